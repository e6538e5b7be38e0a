"""Column functions for language-model request planning.

All native expressions; the model call itself is outside Spark (G9 joins a
response table back).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelens.functions.text import JS_WS_CLASS, col_, js_trim

# Defaults of the model configuration.
DEFAULT_MODEL = "milkey/reader-lm-v2:latest"
DEFAULT_MAX_CONTEXT = 131072
CHARS_PER_TOKEN = 3
MIN_CONTEXT = 4096
QWEN_MAX_PREDICT = 8192
# Fixed value: the system prompt sent with every request.
SYSTEM_PROMPT = (
    "You are a content formatter. Clean up and restructure the provided markdown into "
    "well-formatted, readable markdown. For listings or catalogs, create structured tables "
    "with appropriate columns. Remove navigation noise, filter links, and empty sections. "
    "Preserve all data content and links. Output only the cleaned markdown, no explanations."
)


def max_chars(max_context: int = DEFAULT_MAX_CONTEXT) -> int:
    return max_context * CHARS_PER_TOKEN


def truncate_for_context(c, max_context: int = DEFAULT_MAX_CONTEXT) -> Column:
    """Cut to max_context*3 characters."""
    c = col_(c)
    n = max_chars(max_context)
    return F.when(F.length(c) > n, F.substring(c, 1, n)).otherwise(c)


def js_round(x: Column) -> Column:
    """``Math.round`` (halves go up)."""
    return F.floor(x + F.lit(0.5)).cast("long")


def truncation_warning(c, max_context: int = DEFAULT_MAX_CONTEXT) -> Column:
    """The warning text, NULL when nothing was cut."""
    c = col_(c)
    n = max_chars(max_context)
    return F.when(F.length(c) > n, F.format_string(
        "Content truncated from %dKB to %dKB to fit AI context window (%d tokens). "
        "Some content may be missing.",
        js_round(F.length(c) / 1024.0), F.lit(round(n / 1024 + 1e-12)), F.lit(max_context)))


def append_warning(markdown, warning) -> Column:
    """``${markdown}\\n\\n---\\n_${warning}_`` when there is a warning."""
    m, w = col_(markdown), col_(warning)
    return F.when(w.isNull(), m).otherwise(F.concat(m, F.lit("\n\n---\n_"), w, F.lit("_")))


def strip_md_images(c) -> Column:
    """Linked images, images, empty links (+ trailing space), 3+ newlines."""
    c = F.regexp_replace(col_(c), r"\[!\[[^\]]*\]\([^)]+\)\]\([^)]+\)", "")
    c = F.regexp_replace(c, r"!\[[^\]]*\]\([^)]+\)", "")
    c = F.regexp_replace(c, rf"\[\]\([^)]+\)[{JS_WS_CLASS}]*", "")
    return F.regexp_replace(c, r"\n{3,}", "\n\n")


def estimate_tokens(c) -> Column:
    """ceil(chars / 3)."""
    return F.ceil(F.length(col_(c)) / F.lit(float(CHARS_PER_TOKEN))).cast("long")


def dynamic_context(tokens, max_context: int = DEFAULT_MAX_CONTEXT) -> Column:
    """max(4096, min(ceil(1.5 * tokens), max_context))."""
    need = F.ceil(col_(tokens) * F.lit(1.5)).cast("long")
    return F.greatest(F.lit(MIN_CONTEXT).cast("long"), F.least(need, F.lit(max_context).cast("long")))


def model_options(model: Column, tokens: Column, num_ctx: Column) -> Column:
    """Sampling options by model family."""
    qwen = model.contains("qwen") & ~model.contains("reader-lm")
    return F.struct(
        F.when(qwen, F.lit(0.7)).otherwise(F.lit(0.0)).alias("temperature"),
        F.when(qwen, F.lit(0.8)).alias("top_p"),
        F.when(qwen, F.lit(20)).alias("top_k"),
        num_ctx.alias("num_ctx"),
        F.when(qwen, F.least(tokens, F.lit(QWEN_MAX_PREDICT).cast("long"))).alias("num_predict"))


FENCE_RE = r"^```(?:markdown|md|html)?" + rf"[{JS_WS_CLASS}]*" + r"\n([\s\S]*?)\n?```" + rf"[{JS_WS_CLASS}]*$"


def strip_code_fence(c) -> Column:
    """Applied to the trimmed reply; a whole-text fence is unwrapped
    and its body trimmed, anything else is returned as is."""
    t = js_trim(col_(c))
    return F.when(t.rlike(FENCE_RE), js_trim(F.regexp_extract(t, FENCE_RE, 1))).otherwise(t)
