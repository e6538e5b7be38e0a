"""Language-model batch preparation and post-processing.

``plan_requests`` turns a content table into request rows (one per input,
no driver round trip); ``apply_responses`` joins model replies back by
request id; ``token_report`` summarises the batch. Requests carry their
context size so a serving job can sort/bucket by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.functions import llm as L


def plan_requests(df: DataFrame, content_col: str = "content", key_col: str = "page_id",
                  model: str = L.DEFAULT_MODEL, max_context: int = L.DEFAULT_MAX_CONTEXT, keep=()) -> DataFrame:
    """Truncate -> strip images -> size -> options -> request row.
    Columns in ``keep`` pass through (a group for ``token_report``)."""
    from pagelens.session import ensure_parallel
    df = ensure_parallel(df.select(key_col, content_col, *keep), key_col)
    c = F.col(content_col)
    m = F.lit(model)
    staged = df.select(
        F.col(key_col).alias("key"),
        F.length(c).alias("input_chars"),
        (F.length(c) > L.max_chars(max_context)).alias("truncated"),
        L.truncation_warning(c, max_context).alias("warning"),
        L.strip_md_images(L.truncate_for_context(c, max_context)).alias("prompt"), *keep)
    staged = staged.withColumn("tokens", L.estimate_tokens("prompt"))
    staged = staged.withColumn("num_ctx", L.dynamic_context(F.col("tokens"), max_context))
    staged = staged.withColumn("options", L.model_options(m, F.col("tokens"), F.col("num_ctx")))
    messages = F.array(
        F.struct(F.lit("system").alias("role"), F.lit(L.SYSTEM_PROMPT).alias("content")),
        F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")))
    req = F.struct(m.alias("model"), messages.alias("messages"), F.col("options").alias("options"))
    staged = staged.withColumn("request", F.to_json(req))
    # one id per input row (identical inputs keep separate ids, so a reply
    # table keyed by request_id never multiplies rows); ``request_hash``
    # is the same for identical requests, for a serving layer that dedupes
    rid = F.sha2(F.concat_ws("\u0000", F.col("key").cast("string"), F.col("request")), 256)
    return staged.select(
        "key", rid.alias("request_id"), F.sha2("request", 256).alias("request_hash"), m.alias("model"),
        "input_chars", "truncated", "warning", "prompt", "tokens", "num_ctx", "options", "request", *keep)


def chat_requests(turns: DataFrame, model: str = L.DEFAULT_MODEL,
                  max_context: int = L.DEFAULT_MAX_CONTEXT) -> DataFrame:
    """G8 for multi-turn input: ``turns(conv_id, turn, role, text)`` -> one
    request per conversation with the system prompt first and the turns in
    order. A conversation is one group (bounded by its turns)."""
    msgs = turns.groupBy("conv_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))),
                    lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("turns"),
        F.sum(F.length("text")).alias("chars"))
    tokens = F.ceil(F.col("chars") / F.lit(float(L.CHARS_PER_TOKEN))).cast("long")
    num_ctx = L.dynamic_context(tokens, max_context)
    system = F.array(F.struct(F.lit("system").alias("role"), F.lit(L.SYSTEM_PROMPT).alias("content")))
    req = F.struct(F.lit(model).alias("model"), F.concat(system, F.col("turns")).alias("messages"),
                   L.model_options(F.lit(model), tokens, num_ctx).alias("options"))
    return msgs.select("conv_id", F.size("turns").alias("n_messages"), tokens.alias("tokens"),
                       num_ctx.alias("num_ctx"), F.to_json(req).alias("request")) \
        .withColumn("request_id", F.sha2(F.concat_ws("\u0000", F.col("conv_id").cast("string"),
                                                     F.col("request")), 256))


def apply_responses(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """G9 + G10 + G4: ``responses(request_id, reply)``; a missing reply is an
    error row, a present one is unwrapped and gets the truncation warning."""
    j = requests.join(responses, "request_id", "left")
    body = L.append_warning(L.strip_code_fence("reply"), F.col("warning"))
    return j.select("key", "request_id",
                    F.when(F.col("reply").isNotNull(), body).alias("content"),
                    F.when(F.col("reply").isNull(), F.lit("no model response")).alias("error"))


def call_model(requests: DataFrame, fn) -> DataFrame:
    """G9 with a caller-supplied batch function ``fn(pandas.Series of
    request JSON) -> pandas.Series of replies`` run per Arrow batch."""
    import pandas as pd

    from pagelens.session import ship_package
    ship_package(requests.sparkSession)

    def run(it):
        for pdf in it:
            yield pd.DataFrame({"request_id": pdf["request_id"], "reply": fn(pdf["request"])})
    return requests.select("request_id", "request").mapInPandas(run, "request_id string, reply string")


def token_report(requests: DataFrame, by: str = "model") -> DataFrame:
    """Batch size summary per group."""
    return requests.groupBy(by).agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum(F.col("truncated").cast("int")).cast("long").alias("truncated"),
        F.sum("tokens").cast("long").alias("tokens"),
        F.max("tokens").alias("max_tokens"),
        F.sum(F.when(F.col("num_ctx") <= 4096, 1).otherwise(0)).cast("long").alias("ctx_4k"),
        F.sum(F.when((F.col("num_ctx") > 4096) & (F.col("num_ctx") <= 32768), 1).otherwise(0))
        .cast("long").alias("ctx_32k"),
        F.sum(F.when(F.col("num_ctx") > 32768, 1).otherwise(0)).cast("long").alias("ctx_large"))


SKETCH_K = 400         # of the KLL sketches
RANK_ERROR = 0.02      # bound on a quantile's rank error that tests and queries hold it to


def token_sketches(requests: DataFrame, *by) -> DataFrame:
    """A mergeable sketch of the token counts for each group of ``by``
    (a source and a day, say), small enough to keep."""
    return requests.groupBy(*by).agg(F.kll_sketch_agg_bigint(F.col("tokens").cast("long"), F.lit(SKETCH_K)).alias("sketch"))


def token_quantiles(sketches: DataFrame, *by, ranks=(0.5, 0.9, 0.99)) -> DataFrame:
    """Quantiles of the token counts per group of ``by``, from kept
    sketches alone: (by..., n, q, tokens), within ``RANK_ERROR`` of the rank."""
    merged = sketches.groupBy(*by).agg(F.kll_merge_agg_bigint("sketch").alias("sketch"))
    return merged.select(*by, F.kll_sketch_get_n_bigint("sketch").alias("n"), F.explode(F.array(*[
        F.struct(F.lit(float(q)).alias("q"), F.kll_sketch_get_quantile_bigint("sketch", F.lit(float(q))).alias("tokens")) for q in ranks])).alias("x")
    ).select(*by, "n", "x.q", "x.tokens")
