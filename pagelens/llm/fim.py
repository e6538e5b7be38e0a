"""Fill-in-the-middle by a counted-quantifier regex.

``regexp_count`` gives the number n of units of a text. Two cut points of
0..n follow from the row's key; a pattern made for the row,

    \\A(unit{a}+)(unit{b-a}+)(.*)\\z

captures prefix, middle and suffix in one match, and the replacement puts them
in the order of the row's form. The counted groups are possessive: they loop
without backtracking, so a match takes linear time and constant stack however
long the text is. The key is a hash of the id, so the same row is always cut
alike, whatever task runs it.

The markers cannot be told from text that holds them, so such a text stays
plain; so does an empty one. ``restore`` rebuilds the text from output and form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pagelens.llm import common

UNIT = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_BELOW = 90, 20       # of 100
SEED = "1"
_PSM = f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2"
_SPM = f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2"


def _draw(digest: Column, k: int) -> Column:
    return F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long")


def transform(docs: DataFrame, id_col="doc_id", text_col="text", out="fim", seed: str = SEED) -> DataFrame:
    """Append ``out``: struct(n, form, output, prefix_chars, middle_chars).

    A null text counts as empty: no units, form plain, output ''. A null id
    draws as the id ''. Rows with the same id draw alike; repeated rows stay.
    An empty table gives an empty table. ``out`` and the helper columns are
    lengthened if the input has them."""
    names = []
    for wish in (out, "_fim_text", "_fim_n", "_fim_form", "_fim_a", "_fim_b", "_fim_output"):
        names.append(common.fresh([*docs.columns, *names], wish))
    out, text, n, form, a, b, output = names
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    marked = F.lit(False)
    for m in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains(text, F.lit(m))
    plain = (F.col(n) == 0) | marked | (F.pmod(_draw(digest, 2), F.lit(100)) >= PLAIN_FROM)
    cuts = [F.pmod(_draw(digest, k), F.col(n) + 1) for k in (0, 1)]
    counted = lambda times: F.concat(F.lit(f"((?:{UNIT}){{"), times.cast("string"), F.lit("}+)"))
    pattern = F.concat(F.lit("(?s)\\A"), counted(F.col(a)), counted(F.col(b) - F.col(a)), F.lit("(.*)\\z"))
    order = F.when(F.col(form) == "psm", F.lit(_PSM)).otherwise(F.lit(_SPM))
    place = lambda m: F.locate(m, F.col(output)).cast("long")  # noqa: E731  the markers stand once each
    # a marker has three characters; locate counts from 1
    prefix = F.when(F.col(form) == "psm", place(SUFFIX) - place(PREFIX)).otherwise(place(MIDDLE) - place(PREFIX)) - 3
    middle = F.char_length(output).cast("long") - place(MIDDLE) - 2
    framed = F.col(form) != "plain"
    return (docs.withColumn(text, F.coalesce(F.col(text_col), F.lit("")))
            .withColumn(n, F.regexp_count(F.col(text), F.lit(UNIT)).cast("long"))
            .withColumn(form, F.when(plain, "plain").when(F.pmod(_draw(digest, 3), F.lit(100)) < SPM_BELOW, "spm").otherwise("psm"))
            .withColumn(a, F.least(*cuts)).withColumn(b, F.greatest(*cuts))
            .withColumn(output, F.when(framed, F.regexp_replace(F.col(text), pattern, order)).otherwise(F.col(text)))
            .withColumn(out, F.struct(
                F.col(n).alias("n"), F.col(form).alias("form"), F.col(output).alias("output"),
                F.when(framed, prefix).alias("prefix_chars"), F.when(framed, middle).alias("middle_chars")))
            .drop(text, n, form, a, b, output))


def restore(output, form) -> Column:
    """The text that ``transform`` made ``output`` from, by its form alone."""
    output, form = (F.col(x) if isinstance(x, str) else x for x in (output, form))
    part = "((?s:.*?))"
    psm = F.regexp_replace(output, F.lit(f"\\A{PREFIX}{part}{SUFFIX}{part}{MIDDLE}((?s:.*))\\z"), F.lit("$1$3$2"))
    spm = F.regexp_replace(output, F.lit(f"\\A{SUFFIX}{part}{PREFIX}{part}{MIDDLE}((?s:.*))\\z"), F.lit("$2$3$1"))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def query(spark, sf_dir: str) -> DataFrame:
    made = transform(common.documents(spark, sf_dir).select("doc_id", "text"))
    return made.select(
        "doc_id", F.col("fim.n").alias("n"), F.col("fim.form").alias("form"),
        F.col("fim.prefix_chars").alias("prefix_chars"), F.col("fim.middle_chars").alias("middle_chars"),
        F.sha2(F.col("fim.output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restore("fim.output", "fim.form").cast("binary"), 256).alias("restored_sha256"))


ORACLE = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '{UNIT}') AS units FROM documents),
h AS (
  SELECT *, CAST(len(units) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
         CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h3 % 100 >= {PLAIN_FROM}
              THEN 'plain' WHEN h4 % 100 < {SPM_BELOW} THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (
  SELECT *, array_to_string(units[1:a], '') AS pre, array_to_string(units[a + 1:b], '') AS mid,
         array_to_string(units[b + 1:n], '') AS suf FROM c)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || pre || '{SUFFIX}' || suf || '{MIDDLE}' || mid
         ELSE '{SUFFIX}' || suf || '{PREFIX}' || pre || '{MIDDLE}' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
