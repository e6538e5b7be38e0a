"""URL rules by a sort-merge range join, in DataFrame functions only.

The key of a host and path is the host's labels in reverse, each ended by a
dot, then ``#`` and the path: ``a.example.org/en/1`` is
``org.example.a.#/en/1``. A rule is one interval of keys, all that begin with
its own; such intervals are nested or apart. A url asks once for its host and
once for every host above it, as a rule of those fits it too. Interval ends
and asked keys (distinct first, so that a hot host is one key) are dealt by
range and sorted together. The sweep counts the open intervals: a rule opens
one level, its end closes one. Its stack of active rules is, for each level
up to the present one, the rule that opened it last; so the innermost rule at
a key is the last one opened at the key's own level, a window within the
partition, or, where that lies in an earlier partition, what the partitions
before carry over at this level. The innermost rule of a host is its longest;
the longest of all its hosts' decides a url. Rows are linear in rules and urls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pagelens.llm import common

#: The rules of the registered query.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = "(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """Between the first '://' and '/', '?', '#' or the end, A-Z lower-cased;
    '' for a null url or one without '://'."""
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def key_of(host: Column, path: Column) -> Column:
    """Neither hosts nor paths of urls hold the ``#`` between the two."""
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.", -1)), "."), F.lit(".#"), path).cast("binary")


def plain_rules(rules: DataFrame) -> DataFrame:
    """(host, path, verdict), one verdict for a host and path: block wins."""
    return (rules.where(F.col("host").isNotNull() & F.col("verdict").isNotNull())
            .select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
            .groupBy("host", "path").agg(F.max("verdict").alias("verdict")))


def events(rules: DataFrame, asked: DataFrame) -> DataFrame:
    """(key, kind, step, what): two rows for a rule, one for an asked key."""
    key = key_of(F.col("host"), F.col("path"))
    rule = F.struct("host", "path", "verdict")
    bounds = rules.select(F.explode(F.array(
        F.struct(key.alias("key"), F.lit(1).alias("step"), rule.alias("what")),
        # no text in UTF-8 holds the byte FF: all keys that begin with the rule's lie before
        F.struct(F.concat(key, F.unhex(F.lit("FF"))).alias("key"), F.lit(-1).alias("step"), rule.alias("what")))).alias("e"))
    asks = asked.select(key.alias("key"), F.lit(1).alias("kind"), F.lit(0).alias("step"),
                        F.struct("host", "path", F.lit(None).cast("string").alias("verdict")).alias("what"))
    return bounds.select("e.key", F.lit(0).alias("kind"), "e.step", "e.what").unionByName(asks)


def sweep(rules: DataFrame, asked: DataFrame) -> DataFrame:
    """(host, path, rule) for every asked (host, path) that lies in a rule of
    its very host: the innermost one."""
    # written with its partition's number: dealt once, read by all steps below
    dealt = common.written(events(rules, asked).repartitionByRange("key", "kind").withColumn("part", F.spark_partition_id()), "url-sweep")
    # one row per partition, whatever the input
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = (dealt.groupBy("part").agg(F.sum("step").alias("change"))
              .select("part", F.coalesce(F.sum("change").over(before), F.lit(0)).alias("at")))
    here = W.partitionBy("part").orderBy("key", "kind").rowsBetween(W.unboundedPreceding, 0)

    def levelled(rows: DataFrame) -> DataFrame:
        return rows.join(starts, "part").withColumn("level", F.col("at") + F.sum("step").over(here))

    opened = (levelled(dealt.where("kind = 0")).where("step = 1").groupBy("part", "level")
              .agg(F.max_by("what", "key").alias("rule")).withColumn("own", F.lit(1)))
    needed = (starts.where("at > 0").select("part", F.explode(F.sequence(F.lit(1), F.col("at"))).alias("level"))
              .withColumns({"rule": F.lit(None).cast(opened.schema["rule"].dataType), "own": F.lit(0)}))
    # the last rule opened at this level in an earlier partition
    earlier = W.partitionBy("level").orderBy("part", "own").rowsBetween(W.unboundedPreceding, 0)
    carried = (needed.unionByName(opened).withColumn("carried", F.last("rule", ignorenulls=True).over(earlier))
               .where("own = 0").select("part", "level", "carried"))
    level = W.partitionBy("part", "level").orderBy("key", "kind").rowsBetween(W.unboundedPreceding, 0)
    seen = (levelled(dealt).withColumn("seen", F.last(F.when(F.col("step") == 1, F.col("what")), ignorenulls=True).over(level))
            .where("kind = 1 AND level > 0"))
    return (seen.join(carried, ["part", "level"], "left")
            .select("what.host", "what.path", F.coalesce("seen", "carried").alias("rule")))


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """Append host, path, rule and verdict to every row.

    The rule with the longest host and path wins; of equal lengths the one
    with the longer host. Without a rule the verdict is allow, or block where
    the url has no host. Null urls have empty host and path. Repeated rows
    stay; an empty table stays empty; no rules judge by the default alone.
    Columns of these names in the input are lengthened in the output."""
    names = {}
    for wish in ("host", "path", "rule", "verdict"):
        names[wish] = common.fresh(pages.columns + list(names.values()), wish)
    rules = common.written(plain_rules(rules), "url-rules")
    # no rule reads a path further than this
    longest = rules.agg(F.max(F.length("path"))).first()[0] or 0
    url = F.col(url_col)
    read = pages.withColumns({names["host"]: host_of(url), names["path"]: path_of(url)})
    host, path, best = (common.fresh(read.columns, x) for x in ("_host", "_path", "_best"))
    read = read.withColumn(path, F.substring(F.col(names["path"]), 1, longest))
    urls = common.written(read.select(F.col(names["host"]).alias(host), path).distinct(), "url-keys")
    labels = F.split(host, "\\.", -1)
    above = urls.select(host, F.col(path).alias("path"), F.explode(F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("host"))
    found = (above.join(sweep(rules, above.select("host", "path").distinct()), ["host", "path"])
             .groupBy(F.col(host), F.col("path").alias(path))
             .agg(F.max(F.struct((F.length("rule.host") + F.length("rule.path")).alias("size"), F.length("rule.host").alias("hosts"),
                                 F.col("rule.verdict").alias("verdict"), F.concat("rule.host", "rule.path").alias("rule"))).alias(best)))
    joined = read.withColumn(host, F.col(names["host"])).join(found, [host, path], "left")
    default = F.when(F.col(names["host"]) == "", "block").otherwise("allow")
    return (joined.withColumns({names["rule"]: F.col(best)["rule"], names["verdict"]: F.coalesce(F.col(best)["verdict"], default)})
            .select(*pages.columns, *names.values()))


def rule_table(spark, rules=None) -> DataFrame:
    rows = ", ".join("('" + "', '".join(x.replace("'", "''") for x in r) + "')" for r in (rules or RULES))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(verdict, host, path)")


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir.rstrip('/')}/pages.parquet").select("page_id", "url")
    return judge(pages, rule_table(spark)).drop("url")


ORACLE = """
WITH p AS (
  SELECT page_id, strpos(url, '://') AS pos, substr(url, strpos(url, '://') + 3) AS rest, url FROM pages),
q AS (
  SELECT page_id,
    CASE WHEN pos > 0 THEN translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN pos > 0 THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM p),
r(verdict, rhost, rpath) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
  ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
b AS (
  SELECT page_id, host, path, max({'s': length(rhost) + length(rpath), 'h': length(rhost), 'v': verdict, 'r': rhost || rpath}) AS best
  FROM q JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY ALL)
SELECT q.page_id, q.host, q.path, b.best.r AS rule, coalesce(b.best.v, CASE WHEN q.host = '' THEN 'block' ELSE 'allow' END) AS verdict
FROM q LEFT JOIN b USING (page_id)
"""
