"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import uuid

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F

from pagelens import session


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def ready(spark: SparkSession) -> None:
    """Python workers need the package; ship it once per application."""
    session.ship_package(spark)


def fresh(columns, wish: str) -> str:
    """``wish``, lengthened until it clashes with none of ``columns``
    (Spark compares names without case)."""
    taken = {c.lower() for c in columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def written(df: DataFrame, name: str) -> DataFrame:
    """Materialise under ``spark.checkpoint.dir`` and read back with the known
    schema: cuts lineage in a folder that all executors share."""
    return session.write_table(df, name)


def broadcast(spark: SparkSession, value) -> Broadcast:
    return spark.sparkContext.broadcast(value)


def crc_of_id(id_col="doc_id", modulus: int = 3):
    """crc32 of the id as text, modulo ``modulus``; a null id counts as ''."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(modulus))


def running(items: str, kind: str, zero: str, step, merge, row) -> str:
    """SQL: for each of ``items`` the struct ``row``, made from what came before.

    ``step(state, x)`` is the state after x, ``merge(state, state)`` that of two
    runs in a row and ``zero`` its start; ``row(state, x)`` gets the state before
    x; ``kind`` is the row's SQL type. An array that grows by one costs its
    length each time, so the items go in blocks of about the root of their
    number: first every block's own state, then the state before each block,
    then the rows of each block."""
    none = f"cast(array() as array<{kind}>)"
    grown = f"struct({step('r_s.at', 'r_x')} as at, concat(r_s.out, array({row('r_s.at', 'r_x')})) as out)"
    after = merge("r_s.at", "r_b.own")
    return f"""transform(array({items}), r_every -> transform(array(transform(
        transform(array(cast(greatest(32, sqrt(size(r_every))) as int)), r_n -> transform(sequence(0, greatest(size(r_every) - 1, 0) div r_n), r_i -> slice(r_every, cast(r_i * r_n as int) + 1, r_n)))[0],
        r_part -> struct(r_part as part, aggregate(r_part, {zero}, (r_s, r_x) -> {step('r_s', 'r_x')}) as own))),
      r_blocks -> flatten(zip_with(r_blocks, aggregate(r_blocks, struct({zero} as at, array({zero}) as out),
          (r_s, r_b) -> struct({after} as at, concat(r_s.out, array({after})) as out), r_s -> r_s.out),
        (r_b, r_before) -> if(r_b is null, {none}, aggregate(r_b.part, struct(r_before as at, {none} as out), (r_s, r_x) -> {grown}, r_s -> r_s.out)))))[0])[0]"""


def token() -> str:
    return uuid.uuid4().hex[:12]
