"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplens.session import ensure_checkpoint_dir

#: What separates words: the space and U+0009..U+000D; everything else is part of a word.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read again: cuts the
    lineage, survives lost executors, and gives later plans true sizes."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or one like it that no column of ``df`` has (case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def salt(of: list[str], salts: int = 64) -> Column:
    return F.pmod(F.xxhash64(*of), F.lit(salts)).cast("int")


def with_group_totals(df: DataFrame, keys: list[str], salt_on: list[str], partial: list[Column],
                      final: list[Column], salts: int = 64, how: str = "inner",
                      having: Column | None = None) -> DataFrame:
    """Each row of ``df`` with the totals of its group, although a group may
    hold a third of all rows: totals are summed per (keys, salt) and then per
    key, and come back to the rows per (keys, salt), so that a hot key is
    spread over ``salts`` tasks.  Keys must not be null."""
    salted = df.withColumn("_salt", salt(salt_on, salts))
    totals = (salted.groupBy(*keys, "_salt").agg(*partial)
              .groupBy(*keys).agg(*final, F.collect_list("_salt").alias("_salts")))
    if having is not None:
        totals = totals.filter(having)
    spread = totals.withColumn("_salt", F.explode("_salts")).drop("_salts")
    return salted.join(spread, [*keys, "_salt"], how).drop("_salt")


def null_safe_semi(df: DataFrame, ids: DataFrame, cols: list[str], how: str = "left_semi") -> DataFrame:
    """Rows of ``df`` whose ``cols`` are (not) among the rows of ``ids``; nulls match nulls."""
    right = ids.select([F.col(c).alias(f"_r_{c}") for c in cols])
    on = F.lit(True)
    for c in cols:
        on = on & df[c].eqNullSafe(right[f"_r_{c}"])
    return df.join(right, on, how)


def components(links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Connected components of ``links`` (a long, b long) as (id, component_id):
    the smallest id that links reach, for every id that has a link.

    Alternating large-star and small-star steps: each is one aggregation and
    one join per vertex, and every round is written to the shared folder.  Ends
    when a round changes nothing; nothing is collected but a checksum."""
    spark = links.sparkSession
    edges = saved(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                  .distinct(), "edges")

    def mark(df: DataFrame) -> tuple:
        r = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return tuple(r)

    before = mark(edges)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .filter("u <> v").distinct())
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(down, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionAll(down.select("u", F.col("m").alias("v"))).distinct())
        edges = saved(small, "edges")
        after = mark(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("id")).distinct()
    return (edges.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
            .unionAll(roots.select("id", F.col("id").alias("component_id"))))
