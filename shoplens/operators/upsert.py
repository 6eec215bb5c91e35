"""Keyed merge operators of the ingest: latest-wins upsert, first-wins
insert of unseen jobs, the unseen-job anti join and ingest statistics.

Latest-per-key is an *aggregation* (``max_by`` over a sequence struct),
not a window: it is partially aggregated map-side, so a key with millions
of versions is reduced per task before the shuffle instead of being
sorted inside one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEQ = "_seq"
#: Errors that a sync run reports.
ERROR_LIMIT = 25


def with_seq(df: DataFrame, *order: Column | str) -> DataFrame:
    """Attach the ordering used to decide which version of a key wins."""
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    return df.withColumn(SEQ, F.struct(*cols))


def latest_per_key(df: DataFrame, key: str = "id", seq: str = SEQ) -> DataFrame:
    """E5: keep the row with the greatest ``seq`` per key (rows with a NULL
    key are dropped: a primary key is never NULL)."""
    payload = [c for c in df.columns if c not in (key, seq)]
    g = (df.filter(F.col(key).isNotNull()).groupBy(key)
         .agg(F.max_by(F.struct(*payload), F.col(seq)).alias("_r")))
    return g.select(key, *[F.col(f"_r.{c}").alias(c) for c in payload])


def first_per_key(df: DataFrame, key: str = "id", seq: str = SEQ) -> DataFrame:
    payload = [c for c in df.columns if c not in (key, seq)]
    g = (df.filter(F.col(key).isNotNull()).groupBy(key)
         .agg(F.min_by(F.struct(*payload), F.col(seq)).alias("_r")))
    return g.select(key, *[F.col(f"_r.{c}").alias(c) for c in payload])


def upsert_latest(existing: DataFrame | None, batch: DataFrame, key: str = "id",
                  seq: str = SEQ) -> DataFrame:
    """Replace by key, newest version wins.  Keys absent
    from the batch are kept (children missing from a new document are not
    deleted).  Both inputs carry ``seq``; the result drops it."""
    both = batch if existing is None else existing.unionByName(batch)
    return latest_per_key(both, key, seq)


def upsert_first(existing: DataFrame | None, batch: DataFrame, key: str = "id",
                 seq: str = SEQ) -> DataFrame:
    """Insert jobs whose id is not stored yet; stored rows never change
    (the first stored version wins, later documents are ignored)."""
    if existing is None:
        return first_per_key(batch, key, seq)
    # known ids go first: only documents of unseen ones are compared
    new = first_per_key(batch.join(existing.select(key), key, "left_anti"), key, seq)
    return existing.select(*new.columns).unionByName(new)


def unseen_job_ids(summaries: DataFrame, known_ids: DataFrame) -> DataFrame:
    """Job summaries whose id is not in the known set (anti join on
    the distinct ids; one row per unseen job id)."""
    ids = summaries.groupBy("job_id").agg(
        F.min("repair_order_number").alias("repair_order_number"),
        F.count(F.lit(1)).alias("mentions"))
    return ids.join(known_ids.select(F.col("id").alias("job_id")), "job_id", "left_anti")


def ingest_stats(summaries: DataFrame, known_ids: DataFrame, fetched: DataFrame) -> DataFrame:
    """Found / synced / skipped / failed over one sync run.

    Every summary mention is 'found'.  A mention of a known job is skipped;
    the first mention of an unseen job whose document parsed is synced and
    later mentions of it are skipped (it is known by then); every mention of
    an unseen job without a usable document fails.  Computed per job id
    with a partial aggregate, so one job mentioned everywhere is one row per
    task before the shuffle.
    """
    per_id = summaries.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"))
    known = known_ids.select(F.col("id").alias("job_id"), F.lit(True).alias("known"))
    ok = fetched.select(F.col("id").alias("job_id"), F.lit(True).alias("ok")).dropDuplicates(["job_id"])
    t = per_id.join(known, "job_id", "left").join(ok, "job_id", "left")
    is_known = F.coalesce(F.col("known"), F.lit(False))
    is_ok = F.coalesce(F.col("ok"), F.lit(False))
    n = F.col("n")
    return t.agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("jobs_found"),
        F.coalesce(F.sum(F.when(~is_known & is_ok, 1).otherwise(0)), F.lit(0)).cast("long")
        .alias("jobs_synced"),
        F.coalesce(F.sum(F.when(is_known, n).when(is_ok, n - 1).otherwise(0)), F.lit(0))
        .cast("long").alias("jobs_skipped"),
        F.coalesce(F.sum(F.when(~is_known & ~is_ok, n).otherwise(0)), F.lit(0)).cast("long")
        .alias("jobs_failed"))


def ingest_errors(summaries: DataFrame, known_ids: DataFrame, fetched: DataFrame,
                  limit: int = ERROR_LIMIT) -> DataFrame:
    """the first ``limit`` failed mentions (by order number, job id).

    The ids of stored and of fetched jobs move by key, in one join: their size
    is estimated from compressed files that hold much else (1.2 MB for 35
    million ids), so Spark would send all of them through the driver.
    """
    stored = known_ids.select(F.col("id").alias("job_id")).unionByName(fetched.select(F.col("id").alias("job_id")))
    failed = summaries.join(stored.hint("merge"), "job_id", "left_anti")
    return (failed.orderBy("repair_order_number", "job_id").limit(int(limit))
            .select(F.col("repair_order_number").alias("repair_order"), "job_id",
                    F.lit("job document missing or unreadable").alias("error")))
