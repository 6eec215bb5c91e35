"""Structured Streaming ingest of landed documents.

Two steps, both plain streaming queries:

* **Landing to log** (:func:`start`): ``foreachBatch`` writes a micro-batch's
  own rows, and nothing else, to ``<root>/<table>/log/stream=<id>/batch=<n>``.
  A replayed batch overwrites its own folder, two streams never touch the same
  one, and a run of any number is a batch of its own (J1, J3).  A job is one log
  row with its labor lines and parts, so its lines are never seen without it.
  What cannot be stored is a log row too, with the reason.
* **Log to base** (:func:`merge_log`): a file stream over the log merges its
  rows into ``<root>/<table>/base``, partitioned by a hash of the key, by
  overwriting only the partitions that a batch meets (A5-A9).  Spark's
  checkpoint knows which log files are merged, and moves them to an archive.

Merging keeps the greatest version of a key (orders, employees: the latest
update stamp, then the latest landing, then the greater row) or the smallest
(jobs: the earliest landing).  Both are idempotent and independent of order, so
replays, batch boundaries and the order of streams and runs change nothing, and
:func:`published` may read base and log together at any time.

J2: a stored job is never refreshed.  The job stream asks Spark's streaming
deduplication state which ids are new, so that landings of known jobs are not
even logged.
"""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplens.session import delete_folder, ensure_checkpoint_dir, glob_paths, path_exists
from shoplens.sources import landed
from shoplens.sources import schemas as S

TABLES = ("employees", "repair_orders", "jobs", "labor_lines", "parts")
CORRUPT = "_corrupt_record"
#: Partitions of a base table (by a hash of the key); fixed for the life of a table.
BUCKETS = 64
#: Reasons that only mark a page, not something that was turned away.
MARKS = ("no records",)

KINDS = {"orders": (S.ORDER_PAGE, "repair_orders", landed.order_entries),
         "employees": (S.EMPLOYEE_PAGE, "employees", landed.employee_entries),
         "jobs": (S.JOB, "jobs", landed.job_entries)}


# ------------------------------------------------------------------ log
def batch_path(root: str, table: str, source: str, batch: int) -> str:
    name = re.sub(r"[^A-Za-z0-9_-]", "-", source)
    return f"{root.rstrip('/')}/{table}/log/stream={name}/batch={int(batch)}"


def append(rows: DataFrame, root: str, table: str, source: str, batch: int) -> None:
    """Write a batch's rows to its own folder (again, on a replay)."""
    names = S.LOG[table].names
    rows.select(*names).write.mode("overwrite").parquet(batch_path(root, table, source, batch))


def log(spark: SparkSession, root: str, table: str, only: str = "stream=*/batch=*", without: str = "-") -> DataFrame:
    """Rows of the log's complete batches: of those whose folders match
    ``only`` and do not end in ``without``."""
    folder = f"{root.rstrip('/')}/{table}/log"
    paths = [p[: -len("/_SUCCESS")] for p in glob_paths(spark, f"{folder}/{only}/_SUCCESS")]
    paths = [p for p in paths if not p.endswith(f"/{without}")]
    if not paths:
        return spark.createDataFrame([], S.LOG[table])
    rows = spark.read.schema(S.LOG[table]).option("basePath", folder).option("ignoreMissingFiles", "true").parquet(*paths)
    return rows.select(*S.LOG[table].names)


def _stored(rows: DataFrame, table: str) -> DataFrame:
    """The rows that count, with the columns of the base."""
    return rows.filter(F.col(S.REASON).isNull()).select(*_base_schema(table).names)


def _base_schema(table: str) -> T.StructType:
    return T.StructType([f for f in S.LOG[table] if f.name not in (S.REASON, S.TEXT, "mentions", "page", "pages")])


def _base_path(root: str, table: str) -> str:
    return f"{root.rstrip('/')}/{table}/base-{BUCKETS}"


def _base(spark: SparkSession, root: str, table: str) -> DataFrame:
    schema = T.StructType([*_base_schema(table), T.StructField("bucket", T.IntegerType())])
    if not path_exists(spark, _base_path(root, table)):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(_base_path(root, table))


# ------------------------------------------------------------------ merging
def winners(rows: DataFrame, table: str) -> DataFrame:
    """One row per id: the latest version, of jobs the first."""
    own = [c for c in rows.columns if c not in ("id", "updated_date", S.LANDED_AT)]
    if table == "jobs":
        order, pick = [S.LANDED_AT, "updated_date", *own], F.min
    else:
        order, pick = ["updated_date", S.LANDED_AT, *own], F.max
    best = rows.groupBy("id").agg(pick(F.struct(*order)).alias("_w"))
    return best.select(*[F.col("id") if c == "id" else F.col(f"_w.{c}").alias(c) for c in rows.columns])


def merged(base: DataFrame, new: DataFrame, table: str) -> DataFrame:
    """``base`` (a row per id) with ``new`` rows of any number: stored rows that
    no new row meets pass an anti join, and only the others are compared."""
    ids = new.select("id").distinct()
    met = base.join(ids, "id", "left_semi").unionByName(new)
    return base.join(ids, "id", "left_anti").unionByName(winners(met, table))


def _bucket() -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int").alias("bucket")


def _merge_batch(spark: SparkSession, root: str, table: str, rows: DataFrame, batch_id: int) -> None:
    """Merge log rows into the partitions of the base that they meet.  The
    merged partitions are written aside first: a batch that is replayed after a
    loss in the middle of the overwrite starts from that copy."""
    aside = f"{root.rstrip('/')}/{table}/pending/batch={batch_id}"
    if not path_exists(spark, f"{aside}/merged/_SUCCESS"):
        winners(_stored(rows, table), table).select("*", _bucket()).write.mode("overwrite").parquet(f"{aside}/new")
        new = spark.read.schema(_base(spark, root, table).schema).parquet(f"{aside}/new")
        met = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most BUCKETS
        base = _base(spark, root, table).filter(F.col("bucket").isin(met))
        whole = merged(base.drop("bucket"), new.drop("bucket"), table).select("*", _bucket())
        whole.write.mode("overwrite").parquet(f"{aside}/merged")
    ready = spark.read.schema(_base(spark, root, table).schema).parquet(f"{aside}/merged")
    (ready.hint("rebalance", F.col("bucket")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("bucket").parquet(_base_path(root, table)))
    for old in glob_paths(spark, f"{root.rstrip('/')}/{table}/pending/batch=*"):
        if int(old.rpartition("=")[2]) != batch_id:
            delete_folder(spark, old)


def merge_log(spark: SparkSession, root: str, max_files_per_trigger: int | None = None) -> None:
    """Merge what the log holds so far into the base tables, and return.  One
    such merge at a time: its checkpoint belongs to ``root``."""
    root = root.rstrip("/")
    key = hashlib.sha1(root.encode()).hexdigest()[:16]
    for table in S.LOG:
        if not path_exists(spark, f"{root}/{table}/log"):
            continue
        # stream and batch are folders here
        schema = T.StructType([*S.LOG[table], T.StructField("stream", T.StringType()), T.StructField("batch", T.LongType())])
        reader = (spark.readStream.schema(schema).option("ignoreMissingFiles", "true")
                  .option("cleanSource", "archive").option("sourceArchiveDir", f"{root}/{table}/archive"))
        if max_files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
        rows = reader.parquet(f"{root}/{table}/log")

        def each(batch: DataFrame, batch_id: int, table: str = table) -> None:
            _merge_batch(batch.sparkSession, root, table, batch, batch_id)

        (rows.writeStream.foreachBatch(each).trigger(availableNow=True)
         .option("checkpointLocation", f"{ensure_checkpoint_dir(spark)}/shoplens-merge/{table}-{key}")
         .start().awaitTermination())


# ------------------------------------------------------------------ reading
def job_ids(spark: SparkSession, root: str, without: str) -> DataFrame:
    """Ids of stored jobs, but for what the log holds of one batch only."""
    logged = _stored(log(spark, root, "jobs", without=without), "jobs")
    return _base(spark, root, "jobs").select("id").unionByName(logged.select("id")).distinct()


def _lines(jobs: DataFrame, name: str) -> DataFrame:
    """Lines of stored jobs, a row per line id: that of the job stored last."""
    x = jobs.select(S.LANDED_AT, "updated_date", F.explode(name).alias("l"))
    best = x.groupBy("l.id").agg(F.max(F.struct(S.LANDED_AT, "updated_date", "l")).alias("_w"))
    return best.select("_w.l.*")


def published(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The five tables as base and log say together, and ``rejected`` (kind,
    reason, text): what the log and its archive hold that could not be stored."""
    out = {t: merged(_base(spark, root, t).drop("bucket"), _stored(log(spark, root, t), t), t) for t in S.LOG}
    jobs = out["jobs"]
    out = {t: df.drop(S.LANDED_AT) for t, df in out.items() if t != "jobs"}
    out["jobs"] = jobs.drop(S.LANDED_AT, "labor", "parts")
    out["labor_lines"], out["parts"] = _lines(jobs, "labor"), _lines(jobs, "parts")
    out["rejected"] = rejected(spark, root)
    return out


def rejected(spark: SparkSession, root: str) -> DataFrame:
    """Every landing that could not be stored, each once, merged or not."""
    out = None
    for kind, (_, table, _) in KINDS.items():
        rows = log(spark, root, table)
        archive = f"{root.rstrip('/')}/{table}/archive"
        if path_exists(spark, archive):
            rows = rows.unionByName(spark.read.schema(S.LOG[table]).option("recursiveFileLookup", "true").parquet(archive))
        bad = rows.filter(F.col(S.REASON).isNotNull() & ~F.col(S.REASON).isin(*MARKS)).select(
            F.lit(kind.rstrip("s")).alias("kind"), F.col(S.REASON).alias("reason"), F.col(S.TEXT).alias("text"))
        out = bad if out is None else out.unionByName(bad)
    return out


# ------------------------------------------------------------------ landing
def batch_writer(kind: str, root: str):
    """Writer (batch, batch id, source) of landed documents to the log."""
    _, table, entries = KINDS[kind]

    def write(batch: DataFrame, batch_id: int, source: str) -> None:
        append(entries(batch), root, table, source, batch_id)
    return write


def _unseen_jobs(entries: DataFrame) -> DataFrame:
    """In a stream of job rows: those to log.  Streaming deduplication marks the
    ids it has not met before; which of an id's rows in this batch comes first is
    then decided by :func:`winners`, not by their arrival in the operator."""
    new = entries.filter(F.col(S.REASON).isNull()).select("id").dropDuplicates(["id"])
    marks = new.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in S.LOG["jobs"] if f.name != "id"],
                       F.lit(True).alias("_new"))
    return entries.select(*S.LOG["jobs"].names, F.lit(False).alias("_new")).unionByName(marks)


def _first_of_batch(batch: DataFrame) -> DataFrame:
    """The first row of each id that is new, and what could not be stored."""
    rows = batch.filter(~F.col("_new")).drop("_new")
    new = batch.filter("_new").select("id")
    good = winners(rows.filter(F.col(S.REASON).isNull()).drop(S.REASON, S.TEXT), "jobs").join(new, "id", "left_semi")
    return good.unionByName(rows.filter(F.col(S.REASON).isNotNull()), allowMissingColumns=True)


def landed_at() -> Column:
    return F.col("_metadata.file_modification_time").alias(S.LANDED_AT)


def start(spark: SparkSession, kind: str, landing: str, table_root: str, checkpoint: str | None = None,
          max_files_per_trigger: int | None = None, multi_line: bool = False):
    """Start an availableNow stream for ``kind`` in {orders, employees, jobs}.
    Returns the StreamingQuery (call ``awaitTermination()``).  Without a
    ``checkpoint``, each pair of landing folder and table root has its own."""
    schema, table, entries = KINDS[kind]
    schema = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    reader = (spark.readStream.schema(schema).option("multiLine", str(multi_line).lower())
              .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    rows = entries(reader.json(landing).select("*", landed_at()))
    pair = hashlib.sha1(f"{landing.rstrip('/')}\n{table_root.rstrip('/')}".encode()).hexdigest()[:16]
    ckpt = checkpoint or f"{ensure_checkpoint_dir(spark)}/shoplens-stream/{kind}-{pair}"
    if kind == "jobs":
        # ids of all jobs ever seen: more than fits a heap, so the state lives in RocksDB
        spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                       "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        rows = _unseen_jobs(rows)

    def each(batch: DataFrame, batch_id: int) -> None:
        # the id that Spark gave this checkpoint: another checkpoint is another stream
        text = batch.sparkSession.read.option("wholetext", "true").text(f"{ckpt}/metadata").first()[0]
        if kind == "jobs":
            batch = _first_of_batch(batch)
        append(batch, table_root, table, f"stream-{json.loads(text)['id']}", batch_id)

    return (rows.writeStream.foreachBatch(each).option("checkpointLocation", ckpt)
            .trigger(availableNow=True).start())
