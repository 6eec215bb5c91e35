"""Shards by balanced label propagation (DataFrame functions only).

Documents with equal texts are linked through the hub of their text.  Each
document starts in the shard of its hash; in every round the documents of a
hub that are not in its best shard, where most of the hub's documents are (ties
by a hash that changes each round; by turns among all shards and among those
with room), ask to move there.  Quotas are set per pair
of shards: what two shards ask of each other is swapped, which changes no size,
and what is asked beyond that is admitted as far as the receiving shard has
room.  Every move brings more of a hub together, so rounds come to an end; the
last is the first to move less than one linked document in a thousand.

The documents of one hub in one shard are interchangeable, so the state is a
table of *cells* (hub, shard, number of documents): a hub of a third of all
rows has as many cells as there are shards.  Admission needs running sums of
the requests between two shards; they come from a histogram of priorities and
from windows over single priority classes, so no window spans a shard.  The
law is ``rows``: shard counts differ by one at most.  What a shard holds beyond
its share leaves it hub by hub, and fills what is left elsewhere in that order,
so that sizes are mended by whole texts but for one at each border.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

SHARDS = 24
#: A round that moves a smaller share of the linked documents is the last; and a guard against rounds without end.
SETTLED, MOST_ROUNDS = 1e-3, 200
#: Rows that are numbered in one go, about.
BUCKET_ROWS, CLASSES = 20_000, 512


def _prefix(df: DataFrame, by: list[str], order: list[str], n: str, name: str) -> DataFrame:
    """``df`` (small: a row per part) with the sum of ``n`` over earlier rows."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(n).over(w), F.lit(0)).cast("long"))


def _by_shard(df: DataFrame, shard: str) -> dict[int, int]:
    """Documents per shard (a row per shard)."""
    return {r["s"]: r["n"] for r in df.groupBy(F.col(shard).alias("s")).agg(F.sum("n").alias("n")).collect()}


def _quotas(asked: dict[tuple[int, int], int], free: dict[int, int]) -> dict[tuple[int, int], int]:
    """Documents that may move between each two shards: swaps, and as many more as there is room for."""
    out = {(s, t): min(n, asked.get((t, s), 0)) for (s, t), n in asked.items()}
    for t in free:
        more = {s: n - out[s, to] for (s, to), n in asked.items() if to == t and n > out[s, to]}
        room, wanted = max(0, free[t]), sum(more.values())
        given = {s: n if wanted <= room else room * n // wanted for s, n in more.items()}
        for s in sorted(more, key=lambda s: -more[s]):  # what rounding down has left
            given[s] += max(0, min(more[s] - given[s], room - sum(given.values())))
            out[s, t] += given[s]
    return out


def propagate(cells: DataFrame, targets: dict[int, int], settled: float = SETTLED) -> DataFrame:
    """Cells (hub, shard, n) after label propagation under ``targets`` (rows per
    shard).  No move takes a load above its target, or further above it, but for
    the few that gather the rest of a hub at the end."""
    spark = cells.sparkSession
    state = saved(cells, "cells")
    linked = state.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hub = Window.partitionBy("hub")  # at most one row per shard
    quiet = 0
    for turn in range(MOST_ROUNDS):
        load = _by_shard(state, "shard")
        free = {s: t - load.get(s, 0) for s, t in targets.items()}
        # by turns: the best of all shards, which swaps reach, and the best of those with room
        open_to = [s for s in targets if turn % 2 == 0 or free[s] > 0]
        rank = F.struct("n", F.xxhash64("hub", "shard", F.lit(turn)).alias("tie"), "shard")
        asks = saved(state.withColumn("best", F.max(F.when(F.col("shard").isin(open_to), rank)).over(hub))
                     .withColumn("size", F.sum("n").over(hub))
                     .select("hub", "shard", "n", "size", F.col("best.shard").alias("to"), F.col("best.n").alias("n_to"))
                     .filter("to <> shard and n <= n_to"), "asks")
        # a row per pair of shards
        asked = {(r["shard"], r["to"]): r["n"] for r in asks.groupBy("shard", "to").agg(F.sum("n").alias("n")).collect()}
        quotas = [(s, t, n) for (s, t), n in _quotas(asked, free).items() if n]
        quiet = quiet + 1 if sum(n for _, _, n in quotas) <= settled * linked else 0
        if quiet == 2:
            return _gathered(state, min(targets.values()))
        if quiet:
            continue
        moves = saved(_admitted(asks, spark.createDataFrame(quotas, "shard int, to int, quota long")), "moves")
        change = moves.select("hub", F.explode(F.array(
            F.struct("shard", (-F.col("moved")).alias("n")),
            F.struct(F.col("to").alias("shard"), F.col("moved").alias("n")))).alias("c")).select("hub", "c.shard", "c.n")
        state = saved(state.unionByName(change).groupBy("hub", "shard").agg(F.sum("n").alias("n")).filter("n > 0"), "cells")
    raise RuntimeError(f"label propagation did not settle in {MOST_ROUNDS} rounds")


def _gathered(cells: DataFrame, share: int) -> DataFrame:
    """What is left of hubs that fit a shard joins their best cell, with room or
    without: sizes are mended by whole hubs afterwards."""
    hub = Window.partitionBy("hub")
    best = F.max(F.struct("n", F.xxhash64("hub", "shard").alias("tie"), "shard")).over(hub)
    to = F.when(F.sum("n").over(hub) <= share, best["shard"]).otherwise(F.col("shard"))
    return saved(cells.withColumn("to", to).groupBy("hub", F.col("to").alias("shard")).agg(F.sum("n").alias("n")), "cells")


def _admitted(asks: DataFrame, quotas: DataFrame) -> DataFrame:
    """``asks`` with how many documents of each (`moved`) the quota between its
    two shards admits: larger hubs first, in hash order within a size."""
    asks = asks.withColumn("class", (F.lit(64) - F.floor(F.log2(F.col("size").cast("double")))).cast("int") * CLASSES
                           + F.pmod(F.xxhash64("hub"), F.lit(CLASSES)).cast("int"))
    way = ["shard", "to"]
    by_class = _prefix(asks.groupBy(*way, "class").agg(F.sum("n").alias("m")), way, ["class"], "m", "ahead")
    run = Window.partitionBy(*way, "class").orderBy("hub").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("ahead") + F.coalesce(F.sum("n").over(run), F.lit(0))
    # the quotas have a row per pair of shards
    return (asks.join(by_class.drop("m"), [*way, "class"]).join(F.broadcast(quotas), way)
            .withColumn("moved", F.greatest(F.lit(0), F.least("n", F.col("quota") - ahead))).filter("moved > 0"))


def shards(docs: DataFrame, n_shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, size (bytes of the text plus 8),
    text_crc32, law ('rows'), shard, slot, grown_shard (null under this law).

    Shard counts differ by one at most, whatever the texts; slots run from 0
    without gaps.  Documents of equal text share a shard as far as its quota
    allows.  A null text has no bytes and is linked with other null texts and
    empty ones; null ids and repeated rows are rows like others.  With fewer
    rows than shards, some shards stay empty; an empty table gives an empty
    result; other columns are ignored."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = saved(docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.sha2(text, 256).alias("hub"))
        .withColumn("uid", F.monotonically_increasing_id()), "rows")
    n_rows = base.count()
    n_parts = n_shards * max(1, -(-n_rows // (n_shards * BUCKET_ROWS)))
    base = base.withColumn("part", F.pmod(F.xxhash64("doc_id", "uid"), F.lit(n_parts)).cast("int"))
    targets = {s: n_rows // n_shards + (s < n_rows % n_shards) for s in range(n_shards)}

    # linked documents: a hub of at least two; numbered within their hub by (part, rank)
    parts = base.groupBy("hub", "part").agg(F.count("*").alias("m"))
    sizes = parts.groupBy("hub").agg(F.sum("m").alias("hub_size")).filter("hub_size > 1")
    parts = saved(_prefix(parts.join(sizes, "hub"), ["hub"], ["part"], "m", "before"), "parts")
    # texts of more rows than a shard's share start in as few shards as they need, the others where their hash says
    share = max(1, min(targets.values()))
    chunk = F.floor(F.col("before") / share)
    start = F.when(F.col("hub_size") > share, F.pmod(F.xxhash64("hub") + chunk, F.lit(n_shards))).otherwise(F.col("part") % n_shards)
    first = parts.groupBy("hub", start.cast("int").alias("shard")).agg(F.sum("m").alias("n"))
    cells = propagate(first, targets)
    cuts = _prefix(cells, ["hub"], ["shard"], "n", "from_rank").groupBy("hub").agg(
        F.sort_array(F.collect_list(F.struct("from_rank", "shard"))).alias("cells"))  # at most one per shard
    rank = Window.partitionBy("hub", "part").orderBy("doc_id", "uid")
    spread = parts.join(cuts, "hub").select("hub", "part", "before", "cells", "hub_size")
    columns = ["doc_id", "size", "text_crc32", "uid", "h", "hub_size"]
    linked = (base.join(spread, ["hub", "part"])
              .withColumn("r", F.col("before") + F.row_number().over(rank) - 1)
              .withColumn("shard", F.element_at(F.filter("cells", lambda c: c["from_rank"] <= F.col("r")), -1)["shard"])
              .withColumn("h", F.xxhash64("hub")).select(*columns, "shard"))
    linked = saved(linked, "linked")
    numbered = _numbered(linked, "shard", n_rows, share)
    quota = F.broadcast(spark.createDataFrame(list(targets.items()), "shard int, target long"))
    numbered = saved(numbered.join(quota, "shard"), "numbered")
    held = numbered.filter("slot < target").select("doc_id", "size", "text_crc32", "shard", "slot")

    # the rest in one row of places: what is beyond a shard's share, text by text, and documents without links
    over = numbered.filter("slot >= target").select(*columns)
    alone = base.join(sizes, "hub", "left_anti").withColumn("h", F.xxhash64("hub")).withColumn(
        "hub_size", F.lit(1).cast("long")).select(*columns)
    rest = _numbered(over.unionByName(alone).withColumn("all", F.lit(0)), "all", n_rows, share)
    taken = {r["shard"]: r["n"] for r in held.groupBy("shard").agg(F.count("*").alias("n")).collect()}  # a row per shard
    places, at = [], 0
    for s in range(n_shards):
        free = targets[s] - taken.get(s, 0)
        if free:
            places.append((s, at, taken.get(s, 0)))
            at += free
    if places:
        # at most one entry per shard
        where = F.array(*[F.struct(F.lit(lo).cast("long").alias("lo"), F.lit(s).alias("shard"),
                                   F.lit(t).cast("long").alias("taken")) for s, lo, t in places])
        place = F.element_at(F.filter(where, lambda c: c["lo"] <= F.col("slot")), -1)
        filled = rest.withColumn("p", place).select(
            "doc_id", "size", "text_crc32", F.col("p.shard").alias("shard"),
            (F.col("p.taken") + F.col("slot") - F.col("p.lo")).alias("slot"))
    else:
        filled = held.limit(0)
    return held.unionByName(filled).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def _numbered(df: DataFrame, by: str, n_rows: int, share: int) -> DataFrame:
    """``df`` with slot: 0, 1, 2 ... within ``by``, rows of a hub (`h`) side by
    side, hubs of more than ``share`` rows first.  Numbers are given within hash buckets of about :data:`BUCKET_ROWS`
    rows, of which a larger hub has several, and moved by the sums of earlier buckets."""
    buckets = max(1, n_rows // BUCKET_ROWS)
    own = F.ceil(F.col("hub_size") / BUCKET_ROWS)
    large = (own > 1) | (F.col("hub_size") > share)
    b = (df.withColumn("_b", F.when(F.col("hub_size") > share, -1).otherwise(F.pmod("h", F.lit(buckets))).cast("int"))
         .withColumn("_h", F.when(large, F.col("h")).otherwise(F.lit(0).cast("long")))
         .withColumn("_k", F.when(large, F.pmod(F.xxhash64("uid"), own)).otherwise(F.lit(-1)).cast("int")))
    at = ["_b", "_h", "_k"]
    starts = _prefix(b.groupBy(by, *at).agg(F.count("*").alias("_m")), [by], at, "_m", "_start").drop("_m")
    w = Window.partitionBy(by, *at).orderBy("h", "doc_id", "uid")
    return (b.join(starts, [by, *at]).withColumn("slot", F.col("_start") + F.row_number().over(w) - 1)
            .drop(*at, "_start"))
