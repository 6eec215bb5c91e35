"""Merkle manifest of a table as a postorder append log.

Leaves are numbered within their group; a node at level l and index i covers
the leaves i * 3^l up to (i + 1) * 3^l, or up to the group's end.  Builders
work on aligned blocks of 3^6 nodes, one group of rows each, and write a node
the moment its last child is there, so that the log is in postorder.  Where a
node lies in that log follows from the sizes of the subtrees alone
(:func:`position`), so a proof addresses the siblings it needs by position and
never walks the tree.  Block roots are the input of the next, 729 times
smaller round; a group with any number of leaves is spread over many tasks in
all rounds, and no task holds more than a block.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

ARITY = 3
#: Levels that one builder adds on top of its block of ARITY ** BLOCK_LEVELS nodes.
BLOCK_LEVELS = 6
BLOCK = ARITY ** BLOCK_LEVELS

LOG = "key string, n long, level int, index long, position long, digest string, block long, is_root boolean"
STEPS = "array<struct<left: string, right: string>>"
STEP_TYPE = pa.struct([("left", pa.string()), ("right", pa.string())])


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def height(n: int) -> int:
    """Levels above the leaves of a tree with ``n`` of them."""
    h = 0
    while n > 1:
        n = -(-n // ARITY)
        h += 1
    return h


def position(level: int, index: int, n: int, top: int) -> int:
    """Place in the postorder log of the node (level, index) of a tree with
    ``n`` leaves and height ``top``: as many nodes as there are, up to its last
    leaf, at its own and lower levels, and before its first leaf at higher ones."""
    end = min(n, (index + 1) * ARITY ** level)
    at = -1
    for k in range(level + 1):
        at += -(-end // ARITY ** k)
    for k in range(level + 1, top + 1):
        index //= ARITY
        at += index
    return at


def field(c: Column) -> Column:
    """``-`` for null, else the length in UTF-8 bytes, a colon and the value."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def group_key(c: Column) -> Column:
    """A string never null that sorts as the column does, null first."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Saved rows with `index` (from 0, gapless within `key`, in ``order``) and
    `n` (rows of the key).  The table is sorted over all tasks and numbered by
    place within a task and the counts of earlier tasks; a key with a third of
    all rows is many tasks."""
    ranged = saved(rows.withColumn("_tie", F.monotonically_increasing_id())
                   .orderBy("key", *[F.col(c).asc_nulls_first() for c in order], "_tie").drop("_tie")
                   .withColumn("_part", F.spark_partition_id())
                   .withColumn("_at", F.monotonically_increasing_id()), "merkle-sorted")
    per = ranged.groupBy("key", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_c"))
    own = Window.partitionBy("key")
    before = own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("key", "_part", "_first", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"),
                     F.sum("_c").over(own).alias("n"))
    return saved(ranged.join(per, ["key", "_part"])
                 .withColumn("index", F.col("_at") - F.col("_first") + F.col("_before"))
                 .drop("_part", "_at", "_first", "_before"), "merkle-numbered")


def _build(base: int):
    """Builder of a block of nodes at level ``base``: appends them in order and
    every node above them as it is completed."""

    def build(key, nodes):
        group, block = key[0].as_py(), key[1].as_py()
        members = sorted(zip(nodes["index"].to_pylist(), nodes["digest"].to_pylist()))
        n = nodes["n"][0].as_py()
        top = height(n)
        last = min(base + BLOCK_LEVELS, top)
        counts = [-(-n // ARITY ** k) for k in range(last + 1)]
        out: list[tuple] = []
        open_runs: list[list[str]] = [[] for _ in range(last + 1)]

        def append(level: int, index: int, digest: str) -> None:
            if level > base or base == 0:
                out.append((level, index, position(level, index, n, top), digest))
            if level == last:
                return
            run = open_runs[level]
            run.append(digest)
            if len(run) == ARITY or index == counts[level] - 1:
                whole = sha("".join(run))
                run.clear()
                append(level + 1, index // ARITY, whole)

        for index, digest in members:
            append(base, index, digest)
        levels, indexes, positions, digests = (list(x) for x in zip(*out))
        m = len(out)
        return pa.table({"key": pa.array([group] * m, pa.string()), "n": pa.array([n] * m, pa.int64()),
                         "level": pa.array(levels, pa.int32()), "index": pa.array(indexes, pa.int64()),
                         "position": pa.array(positions, pa.int64()), "digest": pa.array(digests, pa.string()),
                         "block": pa.array([block] * m, pa.int64()),
                         "is_root": pa.array([lv == top for lv in levels], pa.bool_())})

    return build


def _round(nodes: DataFrame, base: int) -> DataFrame:
    blocks = nodes.select("key", F.floor(F.col("index") / BLOCK).cast("long").alias("block"), "index", "n", "digest")
    return saved(blocks.groupBy("key", "block").applyInArrow(_build(base), LOG), f"merkle-log-{base}")


def append_log(leaves: DataFrame) -> list[DataFrame]:
    """The log over numbered ``leaves`` (key, index, n, digest): a table per
    round with a row per node: key, n, level, index, position, digest, block
    (the builder's) and is_root.  By (key, position) their union is the log."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    rounds = [_round(leaves, 0)]
    while BLOCK ** len(rounds) < most:
        base = BLOCK_LEVELS * len(rounds)
        rounds.append(_round(rounds[-1].filter((F.col("level") == base) & ~F.col("is_root")), base))
    return rounds


def _extract(base: int, payload: list[str]):
    """Path of each asked node of a block: its siblings' places in the log in
    closed form, then what the tail says of the block's root."""

    def extract(segment: pa.Table, asked: pa.Table) -> pa.Table:
        rows = segment.to_pydict()
        tail = next(i for i, lv in enumerate(rows["level"]) if lv < 0)
        n = rows["n"][tail]
        top = height(n)
        last = min(base + BLOCK_LEVELS, top)
        log = dict(zip(rows["position"], rows["digest"]))
        rest = [(s["left"], s["right"]) for s in rows["steps"][tail]]
        above: dict[int, list[tuple[str, str]]] = {rows["index"][tail]: rest}
        for level in range(last - 1, base - 1, -1):
            here = {}
            count = -(-n // ARITY ** level)
            for parent, path in above.items():
                first = parent * ARITY
                run = [log[position(level, i, n, top)] for i in range(first, min(first + ARITY, count))]
                for k in range(len(run)):
                    here[first + k] = [("".join(run[:k]), "".join(run[k + 1:])), *path]
            above = here
        lefts, rights, ends = [], [], [0]
        for i in asked["index"].to_pylist():
            for left, right in above[i]:
                lefts.append(left)
                rights.append(right)
            ends.append(len(lefts))
        steps = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(
            [pa.array(lefts, pa.string()), pa.array(rights, pa.string())], fields=list(STEP_TYPE)))
        m = asked.num_rows
        out = {c: asked[c] for c in payload}
        out |= {"steps": steps, "subroot": pa.array([rows["subroot"][tail]] * m, pa.string()),
                "root": pa.array([rows["root"][tail]] * m, pa.string())}
        return pa.table(out)

    return extract


def paths(rounds: list[DataFrame], asked: DataFrame, tails: DataFrame) -> DataFrame:
    """``asked`` (key, index, n and any other columns, a row per leaf wanted)
    with `steps`, the siblings of each level on the left and the right, from
    the leaf to the root of its key and on along ``tails`` (key, steps,
    subroot, root: how the path goes on above each key)."""
    roots = None
    for r, log in enumerate(rounds):
        own = log.filter("is_root").select("key", "n", "index", F.lit(r).alias("at_round"), "digest")
        roots = own if roots is None else roots.unionByName(own)
    # the path above the root block of each key, in the round in which that key ends
    ends = roots.join(tails, "key").select("key", "n", "index", "steps", "subroot", "root", "at_round")
    wanted = None
    for r in range(len(rounds) - 1, -1, -1):
        base = BLOCK_LEVELS * r
        top = ends.filter(F.col("at_round") == r).drop("at_round")
        above = top if wanted is None else top.unionByName(wanted)
        # `index` of a tail is that of its block's root, which is the block's number
        marks = above.select("key", "n", F.lit(-1).alias("level"), "index", F.lit(-1).cast("long").alias("position"),
                             F.lit(None).cast("string").alias("digest"), F.col("index").alias("block"),
                             "steps", "subroot", "root")
        no = [F.lit(None).cast(STEPS).alias("steps"), F.lit(None).cast("string").alias("subroot"),
              F.lit(None).cast("string").alias("root")]
        nodes = rounds[r].select("key", "n", "level", "index", "position", "digest", "block", *no)
        if r:
            under = rounds[r - 1].filter((F.col("level") == base) & ~F.col("is_root"))
            block = F.floor(F.col("index") / BLOCK).cast("long").alias("block")
            nodes = nodes.unionByName(under.select("key", "n", "level", "index", "position", "digest", block, *no))
            members = under.select("key", "n", "index")
        else:
            members = asked
        payload = members.columns
        members = members.withColumn("_block", F.floor(F.col("index") / BLOCK).cast("long"))
        types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in members.schema if f.name != "_block")
        wanted = (nodes.unionByName(marks).groupBy("key", "block")
                  .cogroup(members.groupBy("key", "_block"))
                  .applyInArrow(_asked_only(_extract(base, payload), payload), f"{types}, steps {STEPS}, subroot string, root string"))
        if r:
            wanted = saved(wanted.select("key", "n", "index", "steps", "subroot", "root"), f"merkle-paths-{r}")
    return wanted


def _asked_only(extract, payload: list[str]):
    """Blocks of which no leaf is asked for give no rows."""

    def of(segment, asked):
        if asked.num_rows:
            return extract(segment, asked)
        empty = {c: asked[c] for c in payload}
        return pa.table(empty | {"steps": pa.array([], pa.list_(STEP_TYPE)), "subroot": pa.array([], pa.string()),
                                 "root": pa.array([], pa.string())})

    return of


def folded(start: Column, steps: Column) -> Column:
    """The root that ``start`` and its siblings lead to."""
    return F.aggregate(steps, start, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def siblings(steps: Column) -> Column:
    """All siblings, level by level from the leaf up and left to right, as one text."""
    return F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), "")


def manifest(leaves: DataFrame) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """Trees of numbered ``leaves`` (key, index, n, digest) and one tree over
    their roots in order of the keys: the rounds of the log, and per key how a
    proof goes on above its own tree (`tails`).  Returns (tails, rounds, log of
    the upper tree)."""
    rounds = append_log(leaves)
    roots = None
    for log in rounds:
        own = log.filter("is_root").select(F.col("key").alias("group"), "digest")
        roots = own if roots is None else roots.unionByName(own)
    upper = numbered(roots.withColumn("key", F.lit("")), ["group"])
    over = append_log(upper)
    root = None
    for log in over:
        own = log.filter("is_root").select("key", F.col("digest").alias("root"))
        root = own if root is None else root.unionByName(own)
    none = F.array().cast(STEPS)
    ends = root.select("key", none.alias("steps"), F.col("root").alias("subroot"), "root")
    reached = paths(over, upper, ends)
    tails = saved(reached.select(F.col("group").alias("key"), "steps", F.col("digest").alias("subroot"), "root"),
                  "merkle-tails")
    log = over[0]
    for more in over[1:]:
        log = log.unionByName(more)
    return tails, rounds, log


def document_leaves(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source",
                    fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
                    text_col: str = "text") -> DataFrame:
    """Numbered leaves of ``docs``: key, index, n, doc_id, digest, and `altered`,
    the digest after the test tampering (where 2 divides the checksum of the id,
    line feeds are deleted from the text; null elsewhere).  Whole rows are
    hashed here once; only digests travel afterwards."""
    changed = F.replace(F.col(text_col), F.lit("\n"), F.lit(""))

    def digest(text: Column) -> Column:
        return F.sha2(F.concat(*[field(text if c == text_col else F.col(c)) for c in fields]), 256)

    hit = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(2)) == 0
    rows = docs.select(group_key(F.col(group_col)).alias("key"), F.col(id_col).cast("long").alias("doc_id"),
                       digest(F.col(text_col)).alias("digest"), F.when(hit, digest(changed)).alias("altered"))
    return numbered(saved(rows, "merkle-leaves"), ["doc_id", "digest"])


def audit(docs: DataFrame) -> DataFrame:
    """A row per document with its proof: doc_id, leaf, subroot, root, `proof`
    (array of the siblings left and right of the path, leaf to root),
    proof_sha256 (of all siblings), folded_root (what the tampered leaf, where
    there is one, and the original siblings lead to) and verified.

    Null fields hash as ``-``; a null source is a group of its own and comes
    first; a null id comes first in its group and is never tampered with.
    Repeated rows and ids are leaves of their own, ordered by digest.  An empty
    table gives an empty result.  Other columns are ignored."""
    leaves = document_leaves(docs)
    tails, rounds, _ = manifest(leaves)
    out = paths(rounds, leaves, tails)
    return (out.withColumn("folded_root", folded(F.coalesce("altered", "digest"), F.col("steps")))
            .select("doc_id", F.col("digest").alias("leaf"), "subroot", "root",
                    F.sha2(siblings(F.col("steps")), 256).alias("proof_sha256"), "folded_root",
                    (F.col("folded_root") == F.col("root")).alias("verified"), F.col("steps").alias("proof")))
