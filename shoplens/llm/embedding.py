"""Near-duplicate vectors by spherical-cap filters.

Filter directions are structured random product codes: a fixed rotation, then
equal parts of the vector, each with its own random code words; a filter is one
code word per part, and a vector passes the filters whose direction its inner
product exceeds its threshold.  These are list-decoded, not enumerated: the
best sums of either half are merged and cut off at the threshold.  Vectors of
one label are joined on filters, and what meets is verified by cosine in double
precision.

Equal vectors of a label are one representative with a multiplicity.  A filter
with many vectors is worked in pairs of blocks of at most :data:`BLOCK`.  Of
several common filters only the smallest counts a link, and of the links only
each block's components leave a task, so a dense cluster makes few rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, saved, with_group_totals

THRESHOLD, BLOCKS, ROTATIONS, PASSED, BLOCK = 0.93, 4, 4, 8, 1500
#: Filters that are compared at once within a block pair.
NAMES = 2048


class Caps:
    """``ROTATIONS`` product codes for ``dim``-dimensional vectors, each with
    ``codewords ** BLOCKS`` filter directions.  A vector's cap threshold in a
    code is such that half as many directions as there are code words exceed it
    (:data:`PASSED` at least), so that a finer code finds as many pairs."""

    def __init__(self, dim: int, codewords: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.codewords, self.width = codewords, -(-dim // BLOCKS)
        full = self.width * BLOCKS
        self.rotations = [np.linalg.qr(rng.standard_normal((full, full)))[0][:dim] for _ in range(ROTATIONS)]
        code = rng.standard_normal((ROTATIONS, BLOCKS, codewords, self.width))
        self.code = code / np.linalg.norm(code, axis=3, keepdims=True)
        self.most = max(PASSED, -(-codewords // 2))
        # among the sums of two descending lists, the best T are among places (i, j) with i * j <= T
        ranks = np.arange(1, self.most + 1)
        self.left, self.right = np.nonzero(np.outer(ranks, ranks) <= self.most)

    def passed(self, unit: np.ndarray) -> np.ndarray:
        """The numbers of the filters that each row of ``unit`` passes, ascending."""
        k, most, out = self.codewords, self.most, []
        for no, (rotation, code) in enumerate(zip(self.rotations, self.code)):
            dots = np.einsum("nbw,bcw->nbc", (unit @ rotation).reshape(len(unit), BLOCKS, self.width), code)
            half = [(dots[:, i, :, None] + dots[:, i + 1, None, :]).reshape(len(unit), k * k) for i in (0, 2)]
            best = [np.argpartition(-h, most - 1, 1)[:, :most] for h in half]
            best = [np.take_along_axis(b, np.argsort(-np.take_along_axis(h, b, 1), 1), 1) for h, b in zip(half, best)]
            a, b = best[0][:, self.left], best[1][:, self.right]
            sums = np.take_along_axis(half[0], a, 1) + np.take_along_axis(half[1], b, 1)
            top = np.argpartition(-sums, most - 1, 1)[:, :most]
            out.append(no * k ** BLOCKS + np.take_along_axis(a, top, 1) * k * k + np.take_along_axis(b, top, 1))
        return np.sort(np.concatenate(out, 1), 1).astype(np.int64)


def _unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _block_links(unit, filters, weight, side, filter_no, threshold):
    """Of one block (pair): how many links each row has that no smaller common
    filter counts, and the smallest row that links reach."""
    n = len(unit)
    ok = unit @ unit.T >= threshold
    np.fill_diagonal(ok, False)
    if side.min() != side.max():
        ok &= side[:, None] != side[None]
    if not ok.any():
        return None
    reach = np.arange(n)
    while True:  # smallest row within reach
        least = np.minimum(reach, np.where(ok, reach[None], n).min(1))
        least = np.minimum(least, least[least])
        if (least == reach).all():
            break
        reach = least
    # only smaller filters of rows that link here, held by two of them at least, can have counted a link
    linked = np.flatnonzero(ok.any(1))
    smaller = [filters[i][filters[i] < filter_no] for i in linked]
    names, times = np.unique(np.concatenate(smaller), return_counts=True)
    names = names[times > 1]
    for at in range(0, len(names), NAMES):  # some at a time, for bounded memory
        some = names[at:at + NAMES]
        has = np.zeros((len(linked), len(some)), np.float32)
        for row, f in enumerate(smaller):
            at_f = np.searchsorted(some, f)
            held = at_f[at_f < len(some)]
            has[row, held[some[held] == f[at_f < len(some)]]] = 1
        ok[np.ix_(linked, linked)] &= has @ has.T == 0
    return ok @ weight, reach


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id",
                    vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors linked directly),
    component_id (smallest vec_id that links reach), kept (vec_id = component_id).

    Vectors link when labels are equal and not null and the cosine is at least
    ``threshold``.  Vectors that are null, zero, empty, or hold null or
    non-finite components link with nothing, nor do vectors of different
    length.  Every row is a vector of its own, also when ids or rows repeat;
    null ids come after all others.  An empty table gives an empty result;
    other columns are ignored.  A link is found if the pair passes a common
    filter: of random pairs at cosine 0.93, at least 99.8 % do at every code
    size (measured in 32, 64 and 384 dimensions), more above it."""
    v = F.col("v")
    sound = (v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
             & F.exists(v, lambda x: x != 0.0))
    rows = saved(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"),
                                F.col(vector_col).cast("array<double>").alias("v"))
                 .withColumn("sound", F.coalesce(sound & F.col("label").isNotNull(), F.lit(False)))
                 .withColumn("uid", F.monotonically_increasing_id()), "vectors")
    # -0.0 and 0.0 are equal but not the same group key on their own
    good = rows.filter("sound").withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    grouped = saved(with_group_totals(good, ["label", "v"], ["uid"],
                                      [F.min("uid").alias("_u"), F.count("*").alias("_c")],
                                      [F.min("_u").alias("rep"), F.sum("_c").alias("copies")]), "copies")
    reps = grouped.filter("uid = rep").select("label", "v", "rep", "copies")
    most = reps.agg(F.count("*")).first()[0]
    codewords = int(min(64, max(16, np.ceil(most ** (1 / BLOCKS)))))

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        caps: dict[int, Caps] = {}
        for frame in frames:
            for dim, same in frame.groupby(frame["v"].map(len)):
                cap = caps.setdefault(dim, Caps(dim, codewords))
                for at in range(0, len(same), 500):
                    some = same.iloc[at:at + 500]
                    matrix = np.array(some["v"].tolist(), np.float64)
                    # by the largest component first: squares neither overflow nor vanish
                    unit = _unit(matrix / np.abs(matrix).max(1, keepdims=True))
                    lists = cap.passed(unit)  # a row each
                    yield pd.DataFrame({
                        "label": some["label"].to_numpy(), "dim": dim, "rep": some["rep"].to_numpy(),
                        "copies": some["copies"].to_numpy(), "unit": [x.tobytes() for x in unit],
                        "filters": [x.tobytes() for x in lists]})

    label_type = dict(reps.dtypes)["label"]
    decoded = saved(reps.mapInPandas(
        decode, f"label {label_type}, dim int, rep long, copies long, unit binary, filters binary"), "caps")

    def numbers(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            lists = [np.frombuffer(x, np.int64) for x in frame["filters"]]
            yield pd.DataFrame({"rep": np.repeat(frame["rep"].to_numpy(), [len(x) for x in lists]),
                                "filter": np.concatenate(lists) if lists else np.empty(0, np.int64)})

    passed = decoded.select("rep", "filters").mapInPandas(numbers, "rep long, filter long")
    members = passed.join(decoded.select("rep", "label", "dim"), "rep")
    sizes = (members.groupBy("label", "dim", "filter").agg(F.count("*").alias("n")).filter("n > 1")
             .withColumn("c", F.ceil(F.col("n") / BLOCK).cast("int")).drop("n"))
    dealt = (members.join(sizes, ["label", "dim", "filter"])
             .withColumn("side", F.pmod(F.xxhash64("rep"), F.col("c")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
             .select("rep", "label", "dim", "filter", "side", F.least("side", "other").alias("bi"),
                     F.greatest("side", "other").alias("bj"))
             .join(decoded.select("rep", "copies", "unit", "filters"), "rep"))
    keys = ["label", "dim", "filter", "bi", "bj"]

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def work(frame: pd.DataFrame, cuts: np.ndarray) -> pd.DataFrame:
            out = []
            rep, copies, side = (frame[c].to_numpy() for c in ("rep", "copies", "side"))
            no, units, lists = frame["filter"].to_numpy(), frame["unit"].to_numpy(), frame["filters"].to_numpy()
            for s, e in zip(cuts[:-1], cuts[1:]):
                if e - s < 2:
                    continue
                order = s + np.argsort(rep[s:e])
                unit = np.frombuffer(b"".join(units[order]), np.float64).reshape(e - s, -1)
                found = _block_links(unit, [np.frombuffer(x, np.int64) for x in lists[order]],
                                     copies[order].astype(np.float64), side[order], no[s], threshold)
                if found is not None:
                    links, reach = found
                    hit = np.flatnonzero((links > 0) | (reach != np.arange(e - s)))
                    out.append((rep[order][hit], links[hit].astype(np.int64), rep[order][reach[hit]]))
            a, n, b = (np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64),) * 3
            return pd.DataFrame({"a": a, "n": n, "b": b})

        rest = None
        for frame in frames:
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            if len(frame):
                new = np.zeros(len(frame), bool)
                for c in keys:
                    x = frame[c].to_numpy()
                    new[1:] |= x[1:] != x[:-1]
                cuts = np.r_[0, np.flatnonzero(new)]
                rest = frame.iloc[cuts[-1]:].reset_index(drop=True)
                if len(cuts) > 1:
                    yield work(frame, cuts)
        if rest is not None and len(rest):
            yield work(rest, np.array([0, len(rest)]))

    verified = saved(dealt.repartition(*keys).sortWithinPartitions(*keys)
                     .mapInPandas(verify, "a long, n long, b long"), "links")
    linked = verified.groupBy("a").agg(F.sum("n").alias("links")).filter("links > 0").withColumnRenamed("a", "rep")
    joined = components(verified.select("a", "b")).withColumnRenamed("id", "rep")
    classes = (reps.select("rep").join(linked, "rep", "left").join(joined, "rep", "left")
               .select("rep", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component_id", "rep").alias("comp")))
    copies = grouped.select("uid", "vec_id", "rep", "copies")
    # a representative may stand for a third of all rows; its row comes back per salt
    spread = with_group_totals(copies, ["rep"], ["uid"], [F.max("copies").alias("_c")], [F.max("_c").alias("_same")])
    placed = spread.join(classes, "rep")
    named = with_group_totals(placed, ["comp"], ["uid"], [F.min("vec_id").alias("_v")], [F.min("_v").alias("component_id")])
    found = named.select("vec_id", (F.col("links") + F.col("copies") - 1).cast("long").alias("n_links"), "component_id")
    alone = rows.filter("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                            F.col("vec_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
