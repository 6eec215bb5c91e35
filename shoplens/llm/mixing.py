"""Temperature mixing of sources (DataFrame functions only).

The token share p of each source is raised to an exponent a and normalised:
weights w = p^a / sum p^a, from the natural shares (a = 1) to equal ones
(a = 0).  The exponent is the largest that meets a target entropy, or the
smallest that keeps every source within the repetition limit, whichever is
larger; it is found by repeated section.  Weights become token budgets, and
budgets are realised as block permutations: in every epoch the documents of a
source are dealt into blocks by a hash and ordered by it within the block;
whole epochs come first, the last one ends where the budget does.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, saved

SECTIONS, ROUNDS = 16, 9


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _order(seed: int, epoch: Column) -> Column:
    """60 bits of the MD5 of seed, epoch and id."""
    text = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def exponent(sources: DataFrame, target_entropy: float, max_repeats: float, budget: int | None) -> float:
    """The exponent for ``sources`` (a row per source with its tokens > 0).

    ``target_entropy``: share of the largest possible entropy, log(number of
    sources).  ``max_repeats``: epochs of the most repeated source.  Each round
    is one aggregation that evaluates the ends of :data:`SECTIONS` sections."""
    total, count = sources.agg(F.sum("n_tokens"), F.count("*")).first()
    if not count or count == 1:
        return 1.0
    p = F.col("n_tokens") / F.lit(float(total))
    wanted = target_entropy * math.log(count)

    def last_true(test: str) -> float:
        """Entropy falls with the exponent, and so do the repeats."""
        lo, hi = 0.0, 1.0
        for _ in range(ROUNDS):
            at = [lo + (hi - lo) * k / SECTIONS for k in range(SECTIONS + 1)]
            cols = []
            for k, a in enumerate(at):
                cols += [F.sum(F.pow(p, F.lit(a))).alias(f"z{k}"), F.sum(F.pow(p, F.lit(a)) * F.log(p)).alias(f"l{k}"),
                         F.max(F.pow(p, F.lit(a - 1.0))).alias(f"hi{k}"), F.min(F.pow(p, F.lit(a - 1.0))).alias(f"lo{k}")]
            r = sources.agg(*cols).first()
            if test == "entropy":
                holds = [math.log(r[f"z{k}"]) - a * r[f"l{k}"] / r[f"z{k}"] >= wanted for k, a in enumerate(at)]
            else:
                holds = [(r[f"hi{k}"] / r[f"lo{k}"] if budget is None else r[f"hi{k}"] / r[f"z{k}"] * budget / total)
                         > max_repeats for k in range(len(at))]
            k = max([i for i, ok in enumerate(holds) if ok], default=0)
            if k == SECTIONS:
                return hi
            lo, hi = at[k], at[k + 1]
        return lo if test == "entropy" else hi

    from_entropy = last_true("entropy")
    from_repeats = last_true("repeats")
    return round(max(from_entropy, from_repeats), 6)


def mixture(docs: DataFrame, target_entropy: float = 0.97, max_repeats: float = 4.0, budget: int | None = None,
            block_tokens: int = 1 << 18, seed: int = 17, id_col: str = "doc_id", text_col: str = "text",
            source_col: str = "source") -> DataFrame:
    """The mix, a row per document and epoch: doc_id, source, n_tokens, epoch,
    mix_block, mix_slot (its place in that block; blocks are in order).

    ``budget``: tokens of the mix; None for the least with which every document
    appears at least once, so that nothing is lost and small sources repeat.
    Tokens are words.  A null source is a source of its own; null and empty
    texts have no tokens, belong to the first epoch and to block 0, and cost nothing.
    Equal places (repeated rows) are ordered by id and length.  An empty table
    gives an empty mix; other columns are ignored."""
    base = saved(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                             F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("null")).alias("_key"),
                             tokens(F.col(text_col)).alias("n_tokens")), "tokens")
    sources = saved(base.groupBy("_key").agg(F.sum("n_tokens").alias("n_tokens")).filter("n_tokens > 0"), "sources")
    a = exponent(sources, target_entropy, max_repeats, budget)
    t = F.col("n_tokens").cast("double")
    if budget is None:
        largest = sources.agg(F.max("n_tokens")).first()[0] or 1
        granted = t * F.pow(F.lit(float(largest)) / t, F.lit(1.0 - a))
    else:
        z = sources.agg(F.sum(F.pow(t, F.lit(a)))).first()[0] or 1.0
        granted = F.pow(t, F.lit(a)) / F.lit(z) * F.lit(float(budget))
    plan = saved(sources.select(
        "_key", F.col("n_tokens").alias("_all"), F.floor(granted).cast("long").alias("_budget"),
        F.ceil(F.col("n_tokens") / F.lit(block_tokens)).cast("long").alias("_blocks")), "plan")
    whole = F.expr("_budget div _all")
    plan = plan.withColumn("_whole", whole).withColumn("_rest", F.expr("_budget % _all"))
    n_blocks = F.lit(max(1, math.ceil((plan.agg(F.sum("_budget")).first()[0] or 0) / block_tokens)))

    some = base.filter("n_tokens > 0")
    # the plan has a row per source; Spark broadcasts it only below its size threshold
    epochs = (some.join(plan, "_key")
              .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("_whole").cast("int"))))
              .filter("epoch < _whole or _rest > 0")
              .withColumn("_h", _order(seed, F.col("epoch"))).withColumn("_b", F.pmod("_h", F.col("_blocks"))))
    in_order = [F.col("_h"), F.col("doc_id"), F.col("n_tokens")]
    block_sizes = epochs.groupBy("_key", "epoch", "_b").agg(F.sum("n_tokens").alias("_n"))
    earlier = Window.partitionBy("_key", "epoch").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = block_sizes.select("_key", "epoch", "_b", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_key", "epoch", "_b").orderBy(*in_order).rowsBetween(Window.unboundedPreceding, 0)
    placed = (epochs.join(starts, ["_key", "epoch", "_b"])
              .withColumn("_end", F.col("_start") + F.sum("n_tokens").over(within))
              .filter("epoch < _whole or _end <= _rest")
              .withColumn("_at", F.col("epoch") * F.col("_all") + F.col("_end") - F.col("n_tokens"))
              .withColumn("_place", F.col("_at") / F.col("_budget"))
              .select("doc_id", "source", "n_tokens", "epoch", "_place", "_h",
                      F.floor(F.col("_at") / F.col("_budget") * n_blocks).cast("long").alias("mix_block")))
    none = base.filter("n_tokens = 0").select(
        "doc_id", "source", "n_tokens", F.lit(0).alias("epoch"), F.lit(-1.0).alias("_place"),
        _order(seed, F.lit(0)).alias("_h"), F.lit(0).cast("long").alias("mix_block"))
    slot = Window.partitionBy("mix_block").orderBy("_place", "_h", "doc_id", "n_tokens")
    return placed.unionByName(none).select(
        "doc_id", "source", "n_tokens", "epoch", "mix_block",
        (F.row_number().over(slot) - 1).cast("long").alias("mix_slot"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents of the mix with all their columns, each as often as the
    mix has it (a document that the mix leaves out is not returned)."""
    mix = mixture(docs, id_col=id_col, **options)
    times = saved(mix.groupBy(F.col("doc_id").alias("_mid")).agg((F.max("epoch") + 1).alias("_times")), "times")
    joined = docs.join(times, docs[id_col].eqNullSafe(times["_mid"]))
    copy = fresh(docs, "copy")
    return joined.select(*[docs[c] for c in docs.columns],
                         F.explode(F.sequence(F.lit(1), times["_times"])).alias(copy)).drop(copy)
