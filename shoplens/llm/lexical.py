"""Ranked lexical search by presence masks.

The items come in blocks of bounded vocabulary; for a block, one pass over the
documents keeps for each document its length and its counts of the block's
terms, from which the document frequencies follow, and a second pass scores.
There, tasks take some thousand documents at a time.  Every term has a bitmap
over them; the bitmaps of an item's terms, read across, give each document's
*presence mask*, and documents with the same mask form one group.  A mask
cannot score more than the largest contributions of its terms, so masks are
evaluated by descending maximum until no mask that is left can reach the k-th
best document found.  That document carries over to the task's next blocks.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

#: Terms in the UTF-8 bytes of a text: runs of ASCII letters and digits and of all that is not ASCII.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Items of one pass, and their distinct terms; an item with more terms is a pass of its own.
MOST_ITEMS, MOST_TERMS = 4096, 20_000
#: Documents that are grouped by mask at once, and documents to evaluate before the next look at the bound.
GROUPED, EVALUATED = 4096, 64
#: Terms of one text that are in memory at once.
CHUNK = 1 << 18
LAST = np.iinfo(np.int64).max


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, lower-cased from A to Z only, in lists of bounded length."""
    if len(text) < 4 * CHUNK:
        yield TERM.findall(text.lower())
        return
    found = (m.group().lower() for m in TERM.finditer(text))
    while some := list(islice(found, CHUNK)):
        yield some


def item_blocks(items: DataFrame, id_col: str, text_col: str, most_terms: int) -> Iterator[list[tuple]]:
    """Lists of (number, id, distinct terms), one list in memory at a time; items without terms are left out."""
    block: list[tuple] = []
    seen: set[bytes] = set()
    rows = items.select(F.col(id_col).alias("item"), F.col(text_col).cast("binary").alias("text")).toLocalIterator()
    for number, row in enumerate(rows):
        own = {t for some in terms_of(bytes(row["text"] or b"")) for t in some}
        if not own:
            continue
        if block and (len(block) == MOST_ITEMS or len(seen | own) > most_terms):
            yield block
            block, seen = [], set()
        block.append((number, row["item"], sorted(own)))
        seen |= own
    if block:
        yield block


def term_counts(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """Documents with at least one term: doc_id, n (their terms), and the
    numbers and counts of the terms that ``vocabulary`` holds."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.get
        for batch in batches:
            ids, lengths, terms, times, ends = [], [], [], [], [0]
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                n, known = 0, {}
                for some in terms_of(text or b""):
                    n += len(some)
                    for t in map(number, some):
                        if t is not None:
                            known[t] = known.get(t, 0) + 1
                if n:
                    ids.append(doc)
                    lengths.append(n)
                    terms.extend(known)
                    times.extend(known.values())
                    ends.append(len(terms))
            at = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()),
                 pa.ListArray.from_arrays(at, pa.array(terms, pa.int32())),
                 pa.ListArray.from_arrays(at, pa.array(times, pa.int64()))], ["doc_id", "n", "terms", "times"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return src.mapInArrow(count, "doc_id long, n long, terms array<int>, times array<long>")


class Block:
    """Some documents with the contributions of all their terms, by term."""

    def __init__(self, docs: np.ndarray, n: np.ndarray, ends: np.ndarray, terms: np.ndarray, times: np.ndarray,
                 weights: np.ndarray, documents: int, all_terms: int):
        if 90 * int(n.max()) * documents > LAST:
            raise OverflowError("90 * n * N does not fit 64 bits")
        self.docs, self.size = docs, len(docs)
        m = 10 + (90 * n * documents) // all_terms
        of = np.repeat(np.arange(self.size), np.diff(ends))
        given = weights[terms] * ((1_000_000_000 * times) // (1000 * times + 8 * m[of]))
        order = np.argsort(terms, kind="stable")
        self.of, self.given = of[order], given[order]
        self.terms, starts = np.unique(terms[order], return_index=True)
        self.bounds = np.append(starts, len(order))
        self.most = np.maximum.reduceat(self.given, starts) if len(starts) else np.zeros(0, np.int64)
        self.bits = np.zeros((len(self.terms), -(-self.size // 8)), np.uint8)
        row = np.repeat(np.arange(len(self.terms)), np.diff(self.bounds))
        np.bitwise_or.at(self.bits, (row, self.of >> 3), (128 >> (self.of & 7)).astype(np.uint8))

    def local(self, terms: np.ndarray) -> np.ndarray:
        """Rows of this block's terms for those of an item that occur in it."""
        at = np.searchsorted(self.terms, terms)
        at[at == len(self.terms)] = 0
        return at[self.terms[at] == terms] if len(self.terms) else at[:0]

    def masks(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Group of each document by its presence mask over the terms ``rows``;
        a group's mask as booleans, and the groups' maximum scores."""
        across = np.packbits(np.unpackbits(self.bits[rows], axis=1, count=self.size).T, axis=1)
        words = np.zeros((self.size, -(-len(rows) // 64) * 8), np.uint8)
        words[:, :across.shape[1]] = across
        group = np.zeros(self.size, np.int64)
        for word in words.view(np.uint64).T:
            values, own = np.unique(word, return_inverse=True)
            first, group = np.unique(group * len(values) + own, return_index=True, return_inverse=True)[1:]
        held = np.unpackbits(across[first], axis=1, count=len(rows)).astype(bool)
        return group, held, held @ self.most[rows]

    def score(self, rows: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        """Scores of the documents ``chosen`` over the terms ``rows``."""
        place = np.full(self.size, -1)
        place[chosen] = np.arange(len(chosen))
        spans = [slice(self.bounds[r], self.bounds[r + 1]) for r in rows]
        at = place[np.concatenate([self.of[s] for s in spans])]
        given = np.concatenate([self.given[s] for s in spans])
        total = np.zeros(len(chosen), np.int64)
        np.add.at(total, at[at >= 0], given[at >= 0])
        return total


class Best:
    """The k best documents of an item so far; equal scores by ascending id, null last."""

    def __init__(self, k: int):
        self.k, self.scores, self.docs = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def least(self) -> int:
        """No document with a smaller score can enter."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, docs: np.ndarray) -> None:
        scores, docs = np.append(self.scores, scores), np.append(self.docs, docs)
        order = np.lexsort((docs, -scores))[:self.k]
        order = order[scores[order] > 0]
        self.scores, self.docs = scores[order], docs[order]


def search_block(block: Block, terms: np.ndarray, best: Best) -> None:
    """Groups by descending maximum score, as long as one can still reach the best."""
    rows = block.local(terms)
    if not len(rows) or block.most[rows].sum() < best.least():
        return
    group, _, most = block.masks(rows)
    open_groups = np.flatnonzero(most >= best.least())
    by_most = open_groups[np.argsort(-most[open_groups], kind="stable")]
    by_group = np.argsort(group, kind="stable")
    ends = np.cumsum(np.bincount(group, minlength=len(most)))
    starts = np.append(0, ends[:-1])
    i = 0
    while i < len(by_most) and most[by_most[i]] >= best.least():
        chosen: list[np.ndarray] = []
        size = 0
        while i < len(by_most) and size < EVALUATED and most[by_most[i]] >= best.least():
            g = by_most[i]
            chosen.append(by_group[starts[g]:ends[g]])
            size += len(chosen[-1])
            i += 1
        some = np.concatenate(chosen)
        best.add(block.score(rows, some), block.docs[some])


def _searcher(items: list[tuple[int, np.ndarray]], weights: np.ndarray, documents: int, all_terms: int, k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {number: Best(k) for number, _ in items}
        for batch in batches:
            for at in range(0, batch.num_rows, GROUPED):
                part = batch.slice(at, GROUPED)
                ends = part["terms"].offsets.to_numpy()
                docs = part["doc_id"].fill_null(LAST).to_numpy(zero_copy_only=False)
                block = Block(docs, part["n"].to_numpy(), ends - ends[0], part["terms"].flatten().to_numpy(),
                              part["times"].flatten().to_numpy(), weights, documents, all_terms)
                for number, terms in items:
                    search_block(block, terms, best[number])
        numbers = [n for n, b in best.items() for _ in b.scores]
        docs = np.concatenate([np.zeros(0, np.int64), *[b.docs for b in best.values()]])
        scores = np.concatenate([np.zeros(0, np.int64), *[b.scores for b in best.values()]])
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(docs, mask=docs == LAST),
                                          pa.array(scores)], ["number", "doc_id", "score"])

    return search


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", item_col: str = "item_id",
           text_col: str = "text", most_terms: int = MOST_TERMS) -> DataFrame:
    """The ``k`` best documents of each item: item_id, rank, doc_id, score.

    The items come to the driver in blocks of at most :data:`MOST_ITEMS` with
    ``most_terms`` distinct terms, and each block is one search of all documents.  A null or empty text
    has no terms: such documents do not count, such items have no rows.  Every
    row is an item or a document of its own, also when ids repeat; equal scores
    rank by ascending document id, null last.  An empty table gives an empty
    result.  Other columns are ignored."""
    spark = docs.sparkSession
    item_type = items.schema[item_col].dataType.simpleString()
    rank = F.row_number().over(Window.partitionBy("number")
                               .orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    found = spark.createDataFrame([], f"number long, doc_id long, score long, rank int, item_id {item_type}")
    for block in item_blocks(items, item_col, text_col, most_terms):
        vocabulary: dict[bytes, int] = {}
        asked = [(number, np.array(sorted(vocabulary.setdefault(t, len(vocabulary)) for t in terms)))
                 for number, _, terms in block]
        counts = saved(term_counts(docs, vocabulary, id_col, text_col), "lexical-counts")
        size = counts.agg(F.count("*").alias("documents"), F.sum("n").alias("terms")).first()
        n = size["documents"]
        # a row per term of the block at most; terms that no document holds weigh nothing here
        weights = np.zeros(len(vocabulary), np.int64)
        for r in counts.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect():
            weights[r["t"]] = math.floor(1000 * math.log((2 * n + 2) / (2 * r["df"] + 1)))
        top = counts.mapInArrow(_searcher(asked, weights, n, size["terms"], k), "number long, doc_id long, score long")
        # bounded as the block of items is
        names = spark.createDataFrame([(number, item) for number, item, _ in block], f"number long, item_id {item_type}")
        found = found.unionByName(saved(top.withColumn("rank", rank).filter(F.col("rank") <= k)
                                        .join(F.broadcast(names), "number"), "lexical-best"))
    return found.select("item_id", "rank", "doc_id", "score")
