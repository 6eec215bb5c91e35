"""Near-duplicate documents by order min-hash with banded alignment.

Each of :data:`SKETCHES` sketches of a document takes its :data:`SAMPLES`
smallest occurrence-labelled shingles (five words and the number of earlier
equal ones) and keeps them *in text order*; two documents agree on a sketch
with a probability that falls with their edit distance.  Documents that agree
on a sketch are candidates, candidates whose alignment covers at least
``threshold`` of the longer one's words are linked, and the linked documents of
each component form one group.

Order of work, so that a group of a third of all rows stays cheap: documents
with equal word sequences are one class and only its representative goes on.
Members of a sketch value are dealt into blocks of about :data:`BLOCK`, anew for
each sketch.  In :data:`ROUNDS` rounds each representative is aligned with the
one in its block whose signature is most like its own.  Then every pair of
blocks of a sketch value that still holds several components is worked off
inside one task, which has the word sequences and aligns all pairs that are not
yet connected and that could reach the threshold by the words they have in
common: no pair leaves the task, only a link for each two components it joins,
and no pair is looked at in two sketches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, components, null_safe_semi, saved, with_group_totals

SHINGLE, SAMPLES, SKETCHES, SIGNATURE, BLOCK = 5, 2, 24, 128, 1000
#: Words that a block holds, about; and hashes of words that a task remembers.
BLOCK_WORDS, KNOWN_WORDS = 2_000_000, 200_000
#: In the first rounds, partners whose signatures agree on fewer places than an aligned pair's do, by so many standard
#: deviations, wait for the last one.
DEVIATIONS = 4.0
#: Rounds that align only the most similar partners.
ROUNDS = 2


def _mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_hashes(words: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of ``width`` words, in text order; of the whole text if it is shorter."""
    if not len(words):
        return np.empty(0, np.uint64)
    width = min(width, len(words))
    out = np.zeros(len(words) - width + 1, np.uint64)
    for i in range(width):
        out = out * np.uint64(0xD1342543DE82EF95) + words[i:len(words) - width + 1 + i]
    return _mix(out)


def labelled(shingles: np.ndarray) -> np.ndarray:
    """Each shingle's hash mixed with the number of equal shingles before it."""
    order = np.argsort(shingles, kind="stable")
    run = shingles[order]
    first = np.r_[True, run[1:] != run[:-1]]
    starts = np.flatnonzero(first)
    number = np.empty(len(run), np.uint64)
    number[order] = (np.arange(len(run)) - np.repeat(starts, np.diff(np.r_[starts, len(run)]))).astype(np.uint64)
    return _mix(shingles + number * np.uint64(0x9E3779B97F4A7C15))


def signature(words: np.ndarray) -> bytes:
    """One byte for each of :data:`SIGNATURE` classes of occurrence-labelled
    words: of the least hash in the class, 0 if the class is empty."""
    once = np.sort(labelled(words))
    classes = (once >> np.uint64(64 - 7)).astype(np.int64)
    first = np.r_[True, classes[1:] != classes[:-1]]
    out = np.zeros(SIGNATURE, np.uint8)
    out[classes[first]] = (once[first] & np.uint64(0xFF)).astype(np.uint8) | np.uint8(1)
    return out.tobytes()


def sketches(shingles: np.ndarray, seeds: np.ndarray, samples: int = SAMPLES) -> list[int]:
    """The sketch values (signed 64-bit) of a document with at least one shingle."""
    n, keys = len(shingles), labelled(shingles)
    mixed, out = keys ^ (keys >> np.uint64(29)), []
    step = max(1, 2_000_000 // n)  # sketches at a time, for bounded memory
    for at in range(0, len(seeds), step):
        # a random order of the labelled shingles per sketch: an odd multiplier
        orders = mixed[None] * seeds[at:at + step, None]
        rows, least = np.arange(len(orders)), []
        for _ in range(min(samples, n)):
            least.append(orders.argmin(1))
            orders[rows, least[-1]] = np.uint64(0xFFFFFFFFFFFFFFFF)
        chosen = keys[np.sort(np.stack(least, 1), 1)]  # in text order
        value = (at + 1 + rows).astype(np.uint64)
        for h in chosen.T:
            value = (value ^ h) * np.uint64(0xD1342543DE82EF95)
            value ^= value >> np.uint64(32)
        out += value.view(np.int64).tolist()
    return out


def _hashes(words: list[str], known: dict[str, int], digest) -> np.ndarray:
    if len(known) > KNOWN_WORDS:
        known.clear()
    for w in set(words).difference(known):
        known[w] = digest(w)
    return np.fromiter((known[w] for w in words), np.uint64, len(words))


def _sketched(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    seeds = _mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    word = WORD

    def sketch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        import xxhash

        find, known = re.compile(word).findall, {}
        for frame in frames:
            rows = []
            for doc, text in zip(frame["doc_id"].tolist(), frame["text"].tolist()):
                words = find(text.lower())
                hashes = _hashes(words, known, xxhash.xxh3_64_intdigest)
                cls = hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest()
                keys, marks = (sketches(shingle_hashes(hashes), seeds), signature(hashes)) if words else ([], b"")
                rows.append((doc, cls, len(words), keys, marks))
            made = pd.DataFrame(rows, columns=["doc_id", "cls", "n_words", "keys", "signature"])
            made["doc_id"] = made["doc_id"].astype("Int64")
            yield made

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    return src.mapInPandas(sketch, "doc_id long, cls binary, n_words int, keys array<long>, signature binary")


def alignment(a: list, b: list, least: float) -> float:
    """Share of the longer sequence that an in-order alignment of equal words
    covers, within the band that a share of ``least`` allows (0.0 below it).

    Common starts and ends are aligned as they are; between them, the longest
    common subsequence comes from a bit-parallel table that counts only the
    cells of the band as matches; a row is one integer of a bit per word."""
    long = max(len(a), len(b))
    if not long:
        return 1.0
    band = long - int(np.ceil(least * long - 1e-9))  # cells off the diagonal, either way
    if long - min(len(a), len(b)) > band:
        return 0.0
    i, most = 0, min(len(a), len(b))
    while i < most and a[i] == b[i]:
        i += 1
    j = 0
    while j < most - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b, common = a[i:len(a) - j], b[i:len(b) - j], i + j
    if a and b:
        places: dict = {}
        for k, w in enumerate(b):
            places[w] = places.get(w, 0) | (1 << k)
        full = (1 << len(b)) - 1
        row, window = full, (1 << (2 * band + 1)) - 1
        for k, w in enumerate(a):
            hits = places.get(w)
            if hits:
                hits &= window << (k - band) if k >= band else window >> (band - k)
                taken = row & hits
                row = ((row + taken) | (row - taken)) & full
        common += len(b) - row.bit_count()
    return common / long if common >= least * long - 1e-9 else 0.0


def _texts_of(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """Each text of the documents ``ids`` (doc_id) once, however often its row
    is repeated.  The ids are written first, so that their true size decides how they meet the texts."""
    some = saved(ids.distinct(), "text-ids")
    return texts.join(some, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])


def _aligned(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    word = WORD

    def align(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        find = re.compile(word).findall
        for frame in frames:
            last, words, keep = None, [], []
            for a, x, y in zip(frame["a"].tolist(), frame["x"].tolist(), frame["y"].tolist()):
                if a != last:
                    last, words = a, find(x.lower())
                keep.append(alignment(words, find(y.lower()), threshold) > 0)
            yield frame.loc[keep, ["a", "b"]]

    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("y"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInPandas(align, "a long, b long")


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows with the block (`side`) of their sketch value, one of `c`, that they fall into; dealt anew for each value."""
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("n_words").alias("_w")).select(
        "key", F.ceil(F.greatest(F.col("n") / BLOCK, F.col("_w") / BLOCK_WORDS)).cast("int").alias("c"))
    return rows.join(sizes, "key").withColumn("side", F.pmod(F.xxhash64("key", "doc_id"), F.col("c")).cast("int"))


def _groups(frames: Iterator[pd.DataFrame], by: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Sorted rows as frames of whole groups, with the numbers of the groups; a group may span frames."""
    rest = None
    for frame in frames:
        frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        if not len(frame):
            continue
        new = np.zeros(len(frame), bool)
        for c in by:
            x = frame[c].to_numpy()
            new[1:] |= x[1:] != x[:-1]
        last = np.flatnonzero(new)[-1] if new.any() else 0  # the last group may go on
        if last:
            yield frame.iloc[:last], np.cumsum(new[:last])
        rest = frame.iloc[last:].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest, np.zeros(len(rest), np.int64)


def _best_partners(rows: DataFrame, threshold: float) -> DataFrame:
    """Pairs (smaller id first): for each row of each block, the row whose label
    differs, whose length allows a link, and whose signature is most like its own."""
    share, places = threshold / (2 - threshold), SIGNATURE

    def work(frame: pd.DataFrame, group: np.ndarray) -> pd.DataFrame:
        docs, labels, words = (frame[c].to_numpy() for c in ("doc_id", "label", "n_words"))
        marks = np.frombuffer(b"".join(frame["signature"]), np.uint8).reshape(-1, places)
        best, partner = np.full(len(docs), -1.0), np.full(len(docs), -1)
        apart = 1
        while apart < len(docs):  # all rows and the row so many places on, while groups are that large
            at = np.flatnonzero(group[apart:] == group[:-apart])
            if not len(at):
                break
            for i in range(0, len(at), 50_000):
                a = at[i:i + 50_000]
                b = a + apart
                short, long = np.minimum(words[a], words[b]), np.maximum(words[a], words[b])
                ok = (labels[a] != labels[b]) & (short >= threshold * long - 1e-9)
                a, b = a[ok], b[ok]
                x, y = marks[a], marks[b]
                agreed = ((x == y) & (x != 0)).sum(1)
                used = ((x != 0) | (y != 0)).sum(1)
                ok = agreed >= np.maximum(1, share * used - DEVIATIONS * np.sqrt(share * (1 - share) * used))
                a, b, agreement = a[ok], b[ok], agreed[ok] / used[ok]
                for x, y in ((a, b), (b, a)):  # within one step, no row stands twice on a side
                    better = agreement > best[x]
                    best[x[better]], partner[x[better]] = agreement[better], y[better]
            apart += 1
        x = np.flatnonzero(partner >= 0)
        x, y = docs[x], docs[partner[x]]
        return pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)}).drop_duplicates()

    def partners(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, group in _groups(frames, ["key", "side"]):
            yield work(frame, group)

    dealt = _dealt(rows).select("key", "side", "doc_id", "label", "n_words", "signature")
    return (dealt.repartition("key", "side").sortWithinPartitions("key", "side", "doc_id")
            .mapInPandas(partners, "a long, b long").distinct())


class Block:
    """Word sequences of some documents; finds links between different labels."""

    def __init__(self, sequences: list[np.ndarray]):
        order = np.argsort([len(x) for x in sequences], kind="stable")
        self.order, self.sequences = order, [sequences[i] for i in order]
        self.words = np.array([len(x) for x in self.sequences])
        # a bit per occurrence-labelled word, eight times as many bits as words
        bits = 1 << min(15, max(9, int(8 * self.words.max() - 1).bit_length()))
        self.marks = np.zeros((len(order), bits // 64), np.uint64)
        for i, x in enumerate(self.sequences):
            at = labelled(x) >> np.uint64(64 - bits.bit_length() + 1)
            np.bitwise_or.at(self.marks[i], (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        #: words that share their bit with another word of the same document
        self.hidden = self.words - np.bitwise_count(self.marks).sum(1, dtype=np.int64)

    def could_link(self, i: int, threshold: float) -> np.ndarray:
        """Later (longer or equal) documents that may have enough words in common
        with the ``i``-th.  Words in common set a bit in both, but for at most the
        hidden ones of either side, so no link is missed."""
        end = np.searchsorted(self.words, self.words[i] / threshold + 1e-6, "right")
        some = slice(i + 1, end)
        both = np.bitwise_count(self.marks[some] & self.marks[i]).sum(1, dtype=np.int64)
        common = both + np.minimum(self.hidden[some], self.hidden[i])
        return i + 1 + np.flatnonzero(common >= threshold * self.words[some] - 1e-9)


def links_within(sequences: list[np.ndarray], labels: list[int], may_meet, threshold: float) -> list[tuple[int, int]]:
    """Links (places) that join documents of different labels, as few as connect
    what is connected: a pair whose labels are joined already is not aligned.
    ``may_meet(place, places)`` says which pairs are to be looked at here."""
    block = Block(sequences)
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    out = []
    for i, words in enumerate(block.sequences):
        near = block.could_link(i, threshold)
        near = near[may_meet(block.order[i], block.order[near])]
        own = None  # numbers as Python objects take four times their room: of two sequences at a time
        for j in near.tolist():
            x, y = find(labels[block.order[i]]), find(labels[block.order[j]])
            if x == y:
                continue
            own = words.tolist() if own is None else own
            if alignment(own, block.sequences[j].tolist(), threshold):
                root[max(x, y)] = min(x, y)
                out.append((int(block.order[i]), int(block.order[j])))
    return out


def _block_links(rows: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links between the labels of every sketch value of ``rows`` (key, sketch,
    keys, doc_id, label, n_words): in pairs of blocks, each within a task."""
    word = WORD

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        import xxhash

        find, known = re.compile(word).findall, {}
        for frame in frames:
            words = [_hashes(find(t.lower()), known, xxhash.xxh3_64_intdigest).tobytes() for t in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "words": words})

    def work(frame: pd.DataFrame) -> list[tuple[int, int]]:
        keys = np.array(frame["keys"].tolist(), np.int64)
        sketch, side = frame["sketch"].iat[0], frame["side"].to_numpy()
        own = frame["bi"].iat[0] == frame["bj"].iat[0]

        def may_meet(i: int, others: np.ndarray) -> np.ndarray:
            # a pair belongs to the first sketch it agrees on, and within that to the blocks of its two sides
            return ((keys[others] == keys[i]).argmax(1) == sketch) & (own | (side[others] != side[i]))

        sequences = [np.frombuffer(w, np.uint64) for w in frame["words"]]
        docs = frame["doc_id"].to_numpy()
        found = links_within(sequences, frame["label"].tolist(), may_meet, threshold)
        return [(min(docs[i], docs[j]), max(docs[i], docs[j])) for i, j in found]

    def blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, group in _groups(frames, ["key", "bi", "bj"]):
            found = [link for _, one in frame.groupby(group, sort=False) if one["label"].nunique() > 1 for link in work(one)]
            yield pd.DataFrame(found, columns=["a", "b"], dtype=np.int64).drop_duplicates()

    words = saved(_texts_of(texts, rows.select("doc_id")).mapInPandas(
        hashed, "doc_id long, words binary"), "words")
    dealt = (_dealt(rows).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
             .select("key", F.least("side", "other").alias("bi"), F.greatest("side", "other").alias("bj"), "side",
                     "sketch", "keys", "doc_id", "label").join(words, "doc_id"))
    return (dealt.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj", "doc_id")
            .mapInPandas(blocks, "a long, b long").distinct())


def near_duplicates(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id (smallest id with the same words
    in the same order, letter case aside), group_id (smallest id that links
    reach), kept (doc_id = group_id).

    Documents are linked when an alignment covers ``threshold`` or more of the
    longer one's words.  Null and empty texts, and texts of white space only,
    are one class without links.  Rows with a null id keep to themselves: null
    class and group, kept.  Rows repeated with one id and text share a class;
    one id on different texts joins their groups.  Other columns are ignored.
    Candidates are found with a probability that depends on the pair: about
    0.996 where 45 % of all five-word shingles are shared, over 0.9999 from 60 %."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    known = src.filter("doc_id is not null")
    marked = saved(_sketched(known, "doc_id", "text"), "sketches")
    classes = saved(with_group_totals(marked.select("doc_id", "cls"), ["cls"], ["doc_id"],
                                      [F.min("doc_id").alias("_m")], [F.min("_m").alias("class_id")])
                    .select("doc_id", "class_id").distinct(), "classes")
    heads = classes.filter("doc_id = class_id").select("doc_id").distinct()
    rows = marked.join(heads, "doc_id", "left_semi").filter("n_words > 0").dropDuplicates(["doc_id", "cls"])
    each = rows.select(F.posexplode("keys").alias("sketch", "key"), "doc_id")
    shared = each.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    where = each.join(shared, "key", "left_semi")
    bucketed = saved(where.join(rows.select("doc_id", "n_words", "signature", "keys"), "doc_id"), "buckets")

    texts = saved(_texts_of(known, bucketed.select("doc_id")), "texts")  # of all documents that share a sketch value

    # an id on several texts joins their classes
    least = classes.groupBy("doc_id").agg(F.min("class_id").alias("a"), F.max("class_id").alias("_most"))
    joined = classes.join(least.filter("a < _most"), "doc_id").filter("class_id > a").select("a", F.col("class_id").alias("b"))

    # rounds of most similar partners, then every pair that is still in different components
    unsettled = bucketed.withColumn("label", F.col("doc_id"))
    tried = links = None
    for turn in range(ROUNDS + 1):
        if turn < ROUNDS:
            pairs = _best_partners(unsettled, threshold)
            pairs = saved(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "candidates")
            more = _aligned(pairs, texts, threshold)
            tried = pairs if tried is None else tried.unionByName(pairs)
        else:
            more = _block_links(unsettled, texts, threshold)
        links = saved((joined if links is None else links).unionByName(more).distinct(), "links")
        found = saved(components(links), "components")
        if turn < ROUNDS:
            # sketch values whose members are not yet in one component
            labelled_rows = bucketed.join(found, bucketed["doc_id"] == found["id"], "left").withColumn(
                "label", F.coalesce("component_id", "doc_id")).drop("id", "component_id")
            mixed = labelled_rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter(
                "lo <> hi").select("key")
            unsettled = saved(labelled_rows.join(mixed, "key", "left_semi"), "unsettled")
    own = least.select("doc_id", F.col("a").alias("class_id"))
    out = own.join(found.withColumnRenamed("id", "class_id"), "class_id", "left")
    group = F.coalesce("component_id", "class_id")
    lone = src.filter("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"),
                                               F.lit(None).cast("long").alias("group_id"), F.lit(True).alias("kept"))
    return out.select("doc_id", "class_id", group.alias("group_id"), (F.col("doc_id") == group).alias("kept")).unionByName(lone)


def kept_documents(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document of each group that stays, with all its columns."""
    gone = near_duplicates(docs, threshold, id_col, text_col).filter("not kept").select(F.col("doc_id").alias(id_col))
    gone = saved(gone, "gone")  # few ids, by their true size, meet the texts where these are
    return null_safe_semi(docs, gone, [id_col], "left_anti")
