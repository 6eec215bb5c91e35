"""Best-fit packing by bin completion over the histogram of piece lengths.

Documents become token ids plus an end id; longer ones than a sequence are cut
into full pieces and a rest.  What is to be packed then is known from the
*histogram* of lengths (at most ``limit`` rows, whatever the corpus), so the
search for fillings needs nothing else: the largest length still to be placed
is completed by branch and bound over undominated fillings of the remaining
space, best-fit solutions are the incumbents, waste bounds prune, and a
filling is used as often as the counts allow.  The resulting plan (a row
per filling and length) is joined back to the pieces by length and rank.
"""

from __future__ import annotations

import bisect
import json
import os
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

LIMIT, END_ID = 4096, 1
#: Steps of the search for one filling, and of the search over all sequences where a bound says that
#: fewer may do; the incumbent stands when they are used up.
FILLING_STEPS, SEARCH_STEPS = 400, 50_000


def _own_merges_lead_to(merges: list[tuple[bytes, bytes]], first: dict[bytes, int]) -> bool:
    """Whether the merges, in their order (after those of ``first``), turn the bytes of each
    merged token into that token and by its own merge.  Then it makes no difference whether a
    pair is merged because it is listed or because its concatenation is a token: what stands
    where a token is about to be made went through the same merges as the token alone."""
    place = {pair: i for i, pair in enumerate(merges)}
    none = len(merges)
    for i, (x, y) in enumerate(merges):
        t = x + y
        parts = [t[k:k + 1] for k in range(len(t))]
        if t[-2:] in first:
            parts[-2:] = [t[-2:]]
        while len(parts) > 2:
            at = min(range(len(parts) - 1), key=lambda k: place.get((parts[k], parts[k + 1]), none))
            if place.get((parts[at], parts[at + 1]), none) >= i:
                return False
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        if parts != [x, y]:
            return False
    return True


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes.

    The tokenizer splits at white space and then by :data:`PARTS` before it
    merges, so ids are kept per lower-cased white-space word; new parts are
    encoded many at a time, and the end-of-word mark of their last token tells
    them apart.  Where the file says the same as a table of ranks (checked when
    it is loaded), the faster of the two public libraries merges the parts, each
    with the byte 0 for the end-of-word mark.  Texts with a character outside the
    plain range below (byte 0 is not in it), or with the text of a special token,
    go to the tokenizer whole."""

    #: Fixed value: the split pattern of the tokenizer file.
    PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    END_OF_WORD, END = "</w>", "\x00"

    def __init__(self, path: str, most_words: int = 500_000):
        import re

        import regex

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(self.END_OF_WORD)]] = True
        self.odd = re.compile("[^\t-\r\x20-\x7e\u00a1-\u012f\u0131-\u024f]").search
        self.split = regex.compile(self.PARTS).findall
        self.words: dict[str, bytes] = {}
        self.most = most_words
        with open(path, encoding="utf-8") as f:
            self.ranks = self._ranks(json.load(f)["model"])

    def _ranks(self, model: dict):
        """The merges as a table of ranks of byte strings, or None if that may differ."""
        if (model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges") or model.get("byte_fallback")
                or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") != self.END_OF_WORD):
            return None
        # printable bytes stand for themselves, the others for the characters from U+0100 on, in order
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        byte = {chr(b): b for b in shown}
        byte |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}

        def of(token: str) -> bytes:
            end = token.endswith(self.END_OF_WORD)
            return bytes(byte[c] for c in (token[:-len(self.END_OF_WORD)] if end else token)) + b"\0" * end

        ranks = {of(t): i for t, i in model["vocab"].items()}
        merges = [tuple(map(of, m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
        first = {bytes([b, 0]): ranks.get(bytes([b, 0]), -1) for b in range(256)}
        single = [ranks.get(bytes([b]), -1) for b in range(256)]
        if (sorted(single) != list(range(256)) or sorted(first.values()) != list(range(256, 512))
                or [ranks.get(x + y) for x, y in merges] != list(range(512, 512 + len(merges)))
                or len(ranks) != 512 + len(merges) or not _own_merges_lead_to(merges, first)):
            return None
        import tiktoken

        return tiktoken.Encoding("ranks", pat_str=r"[^\x00]+\x00", special_tokens={}, mergeable_ranks=ranks)

    def _parts_of(self, word: str) -> list[str]:
        if word[-1] in ",.;:!?" and word[:-1].isalpha():
            return [word[:-1], word[-1]]
        return self.split(word)

    def _encode_parts(self, parts: list[str]) -> None:
        if self.ranks is not None:
            ids = self.ranks.encode_to_numpy(self.END.join(parts) + self.END, disallowed_special=()).astype("<u4")
        else:
            some = [" ".join(parts[i:i + 100]) for i in range(0, len(parts), 100)]
            ids = np.concatenate([np.array(e.ids, "<u4") for e in
                                  self.tokenizer.encode_batch_fast(some, add_special_tokens=False)])
        cuts = 4 * (np.flatnonzero(self.ends[ids]) + 1)
        if len(cuts) != len(parts):
            raise ValueError("the tokenizer does not end each part with an end-of-word token")
        data, at = ids.tobytes(), 0
        for p, to in zip(parts, cuts.tolist()):
            self.words[p] = data[at:to]
            at = to

    def _learn(self, new: set[str]) -> None:
        """The ids of new words: a word of letters is a part itself, others are joined from their parts."""
        parts = {w for w in new if w.isalpha()}
        others = [(w, self._parts_of(w)) for w in new if w not in parts]
        known = self.words
        parts.update([p for _, ps in others for p in ps if p not in known])
        if parts:
            self._encode_parts(list(parts))
        for w, ps in others:
            known[w] = b"".join([known[p] for p in ps])

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.words) > self.most:
            self.words.clear()
        get, out, waiting, new = self.words.get, [], [], set()
        for i, t in enumerate(texts):
            if self.odd(t) or "<|" in t:
                out.append(np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes())
                continue
            words = t.lower().split()
            ids = list(map(get, words))
            if None in ids:
                at = [k for k, x in enumerate(ids) if x is None]
                unknown = [words[k] for k in at]
                new.update(unknown)
                waiting.append((i, ids, at, unknown))
                out.append(b"")
            else:
                out.append(b"".join(ids))
        if new:
            self._learn(new)
        for i, ids, at, unknown in waiting:
            for k, w in zip(at, unknown):
                ids[k] = get(w)
            out[i] = b"".join(ids)
        return out


def _encoder(path: str) -> Encoder:
    """One encoder for each Python worker process: the words that one task has
    met serve the next.  (Functions are shipped by value, so a global of this
    module would last one task only.)"""
    import tokenizers

    kept = tokenizers.__dict__.setdefault("_encoders_by_path", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def pieces(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT, end_id: int = END_ID,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, and the task
    and the rank among that task's pieces of this length."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, ranks, part = _encoder(tokenizer_path), [0] * (limit + 1), TaskContext.get().partitionId()
        for frame in frames:
            out = []
            ids, texts = frame["doc_id"].tolist(), frame["text"].tolist()
            for at in range(0, len(ids), 256):
                for doc, data in zip(ids[at:at + 256], encoder.encode(texts[at:at + 256])):
                    data += end
                    n = len(data) // 4
                    for k in range(0, n, limit):
                        m = min(limit, n - k)
                        out.append((doc, k // limit, k, m, zlib.crc32(data[4 * k:4 * (k + m)]), ranks[m]))
                        ranks[m] += 1
            made = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32", "rank"])
            made["doc_id"] = made["doc_id"].astype("Int64")
            made["part"] = part
            yield made

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    return src.mapInPandas(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, rank long, part int")


def least_bins(counts: dict[int, int], limit: int) -> int:
    """A lower bound on the sequences that pieces need (``counts`` by length): for a length ``a``
    of at most half a sequence, pieces longer than ``limit - a`` go alone, those over half a
    sequence go one to a sequence, and what they leave is filled by pieces of ``a`` or more."""
    x = np.array(sorted(counts), np.int64)
    n = np.array([counts[k] for k in x.tolist()], np.int64)
    rows, tokens = np.r_[0, np.cumsum(n)], np.r_[0, np.cumsum(n * x)]
    half = np.searchsorted(x, limit // 2, side="right")
    a = np.r_[0, x[:half]]
    alone, small = np.searchsorted(x, limit - a, side="right"), np.searchsorted(x, a)
    middle = rows[alone] - rows[half]
    left = middle * limit - (tokens[alone] - tokens[half])
    more = np.maximum(0, -(-(tokens[half] - tokens[small] - left) // limit))
    return int((rows[-1] - rows[half] + more).max())


def fillings(space: int, lengths: list[int], counts: dict[int, int], budget: list[int],
             most_waste: Callable[[], int]) -> Iterator[tuple[int, ...]]:
    """Undominated fillings of ``space`` that waste no more than ``most_waste()`` then
    allows, each once, as descending lengths; ``lengths`` ascending, each usable
    ``counts[length]`` times.  Ends early when ``budget[0]`` steps are used up."""
    total = [0, *accumulate(x * counts[x] for x in lengths)]
    used: dict[int, int] = {}

    def spare(low: int, high: int) -> bool:
        """Whether a length from ``low`` to ``high`` is left over."""
        i = bisect.bisect_left(lengths, low)
        while i < len(lengths) and lengths[i] <= high:
            if counts[lengths[i]] > used.get(lengths[i], 0):
                return True
            i += 1
        return False

    def dominated(rest: int) -> bool:
        """Whether a piece left over fits besides, or in place of a shorter one or of two."""
        if spare(1, rest):
            return True
        xs = list(used)
        if any(spare(x + 1, x + rest) for x in xs):
            return True
        return any(spare(x + y, x + y + rest) for i, x in enumerate(xs) for y in xs[i:]
                   if x != y or used[x] > 1)

    def branch(rest: int, at: int, chosen: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
        for i in range(bisect.bisect_right(lengths, rest, 0, at) - 1, -1, -1):
            # waste bound: this length and all shorter ones together
            if rest - total[i + 1] > most_waste() or budget[0] <= 0:
                break
            x = lengths[i]
            for k in range(min(counts[x], rest // x), 0, -1):
                budget[0] -= 1
                used[x] = k
                yield from branch(rest - k * x, i, chosen + (x,) * k)
                del used[x]
        if rest <= most_waste() and not dominated(rest):
            yield chosen

    return branch(space, len(lengths), ())


def complete(space: int, lengths: list[int], counts: dict[int, int], steps: int = FILLING_STEPS) -> tuple[int, ...]:
    """The undominated filling of ``space`` with the least waste that ``steps`` of branch and
    bound find.  Best fit (always the largest length that fits) is the incumbent."""
    best: list[int] = []
    left, at = space, len(lengths)
    while left and (at := bisect.bisect_right(lengths, left, 0, at)):
        x = lengths[at - 1]
        k = min(counts[x], left // x)
        best += [x] * k
        left -= k * x
        at -= 1
    if left and counts.get(space):
        return (space,)
    if left:  # two lengths that fill the space exactly
        for x in reversed(lengths[:bisect.bisect_left(lengths, space)]):
            y = space - x
            if y > x:
                break
            if counts.get(y, 0) > (x == y):
                return x, y
    found = tuple(best)
    if left:
        for found in fillings(space, lengths, counts, [steps], lambda: left - 1):
            left = space - sum(found)
    return found


def _with(filling: Iterable[int]) -> dict[int, int]:
    need: dict[int, int] = {}
    for x in filling:
        need[x] = need.get(x, 0) + 1
    return need


def _times(filling: Iterable[int], counts: dict[int, int]) -> int:
    return min(counts[x] // k for x, k in _with(filling).items())


def _by_completion(histogram: dict[int, int], limit: int,
                   filled: Callable[..., tuple[int, ...]]) -> list[tuple[tuple[int, ...], int]]:
    """Fillings and how often each is used: around the largest length left, as often as counts allow."""
    counts = dict(histogram)
    lengths, out = sorted(counts), []
    while lengths:
        top = lengths[-1]
        counts[top] -= 1
        left = lengths if counts[top] else lengths[:-1]
        filling = (top, *filled(limit - top, left, counts))
        counts[top] += 1
        times = _times(filling, counts)
        for x, k in _with(filling).items():
            counts[x] -= k * times
            if not counts[x]:
                del counts[x], lengths[bisect.bisect_left(lengths, x)]
        out.append((filling, times))
    return out


def fill_bins(histogram: dict[int, int], limit: int = LIMIT,
              steps: int = SEARCH_STEPS) -> list[tuple[tuple[int, ...], int]]:
    """Fillings and how often each is used, in as few sequences as the search finds.

    Incumbents are best fit decreasing and the completions of :func:`complete`, one after
    another.  Where they need more than :func:`least_bins`, branch and bound goes over all
    sequences: the largest piece left is completed by each undominated filling, so many times;
    a branch ends when its waste is more than one sequence less than the incumbent's has
    room for.  Fillings tried before need not come again around the same length.  The result is
    the optimum unless ``steps`` are used up; it never needs more than the incumbents."""
    counts = {x: n for x, n in histogram.items() if n > 0}
    if not counts:
        return []
    size = sum(x * n for x, n in counts.items())

    def bins(fills: list[tuple[tuple[int, ...], int]]) -> int:
        return sum(n for _, n in fills)

    best = min((_by_completion(counts, limit, f) for f in
                (complete, lambda *a: complete(*a, steps=0))), key=bins)
    least, budget, done = least_bins(counts, limit), [steps], []
    wasted = [0]

    def room() -> int:
        """Waste that a better result may have from here on."""
        return (bins(best) - 1) * limit - size - wasted[0]

    def children(before: int | None, tried: frozenset) -> Iterator[tuple[tuple[int, ...], int, frozenset]]:
        lengths = sorted(x for x, n in counts.items() if n)
        top = lengths[-1]
        tried = tried if top == before else frozenset()
        counts[top] -= 1
        # the search sees the counts without the top piece at every step, the caller never
        for filling in fillings(limit - top, lengths if counts[top] else lengths[:-1], counts, budget, room):
            counts[top] += 1
            if filling not in tried:
                tried |= {filling}
                for times in range(_times((top, *filling), counts), 0, -1):
                    yield (top, *filling), times, tried
            counts[top] -= 1
        counts[top] += 1

    def place(filling: tuple[int, ...], times: int) -> None:
        for x, k in _with(filling).items():
            counts[x] -= k * times
        wasted[0] += (limit - sum(filling)) * times

    stack = [children(None, frozenset())] if bins(best) > least else []
    while stack and bins(best) > least and budget[0] > 0:
        step = next(stack[-1], None)
        if step is None:
            stack.pop()
            if done:
                filling, times = done.pop()
                place(filling, -times)
            continue
        filling, times, tried = step
        budget[0] -= 1
        place(filling, times)
        done.append((filling, times))
        left = {x: n for x, n in counts.items() if n}
        if not left:
            if bins(done) < bins(best):
                best = list(done)
        elif room() >= 0 and bins(done) + least_bins(left, limit) < bins(best):
            stack.append(children(filling[0], tried))
            continue
        done.pop()
        place(filling, -times)
    return best


def plan_bins(histogram: dict[int, int], limit: int = LIMIT,
              steps: int = SEARCH_STEPS) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, rank_from, per_bin, bins, first_bin, offset): the pieces of
    ``length`` from rank ``rank_from`` on fill ``bins`` sequences from
    ``first_bin`` on, ``per_bin`` in each, side by side from ``offset`` on."""
    rank: dict[int, int] = {}
    rows, first = [], 0
    for filling, bins in fill_bins(histogram, limit, steps):
        offset = 0
        for x, k in _with(filling).items():
            rows.append((x, rank.get(x, 0), k, bins, first, offset))
            offset += k * x
            rank[x] = rank.get(x, 0) + k * bins
        first += bins
    return rows


def pack(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT, end_id: int = END_ID,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece with its place: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset.

    A null text is an empty one: its document is the end id alone.  Each row is
    a document of its own, also when rows or ids repeat; a null id stays null.
    An empty table gives an empty result; other columns are ignored."""
    spark = docs.sparkSession
    cut = saved(pieces(docs, tokenizer_path, limit, end_id, id_col, text_col), "pieces")
    per_task = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    # at most `limit` rows, whatever the corpus holds
    histogram = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = plan_bins(histogram, limit)
    schema = "length long, rank_from long, per_bin long, bins long, first_bin long, at long"
    # bounded by the histogram too: a filling uses up at least one length, or all but its last few
    plan = spark.createDataFrame(rows, schema)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_task.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ranks_before"))
    ranked = cut.join(starts, ["part", "length"]).withColumn("r", F.col("rank") + F.col("ranks_before"))
    place = (F.col("r") >= plan["rank_from"]) & (F.col("r") < plan["rank_from"] + plan["per_bin"] * plan["bins"])
    x = F.col("r") - F.col("rank_from")
    return (ranked.join(F.broadcast(plan), (ranked["length"] == plan["length"]) & place)
            .select("doc_id", "piece", "start", ranked["length"], "ids_crc32",
                    (F.col("first_bin") + F.floor(x / F.col("per_bin"))).cast("long").alias("sequence_id"),
                    (F.col("at") + F.pmod(x, F.col("per_bin")) * ranked["length"]).alias("offset")))
