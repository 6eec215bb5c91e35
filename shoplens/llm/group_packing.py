"""First-fit decreasing packing in randomised groups.

Documents become token ids plus an end id.  Pieces as long as a sequence are
sequences of their own; what is left of each document is packed in groups that
rows fall into at random, each group by itself and in bounded memory.  First
fit finds the first sequence with enough room in a tournament tree over the
room of all sequences, in logarithmic time.  The sequences that first fit
leaves emptiest are then cut up to fill the room of the others, and the one
that remains is cut at powers of two, where no padding is due.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

LIMIT, END_ID = 1024, 0
#: Rests of documents that are packed together.
GROUP_ROWS = 4096


class ByteEncoder:
    """Token ids of whole texts as a byte-level BPE tokenizer file defines them.

    Such a file says the same as a table of ranks where each token's id is its
    place in the merge order; then the faster of the two public libraries reads
    it.  Any other file, and texts that hold a special token's text, go to the
    tokenizer as it is."""

    #: Fixed value: the split pattern that byte-level files mean by ``use_regex``.
    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.fast = self._ranks(spec)
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"

    def _ranks(self, spec: dict):
        split, model = spec["pre_tokenizer"] or {}, spec["model"]
        plain = (split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
                 and spec["normalizer"] is None and model["type"] == "BPE" and not model.get("dropout")
                 and not model.get("ignore_merges") and not model.get("end_of_word_suffix"))
        if not plain:
            return None
        # printable bytes stand for themselves, the others for the characters from U+0100 on, in order
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        byte = {chr(b): b for b in shown}
        byte |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        vocabulary = {t: i for t, i in model["vocab"].items() if t not in self.special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        if [vocabulary.get(a + b) for a, b in merges] != list(range(256, 256 + len(merges))):
            return None
        if len(vocabulary) != 256 + len(merges):
            return None
        import tiktoken

        return tiktoken.Encoding("ranks", pat_str=self.PATTERN, special_tokens={},
                                 mergeable_ranks={bytes(byte[c] for c in t): i for t, i in vocabulary.items()})

    def encode(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4")


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


CUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, row long, ids binary"


def cut(docs: DataFrame, tokenizer_path: str, limit: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Full pieces, and with their ids the rests of the documents (ids not null), numbered by task and row."""

    def pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, part, row = ByteEncoder(tokenizer_path), TaskContext.get().partitionId(), 0
        for frame in frames:
            out = []
            for doc, text in zip(frame["doc_id"].tolist(), frame["text"].tolist()):
                ids = np.append(encoder.encode(text), np.array(end_id, "<u4"))
                n = len(ids)
                for at in range(0, n, limit):
                    some = ids[at:at + limit]
                    whole = len(some) == limit
                    out.append((doc, at, len(some), _crc(some), n, part, row,
                                None if whole else some.astype(encoder.dtype).tobytes()))
                    row += 1
            made = pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "row", "ids"])
            made["doc_id"] = made["doc_id"].astype("Int64")
            yield made

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    return src.mapInPandas(pieces, CUT)


class Tournament:
    """The room of sequences that are opened in order; each inner node has the
    most room below it, so the first with enough is found by going down."""

    def __init__(self, bins: int, limit: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [limit] * (2 * self.leaves)

    def take(self, size: int) -> int:
        """The first sequence with room for ``size``, which is then less."""
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < size:
                at += 1
        room[at] -= size
        found = at - self.leaves
        while at > 1:
            at >>= 1
            most = room[2 * at] if room[2 * at] > room[2 * at + 1] else room[2 * at + 1]
            if room[at] == most:
                break
            room[at] = most
        return found


def first_fit_decreasing(sizes: list[int], limit: int) -> list[list[int]]:
    """Sequences as lists of the places in ``sizes``, the largest placed first."""
    tree, bins = Tournament(len(sizes), limit), []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        b = tree.take(sizes[i])
        if b == len(bins):
            bins.append([])
        bins[b].append(i)
    return bins


def fill_up(bins: list[list[int]], sizes: list[int], limit: int) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (place in ``sizes``, from, length) without padding.

    The emptiest sequences give their pieces, cut where needed, to those that
    have room; a sequence that nothing is left to fill is cut at powers of two
    from the largest down."""
    placed = [[(i, 0, sizes[i]) for i in b] for b in bins]
    room = [limit - sum(sizes[i] for i in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda b: room[b])
    done = [placed[b] for b in order if room[b] == 0]
    takers = [b for b in order if room[b]]
    first = 0
    while first < len(takers) - 1:
        giver = placed[takers[-1]]
        while giver and first < len(takers) - 1:
            i, at, n = giver.pop()
            to = takers[first]
            part = min(n, room[to])
            placed[to].append((i, at, part))
            room[to] -= part
            room[takers[-1]] += part
            if part < n:
                giver.append((i, at + part, n - part))
            if not room[to]:
                done.append(placed[to])
                first += 1
        if not giver:
            takers.pop()
    for b in takers[first:]:
        rest = placed[b]
        left = sum(n for _, _, n in rest)
        while left:
            size = 1 << (left.bit_length() - 1)
            left -= size
            one = []
            while size:
                i, at, n = rest.pop()
                part = min(n, size)
                one.append((i, at, part))
                size -= part
                if part < n:
                    rest.append((i, at + part, n - part))
            done.append(one)
    return done


PACKED = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def _packer(limit: int, dtype: str):
    def pack_group(key, frame):
        frame = frame.sort_values(["part", "row"], ignore_index=True)
        sizes, start, ids = frame["length"].tolist(), frame["start"].tolist(), frame["ids"].tolist()
        crc = frame["ids_crc32"].tolist()
        out = []
        for b, sequence in enumerate(fill_up(first_fit_decreasing(sizes, limit), sizes, limit)):
            offset = 0
            for i, at, n in sequence:
                own = crc[i] if n == sizes[i] else _crc(np.frombuffer(ids[i], dtype)[at:at + n])
                out.append((i, start[i] + at, n, own, (int(key[0]) << 32 | b) * 2 + 1, offset))
                offset += n
        of, starts, lengths, crcs, sequences, offsets = zip(*out)
        rows = frame.iloc[list(of)]
        return pd.DataFrame({"doc_id": rows["doc_id"].astype("Int64").array, "start": starts, "length": lengths,
                             "ids_crc32": crcs, "doc_tokens": rows["doc_tokens"].to_numpy(),
                             "sequence_id": sequences, "offset": offsets})

    return pack_group


def pack(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT, end_id: int = END_ID,
         group_rows: int = GROUP_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece with its place: doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset.

    Sequences are full, or as long as a power of two.  A null text is an empty
    one: its document is the end id alone.  Each row is a document of its own,
    also when rows or ids repeat; a null id stays null.  An empty table gives
    an empty result; other columns are ignored."""
    made = saved(cut(docs, tokenizer_path, limit, end_id, id_col, text_col), "group-pieces")
    rests = made.filter(F.col("ids").isNotNull())
    groups = max(1, -(-rests.count() // group_rows))
    dtype = ByteEncoder(tokenizer_path).dtype
    packed = (rests.withColumn("group", F.pmod(F.xxhash64("part", "row"), F.lit(groups)))
              .groupBy("group").applyInPandas(_packer(limit, dtype), PACKED))
    full = made.filter(F.col("ids").isNull()).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.shiftleft(F.col("part"), 34) + F.col("row") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full)
