"""Best-two-fit packing of tokenised documents into sequences of fixed length.

A document longer than a sequence is cut into full pieces, the first of which
may be shorter.  The pieces of all documents are then counted by length: at
most as many different lengths as a sequence has tokens.  The plan is made on
these counts.  A bin is filled greedily, longest piece first; if a gap stays,
its smallest piece makes way for two unpacked pieces that fit the widened gap
more tightly.  The same filling is repeated as often as the counts allow, so
the plan grows with the number of lengths and not with the corpus.  Every piece
then finds its place from its length and its rank among pieces of that length.

The tokenizer is called as the library does by default: the text of one of its
special tokens becomes that token.  Texts with such a passage are encoded whole.

Defined cases: a null text counts as empty and packs as the end token alone;
rows with the same doc_id or text are packed as rows of their own; a null
doc_id stays null; other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunked_text import CachedEncoder
from .common import prepare, save, whole_text

END_ID = 2
#: Words given to the tokenizer in one text.
JOINED = 1_024
CAPACITY = 1024


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Fillings (how often, [(length, pieces of it)]) that use up the counts.

    Each filling is repeated until one of its lengths has too few pieces left
    for it, which at least halves that count; so there are at most
    capacity * (1 + log2(capacity)) fillings."""
    left = {int(k): int(v) for k, v in counts.items() if v > 0}
    lengths = sorted(left)
    out = []
    while lengths:
        used: dict[int, int] = {}
        gap = capacity
        upto = len(lengths)
        while gap:
            upto = bisect_right(lengths, gap, 0, upto)
            if not upto:
                break
            size = lengths[upto - 1]
            k = min(left[size], gap // size)
            used[size] = k
            gap -= k * size
            upto -= 1
        if gap and sum(used.values()) > 1:
            small = min(used)
            pair = _two(lengths, left, used, small, gap + small)
            if pair:
                used[small] -= 1
                for x in pair:
                    used[x] = used.get(x, 0) + 1
                if not used[small]:
                    del used[small]
        times = min(left[s] // k for s, k in used.items())
        out.append((times, sorted(used.items(), reverse=True)))
        for s, k in used.items():
            left[s] -= times * k
            if not left[s]:
                del left[s]
                lengths.remove(s)
    return out


def _two(lengths: list[int], left: dict[int, int], used: dict[int, int], small: int, room: int) -> tuple[int, int] | None:
    """The two unpacked pieces that fill the room best, if they fill more than the small one did."""
    free = [s for s in lengths[: bisect_right(lengths, room)] if left[s] > used.get(s, 0)]
    lo, hi, best, found = 0, len(free) - 1, small, None
    while lo <= hi:
        a, b = free[lo], free[hi]
        if a + b > room or (lo == hi and left[a] - used.get(a, 0) < 2):
            hi -= 1
            continue
        if a + b > best:
            best, found = a + b, (a, b)
            if best == room:
                break
        lo += 1
    return found


class Places:
    """Where the pieces of each length go: runs of ranks, in arrays."""

    def __init__(self, fillings: list[tuple[int, list[tuple[int, int]]]]):
        runs, at, bins = [], {}, 0
        for times, sizes in fillings:
            offset = 0
            for size, k in sizes:
                start = at.get(size, 0)
                runs.append((size << 44 | start, k, bins, offset, size))
                at[size] = start + times * k
                offset += k * size
            bins += times
        table = np.array(sorted(runs), dtype=np.int64).reshape(-1, 5)
        self.keys, self.each, self.bins, self.offsets, self.sizes = (np.ascontiguousarray(table[:, k]) for k in range(5))
        self.n_bins = bins

    def of(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence_id, offset) of pieces."""
        k = np.searchsorted(self.keys, (lengths << 44) | ranks, side="right") - 1
        i = ranks - (self.keys[k] & ((1 << 44) - 1))
        return self.bins[k] + i // self.each[k], self.offsets[k] + (i % self.each[k]) * lengths


PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("rank_in_part", pa.int64())])
PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank_in_part long"


class _Encoder:
    """Ids of texts; those with the text of a special token don't go through the cache of words."""

    def __init__(self, tokenizer, cached: CachedEncoder):
        self.tokenizer, self.cached = tokenizer, cached
        special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.special = "|".join(map(re.escape, special)) if special else None

    def raw_many(self, texts: pa.Array) -> list[bytes]:
        whole = pc.match_substring_regex(texts, self.special) if self.special else None
        if whole is None or not pc.any(whole).as_py():
            return self.cached.raw_many(texts)
        out = self.cached.raw_many(pc.if_else(whole, "", texts))
        for k in np.flatnonzero(whole.to_numpy(zero_copy_only=False)).tolist():
            ids = self.tokenizer.encode(texts[k].as_py(), add_special_tokens=False).ids
            out[k] = np.array(ids, dtype="<u4").tobytes()
        return out


def _tokenizer(path: str, pattern: str) -> _Encoder:
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    t = Tokenizer.from_file(path)

    def encode(matches: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(x.ids)}I", *x.ids) for x in t.encode_batch_fast(matches, add_special_tokens=False)]

    def encode_words(words: list[str]) -> list[bytes]:
        # words behind a space stay words of their own when joined: one call for many
        out: list[bytes] = []
        for k in range(0, len(words), JOINED):
            some = words[k : k + JOINED]
            found = t.encode(" " + " ".join(some), add_special_tokens=False)
            of = np.array(found.word_ids)
            if of[-1] + 1 != len(some):
                out += encode([" " + w for w in some])
                continue
            raw = np.array(found.ids, dtype="<u4").tobytes()
            ends = (4 * np.searchsorted(of, np.arange(len(some)), side="right")).tolist()
            out += [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        return out

    return _Encoder(t, CachedEncoder(pattern, encode, encode_words))


_encoders: dict[tuple[str, str], _Encoder] = {}
_END = np.array([END_ID], dtype="<u4").tobytes()


def _pieces(path: str, pattern: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get((path, pattern)) or _encoders.setdefault((path, pattern), _tokenizer(path, pattern))
        part, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            cols: list[list] = [[] for _ in PIECES]
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.raw_many(batch.column(1)), strict=True):
                raw = memoryview(ids + _END)
                for k, (start, length) in enumerate(cut(len(raw) // 4, capacity)):
                    for c, v in zip(cols, (doc_id, k, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), part, seen[length]), strict=True):
                        c.append(v)
                    seen[length] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, PIECES, strict=True)], schema=PIECES)

    return run


def pack_documents(docs: DataFrame, tokenizer: str, pattern: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of all documents with their places.

    The tokenizer is a file of the tokenizers library, the pattern the one by
    which its vocabulary splits text.  Texts are read and tokenised once, without a shuffle; what is shuffled are
    the pieces' lengths and keys.  The driver sees one count for each length."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    pieces = save(rows.mapInArrow(_pieces(tokenizer, pattern, capacity), PIECES_DDL), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.max("rank_in_part").alias("last")).select("part", "length", (F.col("last") + 1).alias("n"))
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = Places(plan(total, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rank_before"))
    ranked = pieces.join(offsets, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank_before") + F.col("rank_in_part")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seq, off = places.of(b.column("length").to_numpy(zero_copy_only=False), b.column("rank").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(5)), pa.array(seq, pa.int64()), pa.array(off, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
