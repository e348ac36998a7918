"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a piece there is one token with which its encoding ends.
That token is found from those of the shorter prefixes: a token fits behind a
prefix if merging would never join the two across their border.  The table of
last tokens is the encoder's whole state: appending extends it, an edit keeps
what lies in front of the edit, and walking it backwards yields the ids.

Defined cases: a null text counts as empty and has no ids; a null doc_id stays
null; repeated rows are encoded as often as they occur; other columns are
ignored; an empty table gives an empty result; unpaired surrogates cannot occur
in Spark strings.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunked_text import CachedEncoder
from .common import prepare, whole_text


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PrefixBpe:
    """Encoder and decoder for one rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.longest = max(map(len, ranks))
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        #: Tokens that merging reaches; the others only ever stand for a whole piece.
        self.reached: dict[bytes, int] = {}
        for word, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(word) == 1:
                self.halves[rank] = (rank, rank)
            else:
                parts = self._last_two(word, rank)
                if parts is None:
                    continue
                self.halves[rank] = parts
            self.reached[word] = rank
        self._fit: dict[tuple[int, int], bool] = {}

    def _last_two(self, word: bytes, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one, as merging in rank order would."""
        parts = [word[k : k + 1] for k in range(len(word))]
        while len(parts) > 2:
            found = [(self.ranks.get(a + b, rank), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
            low, k = min(found)
            if low >= rank:
                return None
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        a, b = (self.ranks.get(x) for x in parts)
        return None if a is None or b is None else (a, b)

    def fits(self, a: int, b: int) -> bool:
        """Whether b can follow a: merging in rank order keeps their border.

        Both tokens are taken apart along their merges, newest first; the
        border breaks if the tokens beside it would have merged earlier."""
        known = self._fit.get((a, b))
        if known is not None:
            return known
        key, left, right, word_of, ranks, halves = (a, b), a, b, self.bytes_of, self.ranks, self.halves
        limit = len(self.bytes_of) + max(a, b) + 1
        good = True
        while True:
            joint = ranks.get(word_of[left] + word_of[right])
            if joint is not None and joint < limit:
                good = False
                break
            one_left, one_right = len(word_of[left]) == 1, len(word_of[right]) == 1
            if one_left and one_right:
                break
            if not one_left and (one_right or left > right):
                limit, left = left, halves[left][1]
            else:
                limit, right = right + 1, halves[right][0]
        if len(self._fit) > 1_000_000:
            self._fit.clear()
        self._fit[key] = good
        return good

    def extend(self, raw: bytes, last: list[int]) -> list[int]:
        """last[i] is the last token of the encoding of raw[:i+1]; add what is missing."""
        reached, longest, fits, known = self.reached, self.longest, self.fits, self._fit
        for end in range(len(last) + 1, len(raw) + 1):
            for start in range(max(0, end - longest), end):
                token = reached.get(raw[start:end])
                if token is not None:
                    if not start:
                        last.append(token)
                        break
                    good = known.get((last[start - 1], token))
                    if good or (good is None and fits(last[start - 1], token)):
                        last.append(token)
                        break
        return last

    def walk(self, last: list[int]) -> tuple[int, ...]:
        out, at, word_of = [], len(last), self.bytes_of
        while at:
            out.append(last[at - 1])
            at -= len(word_of[out[-1]])
        return tuple(reversed(out))

    def piece(self, raw: bytes) -> tuple[int, ...]:
        """ids of one match of the pattern."""
        whole = self.ranks.get(raw)
        return (whole,) if whole is not None else self.walk(self.extend(raw, []))

    def encode_matches(self, matches: list[str]) -> list[bytes]:
        """For each match of the pattern its ids as little-endian unsigned 32-bit integers."""
        return [struct.pack(f"<{len(ids)}I", *ids) for ids in (self.piece(m.encode()) for m in matches)]

    def encode(self, text: str) -> list[int]:
        return [x for m in self.pattern.findall(text) for x in self.piece(m.encode())]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class Editable:
    """A piece with its table of last tokens: appends are exact, edits re-encode from where they begin."""

    def __init__(self, bpe: PrefixBpe, raw: bytes = b""):
        self.bpe, self.raw = bpe, raw
        self.last = bpe.extend(raw, [])

    def append(self, more: bytes) -> None:
        self.raw += more
        self.bpe.extend(self.raw, self.last)

    def replace(self, start: int, end: int, new: bytes) -> None:
        self.raw = self.raw[:start] + new + self.raw[end:]
        del self.last[start:]
        self.bpe.extend(self.raw, self.last)

    def ids(self) -> tuple[int, ...]:
        whole = self.bpe.ranks.get(self.raw)
        return (whole,) if whole is not None else self.bpe.walk(self.last)


_loaded: dict[tuple[str, str], tuple[PrefixBpe, CachedEncoder]] = {}


def encoder(path: str, pattern: str) -> tuple[PrefixBpe, CachedEncoder]:
    if (path, pattern) not in _loaded:
        bpe = PrefixBpe(load_ranks(path), pattern)
        _loaded[path, pattern] = bpe, CachedEncoder(pattern, bpe.encode_matches)
    return _loaded[path, pattern]


OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Encode and decode all texts: one pass without a shuffle.  with_ids adds the ids as an array."""
    prepare(docs.sparkSession)
    schema = OUT.append(pa.field("ids", pa.list_(pa.int32()))) if with_ids else OUT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, cached = encoder(ranks_path, pattern)
        for batch in batches:
            rows = []
            for doc_id, raw in zip(batch.column(0).to_pylist(), cached.raw_many(batch.column(1)), strict=True):
                ids = np.frombuffer(raw, dtype="<u4").tolist()
                row = (doc_id, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest())
                rows.append((*row, ids) if with_ids else row)
            cols = list(zip(*rows, strict=True)) or [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(run, ddl)
