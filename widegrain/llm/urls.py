"""URL filter: a blocked Bloom filter in front of an exact join with the listed URLs.

A listed URL is canonical: a lower-case host, a path, and a verdict.  It fits
every URL of its host and of the host's subdomains whose path begins with its
path; the longest one decides.  For each URL the keys that could be listed (host
suffix and path prefix, for the path lengths that occur in the list) are asked
of the Bloom filter; only possible hits go on to the join, which removes false
positives.  A URL that no entry fits is allowed.

Defined cases: host and path of a null URL, and of one without "://", are
empty, and nothing fits them; repeated rows are judged one by one; page_id may
be null or repeat; whole URLs are read, however long; other columns are ignored;
an empty table gives an empty result, an empty list allows everything; entries
without a host or path fit nothing; of entries of equal length the one with the
longer host decides, of equal entries the one with the greater verdict (block).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_place, partitions, prepare, save

#: Blocks of 512 bits; a key sets PROBES bits of one block.
BLOCK_BITS, PROBES = 512, 6
#: Bits for each entry, and the least and the most that a filter takes; a list beyond that leaves the join more to remove.
ENTRY_BITS, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 28
#: A list of up to so many entries is broadcast for the exact join; a longer one is shuffled, but for keys that very many rows have.
BROADCAST_ENTRIES = 100_000
#: Letters whose case a host ignores.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

HOST = r"(?s)^.*?://([^/?#]*)"
PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"


class BlockedBloom:
    """A Bloom filter whose bits for one key lie in one block of a cache line."""

    def __init__(self, bits: int = 1 << 20, data: np.ndarray | None = None):
        self.blocks = max(1, bits // BLOCK_BITS)
        self.data = np.zeros((self.blocks, BLOCK_BITS // 64), dtype=np.uint64) if data is None else data

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        block = (keys >> np.uint64(32)) % np.uint64(self.blocks)
        step = (keys & np.uint64(0xFFFF)) | np.uint64(1)
        first = (keys >> np.uint64(16)) & np.uint64(0xFFFF)
        return block.astype(np.int64), (first[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)) % np.uint64(BLOCK_BITS)

    def add(self, keys: np.ndarray) -> None:
        block, bit = self._places(keys)
        np.bitwise_or.at(self.data, (block[:, None], (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))

    def has(self, keys: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(0, dtype=bool)
        block, bit = self._places(keys)
        return ((self.data[block[:, None], (bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1)).all(axis=1)


def _hashes(keys: list[str]) -> np.ndarray:
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(k.encode()) for k in keys), dtype=np.uint64, count=len(keys))


def candidate_keys(host: str, path: str, lengths: tuple[int, ...], labels: int) -> list[str]:
    """What could be listed for a URL: each suffix of the host of at most so many whole labels, with path prefixes."""
    last = host.rsplit(".", labels)[-labels:] if labels else []
    prefixes = [path[:n] for n in lengths if n <= len(path)]
    whole = [host] if host.count(".") < labels else []
    return [h + "\t" + p for h in [*whole, *(".".join(last[k:]) for k in range(len(whole), len(last)))] for p in prefixes] if host else []


def filter_bits(entries: int) -> int:
    """The power of two that gives each entry ENTRY_BITS, within the bounds."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (ENTRY_BITS * entries - 1).bit_length()))


def build_filter(entries: DataFrame, bits: int) -> tuple[BlockedBloom, tuple[int, ...], int]:
    """The filter of the listed keys, the path lengths, and how many labels the listed hosts have at most.

    Each task makes a filter of the fixed size; the driver joins them by OR, one
    at a time."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom, lengths, labels = BlockedBloom(bits), set(), 0
        for b in batches:
            hosts, paths = b.column(0).to_pylist(), b.column(1).to_pylist()
            bloom.add(_hashes([f"{h}\t{p}" for h, p in zip(hosts, paths, strict=True)]))
            lengths.update(map(len, paths))
            labels = max([labels, *(h.count(".") + 1 for h in hosts)])
        yield pa.RecordBatch.from_arrays([pa.array([bloom.data.tobytes()], pa.binary()), pa.array([sorted(lengths)], pa.list_(pa.int32())), pa.array([labels], pa.int64())], names=["bits", "lengths", "labels"])

    whole, lengths, labels = BlockedBloom(bits), set(), 0
    for row in entries.select("host", "path").mapInArrow(part, "bits binary, lengths array<int>, labels long").toLocalIterator():
        whole.data |= np.frombuffer(row["bits"], dtype=np.uint64).reshape(whole.data.shape)
        lengths.update(row["lengths"])
        labels = max(labels, row["labels"])
    return whole, tuple(sorted(lengths)), labels


def split_url(url):
    """(host, path) columns of a URL column."""
    has = F.coalesce(url.contains("://"), F.lit(False))
    host = F.when(has, F.translate(F.regexp_extract(url, HOST, 1), UPPER, LOWER)).otherwise(F.lit(""))
    path = F.when(has, F.regexp_extract(url, PATH, 1)).otherwise(F.lit(""))
    return host, path


def _met(possible: DataFrame, listed: DataFrame) -> DataFrame:
    """The exact join with a list that is too long to broadcast.

    Keys that more than a partition's share of the rows have are fewer than the
    partitions; their entries are broadcast, and the others' rows spread over the
    shuffle."""
    possible = save(possible, "urls")
    share = possible.count() // partitions(possible.sparkSession)
    many = save(possible.groupBy("key").count().where(F.col("count") > share).select("key"), "urls")
    hot = possible.join(F.broadcast(many), "key", "left_semi").join(F.broadcast(listed.join(F.broadcast(many), "key", "left_semi")), "key", "left")
    return hot.unionByName(possible.join(F.broadcast(many), "key", "left_anti").join(listed, "key", "left"))


def judge_urls(pages: DataFrame, entries: DataFrame, bits: int | None = None) -> DataFrame:
    """Verdicts for all rows of pages(page_id, url); entries has host, path, verdict.

    The filter has so many bits, by default as many as the list needs.  Rows
    without a possible hit take no part in the join.  Rows are told apart by
    their place in the scan, which a repeated attempt gives them again; rows that
    have none are written first."""
    prepare(pages.sparkSession)
    entries = entries.select("host", "path", "verdict").where("host IS NOT NULL AND path IS NOT NULL")
    n = entries.count()
    bloom, lengths, labels = build_filter(entries, bits or filter_bits(n))
    host, path = split_url(F.col("url"))
    rows = in_place(pages.select("page_id", F.col("url").cast("string").alias("url")), "urls").withColumn("host", host).withColumn("path", path)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, ends = [], []
            for h, p in zip(b.column("host").to_pylist(), b.column("path").to_pylist(), strict=True):
                keys.extend(candidate_keys(h, p, lengths, labels))
                ends.append(len(keys))
            hit = bloom.has(_hashes(keys)).tolist()
            found, start = [], 0
            for end in ends:
                found.append([keys[k] for k in range(start, end) if hit[k]])
                start = end
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(4)), pa.array(found, pa.list_(pa.string()))], names=["row", "page_id", "host", "path", "keys"])

    asked = rows.select(F.monotonically_increasing_id().alias("row"), "page_id", "host", "path").mapInArrow(ask, f"row long, page_id {pages.schema['page_id'].dataType.simpleString()}, host string, path string, keys array<string>")
    listed = entries.select(F.concat_ws("\t", "host", "path").alias("key"), F.struct((F.length("host") + F.length("path")).alias("n"), F.length("host").alias("h"), F.concat("host", "path").alias("rule"), "verdict").alias("entry"))
    possible = asked.where(F.size("keys") > 0).withColumn("key", F.explode("keys")).drop("keys")
    joined = possible.join(F.broadcast(listed), "key", "left") if n <= BROADCAST_ENTRIES else _met(possible, listed)
    best = joined.groupBy("row").agg(F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("path").alias("path"), F.max("entry").alias("entry"))
    none = asked.where(F.size("keys") == 0).select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    return none.unionByName(best.select("page_id", "host", "path", F.col("entry.rule").alias("rule"), F.coalesce("entry.verdict", F.lit("allow")).alias("verdict")))
