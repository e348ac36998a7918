"""Document fingerprints by content-defined chunking.

A gear hash of the last 32 bytes decides where a chunk may end.  Cut points are
normalised: below the target size a stricter condition holds than above it, so
sizes gather around the target.  A fingerprint is the set of the chunks'
digests with their lengths; as a cut depends on nearby bytes only, an insertion
changes few chunks.  The likeness of two fingerprints is the share of the first
one's length that the second one holds too (containment).

Defined cases: a null text counts as empty; an empty text has the empty
fingerprint, which is contained fully in an empty one and not at all in
another; a null doc_id sorts first; rows that share a doc_id are ordered by
text; other columns are ignored; an empty table gives an empty result; a single
document is its own next one.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, prepare, whole_text

#: Chunk sizes in bytes: none ends before the least (but the last), none is longer than the most.
LEAST, TARGET, MOST = 16, 48, 192
#: Bits that must be zero at a cut: below the target size, and above it.
STRICT_BITS, LOOSE_BITS = 7, 4
#: Bytes hashed at once; the window of 32 bytes overlaps between blocks.
BLOCK = 1 << 22
WINDOW = 32
#: Range buckets for each shuffle partition.
BUCKETS_EACH = 4


def _gear() -> np.ndarray:
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return (x ^ (x >> np.uint64(31))).astype(np.uint32)


GEAR = _gear()


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """For each byte the gear hash of the (at most) 32 bytes that end there."""
    h = GEAR[data]
    width = 1
    while width < WINDOW:
        longer = h.copy()
        longer[width:] += h[:-width] << np.uint32(width) if len(h) > width else 0
        h, width = longer, 2 * width
    return h


def _candidates(data: np.ndarray) -> tuple[list[int], list[bool]]:
    ends, strict = [], []
    for start in range(0, len(data), BLOCK):
        lead = min(start, WINDOW - 1)
        h = gear_hashes(data[start - lead : start + BLOCK])[lead:]
        at = np.flatnonzero(h >> np.uint32(32 - LOOSE_BITS) == 0)
        ends.extend((at + (start + 1)).tolist())
        strict.extend((h[at] >> np.uint32(32 - STRICT_BITS) == 0).tolist())
    return ends, strict


def chunk_ends(raw: bytes) -> list[int]:
    """End offsets of the chunks of a byte string; the last is its length."""
    cuts: list[int] = []
    start = 0
    for end, sure in zip(*_candidates(np.frombuffer(raw, dtype=np.uint8)), strict=True):
        while end - start > MOST:
            start += MOST
            cuts.append(start)
        if end - start >= (LEAST if sure else TARGET):
            cuts.append(end)
            start = end
    while len(raw) - start > MOST:
        start += MOST
        cuts.append(start)
    if start < len(raw):
        cuts.append(len(raw))
    return cuts


def chunks(raw: bytes) -> frozenset[int]:
    """The set of chunks: 56 bits of digest, then 8 bits of length."""
    out, start, digest = set(), 0, xxhash.xxh3_64_intdigest
    for end in chunk_ends(raw):
        out.add((digest(raw[start:end]) & ~0xFF) | (end - start))
        start = end
    return frozenset(out)


def encode(found: frozenset[int]) -> str:
    return base64.b64encode(np.sort(np.fromiter(found, dtype="<u8", count=len(found))).tobytes()).decode()


def decode(fingerprint: str) -> frozenset[int]:
    return frozenset(np.frombuffer(base64.b64decode(fingerprint), dtype="<u8").tolist())


def containment(a: frozenset[int], b: frozenset[int]) -> float:
    """The share of a's length that lies in chunks which b has too."""
    if not a:
        return 1.0 if not b else 0.0
    return sum(x & 0xFF for x in a & b) / sum(x & 0xFF for x in a)


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by as many first code points of the following one."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


RESULT = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("n_chunks", pa.int64())]
)


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (bucket, halo, doc_id, text): each is compared with the one after it in its bucket.

    A bucket's halo row is a copy of the first row of the next bucket."""
    last = None  # bucket, doc_id, text, chunks
    rows: list[tuple] = []

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*rows, strict=True), RESULT, strict=True)], schema=RESULT)
        rows.clear()
        return out

    for batch in batches:
        for bucket, halo, doc_id, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if last is None and halo:
                continue
            own = chunks(text.encode("utf-8", "surrogatepass"))
            if last is not None:
                if last[0] == bucket:
                    _, was, before, theirs = last
                    new = edited(before, text)
                    raw = new.encode("utf-8", "surrogatepass")
                    changed = chunks(raw)
                    rows.append((was, len(before), hashlib.sha256(raw).hexdigest(), encode(theirs), encode(changed), containment(theirs, changed), containment(theirs, own), len(theirs)))
                last = None
            if not halo:
                last = (bucket, doc_id, text, own)
        if rows:
            yield flush()


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, and how alike they are.

    One shuffle of the texts: they are dealt to ranges of doc_id, and the first
    row of each range goes to the range before it as well.  The driver sees the
    split points and the least doc_id of each range, BUCKETS_EACH for each
    shuffle partition, and no more."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    n = BUCKETS_EACH * partitions(spark)
    found = rows.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], max(10_000, 10 * n)).alias("at")).first()["at"]
    splits = np.unique(np.array([x for x in found or [] if x is not None], dtype=np.int64))

    @F.pandas_udf("int")
    def bucket_of(ids):
        import pandas as pd

        known = ids.notna().to_numpy()
        out = np.zeros(len(ids), dtype=np.int32)
        out[known] = np.searchsorted(splits, ids[known].to_numpy(dtype=np.int64), side="right")
        return pd.Series(out)

    dealt = rows.withColumn("bucket", bucket_of("doc_id"))
    firsts = rows.select(bucket_of("doc_id").alias("bucket"), "doc_id").groupBy("bucket").agg(F.min(F.struct("doc_id")).alias("first")).orderBy("bucket").collect()
    if not firsts:
        return spark.createDataFrame([], RESULT_DDL)
    buckets = [r["bucket"] for r in firsts]
    halo = spark.createDataFrame([(r["first"]["doc_id"], int(buckets[k - 1])) for k, r in enumerate(firsts)], "first_id long, before int")
    dealt = dealt.join(F.broadcast(halo), dealt["doc_id"].eqNullSafe(halo["first_id"]), "left")
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("halo"))
    copy = F.struct(F.col("before").alias("bucket"), F.lit(True).alias("halo"))
    dealt = dealt.select(F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, copy))).alias("to"), "doc_id", "text")
    dealt = dealt.select("to.bucket", "to.halo", "doc_id", "text").repartition(partitions(spark), "bucket").sortWithinPartitions("bucket", "halo", "doc_id", "text")
    return dealt.mapInArrow(_judge, RESULT_DDL)


RESULT_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_chunks long"
