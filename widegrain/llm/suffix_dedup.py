"""Exact substring deduplication with suffix arrays built by linear grouping.

A byte goes if it lies in a string of LENGTH bytes that also starts somewhere
else.  Every such string has an anchor: of its grams the one with the least
hash, the first of equals.  Equal strings have equal anchors at equal places,
so texts are cut into segments, one for each anchor, that hold all strings with
that anchor; segments whose anchor occurs once are dropped, equal segments are
counted and kept once, and strings are compared within the groups of segments
with one anchor.  There a suffix array decides: segments are read as sequences
of blocks that are aligned at the anchor, the suffixes are sorted, and strings
agree if their blocks form one run of the array and the few bytes at both ends
are equal.  A group with very many segments is split; its parts then exchange
digests of their strings, so nothing is missed.

The suffix array is built without recursion: suffixes are grouped by their
Lyndon prefixes, groups are taken in descending order, each suffix hands its
group to its previous smaller suffix, which thereby moves to a higher group;
then the order inside all groups is emitted from the smallest suffix on.

Defined cases: a null text counts as empty; texts shorter than LENGTH lose
nothing; a null doc_id stays null; repeated rows are separate texts, so each
loses all of a text of LENGTH bytes or more; other columns are ignored or, in
remove_repeats(), kept; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_place, packed, partitions, prepare, save, unpacked, whole_text

LENGTH = 200
GRAM = 16
#: Grams of one string.
SPAN = LENGTH - GRAM + 1
#: Bytes of a symbol of the suffix array.
SYMBOL = 16
#: Whole blocks that every string holds, whatever its place among them.
CORE = LENGTH // SYMBOL - 1
#: Strings that are begun in one block of a long text.
PIECE = 1 << 23
#: Segments of one part of a group; symbols of one suffix array.
SEGMENTS, SYMBOLS = 32_768, 40_000

_PLACE = np.uint64((1 << 24) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all grams of GRAM bytes."""
    h, width = _BYTES[data], 1
    while width < GRAM:
        factor = np.uint64(pow(0xD6E8FEB86659FD93, width, 1 << 64))
        h = h[:-width] * factor + h[width:]
        width *= 2
    return _mix(h)


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(x)] = x
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(raw: bytes) -> list[tuple[int, int, int, int]]:
    """(anchor hash, first string's start, number of strings, anchor's offset from that start) of a text's segments."""
    out: list[tuple[int, int, int, int]] = []
    for begin in range(0, len(raw) - LENGTH + 1, PIECE):
        data = np.frombuffer(raw[begin : begin + PIECE + LENGTH - 1], dtype=np.uint8)
        h = gram_hashes(data)
        place = np.arange(len(h), dtype=np.uint64)
        owner = (_window_min((h & ~_PLACE) | place, SPAN) & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        count = np.diff(np.append(first, len(owner)))
        out.extend(zip(h[owner[first]].view(np.int64).tolist(), (first + begin).tolist(), count.tolist(), (owner[first] - first).tolist(), strict=True))
    return out


def suffix_array(seq: list[int]) -> list[int]:
    """Suffix array of a sequence of small non-negative integers, by Lyndon groups.

    A suffix's Lyndon prefix is its first symbol followed by the Lyndon prefixes
    of the suffixes whose previous smaller suffix it is, the greatest first.
    So with groups taken in descending order each suffix learns the rest of its
    own group bit by bit."""
    n = len(seq)
    if n < 2:
        return list(range(n))
    # groups by first symbol, linked from the lowest to the highest
    places: dict[int, list[int]] = {}
    for i, c in enumerate(seq):
        places.setdefault(c, []).append(i)
    members = [places[c] for c in sorted(places)]
    size = [len(m) for m in members]
    lower = list(range(-1, len(members) - 1))
    upper = [*range(1, len(members)), -1]
    group = [0] * n
    for g, found in enumerate(members):
        for i in found:
            group[i] = g
    smaller, done = [-1] * n, bytearray(n)
    current, order = len(members) - 1, []
    while current >= 0:
        if size[current]:
            found = members[current]
            if len(found) != size[current]:
                found = [i for i in found if group[i] == current]
            if len(found) > 1:
                found.sort()
            order.append(current)
            times: dict[int, int] = {}
            for i in found:
                p = i - 1
                while p >= 0 and done[p]:
                    p = smaller[p]
                smaller[i] = p
                done[i] = 1
                if p >= 0:
                    times[p] = times.get(p, 0) + 1
            # parents rise above those of their group that have fewer children here
            if len(times) == 1:
                ((p, _),) = times.items()
                raised = [(group[p], 1, [p])]
            else:
                split: dict[tuple[int, int], list[int]] = {}
                for p, k in times.items():
                    split.setdefault((group[p], k), []).append(p)
                raised = [(g, k, split[g, k]) for g, k in sorted(split, reverse=True)]
            for g, _, parents in raised:
                if len(parents) == size[g]:
                    # all that is left of the group rises: it keeps its place
                    if len(members[g]) != size[g]:
                        members[g] = parents
                    continue
                new = len(members)
                members.append(parents)
                size.append(len(parents))
                size[g] -= len(parents)
                above = upper[g]
                lower.append(g)
                upper.append(above)
                upper[g] = new
                lower[above] = new
                for p in parents:
                    group[p] = new
        current = lower[current]
    head, at = {}, n
    for g in order:
        at -= size[g]
        head[g] = at
    out = [-1] * n
    i = n - 1
    while i >= 0:  # suffixes that end with their Lyndon prefix
        g = group[i]
        out[head[g]] = i
        head[g] += 1
        i = smaller[i]
    for r in range(n):
        s = out[r]
        i, stop = s - 1, smaller[s]
        while i != stop:
            g = group[i]
            out[head[g]] = i
            head[g] += 1
            i = smaller[i]
    return out


def repeated_strings(segments: list[tuple[bytes, int, int]]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For (segment, anchor offset, how often it occurs): which of its strings occur more than once.

    Also, for the exchange between parts of a group: for each string the number
    of its content, and the first string with each content."""
    counts = np.array([len(s) - LENGTH + 1 for s, _, _ in segments])
    lengths = np.array([len(s) for s, _, _ in segments])
    begins = np.cumsum(lengths) - lengths
    data = np.frombuffer(b"".join(s for s, _, _ in segments) + bytes(16), dtype=np.uint8).astype(np.uint64)
    # eight bytes from each place on as one number
    word = data[:-7].copy()
    for k in range(1, 8):
        word |= data[k : len(data) - 7 + k] << np.uint64(8 * k)
    # blocks of all segments, each followed by a separator of its own
    leads = np.array([o for _, o, _ in segments]) % SYMBOL
    blocks = (lengths - leads) // SYMBOL
    first = np.cumsum(blocks + 1) - (blocks + 1)
    own = np.repeat(np.arange(len(segments)), blocks + 1)
    nth = np.arange(len(own)) - first[own]
    real = nth < blocks[own]
    at = np.where(real, begins[own] + leads[own] + SYMBOL * nth, 0)
    halves = [np.where(real, word[at + 8 * j], own.astype(np.uint64)) for j in range(SYMBOL // 8)]
    digest = np.zeros(len(own), dtype=np.uint64)
    for h in halves:
        digest = _mix(digest + h)
    _, rank = np.unique(digest[real], return_inverse=True)
    seq = own.copy()
    seq[real] = rank + len(segments)
    sa = np.array(suffix_array(seq.tolist()), dtype=np.int64)
    kind = np.concatenate([real, np.zeros(CORE, bool)])
    padded = [np.concatenate([h, np.zeros(CORE, np.uint64)]) for h in halves]
    same = np.ones(len(sa) - 1, dtype=bool)
    for k in range(CORE):
        x, y = sa[1:] + k, sa[:-1] + k
        same &= kind[x] & kind[y]
        for h in padded:
            same &= h[x] == h[y]
    run = np.empty(len(sa), dtype=np.int64)
    run[sa] = np.cumsum(np.append(0, ~same))
    # every string: the run of its first whole block, its bytes before that block and after the core
    which = np.repeat(np.arange(len(segments)), counts)
    p = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    q = -(-(p - leads[which]) // SYMBOL)
    before = leads[which] + SYMBOL * q - p
    key = (run[first[which] + q] * SYMBOL + before).astype(np.uint64)
    start = begins[which] + p
    parts = [key]
    for k in range((LENGTH - CORE * SYMBOL) // 8):
        # bytes 8k.. of those outside the core: in front of it, then behind it
        ahead = np.clip(before - 8 * k, 0, 8).astype(np.uint64)
        mask = np.where(ahead == 8, ~np.uint64(0), (np.uint64(1) << (np.uint64(8) * (ahead % np.uint64(8)))) - np.uint64(1))
        parts.append((word[start + 8 * k] & mask) | (word[start + CORE * SYMBOL + 8 * k] & ~mask))
    digest = np.zeros(len(key), dtype=np.uint64)
    for x in parts:
        digest = _mix(digest + x)
    order = np.argsort(digest)
    new = np.ones(len(order), dtype=bool)
    new[1:] = False
    for x in parts:
        y = x[order]
        new[1:] |= y[1:] != y[:-1]
    content = np.empty(len(order), dtype=np.int64)
    content[order] = np.cumsum(new) - 1
    total = np.bincount(content, weights=np.array([c for _, _, c in segments])[which])
    hit = total[content] > 1
    return np.split(hit, np.cumsum(counts)[:-1]), content, order[new]


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _raw(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


ANCHORS = "row long, doc_id long, n_bytes long, sha256 string, h array<long>, s array<int>, m array<int>, o array<int>"


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.string(), *map(pa.list_, (pa.int64(), pa.int32(), pa.int32(), pa.int32()))]
    for b in batches:
        cols: list[list] = [[] for _ in types]
        for text in b.column("text").to_pylist():
            raw = _raw(text)
            found = list(zip(*anchors(raw), strict=True)) or [[], [], [], []]
            for c, v in zip(cols, (len(raw), hashlib.sha256(raw).hexdigest(), *found), strict=True):
                c.append(v)
        yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["row", "doc_id", "n_bytes", "sha256", "h", "s", "m", "o"])


def _segment_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, text, h, s, m, o) to segments: where each is, and a digest of its bytes and anchor offset."""
    for b in batches:
        cols: list[list] = [[] for _ in range(6)]
        for row, text, hs, ss, ms, os_ in zip(*(b.column(k).to_pylist() for k in ("row", "text", "h", "s", "m", "o")), strict=True):
            raw = _raw(text)
            cols[0] += [row] * len(hs)
            for c, v in zip(cols[1:5], (ss, ms, os_, hs), strict=True):
                c += v
            cols[5] += [xxhash.xxh3_128_digest(raw[s : s + m + LENGTH - 1], seed=o) for s, m, o in zip(ss, ms, os_, strict=True)]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["row", "s", "m", "o", "h", "key"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, at) to the segments that at lists, with their bytes."""
    kinds = [("h", pa.int64()), ("part", pa.int64()), ("parts", pa.int64()), ("key", pa.binary()), ("seg", pa.binary()), ("o", pa.int32()), ("n", pa.int64())]

    def made(cols):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, kinds, strict=True)], names=[n for n, _ in kinds])

    for b in batches:
        cols: list[list] = [[] for _ in kinds]
        for text, at in zip(b.column("text").to_pylist(), b.column("at").to_pylist(), strict=True):
            raw = _raw(text)
            for x in at:
                for c, v in zip(cols, (x["h"], x["part"], x["parts"], x["key"], raw[x["s"] : x["s"] + x["m"] + LENGTH - 1], x["o"], x["n"]), strict=True):
                    c.append(v)
            if len(cols[0]) > 4_000:
                yield made(cols)
                cols = [[] for _ in kinds]
        yield made(cols)


def _judge_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (h, part): which strings of segments that occur once occur elsewhere; digests where a group is split.

    Out: key, first, last (strings first..last-1 of the segment are repeated);
    or key or null, first, null and the digest of a string of a split group."""
    held: list[tuple] = []
    n = 0

    def flush():
        out: list[tuple] = []
        hits, content, firsts = repeated_strings([(seg, o, c) for _, _, _, _, seg, o, c in held])
        at = 0
        single_of: list[tuple] = []
        for (_, _, parts, key, seg, _, c), mask in zip(held, hits, strict=True):
            if c == 1:
                out.extend((key, a, b, None) for a, b in _runs(mask))
            if parts > 1:
                single_of.append((at, key, seg, c == 1, mask))
            at += len(mask)
        known = set(firsts.tolist())
        for at, key, seg, once, mask in single_of:
            for p in range(len(mask)):
                if at + p in known:  # each content of this part speaks once; those that are alone here wait for an answer
                    alone = once and not mask[p]
                    out.append((key if alone else None, p, None, xxhash.xxh3_128_digest(seg[p : p + LENGTH])))
        held.clear()
        cols = list(zip(*out, strict=True)) or [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.binary(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["key", "first", "last", "digest"])

    for b in batches:
        for row in zip(*(b.column(k).to_pylist() for k in ("h", "part", "parts", "key", "seg", "o", "n")), strict=True):
            if held and row[:2] != held[-1][:2] and n > SYMBOLS * SYMBOL:
                yield flush()
                n = 0
            held.append(row)
            n += len(row[4])
    if held:
        yield flush()


def _spans(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, found, spans): row, doc_id, n_bytes, sha256 of every text; row and text where an anchor is repeated; row and repeated spans where there are any."""
    spark = docs.sparkSession
    prepare(spark)
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    rows = save(texts.mapInArrow(_anchor_rows, ANCHORS), "anchors")
    each = rows.select("row", F.posexplode("h").alias("k", "h"))
    often = save(each.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "anchors-often")
    some = save(each.join(often, "h", "left_semi").groupBy("row").agg(F.collect_list("k").alias("ks")), "anchors-kept")
    pick = lambda c: F.transform("ks", lambda k: F.col(c)[k]).alias(c)
    chosen = rows.select("row", "h", "s", "m", "o").join(some, "row").select("row", *map(pick, "hsmo"))
    found = save(texts.select("row", "text").join(chosen, "row"), "anchored")

    keyed = found.mapInArrow(_segment_keys, "row long, s int, m int, o int, h long, key binary")
    # equal segments are one; any of their places will do
    segments = save(keyed.groupBy("h", "key").agg(F.count(F.lit(1)).alias("n"), *(F.first(c).alias(c) for c in ("row", "s", "m", "o"))), "segments")
    groups = segments.groupBy("h").agg(F.count(F.lit(1)).alias("size"), F.sum((F.col("n") == 1).cast("int")).alias("once"))
    easy = segments.where("n > 1").select("key", F.lit(0).alias("first"), F.col("m").alias("last"))
    hard = segments.join(groups.where("size > 1 AND once > 0").select("h", F.ceil(F.col("size") / SEGMENTS).alias("parts")), "h")
    hard = hard.withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts"))).groupBy("row").agg(F.collect_list(F.struct("h", "part", "parts", "key", "s", "m", "o", "n")).alias("at"))
    cut = found.select("row", "text").join(hard, "row").select("text", "at").mapInArrow(_cut, "h long, part long, parts long, key binary, seg binary, o int, n long")
    judged = cut.repartition(partitions(spark), "h", "part").sortWithinPartitions("h", "part").mapInArrow(_judge_groups, "key binary, first int, last int, digest binary")
    judged = save(judged, "judged")
    speaks = judged.where("digest IS NOT NULL")
    shared = speaks.groupBy("digest").agg(F.count(F.lit(1)).alias("parts")).where("parts > 1").select("digest")
    answered = speaks.where("key IS NOT NULL").join(shared, "digest", "left_semi").select("key", "first", (F.col("first") + 1).alias("last"))
    repeats = easy.unionByName(judged.where("digest IS NULL").select("key", "first", "last")).unionByName(answered)

    places = keyed.select("row", F.col("s").cast("long").alias("s"), "key")
    spans = places.join(repeats, "key").groupBy("row").agg(F.collect_list(F.struct((F.col("s") + F.col("first")).alias("a"), (F.col("s") + F.col("last") + (LENGTH - 1)).alias("b"))).alias("spans"))
    return rows, found.select("row", "text"), spans


def without(raw: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, list[tuple[int, int]]]:
    """(what is left, maximal removed runs)."""
    gone = union(spans)
    return b"".join(raw[a:c] for a, c in zip([0, *(y for _, y in gone)], [*(x for x, _ in gone), len(raw)], strict=True)), gone


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.int64(), pa.string()]
    for b in batches:
        out: list[list] = [[] for _ in types]
        for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
            kept, gone = without(_raw(text), [(x["a"], x["b"]) for x in spans])
            for c, v in zip(out, (sum(y - x for x, y in gone), len(gone), hashlib.sha256(kept).hexdigest()), strict=True):
                c.append(v)
        yield pa.RecordBatch.from_arrays([b.column("row"), *(pa.array(c, t) for c, t in zip(out, types, strict=True))], names=["at", "n_removed", "n_spans", "kept_sha256"])


def repeat_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    rows, found, spans = _spans(in_place(docs, "rows"))
    removed = found.join(spans, "row").mapInArrow(_remove, "at long, n_removed long, n_spans long, kept_sha256 string")
    out = rows.select("row", "doc_id", "n_bytes", "sha256").join(removed, F.col("row") == F.col("at"), "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "sha256").alias("kept_sha256"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """All rows and columns, texts without their repeated strings; n_chars, if there is one, follows the text.

    Characters of which only some bytes are repeated go as a whole."""
    docs = in_place(docs, "rows")
    _, _, spans = _spans(docs)

    @F.pandas_udf("string")
    def shortened(texts, starts, ends):
        import pandas as pd

        made = [None if t is None else without(_raw(t), list(zip(a.tolist(), b.tolist(), strict=True)))[0].decode("utf-8", "ignore") for t, a, b in zip(texts, starts, ends, strict=True)]
        return pd.Series(made, dtype="object")

    spans = spans.select(F.col("row").alias("__at"), F.col("spans.a").alias("__a"), F.col("spans.b").alias("__b"))
    out = packed(docs).withColumn("__row", F.monotonically_increasing_id()).join(spans, F.col("__row") == F.col("__at"), "left")
    hit = F.col("__at").isNotNull()
    # texts that keep all their bytes don't visit Python
    out = out.withColumn("__kept", shortened(F.when(hit, whole_text("__doc.text")), "__a", "__b"))
    doc = F.col("__doc").withField("text", F.col("__kept"))
    if "n_chars" in docs.columns:
        doc = doc.withField("n_chars", F.length("__kept").cast(docs.schema["n_chars"].dataType))
    return unpacked(out.select(F.when(hit, doc).otherwise(F.col("__doc")).alias("__doc")))
