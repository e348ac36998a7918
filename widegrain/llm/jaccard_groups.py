"""Near-duplicate documents by a token-group matrix: all links of word n-gram sets with Jaccard similarity.

Documents with equal sets form a class; what follows is about classes, each
known by its first row.  Classes that agree on a band of min-hashes meet.

Similar classes are partitioned into groups: each class joins the group of the
least class that it meets in most bands.  A large group is cut into blocks of
bounded size, its leader standing in every block.  Of a block the union of its
members' tokens is kept; a class is held against the union, which bounds its
overlap with every member, and only a block that may qualify is opened: whose
each token is tells the overlap with all members at once, and those that
qualify are compared, unless they are linked with the class already.

What that links is contracted.  A class may also meet classes of other groups:
a band in which several components are left is a block too.  A large one is cut
into tiles of like size, the greater the larger it is, and each class is held
against those it may be linked with.  Similarities are computed on the whole
sets.  Rows grow with the power 1.5 of a large band (with its square once
tiles reach TOKENS), the look-ups inside the tiles with its square.

Two sets at the threshold itself agree on no band with a probability below
MISS; more alike ones with a smaller one still.  Every pair that meets is
settled: either both are in one component already, or it is compared.

Defined cases: a null or wordless text has the empty set and is linked with
nothing; a text of fewer words than a shingle has its whole sequence as its one
shingle; a null doc_id has no say in a component's name, and a component without
any other has none; repeated rows are one class; other columns are ignored or,
in one_of_each(), kept; an empty table gives an empty result.  Rows are known by
their places in the scan; rows that have none are written first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_place, packed, partitions, prepare, save, unpacked, whole_text
from .components import components

BANDS = 50
#: Chance at most that two sets at the threshold agree on no band.
MISS = 1e-6
#: Members of a block of a group and tokens of any block, as expected of a hash; queries that are held against it in one turn, and classes of a band that is one block.
MEMBERS, TOKENS, QUERIES = 64, 4 << 20, 512
#: Words whose hashes a worker keeps.
CACHE_WORDS = 400_000

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _odd(n: int, seed: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def rows_of_band(percent: int) -> int:
    """The most min-hashes a band may have to miss a pair at the threshold with a chance below MISS."""
    t, r = percent / 100, 1
    while (1 - t ** (r + 1)) ** BANDS <= MISS:
        r += 1
    return r


class Shingler:
    """Sets of hashed word n-grams."""

    def __init__(self, width: int):
        self.width, self.known = width, {}
        self.factors = _odd(width, 1)

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, dtype=np.uint64)
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        k = min(self.width, len(h))
        out = np.full(len(h) - k + 1, np.uint64(k), dtype=np.uint64)
        for j in range(k):
            out += _mix(h[j : len(h) - k + 1 + j] * self.factors[j])
        return np.unique(_mix(out))


class Bands:
    """Keys under which similar sets meet."""

    def __init__(self, percent: int):
        self.rows = rows_of_band(percent)
        self.factors = _odd(BANDS * self.rows, 2)

    def __call__(self, tokens: np.ndarray) -> list[int]:
        least = np.full(BANDS * self.rows, np.iinfo(np.uint64).max, dtype=np.uint64)
        for k in range(0, len(tokens), 256):
            np.minimum(least, (tokens[k : k + 256, None] * self.factors).min(axis=0), out=least)
        raw = least.tobytes()
        step, h = 8 * self.rows, xxhash.xxh3_64_intdigest
        return [h(raw[k * step : (k + 1) * step], seed=k) - (1 << 63) for k in range(BANDS)]


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, of sorted sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def _features(width: int, percent: int):
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("sig", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, bands = Shingler(width), Bands(percent)
        for b in batches:
            ns, sigs, keys = [], [], []
            for text in b.column("text").to_pylist():
                tokens = shingles(text)
                ns.append(len(tokens))
                sigs.append(xxhash.xxh3_128_digest(tokens.tobytes()))
                keys.append(bands(tokens) if len(tokens) else [])
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), pa.array(ns, pa.int64()), pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], schema=schema)

    return run


def _sets(width: int):
    """(cid, row, text) to (cid, tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(width)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("cid"), pa.array([shingles(t).tobytes() for t in b.column("text").to_pylist()], pa.binary())], names=["cid", "tokens"])

    return run


class Block:
    """Members of a group with the union of their tokens, whose each of them is, and what is linked so far."""

    def __init__(self, percent: int):
        self.percent, self.members, self.up = percent, [], {}
        #: The tokens of the first members in order, and by their places whose they are; the sizes of these members.
        self._placed, self._owners, self._sizes = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)

    def _find(self, comp: int) -> int:
        while (above := self.up.get(comp, comp)) != comp:
            comp = above
        return comp

    def _place(self, wait: int = 0) -> None:
        """Put the tokens of all members in order, unless no more than so many of them wait for it."""
        have, late = len(self._sizes), [tokens for _, _, tokens in self.members[len(self._sizes) :]]
        if len(late) <= wait:
            return
        sizes = np.array([len(t) for t in late], dtype=np.int64)
        tokens = np.concatenate([self._placed, *late])
        owners = np.concatenate([self._owners, np.repeat(np.arange(have, len(self.members), dtype=np.int32), sizes)])
        order = np.argsort(tokens, kind="stable")
        self._placed, self._owners, self._sizes = tokens[order], owners[order], np.concatenate([self._sizes, sizes])

    @property
    def union(self) -> np.ndarray:
        self._place()
        return np.unique(self._placed)

    def add(self, cid: int, comp: int, tokens: np.ndarray) -> None:
        self.members.append((cid, comp, tokens))

    def _may_be_linked(self, tokens: np.ndarray) -> list[int]:
        """Places of the members that are similar, and of those whose tokens aren't in order yet."""
        self._place(wait=max(8, len(self._sizes) // 8))
        first, end = np.searchsorted(self._placed, tokens), np.searchsorted(self._placed, tokens, side="right")
        first, many = first[end > first], (end - first)[end > first]
        late = list(range(len(self._sizes), len(self.members)))
        # an intersection with a member is at most the overlap with the union, and must reach percent of the class's size
        if 100 * len(many) < self.percent * len(tokens):
            return late
        at = np.arange(many.sum()) + np.repeat(first - np.cumsum(many) + many, many)
        common = np.bincount(self._owners[at], minlength=len(self._sizes))
        return np.flatnonzero(100 * common >= self.percent * (len(tokens) + self._sizes - common)).tolist() + late

    def ask(self, comp: int, tokens: np.ndarray) -> Iterator[int]:
        """Members that a class of this component is linked with, one of each component at most."""
        for k in self._may_be_linked(tokens):
            other, its, theirs = self.members[k]
            mine, its = self._find(comp), self._find(its)
            if mine != its and similar(tokens, theirs, self.percent):
                self.up[its] = mine
                yield other


#: What a row of the matrix does: stand in the block, ask it, or ask it and then stand in it.
STANDS, ASKS, BOTH = 0, 1, 2


def _open_blocks(percent: int):
    """Rows of (a block's key columns, kind, cid, comp, tokens), sorted by key and kind, to links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block = None, None
        for b in batches:
            left, right = [], []
            for *at, kind, cid, comp, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if at != key:
                    key, block = at, Block(percent)
                tokens = np.frombuffer(raw, np.uint64)
                if kind != STANDS:
                    for other in block.ask(comp, tokens):
                        left.append(cid)
                        right.append(other)
                if kind != ASKS:
                    block.add(cid, comp, tokens)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return run


def _links(matrix: DataFrame, key: list[str], percent: int) -> DataFrame:
    rows = matrix.select(*key, "kind", "cid", "comp", "tokens")
    rows = rows.repartition(partitions(matrix.sparkSession), *key).sortWithinPartitions(*key, "kind", "cid")
    return rows.mapInArrow(_open_blocks(percent), "a long, b long")


def _blocks() -> Column:
    """Blocks into which a group of classes is cut."""
    return F.greatest(F.ceil(F.count(F.lit(1)) / MEMBERS), F.ceil(F.sum("n") / TOKENS))


def _tiles() -> Column:
    """Blocks into which classes that have to be held against each other are cut.

    The greater a band, the greater they are, so that the rows in which each
    class asks each block grow with the power 1.5 of a band, not with its square."""
    return F.greatest(F.ceil(F.sqrt(F.count(F.lit(1)) / QUERIES)), F.ceil(F.sum("n") / TOKENS))


def _steps(n: Column | str) -> Column:
    """0 to n - 1, a row for each."""
    n = F.col(n) if isinstance(n, str) else n
    return F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1))


def _within_groups(met: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links inside the groups; each class is in the group of the class it meets first in most bands."""
    led = met.where("cid <> head.cid").where(_fits(F.col("n"), F.col("head.n"), percent)).groupBy("cid", "n", F.col("head.cid").alias("leader")).agg(F.count(F.lit(1)).alias("bands"))
    led = led.groupBy("cid", "n").agg(F.max(F.struct("bands", (-F.col("leader")).alias("least"))).alias("best")).select("cid", "n", (-F.col("best.least")).alias("leader"))
    led = save(led, "group-members")
    sizes = led.groupBy("leader").agg(_blocks().alias("blocks"))
    members = led.join(sizes, "leader").select("leader", F.pmod(F.xxhash64("cid"), "blocks").alias("block"), F.lit(BOTH).alias("kind"), "cid", F.col("cid").alias("comp")).join(sets, "cid")
    # a leader's tokens are dealt to its blocks in two steps, so that no task writes more than QUERIES of them
    leaders = sizes.join(sets.withColumnRenamed("cid", "leader"), "leader").select("*", _steps(F.ceil(F.col("blocks") / QUERIES)).alias("part"))
    leaders = leaders.repartition(partitions(met.sparkSession), "leader", "part")
    leaders = leaders.select("*", _steps(F.least(F.lit(QUERIES), F.col("blocks") - F.col("part") * QUERIES)).alias("nth"))
    leaders = leaders.select("leader", (F.col("part") * QUERIES + F.col("nth")).alias("block"), F.lit(STANDS).alias("kind"), F.col("leader").alias("cid"), F.col("leader").alias("comp"), "tokens")
    return _links(members.unionByName(leaders), ["leader", "block"], percent)


def _between_groups(met: DataFrame, sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Links in the bands in which several components meet."""
    named = met.select("band", "cid", "n").join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    per = named.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("tokens"))
    mixed = per.groupBy("band").agg(F.count(F.lit(1)).alias("comps"), ((F.sum("k") > QUERIES) | (F.sum("tokens") > TOKENS)).alias("large")).where("comps > 1")
    # a band is one block; a large one is cut into blocks of classes of like size, and a large component of it has blocks of its own
    named = named.join(mixed, "band").join(per.drop("tokens"), ["band", "comp"]).withColumn("of", F.when(F.col("large") & (F.col("k") > MEMBERS), F.col("comp")).otherwise(F.lit(-1)))
    tier = F.floor(F.log("n") / math.log(100 / percent)) if percent < 100 else F.col("n")
    named = named.withColumn("tier", F.when(F.col("large"), tier).otherwise(F.lit(-1)))
    cut = named.groupBy("band", "of", "tier").agg(_tiles().alias("blocks"))
    named = named.join(cut, ["band", "of", "tier"]).select("band", "of", "tier", F.pmod(F.xxhash64("cid"), "blocks").alias("block"), "cid", "n", "comp", "large")
    named = save(named, "blocks")
    key = ["band", "of", "tier", "block"]
    blocks = named.groupBy(*key).agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("comp").alias("c0"), F.max("comp").alias("c1"))
    # a block's members ask each other, unless all are of one component
    own = named.join(blocks.where("c0 <> c1"), key, "left_semi").select(*key, F.lit(0).cast("long").alias("turn"), F.lit(BOTH).alias("kind"), "cid", "comp")
    # and a class of a large band asks the blocks behind its own, unless all there are of its component or none is of fitting size
    place = F.struct("of", "tier", "block")
    asking = named.where("large").select("band", place.alias("own"), "cid", "n", "comp").join(blocks, "band").where(place > F.col("own"))
    asking = asking.where("NOT (c0 = comp AND c1 = comp)").where(F.expr(f"100 * high >= {percent} * n AND {percent} * low <= 100 * n"))
    asking = save(asking.select(*key, "cid", "comp"), "asking")
    turns = asking.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("turns"))
    inside = named.join(turns, key).select(*key, _steps("turns").alias("turn"), F.lit(STANDS).alias("kind"), "cid", "comp")
    queries = asking.join(turns, key).select(*key, F.pmod(F.xxhash64("cid"), "turns").alias("turn"), F.lit(ASKS).alias("kind"), "cid", "comp")
    behind = inside.unionByName(queries).withColumn("turn", F.col("turn") + 1)
    return _links(own.unionByName(behind).join(sets, "cid"), [*key, "turn"], percent)


def _fits(a: Column, b: Column, percent: int) -> Column:
    """Whether sets of these sizes may be similar."""
    return F.lit(100) * F.least(a, b) >= F.lit(percent) * F.greatest(a, b)


def _linked(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): row, doc_id, n_shingles, sig of every row; sig, cid, comp, first (the component's least doc_id) of every class."""
    spark = docs.sparkSession
    prepare(spark)
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    rows = save(texts.mapInArrow(_features(width, percent), "row long, doc_id long, n_shingles long, sig binary, bands array<long>"), "shingles")
    classes = rows.where("n_shingles > 0").groupBy("sig").agg(F.min("doc_id").alias("least"), F.min("row").alias("cid"), F.min("n_shingles").alias("n"), F.min("bands").alias("bands"))
    classes = save(classes, "classes")

    met = classes.select("cid", "n", F.explode("bands").alias("band"))
    heads = met.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("cid", "n")).alias("head")).where("size > 1")
    met = save(met.join(heads, "band").select("band", "cid", "n", "head"), "met")
    wanted = met.select(F.col("cid").alias("row")).distinct()
    sets = save(texts.join(wanted, "row").select(F.col("row").alias("cid"), "text").mapInArrow(_sets(width), "cid long, tokens binary"), "sets")

    links = save(_within_groups(met, sets, percent), "links-within")
    labels = components(links)
    more = save(_between_groups(met, sets, labels, percent), "links-between")
    if not more.isEmpty():
        labels = components(links.unionByName(more))
    named = classes.select("sig", "cid", "least", "n").join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    first = named.groupBy("comp").agg(F.min("least").alias("first"))
    return rows, named.join(first, "comp").select("sig", "cid", "comp", "first")


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    rows, classes = _linked(in_place(docs, "rows"), width, percent)
    out = rows.join(classes, "sig", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("first")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Of each component the row with the least doc_id, and every row without words; all columns.

    Of rows that repeat that doc_id the first in the scan stays; a component
    whose doc_ids are all null keeps its first row."""
    docs = in_place(docs, "rows")
    rows, classes = _linked(docs, width, percent)
    named = rows.where("n_shingles > 0").select("row", "doc_id", "sig").join(classes.select("sig", "comp"), "sig")
    heads = named.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("head")).select(F.col("head.row").alias("__row"))
    stay = heads.unionByName(rows.where("n_shingles = 0").select(F.col("row").alias("__row")))
    scanned = packed(docs).withColumn("__scan", F.monotonically_increasing_id())
    return unpacked(scanned.join(stay, F.col("__scan") == F.col("__row"), "left_semi"))
