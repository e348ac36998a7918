"""Exact deduplication as a stateful stream, in DataFrame operations only.

What arrives is a landing table with a digest, the identifier and a locator of
the content (arrival, place in its scan) for every row.  A streaming aggregation
keeps, for each digest and for good, the number of rows and the greatest
(identifier, locator) in a disk-backed state store; the rows of one digest are
counted before they are shuffled.  A state that is kept in a folder meets later
arrivals: DedupState.add() takes one after another, each is read once, and what
it repeats of earlier ones is found.

Where a digest has come more than once its rows are hits, and their full bytes
are compared: the least and the greatest text of the digest must be one.  A
bitmap of the hits' digests, of at most BITMAP_BITS bits, lets only texts of
possible hits into that comparison, and each task leaves two texts of a digest
at most.  Should texts differ under one digest, those rows are grouped by their
text instead.  Digests that very many rows share are few; they meet their rows
by a broadcast instead of a shuffle.

Defined cases: a null text counts as empty; of rows with equal text the one with
the largest doc_id stays (a null doc_id is smaller than any other), and of rows
that repeat it too the one with the greatest locator; other columns are ignored
or, in keep_one(), kept; an empty table gives an empty result.  Rows that don't
come straight from files are written first, so that they have a place.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete_at_exit, in_place, new_path, packed, save, unpacked, whole_text

#: State in RocksDB, whose memory is bounded for each executor.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
#: Files of the landing table in one micro-batch.
FILES_AT_ONCE = 10_000
#: Bits of the bitmap of hits: so many for each hit, a power of two, between these; more hits only let more texts pass.
BITS_EACH, BITMAP_BITS = 16, (1 << 15, 1 << 27)
#: The share of all rows from which a group counts as large; so there are at most 1 / LARGE_SHARE of them.
LARGE_SHARE = 0.001

LANDING = "digest binary, doc_id long, arrival int, place long"
GROUPS = "digest binary, n long, keep struct<doc_id:long,arrival:int,place:long>, epoch long"


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def sha256_digest(text):
    return F.unhex(F.sha2(text, 256))


def _keyed(docs: DataFrame, arrival: int, digest) -> DataFrame:
    """Of every row its text, digest, doc_id and locator."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"), F.lit(arrival).alias("arrival"), F.monotonically_increasing_id().alias("place")).withColumn("digest", digest(F.col("text")))


class DedupState:
    """What has arrived so far, in a folder that all executors share.

    landing/ has a row for each row that arrived, groups/ what the stream made
    of each digest, stream/ the stream's checkpoint with its state.  With
    keep_texts the texts of an arrival stay in texts/, where later arrivals are
    compared with them; without it there can be one arrival only."""

    def __init__(self, spark: SparkSession, folder: str, *, keep_texts: bool = True, digest=sha256_digest):
        self.spark, self.folder, self.digest, self.keep_texts = spark, folder, digest, keep_texts
        self.docs: DataFrame | None = None

    def _has(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _landing(self) -> DataFrame:
        return self.spark.read.schema(LANDING).option("recursiveFileLookup", "true").parquet(f"{self.folder}/landing")

    def arrivals(self) -> int:
        n = 0
        while self._has(f"landing/{n}/_SUCCESS"):
            n += 1
        return n

    def add(self, docs: DataFrame) -> DedupState:
        """Take an arrival: write its rows, and let the stream run until it has caught up.

        An arrival that was cut off while it was written is written anew."""
        arrival = self.arrivals()
        if arrival and not self.keep_texts:
            raise ValueError("a state that keeps no texts takes one arrival")
        self.docs = in_place(docs, "dedup-rows")
        keyed = _keyed(self.docs, arrival, self.digest)
        if self.keep_texts:
            keyed.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.folder}/texts/{arrival}")
            keyed = self.spark.read.schema(keyed.schema).parquet(f"{self.folder}/texts/{arrival}")
        keyed.select("digest", "doc_id", "arrival", "place").write.mode("overwrite").parquet(f"{self.folder}/landing/{arrival}")
        rows = self.spark.readStream.schema(LANDING).option("maxFilesPerTrigger", FILES_AT_ONCE).parquet(f"{self.folder}/landing/*")
        held = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", "arrival", "place")).alias("keep"))

        def upsert(batch: DataFrame, epoch: int) -> None:
            batch.withColumn("epoch", F.lit(epoch).cast("long")).write.mode("overwrite").parquet(f"{self.folder}/groups/{epoch}")

        with _settings(self.spark, STATE):
            query = held.writeStream.outputMode("update").option("checkpointLocation", f"{self.folder}/stream").trigger(availableNow=True).foreachBatch(upsert).start()
            query.awaitTermination()
        return self

    def _groups(self) -> DataFrame:
        """Of each digest what its newest row holds, which is its whole history."""
        if not self._has("groups"):
            return self.spark.createDataFrame([], GROUPS).drop("epoch")
        rows = self.spark.read.schema(GROUPS).option("recursiveFileLookup", "true").parquet(f"{self.folder}/groups")
        return rows.groupBy("digest").agg(F.max("n").alias("n"), F.max("keep").alias("keep"))

    def _texts(self) -> DataFrame:
        if self.keep_texts:
            return self.spark.read.schema("doc_id long, text string, arrival int, place long, digest binary").option("recursiveFileLookup", "true").parquet(f"{self.folder}/texts")
        return _keyed(self.docs, 0, self.digest)

    def decisions(self) -> DataFrame:
        """For every row that arrived: digest, doc_id, arrival, place, keep_id, group_size, kept."""
        landing, groups = self._landing(), save(self._groups(), "dedup-groups")
        hits = groups.where("n > 1")
        sizes = groups.agg(F.sum("n").alias("rows"), F.sum((F.col("n") > 1).cast("long")).alias("hits")).first()
        differ, odd = None, sizes["hits"] and self._differing(hits, sizes["hits"])
        if odd:
            differ = odd.select("digest")
            groups = groups.join(differ, "digest", "left_anti")
        large = groups.where(F.col("n") > LARGE_SHARE * (sizes["rows"] or 0))
        small = groups.where(F.col("n") <= LARGE_SHARE * (sizes["rows"] or 0))
        # rows of large groups don't go to one place
        rest = landing.join(F.broadcast(large.select("digest")), "digest", "left_anti")
        out = _decided(rest.join(small, "digest")).unionByName(_decided(landing.join(F.broadcast(large), "digest")))
        if not odd:
            return out
        texts = self._texts().join(differ, "digest", "left_semi")
        by_text = texts.groupBy("digest", "text").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", "arrival", "place")).alias("keep"))
        return out.unionByName(_decided(texts.join(by_text, ["digest", "text"])))

    def _differing(self, hits: DataFrame, n: int) -> DataFrame | None:
        """Digests that stand for several texts, if there are any."""
        bits = min(max(1 << (BITS_EACH * n - 1).bit_length(), BITMAP_BITS[0]), BITMAP_BITS[1])
        place = F.pmod(F.xxhash64("digest"), F.lit(bits))
        spot = F.floor(place / 32768).cast("int")
        bitmap = hits.select(spot.alias("spot"), F.pmod(place, F.lit(32768)).alias("bit")).groupBy("spot").agg(F.bitmap_construct_agg("bit").alias("bits"))
        asked = self._texts().select("digest", "text", spot.alias("spot"), F.pmod(place, F.lit(32768)).cast("int").alias("bit"))
        byte = F.expr("CAST(conv(hex(substring(bits, bit DIV 8 + 1, 1)), 16, 10) AS INT)")
        possible = asked.join(F.broadcast(bitmap), "spot").where(byte.bitwiseAND(F.expr("shiftleft(1, bit % 8)")) != 0)
        ends = possible.groupBy("digest").agg(F.min("text").alias("a"), F.max("text").alias("b"))
        differ = save(ends.where("a <> b").select("digest"), "dedup-differ")
        return None if differ.isEmpty() else differ


def _decided(rows: DataFrame) -> DataFrame:
    mine = F.struct(F.col("arrival"), F.col("place"))
    return rows.select("digest", "doc_id", "arrival", "place", F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (mine == F.struct(F.col("keep.arrival").alias("arrival"), F.col("keep.place").alias("place"))).alias("kept"))


def _once(docs: DataFrame, digest=sha256_digest) -> DedupState:
    """The state after a single arrival."""
    spark = docs.sparkSession
    folder = new_path(spark, "dedup")
    state = DedupState(spark, folder, keep_texts=False, digest=digest).add(docs)
    delete_at_exit(spark, folder)
    return state


def dedup_report(docs: DataFrame, state: DedupState | None = None) -> DataFrame:
    """For every row: doc_id, keep_id, group_size, kept, text_sha256.

    A state that is given takes docs as its next arrival, and the rows of all its arrivals are reported."""
    rows = (state.add(docs) if state is not None else _once(docs)).decisions()
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns."""
    state = _once(docs)
    kept = state.decisions().where("kept").select(F.col("place").alias("__keep"))
    scanned = packed(state.docs).withColumn("__locator", F.monotonically_increasing_id())
    return unpacked(scanned.join(kept, F.col("__locator") == F.col("__keep"), "left_semi"))
