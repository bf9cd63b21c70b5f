"""Exact dedup as a stateful stream: disk-backed keyed state without expiry, and a byte check on each hit.

`digest_log` writes, for each row, the digest of its normalised text, its identifier and the locator of its content.
A streaming aggregation reads the log in micro-batches and keeps in RocksDB, for each digest and for good (there is no
watermark), the identifier and locator of the row to keep and the number of rows seen. Updates go to a table by batch;
a batch that is run again replaces its own part. At the end, the full texts of all digests hit twice are compared;
texts that differ in spite of one digest are grouped by their bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .storage import Workspace

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A stream keeps the number of its state stores for good, so it follows the number of rows, not the session's
#: shuffle partitions; each store has some MB of files of its own, however few its keys.
_STATES, ROWS_PER_STATE = "spark.sql.streaming.internal.stateStore.partitions", 1_000_000
#: A digest filter of at most so many words (16 MiB) is broadcast; a fuller one lets more rows through, loses none.
_FILTER_WORDS = 1 << 20
#: Places of rows to drop, 24 bytes each, are broadcast up to so many; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def normalised(text: str) -> F.Column:
    """Lower-cases A-Z only; null is empty."""
    return F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER)


PLACE = ("_metadata.file_path AS file", "_metadata.row_index AS row")


def in_files(docs: DataFrame, work: Workspace) -> DataFrame:
    """`docs` itself if its rows have places in files, else a table of them."""
    try:
        docs.selectExpr(*PLACE)
        return docs
    except AnalysisException:
        return work.save(docs, "source")


def located(docs: DataFrame, id_col: str, text_col: str, work: Workspace) -> DataFrame:
    """id, file, row, text. Files name the content's place; tables that are no files are written first."""
    own = [F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")]
    return in_files(docs, work).select(*own, *map(F.expr, PLACE))


def _digest(bits: int) -> F.Column:
    whole = F.unhex(F.sha2("content", 256))
    return whole if bits == 256 else F.substring(whole, 1, max(1, bits // 8))


def stream_state(spark: SparkSession, log: DataFrame, log_path: str, work: Workspace, bytes_per_batch: int) -> DataFrame:
    """Runs the stream over the whole log: digest, keep (id, file, row), n: the last update of each digest."""
    wanted = {_PROVIDER: _ROCKSDB, _STATES: str(max(8, -(-log.count() // ROWS_PER_STATE)))}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    updates = work.path("updates")
    try:
        state = (
            spark.readStream.schema(log.schema)
            .option("maxBytesPerTrigger", str(bytes_per_batch))
            .parquet(log_path)
            .groupBy("digest")
            .agg(F.max_by(F.struct("id", "file", "row"), F.struct(F.col("id").isNotNull(), "id", "file", "row")).alias("keep"), F.count(F.lit(1)).alias("n"))
        )
        query = (
            state.writeStream.outputMode("update")
            .option("checkpointLocation", work.path("stream"))
            .trigger(availableNow=True)
            .foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{updates}/batch={number}"))
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    written = spark.read.schema(state.schema.add("batch", "long")).parquet(updates)
    return written.groupBy("digest").agg(F.max_by(F.struct("keep", "n"), "batch").alias("last")).select("digest", "last.*")


def dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bits: int = 256, bytes_per_batch: int = 256 << 30, batch_files: int = 0) -> DataFrame:
    """Groups rows whose texts are identical after lower-casing A-Z; of a group the row with the largest id stays.

    Returns one row for each row of `docs`: id, file, row (its place), keep_id, group_size, kept, text_sha256. A null
    text counts as empty; a null id is less than all others; of rows with one id and one text, the last by file and
    row stays. An empty table gives an empty result. Other columns are not read. `digest_bits` less than 256 shortens
    the state's key; results stay the same, as bytes decide.
    """
    work = Workspace(spark, "exact-dedup")
    rows = located(docs, id_col, text_col, work).select("id", "file", "row", normalised("text").alias("content"))
    hashed = rows.select("id", "file", "row", _digest(digest_bits).alias("digest"), F.sha2("content", 256).alias("text_sha256") if digest_bits < 256 else F.lit(None).cast("string").alias("text_sha256"))
    if batch_files:
        hashed = hashed.repartition(batch_files)
    log = work.save(hashed, "log")
    if log.isEmpty():
        return log.select("id", "file", "row", F.col("id").alias("keep_id"), F.lit(0).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    state = work.save(stream_state(spark, log, work.path("log"), work, bytes_per_batch), "state")
    work.drop("updates", "stream")

    # Byte check of all hits. The filter's size is fixed; what it lets through by chance meets the state in the join.
    word = F.expr(f"shiftright(xxhash64(digest), 6) & {_FILTER_WORDS - 1}L")
    bit = F.expr("shiftleft(1L, cast(xxhash64(digest) & 63 as int))")
    twice = state.where("n > 1").select("digest")
    bitmap = twice.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    maybe = rows.withColumn("digest", _digest(digest_bits)).withColumn("word", word).join(F.broadcast(bitmap), "word").where(F.col("bits").bitwiseAND(bit) != 0)
    bounds = maybe.groupBy("digest").agg(F.min("content").alias("a"), F.max("content").alias("b"))
    mixed = work.save(bounds.join(twice, "digest", "left_semi").where("a <> b").select("digest"), "mixed")
    sha = F.hex("digest") if digest_bits == 256 else F.col("text_sha256")
    flat = log.join(state, "digest")
    if not mixed.isEmpty():
        flat = flat.join(mixed, "digest", "left_anti")
    same = (F.col("keep.file") == F.col("file")) & (F.col("keep.row") == F.col("row"))
    result = flat.select("id", "file", "row", F.col("keep.id").alias("keep_id"), F.col("n").alias("group_size"), same.alias("kept"), F.lower(sha).alias("text_sha256"))
    if not mixed.isEmpty():
        apart = rows.withColumn("digest", _digest(digest_bits)).join(mixed, "digest", "left_semi")
        best = apart.groupBy("content").agg(F.max_by(F.struct("id", "file", "row"), F.struct(F.col("id").isNotNull(), "id", "file", "row")).alias("keep"), F.count(F.lit(1)).alias("n"))
        result = result.unionByName(apart.join(best, "content").select("id", "file", "row", F.col("keep.id").alias("keep_id"), F.col("n").alias("group_size"), same.alias("kept"), F.sha2("content", 256).alias("text_sha256")))
    return result


def drop_copies(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with the rows only that stay, see `dedup`. Places to drop are broadcast up to BROADCAST_ROWS of them."""
    work = Workspace(spark, "drop-copies")
    docs = in_files(docs, work)
    place = F.struct(F.xxhash64("file"), F.xxhash64("file", "row"), F.col("row"))
    gone = work.save(dedup(spark, docs, id_col, text_col).where("not kept").select(place.alias("place")), "gone")
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), *map(F.expr, PLACE)).select("doc", place.alias("place"))
    return whole.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, "place", "left_anti").select("doc.*")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = dedup(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


OP3_SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents
), g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.body) AS text_sha256
FROM t JOIN g USING (body)
"""
