"""Structured Streaming: files into versioned tables, and event-time windows with watermarks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.functions import text as T
from quern.operators import documents as D
from quern.operators import text_index
from quern.operators.lineage import cut
from quern.sources import keyed
from quern.sources.files import parse

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def file_stream(spark: SparkSession, path: str, pattern: str = "*", per_batch: int = 100, archive: str | None = None) -> DataFrame:
    """New files of a folder; with archive, files move there once a batch with them is done."""
    reader = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_batch)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.load(path)


def store_documents(target: str, index: bool = False) -> Callable[[DataFrame, int], None]:
    """A batch function: parse, clean and chunk files, and upsert documents and chunks by path and content.

    A batch is parsed once, into a checkpointed table. A document that is seen again replaces all its chunks; files without
    text go to a dead-letter table with the reason, and leave it when they come back with text. The same files in any number
    of batches, or a batch that runs twice, leave the same tables. A batch rewrites the buckets of its own keys. With index, a batch's documents become a segment of a
    search index under its number.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        hashes = batch.select("path", F.sha2("content", 256).alias("version"), "modificationTime")
        parsed = cut(parse(batch).join(hashes, "path"))
        said = F.coalesce(F.col("text").rlike(r"\S"), F.lit(False))
        good, bad = parsed.where(said), parsed.where(~said)
        docs = good.select(F.sha2("path", 256).alias("doc_id"), "path", "format", "version", F.col("modificationTime").alias("seen_at"), T.clean_lines("text").alias("text"))
        keyed.merge_into(docs, f"{target}/documents", ["doc_id"])
        chunks = docs.select("doc_id", F.posexplode(D.sentence_window(T.sentences("text"), least=1)).alias("chunk", "text"))
        keyed.replace_in(chunks.select("doc_id", F.col("chunk").cast("long").alias("chunk"), "text"), f"{target}/chunks", docs.select("doc_id"), ["doc_id"])
        keyed.replace_in(bad.select("path", F.coalesce("error", F.lit("no text")).alias("error")), f"{target}/dead_letters", parsed.select("path"), ["path"])
        if index:
            text_index.write_segment(docs.select("doc_id", "text"), f"{target}/index", batch_id)
        for table in ("documents", "chunks", "dead_letters"):
            keyed.expire(spark, f"{target}/{table}")

    return run


def start_documents(spark: SparkSession, source: str, target: str, checkpoint: str, seconds: int | None = None, index: bool = False, **options) -> StreamingQuery:
    """The document job: every `seconds`, or once over what is there."""
    writer = file_stream(spark, source, **options).writeStream.foreachBatch(store_documents(target, index)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)).start()


def timed(events: DataFrame, time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Events with a watermark; times without zone count as UTC."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def windowed_counts(events: DataFrame, width: str = "5 minutes", step: str | None = None, late: str = "10 minutes") -> DataFrame:
    w = F.window("ts", width, step) if step else F.window("ts", width)
    return timed(events, late=late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return timed(events, late=late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))


def unique_events(events: DataFrame, key: str = "event_id", late: str = "10 minutes") -> DataFrame:
    return timed(events, late=late).dropDuplicatesWithinWatermark([key])
