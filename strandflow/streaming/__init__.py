"""Structured Streaming forms of the sequence operators, and event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.segment import contiguous
from ..operators.tokenize import KmerTokenizer
from ..sources.fasta import stream_fasta


def tokenize_stream(records: DataFrame, tokenizer: KmerTokenizer | None = None, min_length: int = 0, max_length: int = 512) -> DataFrame:
    """Streamed records to segments and token rows; stateless, so it runs on any trigger."""
    t = tokenizer or KmerTokenizer()
    cut = contiguous(records.withColumn("sequence_id", F.col("fasta_id")), min_length, max_length)
    return cut.select(F.col("sequence_id").alias("fasta_id"), "segment_start", "segment_end", F.posexplode(t.encode_all("segment")).alias("offset", "ids"))


def fasta_to_tokens(spark: SparkSession, source: str, target: str, checkpoint: str, tokenizer: KmerTokenizer | None = None):
    """Tokenize all files now in a folder, exactly once over restarts, into Parquet; returns the running query."""
    return tokenize_stream(stream_fasta(spark, source), tokenizer).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, kind: str = "tumbling", size: str = "1 hour", slide: str | None = None, gap: str = "10 minutes", late: str = "10 minutes", keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Counts and sums of ``value`` by event-time window (tumbling, sliding or session), with a watermark for late rows."""
    ts = F.col("ts").cast("timestamp")
    rows = events.withColumn("ts", ts).withWatermark("ts", late)
    window = {"tumbling": lambda: F.window("ts", size), "sliding": lambda: F.window("ts", size, slide or size), "session": lambda: F.session_window("ts", gap)}[kind]()
    out = rows.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", "total")
