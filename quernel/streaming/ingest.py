"""Structured Streaming: documents of a stream go into an engine's index batch by batch, and running term counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quernel.engine import SearchEngine
from quernel.functions.analysis import AnalyzerConfig, tokens


def ingest(stream: DataFrame, engine: SearchEngine, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Upserts (doc_id, fields) rows. A batch that runs again replaces what it wrote, so each counts once; ids must be given."""

    def batch(df: DataFrame, _: int) -> None:
        engine.index_documents(df.select("doc_id", "fields"))

    writer = stream.where("doc_id IS NOT NULL").writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed_terms(stream: DataFrame, time: str = "ts", text: str = "text", window: str = "5 minutes", late: str = "10 minutes", config: AnalyzerConfig = AnalyzerConfig()) -> DataFrame:
    """window start, term, n: occurrences of terms in tumbling windows; rows later than the watermark are left out."""
    t = stream.withWatermark(time, late).select(time, F.explode(tokens(text, config)).alias("term"))
    return t.groupBy(F.window(time, window).alias("w"), "term").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "term", "n")
