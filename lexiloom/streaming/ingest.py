"""Pages that keep arriving: a file stream into a table of documents."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexiloom import schemas
from lexiloom.operators.extract import documents


def stream_corpus(spark: SparkSession, pages: str, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Parquet files of (path, html, ...) under `pages` become documents under `out`; each file is taken once. No state is kept: `latest` settles repeats on reading."""
    source = spark.readStream.schema(schemas.PAGE).parquet(pages)
    docs = documents(source).withColumn("loaded_at", F.current_timestamp())
    w = docs.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if once else w).start()
