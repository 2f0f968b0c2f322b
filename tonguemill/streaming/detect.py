"""Detection on a stream. It is stateless, so it is the batch columns unchanged; counts
by language are a streaming aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.detect import detect
from ..operators.metrics import histogram
from ..operators.model import Model


def text_stream(spark: SparkSession, path: str) -> DataFrame:
    """Lines of files as they arrive in a folder."""
    return spark.readStream.text(path).withColumnRenamed("value", "text")


def detect_stream(stream: DataFrame, m: Model) -> DataFrame:
    return detect(stream, m)


def start_histogram(stream: DataFrame, m: Model, name: str, checkpoint: str) -> StreamingQuery:
    """Languages seen so far, in memory table ``name``."""
    out = histogram(detect_stream(stream, m))
    return out.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()


def start_sink(stream: DataFrame, m: Model, path: str, checkpoint: str) -> StreamingQuery:
    """Detections to Parquet, exactly once."""
    return detect_stream(stream, m).writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).start()
