"""Reading logged requests and responses, writing plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxledger.functions.text import u16len
from ctxledger.operators.profiles import protocol_of

REQUESTS = "request_id string, session_id string, ts timestamp, path string, body string"
RESPONSES = "response_id string, request_id string, ts timestamp, status int, content_type string, body string"


def with_model(requests: DataFrame) -> DataFrame:
    """``requests`` plus protocol and model (a string of 200 units at most, else '')."""
    model = F.get_json_object("body", "$.model")
    typed = F.col("body").rlike(r'"model"\s*:\s*"')
    ok = F.when(typed & (u16len(model) <= 200), model).otherwise("")
    return requests.withColumns({"protocol": protocol_of(F.col("path")), "model": F.coalesce(ok, F.lit(""))})


def read_requests(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Logged bodies, one JSON object a row; the raw text is kept, since measured text may not be re-serialised."""
    reader = spark.read.schema(REQUESTS) if fmt in ("json", "csv") else spark.read
    return with_model(reader.format(fmt).load(path))


def read_responses(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    reader = spark.read.schema(RESPONSES) if fmt in ("json", "csv") else spark.read
    return reader.format(fmt).load(path)


def write_plans(df: DataFrame, path: str, fmt: str = "parquet", by: str = "protocol", mode: str = "append") -> None:
    """Sink of plans, chunks, facts or ledger rows, partitioned where the column is there."""
    writer = df.write.mode(mode).format(fmt)
    (writer.partitionBy(by) if by in df.columns else writer).save(path)


def stream_events(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files: int = 100) -> DataFrame:
    """New files of ``path`` as a stream; ``files`` bounds a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(fmt).load(path)


def stream_outcomes(spark: SparkSession, requests: str, responses: str, fmt: str = "parquet", files: int = 100, **bounds) -> DataFrame:
    """Logged requests and responses under two paths as one stream of outcomes (streaming.streams.outcome_stream)."""
    from ctxledger.streaming.streams import outcome_stream

    return outcome_stream(stream_events(spark, requests, REQUESTS, fmt, files), stream_events(spark, responses, RESPONSES, fmt, files), **bounds)
