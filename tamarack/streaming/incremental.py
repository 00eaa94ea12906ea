"""Scoring of arriving vectors with an existing model: stateless, exactly once per batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tamarack.operators.vectors import score_matrix


def score_stream(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, key: str, vec: str, weights: dict[str, Sequence[float]]) -> StreamingQuery:
    """Scores the Parquet files that arrive in ``source`` and appends them to ``sink``, each batch in its own
    subfolder, so that a batch that is run again overwrites itself. Stops when all there is has been read."""

    def write(batch: DataFrame, number: int) -> None:
        score_matrix(batch, key, vec, weights).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
