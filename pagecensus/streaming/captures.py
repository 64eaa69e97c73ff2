"""The stateless jobs on a stream of captures.

Identity, observation, measurement and evidence hold no state and add no shuffle, so the same
functions run on a streaming DataFrame.  Selection, counting and findings over documents stay batch
jobs; per micro-batch they can be run from ``foreachBatch``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from pagecensus import schemas
from pagecensus.operators.measurements import evidence, measurements
from pagecensus.plans.acquisition import observed_captures


def capture_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(schemas.CAPTURE).parquet(path)


def measurement_stream(captures: DataFrame) -> DataFrame:
    """Measurements of captures as they arrive, keyed by the identity of the requested URL."""
    return measurements(observed_captures(captures))


def evidence_stream(captures: DataFrame) -> DataFrame:
    return evidence(measurement_stream(captures))


def for_each_batch(
    stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str
) -> StreamingQuery:
    """Hands every micro-batch to ``sink`` once all available captures are taken."""
    return (
        stream.writeStream.foreachBatch(sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
