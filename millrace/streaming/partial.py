"""Models that learn from a stream: each micro-batch goes through partial_fit, and the state is a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from millrace.learn.base import Estimator


def fit_stream(model: Estimator, stream: DataFrame, update: Callable[[Estimator, DataFrame], object], path: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that calls update(model, batch) for each non-empty micro-batch in turn and saves the model to
    `path` with the batch's number, so that a batch that is replayed after a failure is not counted twice.

    `checkpoint` and `path` are folders that driver and executors share. After a restart the model is the saved one.
    """
    spark = stream.sparkSession
    jpath = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/last")
    if jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        held = type(model).load(spark, f"{path}/last")
        model.params, model.state = held.params, held.state

    def step(batch: DataFrame, number: int) -> None:
        if number <= model.state.get("batch", -1) or batch.isEmpty():
            return
        update(model, batch)
        model.state["batch"] = number
        model.save(batch.sparkSession, f"{path}/last")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
