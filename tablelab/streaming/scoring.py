"""Batch scoring kept up to date as new files or messages arrive."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tablelab.models import score
from tablelab.models.text_linear import TextLinearModel


def score_stream(
    model: PipelineModel | TextLinearModel, rows: DataFrame, schema: T.StructType, out: str, checkpoint: str,
    once: bool = False,
) -> StreamingQuery:
    """Score a streaming frame with a saved model and append the result as Parquet.

    Scoring is stateless, so there is no watermark; the checkpoint makes the output exactly-once.
    ``once`` handles what has arrived so far and stops. A model whose coefficients are a table is joined to
    one batch after another; a batch that is repeated after a failure replaces its own folder.
    """
    if isinstance(model, TextLinearModel):
        def batch(arrived: DataFrame, number: int) -> None:
            score(model, arrived, schema).write.mode("overwrite").parquet(f"{out}/batch={number}")

        writer = rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    else:
        writer = (
            score(model, rows, schema).writeStream.format("parquet")
            .option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
        )
    return (writer.trigger(availableNow=True) if once else writer).start()
