"""Running a stream over what has arrived, and reading what it wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def drain_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process all that is there, append it to a Parquet table, and stop."""
    (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def drain_batches(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Process all that is there through ``handle(batch, number)``, and stop.

    A batch may be handed over again after a failure, under the same number. What a batch shuffled goes with each
    of its queries; else the files of all batches would stay on disk until the driver collects its garbage.
    """

    def run(batch: DataFrame, number: int) -> None:
        batch.sparkSession.conf.set(CLEAN_SHUFFLES, "true")  # a session of the stream's own
        handle(batch, number)

    (
        stream.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
