"""Incremental audit and leaderboard on file-source streams.

Each run takes what is new since the last one (``availableNow``) and stops. What has been done is recorded by the stream's
own checkpoint, which must lie on storage all executors share; no list of finished keys is kept beside it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def incremental_audit(
    spark: SparkSession, source: str, schema: str, audit: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, files_per_batch: int | None = None
) -> None:
    """Audits the files that arrived since the last run and appends the rows. A replayed batch replaces its own output."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def write(batch: DataFrame, batch_id: int) -> None:
        audit(batch).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    query = reader.parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def incremental_leaderboard(
    spark: SparkSession, source: str, schema: str, keys: Sequence[str], score: str, top: int, sink: str, checkpoint: str, files_per_batch: int | None = None
) -> None:
    """Top rows over everything seen, one per key, by its highest score: each batch merges its own top rows with the previous board.

    The state is the board of ``top`` rows. A key that fell off it had ``top`` better ones and comes back only with a better score of its own.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    order = [F.col(score).desc(), *[F.col(k) for k in keys]]

    def best_of(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in keys]
        best = F.max_by(F.struct(*rest), F.struct(F.col(score), F.struct(*[c for c in rest if c != score] or [F.lit(0)])))
        return rows.groupBy(*keys).agg(best.alias("__b")).select(*keys, "__b.*").select(*rows.columns).orderBy(*order).limit(top)

    def write(batch: DataFrame, batch_id: int) -> None:
        best = best_of(batch)
        if batch_id > 0:
            best = best_of(best.unionByName(batch.sparkSession.read.parquet(f"{sink}/board={batch_id - 1}")))
        best.write.mode("overwrite").parquet(f"{sink}/board={batch_id}")

    reader.parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest_board(spark: SparkSession, sink: str) -> DataFrame:
    boards = spark.read.parquet(sink)
    return boards.where(F.col("board") == boards.agg(F.max("board")).scalar()).drop("board")
