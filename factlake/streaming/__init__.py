"""The jobs on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from factlake.operators.retrieval import KnowledgeIndex
from factlake.plans.screen import ScreenOptions, screen
from factlake.plans.verify import verify_answers
from factlake.session import drop_folder, temporary_tables
from factlake.sources import feedback_rows


def screen_stream(
    prompts: DataFrame, path: str, vault_path: str, checkpoint: str, options: ScreenOptions = ScreenOptions()
) -> StreamingQuery:
    """Screen a stream of prompts; results and vault go to their own tables.

    Screening has no state, so the stream runs the batch expressions as they are.  Each
    micro-batch is screened once for both tables and replaces its own output if it is
    run again.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        done = batch.persist()
        done.drop("pii_mapping").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        done.where("size(pii_mapping) > 0").select("prompt_id", "pii_mapping").write.mode(
            "overwrite"
        ).parquet(f"{vault_path}/batch={batch_id}")
        done.unpersist()

    return _started(screen(prompts, options), write, checkpoint)


def verify_stream(answers: DataFrame, index: KnowledgeIndex, path: str, checkpoint: str) -> StreamingQuery:
    """Verify each micro-batch of answers as a batch; one report row per answer.

    What a micro-batch leaves in the shared folder is dropped when its reports are written.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        with temporary_tables(batch.sparkSession):
            reports = verify_answers(batch, index).reports
            reports.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return _started(answers, write, checkpoint)


def feedback_stream(
    corrections: DataFrame,
    path: str,
    checkpoint: str,
    sent_at: str | None = None,
    late: str = "1 hour",
) -> StreamingQuery:
    """Append a stream of corrections to the feedback table.

    With a ``sent_at`` column a correction that is sent again (same content, same time) within
    ``late`` is appended once; the state holds the keys of that time only. Without it the table
    gets every row that arrives.
    """
    rows = feedback_rows(corrections, sent_at)
    if sent_at is not None:
        rows = rows.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["id"])
    return (
        rows.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def feedback_totals_stream(corrections: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Running totals per correction pair; the state has one row per pair of verdicts.

    Every batch writes a folder of its own, so readers always find whole totals and a batch
    that is repeated after a failure replaces itself only; see ``read_totals``. Only the last
    two folders are kept.
    """

    def write(totals: DataFrame, batch_id: int) -> None:
        totals.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        # The one before stays, for readers that have just found it.
        drop_folder(totals.sparkSession, f"{path}/batch_id={batch_id - 2}")

    pairs = corrections.groupBy("predicted_verdict", "correct_verdict").count()
    return (
        pairs.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .outputMode("complete")
        .trigger(availableNow=True)
        .start()
    )


def read_totals(spark: SparkSession, path: str) -> DataFrame:
    """The newest totals that ``feedback_totals_stream`` has written to ``path``."""
    batches = spark.read.parquet(path)
    newest = batches.agg(F.max("batch_id")).scalar()
    return batches.where(F.col("batch_id") == newest).drop("batch_id")


def _started(df: DataFrame, write, checkpoint: str) -> StreamingQuery:
    return (
        df.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
