"""Reading the input tables and writing the results."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from factlake import schemas
from factlake.functions import fixed_values as fv
from factlake.operators.validation import split, validate_eval_cases
from factlake.plans.benchmark import Benchmark


class EvalDataset(NamedTuple):
    """``cases`` and ``rejected`` together hold every case of a dataset once.

    ``rejected`` has the case as it was read (``raw``) and its ``problems``.
    """

    cases: DataFrame
    rejected: DataFrame


_UNREADABLE = "case is not readable"


def _sorted_out(raw: DataFrame) -> EvalDataset:
    """From ``raw`` texts of cases, with the columns beside them."""
    beside = [c for c in raw.columns if c != "raw"]
    schema = f"{schemas.EVAL_CASE[:-1]}, _corrupt: STRING>"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    read = raw.withColumn("c", F.from_json("raw", schema, options))
    fields = read.select(*beside, "raw", F.col("c.id").alias("case_id"), "c.*").drop("id")
    readable = F.col("_corrupt").isNull() & F.col("case_id").isNotNull()
    checked = validate_eval_cases(fields).withColumn(
        "problems", F.when(readable, F.col("problems")).otherwise(F.array(F.lit(_UNREADABLE)))
    )
    valid, rejected = split(checked)
    return EvalDataset(
        valid.drop("raw", "_corrupt"), rejected.select(*beside, "case_id", "raw", "problems")
    )


def read_eval_dataset(spark: SparkSession, path: str) -> EvalDataset:
    """A labelled dataset as one JSON document, with the dataset's name and version.

    The cases are read as texts first, so that a case of another shape is rejected alone. A
    document is one row, so one task goes through a file; a large dataset is better kept as
    lines, see :func:`read_eval_lines`. A missing file is an error.
    """
    shape = "name STRING, version STRING, description STRING, cases ARRAY<STRING>"
    data = spark.read.schema(shape).option("multiLine", True).option("mode", "FAILFAST").json(path)
    names = [F.col("name").alias("dataset_name"), F.col("version").alias("dataset_version")]
    raw = data.select(*names, F.explode("cases").alias("raw"))
    # Dealt out again: the task that went through the file shouldn't read all cases, too.
    return _sorted_out(raw.repartition(spark.sparkContext.defaultParallelism))


def read_eval_lines(spark: SparkSession, path: str) -> EvalDataset:
    """A labelled dataset with one case per line, in any number of files and splits.

    Lines that aren't JSON or of another shape are rejected alone.
    """
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    return _sorted_out(lines.select(F.col("value").alias("raw")))


def write_eval_lines(cases: DataFrame, path: str) -> None:
    """Cases, one per line, as :func:`read_eval_lines` reads them."""
    rest = [c for c in cases.columns if c not in ("case_id", "dataset_name", "dataset_version")]
    line = F.to_json(F.struct(F.col("case_id").alias("id"), *rest))
    cases.select(line.alias("value")).write.mode("overwrite").text(path)


def read_eval_cases(spark: SparkSession, path: str) -> DataFrame:
    """The accepted cases of :func:`read_eval_dataset`."""
    return read_eval_dataset(spark, path).cases


def read_table(spark: SparkSession, path: str, schema: str, file_format: str = "parquet") -> DataFrame:
    """A table of declared schema: answers, prompts, predictions, knowledge base, feedback."""
    return spark.read.schema(schema).format(file_format).load(path)


def read_knowledge_base(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    return read_table(spark, path, schemas.KNOWLEDGE, file_format)


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.FEEDBACK)


_CORRECTION = ["request_id", "claim_index", "predicted_verdict", "correct_verdict", "comment"]


def feedback_rows(df: DataFrame, sent_at: str | None = None) -> DataFrame:
    """Corrections with a key and a UTC time stamp.

    The key follows from what was sent (and when, if there is a ``sent_at`` column), so that a
    job that is run again gives a correction the same key.
    """
    when = F.current_timestamp() if sent_at is None else F.col(sent_at).cast("timestamp")
    comment = F.coalesce("comment", F.lit("")).alias("comment")
    rows = df.select(*_CORRECTION[:-1], comment, when.alias("created_at"))
    sent = _CORRECTION if sent_at is None else [*_CORRECTION, "created_at"]
    # As JSON a null differs from a text and no value can run into the next one.
    key = F.sha2(F.to_json(F.struct(*sent), {"ignoreNullFields": "false"}), 256)
    return rows.select(key.alias("id"), *rows.columns)


def append_feedback(df: DataFrame, path: str, sent_at: str | None = None) -> None:
    feedback_rows(df, sent_at).write.mode("append").parquet(path)


def write_json_report(summary: DataFrame, path: str, dataset_name: str, dataset_version: str) -> None:
    """The one-row summary as a JSON document."""
    document = F.struct(
        F.lit(dataset_name).alias("dataset_name"),
        F.lit(dataset_version).alias("dataset_version"),
        F.struct(*summary.columns).alias("aggregate_results"),
        _now().alias("generated_at"),
    )
    summary.select(F.to_json(document).alias("value")).write.mode("overwrite").text(path)


def _now() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def write_evaluation(run: Benchmark, path: str, dataset_name: str, dataset_version: str) -> None:
    """The whole evaluation as one JSON document: summary, every case's results, advice.

    The document is the lines of the part files in the order of their names; each case is a
    line of its own. It is sorted and written in parts, so no task holds more than its share
    of the cases; ``read_evaluation`` reads the cases back.
    """
    scores = [c for c in run.summary.columns if c != "recommendations"]
    head = F.struct(F.lit(dataset_name).alias("dataset_name"), F.lit(dataset_version).alias("dataset_version"))
    tail = F.struct(_now().alias("generated_at"), F.lit(fv.RUNNER_VERSION).alias("runner_version"))
    inside = F.struct("recommendations")

    def opened(json: Column) -> Column:
        return F.regexp_replace(json, r"\}$", "")

    def continued(json: Column) -> Column:
        return F.regexp_replace(json, r"^\{", ",")

    summary = run.summary.select(
        F.concat(
            opened(F.to_json(head)),
            F.lit(',"aggregate_results":'),
            opened(F.to_json(F.struct(*scores))),
            F.lit(',"case_results":['),
        ).alias("first"),
        F.concat(
            F.lit("]"), continued(F.to_json(inside)), continued(F.to_json(tail))
        ).alias("last"),
    )
    ends = F.explode(
        F.array(
            F.struct(F.lit(0).alias("part"), F.col("first").alias("value")),
            F.struct(F.lit(2).alias("part"), F.col("last").alias("value")),
        )
    )
    frame = summary.select(ends.alias("e")).select("e.part", F.lit("").alias("case_id"), "e.value")
    least = run.results.agg(F.min("case_id")).scalar()
    comma = F.when(F.col("case_id") == least, "").otherwise(",")
    line = F.concat(comma, F.to_json(F.struct(*run.results.columns), {"ignoreNullFields": "false"}))
    cases = run.results.select(F.lit(1).alias("part"), "case_id", line.alias("value"))
    ordered = frame.unionByName(cases).orderBy("part", "case_id").select("value")
    ordered.write.mode("overwrite").text(path)


def read_evaluation(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The cases of a document that ``write_evaluation`` has written, in a declared schema."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "^,", "").alias("value"))
    cases = lines.where(F.startswith("value", F.lit('{"case_id"')))
    return cases.select(F.from_json("value", schema).alias("c")).select("c.*")
