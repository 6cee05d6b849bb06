"""Batches: per-row work with captured errors, and what is reported about the outcomes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.accumulators import Accumulator, AccumulatorParam
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.texts import counted, summary

#: Committed outcomes of a ledger are visible task by task.
BY_TASK = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}
OUTCOME = "idx long, input string, output string, detail string, failure string, error_code string"


class JobError(Exception):
    """A failure with a code, to be reported for its row."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(message)
        self.code = code


def run_jobs(df: DataFrame, job: Callable[[dict], tuple[str | None, str | None]], width: int | None = None, path: str = "path", step: Accumulator | None = None) -> DataFrame:
    """One outcome for each row of df (idx, path, ...): job(row) gives (output, detail) or raises.

    A row's exception becomes its failure; the batch goes on. `width` is the number of partitions that the
    rows are spread over, many more than there are cores, so that slow rows do not hold up others. An empty
    batch has no outcomes; rows with the same path are jobs of their own. `step` (of a Progress) counts the rows.
    """
    if width is not None and width < 1:
        raise ValueError("width must be at least 1")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                try:
                    output, detail = job(row)
                    out.append((row["idx"], row[path], output, detail, None, None))
                except JobError as e:
                    out.append((row["idx"], row[path], None, None, str(e), e.code))
                except Exception as e:  # whatever a job raises is that row's failure
                    out.append((row["idx"], row[path], None, None, str(e), "unexpected"))
            if step is not None:
                step.add({(task.partitionId(), task.taskAttemptId()): len(out)})
            yield pd.DataFrame(out, columns=["idx", "input", "output", "detail", "failure", "error_code"])

    return (df.repartition(width) if width else df).mapInPandas(run, OUTCOME)


class _ByAttempt(AccumulatorParam):
    """Rows by partition and attempt; what comes in adds up for each."""

    def zero(self, value: dict) -> dict:
        return {}

    def addInPlace(self, value: dict, more: dict) -> dict:  # noqa: N802  Spark's name
        for key, n in more.items():
            value[key] = value.get(key, 0) + n
        return value


class Progress:
    """How many rows of a running batch are done, for whoever watches it on the driver; pass `step` to run_jobs.

    Counts come in as tasks end, by partition and attempt, and each partition counts with the attempt that got
    furthest. So a task that has to run again, a duplicate of a slow task, and a second action over the same outcomes
    add nothing. The driver holds a number for each task. Use one Progress for each batch.
    """

    def __init__(self, spark: SparkSession, total: int) -> None:
        self.total, self._count = total, spark.sparkContext.accumulator({}, _ByAttempt())

    @property
    def step(self) -> Accumulator:
        return self._count

    @property
    def done(self) -> int:
        furthest: dict[int, int] = {}
        for (partition, _), n in self._count.value.items():
            furthest[partition] = max(n, furthest.get(partition, 0))
        return sum(furthest.values())


def ledger(spark: SparkSession, folder: str) -> DataFrame | None:
    """All outcomes that were ever recorded in a ledger, with their attempts; None where there are none yet."""
    try:
        return spark.read.schema(f"{OUTCOME}, attempt int").parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def run_recorded(df: DataFrame, job: Callable[[dict], tuple[str | None, str | None]], folder: str, width: int | None = None, path: str = "path", step: Accumulator | None = None) -> DataFrame:
    """Runs the rows of df that have not succeeded yet, records their outcomes in the ledger `folder`, and returns the last outcome of each row.

    A row is known by (idx, path); rows equal in both share an outcome. Rows get a column `attempt`, the number of
    the run, counted from 1. The ledger only ever grows, and each task's outcomes are in it as soon as the task has
    ended: if a run is broken off, the next one starts with the rows that no ended task has done. Failed rows run
    again each time. Driver and executors must reach the folder by its name; one run at a time.
    """
    spark = df.sparkSession
    before = ledger(spark, folder)
    runs, todo = 1, df
    if before is not None:
        runs += before.agg(F.max("attempt")).first()[0] or 0
        finished = before.where(succeeded(F.col("failure"))).select(F.col("idx").alias("_idx"), F.col("input").alias("_input")).distinct()
        todo = df.join(finished, df["idx"].eqNullSafe(F.col("_idx")) & df[path].eqNullSafe(F.col("_input")), "left_anti")
    todo = todo.withColumn("attempt", F.lit(runs))
    run_jobs(todo, job, width, path, step).withColumn("attempt", F.lit(runs)).write.mode("append").options(**BY_TASK).parquet(folder)
    return last_outcomes(ledger(spark, folder))


def last_outcomes(recorded: DataFrame) -> DataFrame:
    """The success of each row if it has one, else its last failure, with the number of its `attempt` and of its `runs`."""
    row = F.struct("output", "detail", "failure", "error_code", "attempt")
    last = recorded.groupBy("idx", "input").agg(F.max_by(row, F.struct(succeeded(F.col("failure")), "attempt")).alias("row"), F.count_distinct("attempt").alias("runs"))
    return last.select("idx", "input", "row.*", "runs")


def succeeded(failure: Column) -> Column:
    return failure.isNull()


def in_order(outcomes: DataFrame) -> DataFrame:
    """Outcomes in the order of the inputs."""
    return outcomes.orderBy("idx")


def retry_queue(outcomes: DataFrame) -> DataFrame:
    """Inputs of the failed rows."""
    return outcomes.where(~succeeded(F.col("failure"))).select("idx", F.col("input").alias("path"))


def batch_summary(outcomes: DataFrame, *by: str, failure: str = "failure") -> DataFrame:
    """Numbers of done and failed rows, the share that is done, and the line that says so; for each group, if `by` is given."""
    ok = succeeded(F.col(failure))
    found = outcomes.groupBy(*by).agg(F.count_if(ok).alias("n_done"), F.count_if(~ok).alias("n_failed"))
    share = F.when(F.col("n_done") + F.col("n_failed") > 0, F.col("n_done") / (F.col("n_done") + F.col("n_failed"))).otherwise(0.0)
    return found.select(*by, "n_done", "n_failed", share.alias("done_fraction"), summary(F.col("n_done"), F.col("n_failed")).alias("summary"))


def queue_label(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(counted(F.count("*"), "file").alias("label"))


def locked_count(df: DataFrame, locked: Column, *by: str) -> DataFrame:
    """Locked files and those that are not."""
    return df.groupBy(*by).agg(F.count_if(locked).alias("n_locked"), F.count_if(~locked).alias("n_open"))


def first_success(outcomes: DataFrame, *by: str) -> DataFrame:
    """The output of the first row that succeeded."""
    return outcomes.where(succeeded(F.col("failure"))).groupBy(*by).agg(F.min_by("output", "idx").alias("output"))
