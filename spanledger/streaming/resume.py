"""Resumable scoring: requests not yet in the checkpoint are scored and appended, in rounds.

Every round is one Spark job: leave out what the checkpoint holds, call the scorer inside the tasks,
write one batch folder.  A batch is committed as a whole, so a lost executor repeats its own calls
and leaves no half-written rows, and a later run continues from the committed batches.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanledger import constants as K
from spanledger.functions.shape import parse_document, shape_valid, stage_field
from spanledger.operators.dataset import cases_by_arms, last_row_per_key, todo
from spanledger.operators.records import long_responses
from spanledger.sources.jsonl import CHECKPOINT
from spanledger.sources.tables import with_file_order

DONE, RETRY, FATAL = "done", "retry", "fatal"
_SCORED = "case_id string, arm string, raw string, failed boolean, outcome string"


class RetryLater(Exception):
    """The service is throttled: the request is not recorded and a later round tries again."""


class Exhausted(Exception):
    """The service refuses for good: the run stops after this round is committed."""


class Unfinished(Exception):
    """The rounds are used up and requests are left; what is finished is in the checkpoint."""


def score_with(requests: DataFrame, scorer: Callable[[str, str], str]) -> DataFrame:
    """Call ``scorer(arm, text)`` for every request inside the tasks.

    Any other exception is a real failure of that request and is recorded as one.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stopped = False
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                if stopped:
                    rows.append((r.case_id, r.arm, None, False, RETRY))
                    continue
                try:
                    rows.append((r.case_id, r.arm, scorer(r.arm, r.text), False, DONE))
                except RetryLater:
                    rows.append((r.case_id, r.arm, None, False, RETRY))
                except Exhausted as error:
                    stopped = True
                    rows.append((r.case_id, r.arm, repr(error), True, FATAL))
                except Exception as error:
                    rows.append((r.case_id, r.arm, f"ERROR: {error!r}", True, DONE))
            yield pd.DataFrame(rows, columns=["case_id", "arm", "raw", "failed", "outcome"])

    return requests.select("case_id", "arm", "text").mapInPandas(run, _SCORED)


def to_results(scored: DataFrame) -> DataFrame:
    """Scored rows in checkpoint form: the shape check decides validity, natively.

    One pass: a failed call has no document, so its fields are NULL and it is invalid.
    """
    rows = scored.withColumn("doc", F.when(~F.col("failed"), parse_document(F.col("raw")))).withColumn(
        "invalid", ~shape_valid(F.col("doc"))
    )
    fields = [stage_field(F.col("doc"), t).alias(f"{t}_stage") for t in K.TARGETS]
    group = F.when(
        F.schema_of_variant(F.try_variant_get("doc", "$.pathologic_stage", "variant")).startswith("OBJECT"),
        F.struct(*(F.try_variant_get("doc", f"$.pathologic_stage.{k}", "string").alias(k)
                   for k in ("value", "evidence", "confidence", "reason"))),
    ).alias("pathologic_stage")
    return rows.select(
        "case_id", "arm", "invalid", "raw",
        F.when(~F.col("invalid"), F.struct(*fields, group)).alias("extraction"), "outcome",
    )


def _lines(spark: SparkSession, path: str, after: int | None = None) -> DataFrame | None:
    """All lines of a checkpoint with their folder columns, None when nothing is there.

    A plain file or folder of lines has no such columns: its rows are finished and come before any batch.  With
    ``after`` only later batches are read, as folders.
    """
    try:
        lines = spark.read.schema(f"{CHECKPOINT}, batch int, outcome string").json(path)
        if after is not None:
            lines = lines.filter(F.col("batch") > after)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return with_file_order(lines, "place").withColumns(
        {"batch": F.coalesce("batch", F.lit(-1)), "outcome": F.coalesce("outcome", F.lit(DONE))})


def _last_batch(spark: SparkSession, path: str) -> tuple[int, bool]:
    """Number of the last committed batch (-1: none), and whether a request was refused for good in it.

    Every batch leaves one small row in a manifest, so no file of results is listed or read for this.
    """
    try:
        last = spark.read.schema("batch int, refused boolean").json(f"{path}/_manifest/*").orderBy(F.desc("batch")).first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        last = None
    return (last["batch"], last["refused"]) if last else (-1, False)


def _live(spark: SparkSession, path: str) -> tuple[str, int] | None:
    """The compacted run that stands for all batches up to a number: (folder, number).  The newest entry counts."""
    try:
        last = spark.read.schema("run string, upto int").json(f"{path}/_live/*").orderBy(F.desc("upto"), F.desc("run")).first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        last = None
    return (last["run"], last["upto"]) if last else None


def read_checkpoint(spark: SparkSession, path: str, earlier: str | None = None) -> DataFrame:
    """Latest result per (case_id, arm); an absent checkpoint is empty.

    ``path`` may be a folder of batches or plain lines.  ``earlier`` names plain lines that count as
    older than all batches.  Batches that a compacted run stands for are not read.
    """
    found = [] if earlier is None or (old := _lines(spark, earlier)) is None else [old.withColumn("batch", F.lit(-3))]
    live = _live(spark, path)
    if live and (run := _lines(spark, live[0])) is not None:
        found.append(run.withColumn("batch", F.lit(-2)))
    if (lines := _lines(spark, path, live[1] if live else None)) is not None:
        found.append(lines)
    if not found:
        return spark.createDataFrame([], CHECKPOINT)
    lines = reduce(DataFrame.unionByName, found)
    ordered = lines.filter(F.col("outcome") == DONE).withColumn("place", F.struct("batch", "place"))
    return last_row_per_key(ordered.drop("batch", "outcome"), ["case_id", "arm"], "place").select(
        "case_id", "arm", "invalid", "raw", "extraction"
    )


def compact(spark: SparkSession, path: str) -> None:
    """Merge all committed batches into one run with the latest result of each key.

    The run is written first; the entry that makes it live is one small file, which its commit moves into place.
    Whoever reads before that sees the batches, whoever reads after it the run and later batches, so a crash at any
    point loses nothing.  Merged batches stay on disk until ``drop_merged``.
    """
    last, live = _last_batch(spark, path)[0], _live(spark, path)
    if last < 0 or live and live[1] >= last:
        return
    run = f"{path}/_runs/{last:09d}-{uuid.uuid4().hex}"
    read_checkpoint(spark, path).sortWithinPartitions("case_id", "arm").write.option("ignoreNullFields", False).json(run)
    _make_live(spark, path, run, last)


def _make_live(spark: SparkSession, path: str, run: str, upto: int) -> None:
    spark.createDataFrame([(run, upto)], "run string, upto int").coalesce(1).write.mode("overwrite").json(f"{path}/_live/{upto:09d}")


def drop_merged(spark: SparkSession, path: str) -> list[int]:
    """Remove the folders of batches that the live run stands for; returns their numbers.  For times without readers."""
    live = _live(spark, path)
    if live is None:
        return []
    hadoop = spark._jvm.org.apache.hadoop.fs
    files = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    gone = []
    for status in files.globStatus(hadoop.Path(f"{path}/batch=*")):
        number = int(status.getPath().getName().split("=")[1])
        if number <= live[1] and files.delete(status.getPath(), True):
            gone.append(number)
    return sorted(gone)


def append_results(results: DataFrame, path: str, batch: int) -> None:
    """Commit one batch: finished rows, and a marker for requests that were refused for good."""
    folder = f"{path}/batch={batch}"
    kept = results.filter(F.col("outcome") != RETRY)
    kept.write.mode("overwrite").partitionBy("outcome").option("ignoreNullFields", False).json(folder)
    spark = results.sparkSession
    written = spark.read.schema("outcome string").option("basePath", folder).json(folder)
    refused = not written.filter(F.col("outcome") == FATAL).limit(1).isEmpty()
    spark.createDataFrame([(batch, refused)], "batch int, refused boolean").coalesce(1).write.mode("overwrite").json(
        f"{path}/_manifest/{batch}")


def pending_requests(reports: DataFrame, arms: Sequence[str], done: DataFrame | None) -> DataFrame:
    """(case_id, arm, text) still to be scored.

    Finished arms are first gathered per case, so a report text takes part in one join and only
    afterwards is repeated for its missing arms.  Without a checkpoint there is no join at all.
    """
    every = F.array(*(F.lit(a) for a in arms))
    texts = reports.select("case_id", "text")
    if done is None:
        return texts.withColumn("arm", F.explode(every))
    finished = done.groupBy("case_id").agg(F.collect_set("arm").alias("finished"))
    joined = texts.join(finished, "case_id", "left")
    missing = F.array_except(every, F.coalesce("finished", F.array().cast("array<string>")))
    return joined.select("case_id", "text", F.explode(missing).alias("arm"))


def run_rounds(
    reports: DataFrame, arms: Sequence[str], path: str, scorer: Callable[[str, str], str], *,
    max_rounds: int = 20, parallelism: int | None = None, pause_seconds: float = 0.0, earlier: str | None = None,
    compact_every: int = 8,
) -> DataFrame:
    """Score every (report, arm) until none is left; Unfinished is raised if the rounds are used up before.

    ``reports``: case_id, text.  ``parallelism`` bounds the concurrent calls.  ``earlier`` names plain
    lines of results that are not asked for again.  Whether anything is left is decided on the keys
    alone.  Returns the checkpoint.
    """
    spark = reports.sparkSession
    keys = cases_by_arms(reports.select("case_id"), tuple(arms))
    batch = 1 + _last_batch(spark, path)[0]
    for round_no in range(max_rounds + 1):
        done = read_checkpoint(spark, path, earlier).select("case_id", "arm") if batch or earlier else None
        if done is not None and todo(keys, done).isEmpty():
            return read_checkpoint(spark, path, earlier)
        if round_no == max_rounds:
            break
        if round_no:
            time.sleep(pause_seconds)
        pending = pending_requests(reports, arms, done)
        pending = pending.repartition(parallelism) if parallelism else pending
        append_results(to_results(score_with(pending, scorer)), path, batch)
        if _last_batch(spark, path)[1]:
            raise Exhausted("the scorer refused for good; finished rows are in the checkpoint")
        batch += 1
        if batch % compact_every == 0:
            compact(spark, path)
    raise Unfinished(f"requests are left after {max_rounds} rounds; finished rows are in the checkpoint")


def checkpoint_responses(checkpoint: DataFrame) -> DataFrame:
    """Checkpoint rows as long responses for the record operator."""
    fields = checkpoint.select(
        "case_id", "arm", "invalid", *(F.col(f"extraction.{t}_stage").alias(f"{t}_stage") for t in K.TARGETS)
    )
    return long_responses(fields)
