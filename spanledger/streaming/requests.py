"""Scoring as a stream: requests arrive as files, every micro-batch commits one batch of results.

A micro-batch writes its results into the folder of its own number, so one that was cut off is written again in place, and the
stream's own log says which files are done.  Throttled requests go back to the queue as files of a later batch.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from spanledger.operators.dataset import todo
from spanledger.session import materialize
from spanledger.streaming import resume

REQUEST = "case_id string, arm string, text string"
FILE_ROWS = 20_000


def add_requests(reports: DataFrame, arms: Sequence[str], queue: str) -> None:
    """Put a request for every report (case_id, text) and arm into the queue folder.

    The requests of a report stand one after the other, so compressed files hold its text about once.  Such a file is
    read by one task, hence the limit on its rows.
    """
    pending = resume.pending_requests(reports, arms, None)
    pending.write.options(compression="gzip", maxRecordsPerFile=FILE_ROWS).json(f"{queue}/new-{uuid.uuid4().hex}")


def queued(spark: SparkSession, queue: str) -> DataFrame:
    """All requests that were ever queued, throttled ones once for each time."""
    return spark.read.schema(REQUEST).json(f"{queue}/*")


def score_stream(spark: SparkSession, queue: str, path: str, state: str, scorer: Callable[[str, str], str], *,
                 max_rounds: int = 20, files_per_batch: int = 100, pause_seconds: float = 0.0) -> DataFrame:
    """Score all queued requests and return the checkpoint at ``path``; ``state`` is the stream's own folder.

    A run that ended anywhere goes on where it stopped.  A round takes what the queue holds; requests that the scorer
    throttled are queued again for the next one, after a pause.  Raises ``resume.Unfinished`` if some are left after
    ``max_rounds``, and ``resume.Exhausted`` after a batch in which the scorer refused for good.
    """
    def commit(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        resume.append_results(resume.to_results(resume.score_with(batch, scorer)), path, number)
        written = session.read.schema("case_id string, arm string").json(f"{path}/batch={number}/*")
        # the keys alone say what was throttled; texts meet only these
        throttled = materialize(todo(batch.select("case_id", "arm"), written), "throttled")
        again = batch.join(throttled, ["case_id", "arm"], "left_semi")
        again.write.mode("overwrite").options(compression="gzip", maxRecordsPerFile=FILE_ROWS).json(f"{queue}/again-{number}")

    for round_no in range(max_rounds):
        if round_no:
            time.sleep(pause_seconds)
        source = spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", files_per_batch).json(f"{queue}/*")
        source.writeStream.foreachBatch(commit).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        if resume._last_batch(spark, path)[1]:
            raise resume.Exhausted("the scorer refused for good; finished rows are in the checkpoint")
        done = resume.read_checkpoint(spark, path)
        if todo(queued(spark, queue).select("case_id", "arm"), done).isEmpty():
            return done
    raise resume.Unfinished(f"requests are left after {max_rounds} rounds; finished rows are in the checkpoint")
