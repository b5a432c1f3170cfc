import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.errors import StreamingQueryException

from spanledger.operators.dataset import overlap_leaks, overlap_lists
from spanledger.session import scratch_path
from spanledger.streaming import requests, resume

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not import test modules

ARMS = ("A_zero_shot", "D_grounded")


def _answer(arm, text):
    field = {"value": "T2", "evidence": None, "confidence": "high", "reason": None}
    return json.dumps({f"{t}_stage": field for t in "TNM"})


def _queue(spark, n, *queues):
    reports = spark.createDataFrame([(f"c{i}", f"report {i}") for i in range(n)], "case_id string, text string").repartition(3)
    paths = [scratch_path(spark, name) for name in ("queue", "results", "state")] if not queues else list(queues)
    requests.add_requests(reports, ARMS, paths[0])
    return paths


def _keys(df):
    return sorted((r["case_id"], r["arm"]) for r in df.select("case_id", "arm").collect())


def test_a_run_that_was_killed_after_a_write_gives_each_key_once(spark, monkeypatch):
    queue, path, state = _queue(spark, 6)
    real, calls = resume.append_results, []

    def cut_off(*args):
        real(*args)
        calls.append(args[2])
        if len(calls) == 2:
            raise RuntimeError("killed")

    monkeypatch.setattr(resume, "append_results", cut_off)
    with pytest.raises(StreamingQueryException):
        requests.score_stream(spark, queue, path, state, _answer, files_per_batch=1)
    monkeypatch.setattr(resume, "append_results", real)
    done = requests.score_stream(spark, queue, path, state, _answer, files_per_batch=1)
    wanted = sorted((f"c{i}", a) for i in range(6) for a in ARMS)
    assert _keys(done) == wanted
    assert _keys(spark.read.json(f"{path}/batch=*/*")) == wanted  # no line twice on disk either
    _queue(spark, 8, queue, path, state)
    assert len(_keys(requests.score_stream(spark, queue, path, state, _answer))) == 16


def test_throttled_requests_come_back(spark):
    queue, path, state = _queue(spark, 4)

    def throttled(arm, text):
        if text.endswith(("1", "3")):
            raise resume.RetryLater("slow down")
        return _answer(arm, text)

    with pytest.raises(resume.Unfinished):
        requests.score_stream(spark, queue, path, state, throttled, max_rounds=2)
    assert len(_keys(resume.read_checkpoint(spark, path))) == 4
    assert len(_keys(requests.score_stream(spark, queue, path, state, _answer))) == 8


def test_a_refusal_ends_the_stream(spark):
    queue, path, state = _queue(spark, 2)

    def refuse(arm, text):
        raise resume.Exhausted("no quota")

    with pytest.raises(resume.Exhausted):
        requests.score_stream(spark, queue, path, state, refuse)


def test_a_train_case_in_the_overlap_fails(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "case_id string")
    sampled, held_out = ids("a", "b", "c", "d"), ids("b", "c", "x", "b")
    assert sorted(r[0] for r in overlap_lists(sampled, held_out, ids("a", "x", "y")).collect()) == ["b", "c"]
    assert [r[0] for r in overlap_leaks(ids("b", "c"), ids("c", "c", "z")).collect()] == ["c"]
    with pytest.raises(Exception, match="a train case is in the overlap: c"):
        overlap_lists(sampled, held_out, ids("c")).collect()
    assert overlap_lists(sampled, held_out, ids()).count() == 2


def test_the_queue_holds_a_text_about_once_whatever_the_arms(spark, tmp_path):
    reports = spark.range(0, 20, 1, 2).selectExpr("concat('c', id) as case_id", "array_join(transform(sequence(1, 200), i -> md5(concat(id, i))), '') as text")
    queue = str(tmp_path / "queue")
    arms = ("A_zero_shot", "C_constrained", "D_grounded", "E_other")
    requests.add_requests(reports, arms, queue)
    written = sum(f.stat().st_size for f in (tmp_path / "queue").rglob("part-*"))
    assert written < 2 * 20 * 6400
    assert requests.queued(spark, queue).count() == 80
