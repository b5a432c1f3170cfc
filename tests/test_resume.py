import json
import sys
from pathlib import Path

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from spanledger.operators.dataset import cases_by_arms
from spanledger.session import scratch_path
from spanledger.streaming import resume

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not import test modules

ARMS = ("A_zero_shot", "D_grounded")


def _reports(spark, n=5):
    return spark.createDataFrame([(f"c{i}", f"report {i}") for i in range(n)], "case_id string, text string")


def _run(spark, path, scorer, n=5, **options):
    return resume.run_rounds(_reports(spark, n), ARMS, path, scorer, **options)


def _answer(value="T2"):
    field = {"value": value, "evidence": None, "confidence": "high", "reason": None}
    return json.dumps({f"{t}_stage": field for t in "TNM"})


def _rows(df):
    return {(r["case_id"], r["arm"]): r for r in df.collect()}


def _log(folder, arm, text):
    (Path(folder) / f"{arm}-{text.split()[-1]}-{len(list(Path(folder).iterdir()))}").touch()


def test_scores_everything_once_and_resumes(spark, tmp_path):
    folder, path = str(tmp_path), scratch_path(spark, "checkpoint")

    def scorer(arm, text):
        _log(folder, arm, text)
        return _answer()

    first = _rows(_run(spark, path, n=3, scorer=scorer))
    assert len(first) == 6 and not any(r["invalid"] for r in first.values())
    assert len(list(tmp_path.iterdir())) == 6
    again = _rows(_run(spark, path, n=5, scorer=scorer))
    assert len(again) == 10 and len(list(tmp_path.iterdir())) == 10
    assert again[("c0", ARMS[0])]["extraction"]["T_stage"]["value"] == "T2"


def test_absent_checkpoint_is_empty(spark):
    assert resume.read_checkpoint(spark, scratch_path(spark, "nothing")).count() == 0


def test_throttled_requests_are_never_written_and_come_later(spark, tmp_path):
    folder, path = str(tmp_path), scratch_path(spark, "checkpoint")

    def scorer(arm, text):
        marker = Path(folder) / f"{arm}-{text}".replace(" ", "_")
        if text.endswith("1") and not marker.exists():
            marker.touch()
            raise resume.RetryLater("later")
        return _answer()

    with pytest.raises(resume.Unfinished):
        _run(spark, path, scorer, max_rounds=1)
    assert len(_rows(resume.read_checkpoint(spark, path))) == 8
    assert len(_rows(_run(spark, path, scorer))) == 10


def test_rounds_are_bounded(spark):
    def never(arm, text):
        raise resume.RetryLater("always")

    with pytest.raises(resume.Unfinished):
        _run(spark, scratch_path(spark, "checkpoint"), never, max_rounds=3)


def test_plain_lines_are_a_checkpoint(spark, tmp_path):
    plain = tmp_path / "old.jsonl"
    line = '{"case_id": "%s", "arm": "%s", "invalid": %s, "raw": "%s", "extraction": null}\n'
    plain.write_text(line % ("c0", ARMS[0], "true", "first") + line % ("c1", ARMS[0], "false", "x") + line % ("c0", ARMS[0], "false", "last"))
    rows = _rows(resume.read_checkpoint(spark, str(plain)))
    assert len(rows) == 2 and rows[("c0", ARMS[0])]["raw"] == "last" and not rows[("c0", ARMS[0])]["invalid"]
    done = _rows(_run(spark, scratch_path(spark, "checkpoint"), lambda a, t: _answer(), n=2, earlier=str(plain)))
    assert len(done) == 4 and done[("c0", ARMS[0])]["raw"] == "last" and done[("c0", ARMS[1])]["raw"] == _answer()


def test_real_failures_and_bad_shapes_are_recorded_as_invalid(spark):
    def scorer(arm, text):
        if text.endswith("0"):
            raise ValueError("broken")
        return "not json" if text.endswith("1") else _answer()

    rows = _rows(_run(spark, scratch_path(spark, "checkpoint"), scorer))
    assert [rows[(f"c{i}", ARMS[0])]["invalid"] for i in range(5)] == [True, True, False, False, False]
    assert rows[("c0", ARMS[0])]["raw"].startswith("ERROR: ValueError") and rows[("c0", ARMS[0])]["extraction"] is None


def test_exhausted_scorer_stops_the_run_and_keeps_finished_rows(spark):
    path = scratch_path(spark, "checkpoint")

    def scorer(arm, text):
        if text.endswith("4"):
            raise resume.Exhausted("quota")
        return _answer()

    with pytest.raises(resume.Exhausted):
        resume.run_rounds(_reports(spark).coalesce(1).orderBy("case_id"), ARMS, path, scorer)
    kept = _rows(resume.read_checkpoint(spark, path))
    assert kept and not [k for k in kept if k[0] == "c4"]
    assert len(_rows(_run(spark, path, lambda a, t: _answer()))) == 10


def test_last_result_of_a_key_wins(spark):
    path = scratch_path(spark, "checkpoint")
    for batch, value in enumerate(("T1", "T3")):
        scored = resume.score_with(cases_by_arms(_reports(spark, 2), ARMS), lambda a, t, v=value: _answer(v))
        resume.append_results(resume.to_results(scored), path, batch)
    assert {r["extraction"]["T_stage"]["value"] for r in resume.read_checkpoint(spark, path).collect()} == {"T3"}


def test_checkpoint_becomes_long_responses(spark):
    done = _run(spark, scratch_path(spark, "checkpoint"), n=1, scorer=lambda a, t: _answer() if a == ARMS[0] else "x")
    rows = {(r["arm"], r["target"]): (r["raw_value"], r["shape_valid"]) for r in resume.checkpoint_responses(done).collect()}
    assert rows[(ARMS[0], "N")] == ("T2", True) and rows[(ARMS[1], "T")] == (None, False) and len(rows) == 6


def _batches(spark, path, values, n=3):
    for batch, value in enumerate(values):
        scored = resume.score_with(cases_by_arms(_reports(spark, n), ARMS), lambda a, t, v=value: _answer(v))
        resume.append_results(resume.to_results(scored), path, batch)


def _found(spark, path):
    return {(k, r["extraction"]["T_stage"]["value"]) for k, r in _rows(resume.read_checkpoint(spark, path)).items()}


def test_compaction_keeps_the_last_result_and_reads_the_run_alone(spark):
    path = scratch_path(spark, "checkpoint")
    _batches(spark, path, ("T1", "T2", "T3"))
    before = _found(spark, path)
    resume.compact(spark, path)
    resume.compact(spark, path)  # nothing new: no second run
    assert _found(spark, path) == before and len(spark.read.json(f"{path}/_live/*").collect()) == 1
    assert resume.drop_merged(spark, path) == [0, 1, 2] and _found(spark, path) == before
    scored = resume.score_with(cases_by_arms(_reports(spark, 1), ARMS), lambda a, t: _answer("T4"))
    resume.append_results(resume.to_results(scored), path, 3)
    assert {v for (case, _), v in _found(spark, path) if case == "c0"} == {"T4"} and len(_found(spark, path)) == 6
    resume.compact(spark, path)
    assert {v for (case, _), v in _found(spark, path) if case == "c0"} == {"T4"} and len(_found(spark, path)) == 6
    assert spark.read.text(resume._live(spark, path)[0]).count() == 6  # bounded by the keys, whatever the batches


def test_a_crash_between_the_run_and_the_swap_loses_nothing(spark, monkeypatch):
    path = scratch_path(spark, "checkpoint")
    _batches(spark, path, ("T1", "T2"))

    def crash(*args):
        raise RuntimeError("killed")

    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(resume, "_make_live", crash)
        resume.compact(spark, path)
    assert {v for _, v in _found(spark, path)} == {"T2"} and resume.drop_merged(spark, path) == []
    resume.compact(spark, path)
    assert {v for _, v in _found(spark, path)} == {"T2"}


def test_rounds_go_on_after_a_compaction(spark):
    path = scratch_path(spark, "checkpoint")
    assert len(_rows(_run(spark, path, lambda a, t: _answer(), n=2, compact_every=1))) == 4
    resume.drop_merged(spark, path)
    assert len(_rows(_run(spark, path, lambda a, t: _answer(), n=4, compact_every=1))) == 8


def test_plain_checkpoint_query_writes_no_file_in_one_task(spark, tmp_path, monkeypatch):
    """The lines of s9 stand in the order of several files; the later of two lines with a key counts across files."""
    from catalog import QUERIES

    monkeypatch.setattr("catalog.source_queries.scratch_path", lambda session, label: str(tmp_path / label))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = QUERIES["s9_plain_checkpoint"](spark, "/root/testdata/sf0.001")
        assert rows.filter(F.col("raw_md5") == F.md5(F.lit("old"))).isEmpty() and rows.count() > 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "plain-checkpoint").glob("part-*"))) > 1


def test_long_texts_reach_a_scorer_in_batches_of_bytes(spark):
    def sizes(batches):
        for batch in batches:
            yield batch.assign(size=batch["text"].str.len().sum())[["size"]].head(1)

    texts = spark.range(0, 400, 1, 1).selectExpr("repeat('x', 100000) as text")
    seen = [r["size"] for r in texts.mapInPandas(sizes, "size long").collect()]
    assert sum(seen) == 40_000_000 and max(seen) <= 5_000_000


def test_first_tokens_of_a_text_in_one_pass():
    import random
    import re

    from catalog.join_queries import first_tokens
    from spanledger import constants as K

    plain = {t: re.compile(rf"(?<![^\W_])(?<!_)p?{t}[{K.TOKEN_SUFFIXES[t]}]", re.IGNORECASE) for t in K.TARGETS}
    rng = random.Random(1)
    texts = ["".join(rng.choice("pPTtNnMm0123456xXé_ .y²ı\n") for _ in range(rng.randrange(14))) for _ in range(20_000)]
    for text in [*texts, "", "T", "pT2N0M0", "PN1 m1"]:
        assert first_tokens(text) == {t: hit[0] for t, p in plain.items() if (hit := p.search(text))}
