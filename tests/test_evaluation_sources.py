import hashlib
import json

import pytest

from corpusloom.sources import evaluation as E


def test_cases_need_exactly_one_wording(spark):
    plan = spark.createDataFrame([("b1", "easy"), ("b2", "hard")], "blueprint_id string, difficulty string")
    words = spark.createDataFrame([("b1", "Why?"), ("b2", "How so?"), ("b9", "?")], "blueprint_id string, question string")
    rows = {r.blueprint_id: r.question_chars for r in E.build_cases(plan, words).collect()}
    assert rows == {"b1": 4, "b2": 7} and [r.blueprint_id for r in E.unplanned(plan, words).collect()] == ["b9"]
    for bad in (words.filter("blueprint_id <> 'b2'"), words.union(words)):
        with pytest.raises(Exception, match="exactly one wording"):
            E.build_cases(plan, bad).collect()


def test_load_run_takes_the_last_lines(spark):
    records = spark.createDataFrame([("c", "A", "full", "ok", "old", 0), ("c", "A", "full", "ok", "new", 1), ("d", "A", "full", "ok", "x", 2)], "case_id string, arm string, mode string, status string, answer string, seq long")
    h = hashlib.sha256(b"new").hexdigest()
    judged = spark.createDataFrame([("c", "A", h, "v1", "error", None, 0), ("c", "A", h, "v1", "ok", "yes", 1)], "case_id string, arm string, answer_sha256 string, judge_prompt_version string, status string, verdict string, seq long")
    assert sorted((r.case_id, r.answer, r.judge_status, r.verdict) for r in E.load_run(records, judged).collect()) == [("c", "new", "ok", "yes"), ("d", "x", None, None)]


def test_selection_and_resuming(spark):
    cases = spark.createDataFrame([("q1", "eval"), ("q2", "eval"), ("d1", "dev")], "id string, split string")
    assert {r.id for r in E.select_cases(cases, "eval").collect()} == {"q1", "q2"}
    assert [r.id for r in E.select_cases(cases, "eval", ["q2"]).collect()] == ["q2"]
    for ids in (["q9"], ["d1"]):
        with pytest.raises(E.SettingsError):
            E.select_cases(cases, "eval", ids)
    records = spark.createDataFrame([("q1", "A", "full", "ok", 0), ("q2", "A", "full", "ok", 1), ("q2", "A", "full", "error", 2)], "case_id string, arm string, mode string, status string, seq long")
    assert {r.id for r in E.remaining(cases, records, "A", "full").collect()} == {"q2", "d1"}
    E.check_resumable({"k": 1}, {"k": 1})
    with pytest.raises(E.SettingsError, match="k"):
        E.check_resumable({"k": 1}, {"k": 2})


def test_settings():
    env = {"A": "yes", "B": "0", "C": "maybe", "N": "7", "X": "x"}
    assert E.flag(env, "A", False) and not E.flag(env, "B", True) and E.flag(env, "missing", True) and E.number(env, "N", 1, 0, 9) == 7
    for call in (lambda: E.flag(env, "C", True), lambda: E.number(env, "N", 1, 0, 5), lambda: E.number(env, "X", 1, 0, 5)):
        with pytest.raises(E.SettingsError):
            call()


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("c", "A", ["s1", "s2"], None)], "case_id string, arm string, citations array<string>, result string")
    E.write_csv(rows, str(tmp_path / "csv"))
    found = spark.read.option("header", True).csv(str(tmp_path / "csv")).first()
    assert tuple(found.asDict()) == E.CSV_COLUMNS and (found.case_id, found.citations, found.result) == ("c", "s1;s2", None)
    assert json.loads(E.summary_json(rows).first().value) == {"case_id": "c", "arm": "A", "citations": ["s1", "s2"], "result": None}
