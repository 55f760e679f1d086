"""Calls of a model: each question once, also under killed tasks; auditor and critic together."""

import json
import os
import uuid
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from spanwarden.operators import calls

FAST = {"calls": 10_000, "period": 0.01}


def asked(folder):
    return Counter(p.read_text() for p in Path(folder).glob("call-*"))


def model(folder, die_at=None):
    """A fake model that leaves a note of each call; the first time it is asked for ``die_at`` its worker is killed."""

    def call(prompt: str) -> str:
        flag = f"{folder}/died"
        if prompt == die_at and not os.path.exists(flag):
            open(flag, "w").close()
            os._exit(1)
        with open(f"{folder}/call-{uuid.uuid4().hex}", "w") as f:
            f.write(prompt)
        if prompt == "fails":
            raise OSError("no")
        return f"answer to {prompt}"

    return call


def test_no_call_is_repeated_under_a_killed_worker(spark, tmp_path):
    notes = tmp_path / "notes"
    notes.mkdir()
    questions = spark.createDataFrame([(f"k{i}", f"p{i}") for i in range(40)] + [("k0", "p0")], "key string, prompt string")
    call, store = model(str(notes), die_at="p7"), str(tmp_path / "store")
    with pytest.raises(Exception):  # noqa: B017  a local session does not retry its tasks
        calls.ask(questions, call, store, **FAST).collect()
    got = {r["key"]: r["answer"] for r in calls.ask(questions, call, store, **FAST).collect()}
    assert got == {f"k{i}": f"answer to p{i}" for i in range(40)}
    assert asked(notes) == {f"p{i}": 1 for i in range(40)}
    assert calls.ask(questions, call, store, **FAST).count() == 40 and sum(asked(notes).values()) == 40


def test_failed_calls_are_absent_and_asked_again(spark, tmp_path):
    notes = tmp_path / "notes"
    notes.mkdir()
    questions = spark.createDataFrame([("a", "fails"), ("b", "p")], "key string, prompt string")
    for n in (1, 2):
        got = {r["key"]: r["answer"] for r in calls.ask(questions, model(str(notes)), str(tmp_path / "store"), callers=1, **FAST).collect()}
        assert got == {"a": None, "b": "answer to p"} and asked(notes) == {"fails": n, "p": 1}


def test_auditor_and_critic(spark, tmp_path):
    notes = tmp_path / "notes"
    notes.mkdir()

    def call(prompt: str) -> str:
        with open(f"{notes}/call-{uuid.uuid4().hex}", "w") as f:
            f.write(prompt.split(":")[0])
        if prompt.startswith("Find"):
            if "plain.py" in prompt:
                return "sorry"
            return json.dumps({"violations": [{"rule_id": r, "line_start": n, "line_end": n + 90, "message": "m", "confidence": 0.9} for r, n in (("p/one", 2), ("p/one", 99), ("p/two", 1), ("p/none", 1))]})
        return json.dumps({"reviewed": [{"rule_id": "p/one", "line_start": 2, "verdict": "KEEP", "adjusted_confidence": 0.8}, {"rule_id": "p/one", "line_start": 99, "verdict": "keep"}, {"rule_id": "p/two", "line_start": 1, "verdict": "reject"}]})

    rules = spark.createDataFrame([("p", "p/one", "One", "HIGH", None, "Names in logs."), ("p", "p/two", "Two", "LOW", "hint", "Ages.")], "pack_id string, rule_id string, name string, severity string, fix_hint string, prompt string")
    files = spark.createDataFrame([("a.py", "x\nlog(name)\ny"), ("tests/test_b.py", "x\nlog(name)  # noqa\ny"), ("plain.py", "x"), ("long.py", "x" * 20_000)], "file_path string, content string")
    for _ in range(2):
        got = sorted((r["file_path"], r["rule_id"], r["line_start"], r["line_end"], r["confidence"], r["severity"]) for r in calls.audit(files, rules, call, str(tmp_path / "store"), **FAST).collect())
        assert got == [("a.py", "p/one", 2, 3, 0.8, "HIGH"), ("a.py", "p/one", 3, 3, 0.7, "HIGH"), ("tests/test_b.py", "p/one", 3, 3, 0.3, "HIGH")]
        assert asked(notes) == {"Find what breaks these rules": 3, "Keep or reject each of these": 2}


def test_batches_of_models_are_classified_once(spark, tmp_path):
    notes = tmp_path / "notes"
    notes.mkdir()
    prompts = spark.range(1, 5).select(F.col("id").cast("int").alias("batch"), F.concat(F.lit("models "), F.col("id").cast("string")).alias("prompt"))
    for _ in range(2):
        got = {r["batch"]: r["answer"] for r in calls.classify(prompts, model(str(notes)), str(tmp_path / "store"), **FAST).collect()}
        assert got == {i: f"answer to models {i}" for i in range(1, 5)} and sum(asked(notes).values()) == 4
