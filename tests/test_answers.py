"""The answer store: each prompt asked once, whatever fails; the rate of the whole cluster; refusals shared by all lanes."""
import os
import time
from pathlib import Path

import pandas as pd
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from barlane.operators import answers, hybrid, judge


def counting(log: str, fails: str | None = None, refuses: int = 0):
    """A judge that notes each call in a file of its own, in the folder log."""

    def ask(prompts: pd.Series) -> pd.Series:
        out = []
        for p in prompts:
            (Path(log) / f"{time.time():.6f}-{os.getpid()}-{p[:40].strip().replace(' ', '_').replace('/', '')}").touch()
            if fails and p == fails and not (Path(log) / "failed").exists():
                (Path(log) / "failed").touch()
                os._exit(1)  # as if the executor were lost
            if refuses and len(list(Path(log).iterdir())) <= refuses:
                raise judge.Refused("rate_limit_exceeded: try again in 300ms")
            if p == "bad":
                raise judge.JudgeError("no")
            out.append(f"answer to {p}")
        return pd.Series(out)

    return ask


def calls(log):
    return sorted((float(f.name.split("-")[0]), f.name.split("-", 2)[2]) for f in Path(log).iterdir() if f.name != "failed")


@pytest.fixture
def log(tmp_path):
    (tmp_path / "log").mkdir()
    return str(tmp_path / "log")


def test_each_prompt_is_asked_once_also_where_a_task_fails(spark, tmp_path, log):
    store = f"file://{tmp_path}/store"
    prompts = spark.createDataFrame([(f"p{i % 40}",) for i in range(400)] + [(None,), ("bad",)], "prompt string").repartition(7)
    with pytest.raises((PythonException, Exception)):
        answers.fill(prompts, store, counting(log, fails="p17"), lanes=4, flush=1)
    before = {p for _, p in calls(log)}
    assert "p17" in before and len(calls(log)) == len(before)
    assert {r.content for r in answers.read(spark, store).collect()} <= {f"answer to {p}" for p in before}
    got = {r.cache_key: r.content for r in answers.fill(prompts, store, counting(log, fails="p17"), lanes=4, flush=1).collect()}
    assert sorted(got.values()) == sorted(f"answer to p{i}" for i in range(40))
    asked = [p for _, p in calls(log) if p != "bad"]
    assert sorted(asked) == sorted([*{f"p{i}" for i in range(40)}, "p17"])  # only the call that was lost is made again
    n = len(calls(log))
    answers.fill(prompts.filter("prompt <> 'bad'"), store, counting(log), lanes=3)
    assert len(calls(log)) == n


def test_keys_have_model_and_system(spark):
    row = spark.range(1).select(answers.prompt_key(F.lit("u"), "m", "s").alias("k"), F.md5(F.lit("m\0s\0u")).alias("w")).first()
    assert row.k == row.w


def test_all_lanes_together_keep_the_rate(spark, tmp_path, log):
    prompts = spark.createDataFrame([(f"q{i}",) for i in range(40)], "prompt string").repartition(8)
    answers.fill(prompts, f"file://{tmp_path}/s", counting(log), lanes=8, per_second=8.0)
    at = [t for t, _ in calls(log)]
    assert len(at) == 40
    for i, a in enumerate(at):  # at most the first call of each lane more than the rate allows
        assert sum(a <= b < a + 2.0 for b in at[i:]) <= 8 * 2 + 8
    assert len(at) / (at[-1] - at[0]) <= 16


def test_refusals_hold_up_every_lane(spark, tmp_path, log):
    prompts = spark.createDataFrame([(f"r{i}",) for i in range(6)], "prompt string")
    got = answers.fill(prompts, f"file://{tmp_path}/s", counting(log, refuses=2), lanes=2)
    assert got.count() == 6
    at = [t for t, _ in calls(log)]
    assert at[-1] - at[0] >= 0.5


def test_hybrid_asks_through_the_store_once(spark, tmp_path, log):
    text = "\n".join(["you set the table", *(f"verse {i} rolls over hills" for i in range(12))])
    both = spark.createDataFrame([(1, 1, "A", text), (2, 1, "A", text)], "match_id long, round int, side string, text string")
    inner = counting(log)

    def ask(prompts):
        inner(prompts)
        return pd.Series(['{"semantic_detections": [{"skill_id": "MR", "points": 1.35, "direction": "positive", "lines": ["x"]}]}' if p.startswith("Name the skills in these lines. Answer") or "open the round" in p else "nothing" for p in prompts])

    store = f"file://{tmp_path}/store"
    for _ in range(2):
        got = hybrid.hybrid(both, ask, store=store, model="m", lanes=2).collect()
        assert {(r.total, r.status, r.windows) for r in got} == {(1.35, "ok", 2)}
        assert len(calls(log)) == 3  # two windows and one second try; equal texts share them
    assert {r.status for r in hybrid.hybrid(both, store=store, model="other").collect()} == {"unanswered"}
