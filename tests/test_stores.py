"""The reply store and the report store: runs repeated, failed and resumed."""

import sys
from pathlib import Path

import pandas as pd
import pytest
from pyspark import cloudpickle

from factloom.sources import report as sink
from factloom.sources.replies import pending_prompts, score_pending, stored_replies

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Model:
    """Writes down what it is asked, in files that all tasks share."""

    def __init__(self, log, fails=()):
        self.log, self.fails = log, fails

    def __call__(self):
        def score(prompts):
            for prompt in prompts:
                with (Path(self.log) / "asked").open("a") as out:
                    out.write(f"{prompt}\n")
            if any(p in self.fails for p in prompts):
                raise RuntimeError("overloaded")
            return pd.Series([None if p == "mute" else f"re {p}" for p in prompts])

        return score

    def asked(self):
        path = Path(self.log) / "asked"
        lines = path.read_text().split() if path.exists() else []
        path.unlink(missing_ok=True)
        return sorted(lines)


@pytest.fixture
def prompts(spark):
    rows = [(n, f"p{n % 8}") for n in range(40)] + [(90, None), (91, "mute")]
    return spark.createDataFrame(rows, "claim_id long, prompt string").repartition(4)


def test_only_pending_prompts_are_scored(spark, prompts, tmp_path):
    store, model = str(tmp_path / "store"), Model(str(tmp_path))
    first = score_pending(prompts, model, store, "verdict", "1", batch_rows=1)
    assert {r["claim_id"]: r["raw"] for r in first.collect()} == {
        **{n: f"re p{n % 8}" for n in range(40)}, 90: None, 91: None,
    }
    assert model.asked() == ["mute", *[f"p{n}" for n in range(8)]]  # once each, though asked five times
    score_pending(prompts.filter("prompt <> 'mute'"), model, store, "verdict", "1")
    assert model.asked() == []
    more = prompts.unionByName(spark.createDataFrame([(50, "new")], prompts.schema)).filter("claim_id <> 91")
    score_pending(more, model, store, "verdict", "1")
    assert model.asked() == ["new"]
    score_pending(prompts.filter("claim_id < 3"), model, store, "verdict", "2")  # another template
    assert model.asked() == ["p0", "p1", "p2"]
    assert stored_replies(spark, store).count() == 9 + 3


def test_a_failing_batch_is_scored_alone_next_time(spark, prompts, tmp_path):
    store = str(tmp_path / "store")
    bad = Model(str(tmp_path), fails=("p3",))
    got = {r["claim_id"]: r["raw"] for r in score_pending(prompts, bad, store, "s", "1", batch_rows=1).collect()}
    assert {n for n in range(40) if got[n] is None} == {3, 11, 19, 27, 35}
    bad.asked()
    assert {r["prompt"] for r in pending_prompts(prompts, store, "s", "1").collect()} == {"p3", "mute"}
    good = Model(str(tmp_path))
    got = {r["claim_id"]: r["raw"] for r in score_pending(prompts, good, store, "s", "1", batch_rows=1).collect()}
    assert good.asked() == ["mute", "p3"] and got[11] == "re p3"


def test_what_a_failed_run_left_does_not_count(spark, prompts, tmp_path):
    store, model = tmp_path / "store", Model(str(tmp_path))
    (store / "commit-000000000").mkdir(parents=True)
    (store / "commit-000000000" / "part-0.parquet").write_bytes(b"half a file")
    score_pending(prompts, model, str(store), "s", "1")
    assert stored_replies(spark, str(store)).count() == 8
    none = prompts.limit(0)
    assert score_pending(none, model, str(store), "s", "1").collect() == []


def tables(spark, verdicts, rejected=()):
    report = spark.createDataFrame(list(verdicts.items()), "claim_id long, final_verdict string")
    items = [(c, n, f"{c}-{v}-{n}") for c, v in verdicts.items() for n in (1, 2)]
    return (
        report, spark.createDataFrame(items, "claim_id long, item_no int, item string"),
        spark.createDataFrame([(c, "verdict", "none") for c in rejected], "claim_id long, stage string, reason string"),
    )


def shown(spark, path):
    found = sink.read_report(spark, path)
    return (
        {r["claim_id"]: (r["final_verdict"], r["batch"]) for r in found["report"].collect()},
        sorted((r["item"], r["batch"]) for r in found["citations"].collect()),
        {r["claim_id"]: r["batch"] for r in found["rejects"].collect()},
    )


def files(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path).rglob("*") if p.is_file()}


def test_upserts(spark, tmp_path):
    path = str(tmp_path / "report")
    with pytest.raises(FileNotFoundError):
        sink.read_report(spark, path)
    assert sink.upsert_report(*tables(spark, {1: "Real", 2: "Fake", 3: "Real"}, [9]), path, "a")
    before = files(path)
    assert not sink.upsert_report(*tables(spark, {1: "Fake"}), path, "a")
    assert files(path) == before
    # 1 changes its verdict, 3 is rejected now, 9 gets a verdict.
    sink.upsert_report(*tables(spark, {1: "Unverified", 9: "Real"}, [3]), path, "b")
    wanted = (
        {1: ("Unverified", "b"), 2: ("Fake", "a"), 9: ("Real", "b")},
        sorted((f"{c}-{v}-{n}", b) for c, v, b in ((1, "Unverified", "b"), (2, "Fake", "a"), (9, "Real", "b")) for n in (1, 2)),
        {3: "b"},
    )
    assert shown(spark, path) == wanted
    held = sink.read_report(spark, path)["report"]
    sink.compact(spark, path, "all")
    now = shown(spark, path)
    assert sink.manifest(spark, path) == ["all"]
    assert {c: v for c, (v, _) in now[0].items()} == {c: v for c, (v, _) in wanted[0].items()} and now[2] == {3: "all"}
    assert held.count() == 3  # a reader that began before
    assert not sink.upsert_report(*tables(spark, {1: "Fake"}), path, "b")
    sink.upsert_report(*tables(spark, {}, [1]), path, "c")
    assert shown(spark, path)[2] == {3: "all", 1: "c"}


def test_half_a_batch_is_never_seen(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "report")
    sink.upsert_report(*tables(spark, {1: "Real"}), path, "a")
    report, citations, _ = tables(spark, {1: "Fake", 2: "Real"})
    broken = report.selectExpr("claim_id", "raise_error('lost') AS stage", "'x' AS reason")
    with pytest.raises(Exception, match="lost"):
        sink.upsert_report(report, citations, broken, path, "b")
    assert shown(spark, path)[0] == {1: ("Real", "a")}
    assert sink.upsert_report(*tables(spark, {1: "Fake", 2: "Real"}), path, "b")
    assert shown(spark, path)[0] == {1: ("Fake", "b"), 2: ("Real", "b")}
