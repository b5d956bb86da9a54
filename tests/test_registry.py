"""Parameters, presets, jobs, comparison, verdicts."""

import pytest

from quillon.registry import REGISTRY, Analysis, Param, Registry, coerce


def test_coercion():
    assert coerce("42", Param("n", 1, "int")) == 42
    assert coerce("true", Param("b", False, "bool")) is True
    assert coerce("[1, 2]", Param("s", {1}, "json")) == {1, 2}
    for value, kind, default in ((True, "int", 1), ("not[a]list", "json", [1]), ("x", "float", 1.0), (2.5, "int", 1), (1, "str", "a")):
        with pytest.raises(ValueError):
            coerce(value, Param("p", default, kind))


@pytest.fixture
def registry(spark):
    r = Registry()
    r.add(Analysis("base", lambda s, d, n=3: s.range(n), (Param("n", 3, "int"),), seconds=10))
    r.add(Analysis("next", lambda s, d: s.range(1), depends=("base",)))
    r.add(Analysis("broken", lambda s, d: s.range(1).selectExpr("nope"), seconds=5000))
    return r


def test_jobs(spark, registry):
    job = registry.run(spark, "", "base", {"n": "5"})
    assert (job["state"], job["rows"]) == ("done", 5) and registry.job(job["id"]) == job
    assert registry.run(spark, "", "broken")["state"] == "failed"
    with pytest.raises(KeyError):
        registry.run(spark, "", "missing")
    with pytest.raises(KeyError):
        registry.run(spark, "", "base", {"m": 1})
    assert [j["name"] for j in registry.run_all(spark, "", ["next"])] == ["base", "next"]
    assert [t["timeout"] for t in registry.tests()] == [120, 3600, 900]


def test_comparison(spark, registry):
    job = registry.run(spark, "", "base")
    assert registry.compare(job, {}) == "no_reference"
    assert registry.compare(registry.run(spark, "", "base"), {"base": job}) == "identical"
    assert registry.compare(registry.run(spark, "", "base", {"n": 4}), {"base": job}) == "not_comparable_params"
    assert registry.compare(job, {"base": job | {"digest": "x"}}) == "differs"
    assert registry.compare(registry.run(spark, "", "broken"), {}) == "not_comparable_state"


def test_presets(spark, registry):
    registry.save_preset("base", "big", {"n": 7})
    assert registry.run(spark, "", "base", preset="big")["rows"] == 7
    registry.delete_preset("base", "big")
    for change in (lambda: registry.save_preset("base", "defaults", {}), lambda: registry.delete_preset("base", "defaults")):
        with pytest.raises(ValueError):
            change()


def test_verdicts(spark, registry):
    job = registry.run(spark, "", "base")
    registry.adjudicate(job, True, "bind", {"x": 1})
    registry.adjudicate(job, False, "bind", {})
    assert [r.verdict for r in registry.verdict_table(spark).collect()] == ["bind", "gate_failed"]
    registry.quarantine("base", "flaky")
    assert registry.run(spark, "", "base")["state"] == "quarantined"


def test_cycles_are_refused():
    r = Registry()
    r.add(Analysis("a", lambda s, d: None, depends=("b",)))
    r.add(Analysis("b", lambda s, d: None, depends=("a",)))
    with pytest.raises(ValueError):
        r.order(["a"])


def test_catalogue_has_no_sql_without_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(REGISTRY.analyses) > 120


def test_limits_results_and_what_is_kept(spark, registry, tmp_path):
    import time

    folder = str(tmp_path / "state")
    registry.attach(folder)
    registry.add(Analysis("slow", lambda s, d: s.range(8).repartition(8).selectExpr("java_method('java.lang.Thread', 'sleep', 20000L) as x")))
    registry.add(Analysis("after", lambda s, d: s.range(1), depends=("broken",)))
    began = time.monotonic()
    job = registry.run(spark, "", "slow", limit=1.5)
    assert job["state"] == "timeout" and time.monotonic() - began < 15
    registry.save_preset("base", "five", {"n": "5"})
    job = registry.run(spark, "", "base", preset="five", results=f"file://{tmp_path}/results")
    assert job["rows"] == 5 and spark.read.schema("id long").json(f"file://{tmp_path}/results/base").count() == 5
    assert [j["state"] for j in registry.run_all(spark, "", ["after"])] == ["failed", "skipped"]
    registry.quarantine("base", "no reason")
    registry.ledger(str(tmp_path / "ledger.txt"), "night")
    registry.record(str(tmp_path / "golden.json"))
    again = Registry()
    again.analyses = registry.analyses
    again.attach(folder)
    assert again.preset("base", "five") == {"n": 5} and again.quarantined == {"base": "no reason"} and again.jobs == registry.jobs
    assert again.compare(again.jobs[1], Registry.recorded(str(tmp_path / "golden.json"))) == "identical"
    assert "timeout: 1" in (tmp_path / "ledger.txt").read_text()
    again.quarantined.clear()
    done = len(again.jobs)
    again.run(spark, "", "base")
    assert [j["id"] for j in again.run_all(spark, "", ["base"], resume=True)] == [done]


def test_a_report_is_captured(tmp_path, capsys):
    from quillon.registry import captured

    with captured(str(tmp_path / "report.txt")):
        print("é 1")
    assert (tmp_path / "report.txt").read_text(encoding="utf-8") == "é 1\n" == capsys.readouterr().out


def test_every_dependency_is_registered():
    from quillon import catalog  # noqa: F401

    assert REGISTRY.order(REGISTRY.analyses) and sum(bool(a.depends) for a in REGISTRY.analyses.values()) >= 12
