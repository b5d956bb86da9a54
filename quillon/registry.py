"""Registered analyses: typed parameters, dependencies, presets, jobs, verdicts and comparison with recorded results."""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import threading
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

KINDS = ("int", "float", "bool", "str", "json")


@dataclass(frozen=True)
class Param:
    name: str
    default: Any
    kind: str
    doc: str = ""


@dataclass(frozen=True)
class Analysis:
    name: str
    build: Callable[..., DataFrame]
    params: tuple[Param, ...] = ()
    depends: tuple[str, ...] = ()
    oracle: str | None = None
    seconds: float | None = None  # a recorded run, from which the default time limit follows

    def __call__(self, spark: SparkSession, sf_dir: str, **given: Any) -> DataFrame:
        return self.build(spark, sf_dir, **self.values(given))

    def values(self, given: dict[str, Any]) -> dict[str, Any]:
        """All parameters: the given ones coerced to their kinds, the others' defaults. Unknown names are refused."""
        known = {p.name: p for p in self.params}
        if unknown := sorted(set(given) - set(known)):
            raise KeyError(f"{self.name} has no parameter {', '.join(unknown)}")
        return {n: coerce(given[n], p) if n in given else p.default for n, p in known.items()}


def kind_of(value: Any) -> str:
    for kind, types in (("bool", bool), ("int", int), ("float", float), ("str", str)):
        if isinstance(value, types):
            return kind
    return "json"


def coerce(value: Any, param: Param) -> Any:
    """A parameter's value from what a caller gave, text included; ValueError where it doesn't fit the kind."""
    bad = ValueError(f"{param.name}: {value!r} is no {param.kind}")
    try:
        if param.kind == "bool":
            if isinstance(value, str) and value.strip().lower() in ("true", "false", "1", "0"):
                return value.strip().lower() in ("true", "1")
            if not isinstance(value, bool):
                raise bad
            return value
        if param.kind == "int":
            if isinstance(value, bool) or isinstance(value, float) and value != int(value):
                raise bad
            return int(value)
        if param.kind == "float":
            if isinstance(value, bool):
                raise bad
            return float(value)
        if param.kind == "str":
            if not isinstance(value, str):
                raise bad
            return value
        told = json.loads(value) if isinstance(value, str) else value
        container = type(param.default)
        return container(told) if container in (set, tuple, frozenset) else told
    except (TypeError, ValueError):
        raise bad from None


@dataclass
class Registry:
    analyses: dict[str, Analysis] = field(default_factory=dict)
    presets: dict[str, dict[str, dict[str, Any]]] = field(default_factory=dict)
    jobs: list[dict[str, Any]] = field(default_factory=list)
    verdicts: list[dict[str, Any]] = field(default_factory=list)
    quarantined: dict[str, str] = field(default_factory=dict)
    folder: str | None = None

    def add(self, analysis: Analysis) -> None:
        if analysis.name in self.analyses:
            raise ValueError(f"{analysis.name} is registered twice")
        self.analyses[analysis.name] = analysis

    def tests(self) -> list[dict[str, Any]]:
        """What can be run: name, parameters, dependencies, time limit."""
        return [
            {
                "name": a.name,
                "params": [{"name": p.name, "default": p.default, "kind": p.kind, "doc": p.doc} for p in a.params],
                "depends": list(a.depends),
                "timeout": self.timeout(a.name),
            }
            for a in sorted(self.analyses.values(), key=lambda a: a.name)
        ]

    def timeout(self, name: str) -> int:
        """Three times the recorded seconds and a minute, within 2 minutes and an hour; 15 minutes without a record."""
        s = self.analyses[name].seconds
        return 900 if s is None else int(min(3600, max(120, 3 * s + 60)))

    def order(self, names: Iterable[str]) -> list[str]:
        """The names and all that they depend on, each after its dependencies; ValueError on a cycle."""
        out: list[str] = []
        doing: set[str] = set()

        def visit(n: str) -> None:
            if n in out:
                return
            if n in doing:
                raise ValueError(f"{n} depends on itself")
            doing.add(n)
            for d in self.analyses[n].depends:
                visit(d)
            out.append(n)

        for n in names:
            visit(n)
        return out

    def save_preset(self, name: str, preset: str, values: dict[str, Any]) -> None:
        if preset == "defaults":
            raise ValueError("defaults can't be replaced")
        self.presets.setdefault(name, {})[preset] = self.analyses[name].values(values)
        self._keep()

    def delete_preset(self, name: str, preset: str) -> None:
        if preset == "defaults":
            raise ValueError("defaults can't be deleted")
        del self.presets[name][preset]
        self._keep()

    def preset(self, name: str, preset: str = "defaults") -> dict[str, Any]:
        return self.analyses[name].values({}) if preset == "defaults" else self.presets[name][preset]

    def run(
        self, spark: SparkSession, sf_dir: str, name: str, params: dict[str, Any] | None = None, preset: str = "defaults", results: str | None = None, limit: float | None = None
    ) -> dict:
        """Run one analysis and keep its job: id, state, seconds, rows, digest of the result, error.

        A job over its time limit, timeout() unless given, is cancelled and its state is "timeout". With `results`, the
        rows are written there as JSON first, and the digest is that of what was written.
        """
        if name not in self.analyses:
            raise KeyError(f"there is no analysis {name}")
        values = self.analyses[name].values(self.preset(name, preset) | (params or {}))
        job: dict[str, Any] = {"id": len(self.jobs), "name": name, "params": values, "state": "running"}
        self.jobs.append(job)
        if name in self.quarantined:
            self.jobs[job["id"]] = job | {"state": "quarantined", "error": self.quarantined[name]}
            self._keep()
            return self.jobs[job["id"]]
        self._keep()
        group, late, began = f"quillon-{uuid.uuid4().hex}", threading.Event(), time.monotonic()

        def stop() -> None:
            late.set()
            spark.sparkContext.cancelJobGroup(group)

        timer = threading.Timer(self.timeout(name) if limit is None else limit, stop)
        timer.daemon = True
        spark.sparkContext.setJobGroup(group, name, interruptOnCancel=True)
        timer.start()
        try:
            df = self.analyses[name].build(spark, sf_dir, **values)
            if results:
                df.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{results}/{name}")
                df = spark.read.schema(df.schema).json(f"{results}/{name}")
            job |= fingerprint(df) | {"state": "done"}
        except Exception as e:  # a job's failure is its result
            job |= {"state": "timeout" if late.is_set() else "failed", "error": f"{type(e).__name__}: {e}"[:500]}
        finally:
            timer.cancel()
            for key in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
                spark.sparkContext.setLocalProperty(key, None)
        job["seconds"] = round(time.monotonic() - began, 3)
        self.jobs[job["id"]] = job
        self._keep()
        return job

    def run_all(self, spark: SparkSession, sf_dir: str, names: Iterable[str] | None = None, resume: bool = False, results: str | None = None) -> list[dict]:
        """A queue: the named analyses, each after what it depends on; one whose dependency didn't end well is skipped.

        With `resume`, jobs that are done with the same parameters aren't run again.
        """
        out: dict[str, dict] = {}
        for n in self.order(names or sorted(self.analyses)):
            params = self.analyses[n].values({})
            known = next((j for j in reversed(self.jobs) if j["name"] == n and j["state"] == "done" and j["params"] == params), None) if resume else None
            bad = [d for d in self.analyses[n].depends if out.get(d, {}).get("state") != "done"]
            if known:
                out[n] = known
            elif bad:
                out[n] = {"id": len(self.jobs), "name": n, "params": params, "state": "skipped", "error": f"{', '.join(bad)} not done"}
                self.jobs.append(out[n])
                self._keep()
            else:
                out[n] = self.run(spark, sf_dir, n, results=results)
        return list(out.values())

    def attach(self, folder: str) -> Registry:
        """Keep presets, jobs, verdicts and quarantine in a folder from now on, and take over what it holds."""
        os.makedirs(folder, exist_ok=True)
        self.folder = folder
        for part in ("presets", "jobs", "verdicts", "quarantined"):
            path = os.path.join(folder, f"{part}.json")
            if os.path.exists(path):
                with open(path, encoding="utf-8") as f:
                    setattr(self, part, json.load(f))
        for name, own in self.presets.items():  # JSON knows no sets or tuples
            if name in self.analyses:
                self.presets[name] = {k: self.analyses[name].values({n: json.dumps(v) if isinstance(v, list) else v for n, v in p.items()}) for k, p in own.items()}
        for j in self.jobs:  # what was running when the last process ended didn't end
            if j["state"] == "running":
                j |= {"state": "failed", "error": "interrupted"}
        return self

    def _keep(self) -> None:
        if not self.folder:
            return
        for part in ("presets", "jobs", "verdicts", "quarantined"):
            path = os.path.join(self.folder, f"{part}.json")
            with open(f"{path}.part", "w", encoding="utf-8") as f:
                json.dump(getattr(self, part), f, default=sorted, indent=1)
            os.replace(f"{path}.part", path)

    def ledger(self, path: str, title: str) -> None:
        """Append a report of all jobs to a text file: a line each, and how many ended how."""
        states: dict[str, int] = {}
        with open(path, "a", encoding="utf-8") as f:
            f.write(f"# {title}\n")
            for j in self.jobs:
                states[j["state"]] = states.get(j["state"], 0) + 1
                f.write(f"{j['name']}\t{j['state']}\t{j.get('seconds', '')}\t{j.get('rows', '')}\t{j.get('digest', j.get('error', ''))}\n")
            f.write(", ".join(f"{k}: {n}" for k, n in sorted(states.items())) + "\n\n")

    def record(self, path: str) -> None:
        """Write the done jobs as the golden states that later runs are compared with."""
        golden = {j["name"]: {"params": j["params"], "digest": j["digest"], "rows": j["rows"], "seconds": j["seconds"]} for j in self.jobs if j["state"] == "done"}
        with open(path, "w", encoding="utf-8") as f:
            json.dump(golden, f, default=sorted, indent=1)

    @staticmethod
    def recorded(path: str) -> dict[str, dict]:
        with open(path, encoding="utf-8") as f:
            return json.load(f)

    def job(self, number: int) -> dict:
        return self.jobs[number]

    def compare(self, job: dict, recorded: dict[str, dict]) -> str:
        """A job against a recorded one: identical, differs, no_reference, not_comparable_params or _state."""
        if job["state"] != "done":
            return "not_comparable_state"
        if job["name"] not in recorded:
            return "no_reference"
        if job["params"] != recorded[job["name"]]["params"]:
            return "not_comparable_params"
        return "identical" if job["digest"] == recorded[job["name"]]["digest"] else "differs"

    def adjudicate(self, job: dict, gate: bool, verdict: str, metrics: dict[str, float]) -> dict:
        """Record a verdict. One whose gate failed is kept, but counts as no evidence."""
        row = {
            "test": job["name"],
            "params": {k: json.dumps(v, default=sorted) for k, v in job["params"].items()},
            "metrics": {k: float(v) for k, v in metrics.items()},
            "gate": bool(gate),
            "verdict": verdict if gate else "gate_failed",
        }
        self.verdicts.append(row)
        self._keep()
        return row

    def quarantine(self, name: str, reason: str) -> None:
        self.quarantined[name] = reason
        self._keep()

    def verdict_table(self, spark: SparkSession) -> DataFrame:
        schema = "test string, params map<string,string>, metrics map<string,double>, gate boolean, verdict string"
        return spark.createDataFrame([tuple(v.values()) for v in self.verdicts], schema)


@contextlib.contextmanager
def captured(path: str):
    """What is printed in the block goes to a UTF-8 file as well: an analysis's report."""
    import io
    import sys

    class Both(io.TextIOBase):
        def __init__(self, *to):
            self.to = to

        def write(self, text: str) -> int:
            for t in self.to:
                t.write(text)
            return len(text)

    with open(path, "w", encoding="utf-8") as f, contextlib.redirect_stdout(Both(sys.stdout, f)):
        yield


def fingerprint(df: DataFrame) -> dict[str, Any]:
    """Rows and a digest that doesn't depend on their order, by one aggregation over the result."""
    from pyspark.sql import functions as F

    cols = sorted(df.columns)
    line = F.to_json(F.struct(*(F.col(f"`{c}`") for c in cols)), {"ignoreNullFields": "false"})
    found = df.agg(
        F.count("*").alias("rows"),
        F.sum(F.xxhash64(line).cast("decimal(38,0)")).alias("sum"),
        F.bit_xor(F.xxhash64(line)).alias("xor"),
    ).first()
    told = f"{cols}{found.rows}{found.sum}{found.xor}"
    return {"rows": found.rows, "digest": hashlib.sha256(told.encode()).hexdigest()}


REGISTRY = Registry()


def analysis(name: str | None = None, oracle: str | None = None, depends: Iterable[str] = (), **params: Any):
    """Register a function (spark, sf_dir, **params) -> DataFrame; each parameter's kind is that of its default."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        own = tuple(Param(k, v, kind_of(v)) for k, v in params.items())
        REGISTRY.add(Analysis(name or f.__name__, f, own, tuple(depends), oracle))
        return f

    return add
