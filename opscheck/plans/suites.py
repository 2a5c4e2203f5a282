"""User-defined check suites: Spark SQL steps with named parameters, value chains and shared results.

A suite is JSON of the shape::

    {"title": ..., "environments": [...], "business_units": [...],
     "queries": [{"id": ..., "title": ..., "description": ...,
                  "sql_blocks": [{"label": ..., "sql": ...}],
                  "parameters": [{"name": ..., "label": ..., "default": ...}],
                  "gives": ["column"],
                  "takes": [{"source_query_id": ..., "extracted_key": ..., "target_param": ...}],
                  "creates_temp_tables": ["name"], "reads_temp_tables": ["name"]}]}

Missing keys have empty defaults, and blank blocks are left out.  A step that cannot run (no SQL, no id, a
chain without its source) has status ``error``.  Inside the SQL of a step

* ``:name`` is a parameter, bound by name;
* a taken value is a one-column view: with target ``bad``, write
  ``IN (SELECT bad FROM bad)``, which Spark plans as a semi join of any size;
* all blocks but the last become views, named by ``creates_temp_tables`` in
  order, else by their label; any later step may read them;
* every finished step is a view under its id.

The rows of the last block are the step's findings.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce
from graphlib import CycleError, TopologicalSorter

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opscheck.functions.text import row_text
from opscheck.operators.keyed import complete
from opscheck.operators.results import RULES, check_status, scenario_summary
from opscheck.session import stored


@dataclass(frozen=True)
class SuiteResult:
    findings: DataFrame
    statuses: DataFrame
    summary: DataFrame
    steps: Mapping[str, DataFrame] = field(default_factory=dict)
    problems: tuple[str, ...] = ()


def load_suite(spark: SparkSession, path: str) -> dict:
    """Read a suite file from any file system Spark reads."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def _view_name(name: str) -> str:
    return re.sub(r"\W+", "_", name.lstrip("#@")).strip("_").lower()


def _created(step: dict) -> list[str]:
    """View names of a step's leading blocks."""
    declared = [_view_name(t) for t in step.get("creates_temp_tables", [])]
    labels = [_view_name(b.get("label", "")) for b in step.get("sql_blocks", [])[:-1]]
    return declared + labels[len(declared):]


def _ordered(steps: list[dict]) -> list[dict]:
    """Steps after everything they take from or read; unknown steps and cycles are errors."""
    by_id = {s["id"]: s for s in steps}
    if len(by_id) != len(steps):
        raise ValueError("step ids must be unique")
    creator = {view: s["id"] for s in steps for view in _created(s)}
    needs = {}
    for step in steps:
        sources = {t["source_query_id"] for t in step.get("takes", [])}
        unknown = sources - by_id.keys()
        if unknown:
            raise ValueError(f"step {step['id']!r} takes from unknown step(s) {sorted(unknown)}")
        for table in step.get("reads_temp_tables", []):
            if _view_name(table) not in creator:
                raise ValueError(f"step {step['id']!r} reads unknown table {table!r}")
            sources.add(creator[_view_name(table)])
        needs[step["id"]] = sources - {step["id"]}
    try:
        order = list(TopologicalSorter(needs).static_order())
    except CycleError as error:
        raise ValueError(f"steps depend on each other: {error.args[1]}") from error
    return [by_id[i] | {"needs": needs[i]} for i in order]


class _Views:
    """Temporary views of one run; views of the session with the same names come back afterwards."""

    def __init__(self, spark: SparkSession):
        self._spark, self._names, self._hidden = spark, [], {}

    def add(self, name: str, df: DataFrame, replace: bool = False) -> None:
        if name in self._names and not replace:
            raise ValueError(f"two results are named {name!r}")
        if name not in self._names and any(t.isTemporary and t.name == name for t in self._spark.catalog.listTables()):
            self._hidden[name] = self._spark.table(name)
        df.createOrReplaceTempView(name)
        self._names.append(name)

    def drop_all(self) -> None:
        for name in self._names:
            self._spark.catalog.dropTempView(name)
        for name, df in self._hidden.items():
            df.createOrReplaceTempView(name)


def _taken(source: DataFrame, key: str, target: str) -> DataFrame:
    """The distinct non-NULL values of a result column, found regardless of case."""
    column = next((c for c in source.columns if c.lower() == key.lower()), None)
    if column is None:
        raise ValueError(f"no column {key!r} among {source.columns}")
    return complete(source.select(F.col(f"`{column}`").alias(target)), target).distinct()


def _blocks(step: Mapping) -> list[dict]:
    return [b for b in step.get("sql_blocks") or [] if (b.get("sql") or "").strip()]


def _checked(suite: Mapping) -> tuple[list[dict], dict[str, str]]:
    """The steps with an id and only their filled blocks, and what keeps some of them from running, by id."""
    steps, problems = [], {}
    for n, query in enumerate(suite.get("queries") or [], 1):
        if not isinstance(query, Mapping):
            query = {}
        step = dict(query) | {"id": query.get("id") or f"query_{n}", "sql_blocks": _blocks(query)}
        step |= {k: step.get(k) or [] for k in ("parameters", "takes", "creates_temp_tables", "reads_temp_tables")}
        if not query.get("id"):
            problems[step["id"]] = f"query {n} needs an id"
        elif not step["sql_blocks"]:
            problems[step["id"]] = f"query {step['id']!r} needs SQL"
        elif any(not t.get(k) for t in step["takes"] for k in ("source_query_id", "extracted_key", "target_param")):
            problems[step["id"]] = f"query {step['id']!r} takes a value without a source, key or target"
        elif any(not p.get("name") for p in step["parameters"]):
            problems[step["id"]] = f"query {step['id']!r} has a parameter without a name"
        if step["id"] in problems:
            step |= {"takes": [], "reads_temp_tables": [], "creates_temp_tables": [], "sql_blocks": []}
        steps.append(step)
    return steps, problems


def suite_problems(suite: Mapping) -> list[str]:
    """What a suite lacks: title, environment, business unit, queries, and what each query needs to run."""
    problems = [f"a suite needs {name}" for name, key in (
        ("a title", "title"), ("an environment", "environments"), ("a business unit", "business_units"),
        ("at least one query", "queries")) if not suite.get(key)]
    return problems + list(_checked(suite)[1].values())


def _readers(steps: list[dict]) -> Counter:
    """How many blocks, chains and outputs read each view and each step's result."""
    texts = [(step["id"], n, block["sql"]) for step in steps for n, block in enumerate(step["sql_blocks"])]
    readers = Counter(_view_name(t["source_query_id"]) for step in steps for t in step["takes"])
    for step in steps:
        readers[_view_name(step["id"])] += 1  # its findings
        for place, name in enumerate([*_created(step), _view_name(step["id"])]):
            named = re.compile(rf"\b{re.escape(name)}\b", re.IGNORECASE)
            readers[name] += sum(bool(named.search(sql)) for at, n, sql in texts if at != step["id"] or n > place)
    return readers


def _run_step(spark: SparkSession, step: dict, args: Mapping, results: dict[str, DataFrame],
              views: _Views, keep: Callable[[str, DataFrame], DataFrame]) -> DataFrame:
    blocks = step["sql_blocks"]
    bound = {p["name"]: args.get(p["name"], p.get("default", "")) for p in step["parameters"]}
    for take in step["takes"]:
        target = _view_name(take["target_param"])
        views.add(target, _taken(results[take["source_query_id"]], take["extracted_key"], target), replace=True)
    for name, block in zip(_created(step), blocks[:-1]):
        views.add(name, keep(name, spark.sql(block["sql"], args=bound)))
    return spark.sql(blocks[-1]["sql"], args=bound)


def run_suite(spark: SparkSession, suite: dict, args: Mapping | None = None,
              results_path: str | None = None, share: bool = True, strict: bool = False) -> SuiteResult:
    """Run a suite and return its findings, statuses, summary and ``problems`` (:func:`suite_problems`).

    A step that cannot run or whose SQL is rejected has status ``error``, and all steps that depend on it, directly or
    not, are ``skipped``.  With ``strict`` a suite with problems raises before anything runs.

    A block or step with two readers or more (blocks, chains, its findings) is written once, below ``results_path`` or in the
    checkpoint folder, and read from there; the rest stays lazy and is planned together with its reader.  ``share=False``
    keeps everything lazy.  With ``results_path`` every step is written; errors at run time are then caught per step too.
    """
    problems = suite_problems(suite)
    if strict and problems:
        raise ValueError("; ".join(problems))
    title = suite.get("title") or ""
    steps, broken = _checked(suite)
    readers = _readers(steps)
    views = _Views(spark)
    results: dict[str, DataFrame] = {}
    failed: dict[str, tuple[str, str]] = {i: ("error", told) for i, told in broken.items()}

    def written(name: str, df: DataFrame) -> DataFrame:
        target = f"{results_path.rstrip('/')}/{name}"
        df.write.mode("overwrite").parquet(target)
        return spark.read.schema(df.schema).parquet(target)

    def keep(name: str, df: DataFrame) -> DataFrame:
        """``df``, written first if several readers need it."""
        if not share or readers[name] < 2:
            return df
        return written(f"_shared/{name}", df) if results_path else stored(df)

    try:
        for step in _ordered(steps):
            if step["id"] in failed:
                continue
            upstream = [s for s in step["needs"] if s in failed]
            if upstream:
                failed[step["id"]] = ("skipped", "Skipped, an upstream step failed")
                continue
            try:
                result = _run_step(spark, step, args or {}, results, views, keep)
                result = written(step["id"], result) if results_path else keep(_view_name(step["id"]), result)
                views.add(_view_name(step["id"]), result)
                results[step["id"]] = result
            except (PySparkException, ValueError) as error:
                failed[step["id"]] = ("error", str(error).splitlines()[0])
    finally:
        views.drop_all()

    titles = {s["id"]: s.get("title") or s["id"] for s in steps}
    found = _suite_findings(spark, results)
    statuses = _suite_statuses(spark, found, list(results), failed)
    labelled = F.col("check")
    if titles:
        labelled = F.create_map(*[F.lit(x) for pair in titles.items() for x in pair])[F.col("check")]
    tags = {
        "environments": tuple(suite.get("environments") or []),
        "business_units": tuple(suite.get("business_units") or []),
    }
    return SuiteResult(
        found.withColumns({"suite": F.lit(title), "title": labelled} | {
            k: F.array(*[F.lit(x) for x in v]).cast("array<string>") for k, v in tags.items()}),
        statuses, scenario_summary(statuses, title, **tags), results, tuple(problems))


def _suite_findings(spark: SparkSession, results: dict[str, DataFrame]) -> DataFrame:
    frames = [
        df.select(F.lit(step).alias("check"), F.lit("*").alias("subject"),
                  F.col(f"`{df.columns[0]}`").cast("string").alias("finding_key"),
                  row_text(df).alias("detail"), F.lit(1).cast("bigint").alias("n_rows"))
        for step, df in results.items()
    ]
    empty = spark.createDataFrame(
        [], "check STRING, subject STRING, finding_key STRING, detail STRING, n_rows BIGINT")
    return reduce(DataFrame.unionByName, frames, empty) if frames else empty


def _suite_statuses(spark: SparkSession, found: DataFrame, ran: list[str],
                    failed: dict[str, tuple[str, str]]) -> DataFrame:
    rows = [(step, "*", status, 0, headline) for step, (status, headline) in failed.items()]
    problems = spark.createDataFrame(
        rows, "check STRING, subject STRING, status STRING, n_findings BIGINT, headline STRING")
    if not ran:
        return problems
    rules = {step: RULES["suite_step"] for step in ran}
    return check_status(None, found, ran, rules).unionByName(problems)
