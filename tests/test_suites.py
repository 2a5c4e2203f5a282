import json

import pytest

from opscheck.operators.shipping import missing_trailer
from opscheck.plans.suites import load_suite, run_suite
from tests.fixtures import make, rows


def step(step_id, *sql, **extra):
    return {"id": step_id, "title": step_id.title(),
            "sql_blocks": [{"label": f"{step_id} block {i}", "sql": s} for i, s in enumerate(sql)], **extra}


def take(source, key, target):
    return {"source_query_id": source, "extracted_key": key, "target_param": target}


def statuses(result):
    return {r["check"]: (r["status"], r["n_findings"]) for r in result.statuses.collect()}


def test_chain_parameters_and_shared_views(spark):
    suite = {"title": "T", "environments": ["QA"], "business_units": ["Poultry"], "queries": [
        step("late", "SELECT x FROM big_numbers WHERE x IN (SELECT picked FROM picked)",
             takes=[take("base", "VALUE", "@picked")], reads_temp_tables=["#big_numbers"]),
        step("base", "SELECT id AS x FROM range(10) WHERE id >= :low",
             "SELECT x AS value FROM big_numbers WHERE x < :high UNION ALL SELECT NULL",
             parameters=[{"name": "low", "default": 3}, {"name": "high"}], creates_temp_tables=["#big_numbers"])]}
    result = run_suite(spark, suite, {"high": 5})
    assert statuses(result) == {"base": ("issues_found", 3), "late": ("issues_found", 2)}
    assert rows(result.findings, "check", "detail", "title", "environments") == sorted([
        ("base", "3", "Base", ["QA"]), ("base", "4", "Base", ["QA"]), ("base", "None", "Base", ["QA"]),
        ("late", "3", "Late", ["QA"]), ("late", "4", "Late", ["QA"])], key=repr)
    assert rows(result.summary, "ran", "issues", "overall") == [(2, 2, "issues_found")]
    assert not spark.catalog.listTables(pattern="big_numbers")


def test_empty_upstream_is_an_empty_list(spark):
    suite = {"queries": [step("none", "SELECT id FROM range(0)"),
                         step("next", "SELECT 1 AS one WHERE 1 IN (SELECT p FROM p)", takes=[take("none", "id", "p")])]}
    assert statuses(run_suite(spark, suite)) == {"none": ("ok", 0), "next": ("ok", 0)}


def test_error_skips_all_descendants(spark):
    suite = {"queries": [
        step("bad", "SELECT nothing FROM nowhere"), step("child", "SELECT 1", takes=[take("bad", "x", "p")]),
        step("grandchild", "SELECT 1", takes=[take("child", "x", "q")]), step("apart", "SELECT 1 AS one")]}
    result = run_suite(spark, suite)
    assert statuses(result) == {"bad": ("error", 0), "child": ("skipped", 0), "grandchild": ("skipped", 0),
                                "apart": ("issues_found", 1)}
    assert rows(result.summary, "ran", "errors", "skipped", "overall") == [(2, 1, 2, "error")]


def test_runtime_errors_are_caught_when_results_are_written(spark, tmp_path):
    suite = {"queries": [step("fails", "SELECT CAST(concat('x', id) AS INT) AS n FROM range(3)"),
                         step("child", "SELECT 1", takes=[take("fails", "n", "p")]),
                         step("fine", "SELECT id FROM range(2)")]}
    result = run_suite(spark, suite, results_path=str(tmp_path))
    assert statuses(result) == {"fails": ("error", 0), "child": ("skipped", 0), "fine": ("issues_found", 2)}


@pytest.mark.parametrize("queries, message", [
    ([step("a", "SELECT 1", takes=[take("zzz", "x", "p")])], "unknown step"),
    ([step("a", "SELECT 1", reads_temp_tables=["#t"])], "unknown table"),
    ([step("a", "SELECT 1", takes=[take("b", "x", "p")]), step("b", "SELECT 1", takes=[take("a", "x", "p")])],
     "depend on each other"),
    ([step("a", "SELECT 1"), step("a", "SELECT 1")], "unique")])
def test_broken_suites_raise(spark, queries, message):
    with pytest.raises(ValueError, match=message):
        run_suite(spark, {"queries": queries})


def test_missing_column_is_an_error_of_the_taking_step(spark):
    suite = {"queries": [step("a", "SELECT 1 AS one"), step("b", "SELECT 1", takes=[take("a", "two", "p")])]}
    assert statuses(run_suite(spark, suite))["b"] == ("error", 0)


def test_suite_file_repeats_a_built_in_check(spark, tmp_path):
    make(spark, "shipment_stop_deliveries", ("S1", "D1"), ("S2", "D1"), ("S3", "D2")).write.parquet(str(tmp_path / "stops"))
    make(spark, "shipments", ("S1", None), ("S2", "T"), ("S3", "")).write.parquet(str(tmp_path / "shipments"))
    stops, shipments = (f"parquet.`{tmp_path}/{t}`" for t in ("stops", "shipments"))
    suite = {"title": "Trailers", "queries": [
        step("stops", f"SELECT DISTINCT ShipmentNumber FROM {stops} WHERE DeliveryNumber = :delivery",
             parameters=[{"name": "delivery", "default": "D1"}], gives=["ShipmentNumber"]),
        step("trailers", f"SELECT ShipmentNumber FROM {shipments} WHERE coalesce(TrailerId, '') = '' "
                         "AND ShipmentNumber IN (SELECT ship FROM ship)",
             takes=[take("stops", "shipmentnumber", "@ship")])]}
    path = tmp_path / "suite.json"
    path.write_text(json.dumps(suite, indent=1))
    result = run_suite(spark, load_suite(spark, str(path)))
    built_in = missing_trailer(spark.read.parquet(str(tmp_path / "stops")),
                               spark.read.parquet(str(tmp_path / "shipments")), ["D1"])
    assert rows(result.findings.filter("check = 'trailers'"), "finding_key") == rows(built_in, "ShipmentNumber")


def test_bad_suites_are_reported(spark):
    from opscheck.plans.suites import run_suite, suite_problems

    assert len(suite_problems({})) == 4
    empty = run_suite(spark, {})
    assert empty.statuses.count() == 0 and empty.findings.count() == 0
    spark.range(3).createOrReplaceTempView("taken_name")
    suite = {"title": "t", "queries": [{"id": "no_sql"}, {"id": "no_block", "sql_blocks": []},
                                       {"id": "taken_name", "sql_blocks": [{"sql": "SELECT 1 AS one"}]}]}
    statuses = {r["check"]: r["status"] for r in run_suite(spark, suite).statuses.collect()}
    assert (statuses["no_sql"], statuses["no_block"]) == ("error", "error") and statuses["taken_name"] != "error"
    assert spark.table("taken_name").count() == 3
    spark.catalog.dropTempView("taken_name")


def test_problems_become_statuses(spark):
    suite = {"title": "t", "queries": [
        {"sql_blocks": [{"sql": "SELECT 1 AS one"}]}, step("chain", "SELECT 1", takes=[{"extracted_key": "x", "target_param": "p"}]),
        step("after", "SELECT 1", takes=[take("chain", "x", "p")]), step("half", " ", "SELECT 2 AS two", ""), None,
        step("nameless", "SELECT 1", parameters=[{"default": 1}])]}
    result = run_suite(spark, suite)
    assert statuses(result) == {"query_1": ("error", 0), "chain": ("error", 0), "after": ("skipped", 0),
                                "half": ("issues_found", 1), "query_5": ("error", 0), "nameless": ("error", 0)}
    assert len(result.problems) == 6 and any("without a source" in p for p in result.problems)
    with pytest.raises(ValueError, match="needs an id"):
        run_suite(spark, suite, strict=True)


def test_null_lists_are_empty(spark):
    assert run_suite(spark, {"queries": None, "environments": None}).statuses.count() == 0
    nulls = {"id": "a", "title": None, "sql_blocks": [{"sql": "SELECT 1 AS one", "label": ""}], "takes": None,
             "parameters": None, "creates_temp_tables": None, "reads_temp_tables": None}
    assert statuses(run_suite(spark, {"queries": [nulls]})) == {"a": ("issues_found", 1)}


def shared_suite():
    return {"queries": [
        step("base", "SELECT id, uuid() AS u FROM range(4)", "SELECT u FROM picked", creates_temp_tables=["#picked"]),
        step("other", "SELECT u FROM picked WHERE u IN (SELECT p FROM p)", takes=[take("base", "u", "p")], reads_temp_tables=["#picked"])]}


def test_a_block_with_several_readers_is_computed_once(spark, tmp_path):
    result = run_suite(spark, shared_suite())
    assert statuses(result) == {"base": ("issues_found", 4), "other": ("issues_found", 4)}
    plan = result.steps["other"]._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "Range (" not in plan
    lazy = run_suite(spark, shared_suite(), share=False)
    assert "Range (" in lazy.steps["other"]._jdf.queryExecution().executedPlan().toString()
    at_path = run_suite(spark, shared_suite(), results_path=str(tmp_path))
    assert statuses(at_path)["other"] == ("issues_found", 4) and (tmp_path / "_shared" / "picked").exists()


def test_sources_are_scanned_once(spark, tmp_path):
    """A counter in the scan: files of a shared block are read by one job, however many steps read the block."""
    source = spark.range(50)
    counter = spark.sparkContext.accumulator(0)

    def count(rows):
        for r in rows:
            counter.add(1)
            yield r

    spark.createDataFrame(source.rdd.mapPartitions(count), "id BIGINT").createOrReplaceTempView("counted_source")
    suite = {"queries": [
        step("a", "SELECT id FROM counted_source", "SELECT id FROM wanted WHERE id < 5", creates_temp_tables=["#wanted"]),
        step("b", "SELECT id FROM wanted WHERE id > 40", reads_temp_tables=["#wanted"]),
        step("c", "SELECT count(*) AS n FROM wanted", reads_temp_tables=["#wanted"])]}
    result = run_suite(spark, suite)
    assert statuses(result) == {"a": ("issues_found", 5), "b": ("issues_found", 9), "c": ("issues_found", 1)}
    assert counter.value == 50
    spark.catalog.dropTempView("counted_source")
