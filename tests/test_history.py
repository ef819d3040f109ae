import pytest
from pyspark.sql import functions as F

from pactlake.functions.details import details_json, input_hash, log_field, parse_details
from pactlake.functions.text import redact_jdbc_url, trimmed
from pactlake.operators import history, insights
from pactlake.operators.history import RunQuery


def run(run_id, status="PASS", contract="a.b", at="2024-01-01T00:00:00Z", **more):
    return {
        "run_id": run_id,
        "contract_id": contract,
        "base_version": "v1",
        "candidate_version": "v2",
        "status": status,
        "breaking_changes": "[]",
        "warnings": "[]",
        "created_at": at,
        **more,
    }


@pytest.mark.parametrize(
    "raw, expected",
    [
        (None, []),
        (" \t", []),
        ("[]", []),
        ('["a","b | c"]', ["a", "b | c"]),
        ("a | b|  | c ", ["a", "b", "c"]),
        ("[broken", ["[broken"]),
        ("[broken]", ["[broken]"]),
        ('["[FORWARD] Field removed: x"]', ["[FORWARD] Field removed: x"]),
        ('[["x"]|"y"]', ['[["x"]', '"y"]']),
        ('[{"a":1}]', ['[{"a":1}]']),
        ("[1,true]", ["1", "true"]),
    ],
)
def test_parse_details(spark, raw, expected):
    df = spark.createDataFrame([(raw,)], "d string")
    assert df.select(parse_details("d")).first()[0] == expected


def test_details_round_trip(spark):
    df = spark.createDataFrame([(["a", 'q"'],), ([],), (None,)], "d array<string>")
    assert [r[0] for r in df.select(details_json("d")).collect()] == ['["a","q\\""]', "[]", "[]"]


def test_redaction_and_trim(spark):
    urls = {
        "jdbc:postgresql://u:p@h/db?password=s3;x=1": "jdbc:postgresql://***:***@h/db?password=****;x=1",
        "jdbc:sqlite:checks.db": "jdbc:sqlite:checks.db",
        " ": "-",
        None: "-",
    }
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(redact_jdbc_url("u")).collect()] == list(urls.values())
    odd = spark.createDataFrame([("\x00\t a  \n",)], "t string")
    assert odd.select(trimmed("t")).first()[0] == "a "


def test_input_hash_writes_blanks_as_dash(spark):
    import hashlib

    df = spark.createDataFrame([("c", "v1", "v2", None, " ", "ci")], "a string, b string, c string, d string, e string, f string")
    got = df.select(
        input_hash("a", "b", "c", "d", "e", "f"),
        input_hash("a", "b", "c", "d", "e", "f", blank_mode="BACKWARD"),
    ).first()
    assert got[0] == hashlib.sha256(b"c|v1|v2|-|-|ci").hexdigest()
    assert got[1] == hashlib.sha256(b"c|v1|v2|BACKWARD|-|ci").hexdigest()


def test_log_fields(spark):
    df = spark.createDataFrame([("code=x attempt=2 message=a b attempt=9",), ("plain",)], "m string")
    got = df.select(*[log_field("m", k) for k in ("code", "attempt", "message")]).collect()
    assert [tuple(r) for r in got] == [("x", "2", "a b attempt=9"), (None, None, None)]


def test_newest_first_compares_times_not_text(runs_of):
    runs = runs_of(
        run("r1", at="2024-01-01T00:00:00Z"),
        run("r2", at="2024-01-01T00:00:00.500Z"),
        run("r3", at="2024-01-01T00:00:00.500Z"),
    )
    assert [r.run_id for r in history.list_runs(runs).collect()] == ["r3", "r2", "r1"]


def test_paging_and_filters(runs_of):
    runs = runs_of(
        run("r1", "PASS", at="2024-01-01T00:00:01Z", commit_sha="s"),
        run("r2", "FAIL", at="2024-01-01T00:00:02Z"),
        run("r3", "pass", at="2024-01-01T00:00:03Z"),
    )
    first = history.page_runs(runs, RunQuery.of(limit=2)).collect()
    assert [(r.run_id, r.position, r.has_more) for r in first] == [("r3", 1, True), ("r2", 2, True)]
    rest = history.page_runs(runs, RunQuery.of(limit=2, offset=2)).collect()
    assert [(r.run_id, r.has_more) for r in rest] == [("r1", False)]
    passed = history.page_runs(runs, RunQuery.of(contract_id=" a.b ", status=" pass ")).collect()
    assert [r.run_id for r in passed] == ["r3", "r1"]
    assert [r.run_id for r in history.list_runs(runs, commit_sha=" s").collect()] == ["r1"]
    found = history.find_run(runs, " r2 ").collect()
    assert [(r.run_id, r.execution_state) for r in found] == [("r2", "FAILED")]


def test_query_ranges():
    assert RunQuery.of() == RunQuery(None, None, None, 50, 0)
    assert RunQuery.of(" ", "", None).contract_id is None
    for bad in ({"limit": 0}, {"limit": 201}, {"offset": -1}, {"status": "PA SS"}):
        with pytest.raises(ValueError):
            RunQuery.of(**bad)


def test_impact_uses_latest_run_and_consumers(spark, runs_of):
    runs = runs_of(
        run("r1", "PASS", "tide.measured", "2024-01-01T00:00:00Z"),
        run("r2", "FAIL", "tide.measured", "2024-01-02T00:00:00Z", breaking_changes='["Field removed: gauge"]'),
        run("r3", "PASS", "buoy.moved", warnings='["Enum value added: s.X"]'),
    )
    contracts = spark.createDataFrame(
        [("tide.measured", ["harbour-map", "flood-alert"]), ("buoy.moved", []), ("x", None)],
        "contract_id string, consumers array<string>",
    )
    targets = contracts.selectExpr("contract_id", "'v2' version")
    impact = insights.impact_analysis(targets, runs, contracts)
    assert {r.contract_id: (r.risk_level, r.reason) for r in impact.collect()} == {
        "tide.measured": ("HIGH", "Field removed: gauge"),
        "buoy.moved": ("MEDIUM", "Enum value added: s.X"),
        "x": ("LOW", "No historical check run found for this version."),
    }
    names = {(r.contract_id, r.consumer) for r in insights.impact_consumers(impact).collect()}
    assert ("tide.measured", "harbour-map") in names and ("x", None) in names
    badges = insights.contract_badge(contracts, runs).collect()
    assert {r.contract_id: r.message for r in badges} == {
        "tide.measured": "failing", "buoy.moved": "passing", "x": "unknown",
    }


def test_explain_and_guidance(runs_of):
    runs = runs_of(
        run("r1", "FAIL", breaking_changes='["Field type changed: a (string -> integer)"]'),
        run("r2", "FAIL", breaking_changes='["Enum value removed: a.X"]'),
        run("r3", "PASS", warnings='["w"]'),
        run("r4", "FAIL", breaking_changes='["[FORWARD] Field removed: a"]'),
    )
    rows = {r.run_id: r for r in insights.explain_runs(runs).collect()}
    assert rows["r1"].headline == "Field 'a' changed type."
    assert rows["r2"].headline == "A previously allowed enum value was removed."
    assert rows["r3"].explanation == "✅ No Breaking Changes Detected\n\nWarnings:\n- w"
    assert rows["r4"].headline == "[FORWARD] Field removed: a"
    assert rows["r4"].why == insights.WHY_OTHER
    hints = {r.run_id: r.guidance for r in insights.run_guidance(runs).collect()}
    assert hints["r1"] == sorted([insights.HINT_FAILED, insights.HINTS[0][1]])
    assert hints["r3"] == [insights.HINT_NONE]


def test_failure_categories(spark, runs_of):
    runs = runs_of(
        run("r1", "FAIL", " "),
        run("r2", "FAIL", warnings='["Execution error: X"]'),
        run("r3", "PASS"),
    )
    audit = spark.createDataFrame(
        [("CHECK_RUN_CREATE", "FAILURE", None), ("CONTRACT_CREATE", "FAILURE", None)],
        "action string, status string, detail string",
    )
    rows = insights.checks_failed(runs, audit).collect()
    assert {(r.contract_id, r.category, r.failures) for r in rows} == {
        ("unknown", "compatibility_breaking", 1),
        ("a.b", "execution_error", 1),
        ("unknown", "create_error", 1),
    }
    totals = insights.checks_total(runs).groupBy("phase").agg(F.sum("checks")).collect()
    assert dict(map(tuple, totals)) == {"queued": 3, "completed": 3}
