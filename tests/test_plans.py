import json

from conftest import STATION_V1, STATION_V2, PACKS

from pactlake.operators.documents import schema_shapes
from pactlake.operators.policy import PolicyPacks
from pactlake.operators.requests import validate_requests
from pactlake.plans.gate import changed_gate, gate_result
from pactlake.plans.registration import register_contracts, register_versions
from pactlake.plans.request_batch import finished_runs, request_outcomes
from pactlake.schemas import CHECK_REQUESTS
from pactlake.sinks import history as sinks

CONTRACTS = (
    "contract_id string, owner_team string, domain string, compatibility_mode string, "
    "policy_pack string"
)
BROKEN = {"properties": {"a": {}}}


def contracts_of(spark, *rows):
    return spark.createDataFrame([(i, "t", "d", m, p) for i, m, p in rows], CONTRACTS)


def requests_of(spark, *rows):
    data = [(f"q{i}", *row) for i, row in enumerate(rows)]
    return spark.createDataFrame(data, CHECK_REQUESTS)


def test_request_errors_in_order(spark):
    df = requests_of(
        spark,
        (" a.b ", "v1", "v2", "full", " ", "ci"),
        (" ", "v1", "v1", "x", None, None),
        ("a/b", "v1", "v2", "FULL", None, "ci"),
        ("a", "1", "v2", "FULL", None, "ci"),
        ("a", "v1", None, "FULL", None, "ci"),
        ("a", "v1", "v1 ", "x", None, "ci"),
        ("a", "v1", "v2", "x", None, None),
        ("a", "v1", "v2", "FULL", None, ""),
    )
    rows = validate_requests(df).collect()
    assert [r.error for r in rows] == [
        None,
        "contractId must not be blank.",
        "contractId must contain only letters, numbers, dots, underscores, or dashes.",
        "baseVersion must match the format v{number}.",
        "candidateVersion must not be blank.",
        "baseVersion must differ from candidateVersion.",
        "mode must be one of BACKWARD, FORWARD, FULL.",
        "triggeredBy must not be blank.",
    ]
    assert (rows[0].contract_id, rows[0].mode, rows[0].commit_sha) == ("a.b", "FULL", None)


def test_request_batch(spark, docs_of):
    docs = docs_of(("o.c", 1, STATION_V1), ("o.c", 2, STATION_V2), ("o.c", 3, BROKEN))
    contracts = contracts_of(spark, ("o.c", "BACKWARD", " STRICT"))
    requests = requests_of(
        spark,
        ("o.c", "v1", "v2", "BACKWARD", None, "ci"),
        ("o.c", "v1", "v2", "BACKWARD", None, "ci"),
        ("o.c", "v1", "v2", "FORWARD", "sha", "ci"),
        ("o.c", "v2", "v1", "BACKWARD", None, "ci"),
        ("gone", "v1", "v2", "FULL", None, "ci"),
        ("o.c", "v1", "v9", "FULL", None, "ci"),
        ("o.c", "v1", "v3", "FULL", None, "ci"),
        ("o.c", "v1", "v1", "FULL", None, "ci"),
    )
    outcomes = request_outcomes(
        requests.union(requests), contracts, schema_shapes(docs), PolicyPacks.parse(PACKS)
    )
    rows = {r.request_id: r for r in outcomes.collect()}
    added = "Enum value added: quality.suspect"
    assert (rows["q0"].status, rows["q0"].breaking_changes) == ("FAIL", [added])
    assert rows["q0"].run_id != rows["q1"].run_id
    assert rows["q2"].breaking_changes[0] == "[FORWARD] Field removed: unit"
    assert rows["q3"].breaking_changes == [
        "Field removed: unit",
        "Enum value removed: quality.suspect",
    ]
    assert rows["q4"].warnings == ["Execution error: IllegalStateException: Contract not found: gone"]
    assert rows["q5"].warnings == [
        "Execution error: IllegalStateException: Schema file does not exist: contracts/o.c/v9.json"
    ]
    assert rows["q6"].warnings == [
        "Execution error: SchemaValidationException: Property 'a' in v3.json must define 'type'."
    ]
    assert (rows["q7"].status, rows["q7"].run_id) == ("REJECTED", None)
    runs = finished_runs(outcomes, "t")
    assert runs.count() == 7
    logs = sinks.lifecycle_logs(outcomes.filter("error is null"), "t", max_retries=2)
    steps = {}
    for r in logs.orderBy("step").collect():
        steps.setdefault(r.run_id, []).append(r.message.split()[0])
    assert steps[rows["q0"].run_id] == ["code=check_run_claimed", "code=check_run_completed"]
    assert len(steps[rows["q4"].run_id]) == 9
    assert steps[rows["q4"].run_id][-1] == "code=check_run_failed"


def test_the_gate_takes_only_the_last_two_documents_apart(spark, docs_of):
    docs = docs_of(("o.c", 1, STATION_V2), ("o.c", 2, STATION_V1), ("o.c", 3, STATION_V1), ("old.fault", 1, BROKEN),
                   ("old.fault", 2, STATION_V1), ("old.fault", 3, STATION_V1), ("odd.text", 1, "{}"), ("odd.text", 2, None))
    names = ("o.c", "old.fault", "odd.text")
    contracts = contracts_of(spark, *[(n, "BACKWARD", None) for n in names])
    files = spark.createDataFrame([(f"contracts/{n}/v1.json",) for n in names], "path string")
    gate = changed_gate(files, contracts, docs, PolicyPacks.parse(PACKS))
    # The fault of a version that is not compared still counts.
    assert {r.contract_id: (r.outcome, r.violation_count > 0) for r in gate.collect()} == {
        "o.c": ("PASS", False), "old.fault": ("LINT_FAILED", True), "odd.text": ("LINT_FAILED", True),
    }
    lines = gate._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    window = next(i for i, line in enumerate(lines) if "Window [row_number()" in line)
    end = next((i for i in range(window + 1, len(lines)) if depth[i] <= depth[window]), len(lines))
    assert end > window + 1
    assert not any("json(" in line for line in lines[window + 1 : end])


def test_changed_gate(spark, docs_of):
    docs = docs_of(
        ("o.c", 1, STATION_V2),
        ("o.c", 2, STATION_V1),
        ("one.version", 1, STATION_V1),
        ("bad.doc", 1, STATION_V1),
        ("bad.doc", 2, BROKEN),
        ("not.changed", 1, STATION_V2),
        ("not.changed", 2, STATION_V1),
    )
    names = ("o.c", "one.version", "bad.doc", "not.changed")
    contracts = contracts_of(spark, *[(n, "FORWARD", None) for n in names])
    paths = ["contracts/o.c/v2.json", "contracts/o.c/v1.json", "contracts/one.version/v1.json",
             "contracts/bad.doc/v2.json", "contracts/removed/v1.json", "docs/x.md",
             "contracts/policy-packs.json"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    packs = PolicyPacks.parse(PACKS)
    gate = changed_gate(files, contracts, docs, packs)
    assert {r.contract_id: (r.outcome, r.passed) for r in gate.collect()} == {
        "o.c": ("FAIL", False),
        "one.version": ("SKIPPED", True),
        "bad.doc": ("LINT_FAILED", False),
    }
    assert tuple(gate_result(gate).first()) == (3, 2, False)
    own = changed_gate(files, contracts, docs, packs, mode=None)
    assert {r.contract_id: r.outcome for r in own.collect()}["o.c"] == "PASS"
    nothing = changed_gate(files.filter("path like 'docs%'"), contracts, docs, packs)
    assert tuple(gate_result(nothing).first()) == (0, 0, True)


def test_register_versions(spark, docs_of):
    registry = docs_of(
        ("o.c", 1, STATION_V1), ("g.g", 1, STATION_V2), ("g.g", 3, STATION_V2),
        ("bad.base", 1, "{not json"), ("bad.mode", 1, STATION_V2), ("no.mode", 1, STATION_V2),
    )
    contracts = contracts_of(
        spark, ("o.c", "BACKWARD", None), ("g.g", "FULL", "relaxed"), ("new.one", "FULL", None),
        ("bad.base", "FULL", None), ("bad.mode", "SIDEWAYS", None), ("no.mode", None, None),
    )
    good = json.dumps(STATION_V2)
    asked = [
        ("o.c", "v2", good),
        ("o.c", "v1", good),
        ("o.c", "v5", good),
        ("g.g", "v2", good),
        ("g.g", "v4", json.dumps(STATION_V1)),
        ("new.one", "v1", good),
        ("new.one", "v2", good),
        ("gone", "v1", good),
        ("o.c ", "v2", json.dumps(BROKEN)),
        ("o.c", "v99999999999", good),
        ("bad.base", "v2", good),
        ("bad.mode", "v2", good),
        ("no.mode", "v2", good),
    ]
    found = {}
    for row in asked:
        candidates = spark.createDataFrame([row], "contract_id string, version string, schema_json string")
        for strict in (True, False):
            r = register_versions(
                candidates, contracts, schema_shapes(registry), PolicyPacks.parse(PACKS), strict
            ).first()
            found[(*row[:2], strict)] = r.reason
    assert found[("o.c", "v2", True)] is None
    assert found[("o.c", "v1", True)] == "Version already exists for contract o.c: v1"
    assert found[("o.c", "v5", True)] == "Version sequence must be incremental. Expected v2."
    assert found[("g.g", "v2", True)] == "New version must be greater than existing latest version v3."
    assert found[("g.g", "v4", True)].startswith(
        "Strict mode rejected version v4. Breaking changes: Field removed: unit; "
    )
    assert found[("g.g", "v4", False)] is None
    assert found[("new.one", "v1", True)] is None
    assert found[("new.one", "v2", True)] == "First contract version must be v1."
    assert found[("gone", "v1", True)] == "Contract not found: gone"
    for strict in (True, False):
        assert found[("o.c", "v99999999999", strict)] == "Version number out of range: v99999999999"
        assert found[("bad.base", "v2", strict)] == "Invalid JSON in schema file: v1.json"
        assert found[("bad.mode", "v2", strict)].startswith("Invalid compatibilityMode 'SIDEWAYS'.")
        assert found[("no.mode", "v2", strict)].endswith("non-empty 'compatibilityMode'.")
    assert found[("o.c ", "v2", True)] == "Property 'a' in v2.json must define 'type'."


def test_a_chain_of_versions_in_one_batch(spark, docs_of):
    registry = docs_of(("a.a", 3, STATION_V1), ("b.b", 3, STATION_V1), ("c.c", 3, STATION_V1), ("d.d", 3, STATION_V2))
    contracts = contracts_of(
        spark, ("a.a", "BACKWARD", None), ("b.b", "BACKWARD", None), ("c.c", "BACKWARD", None), ("d.d", "BACKWARD", None),
        ("e.e", "BACKWARD", None), ("f.f", "BACKWARD", None),
    )
    one, two, bad = json.dumps(STATION_V1), json.dumps(STATION_V2), json.dumps(BROKEN)
    asked = [
        # v5 takes back what v4 brought, which breaks.
        ("a.a", "v6", two), ("a.a", "v4", two), ("a.a", "v5", one),
        ("b.b", "v4", two), ("b.b", "v6", two),
        # A version sent three times, with two documents.
        ("c.c", "v4", two), ("c.c", "v4", two), ("c.c", "v4", two + " "), ("c.c", "v5", two),
        ("d.d", "v4", bad), ("d.d", "v5", two), ("d.d", "v4", bad), ("d.d", "v3", two),
        ("e.e", "v2", two), ("e.e", "v1", one), ("e.e", "v3", two),
        ("f.f", "v2", two), ("f.f", "v3", two),
    ]
    candidates = spark.createDataFrame(asked, "contract_id string, version string, schema_json string").repartition(3)
    found = {}
    for r in register_versions(candidates, contracts, schema_shapes(registry), PolicyPacks.parse(PACKS)).collect():
        found.setdefault((r.contract_id, r.version), []).append((r.accepted, r.base_version, r.check_status, r.reason))
    assert found["a.a", "v4"] == [(True, "v3", "PASS", None)]
    assert found["a.a", "v5"][0][:3] == (False, "v4", "FAIL")
    assert found["a.a", "v5"][0][3].startswith("Strict mode rejected version v5.")
    assert found["a.a", "v6"] == [(False, None, None, "Version sequence must be incremental. Expected v5.")]
    assert found["b.b", "v4"][0][0]
    assert found["b.b", "v6"] == [(False, None, None, "Version sequence must be incremental. Expected v5.")]
    again = (False, None, None, "Version already exists for contract c.c: v4")
    assert sorted(found["c.c", "v4"], key=str) == [again, again, (True, "v3", "PASS", None)]
    assert found["c.c", "v5"][0][0]
    assert {r[3] for r in found["d.d", "v4"]} == {
        "Property 'a' in v4.json must define 'type'.", "Version was sent more than once in this batch: v4."
    }
    assert found["d.d", "v5"][0][3] == "Version sequence must be incremental. Expected v4."
    assert found["d.d", "v3"][0][3] == "Version already exists for contract d.d: v3"
    assert found["e.e", "v1"] == [(True, None, None, None)]
    assert [found["e.e", v][0][0] for v in ("v2", "v3")] == [True, True]
    assert {found["f.f", v][0][3] for v in ("v2", "v3")} == {"First contract version must be v1."}


def test_register_contracts(spark):
    schema = (
        "contract_id string, owner_team string, domain string, compatibility_mode string, "
        "policy_pack string, initial_version string, schema_json string"
    )
    good = json.dumps(STATION_V1)
    asked = spark.createDataFrame(
        [
            (" payments.completed", "t", "d", "full", " ", None, good),
            ("o.c", "t", "d", "FULL", None, "v7", good),
            ("x.y", "t", "d", "FULL", None, "7", good),
            ("x.z", "t", "d", "FULL", None, "v7", "[]"),
            ("x.w", "t", "d", "FULL", None, "v7", json.dumps(BROKEN)),
        ],
        schema,
    )
    rows = register_contracts(asked, contracts_of(spark, ("o.c", "FULL", None))).collect()
    assert {r.contract_id.strip(): r.reason for r in rows} == {
        "payments.completed": None,
        "o.c": "Contract already exists: o.c",
        "x.y": "initialVersion must match the format v{number}.",
        "x.z": "schema must be a JSON object.",
        "x.w": "Property 'a' in v7.json must define 'type'.",
    }
    first = [r for r in rows if r.accepted][0]
    assert (first.initial_version, first.compatibility_mode, first.policy_pack) == ("v1", "FULL", None)
