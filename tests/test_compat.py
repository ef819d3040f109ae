import json

import pytest
from conftest import STATION_V1, STATION_V2, PACKS

from pactlake.operators.compat import check_compatibility
from pactlake.operators.diff import diff_report, schema_diff
from pactlake.operators.documents import (
    explode_schema,
    schema_shapes,
    shapes_of_fields,
)
from pactlake.operators.ordering import adjacent_pairs
from pactlake.operators.policy import PolicyPacks, policy_violations, rule_errors

ENUM = "Enum value added: quality.suspect"
FORWARD = ["[FORWARD] Field removed: unit", "[FORWARD] Enum value removed: quality.suspect"]


def verdict(spark, docs_of, base, candidate, mode="BACKWARD", pack="baseline", packs=PACKS):
    docs = docs_of(("a.b", 1, base), ("a.b", 2, candidate))
    checks = spark.createDataFrame(
        [("a.b", "v1", "v2", mode, pack)] * 2,
        "contract_id string, base_version string, candidate_version string, mode string, pack string",
    )
    rows = check_compatibility(schema_shapes(docs), checks, PolicyPacks.parse(packs)).collect()
    assert len(rows) == 1
    return rows[0].status, rows[0].breaking_changes, rows[0].warnings


@pytest.mark.parametrize(
    "mode, pack, expected",
    [
        ("BACKWARD", "baseline", ("PASS", [], [ENUM])),
        ("BACKWARD", "strict", ("FAIL", [ENUM], [])),
        ("BACKWARD", "relaxed", ("PASS", [], [])),
        ("FORWARD", "baseline", ("FAIL", FORWARD, [])),
        ("FULL", "baseline", ("FAIL", FORWARD, [ENUM])),
        ("FULL", "strict", ("FAIL", [ENUM, *FORWARD], [])),
    ],
)
def test_added_field_and_enum_value(spark, docs_of, mode, pack, expected):
    assert verdict(spark, docs_of, STATION_V1, STATION_V2, mode, pack) == expected


def test_breaking_changes_in_rule_order(spark, docs_of):
    base = {
        "properties": {
            "depth": {"type": "number"},
            "phase": {"type": "integer", "enum": [1, 2, 3]},
            "tide": {"type": "boolean"},
            "buoy": {"type": "string"},
        }
    }
    candidate = {
        "properties": {
            "depth": {"type": "string"},
            "phase": {"type": "integer", "enum": [1, 3]},
            "datum": {"type": "string"},
        },
        "required": ["datum"],
    }
    assert verdict(spark, docs_of, base, candidate) == (
        "FAIL",
        [
            "Field removed: buoy",
            "Field removed: tide",
            "Field type changed: depth (number -> string)",
            "Required field added: datum",
            "Enum value removed: phase.2",
        ],
        [],
    )


def test_nullability_counts_as_type_and_no_widening(spark, docs_of):
    base = {"properties": {"a": {"type": "integer"}, "b": {"type": "string"}}}
    candidate = {"properties": {"a": {"type": "number"}, "b": {"type": ["null", "String"]}}}
    assert verdict(spark, docs_of, base, candidate)[1] == [
        "Field type changed: a (integer -> number)",
        "Field type changed: b (string -> string|null)",
    ]


def test_enum_appearing_and_dropped(spark, docs_of):
    base = {"properties": {"a": {"type": "string"}, "b": {"type": "string", "enum": ["x", "y"]}}}
    candidate = {"properties": {"a": {"type": "string", "enum": [1, None]}, "b": {"type": "string"}}}
    assert verdict(spark, docs_of, base, candidate) == (
        "FAIL",
        ["Enum value removed: b.x", "Enum value removed: b.y"],
        ["Enum value added: a.1", "Enum value added: a.null"],
    )


def test_required_removed_breaks_only_forward(spark, docs_of):
    base = {"properties": {"a": {"type": "string"}}, "required": ["a"]}
    candidate = {"properties": {"a": {"type": "string"}}}
    assert verdict(spark, docs_of, base, candidate) == ("PASS", [], [])
    assert verdict(spark, docs_of, base, candidate, "FORWARD")[1] == [
        "[FORWARD] Required field added: a"
    ]


def test_what_cannot_be_judged_is_an_error(spark, docs_of):
    docs = docs_of(("a.b", 1, STATION_V1), ("a.b", 2, STATION_V1), ("a.b", 3, "{not json"), ("a.b", 4, {}))
    checks = spark.createDataFrame(
        [
            ("a.b", "v1", "v2", mode, "baseline") for mode in ("FULL", "SIDEWAYS", None, "BACKWARD\t")
        ] + [("a.b", "v1", c, "FULL", "baseline") for c in ("v3", "v4", "v9")],
        "contract_id string, base_version string, candidate_version string, mode string, pack string",
    )
    rows = check_compatibility(schema_shapes(docs), checks, PolicyPacks.parse(PACKS)).collect()
    found = {(r.candidate_version, r.mode): (r.status, r.error) for r in rows}
    assert found == {
        ("v2", "FULL"): ("PASS", None),
        ("v2", "SIDEWAYS"): ("ERROR", "Unknown compatibility mode: SIDEWAYS"),
        ("v2", None): ("ERROR", "Unknown compatibility mode: none"),
        ("v2", "BACKWARD\t"): ("ERROR", "Unknown compatibility mode: BACKWARD\t"),
        ("v3", "FULL"): ("ERROR", "Invalid JSON in schema file: v3.json"),
        ("v4", "FULL"): ("FAIL", None),
        ("v9", "FULL"): ("ERROR", "Schema file does not exist: a.b/v9.json"),
    }
    assert all(not r.breaking_changes and not r.warnings for r in rows if r.error)
    pairs = checks.select("contract_id", "base_version", "candidate_version")
    errors = [r for r in schema_diff(schema_shapes(docs), pairs).collect() if r.kind == "ERROR"]
    assert sorted(r.candidate_version for r in errors) == ["v3", "v9"]
    report = {r.candidate_version: r.report for r in diff_report(schema_shapes(docs), pairs).collect()}
    assert report["v9"] == "Schema diff:\nError: Schema file does not exist: a.b/v9.json"


def test_empty_documents_pass(spark, docs_of):
    assert verdict(spark, docs_of, {}, {"properties": {}}, "FULL") == ("PASS", [], [])


def test_reordered_document_is_unchanged(spark, docs_of):
    turned = {"properties": dict(reversed(STATION_V1["properties"].items()))}
    turned["required"] = ["quality", "station"]
    assert verdict(spark, docs_of, STATION_V1, turned, "FULL", "strict") == ("PASS", [], [])


def test_diff_rows_and_report(spark, docs_of):
    docs = docs_of(("o.c", 1, STATION_V1), ("o.c", 2, STATION_V2), ("o.c", 4, STATION_V2))
    shapes = schema_shapes(docs)
    pairs = adjacent_pairs(docs)
    found = {(r.candidate_version, r.kind, r.subject) for r in schema_diff(shapes, pairs).collect()}
    assert found == {
        ("v2", "FIELD_ADDED", "unit"),
        ("v2", "ENUM_VALUE_ADDED", "quality.suspect"),
    }
    report = {r.candidate_version: r.report for r in diff_report(shapes, pairs).collect()}
    assert report == {
        "v2": "Schema diff:\n+ field added: unit\n~ enum value added: quality.suspect",
        "v4": "Schema diff:\nNo semantic differences found.",
    }


def test_fields_of_documents(spark, docs_of):
    text = (
        '{"properties":{"a":{"type":"x","type":"y"},"a":{"type":" Z "},'
        '"u":{"type":["number","null","string","number"]},"n":{"type":"null"},'
        '"only":{"type":["null"]},"f":{"type":"string","nullable":"true"},'
        '"e":{"type":"string","enum":[1.0,1e3,null,"x","1.0",true]}},"required":["a"]}'
    )
    docs = docs_of(("a.b", 1, text))
    rows = {
        r.field_name: (r.type, r.required, r.nullable, r.enum_values)
        for r in explode_schema(docs).collect()
    }
    assert rows == {
        "a": ("z", True, False, []),
        "u": ("number|number|string", False, True, []),
        "n": ("null", False, True, []),
        "only": ("null", False, True, []),
        "f": ("string", False, True, []),
        "e": ("string", False, False, ["1.0", "1000.0", "null", "true", "x"]),
    }
    direct = schema_shapes(docs).select("shape").first()[0]
    grouped = shapes_of_fields(explode_schema(docs)).select("shape").first()[0]
    assert sorted(direct) == sorted(grouped)


def test_packs_are_dense_and_resolved(spark):
    packs = PolicyPacks.parse(
        '{"defaultPack":" Strict ","packs":{" STRICT":{"rules":{"enum-value-added":null,"":"IGNORE"}},'
        '"empty":{},"":{}}}'
    )
    assert packs.default == "strict"
    assert set(packs.severities) == {"strict", "empty", "baseline"}
    assert packs.severities["strict"]["ENUM_VALUE_ADDED"] == "BREAKING"
    assert packs.severities["empty"]["ENUM_VALUE_ADDED"] == "WARNING"
    assert packs.rules(spark).count() == 15
    asked = spark.createDataFrame([("empty",), (" EMPTY\t",), ("nope",), (None,)], "p string")
    assert [r[0] for r in asked.select(packs.resolve("p")).collect()] == [
        "empty", "empty", "strict", "strict",
    ]
    assert PolicyPacks.parse(None).severities.keys() == {"baseline"}
    assert PolicyPacks.parse('{"defaultPack":"gone"}').default == "baseline"


def test_bad_policy_stops_the_job():
    with pytest.raises(ValueError, match="Unknown policy rule id: FIELD_GONE"):
        PolicyPacks.parse('{"packs":{"x":{"rules":{"FIELD_GONE":"BREAKING"}}}}')
    assert policy_violations({"packs": {"x": {"rules": {"FIELD_REMOVED": "breaking"}}}}) == [
        ("x", "FIELD_REMOVED", "Unknown severity: breaking")
    ]


def test_policy_problems_as_rows(spark):
    texts = [
        '{"packs":{"x":{"rules":{"FIELD_GONE":"BREAKING","field-removed":"breaking","":"LOUD"}},"y":null}}',
        '{"packs":{"x":{"rules":{" enum_value_added ":null}}}}',
        "{}",
    ]
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "config_id string, text string")
    found = sorted((r.config_id, r.pack, r.rule, r.message) for r in rule_errors(rows).collect())
    assert found == sorted((str(i), *v) for i, t in enumerate(texts) for v in policy_violations(json.loads(t)))
    bad = spark.createDataFrame([("a", "[]"), ("b", None), ("c", "{x")], "config_id string, text string")
    assert {(r.config_id, r.pack) for r in rule_errors(bad).collect()} == {("a", None), ("b", None), ("c", None)}
