import json
import random

import pytest
from pyspark.sql import functions as F

from pactlake.operators.payloads import check_payloads, payload_violations

SCHEMA = {
    "type": "object",
    "properties": {
        "id": {"type": "integer"},
        "kind": {"type": ["string", "null"], "enum": ["a", "b", 1, None]},
        "price": {"type": "number", "nullable": True},
        "tags": {"type": "array"},
        "on": {"type": "boolean", "enum": [True]},
        "any": {},
    },
    "required": ["id", "kind"],
}


def check(spark, docs_of, payloads, doc=SCHEMA):
    texts = [p if isinstance(p, (str, type(None))) else json.dumps(p) for p in payloads]
    df = spark.createDataFrame(
        [("a.b", "v1", str(i), t) for i, t in enumerate(texts)],
        "contract_id string, version string, payload_id string, payload string",
    )
    rows = check_payloads(df, docs_of(("a.b", 1, doc))).collect()
    return [r.violations for r in sorted(rows, key=lambda r: int(r.payload_id))]


def test_missing_required_field(spark, docs_of):
    doc = {"type": "object", "properties": {"station": {"type": "string"}}, "required": ["station"]}
    got = check(spark, docs_of, [{"station": "north pier"}, {"level": 1.5}], doc)
    assert got == [[], ["required:station"]]


def test_kinds(spark, docs_of):
    got = check(
        spark,
        docs_of,
        [
            {"id": 1, "kind": "a"},
            '{"id": 1.0, "kind": null}',
            '{"id": 1e3, "kind": 1.0}',
            {"id": 1.5, "kind": "1"},
            {"id": None, "kind": "a", "price": None, "tags": {}, "on": False},
            None,
            "{bad",
            [1],
            "null",
            '"text"',
            '{"id": 12345678901234567890123, "kind": "a", "price": 1e300, "tags": [], "on": true}',
        ],
    )
    assert got == [
        [],
        [],
        ["type:kind"],
        ["enum:kind", "type:id"],
        ["enum:on", "type:id", "type:tags"],
        ["payload_null"],
        ["payload_malformed"],
        ["root_type"],
        ["root_type"],
        ["root_type"],
        [],
    ]


def test_unsupported_keywords_never_pass_silently(spark, docs_of):
    doc = {
        "additionalProperties": {"type": "string"},
        "minimum": 3,
        "properties": {
            "a": {"type": "date"},
            "b": {"type": "string", "pattern": "x"},
            "c": {"items": {"minimum": 1}},
            "d": {"properties": {}},
        },
    }
    assert check(spark, docs_of, [{}], doc) == [
        [
            "unsupported_keyword:a.type",
            "unsupported_keyword:additionalProperties",
            "unsupported_keyword:b.pattern",
            "unsupported_keyword:c.items",
            "unsupported_keyword:d.properties",
            "unsupported_keyword:minimum",
        ]
    ]


def test_bounds_apply_to_their_own_kind_only(spark, docs_of):
    doc = {
        "properties": {
            "a": {"minimum": 2, "minLength": 2, "minItems": 2, "minProperties": 2, "uniqueItems": True},
            "m": {"multipleOf": 0.1, "nullable": True, "const": None},
        }
    }
    payloads = [{"a": v} for v in (1, "x", [1], {"k": 1}, 2, "xy", [1, 1.0], [1, "1"], {"k": 1, "l": 2}, True, None)]
    got = check(spark, docs_of, [*payloads, {"m": 0.3}, {"m": 0.35}, {"m": None}], doc)
    assert got == [
        ["minimum:a"], ["minLength:a"], ["minItems:a"], ["minProperties:a"], [], [], ["uniqueItems:a"],
        [], [], [], [], ["const:m"], ["const:m", "multipleOf:m"], [],
    ]


def test_unknown_contract_and_version_text(spark, docs_of):
    df = spark.createDataFrame(
        [(" a.b", " v1.json", "1", "{}"), ("a.b", "v2", "2", "{}"), ("x", "v1", "3", None)],
        "contract_id string, version string, payload_id string, payload string",
    )
    checked = check_payloads(df, docs_of(("a.b", 1, {})))
    assert {r.payload_id: r.violations for r in checked.collect()} == {
        "1": [],
        "2": ["contract_unknown"],
        "3": ["payload_null"],
    }
    counts = payload_violations(checked).groupBy().agg(F.sum("payloads")).first()[0]
    assert counts == 2


def _expected(payload):
    """The same rules, one payload at a time, in plain Python."""
    names = {
        "string": lambda v: isinstance(v, str),
        "null": lambda v: v is None,
        "integer": lambda v: not isinstance(v, bool) and isinstance(v, (int, float)) and v == int(v),
        "number": lambda v: not isinstance(v, bool) and isinstance(v, (int, float)),
        "array": lambda v: isinstance(v, list),
        "boolean": lambda v: isinstance(v, bool),
    }
    found = [f"required:{n}" for n in SCHEMA["required"] if n not in payload]
    for name, spec in SCHEMA["properties"].items():
        if name not in payload:
            continue
        value = payload[name]
        if spec.get("nullable") and value is None:
            continue
        types = spec.get("type")
        types = [types] if isinstance(types, str) else types
        if types and not any(names[t](value) for t in types):
            found.append(f"type:{name}")
        same = [
            e for e in spec.get("enum", [])
            if e == value and isinstance(e, bool) == isinstance(value, bool)
        ]
        if "enum" in spec and not same:
            found.append(f"enum:{name}")
    return sorted(found)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, docs_of, seed):
    rng = random.Random(seed)
    values = [None, True, False, 0, 1, 1.0, 2.5, -3, "a", "1", "", [], [1], {}, {"x": 1}]
    payloads = [
        {n: rng.choice(values) for n in SCHEMA["properties"] if rng.random() < 0.8}
        for _ in range(300)
    ]
    assert check(spark, docs_of, payloads) == [_expected(p) for p in payloads]
