"""Whole schemas against a recursive evaluator of the same keywords."""

import itertools
import json
import re

import pytest

from pactlake.operators.nested import check_whole, compile_schemas, plain
from pactlake.operators.payloads import check_payloads

PAYLOADS = "contract_id string, version string, payload_id string, payload string, valid string, node int"
DOCS = "contract_id string, version string, version_num int, schema_json string"

KINDS = {
    "string": lambda v: isinstance(v, str),
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    "integer": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and v == int(v),
    "boolean": lambda v: isinstance(v, bool),
    "object": lambda v: isinstance(v, dict),
    "array": lambda v: isinstance(v, list),
    "null": lambda v: v is None,
}


def same(a, b):
    if isinstance(a, bool) != isinstance(b, bool):
        return False
    return a == b


def errors(schema, value, root, path="#", via="false"):
    """Violations of a value by the definition of each keyword."""
    if schema is True:
        return set()
    if schema is False:
        return {f"{via}:{path}"}
    if schema.get("nullable") and value is None:
        return set()
    out = set()
    number, text = KINDS["number"](value), isinstance(value, str)

    def below(kind, sub, v=value, at=path):
        return errors(sub, v, root, at, kind)

    types = schema.get("type")
    types = [types] if isinstance(types, str) else types
    broken = {
        "type": types is not None and not any(KINDS[t](value) for t in types),
        "enum": "enum" in schema and not any(same(value, e) for e in schema["enum"]),
        "const": "const" in schema and not same(value, schema["const"]),
        "minimum": number and "minimum" in schema and value < schema["minimum"],
        "maximum": number and "maximum" in schema and value > schema["maximum"],
        "minLength": text and "minLength" in schema and len(value) < schema["minLength"],
        "maxLength": text and "maxLength" in schema and len(value) > schema["maxLength"],
        "pattern": text and "pattern" in schema and not re.search(schema["pattern"], value),
        "minItems": isinstance(value, list) and len(value) < schema.get("minItems", 0),
        "minProperties": isinstance(value, dict) and len(value) < schema.get("minProperties", 0),
        "anyOf": "anyOf" in schema and all(below("anyOf", s) for s in schema["anyOf"]),
        "oneOf": "oneOf" in schema and sum(not below("oneOf", s) for s in schema["oneOf"]) != 1,
        "not": "not" in schema and not below("not", schema["not"]),
    }
    out |= {f"{k}:{path}" for k, bad in broken.items() if bad}
    for sub in schema.get("allOf", []):
        out |= below("allOf", sub)
    if "$ref" in schema:
        target = root
        for part in schema["$ref"].split("/")[1:]:
            part = part.replace("~1", "/").replace("~0", "~")
            target = target[int(part) if isinstance(target, list) else part]
        out |= below("$ref", target)
    if "if" in schema:
        branch = "else" if below("if", schema["if"]) else "then"
        out |= below(branch, schema[branch]) if branch in schema else set()
    if isinstance(value, dict):
        at = lambda n: f"{path}/" + n.replace("~", "~0").replace("/", "~1")
        out |= {f"required:{path}/{n}" for n in schema.get("required", []) if n not in value}
        for name, names in schema.get("dependentRequired", {}).items():
            out |= {f"dependentRequired:{path}/{n}" for n in names if name in value and n not in value}
        for name, sub in schema.get("dependentSchemas", {}).items():
            out |= below("dependentSchemas", sub) if name in value else set()
        for name, v in value.items():
            found = False
            if name in schema.get("properties", {}):
                found, _ = True, out.update(below("properties", schema["properties"][name], v, at(name)))
            for pattern, sub in schema.get("patternProperties", {}).items():
                if re.search(pattern, name):
                    found, _ = True, out.update(below("patternProperties", sub, v, at(name)))
            if not found and "additionalProperties" in schema:
                out |= below("additionalProperties", schema["additionalProperties"], v, at(name))
        if "propertyNames" in schema and any(below("propertyNames", schema["propertyNames"], n) for n in value):
            out.add(f"propertyNames:{path}")
    if isinstance(value, list):
        prefix = schema.get("prefixItems", [])
        for i, v in enumerate(value):
            if i < len(prefix):
                out |= below("prefixItems", prefix[i], v, f"{path}/{i}")
            elif "items" in schema:
                out |= below("items", schema["items"], v, f"{path}/{i}")
        if "contains" in schema:
            n = sum(not below("contains", schema["contains"], v) for v in value)
            if n < schema.get("minContains", 1) or n > schema.get("maxContains", n):
                out.add(f"contains:{path}")
    return out


TEXT, WHOLE = {"type": "string", "minLength": 2}, {"type": "integer", "minimum": 0}
SCHEMAS = {
    "tree": {
        "type": "object", "properties": {"name": TEXT, "kids": {"type": "array", "items": {"$ref": "#"}}, "any": True, "no": False},
        "required": ["name"], "additionalProperties": False,
    },
    "refs": {
        "$defs": {"id": {"anyOf": [WHOLE, {"$ref": "#/$defs/code"}]}, "code": {"type": "string", "pattern": "^[A-Z]{2,3}-[0-9]+$"}, "a/b": {"const": 1}},
        "properties": {"id": {"$ref": "#/$defs/id"}, "more": {"type": "object", "additionalProperties": {"$ref": "#/$defs/id"}}, "x/y": {"$ref": "#/$defs/a~1b"}},
    },
    "mixed": {
        "allOf": [{"required": ["a"]}, {"properties": {"a": {"oneOf": [{"type": "integer"}, {"minimum": 5}]}}}],
        "not": {"required": ["bad"]}, "if": {"properties": {"k": {"const": "t"}}, "required": ["k"]},
        "then": {"required": ["t"], "properties": {"t": TEXT}}, "else": {"properties": {"t": {"type": "null"}}},
        "dependentSchemas": {"a": {"minProperties": 2}}, "dependentRequired": {"t": ["k"]},
    },
    "lists": {
        "properties": {
            "pair": {"prefixItems": [TEXT, WHOLE], "items": {"type": "boolean"}, "minItems": 1},
            "some": {"contains": {"type": "integer", "minimum": 3}, "minContains": 2, "maxContains": 3},
            "grid": {"type": "array", "items": {"type": "array", "items": {"type": ["integer", "null"]}}},
        },
        "patternProperties": {"^s_": {"type": "string"}, "_n$": {"type": "number"}}, "propertyNames": {"maxLength": 5},
    },
    "nulls": {"properties": {"a": {"type": "object", "nullable": True, "required": ["b"], "properties": {"b": {"enum": [1, "x", None]}}}}},
    "flag": True,
    "never": False,
}
VALUES = [
    {"name": "ab", "kids": [{"name": "cd", "kids": [{"name": "e"}, {"nome": 1}]}, 3]}, {"name": "ab", "kids": {}}, {"name": "xx", "any": [1], "no": 2},
    {"id": 4, "more": {"p": "AB-1", "q": "ab-1", "r": -1}}, {"id": "ABCD-1", "x/y": 2}, {"x/y": 1, "id": None},
    {"a": 1}, {"a": 7, "b": 1}, {"a": 5.5, "k": "t"}, {"a": "z", "k": "t", "t": "u"}, {"a": 2, "t": None}, {"a": 2, "t": None, "k": "o"}, {"bad": 1, "a": 3.0},
    {"pair": ["ab", 1, True, 2], "some": [3, 4, "x"]}, {"pair": [], "some": [3]}, {"some": [3, 4, 5, 6], "pair": "no"}, {"some": []},
    {"grid": [[1, None], [2.0, "x"], 3], "s_n": "x", "s_": 1, "toolong": 1}, {"grid": [[[]]], "a_n": 1},
    {"a": None}, {"a": {}}, {"a": {"b": "x"}}, {"a": {"b": 2}}, {"a": {"b": None}}, 3, "text", None, [], [1, [2]], True, {}, {"a": {"a": {"a": {}}}},
]


def test_matches_the_evaluator(spark):
    rows, want = [], {}
    for i, ((name, schema), value) in enumerate(itertools.product(SCHEMAS.items(), VALUES)):
        rows.append((f" {name}", "v1.json" if i % 2 else "v1", str(i), json.dumps(value), "x", 1))
        want[str(i)] = sorted(errors(schema, value, schema))
    docs = spark.createDataFrame([(n, "v1", 1, json.dumps(s)) for n, s in SCHEMAS.items()], DOCS)
    rows += [("tree", "v1", "null", None, "x", 1), ("tree", "v1", "bad", "{", "x", 1), ("tree", "v9", "gone", "{}", "x", 1)]
    want |= {"null": ["payload_null"], "bad": ["payload_malformed"], "gone": ["contract_unknown"]}
    got = check_whole(spark, spark.createDataFrame([*rows, rows[0]], PAYLOADS), docs)
    assert got.columns == ["contract_id", "version", "payload_id", "payload", "node", "valid", "violations"]
    got = got.collect()
    assert len(got) == len(rows) + 1
    assert {r.payload_id: r.violations for r in got} == want
    assert all(r.valid == (not r.violations) for r in got)
    assert sum(map(bool, want.values())) > 60 and sum(not x for x in want.values()) > 60


def test_what_is_not_judged_is_said(spark):
    schemas = {
        "remote": {"properties": {"a": {"$ref": "https://example.net/x.json"}}},
        "closed": {"unevaluatedProperties": False},
        "look": {"properties": {"a": {"pattern": "(?=x)"}}},
        "type": {"items": {"type": "text"}},
    }
    docs = spark.createDataFrame([(n, "v1", 1, json.dumps(s)) for n, s in schemas.items()], DOCS)
    rows = spark.createDataFrame([(n, "v1", "1", '{"a": "y"}', "", 1) for n in schemas], PAYLOADS)
    got = {r.contract_id: r.violations for r in check_whole(spark, rows, docs).collect()}
    assert got == {
        "remote": ["unsupported_keyword:#/properties/a/$ref"],
        "closed": ["unsupported_keyword:#/unevaluatedProperties"],
        "look": ["unsupported_keyword:#/properties/a/pattern"],
        "type": ["unsupported_keyword:#/items/type"],
    }


def test_references_in_a_circle_end(spark):
    schema = {"$defs": {"a": {"$ref": "#/$defs/b"}, "b": {"$ref": "#/$defs/a", "type": "object"}}, "$ref": "#/$defs/a"}
    docs = spark.createDataFrame([("c", "v1", 1, json.dumps(schema))], DOCS)
    rows = spark.createDataFrame([("c", "v1", "1", "{}", "", 1), ("c", "v1", "2", "1", "", 1)], PAYLOADS)
    assert {r.payload_id: r.violations for r in check_whole(spark, rows, docs).collect()} == {"1": [], "2": ["type:#"]}


def test_empty_tables(spark):
    docs, rows = spark.createDataFrame([], DOCS), spark.createDataFrame([], PAYLOADS)
    assert check_whole(spark, rows, docs).count() == 0
    one = spark.createDataFrame([("c", "v1", "1", "{}", "", 1)], PAYLOADS)
    assert check_whole(spark, one, docs).first().violations == ["contract_unknown"]


@pytest.mark.parametrize(
    ("pattern", "ok"),
    [("^[A-Z]{2,3}-[0-9]+$", True), ("a|b(c|d(e|f)?)*", True), (r"\d+\.\d{2}", True), ("", True), ("[a", False), ("(", False), ("a{3,2}", False),
     ("*a", False), ("[z-a]", False), ("(?<x>a)", False), ("[[:alpha:]]", False), (r"\p{L}", False), ("a++", False), (r"\1", False)],
)
def test_plain_patterns(spark, pattern, ok):
    row = spark.createDataFrame([(pattern,)], "p string")
    assert row.select(plain(row.p)).first()[0] is ok


def test_flat_check_agrees_where_it_judges(spark):
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 2}, "b": {"enum": ["x"]}}}
    docs = spark.createDataFrame([("c", "v1", 1, json.dumps(schema))], DOCS)
    rows = [("c", "v1", str(i), json.dumps(v), "", 1) for i, v in enumerate([{"a": 1}, {"a": 3, "b": "y"}, {}, {"a": 2.0, "b": "x"}, 5])]
    rows = spark.createDataFrame(rows, PAYLOADS).drop("valid")
    one = {r.payload_id: r.valid for r in check_payloads(rows, docs).collect()}
    assert one == {r.payload_id: r.valid for r in check_whole(spark, rows, docs).collect()}


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_few_documents_are_judged_in_the_row(spark):
    names = [n for n in SCHEMAS if n != "tree"]
    docs = spark.createDataFrame([(n, "v1", 1, json.dumps(SCHEMAS[n])) for n in names] + [("bad", "v1", 1, "{")], DOCS)
    rows, want = [], {}
    for i, (name, value) in enumerate(itertools.product(names, VALUES)):
        rows.append((f"{name} ", "v1.json" if i % 2 else "v1", str(i), json.dumps(value), "x", 1))
        want[str(i)] = sorted(errors(SCHEMAS[name], value, SCHEMAS[name]))
    rows += [("flag", "v1", "null", None, "x", 1), ("flag", "v1", "bad", "{", "x", 1), ("tree", "v1", "gone", "{}", "x", 1), ("bad", "v1", "doc", "{}", "x", 1)]
    want |= {"null": ["payload_null"], "bad": ["payload_malformed"], "gone": ["contract_unknown"], "doc": ["payload_malformed"]}
    payloads = spark.createDataFrame([*rows, rows[0]], PAYLOADS)
    compiled = compile_schemas(spark, docs)
    got = check_whole(spark, payloads, docs, compiled)
    # No visit is shuffled, joined or grouped.
    assert "Join" not in plan_of(got) and "Aggregate" not in plan_of(got)
    found = {r.payload_id: (r.valid, r.violations) for r in got.collect()}
    assert found == {k: (not v, v) for k, v in want.items()}
    assert got.count() == len(rows) + 1
    # The tables give the same.
    tables = check_whole(spark, payloads, docs, compiled._replace(inlined=None))
    assert tables.columns == got.columns
    assert {r.payload_id: (r.valid, r.violations) for r in tables.collect()} == found


def test_odd_schemas_are_judged_alike_in_the_row(spark):
    schemas = {
        "nullable": {"nullable": True, "anyOf": [{"type": "null", "nullable": False}, {"required": ["a"]}], "contains": {"nullable": True, "type": "string"}},
        "deep": {"items": {"items": {"if": {"type": "integer"}, "then": {"minimum": 3}, "else": {"properties": {"a": {"const": None}}}}, "prefixItems": [{"type": ["array", "null"]}]}},
        "old": {"items": [{"const": 1}, {"enum": [None, "x"]}], "uniqueItems": True, "contains": True, "minContains": 0, "maxContains": 2},
        "names": {"properties": {"a.b": {"type": "string"}, "a'b": False, 'q"': {"minimum": 2}, "": {"type": "null"}}, "required": ["a.b", "~/"], "additionalProperties": {"multipleOf": 0.1}},
        "rest": {"patternProperties": {"^a": {"minLength": 2}, "(?=x)": False}, "additionalProperties": {"properties": {"b": False}, "required": ["c"]}},
        "refs": {"$defs": {"a": {"$ref": "#/$defs/b", "minimum": 3}, "b": {"$ref": "#/$defs/a", "type": "integer"}}, "$ref": "#/$defs/a", "oneOf": [{"$ref": "#"}, True]},
        "far": {"properties": {"a": {"$ref": "other.json"}}, "type": ["text", "object"]},
        "wants": {"dependentRequired": {"a": ["b", "b"], "c": []}, "dependentSchemas": {"b": {"not": {"required": ["c"]}}}, "propertyNames": {"pattern": "^[a-c]$"}, "type": []},
    }
    values = VALUES + [
        {"a.b": "x", "~/": 0.3, "z": 0.25}, {"a'b": None, 'q"': 1, "": None}, {"": 1, 'q"': 2}, {"a": "x", "ab": "xx", "x": 1}, {"x": {"b": 1}, "y": {"c": 1}},
        [1, None, 1], [1, "x", 2], [None, [1, 3, "x", {"a": None}, {"a": 1}]], [[[2]], [None, 5, 2]], {"a": 1, "b": 2, "c": 3}, {"a": 1}, 2, 3, 4.0, "x", [None], ["a"],
    ]
    docs = spark.createDataFrame([(n, "v1", 1, json.dumps(s)) for n, s in schemas.items()], DOCS)
    pairs = enumerate(itertools.product(schemas, values))
    payloads = spark.createDataFrame([(n, "v1", str(i), json.dumps(v), "x", 1) for i, (n, v) in pairs], PAYLOADS)
    compiled = compile_schemas(spark, docs)
    assert compiled.inlined
    got = {r.payload_id: r.violations for r in check_whole(spark, payloads, docs, compiled).collect()}
    assert got == {r.payload_id: r.violations for r in check_whole(spark, payloads, docs, compiled._replace(inlined=None)).collect()}
    assert len(got) == len(schemas) * len(values) and sum(not v for v in got.values()) > 30


def test_recursive_and_many_documents_go_by_tables(spark):
    def inlined(*schemas):
        return compile_schemas(spark, spark.createDataFrame([(str(i), "v1", 1, json.dumps(s)) for i, s in enumerate(schemas)], DOCS)).inlined

    assert inlined({"type": "object"})
    assert not inlined(SCHEMAS["tree"])
    assert not inlined(*[{"type": "object"}] * 17)
    assert not inlined({"required": [str(i) for i in range(300)]})
    assert not inlined({"enum": ["x" * 70_000]})
