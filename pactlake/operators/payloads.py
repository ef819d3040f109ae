"""Payload conformance: JSON payloads against the schema of a contract version.

A schema becomes one row with an array of its fields; the payload is parsed once as a variant and
all checks are expressions of that row. No Python, no shuffle of payloads when the schema table
passes Spark's broadcast size check; otherwise a join on (contract, version) whose schema side is
unique, which AQE splits when one contract has most payloads.

Covered: root `type`, and per property `type`, `required`, `enum`, `const`, bounds of numbers, lengths,
sizes and unique items, item types, with `nullable` honoured; at the root also `additionalProperties:
false`, sizes and `dependentRequired`. Any other assertion keyword (references, applicators that
recurse, `pattern`, whose dialect differs) gives a violation of its own, never a silent pass.

A value and its kind are bound once in each step, as reading the kind of a variant walks all of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pactlake.functions.text import trimmed
from pactlake.operators.documents import flag_is_true

# Assertion keywords that the field model does not carry, at the root or in a property.
UNSUPPORTED = (
    "$ref", "$dynamicRef", "allOf", "anyOf", "contains", "dependentSchemas", "else", "if",
    "maxContains", "minContains", "not", "oneOf", "pattern", "patternProperties", "prefixItems",
    "propertyNames", "then", "unevaluatedItems", "unevaluatedProperties",
)
# Keywords carried for a property but not for the root.
PROPERTY_ONLY = (
    "const", "enum", "exclusiveMaximum", "exclusiveMinimum", "items", "maxItems", "maxLength",
    "maximum", "minItems", "minLength", "minimum", "multipleOf", "uniqueItems",
)
# Unsupported inside a property only: the root has its own handling of these.
NESTED_ONLY = ("properties", "required", "additionalProperties", "dependentRequired")
TYPE_NAMES = ("array", "boolean", "integer", "null", "number", "object", "string")

# Violation codes.
PAYLOAD_NULL = "payload_null"
CONTRACT_UNKNOWN = "contract_unknown"
PAYLOAD_MALFORMED = "payload_malformed"
ROOT_TYPE = "root_type"
REQUIRED = "required"
TYPE = "type"
ENUM = "enum"
UNSUPPORTED_KEYWORD = "unsupported_keyword"

_NO_TEXT = "array<string>"


def kind(value: Column) -> Column:
    """OBJECT, ARRAY, STRING, BOOLEAN, VOID (JSON null) or a number type; null when absent."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def _is_number(k: Column) -> Column:
    return k.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")


def _whole(value: Column, k: Column) -> Column:
    """A number with zero fraction counts as an integer, however it is written."""
    number = F.when(
        k == "DECIMAL", value.try_cast("string").rlike(r"^-?[0-9]+([.]0+)?\z")
    ).otherwise(value.try_cast("double") % 1 == 0)
    return (k == "BIGINT") | (_is_number(k) & F.coalesce(number, F.lit(False)))


def _type_matches(value: Column, k: Column, name: Column) -> Column:
    return (
        ((name == "string") & (k == "STRING"))
        | ((name == "number") & _is_number(k))
        | ((name == "integer") & _whole(value, k))
        | ((name == "boolean") & (k == "BOOLEAN"))
        | ((name == "object") & (k == "OBJECT"))
        | ((name == "array") & (k == "ARRAY"))
        | ((name == "null") & (k == "VOID"))
    )


def canonical(value: Column, k: Column) -> Column:
    """Text that is equal exactly when two JSON values are: `1` and `1.0` agree, `1` and `"1"` not.
    k: the value's kind."""
    return (
        F.when(
            _is_number(k),
            F.concat(
                F.lit("n:"),
                F.coalesce(
                    F.when(_whole(value, k), value.try_cast("decimal(38,0)").cast("string")),
                    value.try_cast("double").cast("string"),
                ),
            ),
        )
        .when(k == "STRING", F.concat(F.lit("s:"), value.try_cast("string")))
        .otherwise(F.concat(F.lit("j:"), F.to_json(value)))
    )


def _with_kinds(values: Column) -> Column:
    """Variants as (v, k) with their kinds."""
    return F.transform(values, lambda v: F.struct(v.alias("v"), kind(v).alias("k")))


def _canonical_all(values: Column) -> Column:
    return F.transform(_with_kinds(values), lambda x: canonical(x["v"], x["k"]))


def _type_names(of: Column) -> Column:
    """`type` as a list; null when absent."""
    as_list = F.try_variant_get(of, "$.type", "array<string>")
    as_text = F.try_variant_get(of, "$.type", "string")
    is_list = kind(F.try_variant_get(of, "$.type", "variant")) == "ARRAY"
    return F.transform(
        F.when(is_list, as_list).otherwise(
            F.when(as_text.isNotNull(), F.array(as_text))
        ),
        lambda t: F.lower(trimmed(t)),
    )


def _unsupported(of: Column, extra: tuple[str, ...] = ()) -> Column:
    keys = F.map_keys(of.try_cast("map<string,variant>"))
    return F.coalesce(
        F.array_intersect(keys, F.array(*[F.lit(k) for k in (*UNSUPPORTED, *extra)])),
        F.array().cast(_NO_TEXT),
    )


# Keyword, how its value is read, and the property of a payload value that it bounds.
BOUNDS = (
    ("minimum", "double"),
    ("maximum", "double"),
    ("exclusiveMinimum", "double"),
    ("exclusiveMaximum", "double"),
    ("multipleOf", "decimal(38,12)"),
    ("minLength", "bigint"),
    ("maxLength", "bigint"),
    ("minItems", "bigint"),
    ("maxItems", "bigint"),
    ("uniqueItems", "boolean"),
    ("minProperties", "bigint"),
    ("maxProperties", "bigint"),
)
_BOUNDS_DDL = ",".join(f"{name}:{kind_of}" for name, kind_of in BOUNDS)


def _bounds(of: Column) -> Column:
    return F.struct(
        *[F.try_variant_get(of, f"$.{name}", kind_of).alias(name) for name, kind_of in BOUNDS]
    )


def contract_shapes(docs: DataFrame) -> DataFrame:
    """One row per schema document: root types, fields, and violations any payload will have."""
    tree = docs.select(
        F.col("contract_id"), "version", F.try_parse_json("schema_json").alias("tree")
    )
    properties = F.map_entries(F.try_variant_get("tree", "$.properties", "map<string,variant>"))
    closed = F.try_variant_get("tree", "$.additionalProperties", "boolean")
    open_schema = F.try_variant_get("tree", "$.additionalProperties", "variant").isNotNull()
    rows = tree.select(
        "contract_id",
        "version",
        _type_names(F.col("tree")).alias("root_types"),
        F.concat(
            _unsupported(F.col("tree"), PROPERTY_ONLY),
            # A schema for further members, which is no boolean.
            F.when(open_schema & closed.isNull(), F.array(F.lit("additionalProperties"))).otherwise(
                F.array().cast(_NO_TEXT)
            ),
        ).alias("root_unsupported"),
        F.coalesce(
            F.try_variant_get("tree", "$.required", _NO_TEXT), F.array().cast(_NO_TEXT)
        ).alias("required_names"),
        F.coalesce(~closed, F.lit(False)).alias("closed"),
        F.try_variant_get("tree", "$.minProperties", "bigint").alias("min_members"),
        F.try_variant_get("tree", "$.maxProperties", "bigint").alias("max_members"),
        F.map_entries(
            F.try_variant_get("tree", "$.dependentRequired", f"map<string,{_NO_TEXT}>")
        ).alias("dependent"),
        properties.alias("properties"),
    )

    def field(entry: Column) -> Column:
        body = entry["value"]
        enum = F.try_variant_get(body, "$.enum", "array<variant>")
        const = F.try_variant_get(body, "$.const", "variant")
        items = F.try_variant_get(body, "$.items", "variant")
        item_keys = F.map_keys(items.try_cast("map<string,variant>"))
        only_type = F.coalesce(F.size(F.array_except(item_keys, F.array(F.lit("type")))) == 0, F.lit(False))
        return F.struct(
            entry["key"].alias("name"),
            _type_names(body).alias("types"),
            flag_is_true(F.try_variant_get(body, "$.nullable", "string")).alias("nullable"),
            _canonical_all(enum).alias("allowed"),
            F.get(_canonical_all(F.when(const.isNotNull(), F.array(const))), F.lit(0)).alias("const"),
            F.when(only_type, _type_names(items)).alias("item_types"),
            _bounds(body).alias("bounds"),
            F.concat(
                _unsupported(body, NESTED_ONLY),
                F.when(items.isNotNull() & ~only_type, F.array(F.lit("items"))).otherwise(
                    F.array().cast(_NO_TEXT)
                ),
            ).alias("unsupported"),
        )

    rows = rows.withColumn(
        "fields",
        F.coalesce(
            F.transform("properties", field),
            F.array().cast(
                "array<struct<name:string,types:array<string>,nullable:boolean,allowed:array<string>,"
                f"const:string,item_types:array<string>,bounds:struct<{_BOUNDS_DDL}>,"
                "unsupported:array<string>>>"
            ),
        ),
    )
    unknown_types = F.transform(
        F.filter(
            "fields",
            lambda f: F.coalesce(
                F.exists(f["types"], lambda t: ~t.isin(*TYPE_NAMES)), F.lit(False)
            ),
        ),
        lambda f: _code(UNSUPPORTED_KEYWORD, F.concat(f["name"], F.lit(".type"))),
    )
    inside = F.flatten(
        F.transform(
            "fields",
            lambda f: F.transform(
                f["unsupported"],
                lambda k: _code(UNSUPPORTED_KEYWORD, F.concat(f["name"], F.lit("."), k)),
            ),
        )
    )
    at_root = F.transform("root_unsupported", lambda k: _code(UNSUPPORTED_KEYWORD, k))
    return rows.select(
        "contract_id",
        "version",
        F.struct(
            "root_types",
            "required_names",
            "closed",
            "min_members",
            "max_members",
            "dependent",
            "fields",
            F.concat(at_root, inside, unknown_types).alias("unsupported"),
        ).alias("shape"),
    )


def _code(code: str, subject: Column) -> Column:
    return F.concat(F.lit(f"{code}:"), subject)


def _when(condition: Column, code: str) -> Column:
    return F.when(condition, F.array(F.lit(code))).otherwise(F.array().cast(_NO_TEXT))


def member_checks(f, value: Column, k: Column) -> list[tuple[str, Column]]:
    """(code, whether broken) of every assertion that a field f may make of a value of kind k."""
    bounds = f["bounds"]
    number = F.when(_is_number(k), value.try_cast("double"))
    text = F.when(k == "STRING", F.length(value.try_cast("string")))
    items = F.when(k == "ARRAY", value.try_cast("array<variant>"))
    members = F.when(k == "OBJECT", F.size(value.try_cast("map<string,variant>")))
    exact = F.when(_is_number(k), value.try_cast("decimal(38,12)"))
    strange = F.exists(
        _with_kinds(items), lambda x: ~F.exists(f["item_types"], lambda t: _type_matches(x["v"], x["k"], t))
    )
    repeated = F.size(F.array_distinct(_canonical_all(items))) < F.size(items)
    return [
        (TYPE, f["types"].isNotNull() & ~F.exists(f["types"], lambda t: _type_matches(value, k, t))),
        (ENUM, f["allowed"].isNotNull() & ~F.array_contains(f["allowed"], canonical(value, k))),
        ("const", f["const"].isNotNull() & (f["const"] != canonical(value, k))),
        ("minimum", bounds["minimum"].isNotNull() & (number < bounds["minimum"])),
        ("maximum", bounds["maximum"].isNotNull() & (number > bounds["maximum"])),
        ("exclusiveMinimum", bounds["exclusiveMinimum"].isNotNull() & (number <= bounds["exclusiveMinimum"])),
        ("exclusiveMaximum", bounds["exclusiveMaximum"].isNotNull() & (number >= bounds["exclusiveMaximum"])),
        ("multipleOf", (bounds["multipleOf"] > 0) & (exact % bounds["multipleOf"] != 0)),
        ("minLength", bounds["minLength"].isNotNull() & (text < bounds["minLength"])),
        ("maxLength", bounds["maxLength"].isNotNull() & (text > bounds["maxLength"])),
        ("minItems", bounds["minItems"].isNotNull() & (F.size(items) < bounds["minItems"])),
        ("maxItems", bounds["maxItems"].isNotNull() & (F.size(items) > bounds["maxItems"])),
        ("uniqueItems", F.coalesce(bounds["uniqueItems"], F.lit(False)) & repeated),
        ("items", f["item_types"].isNotNull() & strange),
        ("minProperties", bounds["minProperties"].isNotNull() & (members < bounds["minProperties"])),
        ("maxProperties", bounds["maxProperties"].isNotNull() & (members > bounds["maxProperties"])),
    ]


def _member_violations(m: Column) -> Column:
    """Violations of one member (f: field, v: value, k: kind)."""
    wrong = member_checks(m["f"], m["v"], m["k"])
    return F.array_compact(F.array(*[F.when(broken, _code(code, m["f"]["name"])) for code, broken in wrong]))


def with_violations(payloads: DataFrame, shapes: DataFrame) -> DataFrame:
    """Payload rows plus `valid` and sorted `violations` (`code:subject`)."""
    names = {"contract_id": "shape_contract", "version": "shape_version"}
    keyed = payloads.withColumns(
        {
            "wanted_contract": trimmed("contract_id"),
            "wanted_version": trimmed(F.regexp_replace("version", r"\.json\z", "")),
        }
    )
    joined = keyed.join(
        shapes.withColumnsRenamed(names),
        (F.col("wanted_contract") == F.col("shape_contract"))
        & (F.col("wanted_version") == F.col("shape_version")),
        "left",
    ).withColumn("tree", F.try_parse_json("payload"))
    joined = joined.withColumns(
        {
            "root_kind": kind(F.col("tree")),
            "members": F.col("tree").try_cast("map<string,variant>"),
        }
    )
    present, tree = F.col("members"), F.col("tree")
    shape = F.col("shape")
    # Each member that a field describes: read once, then its kind, then what its kind says.
    members = F.filter(
        F.transform(
            shape["fields"],
            lambda f: F.struct(f.alias("f"), F.element_at(present, f["name"]).alias("v")),
        ),
        lambda m: m["v"].isNotNull(),
    )
    kinds = F.filter(
        F.transform(members, lambda m: F.struct(m["f"], m["v"], kind(m["v"]).alias("k"))),
        lambda m: ~(m["f"]["nullable"] & (m["k"] == "VOID")),
    )
    root_ok = shape["root_types"].isNull() | F.exists(
        shape["root_types"], lambda t: _type_matches(tree, F.col("root_kind"), t)
    )
    missing = F.transform(
        F.filter(shape["required_names"], lambda n: F.element_at(present, n).isNull()),
        lambda n: _code(REQUIRED, n),
    )
    names = F.map_keys(present)
    extra = F.transform(
        F.array_except(names, F.transform(shape["fields"], lambda f: f["name"])),
        lambda n: _code("additionalProperties", n),
    )
    dependent = F.flatten(
        F.transform(
            F.filter(shape["dependent"], lambda d: F.array_contains(names, d["key"])),
            lambda d: F.transform(
                F.array_except(d["value"], names), lambda n: _code("dependentRequired", n)
            ),
        )
    )
    nothing = F.array().cast(_NO_TEXT)
    of_object = F.concat(
        missing,
        F.flatten(F.transform(kinds, _member_violations)),
        F.when(shape["closed"], extra).otherwise(nothing),
        _when(F.size(names) < shape["min_members"], "minProperties"),
        _when(F.size(names) > shape["max_members"], "maxProperties"),
        F.coalesce(dependent, nothing),
    )
    checks = F.concat(
        _when(~root_ok, ROOT_TYPE),
        F.when(F.col("root_kind") == "OBJECT", of_object).otherwise(nothing),
        shape["unsupported"],
    )
    violations = (
        F.when(F.col("payload").isNull(), F.array(F.lit(PAYLOAD_NULL)))
        .when(shape.isNull(), F.array(F.lit(CONTRACT_UNKNOWN)))
        .when(tree.isNull(), F.array(F.lit(PAYLOAD_MALFORMED)))
        .otherwise(F.sort_array(F.array_distinct(checks)))
    )
    return joined.select(*payloads.columns, violations.alias("violations")).select(
        *payloads.columns, (F.size("violations") == 0).alias("valid"), "violations"
    )


def check_payloads(payloads: DataFrame, docs: DataFrame) -> DataFrame:
    return with_violations(payloads, contract_shapes(docs))


def payload_violations(checked: DataFrame) -> DataFrame:
    """Counts per contract, version, code and subject."""
    return (
        checked.select("contract_id", "version", F.explode_outer("violations").alias("v"))
        .filter("v is not null")
        .select(
            "contract_id",
            "version",
            F.substring_index("v", ":", 1).alias("code"),
            F.when(F.col("v").contains(":"), F.regexp_replace("v", "^[^:]*:", "")).alias(
                "subject"
            ),
        )
        .groupBy("contract_id", "version", "code", "subject")
        .agg(F.count(F.lit(1)).alias("payloads"))
    )
