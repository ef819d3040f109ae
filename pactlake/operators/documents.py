"""Schema documents (JSON text) to fields: as one array per document, or one row per field.

The array form is the working form: a document is one row, as it is one file, and comparing two
versions needs no row per field. Only top-level properties count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pactlake.functions.text import trimmed
from pactlake.functions.versions import out_of_range
from pactlake.operators.lint import with_document_error
from pactlake.schemas import STRICT_JSON

FIELD = (
    "struct<name:string,type:string,required:boolean,nullable:boolean,enum_values:array<string>>"
)
_TEXTS = "array<string>"
_BODY = "type string, nullable string, enum array<string>"


def last_wins(entries: Column) -> Column:
    """Entries with repeated keys reduced to the last of each, as JSON readers do."""
    keys = F.transform(entries, lambda e: e["key"])
    repeated = F.size(F.array_distinct(keys)) < F.size(keys)
    return F.when(
        repeated,
        F.filter(
            entries,
            lambda e, i: ~F.array_contains(F.slice(keys, i + F.lit(2), F.size(keys)), e["key"]),
        ),
    ).otherwise(entries)


def canonical_type(type_text: Column, union: Column) -> Column:
    """Lower-cased type name; a union without its null, sorted and joined by `|`."""
    concrete = F.sort_array(F.filter(union, lambda t: t != "null"))
    joined = F.when(F.size(concrete) == 0, "null").otherwise(F.array_join(concrete, "|"))
    return F.when(union.isNotNull(), joined).otherwise(F.lower(trimmed(type_text)))


def flag_is_true(text: Column) -> Column:
    """JSON truth of `nullable`: true, "true" or a number other than zero."""
    return F.coalesce(trimmed(text) == "true", F.lit(False)) | F.coalesce(
        text.try_cast("double") != 0, F.lit(False)
    )


def enum_texts(values: Column) -> Column:
    texts = F.transform(values, lambda v: F.coalesce(v, F.lit("null")))
    return F.coalesce(F.sort_array(F.array_distinct(texts)), F.array().cast(_TEXTS))


def display_type(type_name: Column, nullable: Column) -> Column:
    return F.when(
        nullable & ~type_name.contains("null"), F.concat(type_name, F.lit("|null"))
    ).otherwise(type_name)


def parse_documents(docs: DataFrame) -> DataFrame:
    """Replace `schema_json` by `fields`, an array of FIELD; no shuffle, each document read once.

    Documents that fail lint should be left out first; unreadable parts simply yield no fields.
    """
    rest = [c for c in docs.columns if c != "schema_json"]
    read = docs.select(
        *rest,
        F.from_json(
            "schema_json", "properties map<string,string>, required array<string>", STRICT_JSON
        ).alias("doc"),
    )
    # Each step binds what the next uses several times, so no property is parsed twice.
    bodies = read.select(
        *rest,
        F.col("doc.required").alias("needed"),
        F.transform(
            last_wins(F.map_entries("doc.properties")),
            lambda e: F.struct(
                e["key"].alias("name"),
                F.from_json(e["value"], _BODY, STRICT_JSON).alias("spec"),
                F.when(
                    e["value"].contains("["),
                    F.from_json(e["value"], "type array<string>", STRICT_JSON)["type"],
                ).alias("types"),
            ),
        ).alias("bodies"),
    )
    typed = bodies.select(
        *rest,
        "needed",
        F.transform(
            "bodies",
            lambda b: F.struct(
                b["name"].alias("name"),
                b["spec"].alias("spec"),
                # A type given as a list; its text starts with a bracket.
                F.when(
                    b["spec"]["type"].startswith("["),
                    F.transform(b["types"], lambda t: F.lower(trimmed(t))),
                ).alias("union"),
            ),
        ).alias("typed"),
    )

    def field(t: Column) -> Column:
        kind = canonical_type(t["spec"]["type"], t["union"])
        nullable = (
            flag_is_true(t["spec"]["nullable"])
            | F.coalesce(F.array_contains(t["union"], "null"), F.lit(False))
            | F.coalesce(kind == "null", F.lit(False))
        )
        return F.struct(
            t["name"].alias("name"),
            kind.alias("type"),
            F.coalesce(F.array_contains("needed", t["name"]), F.lit(False)).alias("required"),
            nullable.alias("nullable"),
            enum_texts(t["spec"]["enum"]).alias("enum_values"),
        )

    return typed.select(
        *rest,
        F.coalesce(F.transform("typed", field), F.array().cast(f"array<{FIELD}>")).alias("fields"),
    )


def explode_schema(docs: DataFrame) -> DataFrame:
    """schema_docs → schema_fields, one row per field."""
    # Outer plus filter: a plain explode would test the computed array in a filter of its own.
    return (
        parse_documents(docs)
        .select("contract_id", "version", "version_num", F.inline_outer("fields"))
        .filter("name is not null")
        .withColumnRenamed("name", "field_name")
    )


def field_text(field: Column) -> Column:
    """A field as one exact text: equal texts mean equal fields, and texts compare by hash."""
    return F.to_json(field)


def schema_shapes(docs: DataFrame) -> DataFrame:
    """Replace `schema_json` by `shape`, the array of the document's field texts, and
    `document_error`. A document that a reader would refuse has the error and no shape.

    Plain documents (plain_shape, made here unless docs bring it) are read in one pass; only the others are
    linted and taken apart member by member, which gives the same shape at many times the cost.
    """
    if "document_error" in docs.columns:
        return _careful_shapes(docs)
    plain = F.col("plain_shape").isNotNull()
    read = docs if "plain_shape" in docs.columns else with_plain_shape(docs)
    read = read.withColumn("schema_json", F.when(~plain, F.col("schema_json")))
    rest = [c for c in docs.columns if c not in ("schema_json", "plain_shape")]
    return _careful_shapes(with_document_error(read)).select(
        *rest,
        F.when(~plain, F.col("document_error")).alias("document_error"),
        F.coalesce("plain_shape", "shape").alias("shape"),
    )


def _careful_shapes(checked: DataFrame) -> DataFrame:
    parsed = parse_documents(checked)
    shape = F.transform("fields", field_text)
    return parsed.select(
        *[c for c in parsed.columns if c != "fields"],
        F.when(F.col("document_error").isNull(), shape).alias("shape"),
    )


# The types that a plain document may use, alone or in a union with null.
PLAIN_TYPES = ("string", "number", "integer", "boolean", "object", "array")
PLAIN_CHARS = 1_000_000
_PLAIN_DDL = (
    "array<struct<properties:map<string,struct<type:string,nullable:string,enum:array<string>>>,"
    "required:array<string>>>"
)
# A member of another kind than the reader asks for.
_MISPLACED = r'"(?:enum|required)"\s*:\s*[^\[\s]|"properties"\s*:\s*[^{\s]'
# The text of a JSON value that is no string.
_NO_STRING = r"^(?:[-0-9\[{]|true$|false$)"


def with_plain_shape(docs: DataFrame) -> DataFrame:
    """Documents with `plain_shape`: the shape of a document that certainly passes lint, else null.

    Without escapes and without strings that begin with a bracket, the text of a member says of which
    kind it is, and a field's text needs no escaping. What is rare (escapes, unusual types, repeated
    properties, other flags, any fault) is left to the careful reading.
    """
    rest = docs.columns
    text = F.col("schema_json")
    legible = (
        (F.length(text) < PLAIN_CHARS)
        & ~text.contains("\\")
        & ~text.contains('"[')
        & ~text.contains('"{')
        & ~text.rlike(_MISPLACED)
        & ~out_of_range(F.col("version"))
    )
    # In brackets, as the reader would not look behind the end of a lone object.
    listed = F.from_json(F.when(legible, F.concat(F.lit("["), text, F.lit("]"))), _PLAIN_DDL, STRICT_JSON)
    first = F.get("docs", F.lit(0))
    read = docs.select(*rest, listed.alias("docs")).select(
        *rest,
        F.when(F.size("docs") == 1, first["properties"]).alias("entries"),
        F.coalesce(first["required"], F.array().cast(_TEXTS)).alias("needed"),
    )
    single = {t: t for t in PLAIN_TYPES}
    unions = {u: t for t in PLAIN_TYPES for u in (f'["{t}","null"]', f'["null","{t}"]')}
    kinds = F.create_map(*[F.lit(x) for pair in {**single, **unions}.items() for x in pair])

    def field(name: Column, spec: Column) -> Column:
        """The text of a field as field_text writes it; null where the property is not plain."""
        kind, flag = kinds[spec["type"]], F.coalesce(spec["nullable"], F.lit("false"))
        nullable = F.when(spec["type"].startswith("["), "true").when(flag.isin("true", "false"), flag)
        values = spec["enum"]
        scalars = ~F.exists(values, lambda v: v.isNull() | v.startswith("[") | v.startswith("{"))
        quoted = F.concat(F.lit('"'), F.array_join(F.sort_array(F.array_distinct(values)), '","'), F.lit('"'))
        enum = F.when(values.isNull() | (F.size(values) == 0), "").when(scalars, quoted)
        return F.concat(
            F.lit('{"name":"'), name,
            F.lit('","type":"'), kind,
            F.lit('","required":'), F.when(F.array_contains("needed", name), "true").otherwise("false"),
            F.lit(',"nullable":'), nullable,
            F.lit(',"enum_values":['), enum, F.lit("]}"),
        )

    shaped = read.select(
        *rest,
        F.map_keys("entries").alias("names"),
        "needed",
        F.transform(F.map_entries("entries"), lambda e: field(e["key"], e["value"])).alias("texts"),
    )
    plain = (
        ~F.exists("texts", lambda t: t.isNull())
        & (F.size(F.array_distinct("names")) == F.size("names"))
        & ~F.exists("needed", lambda n: n.isNull() | n.rlike(_NO_STRING))
        & (F.size(F.array_except("needed", "names")) == 0)
    )
    return shaped.select(*rest, F.when(plain, F.col("texts")).alias("plain_shape"))


def shapes_of_fields(fields: DataFrame) -> DataFrame:
    """The same from schema_fields rows. A group is one document, never more."""
    spec = F.struct(
        F.col("field_name").alias("name"), "type", "required", "nullable", "enum_values"
    )
    return fields.groupBy("contract_id", "version", "version_num").agg(
        F.lit(None).cast("string").alias("document_error"),
        F.collect_list(field_text(spec)).alias("shape"),
    )
