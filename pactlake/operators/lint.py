"""Lint: every problem of contracts and documents as rows. An empty result means lint passed.

Each document is read once and all its checks are expressions of that one projection. The only
shuffle is the comparison of contract ids between metadata and documents.

Fixed values: the message texts in this module.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pactlake.functions.text import is_blank, trimmed
from pactlake.functions.versions import out_of_range
from pactlake.schemas import MODES, REGISTRY_CONTRACT_ID, STRICT_JSON

VIOLATION = "struct<field_name:string,rule:string,message:string>"
_LIST = f"array<{VIOLATION}>"


def _violation(when: Column, rule: str, *message: Column | str, field: Column | None = None) -> Column:
    """An array with one violation, or an empty one; null conditions count as false."""
    parts = [F.lit(m) if isinstance(m, str) else m for m in message]
    name = F.lit(None).cast("string") if field is None else field
    found = F.struct(
        name.alias("field_name"), F.lit(rule).alias("rule"), F.concat(*parts).alias("message")
    )
    return F.when(when, F.array(found)).otherwise(F.array().cast(_LIST))


def _kind(value: Column) -> Column:
    """OBJECT, ARRAY, STRING, VOID (JSON null), BOOLEAN or a number type; null when absent."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def _metadata_rules() -> list[tuple[str, Column, Column]]:
    """(rule, condition, message) of the metadata's values, in reading order."""
    mode = F.upper(trimmed("compatibility_mode"))
    return [
        (
            "compatibility_mode_missing",
            is_blank("compatibility_mode"),
            F.lit("metadata.yaml must define non-empty 'compatibilityMode'."),
        ),
        (
            "compatibility_mode_invalid",
            ~is_blank("compatibility_mode") & ~mode.isin(*MODES),
            F.concat(
                F.lit("Invalid compatibilityMode '"),
                "compatibility_mode",
                F.lit("'. Allowed: BACKWARD, FORWARD, FULL."),
            ),
        ),
        (
            "owner_team_missing",
            is_blank("owner_team"),
            F.lit("metadata.yaml must define non-empty 'ownerTeam'."),
        ),
        (
            "domain_missing",
            is_blank("domain"),
            F.lit("metadata.yaml must define non-empty 'domain'."),
        ),
    ]


def metadata_error(contracts: DataFrame) -> Column:
    """The first problem of a contract's metadata, null when clean."""
    found = [F.when(wrong, message) for _, wrong, message in _metadata_rules()]
    if "metadata_error" in contracts.columns:
        found = [F.col("metadata_error"), *found]
    return F.coalesce(*found)


def contract_violations(contracts: DataFrame, docs: DataFrame) -> DataFrame:
    """Checks on the contract itself: id, metadata, at least one version."""
    found = with_contract_violations(contracts, docs.select("contract_id").distinct())
    return found.select(
        "contract_id", F.lit(None).cast("string").alias("version"), F.explode("found").alias("v")
    ).select("contract_id", "version", "v.*")


def with_contract_violations(contracts: DataFrame, documented: DataFrame) -> DataFrame:
    """One row per contract that has metadata or documents, with `found`: the array of its violations.

    documented: contract_id, unique, of those with documents; other columns of both sides stay.
    """
    with_docs = documented.withColumn("has_docs", F.lit(True))
    known = contracts.withColumn("has_metadata", F.lit(True))
    if "metadata_error" not in known.columns:
        known = known.withColumn("metadata_error", F.lit(None).cast("string"))
    both = known.join(with_docs, "contract_id", "full")
    has = F.col("has_metadata").isNotNull()
    readable = has & F.col("metadata_error").isNull()
    found = F.concat(
        _violation(
            ~F.col("contract_id").rlike(REGISTRY_CONTRACT_ID),
            "contract_id_format",
            "Invalid contract directory name '",
            F.col("contract_id"),
            "'. Expected lowercase dot-separated format.",
        ),
        _violation(
            ~has,
            "metadata_missing",
            "Missing metadata.yaml in contract directory: ",
            F.col("contract_id"),
        ),
        _violation(
            has & F.col("metadata_error").isNotNull(), "metadata_malformed", F.col("metadata_error")
        ),
        *[_violation(readable & wrong, rule, message) for rule, wrong, message in _metadata_rules()],
        _violation(
            F.col("has_docs").isNull(),
            "no_version_files",
            "No versioned schema files found. Expected files like v1.json.",
        ),
    )
    return both.withColumn("found", found).drop("has_docs", "has_metadata")


def _property_facts(entries: Column) -> Column:
    """What the rules ask of each property (name → body), every kind read once: the kind of a variant
    costs a walk over all of it, so a step binds it before the next uses it several times."""
    parts = F.transform(
        entries,
        lambda e: F.struct(
            e["key"].alias("name"),
            _kind(e["value"]).alias("body_kind"),
            F.try_variant_get(e["value"], "$.type", "variant").alias("type"),
            F.try_variant_get(e["value"], "$.enum", "variant").alias("enum"),
        ),
    )
    return F.transform(
        parts,
        lambda p: F.struct(
            p["name"].alias("name"),
            p["body_kind"].alias("body_kind"),
            _kind(p["type"]).alias("type_kind"),
            F.lower(trimmed(p["type"].try_cast("string"))).alias("type_text"),
            F.transform(p["type"].try_cast("array<variant>"), _kind).alias("entry_kinds"),
            F.filter(
                F.transform(
                    p["type"].try_cast("array<string>"), lambda t: F.lower(trimmed(t))
                ),
                lambda t: t != "null",
            ).alias("names"),
            _kind(p["enum"]).alias("enum_kind"),
            F.transform(p["enum"].try_cast("array<variant>"), _kind).alias("enum_kinds"),
        ),
    )


def _property_violations(facts: Column, file: Column) -> Column:
    name, kind_of_type, type_text = facts["name"], facts["type_kind"], facts["type_text"]
    names, enum_kind, enum_kinds = facts["names"], facts["enum_kind"], facts["enum_kinds"]
    entry_kinds = facts["entry_kinds"]
    joined = F.array_join(F.sort_array(names), "|")
    is_object = facts["body_kind"] == "OBJECT"
    lead = F.concat(F.lit("Property '"), name, F.lit("'"))
    unusable = (kind_of_type == "STRING") & (is_blank(type_text) | (type_text == "unknown"))
    strings_only = ~F.exists(entry_kinds, lambda k: k != "STRING")
    unusable_list = (
        (kind_of_type == "ARRAY")
        & strings_only
        & (F.size(names) > 0)
        & (is_blank(joined) | (joined == "unknown"))
    )
    return F.concat(
        _violation(
            ~is_object, "property_not_object", lead, " must be an object in ", file, ".", field=name
        ),
        _violation(
            is_object & kind_of_type.isNull(),
            "type_missing",
            lead, " in ", file, " must define 'type'.",
            field=name,
        ),
        _violation(
            is_object & ~kind_of_type.isin("STRING", "ARRAY"),
            "type_invalid",
            lead, " in ", file, " has invalid 'type' definition.",
            field=name,
        ),
        _violation(
            is_object & (kind_of_type == "ARRAY") & ~strings_only,
            "type_entry_not_string",
            lead, " in ", file, " has non-string type entry.",
            field=name,
        ),
        _violation(
            is_object & (unusable | unusable_list),
            "type_unknown",
            lead, " in ", file, " must define a valid 'type'.",
            field=name,
        ),
        _violation(
            is_object & enum_kind.isNotNull() & (enum_kind != "ARRAY"),
            "enum_not_array",
            lead, " in ", file, " has invalid 'enum'.",
            field=name,
        ),
        _violation(
            is_object & F.exists(enum_kinds, lambda k: k.isin("OBJECT", "ARRAY")),
            "enum_value_not_scalar",
            lead, " in ", file, " has non-scalar enum value.",
            field=name,
        ),
    )


def with_document_violations(docs: DataFrame) -> DataFrame:
    """Documents with `found`: the array of their violations. One read, no shuffle."""
    rest = docs.columns
    file = F.concat("version", F.lit(".json"))
    # Repeated keys are valid JSON; session.SETTINGS lets the variant parser keep the last one.
    read = docs.select(
        *rest,
        file.alias("file"),
        F.try_parse_json("schema_json").alias("tree"),
        is_blank("schema_json").alias("is_empty"),
        F.from_json("schema_json", "required array<string>", STRICT_JSON).alias("doc"),
    )
    read = read.withColumn("tree_kind", _kind(F.col("tree"))).select(
        *rest,
        "file",
        (F.col("tree").isNotNull() | F.col("is_empty")).alias("is_json"),
        F.coalesce(F.col("tree_kind") == "OBJECT", F.lit(False)).alias("is_object"),
        _kind(F.try_variant_get("tree", "$.required", "variant")).alias("required_kind"),
        _kind(F.try_variant_get("tree", "$.properties", "variant")).alias("properties_kind"),
        F.transform(
            F.try_variant_get("tree", "$.required", "array<variant>"), lambda v: _kind(v)
        ).alias("required_kinds"),
        F.try_variant_get("tree", "$.properties", "map<string,variant>").alias("properties"),
        F.coalesce("doc.required", F.array().cast("array<string>")).alias("required_names"),
    )
    names = F.coalesce(F.map_keys("properties"), F.array().cast("array<string>"))
    ghosts = F.sort_array(F.array_except("required_names", names))
    strings_only = ~F.coalesce(F.exists("required_kinds", lambda k: k != "STRING"), F.lit(False))
    usable = F.col("is_object")
    found = F.concat(
        _violation(
            out_of_range(F.col("version")),
            "version_out_of_range",
            "Version number out of range: ",
            F.col("file"),
        ),
        _violation(
            ~F.col("is_json"), "schema_invalid_json", "Invalid JSON in schema file: ", F.col("file")
        ),
        _violation(
            F.col("is_json") & ~F.col("is_object"),
            "schema_not_object",
            "Schema must be a JSON object: ",
            F.col("file"),
        ),
        _violation(
            usable & F.col("required_kind").isNotNull() & (F.col("required_kind") != "ARRAY"),
            "required_not_array",
            "'required' must be an array in ",
            F.col("file"),
            ".",
        ),
        _violation(
            usable & ~strings_only,
            "required_item_not_string",
            "Each value in 'required' must be a string in ",
            F.col("file"),
            ".",
        ),
        _violation(
            usable & F.col("properties_kind").isNotNull() & (F.col("properties_kind") != "OBJECT"),
            "properties_not_object",
            "'properties' must be an object in ",
            F.col("file"),
            ".",
        ),
        F.when(
            usable & F.col("properties").isNotNull(),
            F.flatten(
                F.transform(
                    _property_facts(F.map_entries("properties")),
                    lambda f: _property_violations(f, F.col("file")),
                )
            ),
        ).otherwise(F.array().cast(_LIST)),
        _violation(
            usable
            & strings_only
            & (F.col("properties_kind").isNull() | (F.col("properties_kind") == "OBJECT"))
            & (F.size(ghosts) > 0),
            "required_unknown_field",
            "'required' references unknown properties in ",
            F.col("file"),
            ": ",
            F.array_join(ghosts, ", "),
        ),
    )
    return read.select(*rest, found.alias("found"))


def document_violations(docs: DataFrame) -> DataFrame:
    """One row per violation of a schema document."""
    found = with_document_violations(docs.select("contract_id", "version", "schema_json"))
    # Outer plus filter: a plain explode would test the computed array in a filter of its own.
    return (
        found.select("contract_id", "version", F.explode_outer("found").alias("v"))
        .filter(F.col("v").isNotNull())
        .select("contract_id", "version", "v.*")
    )


def _by_reading_order(found: str) -> Column:
    rank = F.create_map(*[F.lit(x) for i, rule in enumerate(DOCUMENT_ORDER) for x in (rule, i)])
    return F.transform(
        found,
        lambda v: F.struct(
            rank[v["rule"]].alias("place"),
            F.coalesce(v["field_name"], F.lit("")).alias("field_name"),
            v["message"].alias("message"),
        ),
    )


def with_document_error(docs: DataFrame) -> DataFrame:
    """Documents with `document_error`: the message a reader would stop at, null when clean."""
    return with_document_violations(docs).select(
        *docs.columns,
        F.array_min(_by_reading_order("found"))["message"].alias("document_error"),
    )


def document_errors(docs: DataFrame) -> DataFrame:
    """contract_id, version, document_error of the bad documents."""
    found = with_document_violations(docs.select("contract_id", "version", "schema_json"))
    first = F.slice(F.sort_array(_by_reading_order("found")), 1, 1)
    return (
        found.select("contract_id", "version", F.explode_outer(first).alias("v"))
        .filter(F.col("v").isNotNull())
        .select("contract_id", "version", F.col("v.message").alias("document_error"))
    )


def lint_contracts(contracts: DataFrame, docs: DataFrame) -> DataFrame:
    """lint_violations(contract_id, version, field_name, rule, message)."""
    return contract_violations(contracts, docs).unionByName(document_violations(docs))


def failing_contracts(violations: DataFrame) -> DataFrame:
    """One row per contract that fails lint, with its violation count."""
    return violations.groupBy("contract_id").agg(F.count(F.lit(1)).alias("violation_count"))


# Order in which a reader meets the problems of one document: the structure of `required`, then
# the properties, then the cross-check, and last the type names.
DOCUMENT_ORDER = (
    "version_out_of_range",
    "schema_invalid_json",
    "schema_not_object",
    "required_not_array",
    "required_item_not_string",
    "properties_not_object",
    "property_not_object",
    "type_missing",
    "type_invalid",
    "type_entry_not_string",
    "enum_not_array",
    "enum_value_not_scalar",
    "required_unknown_field",
    "type_unknown",
)
