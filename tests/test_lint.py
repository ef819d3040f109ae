import pytest
from conftest import STATION_V1

from pactlake.operators.lint import (
    document_errors,
    document_violations,
    lint_contracts,
    with_document_error,
)

CONTRACTS = (
    "contract_id string, owner_team string, domain string, compatibility_mode string, "
    "policy_pack string, metadata_error string"
)


def rules(df):
    return {(r.contract_id, r.version, r.rule) for r in df.collect()}


def test_contract_rules(spark, docs_of):
    contracts = spark.createDataFrame(
        [
            ("orders.created", "platform", "commerce", " backward", None, None),
            ("Bad-Name", "a", "b", "FULL", None, None),
            ("no.owner", " ", "b", "FULL", None, None),
            ("no.domain", "a", None, "FULL", None, None),
            ("side.ways", "a", "b", "SIDEWAYS", None, None),
            ("no.mode", "a", "b", "", None, None),
            ("broken.yaml", None, None, None, None, "Invalid YAML in metadata file: metadata.yaml"),
            ("no.versions", "a", "b", "FULL", None, None),
        ],
        CONTRACTS,
    )
    names = [r.contract_id for r in contracts.collect() if r.contract_id != "no.versions"]
    docs = docs_of(*[(name, 1, STATION_V1) for name in [*names, "no.metadata"]])
    assert rules(lint_contracts(contracts, docs)) == {
        ("Bad-Name", None, "contract_id_format"),
        ("no.owner", None, "owner_team_missing"),
        ("no.domain", None, "domain_missing"),
        ("side.ways", None, "compatibility_mode_invalid"),
        ("no.mode", None, "compatibility_mode_missing"),
        ("broken.yaml", None, "metadata_malformed"),
        ("no.versions", None, "no_version_files"),
        ("no.metadata", None, "metadata_missing"),
    }


@pytest.mark.parametrize(
    "text, expected",
    [
        ("{invalid-json}", ["schema_invalid_json"]),
        ("{'a':1}", ["schema_invalid_json"]),
        ("", ["schema_not_object"]),
        (" \n", ["schema_not_object"]),
        ("[]", ["schema_not_object"]),
        ("null", ["schema_not_object"]),
        ('[{"a":1,"a":2}]', ["schema_not_object"]),
        ("{}", []),
        ('{"a":1,"a":2}', []),
        ('{"required":"x"}', ["required_not_array"]),
        ('{"required":null}', ["required_not_array"]),
        ('{"properties":{"a":{"type":"s"}},"required":["a",1]}', ["required_item_not_string"]),
        ('{"properties":[]}', ["properties_not_object"]),
        ('{"properties":{"a":5,"b":"{}"}}', ["property_not_object"] * 2),
        ('{"properties":{"a":{}}}', ["type_missing"]),
        ('{"properties":{"a":{"type":null}}}', ["type_invalid"]),
        ('{"properties":{"a":{"type":{}}}}', ["type_invalid"]),
        ('{"properties":{"a":{"type":["string",3]}}}', ["type_entry_not_string"]),
        ('{"properties":{"a":{"type":" "},"b":{"type":"UNKNOWN"}}}', ["type_unknown"] * 2),
        ('{"properties":{"a":{"type":["unknown","null"]}}}', ["type_unknown"]),
        ('{"properties":{"a":{"type":["null"]},"b":{"type":[]}}}', []),
        ('{"properties":{"a":{"type":"s","enum":"x"}}}', ["enum_not_array"]),
        ('{"properties":{"a":{"type":"s","enum":null}}}', ["enum_not_array"]),
        ('{"properties":{"a":{"type":"s","enum":[1,null,true,"x"]}}}', []),
        ('{"properties":{"a":{"type":"s","enum":[[1]]}}}', ["enum_value_not_scalar"]),
        ('{"required":["ghost"]}', ["required_unknown_field"]),
    ],
)
def test_document_rules(docs_of, text, expected):
    found = document_violations(docs_of(("a.b", 3, text))).collect()
    assert [r.rule for r in found] == expected


def test_first_error_follows_reading_order(docs_of):
    docs = docs_of(
        ("a.b", 1, '{"properties":{"z":{},"a":{"type":"unknown"}},"required":["ghost"]}'),
        ("a.b", 2, STATION_V1),
    )
    expected = {"v1": "Property 'z' in v1.json must define 'type'."}
    assert {r.version: r.document_error for r in document_errors(docs).collect()} == expected
    every = {r.version: r.document_error for r in with_document_error(docs).collect()}
    assert every == {**expected, "v2": None}
