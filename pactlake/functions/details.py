"""Columns over stored runs: change lists kept as text, input hashes, log messages."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pactlake.functions.text import is_blank, trimmed
from pactlake.schemas import STRICT_JSON

NO_TEXT = "array<string>"


def no_strings() -> Column:
    return F.array().cast(NO_TEXT)


def parse_details(raw: Column | str) -> Column:
    """A change list: a JSON array, or older text separated by ` | `."""
    text = trimmed(raw)
    looks_json = text.startswith("[") & text.endswith("]")
    # A nested array or object makes the text a non-list, which is then read the older way. Only
    # texts with a second bracket pay for that look.
    rest = F.substring(text, 2, 2147483647)
    kinds = F.transform(
        F.try_parse_json(text).try_cast("array<variant>"), lambda v: F.schema_of_variant(v)
    )
    nested = F.coalesce(
        F.exists(kinds, lambda k: k.startswith("ARRAY") | k.startswith("OBJECT")), F.lit(False)
    )
    suspicious = rest.contains("[") | rest.contains("{")
    as_json = F.from_json(text, NO_TEXT, STRICT_JSON)
    older = F.filter(
        F.transform(F.split(text, r"\s*\|\s*"), trimmed), lambda part: part != ""
    )
    return (
        F.when(is_blank(raw), no_strings())
        .when(looks_json & ~(suspicious & nested), F.coalesce(as_json, older))
        .otherwise(older)
    )


def details_json(items: Column | str) -> Column:
    items = F.col(items) if isinstance(items, str) else items
    return F.to_json(F.coalesce(items, no_strings()))


def input_hash(
    contract_id: Column | str,
    base_version: Column | str,
    candidate_version: Column | str,
    mode: Column | str,
    commit_sha: Column | str,
    triggered_by: Column | str,
    blank_mode: str = "-",
) -> Column:
    """SHA-256 over the six inputs joined by `|`; blanks are written as `-`."""
    parts = [
        (contract_id, "-"),
        (base_version, "-"),
        (candidate_version, "-"),
        (mode, blank_mode),
        (commit_sha, "-"),
        (triggered_by, "-"),
    ]
    safe = [
        F.when(is_blank(c), F.lit(dash)).otherwise(F.col(c) if isinstance(c, str) else c)
        for c, dash in parts
    ]
    return F.sha2(F.concat_ws("|", *safe), 256)


def log_field(message: Column | str, key: str) -> Column:
    """The value of `key=` in a log message; null when absent."""
    message = F.col(message) if isinstance(message, str) else message
    value = r"(.*)\z" if key == "message" else r"(\S+)"
    found = F.regexp_extract(message, rf"(?s)(?:^|\s){key}={value}", 1)
    return F.when(found != "", found)
