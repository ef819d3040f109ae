"""Trimming, blank handling and small text normalisers, all as JVM-side columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pactlake.schemas import MODES

# Every character up to U+0020: what trimming removes here (Spark's own trim only drops spaces).
CONTROL_AND_SPACE = "".join(chr(code) for code in range(0x21))
# Further code points that make a text count as blank.
WIDE_SPACE = "".join(
    chr(code)
    for code in (
        0x1680, *range(0x2000, 0x2007), 0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x205F, 0x3000
    )
)


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def trimmed(text: Column | str) -> Column:
    return F.btrim(_col(text), F.lit(CONTROL_AND_SPACE))


def is_blank(text: Column | str) -> Column:
    """True for null, empty and all-whitespace text."""
    text = _col(text)
    return text.isNull() | (F.btrim(text, F.lit(CONTROL_AND_SPACE + WIDE_SPACE)) == "")


def blank_to(text: Column | str, fallback: Column) -> Column:
    return F.when(is_blank(text), fallback).otherwise(trimmed(text))


def blank_to_null(text: Column | str) -> Column:
    return F.when(~is_blank(text), trimmed(text))


def dash_if_blank(text: Column | str) -> Column:
    """Blank becomes '-', anything else is kept untouched."""
    text = _col(text)
    return F.when(is_blank(text), F.lit("-")).otherwise(text)


def tag_value(text: Column | str) -> Column:
    return blank_to(text, F.lit("unknown"))


def normalize_mode(mode: Column | str, fallback: Column) -> Column:
    upper = F.upper(trimmed(mode))
    return F.when(~is_blank(mode) & upper.isin(*MODES), upper).otherwise(fallback)


def execution_state(status: Column | str) -> Column:
    upper = F.upper(_col(status))
    return (
        F.when(upper.isNull(), "UNKNOWN")
        .when(upper == "PASS", "SUCCESS")
        .when(upper == "FAIL", "FAILED")
        .otherwise(upper)
    )


def redact_jdbc_url(url: Column | str) -> Column:
    # What counts as a credential, and the masks.
    masked = F.regexp_replace(_col(url), r"(?i)(password=)[^&;]+", "$1****")
    masked = F.regexp_replace(masked, r"(?s)^(.*?://)[^@]*@", "$1***:***@")
    return F.when(is_blank(url), F.lit("-")).otherwise(masked)


def roles_text(roles: Column | str) -> Column:
    bare = F.transform(
        F.filter(_col(roles), lambda r: r.isNotNull()),
        lambda r: F.regexp_replace(trimmed(r), "^ROLE_", ""),
    )
    kept = F.sort_array(F.array_distinct(F.filter(bare, lambda r: ~is_blank(r))))
    return F.when(F.size(kept) > 0, F.array_join(kept, ",")).otherwise("-")


def consumers_array(text: Column | str) -> Column:
    """Comma text to a list of trimmed names; the list form of metadata needs only clean_names."""
    return clean_names(F.split(_col(text), ","))


def clean_names(names: Column | str) -> Column:
    kept = F.transform(F.filter(_col(names), lambda n: ~is_blank(n)), trimmed)
    return F.coalesce(kept, F.array().cast("array<string>"))
