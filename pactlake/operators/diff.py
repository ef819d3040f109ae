"""Semantic diff of schema versions: all pairs in one job.

A pair meets its two documents by two equi-joins on (contract, version), a unique key on the
document side, or for all adjacent versions by one ordered pass (ordering.adjacent_documents).
Everything after that is a projection of one row per pair: hash-based array
differences drop the untouched fields, and only changed ones are looked at. Nothing is grouped,
so no contract, however many versions or checks it has, ends up in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pactlake.operators.documents import FIELD, display_type
from pactlake.schemas import DIFF_SECTIONS, PAIR
from pactlake.session import never_broadcast

CHANGE = "struct<kind:string,subject:string,old_type:string,new_type:string>"
NO_DIFFERENCES = "No semantic differences found."


def no_document(version: str, root: str = "") -> Column:
    """What a reader says of a version that has no document."""
    return F.concat(
        F.lit(f"Schema file does not exist: {root}"),
        "contract_id",
        F.lit("/"),
        version,
        F.lit(".json"),
    )


def with_documents(shapes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs with the documents of both sides, and `error` where one is absent or unreadable.

    Outer joins on a key that is unique on the document side, which is never broadcast. All adjacent
    pairs of a registry are cheaper by ordering.adjacent_documents.
    """

    def side(name: str) -> DataFrame:
        documents = shapes.select(
            "contract_id",
            F.col("version").alias(f"{name}_version"),
            F.col("shape").alias(f"{name}_shape"),
            F.col("document_error").alias(f"{name}_error"),
            F.lit(True).alias(f"{name}_known"),
        )
        return never_broadcast(documents)

    def problem(name: str) -> Column:
        return F.when(F.col(f"{name}_known").isNull(), no_document(f"{name}_version")).otherwise(
            F.col(f"{name}_error")
        )

    return (
        pairs.join(side("base"), ["contract_id", "base_version"], "left")
        .join(side("candidate"), ["contract_id", "candidate_version"], "left")
        .withColumn("error", F.coalesce(problem("base"), problem("candidate")))
        .drop("base_known", "candidate_known", "base_error", "candidate_error")
    )


def align_fields(both: DataFrame) -> DataFrame:
    """Replace `base_shape` and `candidate_shape` by `changed`: the fields that differ, as an array
    of (name, before, after). A projection; other columns stay."""
    rest = [c for c in both.columns if c not in ("base_shape", "candidate_shape")]

    def decoded(there: str, here: str) -> Column:
        return F.transform(F.array_except(there, here), lambda t: F.from_json(t, _FIELD_DDL))

    touched = both.select(
        *rest,
        decoded("base_shape", "candidate_shape").alias("gone"),
        decoded("candidate_shape", "base_shape").alias("came"),
    )
    named = touched.select(
        *rest,
        "gone",
        "came",
        F.transform("gone", lambda f: f["name"]).alias("gone_names"),
        F.transform("came", lambda f: f["name"]).alias("came_names"),
    )
    missing = F.lit(None).cast(FIELD)

    def entry(name: Column, before: Column, after: Column) -> Column:
        return F.struct(name.alias("name"), before.alias("before"), after.alias("after"))

    removed = F.transform(
        F.filter("gone", lambda g: ~F.array_contains("came_names", g["name"])),
        lambda g: entry(g["name"], g, missing),
    )
    others = F.transform(
        "came",
        lambda c: entry(
            c["name"],
            F.get(F.col("gone"), (F.array_position("gone_names", c["name"]) - 1).cast("int")),
            c,
        ),
    )
    return named.select(*rest, F.concat(removed, others).alias("changed"))


_FIELD_DDL = "name string, type string, required boolean, nullable boolean, enum_values array<string>"


def field_changes(name: Column, before: Column, after: Column) -> Column:
    """All changes of one field as an array of (kind, subject, old_type, new_type)."""

    def entry(kind: str, subject: Column, old: Column | None = None, new: Column | None = None):
        nothing = F.lit(None).cast("string")
        return F.struct(
            F.lit(kind).alias("kind"),
            subject.alias("subject"),
            (nothing if old is None else old).alias("old_type"),
            (nothing if new is None else new).alias("new_type"),
        )

    added, removed = before.isNull(), after.isNull()
    kept = ~added & ~removed
    was, now = (F.coalesce(side["required"], F.lit(False)) for side in (before, after))
    type_changed = kept & (
        ~before["type"].eqNullSafe(after["type"]) | (before["nullable"] != after["nullable"])
    )
    old = display_type(before["type"], before["nullable"])
    new = display_type(after["type"], after["nullable"])
    single = F.array(
        F.when(added, entry("FIELD_ADDED", name)),
        F.when(removed, entry("FIELD_REMOVED", name)),
        F.when(type_changed, entry("FIELD_TYPE_CHANGED", name, old, new)),
        F.when(now & ~was, entry("REQUIRED_FIELD_ADDED", name)),
        F.when(was & ~now, entry("REQUIRED_FIELD_REMOVED", name)),
    )

    def enum_delta(kind: str, there: Column, here: Column) -> Column:
        found = F.transform(
            F.array_except(there, here), lambda v: entry(kind, F.concat(name, F.lit("."), v))
        )
        return F.when(kept, found).otherwise(F.array().cast(f"array<{CHANGE}>"))

    return F.concat(
        F.filter(single, lambda c: c.isNotNull()),
        enum_delta("ENUM_VALUE_ADDED", after["enum_values"], before["enum_values"]),
        enum_delta("ENUM_VALUE_REMOVED", before["enum_values"], after["enum_values"]),
    )


def with_changes(both: DataFrame) -> DataFrame:
    """Replace both shapes by all `changes` (an empty array when nothing changed)."""
    aligned = align_fields(both)
    return aligned.select(
        *[c for c in aligned.columns if c != "changed"],
        F.flatten(
            F.transform("changed", lambda f: field_changes(f["name"], f["before"], f["after"]))
        ).alias("changes"),
    )


def pair_changes(shapes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs with all their `changes`, null where `error` says why."""
    return with_changes(with_documents(shapes, pairs))


def schema_diff(shapes: DataFrame, pairs: DataFrame) -> DataFrame:
    """schema_changes rows of the given pairs."""
    return change_rows(pair_changes(shapes, pairs.select(*PAIR).distinct()))


def change_rows(changes: DataFrame) -> DataFrame:
    """One row per change, all kinds in one pass; a pair that cannot be compared has one row of
    kind ERROR."""
    if "error" in changes.columns:
        nothing = F.lit(None).cast("string")
        failed = F.struct(
            F.lit("ERROR").alias("kind"),
            F.col("error").alias("subject"),
            nothing.alias("old_type"),
            nothing.alias("new_type"),
        )
        found = F.when(F.col("error").isNotNull(), F.array(failed)).otherwise(F.col("changes"))
        changes = changes.withColumn("changes", found)
    # Outer plus filter: a plain explode of a computed array makes Spark test it in a filter of its
    # own below, which computes the whole diff twice.
    rows = changes.select(*PAIR, F.explode_outer("changes").alias("change"))
    return rows.filter(F.col("change").isNotNull()).select(
        *PAIR,
        F.col("change.kind").alias("kind"),
        F.col("change.subject").alias("subject"),
        F.when(
            F.col("change.kind") == "FIELD_TYPE_CHANGED",
            F.concat("change.old_type", F.lit(" -> "), "change.new_type"),
        ).alias("detail"),
    )


def change_text(change: Column, mirrored: bool = False) -> Column:
    """The subject as shown to people: `name` or `name (old -> new)`."""
    old, new = change["old_type"], change["new_type"]
    if mirrored:
        old, new = new, old
    return F.when(
        old.isNotNull(),
        F.concat(change["subject"], F.lit(" ("), old, F.lit(" -> "), new, F.lit(")")),
    ).otherwise(change["subject"])


def diff_report(shapes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The text report of the given pairs."""
    return change_report(pair_changes(shapes, pairs.select(*PAIR).distinct()))


def change_report(changes: DataFrame) -> DataFrame:
    """One text per pair, sections in fixed order."""
    section = F.create_map(
        *[F.lit(x) for i, (kind, _) in enumerate(DIFF_SECTIONS) for x in (kind, i)]
    )
    label = F.create_map(*[F.lit(x) for kind, text in DIFF_SECTIONS for x in (kind, text)])
    lines = F.transform(
        F.sort_array(
            F.transform(
                "changes",
                lambda c: F.struct(
                    section[c["kind"]].alias("section"),
                    change_text(c).alias("text"),
                    c["kind"].alias("kind"),
                ),
            )
        ),
        lambda line: F.concat(label[line["kind"]], line["text"]),
    )
    body = F.when(F.size("changes") == 0, F.array(F.lit(NO_DIFFERENCES))).otherwise(lines)
    if "error" in changes.columns:
        failed = F.array(F.concat(F.lit("Error: "), "error"))
        body = F.when(F.col("error").isNotNull(), failed).otherwise(body)
    return changes.select(
        *PAIR,
        F.array_join(F.concat(F.array(F.lit("Schema diff:")), body), "\n").alias("report"),
    )
