"""Verdicts: changes of a pair judged under a mode and a policy pack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pactlake.operators.diff import change_text, pair_changes
from pactlake.operators.policy import PolicyPacks
from pactlake.schemas import FORWARD_PREFIX, MIRRORED_KIND, MODES, PAIR, RULES

CHECK = [*PAIR, "mode", "pack"]


def expand_directions(changes: Column, mode: Column) -> Column:
    """Changes as seen in each direction the mode asks for: (direction, rule, text).

    The mirrored direction is the same diff with both sides swapped, so one alignment serves both.
    """
    mirror = F.create_map(*[F.lit(x) for pair in MIRRORED_KIND.items() for x in pair])

    def seen(direction: int, mirrored: bool) -> Column:
        return F.transform(
            changes,
            lambda c: F.struct(
                F.lit(direction).alias("direction"),
                (mirror[c["kind"]] if mirrored else c["kind"]).alias("rule"),
                change_text(c, mirrored).alias("text"),
            ),
        )

    none = F.array().cast("array<struct<direction:int,rule:string,text:string>>")
    return F.concat(
        F.when(mode.isin("BACKWARD", "FULL"), seen(0, False)).otherwise(none),
        F.when(mode.isin("FORWARD", "FULL"), seen(1, True)).otherwise(none),
    )


def evaluate_rules(seen: Column, severities: Column) -> Column:
    """Ordered (direction, rule order, text) messages with severity; ignored ones dropped."""
    order = F.create_map(*[F.lit(x) for i, (rule, _, _) in enumerate(RULES) for x in (rule, i)])
    label = F.create_map(*[F.lit(x) for rule, text, _ in RULES for x in (rule, text)])
    judged = F.transform(
        F.filter(seen, lambda s: order[s["rule"]].isNotNull()),
        lambda s: F.struct(
            s["direction"].alias("direction"),
            order[s["rule"]].alias("rule_order"),
            s["text"].alias("text"),
            F.concat(
                F.when(s["direction"] == 1, FORWARD_PREFIX).otherwise(""),
                label[s["rule"]],
                s["text"],
            ).alias("message"),
            F.coalesce(severities[s["rule"]], F.lit("BREAKING")).alias("severity"),
        ),
    )
    return F.sort_array(F.filter(judged, lambda j: j["severity"] != "IGNORE"))


def check_compatibility(shapes: DataFrame, checks: DataFrame, packs: PolicyPacks) -> DataFrame:
    """check_results for every distinct check (pair, mode, pack).

    What cannot be judged (an absent or unreadable document, an unknown mode) has status ERROR and
    says why in `error`. Repeated checks fall together before any document is touched.
    """
    results = with_verdict(pair_changes(shapes, checks.select(*CHECK).distinct()), packs)
    return results.select(*CHECK, "status", "breaking_changes", "warnings", "error")


def with_verdict(changes: DataFrame, packs: PolicyPacks | None = None) -> DataFrame:
    """Replace `changes` by status, breaking_changes, warnings and `error`, judged under the row's
    `mode` and `pack`. A projection.

    Without packs the rows bring their pack's `levels`, and a `config_error` in place of one that cannot
    be had (pack_tables.resolved); both go."""
    given = ("levels", "config_error") if packs is None else ()
    rest = [c for c in changes.columns if c not in ("changes", "error", *given)]
    known = F.col("error") if "error" in changes.columns else F.lit(None).cast("string")
    if packs is None:
        known = F.coalesce(known, "config_error")
        severities = F.map_from_arrays(F.lit([rule for rule, _, _ in RULES]), F.col("levels"))
    else:
        severities = packs.severities_of("pack")
    no_mode = F.concat(
        F.lit("Unknown compatibility mode: "), F.coalesce("mode", F.lit("none"))
    )
    error = F.coalesce(
        known,
        F.when(F.col("changes").isNull(), "Schema document cannot be read."),
        F.when(~F.coalesce(F.col("mode").isin(*MODES), F.lit(False)), no_mode),
    )
    seen = changes.select(
        *rest,
        error.alias("error"),
        severities.alias("severities"),
        expand_directions(F.col("changes"), F.col("mode")).alias("seen"),
    )
    judged = seen.select(
        *rest, "error", evaluate_rules(F.col("seen"), F.col("severities")).alias("judged")
    )

    def messages(severity: str) -> Column:
        found = F.transform(
            F.filter("judged", lambda j: j["severity"] == severity), lambda j: j["message"]
        )
        nothing = F.array().cast("array<string>")
        return F.when(F.col("error").isNull(), found).otherwise(nothing)

    return judged.select(
        *rest,
        messages("BREAKING").alias("breaking_changes"),
        messages("WARNING").alias("warnings"),
        "error",
    ).withColumn(
        "status",
        F.when(F.col("error").isNotNull(), "ERROR")
        .when(F.size("breaking_changes") == 0, "PASS")
        .otherwise("FAIL"),
    )
