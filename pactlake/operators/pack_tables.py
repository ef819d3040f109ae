"""Policy packs as tables: very many configurations, each with packs and a default of its own.

A configuration is a row of text and becomes a row per pack. Neither the driver nor the plan holds any of
it, so a job for thousands of configurations plans like a job for one. Packs meet what they judge by joins
that are unique on the pack side, so a configuration that a third of all checks use only makes a skewed
stream side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pactlake.operators.compat import with_verdict
from pactlake.operators.diff import pair_changes
from pactlake.operators.documents import last_wins
from pactlake.operators.policy import NO_OBJECT, is_json_object, pack_key, rule_key, rule_problem
from pactlake.schemas import BASELINE, PAIR, RULES, STRICT_JSON

#: Severities of the baseline, in the order of RULES, as the `levels` of every pack are.
LEVELS = [level for _, _, level in RULES]
_CONFIG = "defaultPack string, packs map<string,struct<rules:map<string,string>>>"
_ENTRIES = "array<struct<key:string,value:struct<rules:map<string,string>>>>"
_RULES = "array<struct<key:string,value:string>>"
_PACKS = "array<struct<pack:string,levels:array<string>>>"


def _first_problem(entries: Column) -> Column:
    """What policy_violations says first of the packs (raw name → body), null if nothing."""

    def problems(pack: Column) -> Column:
        stated = F.coalesce(F.map_entries(pack["value"]["rules"]), F.array().cast(_RULES))
        found = F.transform(stated, lambda e: rule_problem(e["key"], e["value"]))
        return F.filter(found, lambda p: p.isNotNull())

    return F.get(F.flatten(F.transform(entries, problems)), F.lit(0))


def _stated(entries: Column) -> Column:
    """(key, rules) of each pack that has a name; of names or rules alike the last counts."""

    def rules(body: Column) -> Column:
        return last_wins(
            F.transform(
                F.coalesce(F.map_entries(body["rules"]), F.array().cast(_RULES)),
                lambda e: F.struct(
                    rule_key(e["key"]).alias("key"),
                    F.coalesce(e["value"], F.lit("BREAKING")).alias("value"),
                ),
            )
        )

    packs = F.transform(
        entries,
        lambda e: F.struct(pack_key(e["key"]).alias("key"), rules(e["value"]).alias("rules")),
    )
    return last_wins(F.filter(packs, lambda p: p["key"].isNotNull()))


def _levels(rules: Column) -> Column:
    """All five severities: the stated one of each rule, else the baseline's."""

    def level(rule: str, baseline: str) -> Column:
        own = F.get(F.filter(rules, lambda r: r["key"] == rule), F.lit(0))
        return F.coalesce(own["value"], F.lit(baseline))

    return F.array(*[level(rule, baseline) for rule, _, baseline in RULES])


def pack_rows(configs: DataFrame) -> DataFrame:
    """(config_id, pack, is_default, levels, config_error) of configurations (config_id, text), ids unique.

    One row for each pack that a configuration states, and one for the baseline where it states none of
    that name; exactly one of them is its default. A null or empty text states nothing. A configuration
    that PolicyPacks.parse would refuse has a single row, which has no pack and says why; parts of another
    shape than expected count as absent. No shuffle.
    """
    read = configs.select(
        "config_id",
        F.from_json("text", _CONFIG, STRICT_JSON).alias("config"),
        (F.coalesce(F.col("text"), F.lit("")) == "").alias("is_empty"),
        is_json_object("text").alias("is_object"),
    )
    read = read.select(
        "config_id",
        (F.col("is_empty") | F.col("is_object")).alias("is_read"),
        pack_key(F.col("config.defaultPack")).alias("asked"),
        F.coalesce(F.map_entries("config.packs"), F.array().cast(_ENTRIES)).alias("entries"),
    )
    read = read.select(
        "config_id",
        "asked",
        F.when(~F.col("is_read"), NO_OBJECT).otherwise(_first_problem(F.col("entries"))).alias("config_error"),
        _stated(F.col("entries")).alias("stated"),
    )

    def is_stated(name: Column | str) -> Column:
        return F.coalesce(F.exists("stated", lambda p: p["key"] == name), F.lit(False))

    own = F.transform("stated", lambda p: F.struct(p["key"].alias("pack"), _levels(p["rules"]).alias("levels"))).cast(_PACKS)
    baseline = F.array(F.struct(F.lit(BASELINE).alias("pack"), F.lit(LEVELS).alias("levels"))).cast(_PACKS)
    nothing = F.array(F.struct(F.lit(None).alias("pack"), F.lit(None).alias("levels"))).cast(_PACKS)
    packs = (
        F.when(F.col("config_error").isNotNull(), nothing)
        .when(is_stated(BASELINE), own)
        .otherwise(F.concat(own, baseline))
    )
    rows = read.select(
        "config_id",
        "config_error",
        F.when(is_stated(F.col("asked")), F.col("asked")).otherwise(BASELINE).alias("default"),
        packs.alias("packs"),
    ).select("config_id", "config_error", "default", F.inline_outer("packs"))
    is_default = F.coalesce(F.col("pack") == F.col("default"), F.lit(True))
    return rows.select("config_id", "pack", is_default.alias("is_default"), "levels", "config_error")


def resolved(rows: DataFrame, packs: DataFrame) -> DataFrame:
    """Rows (config_id, policy_pack, …) with `pack`, `levels` and `config_error`: the pack that the row asks
    for, where its configuration has it, else the configuration's default. A configuration that is not
    there is the baseline alone; of one that is refused the error comes in place of a pack.

    packs: pack_rows. Both joins are unique on the side of the packs.
    """
    named = packs.filter("pack is not null").select(
        F.col("config_id").alias("named_config"),
        F.col("pack").alias("named_pack"),
        F.col("levels").alias("named_levels"),
    )
    default = packs.filter("is_default").select(
        F.col("config_id").alias("default_config"),
        F.col("pack").alias("default_pack"),
        F.col("levels").alias("default_levels"),
        "config_error",
    )
    is_named = (F.col("config_id") == F.col("named_config")) & (pack_key("policy_pack") == F.col("named_pack"))
    both = rows.join(named, is_named, "left").join(default, F.col("config_id") == F.col("default_config"), "left")
    right = F.col("config_error").isNull()
    return both.select(
        *[both[c] for c in rows.columns],
        F.when(right, F.coalesce("named_pack", "default_pack", F.lit(BASELINE))).alias("pack"),
        F.when(right, F.coalesce("named_levels", "default_levels", F.lit(LEVELS))).alias("levels"),
        "config_error",
    )


def check_with_packs(shapes: DataFrame, checks: DataFrame, packs: DataFrame) -> DataFrame:
    """check_results of checks (pair, mode, config_id, policy_pack), each under a pack of its configuration.

    Repeated checks, and names of one pack, fall together before any document is touched.
    """
    asked = checks.select(*PAIR, "mode", "config_id", "policy_pack").distinct()
    asked = resolved(asked, packs).drop("policy_pack").distinct()
    results = with_verdict(pair_changes(shapes, asked))
    return results.select(
        *PAIR, "mode", "config_id", "pack", "status", "breaking_changes", "warnings", "error"
    )
