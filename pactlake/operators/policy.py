"""Policy packs: which severity each rule has, and which pack a contract gets.

The configuration is one small file and a parameter of a job, like a threshold: it is read once,
size-checked and validated before any data is touched. Contracts, changes and checks never pass
this way.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pactlake.functions.text import blank_to_null, trimmed
from pactlake.schemas import BASELINE, RULES, SEVERITIES, STRICT_JSON

BASELINE_RULES = {rule: level for rule, _, level in RULES}


def pack_key(name: Column | str) -> Column:
    return F.lower(blank_to_null(name))


def _name(text: object) -> str | None:
    return str(text).strip().lower() or None if text is not None else None


def _rule(text: str) -> str | None:
    return text.strip().upper().replace("-", "_") or None


def policy_violations(config: dict) -> list[tuple[str, str, str]]:
    """(pack, rule text, message) for every unknown rule id or severity."""
    found = []
    for pack, body in (config.get("packs") or {}).items():
        for rule, level in ((body or {}).get("rules") or {}).items():
            if _rule(rule) is not None and _rule(rule) not in BASELINE_RULES:
                found.append((pack, rule, f"Unknown policy rule id: {rule}"))
            elif level is not None and level not in SEVERITIES:
                found.append((pack, rule, f"Unknown severity: {level}"))
    return found


#: Fixed message: a configuration that cannot be read.
NO_OBJECT = "Policy configuration is no JSON object."


def is_json_object(text: str) -> Column:
    kind = F.schema_of_variant(F.try_parse_json(text))
    return F.coalesce(kind.startswith("OBJECT"), F.lit(False))


def rule_key(rule: Column | str) -> Column:
    return F.replace(F.upper(trimmed(rule)), F.lit("-"), F.lit("_"))


def rule_problem(rule: Column, level: Column) -> Column:
    """What is wrong with a stated rule, null if nothing; a blank rule's severity is looked at too."""
    key = rule_key(rule)
    return F.when(
        (key != "") & ~key.isin(*BASELINE_RULES), F.concat(F.lit("Unknown policy rule id: "), rule)
    ).when(~level.isin(*SEVERITIES), F.concat(F.lit("Unknown severity: "), level))


def rule_errors(configs: DataFrame) -> DataFrame:
    """policy_violations of many configurations (config_id, text) at once, as rows: config_id, pack,
    rule, message. A text that is no JSON object has one row with no pack."""
    read = configs.select(
        "config_id",
        F.from_json(
            "text", "packs map<string,struct<rules:map<string,string>>>", STRICT_JSON
        ).alias("config"),
        is_json_object("text").alias("is_object"),
    )
    unread = read.filter(~F.col("is_object")).select(
        "config_id",
        F.lit(None).cast("string").alias("pack"),
        F.lit(None).cast("string").alias("rule"),
        F.lit(NO_OBJECT).alias("message"),
    )
    packs = read.select("config_id", F.explode("config.packs").alias("pack", "body"))
    rules = packs.select("config_id", "pack", F.explode("body.rules").alias("rule", "level"))
    message = rule_problem(F.col("rule"), F.col("level"))
    found = rules.select("config_id", "pack", "rule", message.alias("message"))
    return found.filter("message is not null").unionByName(unread)


def _rules_map(rules: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for item in rules.items() for x in item])


@dataclass(frozen=True)
class PolicyPacks:
    """Dense packs (all five rules each) and the default pack's name."""

    default: str
    severities: dict[str, dict[str, str]]

    @staticmethod
    def parse(text: str | None) -> PolicyPacks:
        config = json.loads(text) if text else {}
        problems = policy_violations(config)
        if problems:
            raise ValueError(problems[0][2])
        packs = {}
        for raw, body in (config.get("packs") or {}).items():
            if _name(raw) is None:
                continue
            stated = {}
            for rule, level in ((body or {}).get("rules") or {}).items():
                if _rule(rule) is not None:
                    stated[_rule(rule)] = "BREAKING" if level is None else level
            packs[_name(raw)] = {**BASELINE_RULES, **stated}
        packs.setdefault(BASELINE, dict(BASELINE_RULES))
        default = _name(config.get("defaultPack"))
        return PolicyPacks(default if default in packs else BASELINE, packs)

    def table(self, spark: SparkSession) -> DataFrame:
        """pack, is_default, severities (map); a local relation whose size Spark knows."""
        rows = [
            F.struct(
                F.lit(pack).alias("pack"),
                F.lit(pack == self.default).alias("is_default"),
                _rules_map(rules).alias("severities"),
            )
            for pack, rules in self.severities.items()
        ]
        return spark.range(0, 1, 1, 1).select(F.inline(F.array(*rows)))

    def rules(self, spark: SparkSession) -> DataFrame:
        """Long form: five rows per pack."""
        return self.table(spark).select("pack", F.explode("severities").alias("rule_id", "severity"))

    def severities_of(self, pack: str) -> Column:
        """The rule → severity map of a resolved pack, as a lookup in a literal: the configuration
        is size-checked, and a literal needs neither join nor shuffle. Unknown packs: baseline."""
        maps = [
            x
            for name, rules in self.severities.items()
            for x in (F.lit(name), _rules_map(rules))
        ]
        return F.coalesce(F.create_map(*maps)[F.col(pack)], _rules_map(BASELINE_RULES))

    def resolve(self, requested: Column | str) -> Column:
        """The pack that applies: the requested one, else the default."""
        wanted = pack_key(requested)
        return F.when(wanted.isin(*self.severities), wanted).otherwise(self.default)
