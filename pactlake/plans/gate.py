"""The gate on changed contracts: lint plus a check of the last two versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pactlake.functions.details import no_strings
from pactlake.functions.text import trimmed
from pactlake.operators.catalog import changed_contract_ids
from pactlake.operators.compat import with_verdict
from pactlake.operators.diff import with_changes
from pactlake.operators.documents import schema_shapes, with_plain_shape
from pactlake.operators.lint import with_contract_violations, with_document_violations
from pactlake.operators.policy import PolicyPacks


def changed_gate(
    files: DataFrame,
    contracts: DataFrame,
    docs: DataFrame,
    packs: PolicyPacks,
    mode: str | None = "BACKWARD",
) -> DataFrame:
    """One row per changed contract: lint result, checked pair, verdict, `passed`.

    `mode=None` takes each contract's own mode. Contracts that fail lint are not checked; those
    with one version are skipped; changed paths of contracts that no longer exist are ignored.
    Only changed contracts are read past the first semi join. Their documents are read twice: for the
    sum of their violations, where plain documents, which certainly pass, are not linted member by member; and for
    the last two of each contract, which Spark's window group limit cuts before the shuffle, so a contract with very
    many versions stays spread. Only these two are taken apart.
    """
    changed = changed_contract_ids(files)
    some_contracts = contracts.join(changed, "contract_id", "left_semi")
    some_docs = docs.join(changed, "contract_id", "left_semi").select(
        "contract_id", "version", "version_num", "schema_json"
    )
    plain = F.col("plain_shape").isNotNull()
    suspect = with_plain_shape(some_docs).select(
        "contract_id", "version", plain.alias("plain"), F.when(~plain, F.col("schema_json")).alias("schema_json")
    )
    faults = F.when(F.col("plain"), 0).otherwise(F.size("found"))
    judged = with_document_violations(suspect).groupBy("contract_id")
    problems = judged.agg(F.sum(faults).alias("in_documents"))
    linted = with_contract_violations(some_contracts, problems)
    wanted_mode = F.upper(trimmed("compatibility_mode")) if mode is None else F.lit(mode)
    count = F.size("found") + F.coalesce("in_documents", F.lit(0))
    owners = linted.select(
        "contract_id",
        count.cast("long").alias("violation_count"),
        wanted_mode.alias("mode"),
        packs.resolve("policy_pack").alias("pack"),
    )
    newest = Window.partitionBy("contract_id").orderBy(F.desc("version_num"))
    last_two = (
        some_docs.filter("version_num is not null")
        .withColumn("place", F.row_number().over(newest))
        .filter("place <= 2")
    )
    last_two = schema_shapes(last_two).groupBy("contract_id")

    def of(place: int, column: str) -> Column:
        return F.first(F.when(F.col("place") == place, F.col(column)), ignorenulls=True)

    pairs = last_two.agg(
        of(2, "version").alias("base_version"),
        of(1, "version").alias("candidate_version"),
        of(2, "shape").alias("base_shape"),
        of(1, "shape").alias("candidate_shape"),
    ).filter("base_version is not null")
    results = with_verdict(with_changes(owners.join(pairs, "contract_id", "left")), packs)
    clean = F.col("violation_count") == 0
    checked = clean & F.col("base_version").isNotNull()
    outcome = (
        F.when(~clean, "LINT_FAILED").when(~checked, "SKIPPED").otherwise(F.col("status"))
    )
    return results.select(
        "contract_id",
        "violation_count",
        *[F.when(checked, F.col(c)).alias(c) for c in ("base_version", "candidate_version")],
        outcome.alias("outcome"),
        *[
            F.when(checked, F.col(c)).otherwise(no_strings()).alias(c)
            for c in ("breaking_changes", "warnings")
        ],
        outcome.isin("PASS", "SKIPPED").alias("passed"),
    )


def gate_result(gate: DataFrame) -> DataFrame:
    """The overall answer as one row; no changed contract means the gate passes."""
    return gate.agg(
        F.count(F.lit(1)).alias("contracts"),
        F.count_if(~F.col("passed")).alias("failed"),
        F.coalesce(F.min("passed"), F.lit(True)).alias("passed"),
    )
