"""Incremental refresh of the catalogue: recompute what changed, drop what is gone."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pactlake.operators.catalog import contract_modified, contract_summary
from pactlake.operators.policy import PolicyPacks


def refresh_status(files: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Each contract's state against the last snapshot (contract_id, modified_at).

    files: contract_id, modified_at, one row per file.
    """
    now = contract_modified(files)
    before = snapshot.select("contract_id", F.col("modified_at").alias("seen_at"))
    state = (
        F.when(F.col("modified_at").isNull(), "removed")
        .when(F.col("seen_at").isNull(), "added")
        .when(F.col("modified_at") != F.col("seen_at"), "changed")
        .otherwise("unchanged")
    )
    return now.join(before, "contract_id", "full").select(
        "contract_id", "modified_at", state.alias("state")
    )


def incremental_refresh(
    catalog: DataFrame,
    contracts: DataFrame,
    versions: DataFrame,
    packs: PolicyPacks,
    status: DataFrame,
) -> DataFrame:
    """The new catalogue: stored rows of unchanged contracts, fresh rows of the others.

    Contracts and versions are cut to the stale ids before anything is aggregated.
    """
    stale = status.filter(F.col("state").isin("added", "changed")).select("contract_id")
    kept = status.filter(F.col("state") == "unchanged").select("contract_id")
    fresh = contract_summary(
        contracts.join(stale, "contract_id", "left_semi"),
        versions.join(stale, "contract_id", "left_semi"),
        packs,
    )
    return (
        catalog.join(kept, "contract_id", "left_semi")
        .withColumn("recomputed", F.lit(False))
        .unionByName(fresh.withColumn("recomputed", F.lit(True)))
    )
