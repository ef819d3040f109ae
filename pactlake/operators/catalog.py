"""The contract catalogue: summaries, versions, search, modification times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pactlake.functions.text import is_blank, trimmed
from pactlake.functions.versions import version_of
from pactlake.operators.policy import PolicyPacks
from pactlake.schemas import ACTIVE


def version_summary(versions: DataFrame) -> DataFrame:
    """Latest version (by number) and version count per contract; partial aggregation only."""
    return versions.groupBy("contract_id").agg(
        F.max("version_num").alias("latest_num"),
        F.count("version_num").alias("version_count"),
    )


def contract_catalog(contracts: DataFrame, versions: DataFrame, packs: PolicyPacks) -> DataFrame:
    """One summary row per contract, sorted by id for a listing."""
    return contract_summary(contracts, versions, packs).orderBy("contract_id")


def contract_summary(contracts: DataFrame, versions: DataFrame, packs: PolicyPacks) -> DataFrame:
    """One summary row per contract.

    The list of versions is a table of its own (contract_versions): a contract may have very many.
    """
    joined = contracts.join(version_summary(versions), "contract_id", "left")
    return joined.select(
        "contract_id",
        "owner_team",
        "domain",
        "compatibility_mode",
        packs.resolve("policy_pack").alias("policy_pack"),
        version_of(F.col("latest_num")).alias("latest_version"),
        F.coalesce("version_count", F.lit(0)).cast("long").alias("version_count"),
        F.lit(ACTIVE).alias("status"),
    )


def contract_versions(versions: DataFrame) -> DataFrame:
    return versions.select("contract_id", "version", "version_num").orderBy(
        "contract_id", "version_num"
    )


def contract_document(docs: DataFrame, contract_id: str, version: str) -> DataFrame:
    """One version's document; the filter reaches the scan."""
    name = version.removesuffix(".json")
    return docs.filter(
        (F.col("contract_id") == contract_id.strip()) & (F.col("version") == name)
    ).select("contract_id", "version", "schema_json")


def search_contracts(catalog: DataFrame, text: str | None) -> DataFrame:
    """Case-insensitive substring of id, owner or domain; blank text matches all."""
    wanted = (text or "").strip().lower()
    if not wanted:
        return catalog

    def hit(column: str) -> Column:
        return ~is_blank(column) & F.lower(column).contains(wanted)

    return catalog.filter(hit("contract_id") | hit("owner_team") | hit("domain"))


def contract_count(contracts: DataFrame) -> DataFrame:
    return contracts.select(F.count(F.lit(1)).alias("contract_count"))


def contract_modified(files: DataFrame) -> DataFrame:
    """Last change per contract over all its files (contract_id, modified_at)."""
    return files.groupBy("contract_id").agg(F.max("modified_at").alias("modified_at"))


def changed_contract_ids(files: DataFrame, root: str = "contracts") -> DataFrame:
    """Contracts named by a list of changed paths (column `path`)."""
    parts = F.split(trimmed("path"), "/")
    return (
        files.select(parts.alias("parts"))
        .filter((F.get("parts", F.lit(0)) == root) & (F.size("parts") > 2))
        .select(F.get("parts", F.lit(1)).alias("contract_id"))
        .filter("contract_id <> ''")
        .distinct()
    )


def changed_contracts(rows: DataFrame, files: DataFrame) -> DataFrame:
    return rows.join(changed_contract_ids(files), "contract_id", "left_semi")
