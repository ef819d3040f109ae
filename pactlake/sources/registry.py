"""Sources of the registry: contract folders, metadata, policy packs, changed-file lists."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from pactlake.functions.text import clean_names
from pactlake.functions.versions import version_num
from pactlake.operators.policy import PolicyPacks
from pactlake.schemas import ACTIVE, VERSION_FILE


def read_schema_docs(spark: SparkSession, root: str) -> DataFrame:
    """`<root>/<contract>/v<n>.json`, one whole file per row, with its modification time."""
    files = (
        spark.read.text(f"{root.rstrip('/')}/*/v*.json", wholetext=True)
        .select("value", "_metadata.file_path", "_metadata.file_modification_time")
    )
    parts = F.split(F.url_decode(F.regexp_replace("file_path", r"\+", "%2B")), "/")
    name = F.element_at(parts, -1)
    return (
        files.select(
            F.element_at(parts, -2).alias("contract_id"),
            name.alias("file"),
            "value",
            "file_modification_time",
        )
        .filter(F.col("file").rlike(VERSION_FILE))
        .withColumn("version", F.regexp_replace("file", r"\.json\z", ""))
        .select(
            "contract_id",
            "version",
            version_num(F.col("version")).alias("version_num"),
            F.col("value").alias("schema_json"),
            F.col("file_modification_time").alias("modified_at"),
        )
    )


def with_unread(docs: DataFrame, listing: DataFrame) -> DataFrame:
    """Documents, and one with an empty text for each listed version file that gave none.

    Spark's file sources skip files of zero bytes, so an empty `v2.json` can only be known from a
    listing (contract_id, file). Lint then reports it like any other unreadable document.
    """
    version = F.regexp_replace("file", r"\.json\z", "")
    listed = (
        listing.filter(F.col("file").rlike(VERSION_FILE))
        .select("contract_id", version.alias("version"))
        .distinct()
    )
    unread = listed.join(docs, ["contract_id", "version"], "left_anti").select(
        "contract_id",
        "version",
        version_num(F.col("version")).alias("version_num"),
        F.lit("").alias("schema_json"),
    )
    return docs.unionByName(unread, allowMissingColumns=True)


_META = (
    "contract_id string, owner_team string, domain string, compatibility_mode string, "
    "policy_pack string, consumers array<string>, metadata_error string, modified_at timestamp"
)


def _text_of(node) -> str | None:
    return None if node is None or isinstance(node, (list, dict)) else str(node)


def _parse_metadata(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """YAML has no JVM-side reader in Spark: a small per-file parse of small files."""
    import yaml

    class Plain(yaml.SafeLoader):
        """Every scalar stays the text it was written as, except null."""

    Plain.yaml_implicit_resolvers = {
        first: [(tag, pattern) for tag, pattern in found if tag == "tag:yaml.org,2002:null"]
        for first, found in yaml.SafeLoader.yaml_implicit_resolvers.items()
    }
    for batch in batches:
        rows = []
        for contract_id, value, modified in zip(
            batch["contract_id"], batch["value"], batch["modified_at"]
        ):
            row = dict.fromkeys(
                ("owner_team", "domain", "compatibility_mode", "policy_pack", "consumers",
                 "metadata_error")
            )
            try:
                node = yaml.load(value, Loader=Plain)
                if node is None:
                    row["metadata_error"] = "metadata.yaml must not be empty."
                elif not isinstance(node, dict):
                    raise yaml.YAMLError("not a mapping")
                else:
                    row["owner_team"] = _text_of(node.get("ownerTeam"))
                    row["domain"] = _text_of(node.get("domain"))
                    row["compatibility_mode"] = _text_of(node.get("compatibilityMode"))
                    row["policy_pack"] = _text_of(node.get("policyPack"))
                    declared = node.get("consumers")
                    if isinstance(declared, list):
                        row["consumers"] = [str(x) for x in declared if x is not None]
                    elif declared is not None:
                        row["consumers"] = str(declared).split(",")
            except yaml.YAMLError:
                row["metadata_error"] = "Invalid YAML in metadata file: metadata.yaml"
            rows.append({"contract_id": contract_id, **row, "modified_at": modified})
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _META.split(", ")])


def read_contracts(spark: SparkSession, root: str) -> DataFrame:
    """`<root>/<contract>/metadata.yaml` → contracts, with `metadata_error` for unreadable files.

    Spark's file sources pass over files of zero bytes: such a metadata file counts as missing.
    """
    files = (
        spark.read.text(f"{root.rstrip('/')}/*/metadata.yaml", wholetext=True)
        .select(
            F.element_at(
                F.split(F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B")), "/"),
                -2,
            ).alias("contract_id"),
            "value",
            F.col("_metadata.file_modification_time").alias("modified_at"),
        )
    )
    return (
        files.mapInPandas(_parse_metadata, _META)
        .withColumn("consumers", clean_names("consumers"))
        .withColumn("status", F.lit(ACTIVE))
    )


def read_policy_packs(spark: SparkSession, path: str | None) -> PolicyPacks:
    """One policy file of any size; without a path or a file there, the baseline alone."""
    if path is None:
        return PolicyPacks.parse(None)
    try:
        found = spark.read.text(path, wholetext=True).first()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return PolicyPacks.parse(None)
        raise
    return PolicyPacks.parse(found and found[0])


def read_policy_configs(spark: SparkSession, root: str) -> DataFrame:
    """`<root>/<config>/policy-packs.json`, one whole file per row (config_id, text). Spark skips files of
    zero bytes; such a configuration states nothing, like one that is not there."""
    files = spark.read.text(f"{root.rstrip('/')}/*/policy-packs.json", wholetext=True)
    parts = F.split(F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B")), "/")
    return files.select(F.element_at(parts, -2).alias("config_id"), F.col("value").alias("text"))


def read_changed_files(spark: SparkSession, path: str) -> DataFrame:
    """A list of changed paths, one per line."""
    return spark.read.text(path).select(F.col("value").alias("path")).filter("path <> ''")
