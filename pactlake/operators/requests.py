"""Check requests: validation, and resolution against the registry.

Fixed values: the message texts in this module.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pactlake.functions.text import blank_to_null, is_blank, trimmed
from pactlake.operators.diff import no_document
from pactlake.operators.policy import PolicyPacks
from pactlake.schemas import MODES, REQUEST_CONTRACT_ID, VERSION_NAME
from pactlake.session import never_broadcast

# What one distinct piece of work is: requests that agree on these share one check.
WORK = ["contract_id", "base_version", "candidate_version", "mode"]


def validate_requests(requests: DataFrame) -> DataFrame:
    """Requests with normalised values and `error`: null when valid, else the first problem."""

    def missing(column: str, name: str) -> tuple[Column, str]:
        return is_blank(column), f"{name} must not be blank."

    def no_version(column: str, name: str) -> tuple[Column, str]:
        return ~trimmed(column).rlike(VERSION_NAME), f"{name} must match the format v{{number}}."

    rules = [
        missing("contract_id", "contractId"),
        (
            ~trimmed("contract_id").rlike(REQUEST_CONTRACT_ID),
            "contractId must contain only letters, numbers, dots, underscores, or dashes.",
        ),
        missing("base_version", "baseVersion"),
        no_version("base_version", "baseVersion"),
        missing("candidate_version", "candidateVersion"),
        no_version("candidate_version", "candidateVersion"),
        (
            trimmed("base_version") == trimmed("candidate_version"),
            "baseVersion must differ from candidateVersion.",
        ),
        missing("mode", "mode"),
        (~F.upper(trimmed("mode")).isin(*MODES), "mode must be one of BACKWARD, FORWARD, FULL."),
        missing("triggered_by", "triggeredBy"),
    ]
    error = None
    for condition, message in rules:
        error = F.when(condition, message) if error is None else error.when(condition, message)
    cleaned = {
        "contract_id": trimmed("contract_id"),
        "base_version": trimmed("base_version"),
        "candidate_version": trimmed("candidate_version"),
        "mode": F.upper(trimmed("mode")),
        "commit_sha": blank_to_null("commit_sha"),
        "triggered_by": trimmed("triggered_by"),
    }
    return requests.select(
        *[cleaned[c].alias(c) if c in cleaned else F.col(c) for c in requests.columns],
        error.alias("error"),
    )


def resolve_requests(
    work: DataFrame,
    contracts: DataFrame,
    documents: DataFrame,
    packs: PolicyPacks,
    root: str = "contracts",
) -> DataFrame:
    """Distinct work items with the pack that applies, or `execution_error` when something is missing.

    documents: contract_id, version, document_error (schema_shapes has them); their `shape`, if they have
    one, comes along as `base_shape` and `candidate_shape`.
    """
    with_shapes = "shape" in documents.columns

    def side(name: str) -> DataFrame:
        known = documents.select(
            "contract_id",
            F.col("version").alias(f"{name}_version"),
            F.lit(True).alias(f"has_{name}"),
            F.col("document_error").alias(f"{name}_error"),
            *([F.col("shape").alias(f"{name}_shape")] if with_shapes else []),
        )
        return never_broadcast(known)

    def no_file(name: str) -> Column:
        return F.concat(
            F.lit("IllegalStateException: "), no_document(f"{name}_version", f"{root}/")
        )

    owned = never_broadcast(
        contracts.select("contract_id", packs.resolve("policy_pack").alias("pack"))
    )
    shapes = ["base_shape", "candidate_shape"] if with_shapes else []
    bad_document = F.concat(
        F.lit("SchemaValidationException: "), F.coalesce("base_error", "candidate_error")
    )
    problem = (
        F.when(
            F.col("pack").isNull(),
            F.concat(F.lit("IllegalStateException: Contract not found: "), "contract_id"),
        )
        .when(F.col("has_base").isNull(), no_file("base"))
        .when(F.col("has_candidate").isNull(), no_file("candidate"))
        .otherwise(bad_document)
    )
    return (
        work.select(*WORK)
        .distinct()
        .join(owned, "contract_id", "left")
        .join(side("base"), ["contract_id", "base_version"], "left")
        .join(side("candidate"), ["contract_id", "candidate_version"], "left")
        .select(*WORK, "pack", *shapes, problem.alias("execution_error"))
    )
