"""Gates on new contracts and new versions.

Fixed values: the message texts in this module.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pactlake.functions.text import blank_to_null, is_blank, trimmed
from pactlake.functions.versions import out_of_range, version_num, version_of
from pactlake.operators.compat import with_verdict
from pactlake.operators.diff import with_changes
from pactlake.operators.documents import schema_shapes, with_plain_shape
from pactlake.operators.lint import metadata_error, with_document_error
from pactlake.operators.policy import PolicyPacks
from pactlake.schemas import MODES, REGISTRY_CONTRACT_ID, VERSION_NAME
from pactlake.session import never_broadcast, shared_folder


def _first(*rules: tuple[Column, Column | str]) -> Column:
    found = None
    for condition, message in rules:
        text = F.lit(message) if isinstance(message, str) else message
        found = F.when(condition, text) if found is None else found.when(condition, text)
    return found


def _is_object(text: str) -> Column:
    return F.coalesce(
        F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), F.lit(False)
    )


def register_versions(
    candidates: DataFrame,
    contracts: DataFrame,
    shapes: DataFrame,
    packs: PolicyPacks,
    strict: bool = True,
) -> DataFrame:
    """candidates (contract_id, version, schema_json) → accepted, reason, compatibility status.

    The contract's metadata and its latest document are linted as well: a version is never accepted on
    a base that cannot be judged. shapes: schema_shapes of the registry.

    A batch may hold several new versions of a contract. They go in by number, each compared with the one
    below it, up to the first that is missing or fails; what stands above that is out of sequence. Of rows
    for the same new version one is judged, the first by a hash of its document; the others are rejected.
    No contract is worked on in one task: what stops a chain is a grouped minimum.
    """
    asked = candidates.select(
        F.col("contract_id").alias("given_id"),
        F.col("version").alias("given_version"),
        trimmed("contract_id").alias("contract_id"),
        trimmed("version").alias("version"),
        "schema_json",
        F.xxhash64("schema_json").alias("document"),
    )
    # A plain document is an object and clean; only the others are parsed as a whole, here and below.
    other = F.col("plain_shape").isNull()
    asked = with_plain_shape(asked).withColumns(
        {
            "schema_json": F.when(other, F.col("schema_json")),
            "request_error": F.when(is_blank("version"), "version must not be blank.")
            .when(~F.col("version").rlike(VERSION_NAME), "version must match the format v{number}.")
            .when(other & ~_is_object("schema_json"), "schema must be a JSON object.")
            .when(is_blank("contract_id"), "contractId must not be blank.")
            .when(
                ~F.col("contract_id").rlike(REGISTRY_CONTRACT_ID),
                "contractId must use lowercase dot-separated format.",
            ),
            "version_num": version_num(F.col("version")),
        }
    )
    latest = shapes.groupBy("contract_id").agg(F.max("version_num").alias("latest_num"))
    existing = shapes.select("contract_id", "version").withColumn("version_exists", F.lit(True))
    owners = contracts.select(
        "contract_id",
        F.upper(trimmed("compatibility_mode")).alias("mode"),
        packs.resolve("policy_pack").alias("pack"),
        metadata_error(contracts).alias("metadata_error"),
    )
    top, num = F.col("latest_num"), F.col("version_num")
    placed = (
        asked.join(never_broadcast(owners), "contract_id", "left")
        .join(never_broadcast(latest), "contract_id", "left")
        .join(never_broadcast(existing), ["contract_id", "version"], "left")
        .withColumn(
            "own_error",
            _first(
                (F.col("request_error").isNotNull(), F.col("request_error")),
                (
                    F.col("pack").isNull(),
                    F.concat(F.lit("Contract not found: "), "contract_id"),
                ),
                (F.col("version_exists").isNotNull(), _exists()),
                (
                    out_of_range(F.col("version")),
                    F.concat(F.lit("Version number out of range: "), "version"),
                ),
                (top.isNull() & (num < 1), "First contract version must be v1."),
                (
                    num <= top,
                    F.concat(
                        F.lit("New version must be greater than existing latest version "),
                        version_of(top),
                        F.lit("."),
                    ),
                ),
            ),
        )
        .withColumn("row", F.monotonically_increasing_id())
    )
    # Written: row numbers are kept, and lint and shapes are read more than once.
    path = shared_folder(candidates.sparkSession, "candidates")
    schema_shapes(placed).write.parquet(path)
    placed = candidates.sparkSession.read.parquet(path)
    version = ["contract_id", "version_num"]
    sent = placed.where("own_error is null")
    chosen = sent.groupBy(*version).agg(F.min(F.struct("document", "row"))["row"].alias("first"))
    chain = sent.join(never_broadcast(chosen), version).where("row = first").drop("first")
    below = F.coalesce(top, F.lit(0))
    # The first number that is neither in the registry nor in the batch.
    numbers = chain.select("contract_id", F.col("version_num").alias("next"))
    starts = chain.select("contract_id", below.alias("version_num")).distinct()
    ends = chain.select(*version).union(starts).select("contract_id", (num + 1).alias("next"))
    hole = ends.join(never_broadcast(numbers), ["contract_id", "next"], "left_anti").groupBy("contract_id").agg(F.min("next").alias("hole"))
    base = shapes.select(
        "contract_id",
        F.col("version_num").alias("latest_num"),
        F.col("shape").alias("old_shape"),
        F.col("document_error").alias("old_error"),
    )
    before = chain.select(
        "contract_id",
        (num + 1).alias("version_num"),
        F.col("shape").alias("new_shape"),
        F.col("document_error").alias("new_error"),
    )
    on_top = num == below + 1
    # Each brings its own document; beside the one below it lint, diff and verdict are projections of its row.
    both = (
        chain.withColumnRenamed("shape", "candidate_shape")
        .join(never_broadcast(before), version, "left")
        .join(never_broadcast(base), ["contract_id", "latest_num"], "left")
        .withColumn("base_shape", F.when(on_top, F.col("old_shape")).otherwise(F.col("new_shape")))
        .withColumn(
            "lint_error",
            F.coalesce("metadata_error", "document_error", F.when(on_top, F.col("old_error")).otherwise(F.col("new_error"))),
        )
        .drop("old_shape", "new_shape")
    )
    judged = with_verdict(with_changes(both), packs)
    # The first version of a contract has nothing to be compared with.
    compared = F.col("lint_error").isNull() & (top.isNotNull() | (num > 1))
    status = F.when(compared, F.col("status"))
    rejected_by_check = F.concat(
        F.lit("Strict mode rejected version "),
        "version",
        F.lit(". Breaking changes: "),
        F.array_join("breaking_changes", "; "),
    )
    judged = judged.select(
        "row",
        "contract_id",
        "version_num",
        status.alias("check_status"),
        F.when(compared, version_of(num - 1)).alias("base_version"),
        _first(
            (F.col("lint_error").isNotNull(), F.col("lint_error")),
            (status == "ERROR", F.col("error")),
            (F.lit(strict) & (status == "FAIL"), rejected_by_check),
        ).alias("judged_error"),
    )
    path = shared_folder(candidates.sparkSession, "judged")
    judged.write.parquet(path)
    judged = candidates.sparkSession.read.parquet(path)
    failed = judged.where("judged_error is not null").groupBy("contract_id").agg(F.min("version_num").alias("failed"))
    stops = hole.join(never_broadcast(failed), "contract_id", "left").select(
        "contract_id", F.least("hole", "failed").alias("stop")
    )
    stop, taken = F.col("stop"), F.col("judged").isNotNull()
    told = judged.select("row", F.struct("check_status", "base_version", "judged_error").alias("judged"))
    expected = _first(
        (top.isNull() & (stop == 1), "First contract version must be v1."),
        (
            F.lit(True),
            F.concat(
                F.lit("Version sequence must be incremental. Expected "), version_of(stop), F.lit(".")
            ),
        ),
    )
    reason = _first(
        (F.col("own_error").isNotNull(), F.col("own_error")),
        (num > stop, expected),
        (taken, F.col("judged.judged_error")),
        (num < stop, _exists()),
        (F.lit(True), F.concat(F.lit("Version was sent more than once in this batch: "), "version", F.lit("."))),
    )
    reached = taken & (num <= stop)
    return (
        placed.join(never_broadcast(told), "row", "left")
        .join(never_broadcast(stops), "contract_id", "left")
        .select(
            F.col("given_id").alias("contract_id"),
            F.col("given_version").alias("version"),
            F.when(reached, F.col("judged.base_version")).alias("base_version"),
            F.when(reached, F.col("judged.check_status")).alias("check_status"),
            reason.isNull().alias("accepted"),
            reason.alias("reason"),
        )
    )


def _exists() -> Column:
    return F.concat(
        F.lit("Version already exists for contract "), "contract_id", F.lit(": "), "version"
    )


def register_contracts(requests: DataFrame, contracts: DataFrame) -> DataFrame:
    """New contracts: valid request, free id, clean first document."""
    mode = F.upper(trimmed("compatibility_mode"))
    first_version = F.when(is_blank("initial_version"), "v1").otherwise(trimmed("initial_version"))
    asked = requests.withColumns(
        {
            "given_id": F.col("contract_id"),
            "request_error": _first(
                (is_blank("contract_id"), "contractId must not be blank."),
                (
                    ~trimmed("contract_id").rlike(REGISTRY_CONTRACT_ID),
                    "contractId must use lowercase dot-separated format.",
                ),
                (is_blank("owner_team"), "ownerTeam must not be blank."),
                (is_blank("domain"), "domain must not be blank."),
                (is_blank("compatibility_mode"), "compatibilityMode must not be blank."),
                (
                    ~mode.isin(*MODES),
                    "compatibilityMode must be one of BACKWARD, FORWARD, FULL.",
                ),
                (
                    ~first_version.rlike(VERSION_NAME),
                    "initialVersion must match the format v{number}.",
                ),
                (~_is_object("schema_json"), "schema must be a JSON object."),
            ),
            "contract_id": trimmed("contract_id"),
            "version": first_version,
            "compatibility_mode": mode,
            "policy_pack": blank_to_null("policy_pack"),
        }
    )
    taken = contracts.select("contract_id", F.lit(True).alias("taken"))
    reason = _first(
        (F.col("request_error").isNotNull(), F.col("request_error")),
        (
            F.col("taken").isNotNull(),
            F.concat(F.lit("Contract already exists: "), "contract_id"),
        ),
        (F.col("document_error").isNotNull(), F.col("document_error")),
    )
    return (
        with_document_error(asked)
        .join(taken, "contract_id", "left")
        .select(
            F.col("given_id").alias("contract_id"),
            F.col("version").alias("initial_version"),
            "compatibility_mode",
            "policy_pack",
            reason.isNull().alias("accepted"),
            reason.alias("reason"),
        )
    )
