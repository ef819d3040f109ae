"""Answers drawn from the history: impact, badges, explanations, guidance, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pactlake.functions.details import log_field, no_strings, parse_details
from pactlake.functions.text import blank_to, is_blank, tag_value, trimmed
from pactlake.operators.history import time_of

EXECUTION_ERROR = "Execution error: "

# Fixed texts: what a change means, why it matters and how to fix it, by message label.
EXPLANATIONS = (
    (
        "Field removed: ",
        "Existing consumers expect this field and removal can break deserialization.",
        "Re-introduce the field as optional and deprecate before removal.",
    ),
    (
        "Field type changed: ",
        "Type changes can break parsers and downstream validation logic.",
        "Maintain the previous type or add a new field with the new type.",
    ),
    (
        "Required field added: ",
        "Older producers may not send the new field, causing validation failures.",
        "Make the new field optional for a backward-compatible rollout.",
    ),
    (
        "Enum value removed: ",
        "Existing payload values may be rejected by consumers expecting prior enums.",
        "Keep legacy enum values until all consumers migrate.",
    ),
)
WHY_OTHER = "Existing consumers can break at runtime."
FIX_OTHER = "Preserve compatibility semantics for existing consumers."
WHY_UNKNOWN = "Existing consumers may fail to parse payloads."
FIX_UNKNOWN = "Preserve backward compatibility or release a major version."

# Fixed texts: hints by words found in a breaking change, first match wins.
HINT_FAILED = "Treat this as blocking for consumers until compatibility issues are resolved."
HINTS = (
    ("type changed", "Consider a new schema version or add a compatible transitional field type."),
    (
        "field removed",
        "Avoid removing fields directly. Deprecate first and remove in a later major version.",
    ),
    ("required field", "Prefer optional fields with defaults for backwards compatibility."),
)
HINT_NONE = "No additional guidance was generated for this check run."


def latest_run(runs: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    """The newest run per key (ties by run id), reduced before the shuffle."""
    newest = F.struct(time_of().alias("at"), F.col("run_id"))
    return runs.groupBy(*keys).agg(
        F.max_by(F.struct(*columns), newest).alias("latest")
    ).select(*keys, "latest.*")


def impact_analysis(targets: DataFrame, runs: DataFrame, contracts: DataFrame) -> DataFrame:
    """Risk of each (contract_id, version) from its latest run, with the declared consumers."""
    latest = latest_run(
        runs, ["contract_id", "candidate_version"], "run_id", "breaking_changes", "warnings"
    ).withColumnRenamed("candidate_version", "version")
    breaking, warnings = parse_details("breaking_changes"), parse_details("warnings")
    judged = targets.select("contract_id", "version").join(
        latest, ["contract_id", "version"], "left"
    ).select(
        "contract_id",
        "version",
        F.col("run_id").isNotNull().alias("has_run"),
        breaking.alias("breaking"),
        warnings.alias("warned"),
    )
    risk = (
        F.when(~F.col("has_run"), "LOW")
        .when(F.size("breaking") > 0, "HIGH")
        .when(F.size("warned") > 0, "MEDIUM")
        .otherwise("LOW")
    )
    reason = (
        F.when(~F.col("has_run"), "No historical check run found for this version.")
        .when(F.size("breaking") > 0, F.get("breaking", F.lit(0)))
        .when(F.size("warned") > 0, F.get("warned", F.lit(0)))
        .otherwise("No breaking or warning changes detected.")
    )
    return judged.join(contracts.select("contract_id", "consumers"), "contract_id", "left").select(
        "contract_id",
        "version",
        risk.alias("risk_level"),
        reason.alias("reason"),
        F.coalesce("consumers", no_strings()).alias("consumers"),
    )


def impact_consumers(impact: DataFrame) -> DataFrame:
    """One row per affected consumer; contracts without any keep one row with null."""
    return impact.select(
        "contract_id", "version", "risk_level", F.explode_outer("consumers").alias("consumer")
    )


def contract_badge(contracts: DataFrame, runs: DataFrame) -> DataFrame:
    latest = latest_run(runs, ["contract_id"], "run_id", "status")
    status = F.upper("status")
    state = (
        F.when(F.col("run_id").isNull(), F.array(F.lit("unknown"), F.lit("lightgrey")))
        .when(status.isin("FAIL", "FAILED"), F.array(F.lit("failing"), F.lit("red")))
        .when(status.isin("QUEUED", "RUNNING"), F.array(F.lit("running"), F.lit("yellow")))
        .otherwise(F.array(F.lit("passing"), F.lit("brightgreen")))
    )
    return (
        contracts.select("contract_id")
        .join(latest, "contract_id", "left")
        .withColumn("state", state)
        .select(
            "contract_id",
            F.lit(1).alias("schema_version"),
            F.col("contract_id").alias("label"),
            F.get("state", F.lit(0)).alias("message"),
            F.get("state", F.lit(1)).alias("color"),
        )
    )


def _by_label(change: Column, texts: list[Column], other: Column) -> Column:
    found = None
    for (label, _, _), text in zip(EXPLANATIONS, texts):
        condition = change.startswith(label)
        found = F.when(condition, text) if found is None else found.when(condition, text)
    return found.otherwise(other)


def explain_runs(runs: DataFrame) -> DataFrame:
    """Headline, reason and fix for the first breaking change of each run, and the full text."""
    lists = runs.select(
        "run_id",
        "status",
        parse_details("breaking_changes").alias("breaking"),
        parse_details("warnings").alias("warned"),
    )
    change = F.get("breaking", F.lit(0))
    field = [F.substring(change, len(label) + 1, 2147483647) for label, _, _ in EXPLANATIONS]
    quoted = lambda name, tail: F.concat(F.lit("Field '"), name, F.lit(f"' {tail}"))
    headline = F.when(
        is_blank(change), F.lit("A breaking change was detected.")
    ).otherwise(
        _by_label(
            change,
            [
                quoted(field[0], "was removed."),
                quoted(F.substring_index(field[1], " ", 1), "changed type."),
                quoted(field[2], "is now required."),
                F.lit("A previously allowed enum value was removed."),
            ],
            change,
        )
    )
    why = F.when(change.isNull(), WHY_UNKNOWN).otherwise(
        _by_label(change, [F.lit(w) for _, w, _ in EXPLANATIONS], F.lit(WHY_OTHER))
    )
    fix = F.when(change.isNull(), FIX_UNKNOWN).otherwise(
        _by_label(change, [F.lit(f) for _, _, f in EXPLANATIONS], F.lit(FIX_OTHER))
    )
    broken = F.size("breaking") > 0
    rows = lists.select(
        "run_id",
        "status",
        "warned",
        broken.alias("is_breaking"),
        F.when(broken, headline).otherwise("No Breaking Changes Detected").alias("headline"),
        F.when(broken, why).alias("why"),
        F.when(broken, fix).alias("fix"),
    )
    line = F.lit("\n")
    clean = F.concat(
        F.lit("✅ No Breaking Changes Detected"),
        F.when(
            F.size("warned") > 0,
            F.concat(
                F.lit("\n\nWarnings:\n"),
                F.array_join(F.transform("warned", lambda w: F.concat(F.lit("- "), w)), "\n"),
            ),
        ).otherwise(""),
    )
    text = F.concat(
        F.lit("❌ Breaking Change Detected\n\n"),
        F.col("headline"),
        F.lit("\n\nWhy this matters:\n- "),
        F.col("why"),
        F.lit("\n- Existing integrations can fail at runtime\n\nHow to fix:\n- "),
        F.col("fix"),
        F.lit("\n- Mark field optional OR bump major version\n\nExample:\n{\n"),
        F.lit('  "userId": { "type": "string", "nullable": true }\n}'),
        F.when(
            ~is_blank("status"),
            F.concat(line, line, F.lit("Recorded status: "), F.col("status")),
        ).otherwise(""),
    )
    return rows.select(
        "run_id",
        "status",
        "is_breaking",
        "headline",
        "why",
        "fix",
        F.when(F.col("is_breaking"), text).otherwise(clean).alias("explanation"),
    )


def run_guidance(runs: DataFrame) -> DataFrame:
    """Distinct, sorted hints per run."""

    def hint(change: Column) -> Column:
        lower = F.lower(change)
        found = None
        for words, text in HINTS:
            condition = lower.contains(words)
            found = F.when(condition, text) if found is None else found.when(condition, text)
        return found

    hints = F.concat(
        F.when(F.upper(trimmed("status")) == "FAIL", F.array(F.lit(HINT_FAILED))).otherwise(
            no_strings()
        ),
        F.filter(
            F.transform(parse_details("breaking_changes"), hint), lambda h: h.isNotNull()
        ),
    )
    return runs.select("run_id", F.sort_array(F.array_distinct(hints)).alias("hints")).select(
        "run_id",
        F.when(F.size("hints") == 0, F.array(F.lit(HINT_NONE)))
        .otherwise(F.col("hints"))
        .alias("guidance"),
    )


def is_finished() -> Column:
    return ~F.upper(F.coalesce(trimmed("status"), F.lit(""))).isin("QUEUED", "RUNNING")


def checks_total(runs: DataFrame) -> DataFrame:
    """Counters by phase, contract and outcome: every run was queued once, finished runs ended."""
    outcome = F.upper(blank_to("status", F.lit("unknown")))
    phases = F.concat(
        F.array(F.struct(F.lit("queued").alias("phase"), F.lit(None).cast("string").alias("o"))),
        F.when(
            is_finished(), F.array(F.struct(F.lit("completed").alias("phase"), outcome.alias("o")))
        ).otherwise(F.array().cast("array<struct<phase:string,o:string>>")),
    )
    return (
        runs.select(tag_value("contract_id").alias("contract_id"), F.explode(phases).alias("p"))
        .groupBy("contract_id", F.col("p.phase").alias("phase"), F.col("p.o").alias("outcome"))
        .agg(F.count(F.lit(1)).alias("checks"))
    )


def checks_latency(runs: DataFrame) -> DataFrame:
    """Count, total, maximum and mean milliseconds of finished runs per contract."""
    took = F.unix_millis(time_of("finished_at")) - F.unix_millis(time_of("started_at"))
    return (
        runs.filter(is_finished())
        .select(tag_value("contract_id").alias("contract_id"), took.alias("ms"))
        .filter("ms is not null")
        .groupBy("contract_id")
        .agg(
            F.count(F.lit(1)).alias("runs"),
            F.sum("ms").alias("total_ms"),
            F.max("ms").alias("max_ms"),
            (F.sum("ms") / F.count(F.lit(1))).alias("mean_ms"),
        )
    )


def checks_failed(runs: DataFrame, audit: DataFrame) -> DataFrame:
    """Failures by category: breaking changes, execution errors, rejected requests."""
    category = F.when(
        F.coalesce(
            F.get(parse_details("warnings"), F.lit(0)).startswith(EXECUTION_ERROR), F.lit(False)
        ),
        "execution_error",
    ).otherwise("compatibility_breaking")
    from_runs = runs.filter(F.upper("status") == "FAIL").select(
        tag_value("contract_id").alias("contract_id"), category.alias("category")
    )
    from_audit = audit.filter(
        (F.col("action") == "CHECK_RUN_CREATE") & (F.col("status") == "FAILURE")
    ).select(
        tag_value(F.get_json_object("detail", "$.contractId")).alias("contract_id"),
        F.lit("create_error").alias("category"),
    )
    return (
        from_runs.unionByName(from_audit)
        .groupBy("contract_id", "category")
        .agg(F.count(F.lit(1)).alias("failures"))
    )


def log_fields(logs: DataFrame) -> DataFrame:
    """Log rows with the fields of their messages."""
    return logs.select(
        "log_id",
        "run_id",
        "level",
        log_field("message", "code").alias("code"),
        log_field("message", "attempt").try_cast("int").alias("attempt"),
        log_field("message", "maxRetries").try_cast("int").alias("max_retries"),
        log_field("message", "status").alias("status"),
        log_field("message", "message").alias("text"),
    )


def log_attempts(logs: DataFrame) -> DataFrame:
    """Failed attempts per run."""
    return (
        log_fields(logs)
        .filter(F.col("code") == "check_run_attempt_failed")
        .groupBy("run_id")
        .agg(F.max("attempt").alias("attempts"), F.count(F.lit(1)).alias("failed_logs"))
    )


def audit_count(audit: DataFrame) -> DataFrame:
    return audit.groupBy("action", "status").agg(F.count(F.lit(1)).alias("rows"))


def latest_audit(audit: DataFrame, limit: int = 5) -> DataFrame:
    return (
        audit.orderBy(F.desc(time_of()), F.desc("audit_id"))
        .limit(limit)
        .select(
            "audit_id", "action", "status", "actor", "actor_roles", "resource_id", "created_at"
        )
    )
