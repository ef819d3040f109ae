"""Set-based upkeep of the history: filling legacy rows, status transitions.

Parquet has no MERGE: these operators return the new snapshot, to be written beside the old one, or slot
by slot in place of it (plans.stored_upkeep).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pactlake.functions.details import details_json, input_hash
from pactlake.functions.ids import stable_id
from pactlake.functions.text import blank_to, blank_to_null, normalize_mode, trimmed
from pactlake.schemas import DEFAULT_MODE
from pactlake.session import shared_folder

LEGACY_MESSAGE = "Legacy check run backfilled without original execution logs."
FILLED = ["triggered_by", "compatibility_mode", "input_hash", "started_at", "finished_at"]


def is_legacy() -> Column:
    found = F.lit(False)
    for column in FILLED:
        found = found | F.col(column).isNull()
    return found


def _status() -> Column:
    return F.upper(F.coalesce(trimmed("status"), F.lit("")))


def backfill_runs(
    runs: DataFrame,
    contracts: DataFrame,
    now: str,
    default_mode: str = DEFAULT_MODE,
    default_triggered_by: str = "legacy",
) -> DataFrame:
    """Every run with its missing fields filled, and whether the row changed."""
    modes = contracts.select(
        F.col("contract_id").alias("known_id"),
        normalize_mode("compatibility_mode", F.lit(default_mode)).alias("contract_mode"),
    )
    joined = runs.join(modes, trimmed("contract_id") == F.col("known_id"), "left")
    triggered = blank_to("triggered_by", F.lit(default_triggered_by))
    mode = normalize_mode("compatibility_mode", F.coalesce("contract_mode", F.lit(default_mode)))
    created = blank_to("created_at", F.lit(now))
    hashed = F.coalesce(
        blank_to_null("input_hash"),
        input_hash(
            "contract_id", "base_version", "candidate_version", mode, "commit_sha", triggered
        ),
    )
    started = F.coalesce(
        blank_to_null("started_at"), F.when(_status() != "QUEUED", created)
    )
    finished = F.coalesce(
        blank_to_null("finished_at"),
        F.when(~_status().isin("QUEUED", "RUNNING"), created),
    )
    new = dict(zip(FILLED, (triggered, mode, hashed, started, finished)))
    changed = F.lit(False)
    for column, value in new.items():
        changed = changed | ~value.eqNullSafe(F.col(column))
    return joined.withColumn("legacy", is_legacy()).select(
        *[
            F.when(F.col("legacy"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c)
            for c in runs.columns
        ],
        (F.col("legacy") & changed).alias("changed"),
    )


def backfill_logs(runs: DataFrame, logs: DataFrame, now: str) -> DataFrame:
    """One log row for every finished legacy run that has none.

    Logs are reduced to distinct run ids first, so a run with very many logs costs nothing.
    """
    wanted = runs.filter(is_legacy() & ~_status().isin("QUEUED", "RUNNING"))
    at = F.coalesce(
        blank_to_null("finished_at"), blank_to("created_at", F.lit(now))
    )
    return (
        wanted.join(logs.select("run_id").distinct(), "run_id", "left_anti")
        .select(
            stable_id(F.col("run_id"), F.lit(LEGACY_MESSAGE)).alias("log_id"),
            "run_id",
            F.lit("INFO").alias("level"),
            F.lit(LEGACY_MESSAGE).alias("message"),
            at.alias("created_at"),
        )
    )


def legal_transition() -> Column:
    """QUEUED→RUNNING, RUNNING→PASS or FAIL, RUNNING→QUEUED."""
    before, after = F.col("expected_status"), F.col("new_status")
    return ((before == "QUEUED") & (after == "RUNNING")) | (
        (before == "RUNNING") & after.isin("PASS", "FAIL", "QUEUED")
    )


#: Updates dealt to one task on average; and of one run and task handled as one array.
TASK_STEPS, CHUNK = 50_000, 256


def _step(status: Column, step: Column) -> Column:
    """The status after a step, which is a map of the two statuses that can be left."""
    return F.when(status == "QUEUED", step["queued"]).when(status == "RUNNING", step["running"]).otherwise(status)


def _after_all(steps: Column, start: str) -> Column:
    return F.aggregate(steps, F.lit(start), lambda s, u: _step(s, u))


def _before_each(steps: Column, start: Column) -> Column:
    """The status before each of some steps, for a status before all of them."""
    at_start = F.struct(start.alias("now"), F.array().cast("array<string>").alias("seen"))
    return F.aggregate(
        steps,
        at_start,
        lambda acc, u: F.struct(_step(acc["now"], u).alias("now"), F.array_append(acc["seen"], acc["now"]).alias("seen")),
        lambda acc: acc["seen"],
    )


def _composed(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """(group, steps, queued, running): the steps of each group in order, and as one map."""
    one = F.struct(*order, "queued", "running")
    rows = rows.groupBy(*group).agg(F.array_sort(F.collect_list(one)).alias("steps"))
    return rows.select("*", _after_all(F.col("steps"), "QUEUED").alias("queued"), _after_all(F.col("steps"), "RUNNING").alias("running"))


def _spread(groups: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """(group, order, status_before) of each step, from groups with the `status_before` all of them."""
    seen = _before_each(F.col("steps"), F.col("status_before"))
    rows = groups.select(*group, F.explode(F.arrays_zip("steps", seen.alias("seen"))).alias("one"))
    return rows.select(*group, *[F.col(f"one.steps.{c}").alias(c) for c in order], F.col("one.seen").alias("status_before"))


def stored_updates(updates: DataFrame) -> DataFrame:
    """A batch of updates as a written table: it is read several times, and deriving it may be dear."""
    path = shared_folder(updates.sparkSession, "updates")
    updates.write.parquet(path)
    return updates.sparkSession.read.parquet(path)


def transition_steps(runs: DataFrame, updates: DataFrame, stored: bool = False) -> DataFrame:
    """The updates, all their columns, with `status_before`, the run's status when an update's turn comes, whether it is
    `applied`, and the reason if not.

    Each update of a run meets the status that those before it, by time and id, have left. An update maps each status
    to one, and such maps compose, so a run's updates are cut into ranges that tasks compose on their own, each in
    chunks; the maps of the ranges are run through once and the statuses handed down again. A run with very many
    updates is spread like any others. update_id is unique. stored: the updates are a written table already."""
    spark = runs.sparkSession
    updates = updates if stored else stored_updates(updates)
    place = ["run_id", "at", "update_id"]
    legal = updates.filter(legal_transition()).select(
        *place,
        F.when(F.col("expected_status") == "QUEUED", F.col("new_status")).otherwise("QUEUED").alias("queued"),
        F.when(F.col("expected_status") == "RUNNING", F.col("new_status")).otherwise("RUNNING").alias("running"),
    )
    tasks = legal.count() // TASK_STEPS + 1
    ranged = legal.repartitionByRange(tasks, *place).withColumn("range", F.spark_partition_id())
    path = shared_folder(spark, "transitions")
    # Written, as the ranges are drawn from a sample and the rows are read more than once.
    ranged.write.parquet(path)
    nth = F.row_number().over(Window.partitionBy("run_id", "range").orderBy("at", "update_id"))
    steps = spark.read.parquet(path).withColumn("chunk", F.floor((nth - 1) / CHUNK))
    chunks = _composed(steps, ["run_id", "range", "chunk"], ["at", "update_id"])
    ranges = _composed(chunks.drop("steps"), ["run_id", "range"], ["chunk"])
    whole = _composed(ranges.drop("steps"), ["run_id"], ["range"])
    current = runs.select("run_id", F.col("status").alias("status_before"))
    before = _spread(whole.join(current, "run_id"), ["run_id"], ["range"])
    before = _spread(ranges.join(before, ["run_id", "range"]), ["run_id", "range"], ["chunk"])
    before = _spread(chunks.join(before, ["run_id", "range", "chunk"]), ["run_id"], ["at", "update_id"])
    before = before.select(F.col("update_id").alias("step_id"), F.col("status_before").alias("then"))
    current = runs.select(F.col("run_id").alias("stored_id"), F.col("status").alias("stored"))
    met = updates.join(before, F.col("update_id") == F.col("step_id"), "left").join(
        current, F.col("run_id") == F.col("stored_id"), "left"
    )
    expected, then = F.col("expected_status"), F.col("then")
    legal_now = F.coalesce(legal_transition(), F.lit(False))
    reason = (
        F.when(~legal_now, "illegal_transition")
        .when(F.col("stored").isNull(), "run_not_found")
        .when(then == expected, F.lit(None))
        # What the stored run allowed, an earlier update of the batch has overtaken.
        .when(F.col("stored") == expected, "superseded")
        .otherwise("status_mismatch")
    )
    return met.select(*updates.columns, then.alias("status_before"), reason.alias("reason")).withColumn(
        "applied", F.col("reason").isNull()
    )


def apply_transitions(runs: DataFrame, updates: DataFrame) -> DataFrame:
    """The runs after a batch of updates, applied in order of time and id, each guarded by the status it expects.

    updates: update_id, run_id, expected_status, new_status, breaking_changes, warnings (arrays), at.
    """
    return after_steps(runs, transition_steps(runs, updates))


def after_steps(runs: DataFrame, steps: DataFrame) -> DataFrame:
    """The runs with what the applied ones of transition_steps leave. Values are assigned, whatever the run
    holds, so doing it again changes nothing."""
    steps = steps.where("applied")
    to, order = F.col("new_status"), F.struct("at", "update_id")
    ended = to.isin("PASS", "FAIL")

    def last(condition: Column, *values: Column) -> Column:
        """Of the last update of a kind; without a struct around it a null could not win."""
        return F.max_by(F.when(condition, F.struct(*values)), F.when(condition, order))

    end = [details_json("breaking_changes").alias("breaking"), details_json("warnings").alias("warned")]
    found = steps.groupBy(F.col("run_id").alias("u_run_id")).agg(
        F.max_by("new_status", order).alias("u_status"),
        last(ended, *end).alias("u_end"),
        last(to.isin("RUNNING", "QUEUED"), F.when(to == "RUNNING", F.col("at")).alias("at")).alias("u_start"),
        last(ended | (to == "QUEUED"), F.when(ended, F.col("at")).alias("at")).alias("u_finish"),
    )
    joined = runs.join(found, F.col("run_id") == F.col("u_run_id"), "left")

    def or_old(group: str, value: str, old: str) -> Column:
        return F.when(F.col(group).isNotNull(), F.col(f"{group}.{value}")).otherwise(F.col(old))

    new = {
        "status": F.coalesce("u_status", "status"),
        "breaking_changes": or_old("u_end", "breaking", "breaking_changes"),
        "warnings": or_old("u_end", "warned", "warnings"),
        "started_at": or_old("u_start", "at", "started_at"),
        "finished_at": or_old("u_finish", "at", "finished_at"),
    }
    return joined.select(*[new.get(c, F.col(c)).alias(c) for c in runs.columns])


def skipped_updates(runs: DataFrame, updates: DataFrame) -> DataFrame:
    """Updates that changed nothing, with the reason and the run's status when their turn came."""
    steps = transition_steps(runs, updates).where("reason is not null")
    return steps.select("update_id", "run_id", "expected_status", "new_status", "status_before", "reason")
