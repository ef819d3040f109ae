"""Registered queries: each operator over the whole of the derived tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from pactlake.functions import text
from pactlake.functions.details import details_json, input_hash, parse_details
from pactlake.functions.versions import version_name, version_num, version_of
from pactlake.operators import (
    catalog,
    compat,
    diff,
    documents,
    history,
    insights,
    lint,
    nested,
    ordering,
    pack_tables,
    payloads,
    policy,
    requests,
    upkeep,
)
from pactlake.plans import gate, refresh, registration, request_batch, stored_upkeep
from pactlake.schemas import PAIR
from pactlake.session import prepare, shared_folder
from pactlake.sinks import history as sinks
from pactlake.sources import feeds, history as read_history
from pactlake.streaming.metrics_stream import read_metrics, start_metrics
from pactlake.streaming.payload_stream import read_checked, start_payload_check
from pactlake.streaming.request_stream import start_request_checks
from proving import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
NOW = "2026-01-01T00:00:00.000Z"


def query(run: Query) -> Query:
    def prepared(spark: SparkSession, sf: str) -> DataFrame:
        return run(prepare(spark), sf)

    QUERIES[run.__name__] = prepared
    return prepared


def listed(column: str, separator: str = "; ") -> Column:
    """Lists as text, which both engines compare alike."""
    return F.array_join(column, separator).alias(column)


def stored(spark: SparkSession, name: str, rows: DataFrame) -> DataFrame:
    """Derived rows as a written table: a registry is stored, and its readers read it more than
    once. Cuts the lineage and survives lost executors."""
    path = shared_folder(spark, name)
    rows.write.parquet(path)
    return spark.read.parquet(path)


def evolving_shapes(spark: SparkSession, sf: str) -> DataFrame:
    docs = fx.evolving_documents(spark, sf)
    return stored(spark, "shapes", documents.schema_shapes(docs))


def evolving_versions(spark: SparkSession, sf: str) -> DataFrame:
    return (
        fx.evolving_fields(spark, sf).select("contract_id", "version", "version_num").distinct()
    )


def churning_shapes(spark: SparkSession, sf: str) -> DataFrame:
    docs = fx.churning_documents(spark, sf)
    return stored(spark, "shapes", documents.schema_shapes(docs))


# --- documents and pairs -----------------------------------------------------------------------


@query
def schema_fields(spark, sf):
    docs = fx.schema_docs(fx.churning_fields(spark, sf))
    return documents.explode_schema(docs).withColumn("enum_values", listed("enum_values", ","))


@query
def display_types(spark, sf):
    fields = fx.churning_fields(spark, sf)
    return fields.groupBy(
        documents.display_type(F.col("type"), F.col("nullable")).alias("display_type"), "required"
    ).agg(F.count(F.lit(1)).alias("fields"))


@query
def adjacent_pairs(spark, sf):
    return ordering.adjacent_pairs(fx.evolving_fields(spark, sf))


@query
def latest_pairs(spark, sf):
    return ordering.latest_pairs(fx.evolving_fields(spark, sf))


@query
def schema_diff(spark, sf):
    both = ordering.adjacent_documents(churning_shapes(spark, sf))
    return diff.change_rows(diff.with_changes(both))


@query
def diff_report(spark, sf):
    both = ordering.adjacent_documents(churning_shapes(spark, sf))
    return diff.change_report(diff.with_changes(both))


# --- compatibility -----------------------------------------------------------------------------


def _adjacent_verdicts(spark, sf, mode: str, pack: str = "baseline") -> DataFrame:
    both = ordering.adjacent_documents(evolving_shapes(spark, sf))
    checks = diff.with_changes(both).withColumns({"mode": F.lit(mode), "pack": F.lit(pack)})
    return _shown(compat.with_verdict(checks, fx.packs()))


def _shown(results: DataFrame) -> DataFrame:
    if "execution_error" not in results.columns:
        results = results.drop("error")
    return results.withColumns(
        {"breaking_changes": listed("breaking_changes"), "warnings": listed("warnings")}
    )


@query
def compat_backward(spark, sf):
    return _adjacent_verdicts(spark, sf, "BACKWARD")


@query
def compat_forward(spark, sf):
    return _adjacent_verdicts(spark, sf, "FORWARD")


@query
def compat_full(spark, sf):
    return _adjacent_verdicts(spark, sf, "FULL")


@query
def compat_full_null_severity(spark, sf):
    return _adjacent_verdicts(spark, sf, "FULL", "nullsev")


@query
def compat_by_contract_policy(spark, sf):
    shapes, packs = evolving_shapes(spark, sf), fx.packs()
    owners = fx.contracts(spark, sf).select(
        "contract_id",
        F.col("compatibility_mode").alias("mode"),
        packs.resolve("policy_pack").alias("pack"),
    )
    both = ordering.adjacent_documents(shapes).join(owners, "contract_id")
    return _shown(compat.with_verdict(diff.with_changes(both), packs))


@query
def compat_churn(spark, sf):
    both = ordering.adjacent_documents(churning_shapes(spark, sf))
    checks = diff.with_changes(both).withColumns({"mode": F.lit("FULL"), "pack": F.lit("relaxed")})
    return _shown(compat.with_verdict(checks, fx.packs()))


@query
def compat_errors(spark, sf):
    """Checks of which many cannot be judged: bad documents, absent versions, bad modes."""
    shapes = stored(spark, "shapes", documents.schema_shapes(fx.faulty_docs(spark, sf)))
    pairs = [("v1", "v2"), ("v2", "v9999"), ("v1", "v3000000000")]
    pair = F.explode(F.array(*[F.struct(F.lit(b).alias("b"), F.lit(c).alias("c")) for b, c in pairs]))
    mode = fx.pick(fx.customer_key(), "BACKWARD", "SIDEWAYS", None, "BACKWARD\t", "FULL")
    checks = shapes.select("contract_id").distinct().select("contract_id", mode.alias("mode"), pair.alias("p"))
    checks = checks.select(
        "contract_id",
        F.col("p.b").alias("base_version"),
        F.col("p.c").alias("candidate_version"),
        "mode",
        F.lit("baseline").alias("pack"),
    )
    results = compat.check_compatibility(shapes, checks, fx.packs())
    return results.select(*PAIR, "mode", (F.col("status") != "ERROR").alias("judged"), "error")


@query
def contract_policies(spark, sf):
    packs = fx.packs()
    owners = fx.contracts(spark, sf).select(
        "contract_id", packs.resolve("policy_pack").alias("pack")
    )
    return owners.join(packs.rules(spark), "pack").select(
        "contract_id", "pack", "rule_id", "severity"
    )


@query
def policy_rule_errors(spark, sf):
    return policy.rule_errors(fx.policy_configs(spark, sf))


@query
def pack_table(spark, sf):
    """Every pack of every customer's configuration, and why a configuration has none."""
    rows = pack_tables.pack_rows(fx.policy_configs(spark, sf))
    return rows.withColumn("levels", listed("levels", ","))


@query
def compat_own_packs(spark, sf):
    """All adjacent versions, each contract under its mode and a pack of its own configuration."""
    packs = stored(spark, "packs", pack_tables.pack_rows(fx.policy_configs(spark, sf)))
    owners = fx.contracts(spark, sf).select(
        "contract_id",
        F.col("contract_id").alias("config_id"),
        "policy_pack",
        F.col("compatibility_mode").alias("mode"),
    )
    owners = pack_tables.resolved(owners, packs).drop("config_id", "policy_pack")
    both = ordering.adjacent_documents(evolving_shapes(spark, sf)).join(owners, "contract_id")
    results = compat.with_verdict(diff.with_changes(both))
    return results.withColumns(
        {"breaking_changes": listed("breaking_changes"), "warnings": listed("warnings")}
    )


# --- lint and catalogue ------------------------------------------------------------------------


@query
def lint_violations(spark, sf):
    return lint.lint_contracts(fx.faulty_contracts(spark, sf), fx.faulty_docs(spark, sf))


@query
def lint_failing_contracts(spark, sf):
    return lint.failing_contracts(lint_violations(spark, sf))


@query
def document_errors(spark, sf):
    return lint.document_errors(fx.faulty_docs(spark, sf))


@query
def contract_catalog(spark, sf):
    return catalog.contract_catalog(
        fx.contracts(spark, sf), evolving_versions(spark, sf), fx.packs()
    )


@query
def contract_search(spark, sf):
    return catalog.search_contracts(contract_catalog(spark, sf), " MACH ")


@query
def contract_versions(spark, sf):
    return catalog.contract_versions(evolving_versions(spark, sf))


@query
def contract_document(spark, sf):
    docs = fx.schema_docs(fx.churning_fields(spark, sf))
    return catalog.contract_document(docs, " cust.7", "v2.json")


@query
def contract_count(spark, sf):
    return catalog.contract_count(fx.contracts(spark, sf))


def version_files(spark: SparkSession, sf: str) -> DataFrame:
    return fx.table(spark, sf, "orders").select(
        fx.contract_of("o_custkey").alias("contract_id"), F.col("o_orderdate").alias("modified_at")
    )


@query
def contract_modified(spark, sf):
    return catalog.contract_modified(version_files(spark, sf)).withColumn(
        "modified_at", F.date_format("modified_at", "yyyy-MM-dd HH:mm:ss")
    )


# --- history -----------------------------------------------------------------------------------


def _response(rows: DataFrame) -> DataFrame:
    return rows.withColumns(
        {"breaking_changes": listed("breaking_changes"), "warnings": listed("warnings")}
    )


@query
def runs_list(spark, sf):
    return _response(history.list_runs(fx.check_runs(spark, sf)))


@query
def runs_page(spark, sf):
    asked = history.RunQuery.of(status=" pass ", limit=50, offset=100)
    return _response(history.page_runs(fx.check_runs(spark, sf), asked))


@query
def recent_runs(spark, sf):
    return _response(history.recent_runs(fx.check_runs(spark, sf)))


@query
def run_by_id(spark, sf):
    return _response(history.find_run(fx.check_runs(spark, sf), " run-7 "))


@query
def run_logs(spark, sf):
    return history.run_logs(fx.check_run_logs(spark, sf), "run-7")


@query
def history_round_trip(spark, sf):
    """Runs, logs and audit rows written, read back, and joined."""
    folder = shared_folder(spark, "history")
    sinks.write_check_runs(fx.check_runs(spark, sf), f"{folder}/runs")
    sinks.write_run_logs(fx.check_run_logs(spark, sf), f"{folder}/logs")
    sinks.write_audit_rows(fx.audit_logs(spark, sf), f"{folder}/audit")
    runs = read_history.read_check_runs(spark, f"{folder}/runs")
    logs = read_history.read_check_run_logs(spark, f"{folder}/logs")
    audits = read_history.read_audit_logs(spark, f"{folder}/audit")
    kept = logs.groupBy("run_id").agg(F.count(F.lit(1)).alias("logs"), F.max("message").alias("message"))
    stored_runs = runs.join(kept, "run_id", "left").select(
        F.lit("run").alias("kind"),
        F.col("run_id").alias("id"),
        "status",
        "created_at",
        F.coalesce("logs", F.lit(0)).alias("logs"),
        "message",
    )
    nothing = F.lit(None).cast("string")
    return stored_runs.union(
        audits.select(F.lit("audit"), "audit_id", "status", "created_at", F.lit(0).cast("long"), nothing)
    )


@query
def stored_run_by_id(spark, sf):
    """One run and its logs from the stored tables, of which one folder each is read."""
    folder = shared_folder(spark, "history")
    sinks.write_check_runs(fx.check_runs(spark, sf), f"{folder}/runs")
    sinks.write_run_logs(fx.check_run_logs(spark, sf), f"{folder}/logs")
    run = history.find_run(read_history.read_check_runs(spark, f"{folder}/runs"), " run-7 ")
    logs = history.run_logs(read_history.read_check_run_logs(spark, f"{folder}/logs"), "run-7")
    return run.select("run_id", "status", "commit_sha").join(
        logs.select("run_id", "log_id", "level", "message"), "run_id"
    )


@query
def runs_page_after(spark, sf):
    """The page behind the newest 25 runs, by the last of them."""
    runs = fx.check_runs(spark, sf)
    asked = history.RunQuery.of(limit=25)
    last = history.page_runs(runs, asked).filter("position = 25").select("created_at", "run_id").first()
    return _response(history.page_after(runs, asked, last.created_at, last.run_id))


@query
def run_with_logs(spark, sf):
    return history.run_with_logs(fx.check_runs(spark, sf), fx.check_run_logs(spark, sf))


@query
def oldest_queued(spark, sf):
    return history.oldest_queued(fx.check_runs(spark, sf))


@query
def parsed_details(spark, sf):
    runs = fx.check_runs(spark, sf)
    return runs.select(
        "run_id",
        F.explode(
            F.concat(
                F.transform(
                    parse_details("breaking_changes"),
                    lambda m, i: F.struct(
                        F.lit("breaking").alias("kind"), i.alias("place"), m.alias("message")
                    ),
                ),
                F.transform(
                    parse_details("warnings"),
                    lambda m, i: F.struct(
                        F.lit("warning").alias("kind"), i.alias("place"), m.alias("message")
                    ),
                ),
            )
        ).alias("d"),
    ).select("run_id", "d.kind", "d.place", "d.message")


@query
def details_as_json(spark, sf):
    runs = fx.check_runs(spark, sf)
    return runs.select("run_id", details_json(parse_details("breaking_changes")).alias("json"))


@query
def execution_states(spark, sf):
    runs = fx.check_runs(spark, sf).withColumn(
        "status",
        F.when(fx.customer_key("run_id") % 13 == 0, F.lit(None).cast("string")).otherwise(
            F.lower("status")
        ),
    )
    return runs.groupBy(text.execution_state("status").alias("state")).agg(
        F.count(F.lit(1)).alias("runs")
    )


@query
def input_hashes(spark, sf):
    return fx.check_runs(spark, sf).select(
        "run_id",
        input_hash(
            "contract_id", "base_version", "candidate_version", "compatibility_mode",
            "commit_sha", "triggered_by",
        ).alias("service_hash"),
        input_hash(
            "contract_id", "base_version", "candidate_version", "compatibility_mode",
            "commit_sha", "triggered_by", blank_mode="BACKWARD",
        ).alias("cli_hash"),
    )


@query
def normalised_values(spark, sf):
    c = F.col("c_custkey")
    raw = fx.table(spark, sf, "customer").select(
        "c_custkey",
        fx.pick(c, "v1.json", "v0", "V2", "v007", "v12", "v99999999999", None, " v3", "v4\n").alias(
            "version"
        ),
        fx.pick(c, " backward\t", "Full", "", None, "sideways", "FORWARD\n").alias("mode"),
        fx.pick(c, " a ", "", " \t", None, "b c").alias("note"),
        F.concat(
            fx.pick(
                c,
                "jdbc:postgresql://user:secret@host/db",
                "jdbc:postgresql://host/db?user=u&PASSWORD=p@ss&x=1",
                "jdbc:sqlite:checks.db",
                "jdbc:postgresql://h/db?password=one;password=two",
            ),
            F.lit("#"),
            c,
        ).alias("url"),
        F.split(
            fx.pick(c, "ROLE_B, A,ROLE_A,A", "ROLE_", "", "writer,ROLE_USER ,ROLE_USER"), ","
        ).alias("roles"),
        fx.pick(c, " svc-a , ,svc-b", "", None, "one").alias("consumers"),
    )
    name = version_name(F.col("version"))
    return raw.select(
        "c_custkey",
        name.alias("version_name"),
        version_num(name).alias("version_num"),
        text.normalize_mode("mode", F.lit("-")).alias("mode"),
        text.blank_to("note", F.lit("none")).alias("note_or_none"),
        text.blank_to_null("note").alias("note_or_null"),
        text.dash_if_blank("note").alias("note_or_dash"),
        text.tag_value("note").alias("tag"),
        text.redact_jdbc_url("url").alias("url"),
        text.roles_text("roles").alias("roles"),
        F.array_join(text.consumers_array("consumers"), "|").alias("consumers"),
    )


# --- insights ----------------------------------------------------------------------------------


def impact_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Every contract with the four versions that its runs may name."""
    return fx.contracts(spark, sf).select(
        "contract_id", F.explode(F.array(*[F.lit(f"v{i}") for i in range(1, 5)])).alias("version")
    )


@query
def impact_analysis(spark, sf):
    found = insights.impact_analysis(
        impact_targets(spark, sf), fx.check_runs(spark, sf), fx.contracts(spark, sf)
    )
    return found.withColumn("consumers", listed("consumers", ","))


@query
def impact_consumers(spark, sf):
    return insights.impact_consumers(
        insights.impact_analysis(
            impact_targets(spark, sf), fx.check_runs(spark, sf), fx.contracts(spark, sf)
        )
    )


@query
def contract_badge(spark, sf):
    return insights.contract_badge(fx.contracts(spark, sf), fx.check_runs(spark, sf))


@query
def explain_runs(spark, sf):
    return insights.explain_runs(fx.check_runs(spark, sf))


@query
def run_guidance(spark, sf):
    return insights.run_guidance(fx.check_runs(spark, sf)).withColumn(
        "guidance", listed("guidance", " / ")
    )


@query
def metrics_totals(spark, sf):
    return insights.checks_total(fx.check_runs(spark, sf))


@query
def metrics_latency(spark, sf):
    return insights.checks_latency(fx.check_runs(spark, sf))


@query
def metrics_failures(spark, sf):
    return insights.checks_failed(fx.check_runs(spark, sf), fx.audit_logs(spark, sf))


@query
def log_fields(spark, sf):
    return insights.log_fields(fx.check_run_logs(spark, sf))


@query
def log_attempts(spark, sf):
    return insights.log_attempts(fx.check_run_logs(spark, sf))


@query
def audit_summary(spark, sf):
    return insights.audit_count(fx.audit_logs(spark, sf))


@query
def audit_latest(spark, sf):
    return insights.latest_audit(fx.audit_logs(spark, sf))


# --- upkeep ------------------------------------------------------------------------------------


@query
def backfill_runs(spark, sf):
    return upkeep.backfill_runs(fx.check_runs(spark, sf), fx.contracts(spark, sf), NOW)


@query
def backfill_logs(spark, sf):
    return upkeep.backfill_logs(fx.check_runs(spark, sf), fx.check_run_logs(spark, sf), NOW)


def run_updates(spark: SparkSession, sf: str) -> DataFrame:
    """One update per run, some guarded by another status or for a run that is not there, and a
    second, later one for every ninth."""
    runs = fx.check_runs(spark, sf)
    key = fx.customer_key("run_id")
    expected = F.when(key % 6 == 0, "RUNNING").when(F.col("status") == "QUEUED", "QUEUED").otherwise(
        "RUNNING"
    )
    rows = runs.select(
        key.alias("k"),
        F.when(key % 50 == 0, F.concat(F.lit("gone-"), key)).otherwise(F.col("run_id")).alias("run_id"),
        expected.alias("expected_status"),
        F.when(expected == "QUEUED", "RUNNING")
        .otherwise(fx.pick(key, "PASS", "FAIL", "QUEUED", "QUEUED", "LOST"))
        .alias("new_status"),
        F.explode(F.when(key % 9 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias(
            "turn"
        ),
    )
    return rows.select(
        F.concat(F.lit("u-"), "k", F.lit("-"), "turn").alias("update_id"),
        "run_id",
        "expected_status",
        "new_status",
        F.when(F.col("new_status") == "FAIL", F.array(F.concat(F.lit("Field removed: u"), "turn")))
        .otherwise(F.array().cast("array<string>"))
        .alias("breaking_changes"),
        F.array().cast("array<string>").alias("warnings"),
        F.concat(F.lit("2002-01-01T00:00:0"), "turn", F.lit("Z")).alias("at"),
    )


@query
def apply_transitions(spark, sf):
    return upkeep.apply_transitions(fx.check_runs(spark, sf), run_updates(spark, sf)).select(
        "run_id", "status", "breaking_changes", "warnings", "started_at", "finished_at"
    )


@query
def skipped_updates(spark, sf):
    return upkeep.skipped_updates(fx.check_runs(spark, sf), run_updates(spark, sf)).drop("status_before")


def chained_updates(spark: SparkSession, sf: str) -> DataFrame:
    """Several updates of each run in one batch: claimed, given back, claimed again, ended, ended once more; by key
    some of them come in another order."""
    runs = fx.check_runs(spark, sf)
    key = fx.customer_key("run_id")
    turn = F.col("turn")
    rows = runs.select("run_id", key.alias("k"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("turn"))
    kind = F.pmod(turn * (1 + F.col("k") % 5) + F.col("k"), F.lit(6))
    expected = F.when(kind.isin(0, 2), "QUEUED").otherwise("RUNNING")
    new = F.when(kind.isin(0, 2), "RUNNING").when(kind == 1, "QUEUED").when(kind == 3, "PASS").when(kind == 4, "FAIL")
    listed_turn = F.array(F.concat(F.lit("Field removed: u"), turn))
    return rows.select(
        F.concat(F.lit("u-"), "k", F.lit("-"), turn).alias("update_id"),
        "run_id",
        expected.alias("expected_status"),
        F.coalesce(new, F.lit("LOST")).alias("new_status"),
        F.when(kind == 4, listed_turn).otherwise(F.array().cast("array<string>")).alias("breaking_changes"),
        F.array().cast("array<string>").alias("warnings"),
        F.concat(F.lit("2002-01-01T00:00:0"), turn, F.lit("Z")).alias("at"),
    )


@query
def transition_chains(spark, sf):
    return upkeep.apply_transitions(fx.check_runs(spark, sf), chained_updates(spark, sf)).select(
        "run_id", "status", "breaking_changes", "warnings", "started_at", "finished_at"
    )


@query
def stored_transitions(spark, sf):
    """The same in a stored history, whose touched slots are written again in place."""
    folder = shared_folder(spark, "history")
    sinks.write_check_runs(fx.check_runs(spark, sf), f"{folder}/runs")
    steps = stored_upkeep.decide_transitions(
        spark, f"{folder}/runs", chained_updates(spark, sf), f"{folder}/steps"
    )
    stored_upkeep.put_transitions(spark, f"{folder}/runs", steps)
    return read_history.read_check_runs(spark, f"{folder}/runs").select(
        "run_id", "status", "breaking_changes", "warnings", "started_at", "finished_at"
    )


@query
def stored_backfill(spark, sf):
    """A stored history after its legacy runs are filled, and the logs of each run counted."""
    folder = shared_folder(spark, "history")
    runs, logs = f"{folder}/runs", f"{folder}/logs"
    sinks.write_check_runs(fx.check_runs(spark, sf), runs)
    sinks.write_run_logs(fx.check_run_logs(spark, sf), logs)
    stored_upkeep.backfill(spark, runs, logs, fx.contracts(spark, sf), NOW)
    counted = read_history.read_check_run_logs(spark, logs).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("logs")
    )
    filled = read_history.read_check_runs(spark, runs).drop("slot").join(counted, "run_id", "left")
    return filled.withColumn("logs", F.coalesce("logs", F.lit(0)))


@query
def transition_steps(spark, sf):
    steps = upkeep.transition_steps(fx.check_runs(spark, sf), chained_updates(spark, sf))
    return steps.select("update_id", "run_id", "status_before", "applied", "reason")


# --- composed work -----------------------------------------------------------------------------


@query
def changed_contract_ids(spark, sf):
    return catalog.changed_contract_ids(fx.changed_files(spark, sf))


def _gate(spark: SparkSession, sf: str, mode: str | None = "BACKWARD") -> DataFrame:
    return gate.changed_gate(
        stored(spark, "files", fx.changed_files(spark, sf)),
        fx.faulty_contracts(spark, sf),
        stored(spark, "docs", fx.faulty_docs(spark, sf)),
        fx.packs(),
        mode,
    )


@query
def changed_gate(spark, sf):
    return _shown(_gate(spark, sf))


@query
def changed_gate_own_mode(spark, sf):
    return _shown(_gate(spark, sf, None))


@query
def changed_gate_result(spark, sf):
    return gate.gate_result(_gate(spark, sf))


@query
def request_validation(spark, sf):
    return requests.validate_requests(fx.single_requests(spark, sf))


def request_shapes(spark: SparkSession, sf: str) -> DataFrame:
    docs = fx.broken_third(fx.evolving_documents(spark, sf))
    return stored(spark, "shapes", documents.schema_shapes(docs))


def _outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return request_batch.request_outcomes(
        fx.check_requests(spark, sf),
        fx.contracts(spark, sf),
        request_shapes(spark, sf),
        fx.packs(),
    )


@query
def request_outcomes(spark, sf):
    return _shown(_outcomes(spark, sf))


@query
def finished_runs(spark, sf):
    return request_batch.finished_runs(_outcomes(spark, sf), NOW)


@query
def lifecycle_logs(spark, sf):
    return sinks.lifecycle_logs(_outcomes(spark, sf).filter("error is null"), NOW)


@query
def queued_runs(spark, sf):
    valid = requests.validate_requests(fx.single_requests(spark, sf)).filter("error is null")
    return sinks.queued_runs(valid, NOW)


@query
def recorded_runs(spark, sf):
    shapes = evolving_shapes(spark, sf)
    checks = ordering.latest_pairs(shapes, unique=True).withColumns(
        {"mode": F.lit("FULL"), "pack": F.lit("strict")}
    )
    results = compat.check_compatibility(shapes, checks, fx.packs())
    return sinks.recorded_runs(results, "batch-1", NOW, commit_sha="head")


@query
def recorded_run_logs(spark, sf):
    return sinks.recorded_run_logs(fx.check_runs(spark, sf))


@query
def audit_rows(spark, sf):
    checked = requests.validate_requests(fx.single_requests(spark, sf))
    return sinks.audit_rows(
        checked,
        "CHECK_RUN_CREATE",
        "check_run",
        NOW,
        key=F.col("request_id"),
        resource_id=F.when(F.col("error").isNull(), F.col("request_id")),
        status=F.when(F.col("error").isNull(), "SUCCESS").otherwise("FAILURE"),
        detail=sinks.request_audit_detail(),
        source=F.col("triggered_by"),
        request_id=F.lit(" "),
        http_method=F.lit("POST"),
        path=F.lit("/checks"),
    )


def last_versions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The evolving documents split in two: a registry without each contract's last version, and
    those last versions."""
    docs = stored(spark, "docs", fx.evolving_documents(spark, sf))
    last = docs.groupBy("contract_id").agg(F.max("version_num").alias("last_num"))
    both = docs.join(last, "contract_id")
    rest = both.filter("version_num < last_num").drop("last_num")
    newest = both.filter("version_num = last_num").drop("last_num")
    return rest, newest


@query
def register_versions(spark, sf):
    rest, docs = last_versions(spark, sf)
    key = fx.customer_key()
    top = F.max("version_num").over(Window.partitionBy("contract_id"))
    broken = (key % 20 == 9) & (F.col("version_num") == F.col("top"))
    rest = rest.withColumn("top", top).withColumn(
        "schema_json", F.when(broken, "{not json").otherwise(F.col("schema_json"))
    )
    candidates = docs.select(
        F.when(key % 10 == 3, F.concat(F.lit("ghost."), key))
        .when(key % 10 == 4, F.concat(F.lit("Cust-"), key))
        .otherwise(F.concat(F.lit(" "), "contract_id"))
        .alias("contract_id"),
        F.when(key % 10 == 1, version_of(F.col("version_num") + 2))
        .when(key % 10 == 2, "v2")
        .when(key % 10 == 5, "two")
        .when(key % 20 == 0, "v99999999999")
        .otherwise(F.concat("version", F.lit(" ")))
        .alias("version"),
        F.when(key % 10 == 6, '{"properties":{"a":{}}}')
        .when(key % 30 == 7, "[]")
        .otherwise(F.col("schema_json"))
        .alias("schema_json"),
    )
    shapes = stored(spark, "shapes", documents.schema_shapes(rest.drop("top")))
    mode = F.when(key % 20 == 8, "SIDEWAYS").when(key % 20 != 18, F.col("compatibility_mode"))
    owner = F.when(key % 20 == 10, " \t").otherwise(F.col("owner_team"))
    owners = fx.contracts(spark, sf).withColumns({"compatibility_mode": mode, "owner_team": owner})
    return registration.register_versions(candidates, owners, shapes, fx.packs())


@query
def register_chains(spark, sf):
    """The last four versions of each contract in one batch; by key one is left out, sent twice, or unreadable."""
    docs = stored(spark, "docs", fx.evolving_documents(spark, sf))
    last = docs.groupBy("contract_id").agg(F.max("version_num").alias("last_num"))
    both = docs.join(last, "contract_id")
    key, back = fx.customer_key(), F.col("last_num") - F.col("version_num")
    rest = both.filter(back >= 4).drop("last_num")
    newest = both.filter((back < 4) & ~((key % 10 == 1) & (back == 1)))
    candidates = newest.select(
        "contract_id",
        "version",
        F.when((key % 10 == 3) & (back == 2), '{"properties":{"a":{}}}').otherwise(F.col("schema_json")).alias("schema_json"),
        F.explode(F.when((key % 10 == 2) & (back == 0), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))),
    ).drop("col")
    shapes = stored(spark, "shapes", documents.schema_shapes(rest))
    return registration.register_versions(candidates, fx.contracts(spark, sf), shapes, fx.packs())


@query
def register_contracts(spark, sf):
    rows = fx.contracts(spark, sf)
    key = fx.customer_key()
    fault = key % 20
    asked = rows.select(
        F.when(fault == 1, "  ")
        .when(fault == 2, F.concat(F.lit("New."), key))
        .when(key % 4 == 0, F.col("contract_id"))
        .otherwise(F.concat(F.lit(" new."), key))
        .alias("contract_id"),
        F.when(fault == 3, "").otherwise(F.col("owner_team")).alias("owner_team"),
        F.when(fault == 5, "\t").otherwise(F.col("domain")).alias("domain"),
        F.when(fault == 6, "SIDEWAYS")
        .when(fault == 7, F.lit(None).cast("string"))
        .otherwise(F.lower("compatibility_mode"))
        .alias("compatibility_mode"),
        "policy_pack",
        F.when(fault == 9, "x1").when(key % 3 == 0, " v4").when(key % 3 == 1, "").alias(
            "initial_version"
        ),
        F.when(fault == 10, "[]")
        .when(fault == 11, '{"properties":{"a":{"type":"unknown"}}}')
        .otherwise('{"type":"object","properties":{"id":{"type":"string"}},"required":["id"]}')
        .alias("schema_json"),
    )
    return registration.register_contracts(asked, rows)


def stored_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """An older snapshot: some contracts missing, some older, some since removed."""
    now = catalog.contract_modified(version_files(spark, sf))
    key = fx.customer_key()
    return now.filter(key % 7 != 0).select(
        F.when(key % 11 == 0, F.concat(F.lit("gone."), key))
        .otherwise(F.col("contract_id"))
        .alias("contract_id"),
        F.when(key % 5 == 0, F.timestamp_add("DAY", F.lit(-1), F.col("modified_at")))
        .otherwise(F.col("modified_at"))
        .alias("modified_at"),
    )


@query
def refresh_status(spark, sf):
    found = refresh.refresh_status(version_files(spark, sf), stored_snapshot(spark, sf))
    return found.withColumn("modified_at", F.date_format("modified_at", "yyyy-MM-dd HH:mm:ss"))


@query
def incremental_refresh(spark, sf):
    before = contract_catalog(spark, sf).withColumn("owner_team", F.lit("stored"))
    status = refresh.refresh_status(version_files(spark, sf), stored_snapshot(spark, sf))
    return refresh.incremental_refresh(
        stored(spark, "catalog", before),
        fx.contracts(spark, sf),
        evolving_versions(spark, sf),
        fx.packs(),
        stored(spark, "status", status),
    )


# --- payloads and streams ----------------------------------------------------------------------


@query
def payload_conformance(spark, sf):
    checked = payloads.check_payloads(fx.payloads(spark, sf), fx.event_docs(spark, sf))
    return checked.drop("payload").withColumn("violations", listed("violations", ","))


@query
def payload_keywords(spark, sf):
    checked = payloads.check_payloads(fx.keyword_payloads(spark, sf), fx.keyword_docs(spark))
    return checked.select("payload_id", "valid", listed("violations", ","))


@query
def payload_nested(spark, sf):
    rows = fx.nested_payloads(fx.table(spark, sf, "events"))
    checked = nested.check_whole(spark, rows, fx.nested_docs(spark))
    return checked.select("payload_id", "valid", listed("violations", ","))


@query
def stream_payload_nested(spark, sf):
    """The whole check as a stream over the event files."""
    folder = shared_folder(spark, "payload-stream")
    events = spark.readStream.schema(fx.table(spark, sf, "events").schema).parquet(f"{sf}/*events.parquet")
    start_payload_check(
        fx.nested_payloads(events), fx.nested_docs(spark), f"{folder}/checked", f"{folder}/checkpoint", whole=True
    ).awaitTermination()
    checked = read_checked(spark, f"{folder}/checked")
    return checked.select("payload_id", "valid", listed("violations", ","))


@query
def payload_violations(spark, sf):
    return payloads.payload_violations(
        payloads.check_payloads(fx.payloads(spark, sf), fx.event_docs(spark, sf))
    )


@query
def stream_payload_conformance(spark, sf):
    """The payload check as a stream over the event files, run until all input is processed."""
    folder = shared_folder(spark, "payload-stream")
    events = spark.readStream.schema(fx.table(spark, sf, "events").schema).parquet(
        f"{sf}/*events.parquet"
    )
    start_payload_check(
        fx.payloads_of(events),
        fx.event_docs(spark, sf),
        f"{folder}/checked",
        f"{folder}/checkpoint",
    ).awaitTermination()
    checked = read_checked(spark, f"{folder}/checked")
    return checked.select(
        "contract_id", "version", "payload_id", "valid", listed("violations", ",")
    )


@query
def stream_request_runs(spark, sf):
    """The request batch as a stream over written request files."""
    folder = shared_folder(spark, "request-stream")
    # Several files, one a micro-batch: a request sent twice may come in two batches.
    fx.check_requests(spark, sf).repartition(3).write.parquet(f"{folder}/requests")
    stream = feeds.stream_check_requests(spark, f"{folder}/requests", files_per_trigger=1)
    # Each micro-batch joins the registry, so the registry is written once rather than derived
    # again in every batch.
    start_request_checks(
        stream,
        fx.contracts(spark, sf),
        request_shapes(spark, sf),
        fx.packs(),
        f"{folder}/runs",
        f"{folder}/logs",
        f"{folder}/rejected",
        f"{folder}/checkpoint",
    ).awaitTermination()
    return spark.read.parquet(f"{folder}/runs").select(
        "run_id", *PAIR, "status", "breaking_changes", "warnings", "commit_sha",
        "triggered_by", "compatibility_mode", "input_hash",
    )


def in_batches(rows: DataFrame, batches: int, path: str) -> int:
    """Rows written for a stream of so many micro-batches; returns the files of each. Every core has one, as a file of
    its own for a whole micro-batch is read by a single task."""
    files = rows.sparkSession.sparkContext.defaultParallelism
    rows.repartition(batches * files).write.parquet(path)
    return files


@query
def stream_metrics(spark, sf):
    """Counters, latencies, failures and latest runs kept by a stream over the runs, cut into micro-batches."""
    folder = shared_folder(spark, "metrics-stream")
    runs = fx.check_runs(spark, sf)
    files = in_batches(runs, 5, f"{folder}/runs")
    stream = spark.readStream.schema(runs.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/runs")
    start_metrics(spark, stream, f"{folder}/metrics", f"{folder}/checkpoint", every=2).awaitTermination()
    return read_metrics(spark, f"{folder}/metrics").select(
        "contract_id", "measure", "tag", "n", "total_ms", "max_ms", F.col("latest.run_id").alias("run_id"), F.col("latest.status").alias("status")
    )
