import json
import re

import pytest
from conftest import STATION_V1, STATION_V2, PACKS
from pyspark.sql import functions as F

from pactlake.operators import history as questions
from pactlake.operators.compat import check_compatibility
from pactlake.operators.documents import schema_shapes
from pactlake.operators.lint import lint_contracts
from pactlake.operators.ordering import adjacent_pairs
from pactlake.operators.policy import PolicyPacks
from pactlake.schemas import PAYLOADS
from pactlake.sinks import history as sinks
from pactlake.sources import feeds, history, registry
from pactlake.streaming.payload_stream import read_checked, start_payload_check
from pactlake.streaming import request_stream
from pactlake.streaming.request_stream import start_request_checks


@pytest.fixture
def repository(tmp_path):
    def put(path, text):
        file = tmp_path / "contracts" / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(text)

    put("policy-packs.json", PACKS)
    put("o.c/metadata.yaml", "ownerTeam: 007\ndomain: commerce\ncompatibilityMode: BACKWARD\npolicyPack: strict\nconsumers: [a, ' b ', null, '']\n")
    put("o.c/v1.json", json.dumps(STATION_V1, indent=2))
    put("o.c/v10.json", json.dumps(STATION_V2))
    put("o.c/v2.json", json.dumps(STATION_V1))
    put("o.c/v02.json", "not a version")
    put("o.c/vx.json", "not a version")
    put("p.q/metadata.yaml", "ownerTeam: t\ndomain: ~\ncompatibilityMode: full\nconsumers: 'x, ,y'\nextra: 1\n")
    put("empty.meta/metadata.yaml", "# nothing yet\n")
    put("bad.meta/metadata.yaml", "a: [1\n")
    return str(tmp_path / "contracts")


def test_repository(spark, repository):
    docs = registry.read_schema_docs(spark, repository)
    assert {(r.contract_id, r.version, r.version_num) for r in docs.collect()} == {
        ("o.c", "v1", 1), ("o.c", "v2", 2), ("o.c", "v10", 10),
    }
    assert docs.count() == 3
    rows = {r.contract_id: r for r in registry.read_contracts(spark, repository).collect()}
    assert (rows["o.c"].owner_team, rows["o.c"].policy_pack) == ("007", "strict")
    assert rows["o.c"].consumers == ["a", "b"]
    assert (rows["p.q"].domain, rows["p.q"].consumers) == (None, ["x", "y"])
    assert rows["empty.meta"].metadata_error == "metadata.yaml must not be empty."
    assert rows["bad.meta"].metadata_error == "Invalid YAML in metadata file: metadata.yaml"
    found = lint_contracts(registry.read_contracts(spark, repository), docs).collect()
    assert {(r.contract_id, r.rule) for r in found} == {
        ("p.q", "domain_missing"),
        ("p.q", "no_version_files"),
        ("empty.meta", "metadata_malformed"),
        ("empty.meta", "no_version_files"),
        ("bad.meta", "metadata_malformed"),
        ("bad.meta", "no_version_files"),
    }


def test_policy_file(spark, repository, tmp_path):
    packs = registry.read_policy_packs(spark, f"{repository}/policy-packs.json")
    assert packs == PolicyPacks.parse(PACKS)
    assert registry.read_policy_packs(spark, f"{repository}/none.json") == PolicyPacks.parse(None)
    (tmp_path / "big.json").write_text(PACKS + " " * (2 << 20))
    assert registry.read_policy_packs(spark, str(tmp_path / "big.json")) == PolicyPacks.parse(PACKS)
    (tmp_path / "empty.json").write_text("")
    assert registry.read_policy_packs(spark, str(tmp_path / "empty.json")) == PolicyPacks.parse(None)


def test_files_of_zero_bytes_are_known_from_a_listing(spark, repository):
    docs = registry.read_schema_docs(spark, repository)
    listing = spark.createDataFrame(
        [("o.c", "v1.json"), ("o.c", "v3.json"), ("p.q", "v1.json"), ("p.q", "notes.txt")],
        "contract_id string, file string",
    )
    whole = registry.with_unread(docs, listing)
    assert whole.columns == docs.columns and whole.count() == docs.count() + 2
    found = lint_contracts(registry.read_contracts(spark, repository), whole).collect()
    assert {(r.contract_id, r.version) for r in found if r.rule == "schema_not_object"} == {
        ("o.c", "v3"), ("p.q", "v1"),
    }


def test_check_from_files_to_history(spark, repository, tmp_path):
    """Scan, check, store, read back: the whole way."""
    docs = registry.read_schema_docs(spark, repository)
    packs = registry.read_policy_packs(spark, f"{repository}/policy-packs.json")
    checks = adjacent_pairs(docs).withColumns({"mode": F.lit("BACKWARD"), "pack": F.lit("strict")})
    results = check_compatibility(schema_shapes(docs), checks, packs)
    runs = sinks.recorded_runs(results, "b1", "2024-01-01T00:00:00.000Z", commit_sha="head")
    path = str(tmp_path / "runs")
    sinks.write_check_runs(runs, path)
    stored = history.read_check_runs(spark, path)
    assert {(r.base_version, r.candidate_version, r.status) for r in stored.collect()} == {
        ("v1", "v2", "PASS"), ("v2", "v10", "FAIL"),
    }
    logs = sinks.recorded_run_logs(stored)
    sinks.write_run_logs(logs, str(tmp_path / "logs"))
    back = history.read_check_run_logs(spark, str(tmp_path / "logs"))
    assert back.join(stored, "run_id").count() == 2
    wanted = runs.first().run_id
    found = questions.find_run(stored, wanted)
    assert [r.run_id for r in found.collect()] == [wanted]
    scan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*slot#\d+ = \d+", scan)
    assert {r.run_id for r in questions.run_logs(back, wanted).collect()} == {wanted}
    assert {r.run_id for r in runs.collect()} == {r.run_id for r in stored.collect()}


def test_audit_rows(spark, tmp_path):
    df = spark.createDataFrame(
        [("1", "c", None, ["ROLE_B", " A"]), ("2", " ", "boom", [])],
        "id string, contract_id string, error string, roles array<string>",
    )
    rows = sinks.audit_rows(
        df, "CONTRACT_CREATE", "contract", "t",
        key=F.col("id"), resource_id=F.col("contract_id"),
        status=F.when(F.col("error").isNull(), "SUCCESS").otherwise("FAILURE"),
        detail=F.to_json(F.struct("contract_id", "error")), roles=F.col("roles"),
    )
    sinks.write_audit_rows(rows, str(tmp_path / "audit"))
    got = {r.status: r for r in history.read_audit_logs(spark, str(tmp_path / "audit")).collect()}
    assert (got["SUCCESS"].actor_roles, got["SUCCESS"].resource_id) == ("A,B", "c")
    assert (got["FAILURE"].actor_roles, got["FAILURE"].resource_id) == ("-", None)
    assert got["SUCCESS"].audit_id != got["FAILURE"].audit_id


def test_audit_details(spark, tmp_path):
    df = spark.createDataFrame(
        [("c", "t", "d", "FULL", None, "v1", "v2", None), ("c", "t", "d", "FULL", "p", "v1", "v2", "boom")],
        "contract_id string, owner_team string, domain string, compatibility_mode string, "
        "policy_pack string, initial_version string, version string, error string",
    )
    rows = df.select(sinks.contract_audit_detail(), sinks.version_audit_detail()).collect()
    assert json.loads(rows[0][0])["policyPack"] is None and "error" not in json.loads(rows[0][0])
    assert json.loads(rows[1][0])["error"] == "boom"
    assert json.loads(rows[0][1]) == {"contractId": "c", "version": "v2", "createdVersion": "v2"}
    assert json.loads(rows[1][1]) == {"contractId": "c", "version": "v2", "error": "boom"}
    sinks.write_snapshot(df, str(tmp_path / "next"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.write_snapshot(df, str(tmp_path / "next"))


def test_payload_stream_restarts_without_doubling(spark, docs_of, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    docs = docs_of(("a.b", 1, {"properties": {"x": {"type": "integer"}}, "required": ["x"]}))
    rows = [("a.b", "v1", str(i), '{"x":%s}' % ("1" if i % 2 else '"s"')) for i in range(10)]

    def add(part):
        spark.createDataFrame(part, PAYLOADS).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = feeds.stream_payloads(spark, source, files_per_trigger=1)
        start_payload_check(stream, docs, out, str(tmp_path / "ck")).awaitTermination()

    add(rows[:4])
    add(rows[4:8])
    run()
    run()
    add(rows[8:])
    run()
    got = read_checked(spark, out)
    assert got.count() == 10 and got.select("payload_id").distinct().count() == 10
    assert got.filter("valid").count() == 5
    assert got.filter("not valid").select("violations").distinct().first()[0] == ["type:x"]


def test_request_stream(spark, docs_of, tmp_path):
    docs = docs_of(("o.c", 1, STATION_V1), ("o.c", 2, STATION_V2))
    contracts = spark.createDataFrame(
        [("o.c", "BACKWARD", None)],
        "contract_id string, compatibility_mode string, policy_pack string",
    )
    from test_plans import requests_of

    requests_of(
        spark,
        ("o.c", "v1", "v2", "BACKWARD", None, "ci"),
        ("o.c", "v1", "v9", "BACKWARD", None, "ci"),
        ("o.c", "v1", "v1", "BACKWARD", None, "ci"),
    ).write.parquet(str(tmp_path / "in"))
    paths = [str(tmp_path / name) for name in ("runs", "logs", "rejected", "ck")]
    for _ in range(2):
        start_request_checks(
            feeds.stream_check_requests(spark, str(tmp_path / "in")),
            contracts, schema_shapes(docs), PolicyPacks.parse(PACKS), *paths,
        ).awaitTermination()
    runs = spark.read.parquet(paths[0])
    assert sorted(r.status for r in runs.collect()) == ["FAIL", "PASS"]
    assert spark.read.parquet(paths[1]).count() == 2 + 9
    assert spark.read.parquet(paths[2]).count() == 1


def test_request_stream_remembers_ids_over_batches_restarts_and_replays(spark, docs_of, tmp_path, monkeypatch):
    from test_plans import requests_of

    docs = docs_of(("o.c", 1, STATION_V1), ("o.c", 2, STATION_V2))
    contracts = spark.createDataFrame(
        [("o.c", "BACKWARD", None)], "contract_id string, compatibility_mode string, policy_pack string"
    )
    shapes = schema_shapes(docs)
    rows = requests_of(spark, ("o.c", "v1", "v2", "BACKWARD", None, "ci")).first()
    kinds = requests_of(spark, ("o.c", "v1", "v2", "BACKWARD", None, "ci")).schema

    def send(name, *ids):
        given = [rows.asDict() | {"request_id": i, "triggered_by": by} for i, by in ids]
        spark.createDataFrame(given, kinds).coalesce(1).write.parquet(str(tmp_path / "in" / name))

    paths = [str(tmp_path / name) for name in ("runs", "logs", "rejected", "ck")]

    def check():
        stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
        start_request_checks(stream, contracts, shapes, PolicyPacks.parse(PACKS), *paths).awaitTermination()

    def answered():
        outcomes = spark.read.parquet(f"{paths[0]}-outcomes").collect()
        return sorted((r.request_id, r.triggered_by, r.batch) for r in outcomes)

    send("1", ("a", "x"), ("b", "z"), ("b", "y"))
    send("2", ("a", "w"), ("c", "x"))
    check()
    first = answered()
    # Of the rows of an id in one batch the first in the order of its values.
    assert [r[0] for r in first] == ["a", "b", "c"] and first[1][1] == "y"
    # A batch that breaks off when its outcomes are written is judged again after the restart.
    send("3", ("b", "u"), ("d", "x"))
    real = request_stream.lifecycle_logs
    monkeypatch.setattr(request_stream, "lifecycle_logs", lambda *a: 1 / 0)
    with pytest.raises(Exception, match="ZeroDivision|division"):
        check()
    monkeypatch.setattr(request_stream, "lifecycle_logs", real)
    check()
    assert [r[0] for r in answered()] == ["a", "b", "c", "d"] and answered()[:3] == first
    assert spark.read.parquet(paths[0]).count() == 4
    # Nothing of what earlier batches wrote is read.
    send("4", ("a", "t"), ("e", "x"))
    reads = []
    monkeypatch.setattr(type(spark.read), "parquet", lambda self, p, real=type(spark.read).parquet: (reads.append(p), real(self, p))[1])
    check()
    monkeypatch.undo()
    assert [r[0] for r in answered()] == ["a", "b", "c", "d", "e"]
    assert all("batch=" in p for p in reads if "-outcomes" in p)
