import glob

from pyspark.sql import functions as F
from test_history import run
from test_upkeep import NOW, UPDATES

from pactlake.operators.upkeep import FILLED, apply_transitions, transition_steps
from pactlake.plans import stored_upkeep
from pactlake.schemas import CHECK_RUN_LOGS
from pactlake.sinks.history import RUN_COLUMNS, write_check_runs, write_run_logs
from pactlake.sources.history import read_check_run_logs, read_check_runs

FULL = dict.fromkeys(FILLED, "x") | {"compatibility_mode": "FULL"}


def files(path):
    found = {}
    for name in glob.glob(f"{path}/slot=*/*.parquet"):
        found.setdefault(int(name.split("slot=")[1].split("/")[0]), set()).add(name)
    return found


def rows(df):
    return sorted(tuple(r) for r in df.select(*RUN_COLUMNS).na.fill("none").collect())


def updates_of(spark, *updates):
    return spark.createDataFrame([(*u[:4], None, None, u[4]) for u in updates], UPDATES)


def test_only_touched_slots_are_written(spark, runs_of, tmp_path):
    path, steps = str(tmp_path / "runs"), str(tmp_path / "steps")
    runs = runs_of(*[run(f"r{i}", ("QUEUED", "RUNNING", "PASS")[i % 3], **FULL) for i in range(300)])
    write_check_runs(runs, path)
    before = files(path)
    assert len(before) > 50
    # Claimed and ended in one batch; overtaken; illegal; for no run; a swap, which must not be done twice.
    updates = updates_of(
        spark,
        ("u1", "r0", "QUEUED", "RUNNING", "t1"),
        ("u2", "r0", "RUNNING", "PASS", "t2"),
        ("u3", "r2", "RUNNING", "PASS", "t1"),
        ("u4", "r5", "PASS", "QUEUED", "t1"),
        ("u5", "nobody", "QUEUED", "RUNNING", "t1"),
        ("u6", "r3", "RUNNING", "PASS", "t1"),
        ("u7", "r3", "QUEUED", "RUNNING", "t2"),
        ("u8", None, "QUEUED", "RUNNING", "t2"),
    )
    want, judged = rows(apply_transitions(runs, updates)), transition_steps(runs, updates).collect()
    decided = stored_upkeep.decide_transitions(spark, path, updates, steps)
    assert sorted(map(str, decided.collect())) == sorted(map(str, judged))
    slots = stored_upkeep.put_transitions(spark, path, decided)
    assert 1 <= len(slots) <= 2
    after = files(path)
    assert set(after) == set(before)
    assert {slot for slot in before if before[slot] != after[slot]} == set(slots)
    assert all(not before[slot] & after[slot] for slot in slots)
    assert rows(read_check_runs(spark, path)) == want
    status = {r.run_id: r.status for r in read_check_runs(spark, path).collect()}
    assert (status["r0"], status["r3"], status["r2"], status["r5"]) == ("PASS", "RUNNING", "PASS", "PASS")
    # The last step again, as after a loss: nothing changes.
    assert stored_upkeep.put_transitions(spark, path, decided) == slots
    assert rows(read_check_runs(spark, path)) == want


def test_nothing_to_do_writes_nothing(spark, runs_of, tmp_path):
    path = str(tmp_path / "runs")
    write_check_runs(runs_of(run("a", "QUEUED", **FULL)), path)
    before = files(path)
    late = updates_of(spark, ("u", "a", "RUNNING", "PASS", "t"))
    for updates in (late, late.limit(0)):
        decided = stored_upkeep.decide_transitions(spark, path, updates, str(tmp_path / "steps"))
        assert stored_upkeep.put_transitions(spark, path, decided) == []
    assert files(path) == before


def test_touched_slots_alone_are_read(spark, runs_of, tmp_path):
    path = str(tmp_path / "runs")
    write_check_runs(runs_of(*[run(f"r{i}", "QUEUED", **FULL) for i in range(300)]), path)
    slots = stored_upkeep.touched_slots(spark.createDataFrame([("r7",), ("r7",), (None,)], "run_id string"))
    assert len(slots) == 1
    read = stored_upkeep._stored(spark, path, slots)
    names = [r.name for r in read.selectExpr("input_file_name() as name").distinct().collect()]
    assert names and all(f"slot={slots[0]}/" in name for name in names)
    plan = read.select("run_id")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(slot" in plan.replace("\n", " ")


def test_backfill_in_place(spark, runs_of, tmp_path):
    path, logs = str(tmp_path / "runs"), str(tmp_path / "logs")
    runs = [run(f"kept{i}", "PASS", **FULL) for i in range(200)]
    runs += [run("silent", "PASS"), run("loud", "FAIL"), run("waiting", "QUEUED")]
    write_check_runs(runs_of(*runs), path)
    write_run_logs(spark.createDataFrame([("l", "loud", "INFO", "m", NOW)], CHECK_RUN_LOGS), logs)
    contracts = spark.createDataFrame([("a.b", "forward")], "contract_id string, compatibility_mode string")
    before = files(path)
    slots = stored_upkeep.backfill(spark, path, logs, contracts, NOW)
    assert 1 <= len(slots) <= 3
    assert {slot for slot in before if before[slot] != files(path)[slot]} == set(slots)
    found = {r.run_id: r for r in read_check_runs(spark, path).collect()}
    assert len(found) == len(runs) and found["silent"].compatibility_mode == "FORWARD"
    assert found["silent"].finished_at and found["loud"].started_at and found["waiting"].started_at is None
    logged = [r.run_id for r in read_check_run_logs(spark, logs).collect()]
    assert sorted(logged) == ["loud", "silent"]
    # Again: a queued run has no start to fill, and nothing is left to write.
    assert stored_upkeep.backfill(spark, path, logs, contracts, NOW) == []
    assert sorted(r.run_id for r in read_check_run_logs(spark, logs).collect()) == ["loud", "silent"]


def test_updates_are_derived_once(spark, runs_of, tmp_path):
    path, steps = str(tmp_path / "runs"), str(tmp_path / "steps")
    write_check_runs(runs_of(run("r0", "QUEUED", **FULL), run("r1", "RUNNING", **FULL)), path)
    derived = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda i: derived.add(1) or i, "string").asNondeterministic()
    updates = updates_of(spark, ("u1", "r0", "QUEUED", "RUNNING", "t1"), ("u2", "r1", "RUNNING", "PASS", "t2"))
    updates = updates.withColumn("run_id", seen("run_id"))
    assert stored_upkeep.decide_transitions(spark, path, updates, steps).filter("applied").count() == 2
    assert derived.value == 2
