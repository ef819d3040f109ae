import random

import pytest
from test_history import run

from pactlake.operators import upkeep
from pactlake.operators.upkeep import (
    FILLED,
    apply_transitions,
    backfill_logs,
    backfill_runs,
    skipped_updates,
)
from pactlake.schemas import CHECK_RUN_LOGS

UPDATES = (
    "update_id string, run_id string, expected_status string, new_status string, "
    "breaking_changes array<string>, warnings array<string>, at string"
)
NOW = "2024-05-05T00:00:00.000Z"


def test_backfill_fills_by_status_and_is_idempotent(spark, runs_of):
    contracts = spark.createDataFrame(
        [("a.b", "forward")], "contract_id string, compatibility_mode string"
    )
    full = dict.fromkeys(FILLED, "x") | {"compatibility_mode": "FULL"}
    runs = runs_of(
        run("done", "PASS"),
        run("queued", "QUEUED"),
        run("running", "running"),
        run("other", "FAIL", "c.d", compatibility_mode=" sideways", triggered_by=" me "),
        run("kept", "PASS", **full),
    )
    filled = backfill_runs(runs, contracts, NOW)
    rows = {r.run_id: r for r in filled.collect()}
    at = "2024-01-01T00:00:00Z"
    assert (rows["done"].started_at, rows["done"].finished_at) == (at, at)
    assert (rows["queued"].started_at, rows["queued"].finished_at) == (None, None)
    assert (rows["running"].started_at, rows["running"].finished_at) == (at, None)
    assert (rows["done"].compatibility_mode, rows["done"].triggered_by) == ("FORWARD", "legacy")
    assert (rows["other"].compatibility_mode, rows["other"].triggered_by) == ("BACKWARD", "me")
    assert not rows["kept"].changed and rows["done"].changed
    again = backfill_runs(filled.drop("changed"), contracts, NOW)
    assert again.filter("changed").isEmpty()


def test_backfill_logs_only_for_silent_finished_runs(spark, runs_of):
    runs = runs_of(run("silent", "PASS"), run("loud", "FAIL"), run("queued", "QUEUED"))
    logs = spark.createDataFrame([("l", "loud", "INFO", "m", NOW)] * 5, CHECK_RUN_LOGS)
    rows = backfill_logs(runs, logs, NOW).collect()
    assert [r.run_id for r in rows] == ["silent"]
    assert rows == backfill_logs(runs, logs, NOW).collect()


def test_guarded_transitions(spark, runs_of):
    runs = runs_of(run("q", "QUEUED"), run("r", "RUNNING", started_at="s"), run("p", "PASS"))
    updates = spark.createDataFrame(
        [
            ("u1", "q", "QUEUED", "RUNNING", None, None, "t1"),
            ("u2", "q", "QUEUED", "RUNNING", None, None, "t0"),
            ("u3", "r", "RUNNING", "FAIL", ["Field removed: x"], None, "t2"),
            ("u4", "p", "RUNNING", "FAIL", None, None, "t3"),
            ("u5", "gone", "RUNNING", "PASS", None, None, "t4"),
            ("u6", "p", "PASS", "QUEUED", None, None, "t5"),
        ],
        UPDATES,
    )
    rows = {r.run_id: r for r in apply_transitions(runs, updates).collect()}
    assert (rows["q"].status, rows["q"].started_at) == ("RUNNING", "t0")
    assert (rows["r"].status, rows["r"].finished_at) == ("FAIL", "t2")
    assert (rows["r"].breaking_changes, rows["r"].warnings) == ('["Field removed: x"]', "[]")
    assert rows["p"].status == "PASS"
    skipped = {r.update_id: r.reason for r in skipped_updates(runs, updates).collect()}
    assert skipped == {
        "u1": "superseded",
        "u4": "status_mismatch",
        "u5": "run_not_found",
        "u6": "illegal_transition",
    }
    requeue = spark.createDataFrame([("u", "r", "RUNNING", "QUEUED", None, None, "t")], UPDATES)
    back = {r.run_id: r for r in apply_transitions(runs, requeue).collect()}["r"]
    assert (back.status, back.started_at, back.finished_at) == ("QUEUED", None, None)


def applied_one_by_one(status, updates):
    """(statuses before, applied, state of the run) by the definition."""
    run_, steps = {"status": status, "started": None, "finished": None}, []
    for update_id, expected, new, at in sorted(updates, key=lambda u: (u[3], u[0])):
        legal = (expected, new) in {("QUEUED", "RUNNING"), ("RUNNING", "PASS"), ("RUNNING", "FAIL"), ("RUNNING", "QUEUED")}
        hit = legal and run_["status"] == expected
        steps.append((update_id, run_["status"] if legal else None, hit))
        if hit:
            run_["status"] = new
            if new == "RUNNING":
                run_["started"] = at
            elif new == "QUEUED":
                run_["started"] = run_["finished"] = None
            else:
                run_["finished"] = at
    return steps, run_


@pytest.mark.parametrize(("task", "chunk"), [(50_000, 256), (40, 3)])
def test_chains_of_updates_in_one_batch(spark, runs_of, monkeypatch, task, chunk):
    monkeypatch.setattr(upkeep, "TASK_STEPS", task)
    monkeypatch.setattr(upkeep, "CHUNK", chunk)
    rng = random.Random(7)
    kinds = [("QUEUED", "RUNNING"), ("RUNNING", "QUEUED"), ("RUNNING", "PASS"), ("RUNNING", "FAIL"), ("PASS", "QUEUED")]
    given, rows = {}, []
    # One run has most of the updates, and only ends late.
    for n, (name, size) in enumerate([("hot", 300), *((f"r{i}", rng.randint(1, 9)) for i in range(30))]):
        status = rng.choice(["QUEUED", "RUNNING", "PASS"]) if n else "QUEUED"
        steps = []
        for i in range(size):
            expected, new = rng.choice(kinds[:2] if name == "hot" and i < 290 else kinds)
            steps.append((f"{name}-{i:03}", expected, new, f"t{rng.randint(0, 150) + (i >= 290) * 200:03}"))
        given[name] = (status, steps)
        rows += [(u, name, e, t, ["x"] if t == "FAIL" else None, None, at) for u, e, t, at in steps]
    runs = runs_of(*[run(name, status) for name, (status, _) in given.items()], run("still", "QUEUED"))
    updates = spark.createDataFrame(rows, UPDATES).repartition(3)
    got = {r.update_id: (r.status_before, r.applied) for r in upkeep.transition_steps(runs, updates).collect()}
    after = {r.run_id: r for r in apply_transitions(runs, updates).collect()}
    hits = 0
    for name, (status, steps) in given.items():
        want, end = applied_one_by_one(status, steps)
        hits += sum(hit for *_, hit in want)
        assert {u: got[u] for u, *_ in want} == {u: (before, hit) for u, before, hit in want}
        row = after[name]
        assert row.status == end["status"]
        if any(hit for *_, hit in want):
            assert (row.started_at, row.finished_at) == (end["started"], end["finished"])
    assert hits > 100 and after["still"].status == "QUEUED"
