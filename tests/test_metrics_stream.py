"""Metrics kept by a stream against those of one batch, over cuts, restarts and snapshots."""

import random
import re

import pytest
from test_history import run

from pactlake.streaming import metrics_stream
from pactlake.streaming.metrics_stream import measures, read_metrics, start_metrics, totals
from proving.queries import in_batches


def some_runs(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        status = rng.choice(["PASS", "FAIL", "QUEUED", "running", None])
        times = {"started_at": "2024-01-01T00:00:00Z", "finished_at": f"2024-01-01T00:00:{rng.randint(0, 59):02}Z"}
        out.append(run(
            f"{seed}-{i:03}", status, rng.choice(["a.a", "a.b", " ", None]), candidate_version=rng.choice(["v1", "v2"]),
            created_at=f"2024-01-{rng.randint(1, 9):02}T00:00:00Z", warnings=rng.choice(["[]", '["Execution error: x"]']), **rng.choice([times, {}]),
        ))
    return out


def rows_of(metrics):
    return sorted(map(tuple, metrics.collect()), key=str)


@pytest.mark.parametrize("every", [1, 2, 100])
def test_equal_to_one_batch_after_any_cut(spark, runs_of, tmp_path, monkeypatch, every):
    paths = str(tmp_path / "metrics"), str(tmp_path / "checkpoint")
    given = []

    def check():
        stream = spark.readStream.schema(runs_of(*some_runs(1, 0)).schema).option("maxFilesPerTrigger", 1)
        start_metrics(spark, stream.parquet(str(tmp_path / "in" / "*")), *paths, every=every).awaitTermination()

    for seed, size in enumerate([30, 1, 12]):
        given += some_runs(size, seed)
        runs_of(*some_runs(size, seed)).repartition(2).write.parquet(str(tmp_path / "in" / str(seed)))
        if seed == 1:
            # A batch that breaks off is made again after the restart.
            monkeypatch.setattr(metrics_stream, "read_metrics", lambda *a: 1 / 0)
            if every == 1:
                with pytest.raises(Exception, match="ZeroDivision|division"):
                    check()
            monkeypatch.undo()
        check()
        assert rows_of(read_metrics(spark, paths[0])) == rows_of(totals(measures(runs_of(*given))))


def test_measures_are_compiled(spark, runs_of, tmp_path):
    runs_of(*some_runs(3, 0)).write.parquet(str(tmp_path / "runs"))
    plan = measures(spark.read.parquet(str(tmp_path / "runs")))._jdf.queryExecution().executedPlan().toString()
    # Spark interprets what stands inside an explode.
    assert re.search(r"explode(_outer)?\(every#", plan) and "explode(filter(" not in plan


def test_a_micro_batch_is_read_by_many_tasks(spark, tmp_path):
    files = in_batches(spark.range(1000), 3, str(tmp_path / "rows"))
    assert files == spark.sparkContext.defaultParallelism > 1
    stream = spark.readStream.schema("id bigint").option("maxFilesPerTrigger", files).parquet(str(tmp_path / "rows"))
    batches = []
    stream.writeStream.foreachBatch(lambda rows, n: batches.append(rows.count())).trigger(availableNow=True).option(
        "checkpointLocation", str(tmp_path / "checkpoint")
    ).start().awaitTermination()
    assert len(batches) == 3 and sum(batches) == 1000


def test_nothing_is_held_in_memory_and_a_batch_writes_what_it_brings(spark, runs_of, tmp_path):
    paths = str(tmp_path / "metrics"), str(tmp_path / "checkpoint")
    for seed, size in enumerate([30, 1]):
        runs_of(*some_runs(size, seed)).coalesce(1).write.parquet(str(tmp_path / "in" / str(seed)))
        stream = spark.readStream.schema(runs_of(*some_runs(1, 0)).schema).parquet(str(tmp_path / "in" / "*"))
        start_metrics(spark, stream, *paths).awaitTermination()
    # A state store would grow with the keys.
    assert not (tmp_path / "checkpoint" / "state").exists()
    added = spark.read.parquet(f"{paths[0]}/changes/batch=1")
    assert {r.n for r in added.collect()} == {1} and added.where("measure = 'queued'").count() == 1
    assert rows_of(read_metrics(spark, paths[0])) == rows_of(totals(measures(runs_of(*some_runs(30, 0), *some_runs(1, 1)))))
