import random

from pyspark.sql import Window, functions as F

from pactlake.operators.ordering import (
    adjacent_documents,
    adjacent_pairs,
    latest_pairs,
    number_within,
)


def test_pairs_across_gaps_and_buckets(spark):
    numbers = {"a": [1, 2, 5, 65535, 65536, 400000, 2147483647], "b": [7], "c": [2, 1]}
    rows = [(c, n) for c, ns in numbers.items() for n in ns] * 2
    versions = spark.createDataFrame(rows, "contract_id string, version_num int")
    expected = {
        (c, f"v{a}", f"v{b}")
        for c, ns in numbers.items()
        for a, b in zip(sorted(ns), sorted(ns)[1:])
    }
    assert {tuple(r) for r in adjacent_pairs(versions).collect()} == expected
    once = versions.distinct()
    assert {tuple(r) for r in adjacent_pairs(once, unique=True).collect()} == expected
    assert latest_pairs(once, unique=True).exceptAll(latest_pairs(versions)).isEmpty()
    assert {tuple(r) for r in latest_pairs(versions).collect()} == {
        ("a", "v400000", "v2147483647"),
        ("c", "v1", "v2"),
    }


def test_latest_pairs_cuts_before_the_shuffle(spark):
    versions = spark.range(1000).selectExpr(
        "concat('c', id % 3) contract_id", "cast(id as int) version_num"
    )
    plan = latest_pairs(versions, unique=True)._jdf.queryExecution().executedPlan().toString()
    cut, shuffle = plan.rindex("WindowGroupLimit"), plan.rindex("Exchange hashpartitioning")
    assert shuffle < cut, "the limit must also stand below the exchange"


def test_hot_contract(spark):
    """A third of all versions belongs to one contract."""
    rows = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 500)).alias(
            "contract_id"
        ),
        (F.col("id") * 7 + 1).cast("int").alias("version_num"),
    )
    plain = Window.partitionBy("contract_id").orderBy("version_num")
    expected = rows.withColumn("b", F.lag("version_num").over(plain)).filter("b is not null")
    found = adjacent_pairs(rows)
    assert found.count() == expected.count()
    assert found.exceptAll(
        expected.selectExpr("contract_id", "concat('v', b)", "concat('v', version_num)")
    ).isEmpty()


def test_numbers_within_a_key(spark):
    rng = random.Random(5)
    rows = [(0 if i % 3 == 0 else rng.randrange(40), rng.randrange(90), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, day int, i int")
    plain = df.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("day", "i")))
    found = number_within(df, "k", F.col("day"), ["day", "i"], "n")
    assert found.select(plain.columns).exceptAll(plain).isEmpty()
    assert found.count() == 3000


def test_adjacent_documents_carry_both_shapes(spark):
    numbers = {"a": [1, 2, 5, 4095, 4096, 9000, 2147483647], "b": [7], "c": [2, 1]}
    rows = [(c, n, [f"{c}{n}"]) for c, ns in numbers.items() for n in ns]
    shapes = spark.createDataFrame(rows, "contract_id string, version_num int, shape array<string>")
    found = {
        (r.contract_id, r.base_version, r.candidate_version): (r.base_shape, r.candidate_shape)
        for r in adjacent_documents(shapes).collect()
    }
    assert found == {
        (c, f"v{a}", f"v{b}"): ([f"{c}{a}"], [f"{c}{b}"])
        for c, ns in numbers.items()
        for a, b in zip(sorted(ns), sorted(ns)[1:])
    }
