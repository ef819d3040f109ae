import zlib

import numpy as np
import pyarrow as pa

from pactlake.llm import quality

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_no_label_leak(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    assert 0.8 < model.prior < 0.95
    rows = quality.scored(docs, model).join(labels, "doc_id").toPandas()
    assert set(rows["held_out"]) == {True, False}
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(rows["doc_id"], rows["held_out"]))
    unseen = rows[rows["held_out"]]
    assert (unseen["predicted"] == unseen["quality"]).mean() >= 0.97
    assert unseen[unseen["quality"] == 1]["predicted"].mean() == 1
    assert ((unseen["score"] >= 0) & (unseen["score"] <= 1)).all()
    flipped = labels.selectExpr(
        "doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 then 1 - quality else quality end as quality"
    )
    again = quality.fit(docs, flipped)
    assert np.array_equal(again.weights, model.weights) and again.prior == model.prior


def test_odd_rows(spark):
    rows = [(None, None, 1.0), (1, "", 2.0), (1, "", 2.0), (2, "x" * 100_000, 3.0), (3, "Tout va bien.", 4.0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score double")
    labels = spark.createDataFrame([(None, 1), (1, 1), (1, 0), (3, 1), (3, None)], "doc_id bigint, quality int")
    model = quality.fit(docs, labels)
    got = quality.scored(docs, model)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    found = got.collect()
    assert len(found) == 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in found)
    assert not next(r for r in found if r.doc_id is None).held_out
    empty = quality.fit(docs.limit(0), labels.limit(0))
    assert {r.score for r in quality.scored(docs, empty).collect()} == {0.5}
    assert quality.scored(docs.limit(0), model).count() == 0
    kept = quality.good(docs, empty, 0.5)
    assert kept.columns == docs.columns and kept.count() == 5


def test_features_do_not_depend_on_neighbours():
    texts = ["The end. The end.", None, "", "AA BB!! cc", "1 2 2"]
    together = quality.features(pa.array(texts, pa.string()))
    alone = np.concatenate([quality.features(pa.array([t], pa.string())) for t in texts])
    assert np.array_equal(together, alone)


def test_best_bin_prior():
    rng = np.random.default_rng(0)
    positive = rng.normal(2, 1, (4000, 1))
    mixed = np.concatenate([rng.normal(2, 1, (2800, 1)), rng.normal(-2, 1, (1200, 1))])
    rng.shuffle(mixed)
    with_one = [np.concatenate([x, np.ones((len(x), 1))], axis=1) for x in (positive, mixed)]
    assert abs(quality.estimated_prior(*with_one) - 0.7) < 0.05
