import random

import pytest
from pyspark.sql import functions as F

from pactlake.llm import packing

DOCS = "doc_id bigint, text string, source string, size int"


def plain(sizes, sources, clusters, capacity):
    """Best fit by looking at every bin."""
    bins, out = [], []
    for size, source, cluster in zip(sizes, sources, clusters):
        fits = [
            (capacity - sum(s for s, _, _ in held), i)
            for i, held in enumerate(bins)
            if capacity - sum(s for s, _, _ in held) >= size
            and not any(source == a >= 0 or cluster == b >= 0 for _, a, b in held)
        ]
        fits = [f for f in fits if f[0] > 0]
        if not fits:
            bins.append([])
        at = min(fits)[1] if fits else len(bins) - 1
        bins[at].append((size, source, cluster))
        out.append(at)
    return out


def test_best_fit_is_that_of_a_full_search():
    rng = random.Random(1)
    for _ in range(40):
        n = rng.randint(0, 120)
        rows = [(rng.randint(0, 50), rng.randint(-1, 5), rng.randint(-1, 30)) for _ in range(n)]
        columns = [list(c) for c in zip(*rows)] or [[], [], []]
        assert packing.best_fit(*columns, 50) == plain(*columns, 50)


def fixture():
    rng = random.Random(4)
    rows = [(1, None, "s0", 1), (2, "", None, 2), (None, "x y", None, 3), (3, "A  b\nc", "s1", 4), (3, "A  b\nc", "s1", 4)]
    for i in range(300):
        text = " ".join(rng.choice("abc") + str(rng.randint(0, 9)) for _ in range(rng.choice([0, 3, 15, 20, 47, 60])))
        rows.append((10 + i, text if i % 3 else "one copied text of words", f"s{min(rng.randint(0, 9), 6)}", 0))
    return rows


@pytest.mark.parametrize("group", [4096, 40])
def test_every_word_is_packed_once_without_conflicts(spark, group):
    rows = fixture()
    docs = spark.createDataFrame(rows, DOCS)
    got = packing.packed(docs, capacity=20, group=group).collect()
    by_doc, by_bin = {}, {}
    source = {(d, t): s for d, t, s, _ in rows}
    texts = {d: t or "" for d, t, _, _ in rows}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_bin.setdefault(r.bin, []).append(r)
    for d, t in texts.items():
        listed = sum(r[0] == d for r in rows)
        n = len(t.split())
        spans = sorted((r.start, r.n_words) for r in by_doc[d])
        want = [(s, min(20, n - s)) for s in range(0, n, 20)] or [(0, 0)]
        assert spans == sorted(want * listed)
    for held in by_bin.values():
        assert sum(r.n_words for r in held) + held[0].room == 20
        sources = [source[d, t] for r in held for d, t in source if d == r.doc_id and source[d, t]]
        clusters = [" ".join(texts[r.doc_id].lower().split()) for r in held]
        clusters = [c for c in clusters if c]
        assert len(set(sources)) == len(sources) and len(set(clusters)) == len(clusters)
    joined = packing.sequences(docs, packing.packed(docs, capacity=20, group=group)).collect()
    assert {r.bin: r.n_words for r in joined} == {b: sum(r.n_words for r in h) for b, h in by_bin.items()}
    assert sum(len(r.text.split()) for r in joined) == sum(len(t.split()) for t in (r[1] or "" for r in rows))


def test_given_sizes_and_empty_table(spark):
    docs = spark.createDataFrame(fixture(), DOCS)
    got = packing.packed(docs, size=F.lit(5), cluster=F.lit(None), capacity=10)
    assert got.agg(F.sum("n_words")).first()[0] == 5 * docs.count()
    assert packing.packed(docs.limit(0)).count() == 0
