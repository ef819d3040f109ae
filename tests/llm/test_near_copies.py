import random
import re

import numpy as np
import pyarrow as pa
import pytest

from pactlake.llm import near_copies

DOCS = "doc_id bigint, text string"


def shingles(text, size=5):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    return {tuple(words[i : i + size]) for i in range(max(min(len(words), 1), len(words) - size + 1))}


def similarity(x, y):
    return len(x & y) / len(x | y) if x | y else 1.0


def fixture(seed, families=25, copies=6):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdé") + str(rng.randint(0, 900))
    out = [None, "", " \n", "One", "one", "a b", "A\tB", "a b c d", "日本 語 x y z"]
    for _ in range(families):
        words = [word() for _ in range(rng.choice([6, 12, 40, 200, 900]))]
        out.append(" ".join(words))
        for _ in range(copies):
            edited = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 40))):
                edited[rng.randrange(len(words))] = word()
            out.append(rng.choice([" ", "\n", " \t"]).join(edited))
    return [(1000 - i, t) for i, t in enumerate(out)]


def links(rows):
    sets = [shingles(t) for _, t in rows]
    return {(i, j) for i in range(len(rows)) for j in range(i) if similarity(sets[i], sets[j]) >= 0.8}


def grouped_ids(n, pairs):
    label = list(range(n))
    for _ in range(n):
        before = list(label)
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
        if before == label:
            return label
    return label


@pytest.mark.parametrize("tile", [1024, 4])
def test_links_are_right_and_nearly_whole(spark, monkeypatch, tile):
    monkeypatch.setattr(near_copies, "TILE", tile)
    rows = fixture(tile)
    got = near_copies.grouped(spark, spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", node int"))
    first = {r.doc_id: r.first.doc_id for r in got.collect()}
    assert len(first) == len(rows)
    pairs = links(rows)
    label = grouped_ids(len(rows), pairs)
    # Never more than brute force links, and at least 0.95 of its links.
    assert all(label[1000 - d] == label[1000 - f] for d, f in first.items())
    together = [first[rows[i][0]] == first[rows[j][0]] for i, j in pairs]
    assert sum(together) / len(together) >= 0.95
    assert len(pairs) > 200 and all(f <= d for d, f in first.items())


def test_jaccard_is_exact():
    rows = [t for _, t in fixture(5, families=8, copies=3)]
    rng = random.Random(0)
    left, right = [rng.choice(rows) for _ in range(300)], [rng.choice(rows) for _ in range(300)]
    got = near_copies.jaccard(pa.array(left), pa.array(right))
    assert got.tolist() == [similarity(shingles(x), shingles(y)) for x, y in zip(left, right)]


def test_parts_cover_every_pair_within_the_radius():
    bits, parts, words = near_copies.layout(1000)
    assert (bits, parts, words) == (32, 4, 2)
    rng = np.random.default_rng(0)
    masks = [[int(m) for m in near_copies.masks(near_copies.RADIUS, bits, seed=p + 1)] for p in range(parts)]
    for _ in range(500):
        differ = rng.choice(bits * parts, parts * (near_copies.RADIUS + 1) - 1, replace=False)
        code = [sum(1 << int(i % bits) for i in differ if i // bits == p) for p in range(parts)]
        assert any(code[p] & mask == 0 for p in range(parts) for mask in masks[p])


def test_layout_grows_with_the_documents():
    assert near_copies.layout(0) == near_copies.layout(30_000_000) == (32, 4, 2)
    assert near_copies.layout(8_000_000_000) == (48, 13, 13)
    for n in (10**8, 10**9, 10**11):
        bits, parts, words = near_copies.layout(n)
        assert words * (64 // bits) >= parts and n / 2 ** (bits / 2) <= 512


def test_forest_has_the_least_weight():
    rng = np.random.default_rng(2)
    for n in (2, 3, 9, 40):
        a, b = np.triu_indices(n, 1)
        some = rng.random(len(a)) < 0.4
        a, b = a[some], b[some]
        d = rng.integers(0, 12, len(a))
        order = np.argsort(d, kind="stable")
        a, b, d = a[order], b[order], d[order]
        got, trees = near_copies.spanning(a, b, np.arange(n))
        label, weight, count = list(range(n)), 0, 0
        for i in np.argsort(d, kind="stable"):
            x, y = label[a[i]], label[b[i]]
            if x != y:
                label = [x if v == y else v for v in label]
                weight, count = weight + d[i], count + 1
        assert (len(got), d[got].sum()) == (count, weight)
        assert len(set(trees)) == n - count and (trees[a] == trees[b]).all()


def test_one_row_of_each_group_stays(spark):
    rows = [(3, "a b c d", 1, 1), (2, "A b  c d", 2, 1), (2, "A b  c d", 3, 1), (9, None, 4, 1), (8, "", 5, 1), (None, "q", 6, 1)]
    docs = spark.createDataFrame(rows, DOCS + ", at int, `_row` int")
    got = near_copies.one_of_each(spark, docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in got.collect() if r.doc_id) == [(2, "A b  c d"), (8, "")]
    assert got.count() == 3
    assert near_copies.one_of_each(spark, spark.createDataFrame([], DOCS)).count() == 0


def test_many_near_copies_and_a_long_text(spark):
    rng = random.Random(4)
    words = [str(rng.randint(0, 10**6)) for _ in range(300)]
    rows = [(0, " ".join(str(rng.randint(0, 10**6)) for _ in range(200_000)))]
    for i in range(1, 400):
        edited = list(words)
        edited[rng.randrange(300)] = "x" + str(i)
        rows.append((i, " ".join(edited)))
    kept = near_copies.one_of_each(spark, spark.createDataFrame(rows, DOCS))
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == [0, 1]


def test_tables_that_grow_with_the_documents_are_not_broadcast(spark, tmp_path):
    # Spark takes what an explode makes for no larger than its input: here a few rows, that is a broadcast.
    rows = [(i, i * 7919, i * 104729, (False, i, i)) for i in range(50)]
    schema = "node bigint, w0 bigint, w1 bigint, first struct<unnamed: boolean, doc_id: bigint, text_key: bigint>"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "nodes"))
    pairs = near_copies.candidates(spark.read.parquet(str(tmp_path / "nodes")), 32, 4, 2)
    assert "SortMergeJoin" in plan(pairs) and "Broadcast" not in plan(pairs)
    spark.createDataFrame([(i, f"a b c d {i}") for i in range(50)], DOCS).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    texts = docs.withColumnRenamed("doc_id", "node")
    linked = near_copies.links(spark.createDataFrame([(1, 2)], "a bigint, b bigint"), texts)
    for made in (linked, near_copies.grouped(spark, docs)):
        assert "SortMergeJoin" in plan(made) and "Broadcast" not in plan(made)


def plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()
