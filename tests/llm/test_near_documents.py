import random

import numpy as np
import pyarrow as pa
import xxhash

from pactlake.llm import graph, near_documents
from pactlake.llm.words import ALNUM, NOT_SPACE, grams, hashes, least, words_of

DOCS = "doc_id bigint, text string"


def brute_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", lowered) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(rows):
    codes = [brute_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (codes[i] ^ codes[j]).bit_count() <= 3:
                    label[i] = min(label[i], label[j])
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[label[i]] = min(d, ids.get(label[i], d))
    return sorted(
        ((d, f"{codes[i]:016x}", ids.get(label[i])) for i, (d, _) in enumerate(rows)), key=str
    )


def texts(seed=0):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6)))
    base = [" ".join(word() for _ in range(300)) for _ in range(6)]
    out = ["", None, "One", "one", "a b", "A\tB", "  x  y\nz w ", "日本 語 x y"]
    for text in base:
        out.append(text)
        for _ in range(4):
            words = text.split()
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = word()
            out.append(" ".join(words))
    return out


def test_groups_match_brute_force(spark):
    rows = [(100 - i, t) for i, t in enumerate(texts())] + [(100, ""), (None, "one"), (None, "alone here")]
    got = near_documents.near_groups(
        spark, spark.createDataFrame([(*r, "x") for r in rows], DOCS + ", fingerprint string")
    )
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_groups(rows)


def test_large_buckets_are_cut_into_tiles(spark, monkeypatch):
    monkeypatch.setattr(near_documents, "TILE", 3)
    rows = [(i, t) for i, t in enumerate(texts(1))]
    got = near_documents.near_groups(spark, spark.createDataFrame(rows, DOCS))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_groups(rows)


def test_masks_cover_every_pair_within_the_radius():
    masks, rng = near_documents.masks(3), np.random.default_rng(0)
    for _ in range(2000):
        difference = sum(1 << int(i) for i in rng.choice(64, 3, replace=False))
        assert any(mask & difference == 0 for mask in masks)


def test_links_count_the_sign_bit_like_any_other(spark):
    low, top = 0x0F0F_1234_5678_9ABC, 1 << 63
    codes = [low, low | top | 1 << 5, ~low, ~low ^ top ^ 3, low ^ 0x7FFF << 40]
    signed = [((c + top) % (1 << 64)) - top for c in codes]
    for pair, near in (((0, 1), True), ((2, 3), True), ((0, 2), False), ((0, 4), False), ((1, 4), False)):
        two = spark.createDataFrame([(signed[i],) for i in pair], "fingerprint bigint")
        assert (near_documents.links(two).count() > 0) == near
    got = near_documents.links(spark.createDataFrame([(c,) for c in signed], "fingerprint bigint")).collect()
    assert {frozenset(r) for r in got} == {frozenset(signed[:2]), frozenset(signed[2:4])}


def test_one_document_of_each_group_stays(spark):
    rows = [(3, "a b c d", 1), (2, "a b c d", 2), (2, "a b c d", 3), (9, None, 4), (8, "", 5), (None, "q", 6)]
    got = near_documents.one_of_each(spark, spark.createDataFrame(rows, DOCS + ", component int"))
    assert got.columns == ["doc_id", "text", "component"]
    assert sorted((r.doc_id, r.text) for r in got.collect() if r.doc_id) == [(2, "a b c d"), (8, "")]
    assert got.count() == 3
    assert near_documents.one_of_each(spark, spark.createDataFrame([], DOCS)).count() == 0


def test_columns_named_like_helpers_stay(spark):
    rows = [(3, "a b c d", 1, 2, 3), (2, "a b c d", 4, 5, 6)]
    docs = spark.createDataFrame(rows, DOCS + ", _row int, `at` int, _nth int")
    got = near_documents.one_of_each(spark, docs)
    assert got.columns == docs.columns and [tuple(r) for r in got.collect()] == [rows[1]]


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 40)]
    edges += [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    label = {n: n for e in edges for n in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = graph.components(spark, spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    want = {n: r for n, r in label.items() if any(n in e and e[0] != e[1] for e in edges)}
    assert {r.node: r.root for r in got} == want and len(got) == len(want)


def test_words_and_rolling_hashes(monkeypatch):
    rows = ["a bb  a bb", None, "", "Bb-a é9", "x" * 50 + " y", "a bb"]
    for limit in (1 << 20, 8):
        monkeypatch.setattr("pactlake.llm.words.CHUNK_BYTES", limit)
        seen, h = [], []
        for w in words_of(pa.array(rows), ALNUM, lower=True):
            h += hashes(w).tolist()
            counts = w.counts
            text = [w.buf[a:b].tobytes().decode() for a, b in zip(w.start, w.end)]
            for i, n in enumerate(counts):
                seen.append(text[w.first[i] : w.first[i] + n])
        assert seen == [["a", "bb", "a", "bb"], [], [], ["bb", "a", "é9"], ["x" * 50, "y"], ["a", "bb"]]
        assert h[0] == h[2] == h[5] == h[9] and h[1] == h[3] == h[4] and len(set(h)) == 5
    long = np.array([hash(i) for i in [1, 2, 3, 4, 5, 6, 7, 1, 2, 3, 4, 5, 6, 7, 8]], np.uint64)
    for k in range(1, 8):
        g = grams(long, k)
        assert len(g) == 16 - k
        assert all((g[i] == g[j]) == (list(long[i : i + k]) == list(long[j : j + k])) for i in range(len(g)) for j in range(len(g)))
    g = np.array([5, 3, 3, 9, 1, 7, 8], np.uint64)
    assert least(g, 3).tolist() == [2, 2, 4, 4, 4]
    assert next(words_of(pa.array([" a\x0bb\xa0c"]), NOT_SPACE, False)).counts.tolist() == [2]
