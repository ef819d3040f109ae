import hashlib
import random
import re

import pytest

from pactlake.llm import spotsigs

COMMON = set(spotsigs.COMMON.split())


def sig_set(text):
    words = re.sub(r"[^0-9a-z\x80-\U0010ffff]+", " ", text.lower()).strip(" ").split(" ")
    out = set()
    for i, word in enumerate(words):
        if word in COMMON:
            chain = []
            for w in words[i + 1 : i + 1 + spotsigs.CHAIN]:
                if w in COMMON:
                    break
                chain.append(w)
            if chain:
                out.add((word, *chain))
    return frozenset(out or words)


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for i, (doc, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        m = len(text) // 3
        edited = text[: len(text) - m] + after[:m]
        sets = [sig_set(t) for t in (text, edited, after)]
        near = [len(sets[0] & s) / len(sets[0] | s) for s in sets[1:]]
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), *near, sets[0], sets[1]))
    return out


def fixture(n):
    rng = random.Random(n)
    content = ["Haus", "maison", "perro", "tree", "çà", "x9", "éé", "日本"]
    word = lambda: rng.choice(sorted(COMMON)) if rng.random() < 0.3 else rng.choice(content) + rng.choice("abcd")
    rows = [(-5, None), (0, ""), (1, "?! ..."), (2, "Nothing"), (None, "The end of the tree.")]
    for i in range(n):
        rows.append((3 + i * i, rng.choice([" ", ", ", "\n"]).join(word() for _ in range(rng.choice([1, 8, 60, 300])))))
    return rows + [(10**12, rows[-1][1])]


@pytest.mark.parametrize("rows_a_range", [2000, 5])
def test_matches_brute_force(spark, monkeypatch, rows_a_range):
    monkeypatch.setattr(spotsigs, "RANGE_ROWS", rows_a_range)
    rows = fixture(60)
    docs = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id bigint, text string, range int, sigs string")
    got = {r.doc_id: r for r in spotsigs.edited_likeness(docs.repartition(3)).collect()}
    assert len(got) == len(rows)
    prints = {}
    for doc, n, sha, near_edited, near_next, own, edited in brute(rows):
        r = got[doc]
        assert (r.n_chars, r.edited_sha256) == (n, sha)
        assert abs(r.near_edited - near_edited) < 1e-12 and abs(r.near_next - near_next) < 1e-12
        for print_, sigs in ((r.fingerprint, own), (r.edited_fingerprint, edited)):
            assert prints.setdefault(print_, sigs) == sigs
    assert len(prints) == len(set(prints.values()))


def test_one_row_repeated_rows_and_empty_table(spark):
    schema = "doc_id bigint, text string"
    [one] = spotsigs.edited_likeness(spark.createDataFrame([(1, "abcdef")], schema)).collect()
    assert one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and one.near_next == 1
    twice = spotsigs.edited_likeness(spark.createDataFrame([(1, "abc"), (1, "abc"), (2, "of the")], schema))
    assert sorted(r.doc_id for r in twice.collect()) == [1, 1, 2]
    assert spotsigs.edited_likeness(spark.createDataFrame([], schema)).count() == 0


def test_ranges_count_the_bounds_below(spark):
    for n in (0, 1, 2, 5, 17):
        bounds = [10 * i for i in range(n)]
        rows = spark.createDataFrame([(i,) for i in range(-3, 200, 7)], "doc_id bigint")
        for r in rows.select("doc_id", spotsigs._range_of(rows["doc_id"], bounds).alias("n")).collect():
            assert r.n == sum(b <= r.doc_id for b in bounds)


def test_pruned_likeness(spark):
    row = spark.sql("select array(1L, 2L, 3L, 4L) as a, array(1L) as b")
    assert row.select(spotsigs.likeness(row["a"], row["b"])).first()[0] == 0.25
    assert row.select(spotsigs.likeness(row["a"], row["b"], 0.5)).first()[0] == 0
