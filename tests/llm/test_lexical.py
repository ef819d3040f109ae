import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from pactlake.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id bigint, text string, item_id string, rank int, score string, text_key int"
ITEMS = "item_id bigint, text string, doc_id int, block string"


def terms(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return TERM.findall(lowered)


def brute(docs, items, top=10):
    """Every item against every document, by the definition."""
    tfs = [(d, Counter(terms(t))) for d, t in docs]
    some = [tf for _, tf in tfs if tf]
    n_docs, n_terms = len(some), sum(sum(tf.values()) for tf in some)
    df = Counter(term for tf in some for term in tf)
    out = []
    for item_id, text in set(items):
        scores = []
        for d, tf in tfs:
            if not tf:
                continue
            m = 25 + 75 * sum(tf.values()) * n_docs // n_terms
            score = sum(
                c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m))
                for t, c in Counter(terms(text)).items() if tf[t]
            )
            if score > 0:
                scores.append((-score, d is None, d or 0))
        out += [(item_id, rank, None if null else d, -s) for rank, (s, null, d) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=str)


def fixture(seed=4):
    rng = random.Random(seed)
    words = ["cat", "Cat", "cats", "CATS9", "été", "naïve", "日本", " x", "a", "b", "the", "The", "zz"]
    docs = [(1, None), (2, ""), (3, "--- !!"), (None, "cat cat the"), (None, "cat"), (5, "the " * 30000 + "cat")]
    for i in range(120):
        said = "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "_", "\x00", "-", "\t"]) for _ in range(rng.randint(1, 30)))
        docs.append((100 + 7 * i % 120, said))
    docs += [docs[20], docs[20], (999, docs[20][1])]
    items = [(0, None), (1, ""), (2, "cat cat the"), (3, "nowhere else"), (3, "été"), (-4, "日本 naïve, x"), (None, "zz a")]
    items += [(10 + i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 9)))) for i in range(20)]
    return docs, [*items, items[2]]


@pytest.mark.parametrize(("item_bytes", "scores"), [(4 << 20, 1 << 20), (60, 40)])
def test_matches_brute_force(spark, monkeypatch, item_bytes, scores):
    monkeypatch.setattr(lexical, "ITEM_BYTES", item_bytes)
    monkeypatch.setattr(lexical, "SCORES", scores)
    monkeypatch.setattr(lexical, "_PRODUCTS", scores)
    rows, items = fixture()
    docs = spark.createDataFrame([(d, t, "x", 1, "y", 7) for d, t in rows], DOCS).repartition(3)
    got = lexical.ranked(spark, docs, spark.createDataFrame([(i, t, 1, "z") for i, t in items], ITEMS))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    got = [tuple(r) for r in got.collect()]
    assert all(type(x) is int for _, *r in got for x in r if x is not None)
    want = brute(rows, [(i, t or "") for i, t in items])
    assert sorted(got, key=str) == want and len(want) > 150


def test_best_keeps_the_first_of_equal_scores(spark):
    docs = spark.createDataFrame([(d, "same words here", "", 1, "", 1) for d in range(3000, 0, -1)], DOCS)
    docs = docs.union(spark.createDataFrame([(9000 + d, "others", "", 1, "", 1) for d in range(50)], DOCS))
    got = lexical.ranked(spark, docs, spark.createDataFrame([(1, "words", 1, "")], ITEMS)).orderBy("rank").collect()
    assert [(r.rank, r.doc_id) for r in got] == [(i, i) for i in range(1, 11)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    items = spark.createDataFrame([(1, "cat", 1, ""), (2, None, 1, "")], ITEMS)
    assert lexical.ranked(spark, none, items).count() == 0
    docs = spark.createDataFrame([(1, "cat", "", 1, "", 1)], DOCS)
    assert lexical.ranked(spark, docs, spark.createDataFrame([], ITEMS)).count() == 0
    assert lexical.ranked(spark, docs, items.where("item_id = 2")).count() == 0


def test_automaton_reports_whole_terms_only():
    block = lexical.block_terms(pa.array(["cat a cat", "été cat"]))
    [(_, text)] = lexical.guarded(pa.array(["cat cats concat cat-été A été9 é"]))
    term, tf = lexical.found(block.automaton, text)
    assert dict(zip(term.tolist(), tf.tolist())) == {0: 2, 1: 1, 2: 1}
    # cat stands twice in the first item and once in the second.
    assert block.item[: block.first[1]].tolist() == [0, 1] and block.count[: block.first[1]].tolist() == [2, 1]
