import hashlib
import random
import re

import pytest

from pactlake.llm import substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window=20):
    listed = sorted({(d is None, d or 0, t or "") for d, t in rows}, key=lambda r: r[:2])
    seen, gone = set(), {}
    for unnamed, d, t in listed:
        words = WORD.findall(t)
        out = gone[unnamed, d, t] = set()
        for i in range(len(words) - window + 1):
            path = tuple(words[i : i + window])
            if path in seen:
                out |= set(range(i, i + window))
            seen.add(path)
    result = []
    for d, t in rows:
        words, out = WORD.findall(t or ""), gone[d is None, d or 0, t or ""]
        kept = " ".join(w for i, w in enumerate(words) if i not in out)
        result.append((d, len(words), len(out), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(result, key=str)


def fixture(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "É", "The", "x,", "日本"]) + str(rng.randint(0, 30))
    line = lambda n: " ".join(word() for _ in range(n))
    shared = [line(n) for n in (19, 20, 21, 60, 200)] + ["same " * 50, "a b " * 30]
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, shared[3] + " one")]
    for i in range(50):
        parts = [line(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(shared), line(rng.randint(0, 5))]
        rows.append((10 + 7 * i % 53, rng.choice([" ", "\n", " \t "]).join(parts)))
    return rows + [rows[8], rows[9], (500, rows[8][1])]


@pytest.mark.parametrize("chunk", [2 << 20, 3000])
def test_matches_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr("pactlake.llm.words.CHUNK_BYTES", chunk)
    rows = fixture(chunk)
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id bigint, text string, start int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5" if chunk == 3000 else "10000")
    try:
        got = sorted((tuple(r) for r in substrings.report(docs).collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute(rows)
    assert sum(r[2] > 0 for r in got) > 20
    whole = substrings.dedup(docs)
    assert whole.columns == ["doc_id", "text", "start", "_n_words", "_n_removed"]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert substrings.report(docs).count() == 0


def test_the_largest_id_is_an_id_like_any_other(spark):
    text, largest = " ".join(f"w{i}" for i in range(30)), 2**63 - 1
    rows = [(1, text), (largest, text), (None, text + " more"), (-(2**63), "x"), (None, "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((tuple(r) for r in substrings.report(docs).collect()), key=str)
    want = sorted(brute(rows), key=str)
    assert got == want
    assert {(r[0], r[2]) for r in got} >= {(1, 0), (largest, 30), (None, 30)}


def test_columns_named_like_helpers_stay(spark):
    text = " ".join(f"w{i}" for i in range(30))
    names = ["_row", "row", "doc", "cut", "spans", "_cut", "_spans"]
    docs = spark.createDataFrame(
        [(1, text, *range(7)), (2, text, *range(7))], "doc_id bigint, text string, " + ", ".join(f"{n} int" for n in names)
    )
    got = substrings.dedup(docs)
    assert got.columns == ["doc_id", "text", *names, "_n_words", "_n_removed"]
    assert {(r.doc_id, r.text, r._row, r.spans, r._n_removed) for r in got.collect()} == {(1, text, 0, 4, 0), (2, "", 0, 4, 30)}
