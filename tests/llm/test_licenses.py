import random
import re

from pactlake.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_base(text):
    w, places, labels = words(text), [], set()
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        starts = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        places += starts
        labels |= {label} if starts else set()
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def fixture():
    rng = random.Random(6)
    word = lambda: rng.choice(["mit", "license", "general", "Public", "the", "under", "é", "x", "2", "apache"])
    rows = [(1, None), (2, ""), (3, "MIT"), (4, "The MIT-License."), (4, "The MIT-License."), (None, "Apache\nlicense, mit license")]
    for i in range(40):
        rows.append((10 + i, " ".join(word() for _ in range(rng.choice([1, 5, 80])))))
    return rows + [(100, "mit license " * 3000)]


def scanned(spark, rows):
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id bigint, text string, labels int")
    return licenses.scan(spark, docs)


def test_base_columns_match_brute_force(spark):
    rows = fixture()
    got = scanned(spark, rows).collect()
    found = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=str)
    assert found == sorted(((d, *brute_base(t)) for d, t in rows), key=str)
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert r.score == 1 if r.n_base else 0 <= r.score <= 1
        assert r.labels == ",".join(sorted({s.label for s in r.spans}))


def test_notices_with_words_put_in_left_out_or_changed(spark):
    notice = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
    rows = [
        (1, "x " * 9 + notice + " y" * 9),
        (2, notice.replace("free", "truly free")),
        (3, notice.replace("hereby ", "")),
        (4, notice.replace("person", "reader")),
        (5, notice[:40]),
        (6, "Licensed under CC BY-NC 4.0."),
        (7, "This work is licensed under the GNU General Public License, version 3."),
        (8, "Licensed under the Apache License, Version 2.0. Released under the MIT License."),
        (9, "general public, license"),
    ]
    got = {r.doc_id: r for r in scanned(spark, rows).collect()}
    assert [got[i].labels for i in range(1, 10)] == [
        "mit", "mit", "mit", "mit", "", "cc-by-nc", "gpl,gpl-3.0", "apache,apache-2.0,mit", "gpl",
    ]
    assert got[1].score == 1 and [s.start for s in got[1].spans] == [9] and 0.9 <= got[2].score < 1
    assert got[8].n_base == 2 and got[5].score == 0


def test_empty_table(spark):
    assert scanned(spark, fixture()).limit(0).count() == 0
    assert licenses.scan(spark, spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_a_word_left_out_in_the_middle_of_a_text(spark):
    rows, want = [], {}
    for text, label in licenses.NOTICES:
        notice = text.split()
        if len(notice) < 14:
            continue
        for k in range(1, len(notice) - 1):
            left = notice[:k] + notice[k + 1 :]
            want[len(rows)] = (label, 7, 7 + len(left), 1 - 1 / len(notice))
            rows.append((len(rows), " ".join(["foreign"] * 7 + left + ["words"] * 7)))
    assert len(rows) > 20
    for r in scanned(spark, rows).collect():
        [span] = r.spans
        label, start, stop, alike = want[r.doc_id]
        assert (r.labels, span.start, span.stop) == (label, start, stop) and abs(r.score - alike) < 1e-9


def test_alignment_with_free_ends():
    rng = random.Random(1)
    for _ in range(300):
        template, text = ([rng.choice("abc") for _ in range(n)] for n in (rng.randint(2, 6), rng.randint(1, 12)))
        alike, start, stop = licenses.aligned(template, text)
        here = text[start:stop]
        row = list(range(len(here) + 1))
        for i, x in enumerate(template, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(here, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        assert alike == 0 or abs(alike - (1 - row[-1] / max(len(template), len(here)))) < 1e-9
    assert licenses.aligned(list("abc"), list("xxabcabcx")) == (1, 2, 5)
