import hashlib
import random
import re

from pactlake.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = []
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows.append((item, w[i : i + 13]))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for item, window in windows:
            for i in range(len(w) - len(window) + 1):
                if w[i : i + len(window)] == window:
                    hit |= set(range(i, i + len(window)))
                    found |= {item} - {None}
        sha = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def fixture():
    rng = random.Random(5)
    word = lambda: rng.choice(["la", "Le", "ça", "x1", "tu", "of", "the", "et"]) + rng.choice("abcdefgh")
    line = lambda n: " ".join(word() for _ in range(n))
    items = [(1, line(30)), (2, line(13)), (3, line(7)), (10, line(3)), (20, "Zebra"), (None, line(15)), (5, ""), (6, None)]
    items += [(7, items[0][1][:90] + " " + line(4)), (7, items[1][1])]
    docs = [(0, None), (1, ""), (2, "zebra"), (3, "?!")]
    for i in range(40):
        parts = [line(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 2)):
            text = rng.choice(items)[1] or ""
            tokens = text.split()
            a = rng.randint(0, 3)
            parts += [" ".join(tokens[a : a + rng.randint(8, 30)]).replace(" ", ", "), line(rng.randint(0, 9))]
        docs.append((10 + i, "\n".join(parts)))
    return docs + [(10, docs[4][1]), (None, items[0][1]), (11, items[0][1])], items


def test_matches_brute_force(spark):
    docs, items = fixture()
    d = spark.createDataFrame([(*r, 1, 2, 3) for r in docs], "doc_id bigint, text string, hits int, _row int, `at` int")
    b = spark.createDataFrame([(*r, 2) for r in items], "item_id bigint, text string, items int")
    got = decontaminate.contamination_report(d, b)
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted((tuple(r) for r in got.select(columns).collect()), key=str) == brute(docs, items)
    judged = brute(docs, items)
    assert 5 < sum(r[-1] for r in judged) < len(judged) - 5
    left = decontaminate.clean(d, b)
    assert left.columns == d.columns and {(r.hits, r._row, r["at"]) for r in left.collect()} == {(1, 2, 3)}
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(r[0]) for r in judged if not r[-1])
    nothing = decontaminate.contamination_report(d, b.limit(0))
    assert {(r.n_hit, r.n_items, r.contaminated) for r in nothing.collect()} == {(0, 0, False)}
    assert decontaminate.contamination_report(d.limit(0), b).count() == 0


def test_scheme_guarantees_each_span():
    assert decontaminate.scheme([13]) == [(5, 9)]
    assert decontaminate.scheme([1, 3, 7, 13]) == [(5, 3), (1, 1), (3, 1)]


def test_many_windows_are_not_broadcast(spark, tmp_path, monkeypatch):
    spark.createDataFrame(rows := [(i, f"a b c {i}") for i in range(20)], "doc_id bigint, text string").write.parquet(str(tmp_path / "docs"))
    spark.createDataFrame([(str(i), t) for i, t in rows[:9]], "item_id string, text string").write.parquet(str(tmp_path / "items"))
    docs, items = (spark.read.parquet(str(tmp_path / t)) for t in ("docs", "items"))
    hit, joins = [], []
    for small in (decontaminate.SMALL, 0):
        monkeypatch.setattr(decontaminate, "SMALL", small)
        found = decontaminate.contamination(docs, items)
        hit.append(sorted(r.doc_id for r in found.where("contaminated").collect()))
        joins.append(found._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin"))
    assert hit == [list(range(9))] * 2 and joins[1] == 0 < joins[0]
