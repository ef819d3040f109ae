import random
import re
from collections import Counter

import numpy as np
import pytest

from pactlake.llm import bitmaps, phrases

DOCS = "doc_id bigint, text string, lang string, n int, word string, id bigint, w1 bigint"


def brute(rows, least, top, covered=80):
    """Collocations by the definition, from dictionaries of all phrases."""
    counts, total = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    path = (lang, *words[i : i + k])
                    counts[path] = counts.get(path, 0) + 1
    candidates = {p: a for p, a in counts.items() if len(p) > 2 and a >= least}
    out = {}
    for path, a in candidates.items():
        lang, words = path[0], path[1:]
        cuts = []
        for k in range(1, len(words)):
            l, r = counts[(lang, *words[:k])], counts[(lang, *words[k:])]
            cuts.append((2000000 * a // (l + r), k, l, r))
        around = [
            f for longer, f in candidates.items()
            if longer[0] == lang and len(longer) > len(path)
            and any(longer[i : i + len(words)] == words for i in range(1, len(longer)))
        ]
        if not any(100 * f >= covered * a for f in around):
            score, _, l, r = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), l, r))
    return sorted(
        (lang, rank, phrase.decode(), -a, l, r, total[lang], -score)
        for lang, found in out.items()
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1)
    )


def fixture(seed=1):
    rng = random.Random(seed)
    words = ["a", "b", "été", "Über", "x\x00y", "c-d", " ", "zz"]
    fixed = ["new york city hall", "a b c d e f", "Él dice que"]
    rows = [(None, "en"), ("", None), (" \t ", "en"), ("...,,\n", "fr"), ("one", ""), ("a b " * 3000, "en")]
    for _ in range(80):
        said = " ".join(
            rng.choice(fixed) if rng.random() < 0.3 else rng.choice(words) + rng.choice(["", "", ".", "\n", "\t", " ,"])
            for _ in range(rng.randint(1, 40))
        )
        rows.append((said, rng.choice(["en", "en", "fr", None, "und"])))
    return rows + rows[-5:]


@pytest.mark.parametrize(("burst", "room", "ids", "step", "bits"), [(4096, 1 << 18, 1 << 18, 1 << 18, 1 << 26), (2, 20, 6, 64, 64)])
def test_matches_brute_force(spark, monkeypatch, burst, room, ids, step, bits):
    for name, value in (("BURST", burst), ("ROOM", room), ("IDS", ids), ("STEP", step)):
        monkeypatch.setattr(phrases, name, value)
    monkeypatch.setattr(bitmaps, "BITS", bits)
    rows = fixture()
    docs = spark.createDataFrame([(i, t, lang, 1, "w", 2, 3) for i, (t, lang) in enumerate(rows)], DOCS)
    want = brute(rows, 3, 40)
    assert len(want) > 60 and len({lang for lang, *_ in want}) == 3
    got = phrases.collocations(spark, docs.repartition(3), least=3, top=40)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == want


def test_nothing_to_find(spark):
    assert phrases.collocations(spark, spark.createDataFrame([], DOCS)).count() == 0
    docs = spark.createDataFrame([(1, None, None, 1, "", 1, 1), (2, "a b", "en", 1, "", 1, 1)], DOCS)
    assert phrases.collocations(spark, docs).count() == 0


def test_exact_beyond_64_bits(spark):
    # 2,000,000 a passes 64 bits where a passes 4.6e12.
    a, both = 9 * 10**12, 10**13
    value = spark.sql(
        f"select cast(2000000 as decimal(8)) * cast({a}L as decimal(20)) div cast({both}L + {both}L as decimal(20)) as s"
    )
    assert value.first().s == 2000000 * a // (2 * both)


@pytest.mark.parametrize("depth", [2, 4])
def test_trie_counts_paths_through_bursts_and_spills(depth):
    rng = random.Random(depth)
    trie, want, got, bursts = phrases.HatTrie(depth, burst=3, room=60), Counter(), Counter(), 0
    runs = []
    for _ in range(40):
        rows = []
        for _ in range(rng.randint(1, 50)):
            n = rng.randint(2, depth)
            rows.append([rng.choice([7, 7, 7, *range(100, 130)]) for _ in range(n)] + [0] * (depth - n))
        names = np.array(rows, np.uint64)
        want.update(map(tuple, names.tolist()))
        ids = np.zeros(names.shape, np.int64)
        distinct, back = np.unique(names[names > 0], return_inverse=True)
        ids[names > 0] = trie.number(distinct)[back]
        rest = np.zeros(len(ids), np.int64)
        for j in range(1, depth):
            rest = rest << phrases._ID | ids[:, j]
        trie.add(ids[:, 0], rest)
        bursts += any(type(child) is phrases.Node for child in trie.root.values())
        assert trie.size == phrases._paths(trie.root)
        if trie.size > trie.room:
            runs += trie.spill(whole=False)
            assert trie.size <= trie.room // 2
    runs += trie.spill(whole=True)
    assert trie.size == 0 and not trie.root
    for paths, counts in runs:
        rows = list(zip(*(p.tolist() for p in paths)))
        assert len(set(rows)) == len(rows)
        for row, n in zip(rows, counts.tolist()):
            got[row] += n
    assert got == want
    assert bursts or depth == 2
