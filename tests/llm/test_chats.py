import random

import pytest

from pactlake.llm import chats

SCHEMA = "conv_id bigint, turn bigint, role string, text string, part int"


def brute(rows):
    convs = {}
    for conv, turn, role, text in set(rows):
        convs.setdefault(conv, []).append((turn, role, text))
    said = {c: [(r, t) for _, r, t in sorted(turns, key=lambda x: x[0])] for c, turns in convs.items()}
    out = {}
    for c, own in sorted(said.items(), key=lambda x: (x[0] is None, x[0] or 0)):
        prefix = any(len(o) > len(own) and o[: len(own)] == own for o in said.values())
        if not prefix and own not in [said[k] for k in out]:
            out[c] = own
    clean = lambda x: (x or "").replace("<|", "< |")
    return {c: "".join(f"<|{clean(r)}|>\n{clean(t)}<|end|>\n" for r, t in own) for c, own in out.items()}


def fixture():
    rng = random.Random(2)
    rows = []
    for c in range(60):
        base = rng.randrange(6)
        n = rng.randint(1, 9)
        step = rng.choice([1, 1, 3])
        for i in range(n):
            text = f"text {base} {i}" if i < 5 or c % 4 else f"own {c}"
            rows.append((c, i * step, "user" if i % 2 == 0 else "assistant", text))
    rows += [(100, i, "user", f"long {i}") for i in range(40)] + [(101, i, "user", f"long {i}") for i in range(33)]
    rows += [(102, 0, None, None), (103, 0, None, ""), (104, 0, "", "a <|end|> b"), (None, 0, "user", "alone")]
    return rows + rows[:7]


@pytest.mark.parametrize("size", [1024, 4])
def test_matches_brute_force(spark, size):
    rows = fixture()
    want = brute(rows)
    convs = spark.createDataFrame([(*r, 3) for r in rows], SCHEMA)
    got = {}
    for r in sorted(chats.formatted(spark, convs, size).collect(), key=lambda r: r.part):
        parts = got.setdefault(r.conv_id, [])
        assert len(parts) == r.part and r.text.count("<|end|>") == r.n_turns <= size
        parts.append(r.text)
    assert {c: "".join(p) for c, p in got.items()} == want
    assert 10 < len(want) < 60
    assert size == 1024 or len(got[100]) == 10


def test_turns_without_a_number_and_empty_table(spark):
    rows = [(1, None, "user", "b", 0), (1, None, "user", "a", 0), (1, 0, "user", "c", 0), (2, None, "user", "a", 0)]
    got = sorted(chats.formatted(spark, spark.createDataFrame(rows, SCHEMA)).collect())
    text = {c: "".join(r.text for r in got if r.conv_id == c) for c in (1, 2)}
    assert text[1].count("<|user|>") == 3 and text[1].endswith("c<|end|>\n")
    assert text[2] in ("", "<|user|>\na<|end|>\n")
    assert chats.formatted(spark, spark.createDataFrame([], SCHEMA)).count() == 0
