import json
import random

from conftest import STATION_V1, STATION_V2

from pactlake.operators.compat import check_compatibility
from pactlake.operators.documents import schema_shapes
from pactlake.operators.pack_tables import check_with_packs, pack_rows, resolved
from pactlake.operators.policy import NO_OBJECT, PolicyPacks, policy_violations
from pactlake.schemas import RULES
from pactlake.sources.registry import read_policy_configs

CHECKS = (
    "contract_id string, base_version string, candidate_version string, mode string, config_id string, policy_pack string"
)


def configs(seed=0, n=120):
    rng = random.Random(seed)
    rules = [r for r, _, _ in RULES]
    names = ["strict", " Strict", "BASELINE", "baseline ", "own", "", " ", "x-y"]
    spellings = (str, str.lower, lambda r: f" {r} ", lambda r: r.replace("_", "-"))
    out = []
    for _ in range(n):
        packs = {}
        for name in rng.sample(names, rng.randint(0, 5)):
            stated = {}
            for rule in rng.sample(rules, rng.randint(0, 5)):
                stated[rng.choice(spellings)(rule)] = rng.choice(["BREAKING", "WARNING", "IGNORE", None])
            if rng.random() < 0.1:
                stated[rng.choice(["", "  ", "GONE"])] = "WARNING"
            if rng.random() < 0.1:
                stated["field-removed"] = rng.choice(["loud", ""])
            packs[name] = rng.choice([{"rules": stated}] * 6 + [None, {}, {"rules": None}])
        config = {"packs": packs}
        if rng.random() < 0.7:
            config["defaultPack"] = rng.choice([*names, "nope", None])
        out.append(json.dumps(config))
    return out + [None, "", "{}", "[]", "{", '"text"', "null", '{"packs": null}', '{"defaultPack": "BASELINE"}']


def parsed(text):
    """(packs, error) by the parser of a single configuration."""
    try:
        config = json.loads(text) if text else {}
    except ValueError:
        config = None
    if not isinstance(config, dict):
        return None, NO_OBJECT
    problems = policy_violations(config)
    return (None, problems[0][2]) if problems else (PolicyPacks.parse(text), None)


def test_rows_are_what_the_parser_of_one_configuration_reads(spark):
    texts = configs()
    df = spark.createDataFrame(list(enumerate(texts)), "config_id int, text string")
    got = sorted((tuple(r) for r in pack_rows(df).collect()), key=str)
    want, refused = [], 0
    for i, text in enumerate(texts):
        packs, error = parsed(text)
        refused += error is not None
        if error:
            want.append((i, None, True, None, error))
            continue
        for pack, levels in packs.severities.items():
            want.append((i, pack, pack == packs.default, [levels[r] for r, _, _ in RULES], None))
    assert got == sorted(want, key=str)
    assert 20 < refused < len(texts) - 40


def test_checks_are_judged_as_under_their_configuration_alone(spark, docs_of):
    docs = docs_of(("a.b", 1, STATION_V1), ("a.b", 2, STATION_V2))
    shapes = schema_shapes(docs).cache()
    texts = configs(1, 14)
    asked = ["strict", " STRICT ", "nope", None, "", "baseline", "own"]
    rows = [
        ("a.b", *pair, mode, f"c{i}", pack)
        for i in range(len(texts))
        for pack in asked
        for pair, mode in ((("v1", "v2"), "FULL"), (("v2", "v1"), "BACKWARD"))
    ]
    rows += [("a.b", "v1", "v2", "FULL", "absent", "strict"), ("a.b", "v1", "v2", "FULL", None, None)]
    rows += [("a.b", "v1", "v7", "FULL", "absent", None), ("a.b", "v1", "v2", "ODD", "absent", None)]
    table = spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(texts)], "config_id string, text string")
    packs = pack_rows(table).cache()
    found = check_with_packs(shapes, spark.createDataFrame(rows + rows[:9], CHECKS), packs).collect()
    got = {(r.base_version, r.candidate_version, r.mode, r.config_id, r.pack): tuple(r)[6:] for r in found}
    assert len(got) == len(found)

    alone = {}
    for _, base, candidate, mode, config, pack in rows:
        text = texts[int(config[1:])] if config and config[1:].isdigit() else None
        own, error = parsed(text)
        if error:
            alone[base, candidate, mode, config, None] = ("ERROR", [], [], error)
            continue
        name = (pack or "").strip().lower()
        name = name if name in own.severities else own.default
        key = (base, candidate, mode, config, name)
        if key not in alone:
            alone[key] = (own, name)
    assert set(got) == set(alone)
    # One call of the single-configuration check for each distinct set of severities.
    verdicts = {}
    for (base, candidate, mode, config, name), want in alone.items():
        if isinstance(want[0], str):
            assert got[base, candidate, mode, config, name] == want
            continue
        levels = tuple(sorted(want[0].severities[name].items()))
        verdicts.setdefault((base, candidate, mode, levels), []).append((config, name))
    packs_of = {levels: f"p{i}" for i, levels in enumerate(sorted({k[3] for k in verdicts}))}
    joint = PolicyPacks("p0", {name: dict(levels) for levels, name in packs_of.items()})
    checks = [("a.b", b, c, m, packs_of[levels]) for b, c, m, levels in verdicts]
    schema = "contract_id string, base_version string, candidate_version string, mode string, pack string"
    judged = check_compatibility(shapes, spark.createDataFrame(checks, schema), joint).collect()
    single = {(r.base_version, r.candidate_version, r.mode, r.pack): tuple(r)[5:] for r in judged}
    for (base, candidate, mode, levels), users in verdicts.items():
        for config, name in users:
            assert got[base, candidate, mode, config, name] == single[base, candidate, mode, packs_of[levels]]
    assert len({v[0] for v in got.values()}) == 3 and len(verdicts) > 10


def test_plan_does_not_grow_with_the_configurations(spark):
    def plan(n):
        texts = [json.dumps({"packs": {f"p{i}": {"rules": {"FIELD_REMOVED": "IGNORE"}}}}) for i in range(n)]
        table = spark.createDataFrame(list(enumerate(texts)), "config_id int, text string")
        rows = spark.range(5).selectExpr("cast(id as int) as config_id", "'p1' as policy_pack")
        out = resolved(rows, pack_rows(table))
        return out, len(out._jdf.queryExecution().optimizedPlan().toString())

    (_, small), (many, large) = plan(2), plan(2000)
    assert large < small + 100
    assert {(r.config_id, r.pack) for r in many.collect()} == {
        (0, "baseline"), (1, "p1"), (2, "baseline"), (3, "baseline"), (4, "baseline"),
    }


def test_configurations_from_folders(spark, tmp_path):
    for name, text in (("team.a", '{"packs":{"own":{}},"defaultPack":"own"}'), ("team b+c", "[]")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "policy-packs.json").write_text(text)
    (tmp_path / "team.d").mkdir()
    rows = pack_rows(read_policy_configs(spark, str(tmp_path))).collect()
    assert {(r.config_id, r.pack, r.is_default, r.config_error) for r in rows} == {
        ("team.a", "own", True, None), ("team.a", "baseline", False, None), ("team b+c", None, True, NO_OBJECT),
    }
