"""Plain documents are read in one pass, with the result of the careful reading."""

from pyspark.sql import functions as F

from pactlake.operators import documents, lint, ordering
from pactlake.plans import registration
from proving import fixtures

SF = "/root/testdata/sf0.001"
ODD = [
    '{"type":"object","properties":{"a":{"type":"string"},"b":{"type":["integer","null"],"enum":["E2","E1","E2"]}},"required":["a"]}',
    '{}',
    '{} x',
    '{},{}',
    '{}{}',
    '[]',
    '',
    None,
    '  {"properties":{}} ',
    '{"properties":{}}',
    '{"properties":{},"required":[]}',
    '{"properties":null}',
    '{"properties":{"a":null}}',
    '{"properties":{"a":5}}',
    '{"properties":{"a":{}}}',
    '{"properties":{"a":{"type":"string","enum":null}}}',
    '{"properties":{"a":{"type":"string","enum": null}}}',
    '{"properties":{"a":{"type":"string","enum":[]}}}',
    '{"properties":{"a":{"type":"string","enum":[null,"x"]}}}',
    '{"properties":{"a":{"type":"string","enum":[{"y":1}]}}}',
    '{"properties":{"a":{"type":"string","enum":["a]",{"x":1}]}}}',
    '{"properties":{"a":{"type":"string","enum":["[x"]}}}',
    '{"properties":{"a":{"type":"string","enum":[1,1.0,true,"1"]}}}',
    '{"properties":{"a":{"type":"string","enum":"x"}}}',
    '{"properties":{"a":{"type":"string","enum":"x","enum":["a"]}}}',
    '{"properties":{"a":{"type":"string","enum":["a"],"enum":5}}}',
    '{"properties":{"1":{"type":"string"}},"required":[1]}',
    '{"properties":{"1":{"type":"string"}},"required":["1"]}',
    '{"properties":{"true":{"type":"string"}},"required":[true]}',
    '{"properties":{"a":{"type":"string"}},"required":["a","Ghost"]}',
    '{"properties":{"a":{"type":"string"}},"required":[null]}',
    '{"properties":{"a":{"type":"string"}},"required":["a","a"]}',
    '{"properties":{"a":{"type":"string"}},"required":"a"}',
    '{"properties":{"a":{"type":"string"}},"required":[["a"]]}',
    '{"properties":{"a":{"type":"string","type":5}}}',
    '{"properties":{"a":{"type":5,"type":"string"}}}',
    '{"properties":{"a":{"type":"string","type":null}}}',
    '{"properties":{"a":{"type":"string"},"a":{"type":"number"}}}',
    '{"properties":{"a":{"type":"string"}},"properties":5}',
    '{"properties":{"a":{"type":"string"}},"properties":{"b":{"type":"number"}}}',
    '{"properties":{"a":{"type":"String"}}}',
    '{"properties":{"a":{"type":" string "}}}',
    '{"properties":{"a":{"type":"null"}}}',
    '{"properties":{"a":{"type":["null"]}}}',
    '{"properties":{"a":{"type":["string"]}}}',
    '{"properties":{"a":{"type":["string","integer","null"]}}}',
    '{"properties":{"a":{"type":"[\\"string\\",\\"null\\"]"}}}',
    '{"properties":{"a":{"type":[ "string" , "null" ]}}}',
    '{"properties":{"a":{"type":["string","null"],"nullable":false}}}',
    '{"properties":{"a":{"type":"string","nullable":true}}}',
    '{"properties":{"a":{"type":"string","nullable":"true"}}}',
    '{"properties":{"a":{"type":"string","nullable":1}}}',
    '{"properties":{"a":{"type":"string","nullable":" true"}}}',
    '{"properties":{"a":{"type":"string","nullable":null}}}',
    '{"properties":{"a":{"type":["string","null"],"nullable":"x"}}}',
    '{"properties":{"a\\"b":{"type":"string"},"c\\u005b":{"type":"string"}}}',
    '{"properties":{"\xfc\u2028\U0001f600\x7f":{"type":"string","enum":["\xe4\u2028","\U0001f600"]}},"required":["\xfc\u2028\U0001f600\x7f"]}',
    '{"properties":{"a\tb":{"type":"string"}}}',
    '{"properties":{"":{"type":"string"}}}',
    "{'properties':{}}",
    '{"properties":{"a":{"type":"string",}}}',
    '{"properties":{"a":{"type":"string"/*c*/}}}',
    '{"properties":{"a":{"type":NaN}}}',
    '{"properties":{"a":{"type":"string","minimum":NaN}}}',
    '{"properties":{"a":{"type":"string","minimum":01}}}',
    '{"properties":{"a":{"type":"string","minimum":1e999}}}',
    '{"properties":{"a":{"type":"object","properties":{"b":5},"required":["q"]}}}',
    '{"properties":{"type":{"type":"string"},"enum":{"type":"string"},"required":{"type":"array"}}}',
    '{"properties":[]}',
    '{"properties":{"a":[]}}',
    '{"properties":{"a":"x"}}',
    '{"properties":{"a":{"type":"string"}}',
    '{"properties":{"a":{"type":"string","x":' + "[" * 990 + "]" * 990 + "}}",
    '{"properties":{"a":{"type":"string","x":' + "[" * 1200 + "]" * 1200 + "}}",
    '{"properties":{"a":{"type":"string"}}}\n\t ',
    '\ufeff{"properties":{"a":{"type":"string"}}}',
    '{"properties":{"a":{"type":"string"}}}\x00',
    '{"properties":{"a":{"type":"string","enum":["x","y, z","q\xa0"]}}}',
    '{"properties":{"a":{"type":"string","enum":["a",1.50,1E2,-0]}}}',
    '{"a":1,"properties":{"a":{"type":"string"}}, "properties" :  {"z":{"type":"boolean","enum" : ["x"]}},"required" : ["z"]}',
    '{"properties":{"a":{"type":"string","enum":["true","1"]},"b":{"type":"string","enum":["1","true"]}}}',
    *fixtures.FAULTY_DOCS.values(),
]


def test_plain_shapes_are_the_careful_ones(spark):
    rows = [(f"c.{i}", v, 1, text) for i, text in enumerate(ODD) for v in ("v1", "v99999999999")]
    docs = spark.createDataFrame(rows, "contract_id string, version string, version_num int, schema_json string")
    docs = docs.unionByName(fixtures.churning_documents(spark, SF))
    fast = documents.schema_shapes(docs)
    careful = documents._careful_shapes(lint.with_document_error(docs)).select(*fast.columns)
    assert fast.exceptAll(careful).collect() == []
    assert careful.exceptAll(fast).collect() == []


def test_ordinary_documents_are_plain(spark):
    for docs in (fixtures.churning_documents(spark, SF), fixtures.evolving_documents(spark, SF)):
        read = documents.with_plain_shape(docs)
        assert read.agg(F.count_if(F.col("plain_shape").isNull())).first()[0] == 0


def test_derived_documents_are_those_of_the_fields(spark):
    for fields, docs in (
        (fixtures.evolving_fields, fixtures.evolving_documents),
        (fixtures.churning_fields, fixtures.churning_documents),
    ):
        old = fixtures.all_documents(spark, SF, fields(spark, SF))
        new = docs(spark, SF).select(*old.columns)
        assert old.exceptAll(new).collect() == [] and new.exceptAll(old).collect() == []


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_documents_meet_no_broadcast(spark, docs_of, tmp_path):
    """A small file may hold very many equal documents, which the driver could not."""
    text = '{"properties":{"a":{"type":"string"}},"required":[]}'
    owners = spark.createDataFrame(
        [("x.y", "team", "dom", "FULL", None)],
        "contract_id string, owner_team string, domain string, compatibility_mode string, policy_pack string",
    )
    documents.schema_shapes(docs_of(("x.y", 1, text), ("x.y", 2, text))).write.parquet(f"{tmp_path}/shapes")
    shapes = spark.read.parquet(f"{tmp_path}/shapes")
    candidates = docs_of(("x.y", 3, text)).select("contract_id", "version", "schema_json")
    found = registration.register_versions(candidates, owners, shapes, fixtures.packs())
    assert [(r.accepted, r.reason) for r in found.collect()] == [(True, None)]
    assert "Broadcast" not in _plan(found)


def test_few_versions_are_sorted_once(spark, docs_of):
    """Documents are carried between buckets only where there is more than one."""
    def shuffles(*numbers):
        shapes = documents.schema_shapes(docs_of(*[("x.y", n, "{}") for n in numbers]))
        both = ordering.adjacent_documents(shapes)
        return [r.base_version for r in both.orderBy("candidate_version").collect()], _plan(both).count("SortAggregate")

    assert shuffles(1, 2, 5) == (["v1", "v2"], 0)
    pairs, sorts = shuffles(1, 4095, 4096, 9000)
    assert sorted(pairs) == ["v1", "v4095", "v4096"] and sorts > 0


def test_plain_candidates_are_not_taken_apart(spark, docs_of, monkeypatch):
    """Registration lints member by member only what is not plain, and judges it alike."""
    careful, seen = documents._careful_shapes, []
    monkeypatch.setattr(documents, "_careful_shapes", lambda rows: (seen.append(rows), careful(rows))[1])
    plain, odd = '{"properties":{"a":{"type":"string"}},"required":[]}', '{"properties":{"a":{"type":"String"}}}'
    owners = spark.createDataFrame(
        [(c, "team", "dom", "FULL", None) for c in ("x.y", "x.z")],
        "contract_id string, owner_team string, domain string, compatibility_mode string, policy_pack string",
    )
    shapes = documents.schema_shapes(docs_of(("x.y", 1, plain), ("x.z", 1, plain)))
    seen.clear()
    candidates = docs_of(("x.y", 2, plain), ("x.y", 3, "[]"), ("x.z", 2, odd), ("x.z", 3, '{"properties":5}'))
    candidates = candidates.select("contract_id", "version", "schema_json")
    found = registration.register_versions(candidates, owners, shapes, fixtures.packs())
    assert sorted((r.contract_id, r.version, r.reason) for r in found.collect()) == [
        ("x.y", "v2", None), ("x.y", "v3", "schema must be a JSON object."),
        ("x.z", "v2", None), ("x.z", "v3", "'properties' must be an object in v3.json."),
    ]
    read = seen[0].select("schema_json").where("schema_json is not null").collect()
    assert len(seen) == 1 and plain not in {r.schema_json for r in read}
