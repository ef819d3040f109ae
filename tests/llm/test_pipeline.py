import corpus_pipeline
from pactlake.llm import decontaminate, lines, near_copies, quality

SF = "/root/testdata/sf0.001"


def test_stages_take_effect_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "line dedup", "SimHash near-dedup", "benchmark decontamination", "best-fit packing",
    ]
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, seen[-1], SF).collect()
        schema = docs.schema if len(seen) < 5 else None
        seen.append(spark.createDataFrame(rows, schema) if schema else rows)
    scored, deduped, distinct, clean, pieces = seen[1:]
    assert all(s.columns == docs.columns for s in seen[:5])
    judged = {r.doc_id: r.predicted for r in quality.scored(docs, quality.fit(docs, labels)).collect()}
    assert {r.doc_id for r in scored.collect()} == {d for d, p in judged.items() if p}
    report = {r.doc_id: r.n_removed for r in lines.line_report(spark, scored).collect()}
    before = {r.doc_id: r.text for r in scored.collect()}
    after = {r.doc_id: r.text for r in deduped.collect()}
    assert set(after) == set(before) and sum(report.values()) > 0
    assert all((after[d] == before[d]) == (report[d] == 0) for d in after)
    groups = {r.first.doc_id for r in near_copies.grouped(spark, deduped).select("first").distinct().collect()}
    assert {r.doc_id for r in distinct.collect()} == groups
    bad = {r.doc_id for r in decontaminate.contamination_report(distinct, items).collect() if r.contaminated}
    assert {r.doc_id for r in clean.collect()} == groups - bad
    words = {r.doc_id: len(r.text.split()) for r in clean.collect()}
    packed = {}
    for r in pieces:
        packed[r.doc_id] = packed.get(r.doc_id, 0) + r.n_words
    assert packed == words


def test_run_gives_the_rows_of_the_stages(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "piece", "start", "n_words", "bin", "room"]


def test_empty_and_odd_documents_pass_every_stage(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = [spark.createDataFrame([], schema)]
    docs.append(spark.createDataFrame([(None, None, None, None, None), (1, "", "", "", 0), (1, "", "", "", 0)], schema))
    for rows in docs:
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, rows, SF).count() <= max(rows.count(), 0)
