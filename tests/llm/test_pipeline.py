from pyspark.sql import functions as F

import corpus_pipeline
from aerotrace.llm import line_crf, toxicity
from aerotrace.llm.common import held_out, may_hold
from tests.llm.test_ngram_join import brute

SMALL = "/root/testdata/sf0.001"


def test_stages_equal_their_brute_force_forms(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    good = corpus_pipeline.good_documents(spark, docs, SMALL)
    score = {r["doc_id"]: r["score"] for r in line_crf.score(docs, line_crf.fit(docs, labels, ~held_out())).collect()}
    kept = {r["doc_id"]: r for r in good.collect()}
    assert good.columns == docs.columns and set(kept) == {i for i, s in score.items() if s >= 0.5}
    clean = corpus_pipeline.clean_documents(spark, good, SMALL)
    score = {r["doc_id"]: r["score"] for r in toxicity.score(good, toxicity.fit(good, labels, ~held_out())).collect()}
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == {i for i, s in score.items() if s < 0.7}
    repeated = clean.unionByName(clean.limit(20)).unionByName(spark.createDataFrame([(-1, None, "en", "s", 0), (-2, "", "en", "s", 0)], docs.schema))
    rows = [(r["doc_id"], r["text"]) for r in repeated.collect()]
    one = corpus_pipeline.different_documents(spark, repeated, SMALL)
    assert one.columns == docs.columns
    assert sorted(r["doc_id"] for r in one.collect()) == sorted({c for _, _, c in brute(rows, 5, 80)})


def test_run(spark):
    out = corpus_pipeline.run(spark, SMALL)
    assert out.count() > 0 and [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "toxicity", "n-gram Jaccard join", "packing"]


def test_texts_that_stand_alone_are_not_shuffled(spark):
    alone = [(i, f"word{i} is a text of its own number {i * i}", "en", "s", 0) for i in range(200)]
    rows = [*alone, (500, alone[7][1], "en", "s", 0), (None, alone[7][1], "en", "s", 0), (None, "only here and nowhere else", "en", "s", 0), (501, alone[9][1], "en", "s", 0), alone[9], (None, None, "en", "s", 0), (502, " ", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    one = corpus_pipeline.different_documents(spark, docs, SMALL)
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "")
    assert sorted(map(key, one.collect())) == sorted([(False, i, t) for i, t, *_ in alone] + [(True, 0, "only here and nowhere else"), (True, 0, ""), (False, 502, " ")])
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("LeftSemi"):]
    assert "ArrowEvalPython" in below.split("Relation")[0].split("LogicalRDD")[0]  # the filter comes before what brings texts together


def test_filter_of_fixed_size_holds_all_it_was_given(spark):
    hashes = spark.range(3000).select(F.xxhash64("id").alias("h"))
    test = may_hold(hashes, 1 << 16)
    got = {r.id for r in spark.range(10_000).filter(test(F.xxhash64("id"))).collect()}
    assert set(range(3000)) <= got and len(got) < 3500
    assert spark.range(100).filter(may_hold(hashes.limit(0))(F.xxhash64("id"))).isEmpty()
