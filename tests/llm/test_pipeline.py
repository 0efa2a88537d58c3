from collections import Counter

import corpus_pipeline as P

from gristmill.llm import langid, simhash, toxicity
from gristmill.llm.common import materialize


def test_stages_filter_and_keep_the_columns(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    named = dict(P.STAGES)
    one = named["language_id"](spark, docs, d)
    assert one.columns == docs.columns
    told = {r.id: (r.lang_pred, r.score) for r in langid.identify(docs, langid.train(docs)).collect()}
    assert {r.doc_id for r in one.collect()} == {i for i, (g, s) in told.items() if s >= 0.5}
    two = named["toxicity"](spark, docs, d)
    labels = spark.read.parquet(f"{d}/labels.parquet")
    scores = {r.id: r.score for r in toxicity.score_texts(docs, toxicity.train(docs, labels)).collect()}
    assert {r.doc_id for r in two.collect()} == {i for i, s in scores.items() if s < 0.3}
    three = named["near_duplicates"](spark, docs, d)
    classes = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert sorted(r.doc_id for r in three.collect()) == sorted(set(classes.values()))
    four = named["mixture"](spark, docs, d)
    assert four.columns == docs.columns
    assert set(Counter(r.doc_id for r in four.collect()).values()) <= {1, 2}
    five = named["packing"](spark, four, d)
    assert five.select("doc_id").distinct().count() == four.select("doc_id").distinct().count()


def test_run_applies_the_stages_in_order(spark, sf):
    assert [n for n, _ in P.STAGES] == ["language_id", "toxicity", "near_duplicates", "mixture", "packing"]
    rows = P.run(spark, sf).collect()
    used = Counter()
    for r in rows:
        used[r.sequence_id] += r.length
    assert rows and max(used.values()) <= 2048


def test_run_stands_odd_rows_and_an_empty_table(spark, odd, empty, tmp_path):
    labels = spark.createDataFrame([(1, 0), (8, 0), (None, 1), (6, None), (99, 1)], "doc_id long, toxic int")
    packed = {}
    for name, docs in (("odd", odd), ("empty", empty)):
        d = f"{tmp_path}/{name}"
        docs.write.parquet(f"{d}/documents.parquet")
        labels.write.parquet(f"{d}/labels.parquet")
        packed[name] = P.run(spark, d).collect()
        kept = spark.read.parquet(f"{d}/documents.parquet")
        for stage, f in P.STAGES[:-1]:
            kept = materialize(f(spark, kept, d), f"odd-{stage}")
            assert kept.columns == docs.columns
        assert Counter(r.doc_id for r in packed[name] if r.piece == 0) == Counter(r.doc_id for r in kept.select("doc_id").collect())
    assert not packed["empty"]
    # Texts without letters go with the language; of the three equal texts one row stays.
    ids = {r.doc_id for r in packed["odd"]}
    assert ids and ids.isdisjoint({2, 3, 4, 5})
