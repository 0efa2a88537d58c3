"""Queries over whole tables that their SQL doesn't say, or only for some rows."""

import __spark_entry__ as entry
from gristmill.plans import views


def test_mixtures_have_no_cap(spark, tmp_path):
    spark.range(1000).selectExpr("id AS doc_id", "concat('src', id % 2) AS source", "'t' AS text").write.parquet(f"{tmp_path}/documents.parquet")
    q = entry.queries()
    cut = {(s, k): n for s in ("src0", "src1") for k, n in (("train", 475), ("val", 25))}
    assert {(r.source, r.split): r.n for r in q["row_mix"](spark, str(tmp_path)).collect()} == cut
    split = {r.doc_id: r.split for r in q["mixture_split"](spark, str(tmp_path)).collect()}
    assert sorted(split) == list(range(1000))
    order = [(r.split, r.shuffle) for r in q["mixture_order"](spark, str(tmp_path)).collect()]
    assert len(order) == 1000 and order == sorted(order)
    both = q["mixture_with_contrastive"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.contrastive, r.split) for r in both) == sorted((i, c, s) for i, s in split.items() for c in (False, True))


def test_every_perturbed_answer_has_a_contrastive_record(spark, sf):
    got = entry.queries()["contrastive_record"](spark, sf).collect()
    numeric = {r.sample_id: r.gold for r in views.qa(spark, sf).filter("answer_type = 'numeric'").collect()}
    expect = {}
    for i, gold in numeric.items():
        v = float(gold)
        moved = v + max(abs(v) * 0.05, 1.0 if v.is_integer() else 0.1)
        told = f"<verdict>FAIL</verdict>\n<correct_answer>{gold}</correct_answer>\n<correction>\n<answer>{gold}</answer>\n</correction>"
        expect[i] = (told, f"<answer>{round(moved) if v.is_integer() else format(moved, ".4g")}</answer>")
    found = {r.sample_id: (r.output, r.wrong) for r in got if r.sample_id in numeric}
    assert len(got) == len({r.sample_id for r in got})
    assert found == expect
