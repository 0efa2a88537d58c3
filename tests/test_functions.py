"""Column functions on small cases."""

import hashlib

import pytest
from pyspark.sql import functions as F

from gristmill.functions import keys, perturb, structure
from gristmill.functions import text as X
from gristmill.functions import validation as V


def values(spark, inputs, column):
    """The value of a column function for each input text, in order."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(inputs)], "i int, t string")
    return [r.v for r in df.select("i", column(F.col("t")).alias("v")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("text", "kind"),
    [("Yes.", "yes_no"), (" TRUE! ", "yes_no"), ("1,234", "numeric"), ("12.5%", "numeric"), ("nan", "numeric"), ("1_000", "text"), ("1.0d", "text"), ("0x1p3", "text"), ("", "text"), ("blue", "text"), ("-3e5", "numeric")],
)
def test_answer_type(spark, text, kind):
    assert values(spark, [text], X.infer_answer_type) == [kind]


def test_answer_type_with_options(spark):
    assert values(spark, ["yes"], lambda t: X.infer_answer_type(t, F.lit(True))) == ["multiple_choice"]


def test_task_types(spark):
    asked = ["Is it up?", "What is the sum?", "Which is highest?", "How many bars?", "Describe the chart", "Who?"]
    assert values(spark, asked, X.infer_task_type) == ["yes_no", "arithmetic", "global_extrema", "value_extraction", "chart_reasoning", None]
    asked = ["Does it?", "How many in total?", "What is the minimum?", "What is the title?", "In how many years?", "Who?"]
    assert values(spark, asked, X.plot_task_type) == ["yes_no", "arithmetic", "global_extrema", "chart_reasoning", "value_extraction", None]


def test_normalize_text(spark):
    got = values(spark, ["  Hello   World!? ", ".A\tb.", "!!!", "\x1c x \x1f y ", " Z q"], X.normalize_text)
    assert got == ["hello world", "a b", "", "x y", "z q"]


def test_numeric_normal_forms(spark):
    got = values(spark, ["1,000", "10000000", "5%", "-0.0", "0", "NaN", "1.50", "n/a."], X.normalize_numeric)
    assert got == ["1000.0", "10000000.0", "5.0", "-0.0", "0.0", "NaN", "1.5", "n/a"]


def test_decimal_text(spark):
    got = values(spark, ["7.30", "1,200.00%", "+5.", ".50", "-0", "1e3", "abc", "100"], X.decimal_text)
    assert got == ["7.3", "1200", "5", "0.5", "-0", "1000", None, "100"]


def test_typed_equality(spark):
    df = spark.createDataFrame(
        [("yes_no", "Yes", "true."), ("numeric", "1,000", "1000.0"), ("numeric", "5", "5%"), ("text", "Blue Bar", "blue  bar!"), ("multiple_choice", "A", "b")],
        "answer_type string, gold string, prediction string",
    )
    same = X.normalize_by_type("answer_type", "gold") == X.normalize_by_type("answer_type", "prediction")
    assert [r[0] for r in df.select(same).collect()] == [True, True, True, True, False]


def test_tags(spark):
    texts = ["<Answer> 5\n</ANSWER>", "<answer></answer><answer>6</answer>", "none", "<answer>a</answer><answer>b</answer>"]
    assert values(spark, texts, lambda t: V.tag_value(t, "answer")) == ["5", None, None, "a"]
    assert values(spark, ["<verdict>it is a pass.</verdict>", "<verdict>bypass</verdict>"], V.verdict) == ["PASS", None]


def test_validation_messages(spark):
    full = "<perceive>a</perceive><extract>b</extract><answer>c</answer>"
    assert values(spark, [full, "", None, "<perceive>a</perceive>"], V.validation_error) == [
        None, "empty response", "empty response", "missing or empty XML tags: extract, answer"
    ]
    assert values(spark, [full], lambda t: V.validation_error(t, 1, F.lit(True))) == ["missing or empty XML tags: compute"]
    assert values(spark, [full], lambda t: V.validation_error(t, 2)) == ["missing or empty XML tags: compare, verdict, confidence, rubric"]


def test_requires_compute(spark):
    rows = [
        ("what is the total?", "5", "numeric", None, None, True),
        ("what is it?", "5", "numeric", None, None, False),
        ("what is it?", "5", "numeric", "arithmetic", None, True),
        ("what is it?", "5", "numeric", None, "computed_oov", True),
        ("the sum?", "blue", None, "arithmetic", None, False),
        ("the sum?", "yes", "yes_no", "arithmetic", None, False),
    ]
    df = spark.createDataFrame(rows, "q string, a string, k string, t string, m string, expect boolean")
    assert [r[0] == r[1] for r in df.select(V.requires_compute("q", "a", "k", "t", "m"), "expect").collect()] == [True] * len(rows)


def test_lint(spark):
    texts = ["<extract>A is 5, B is 7, C is 9</extract>", "<extract>A is 5</extract>", "<extract>" + "w " * 43 + "</extract>", "no tag"]
    got = values(spark, texts, lambda t: V.lint_errors(t, F.lit("How many?"), F.lit("5")))
    assert got[0] == ["extract includes unnecessary numeric/date evidence: 7, 9. Keep only facts needed to answer the question."]
    assert got[1] == [] and got[2] == [V.TOO_BROAD] and got[3] == []


def test_hash_draw(spark):
    def fraction(key):
        return int(hashlib.sha256(f"13:{key}".encode()).hexdigest()[:16], 16) / (2**64 - 1)

    names = [f"k{i}" for i in range(50)]
    assert values(spark, names, lambda t: keys.hash_draw(t, 0.25, 13)) == [fraction(k) < 0.25 for k in names]
    for rate, expect in ((0, False), (-1, False), (1, True), (2, True), (float("nan"), False), (float("inf"), False)):
        assert values(spark, ["a"], lambda t, r=rate: keys.hash_draw(t, r, 13)) == [expect]


def test_record_key(spark):
    import json

    def expect(**over):
        payload = {"version": keys.KEY_VERSION, "dataset": "d", "split": "s", "image_sha256": "i", "input": "q", "answer": "a", "answer_type": "text", "task_type": "", "sample_id_fallback": ""} | over
        return hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":")).encode()).hexdigest()

    parts = {"dataset": F.lit("d"), "split": F.lit("s"), "input_text": F.lit("q"), "answer": F.lit("a"), "answer_type": F.lit("text"), "sample_id": F.lit("z")}
    got = values(spark, ["x"], lambda t: F.array(keys.record_key(**parts, image_sha256=F.lit("i")), keys.record_key(**parts)))[0]
    assert got == [expect(), expect(image_sha256="", sample_id_fallback="z")]


def test_perturbations(spark):
    assert values(spark, ["10", "100", "-4", "0", "50", "1,000%"], perturb.shift_number) == ["11", "105", "-3", "1", "52", "1050"]
    shifted = values(spark, ["0.5", "123.456", "0.00001", "98765.4", "2.75", "x", "inf"], perturb.shift_number)
    expect = [f"{v + max(abs(v) * 0.05, 0.1):.4g}" for v in (0.5, 123.456, 0.00001, 98765.4, 2.75)]
    assert shifted == [*expect, None, None]
    assert values(spark, ["Yes", "false", "maybe"], perturb.flip) == ["no", "yes", None]
    none = F.lit(None).cast("array<string>")
    assert values(spark, ["a"], lambda t: perturb.alternate(t, none, 13))[0] in "BCD"
    assert values(spark, ["word"], lambda t: perturb.alternate(t, none, 13)) == [None]


def test_replace_answer(spark):
    texts = ["x <Answer>1</answer> y <answer>2</answer>", "none"]
    assert values(spark, texts, lambda t: perturb.replace_answer(t, F.lit(r"$1\2"))) == [r"x <Answer>$1\2</answer> y <answer>2</answer>", None]


def test_candidates(spark):
    assert values(spark, ['{"b": 1, "a": 2}', '["x", "y"]', "", None], perturb.candidate_values) == [["a", "b"], ["x", "y"], [], []]


def test_safe_names(spark):
    assert values(spark, [" a b/c ", "...", "x_-"], X.safe_name) == ["a_b_c", "batch", "x"]


def test_media_type(spark):
    heads = [b"\xff\xd8\xff1", b"\x89PNG\r\n\x1a\n", b"GIF89a", b"RIFF1234WEBP", b"RIFF1234WAVE", b""]
    df = spark.createDataFrame([(i, bytearray(h)) for i, h in enumerate(heads)], "i int, b binary")
    assert [r[0] for r in df.orderBy("i").select(X.media_type("b")).collect()] == [f"image/{k}" for k in ("jpeg", "png", "gif", "webp", "png", "png")]


def parsed(spark, text):
    return [(s.name, list(s.x), list(s.y)) for s in values(spark, [text], structure.parse)[0]]


def test_structure_forms(spark):
    assert parsed(spark, "<s><s_x>a<sep/> b </s_x><s_y>1<sep/>2%</s_y><s_name>N  m</s_name></s>") == [("N m", ["a", "b"], [1.0, 2.0])]
    assert parsed(spark, "<s_x>1<SEP />2</s_x><s_y>a<sep/>b</s_y>") == [("series_0", ["a", "b"], [1.0, 2.0])]
    assert parsed(spark, "<s_bboxes>9</s_bboxes><series name='s' x='a,b' y='1 2'/>") == [("s", ["a", "b"], [1.0, 2.0])]
    assert parsed(spark, "<series label=\"t\"><x>a;b</x><y>1;2;3</y></series>") == [("t", ["a", "b"], [1.0, 2.0])]
    assert parsed(spark, "<s_x>x1<sep/>x2</s_x><s_y>y1<sep/>y2</s_y>") == []
    assert parsed(spark, "<s_x>a</s_x><s_y>1</s_y><s_y>2</s_y><s_name>p</s_name><s_name>q</s_name>") == [("p", ["a"], [1.0]), ("q", ["a"], [2.0])]


def test_structure_score(spark):
    from gristmill.operators.scoring import bucketed, score_structures

    gold = "<s><s_x>a<sep/>b</s_x><s_y>10<sep/>20</s_y><s_name>N</s_name></s>"
    half = gold.replace("20", "99")
    df = spark.createDataFrame([(1, gold, gold), (2, gold, half), (3, gold, "no tags"), (4, gold, ""), (5, "bad", "bad"), (6, gold, "<series name='n' x='a,b' y='10,20'/>"), (7, gold, "<s_y>q</s_y>")], "i int, gold string, prediction string")
    got = {r.i: r for r in bucketed(score_structures(df)).collect()}
    assert got[1].score == 1.0 and got[1].bucket == "exact_match"
    assert got[2].plotqa_value_f1 == 0.5 and got[2].plotqa_point_f1 == 0.5 and got[2].score == pytest.approx(((1 + 1 + 0.5) / 3 + 1) / 2)
    assert got[3].bucket == "no_structural_tags" and got[4].bucket == "empty_output" and got[5].bucket == "gold_parse_error"
    assert got[6].score == 1.0 and got[6].bucket == "placeholder_output"
    assert got[7].bucket == "unparsed_schema_variant" and got[5].score == 1.0


def test_four_digits_round_the_binary_value(spark):
    import random

    rng = random.Random(8)
    values = [rng.randrange(1, 10**5) / 10 ** rng.randrange(0, 9) for _ in range(3000)] + [rng.randrange(1000, 10000) + 0.5 for _ in range(500)]
    values += [rng.randrange(10000, 100000) * 10 ** rng.randrange(0, 6) * 1.0 for _ in range(500)] + [rng.uniform(-1e6, 1e6) for _ in range(500)] + [0.0, -12.345, 1e-7, 24.255, 1e22]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [(r.v, r.t) for r in df.select("v", perturb.four_digits(F.col("v")).alias("t")).collect()] == [(v, format(v, ".4g")) for v in values]


def test_keys_in_ascii_and_ids_of_lists(spark):
    import hashlib
    import json

    texts = ["plain", "Größe \U0001f600 \u2028\u00a0\u00ad", 'a "b"', "it's", "it's \"both\"", "back\\slash\n", "bell\x07", None]
    df = spark.createDataFrame([(t, "x") for t in texts], "t string, u string")
    got = df.select(keys.ascii_json(F.to_json(F.array("t"))).alias("j"), keys.short_id(F.col("t"), F.col("u")).alias("i"), keys.record_key(dataset="u", split="u", input_text="t", ascii_only=True).alias("k")).collect()
    for t, r in zip(texts, got, strict=True):
        assert r.i == hashlib.sha1(str([t, "x"]).encode()).hexdigest()[:12]
        if t is not None and "\x07" not in t:
            assert r.j == json.dumps([t], separators=(",", ":"))
        fields = dict.fromkeys(keys.KEY_FIELDS, "") | {"dataset": "x", "split": "x", "input": t or "", "version": keys.KEY_VERSION, "sample_id_fallback": None}
        assert r.k == hashlib.sha256(json.dumps(fields, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
