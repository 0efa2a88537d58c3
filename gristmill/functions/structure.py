"""Parsing and scoring of chart structures written as tags, as column functions.

Parsing yields ``array<struct<name, x: array<string>, y: array<double>>>``; facts
are its points.  Greedy one-to-one matching folds over the gold facts with the
predictions that are still free as state.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill.functions.text import _c, collapse, first_truthy, float_of, let, normalize_text

# Labels that stand for nothing.
PLACEHOLDERS = ("x", "y", "x1", "x2", "y1", "y2", "series name")
STRUCTURAL_TAGS = ("<s_y", "<s_x", "<s_name", "<series")
EMPTY_TEXT = "array<string>"
SERIES = "array<struct<name:string,x:array<string>,y:array<double>>>"
FACT = "struct<series:string,x:string,y:double>"


def _empty(kind: str = EMPTY_TEXT) -> Column:
    return F.array().cast(kind)


def _filled(values: Column) -> Column:
    return F.filter(F.transform(values, collapse), lambda v: v != "")


def tag_bodies(text: Column, tag: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?is)<{tag}>(.*?)</{tag}>"), F.lit(1))


def without_boxes(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), r"(?is)<s_bboxes>.*?</s_bboxes>", "")


def split_values(text: Column) -> Column:
    return _filled(F.split(text, r"(?i)<sep\s*/>"))


def all_floats(values: Column) -> Column:
    """Doubles, or null if there are no values or one is no number."""
    ok = lambda p: F.when((F.size(p) > 0) & F.forall(p, lambda v: v.isNotNull()), p)
    return let(F.transform(values, float_of), ok)


def variant_values(text: Column) -> Column:
    """Values parted by separators, commas or semicolons, or by spaces if all are numbers."""

    def split(t: Column) -> Column:
        words = let(F.split(t, " "), lambda w: F.when((F.size(w) > 1) & all_floats(w).isNotNull(), w))
        return (
            F.when(t.isNull() | (t == ""), _empty())
            .when(t.rlike(r"(?i)<sep\s*/>"), split_values(t))
            .when(t.rlike("[,;]"), _filled(F.split(t, "[,;]+")))
            .otherwise(F.coalesce(words, F.array(t)))
        )

    return let(collapse(text), split)


def has_placeholder(values: Column) -> Column:
    return F.exists(values, lambda v: normalize_text(v).isin(*PLACEHOLDERS))


def axes(raw_x: Column, raw_y: Column) -> Column:
    """``struct<x, y>`` with the numeric side as y; empty where neither is numeric."""
    pair = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    none = pair(_empty(), _empty("array<double>"))

    def choose(v: Column) -> Column:
        return (
            F.when(has_placeholder(v["x"]) | has_placeholder(v["y"]), none)
            .when(v["yn"].isNotNull(), pair(v["x"], v["yn"]))
            .when(v["xn"].isNotNull(), pair(v["y"], v["xn"]))
            .otherwise(none)
        )

    numbered = lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"), all_floats(v["x"]).alias("xn"), all_floats(v["y"]).alias("yn"))
    return let(pair(raw_x, raw_y), lambda v: let(numbered(v), choose))


def _series(name: Column, pair: Column) -> Column:
    def cut(s: Column) -> Column:
        size = F.least(F.size(s["p"]["x"]), F.size(s["p"]["y"]))
        return F.struct(s["n"].alias("name"), F.slice(s["p"]["x"], 1, size).alias("x"), F.slice(s["p"]["y"], 1, size).alias("y"))

    return let(F.struct(name.alias("n"), pair.alias("p")), cut)


def pick_group(groups: Column, i: Column) -> Column:
    """The group of that place, the last one where there are fewer."""
    return F.when(F.size(groups) == 0, _empty()).otherwise(F.get(groups, F.least(i, F.size(groups) - 1)))


def parse_tags(text: Column) -> Column:
    groups = F.struct(
        F.transform(tag_bodies(text, "s_name"), collapse).alias("names"),
        F.transform(tag_bodies(text, "s_x"), split_values).alias("x"),
        F.transform(tag_bodies(text, "s_y"), split_values).alias("y"),
    )

    def series(g: Column) -> Column:
        name = lambda i: F.coalesce(F.nullif(F.get(g["names"], i), F.lit("")), F.concat(F.lit("series_"), i.cast("string")))
        return F.transform(g["y"], lambda v, i: _series(name(i), axes(pick_group(g["x"], i), v)))

    return F.filter(let(groups, series), lambda s: F.size(s["x"]) > 0)


def attribute(attributes: Column, key: str) -> Column:
    """The last value of that key, of whatever case; null if there is none."""
    pattern = r"""(?U)([\w:-]+)\s*=\s*["']([^"']*)["']"""
    keys = F.reverse(F.transform(F.regexp_extract_all(attributes, F.lit(pattern), F.lit(1)), F.lower))
    values = F.reverse(F.regexp_extract_all(attributes, F.lit(pattern), F.lit(2)))
    return F.get(values, (F.array_position(keys, key) - 1).cast("int"))


def parse_series(text: Column) -> Column:
    block = r"(?is)<series\b([^>]*)>(.*?)</series>"
    both = F.zip_with(
        F.regexp_extract_all(text, F.lit(block), F.lit(1)),
        F.regexp_extract_all(text, F.lit(block), F.lit(2)),
        lambda a, b: F.struct(a.alias("a"), b.alias("b")),
    )
    alone = F.transform(F.regexp_extract_all(text, F.lit(r"(?is)<series\b([^>]*)/>"), F.lit(1)), lambda a: F.struct(a.alias("a"), F.lit("").alias("b")))
    first = lambda s, tag: F.get(tag_bodies(s["b"], tag), 0)

    def series(s: Column) -> Column:
        name = first_truthy(attribute(s["a"], "name"), attribute(s["a"], "label"), first(s, "name"), first(s, "s_name"))
        x = variant_values(first_truthy(attribute(s["a"], "x"), first(s, "x"), first(s, "s_x")))
        y = variant_values(first_truthy(attribute(s["a"], "y"), first(s, "y"), first(s, "s_y")))
        return _series(name, axes(x, y))

    found = F.filter(F.transform(F.concat(both, alone), series), lambda s: s["name"].isNotNull() & (F.size(s["x"]) > 0))
    return F.transform(found, lambda s: F.struct(collapse(s["name"]).alias("name"), s["x"].alias("x"), s["y"].alias("y")))


def parse(text: Column | str) -> Column:
    """Series of either form, bounding boxes left out."""
    bare = without_boxes(text)
    either = lambda tagged: F.when(F.size(tagged["s"]) > 0, tagged["s"]).otherwise(parse_series(tagged["t"]))
    return let(bare, lambda t: let(F.struct(parse_tags(t).alias("s"), t.alias("t")), either)).cast(SERIES)


def facts(series: Column) -> Column:
    points = F.transform(
        series,
        lambda s: F.transform(s["x"], lambda x, i: F.struct(normalize_text(s["name"]).alias("series"), normalize_text(x).alias("x"), F.get(s["y"], i).alias("y"))),
    )
    return F.flatten(points)


def harmonic(p: Column, r: Column) -> Column:
    return F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / F.when(p + r == 0, F.lit(1.0)).otherwise(p + r))


def prf(matches: Column, gold: Column, predicted: Column) -> Column:
    """Precision, recall and F1 from the number of matches."""
    both = let(F.struct((matches / predicted).alias("p"), (matches / gold).alias("r")), lambda v: F.struct(v["p"].alias("precision"), v["r"].alias("recall"), harmonic(v["p"], v["r"]).alias("f1")))
    return both


def set_prf(gold: Column, predicted: Column) -> Column:
    """Of distinct labels."""
    flat = lambda x: F.struct(*(F.lit(x).alias(n) for n in ("precision", "recall", "f1")))

    def compare(v: Column) -> Column:
        g, p = F.size(v["g"]), F.size(v["p"])
        met = prf(F.size(F.array_intersect(v["g"], v["p"])).cast("double"), g, p)
        return F.when((g == 0) & (p == 0), flat(1.0)).when((g == 0) | (p == 0), flat(0.0)).otherwise(met)

    return let(F.struct(F.array_distinct(gold).alias("g"), F.array_distinct(predicted).alias("p")), compare)


def greedy_matches(gold: Column, predicted: Column, kind: str, matches) -> Column:
    """How many of ``gold``, in order, find a free prediction; the first that fits is used up."""
    state = F.struct(predicted.cast(f"array<{kind}>").alias("free"), F.lit(0).alias("n"))

    def step(s: Column, g: Column) -> Column:
        found = F.array_position(F.transform(s["free"], lambda p: matches(g, p)), True).cast("int")

        def use(at: Column) -> Column:
            rest = F.concat(F.slice(s["free"], 1, F.greatest(at - 1, F.lit(0))), F.slice(s["free"], at + 1, F.size(s["free"])))
            return F.struct(F.when(at > 0, rest).otherwise(s["free"]).alias("free"), (s["n"] + (at > 0).cast("int")).alias("n"))

        return let(found, use)

    return F.aggregate(gold, state, step, lambda s: s["n"].cast("double"))


def fact_matches(gold: Column, predicted: Column, tolerance: float = 1e-3) -> Column:
    return (gold["series"] == predicted["series"]) & (gold["x"] == predicted["x"]) & (F.abs(gold["y"] - predicted["y"]) <= tolerance)


def values_match(gold: Column, predicted: Column, relative: float = 0.05) -> Column:
    allowed = F.greatest(F.abs(gold) * relative, F.lit(1e-3))
    return F.coalesce(~F.isnan(gold) & ~F.isnan(predicted) & (F.abs(gold - predicted) <= allowed), F.lit(False))


def metric_columns(gold_series: Column, predicted_series: Column, gold_facts: Column, predicted_facts: Column) -> dict[str, Column]:
    """Precision, recall and F1 of series names, x labels, points and values; null
    where either side has no facts."""
    both = (F.size(gold_facts) > 0) & (F.size(predicted_facts) > 0)
    labels = lambda s: F.flatten(F.transform(s, lambda v: F.transform(v["x"], normalize_text)))
    names = lambda s: F.transform(s, lambda v: normalize_text(v["name"]))
    ys = lambda f: F.transform(f, lambda v: v["y"])
    n_gold, n_predicted = F.size(gold_facts), F.size(predicted_facts)
    found = {
        "series": set_prf(names(gold_series), names(predicted_series)),
        "x": set_prf(labels(gold_series), labels(predicted_series)),
        "point": prf(greedy_matches(gold_facts, predicted_facts, FACT, fact_matches), n_gold, n_predicted),
        "value": prf(greedy_matches(ys(gold_facts), ys(predicted_facts), "double", values_match), n_gold, n_predicted),
    }
    return {k: F.when(both, v) for k, v in found.items()}


def score_columns(metrics: dict[str, Column], gold_series: Column, predicted_series: Column, gold_facts: Column, predicted_facts: Column, exact: Column) -> dict[str, Column]:
    """The score and every figure beside it, by name."""
    n_gold, n_predicted = F.size(gold_facts), F.size(predicted_facts)
    both, whole = (n_gold > 0) & (n_predicted > 0), exact.cast("double")
    out = {"gold_parse_ok": n_gold > 0, "prediction_parse_ok": n_predicted > 0}
    for prefix, metric in (("series", "series"), ("x", "x"), ("x_label", "x"), ("point", "point"), ("value", "value")):
        for part in ("precision", "recall", "f1"):
            rest = whole if prefix == "value" or (prefix, part) == ("point", "f1") else F.lit(0.0)
            out[f"{prefix}_{part}"] = F.coalesce(metrics[metric][part], rest)
    out["strict_point_f1"] = out["point_f1"]
    component = (metrics["series"]["f1"] + metrics["x"]["f1"] + metrics["value"]["f1"]) / 3
    coverage = F.least(n_predicted / F.when(n_gold > 0, n_gold), F.lit(1.0))
    out["component_f1"] = F.when(both, component).otherwise(whole)
    out["fact_coverage"] = F.when(both, coverage).otherwise(whole)
    out["model_quality_score"] = F.when(both, (component + coverage) / 2).otherwise(whole)
    out["count_match"] = F.when(both & (n_gold == n_predicted), 1.0).otherwise(0.0)
    out |= {"gold_series": F.size(gold_series), "predicted_series": F.size(predicted_series), "gold_facts": n_gold, "predicted_facts": n_predicted}
    return out | {"parse_ok": both, "exact_match": exact}


def bucket(score: Column, gold_ok: Column, predicted_ok: Column, exact: Column, prediction: Column) -> Column:
    """What kind of failure or success a record is; the first that applies."""
    low = F.lower(prediction)
    tags = low.contains(STRUCTURAL_TAGS[0])
    for t in STRUCTURAL_TAGS[1:]:
        tags = tags | low.contains(t)
    return (
        F.when(~gold_ok, "gold_parse_error")
        .when(collapse(prediction) == "", "empty_output")
        .when(low.rlike(r"(?U)\b(?:x|y|x1|x2|y1|y2|series name)\b"), "placeholder_output")
        .when(~tags, "no_structural_tags")
        .when(~predicted_ok, "unparsed_schema_variant")
        .when(exact, "exact_match")
        .when(score == 1.0, "semantic_match")
        .when(score > 0.0, "partial_semantic_match")
        .otherwise("parsed_but_no_semantic_match")
    )
