"""Perturbed answers for counterexamples."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill.functions.keys import stable_index
from gristmill.functions.text import _c, float_of, let, strip


def _below_tie(x: Column) -> Column:
    """``x``, or a number just below it where its shortest text is a tie of the fifth
    digit that its binary value rounds down.

    Five digits of the text over a power of ten are compared with the binary value by
    a product whose rounding error is computed exactly (Dekker's)."""
    high = lambda v: F.lit(134217729.0) * v - (F.lit(134217729.0) * v - v)

    def scaled(p: Column) -> Column:
        n = F.regexp_replace(F.substring_index(p["text"], "e", 1), "[-.]", "").cast("double")
        scale = F.lit(4) - F.substring_index(p["text"], "e", -1).cast("int")
        size = F.abs(p["x"])
        return F.struct(p["x"].alias("x"), size.alias("v"), n.alias("n"), scale.alias("scale"), F.pow(F.lit(10.0), F.abs(scale)).alias("ten"))

    def compared(p: Column) -> Column:
        v, ten, product = p["v"], p["ten"], p["v"] * p["ten"]
        vh, th = high(v), high(ten)
        error = ((vh * th - product) + vh * (ten - th) + (v - vh) * th) + (v - vh) * (ten - th)
        rest = F.when(p["scale"] >= 0, (product - p["n"]) + error).otherwise(v - p["n"] * ten)
        near = F.abs(rest) < F.when(p["scale"] >= 0, p["n"]).otherwise(v) * 1e-12
        down = near & (p["n"] % 10 == 5) & (F.abs(p["scale"]) <= 22) & ((rest < 0) | ((rest == 0) & (F.floor(p["n"] / 10) % 2 == 0)))
        lower = F.when(p["scale"] >= 0, (p["n"] - 1) / ten).otherwise((p["n"] - 1) * ten)
        return F.when(down, F.signum(p["x"]) * lower).otherwise(p["x"])

    return let(F.struct(x.alias("x"), F.format_string("%.4e", x).alias("text")), lambda p: let(scaled(p), compared))


def four_digits(x: Column) -> Column:
    """A double with four significant digits and no trailing zeros, in scientific
    form below 1e-4 and from 1e4 on.  The binary value is rounded, ties to even."""
    trimmed = lambda t: F.regexp_replace(F.regexp_replace(t, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    parts = lambda s: F.struct(
        F.when(s.startswith("-"), "-").otherwise("").alias("sign"),
        F.regexp_replace(F.substring_index(s, "e", 1), "[-.]", "").alias("digits"),
        F.substring_index(s, "e", -1).cast("int").alias("power"),
    )

    def write(v: Column) -> Column:
        d, p = v["digits"], v["power"]
        large = F.concat(F.substr(d, F.lit(1), p + 1), F.lit("."), F.substr(d, p + 2))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -p - 1), d)
        science = F.concat(trimmed(F.concat(F.substr(d, F.lit(1), F.lit(1)), F.lit("."), F.substr(d, F.lit(2)))), F.lit("e"), F.when(p < 0, "-").otherwise("+"), F.lpad(F.abs(p).cast("string"), 2, "0"))
        return F.concat(v["sign"], F.when((p < -4) | (p >= 4), science).when(p >= 0, trimmed(large)).otherwise(trimmed(small)))

    return let(F.format_string("%.3e", _below_tie(x)), lambda s: let(parts(s), write))


def shift_number(answer: Column | str) -> Column:
    """The number moved up by a twentieth, by 1 (0.1 for fractions) at least; null
    where the answer is no finite number."""

    def move(v: Column) -> Column:
        whole = v == F.floor(v)
        moved = v + F.greatest(F.abs(v) * 0.05, F.when(whole, 1.0).otherwise(0.1))
        text = F.when(whole, F.bround(moved.cast("decimal(38,6)"), 0).cast("decimal(38,0)").cast("string")).otherwise(four_digits(moved))
        return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), text)

    return let(float_of(answer), move)


def flip(answer: Column | str) -> Column:
    low = F.lower(strip(answer))
    return F.when(low.isin("yes", "true"), "no").when(low.isin("no", "false"), "yes")


def alternate(answer: Column | str, candidates: Column, seed: int | None) -> Column:
    """Another candidate, picked by a hash of the answer.  A single letter from A to
    D without candidates has those four."""
    letters = F.array(*map(F.lit, "ABCD"))
    given = F.coalesce(candidates, F.array().cast("array<string>"))

    def pick(v: Column) -> Column:
        pool = F.when((F.size(v["given"]) == 0) & v["own"].rlike("^[A-Da-d]$"), letters).otherwise(v["given"])
        others = F.filter(pool, lambda c: F.lower(c) != F.lower(v["own"]))
        return let(others, lambda o: F.when(F.size(o) > 0, F.get(o, stable_index(v["own"], seed, F.size(o)).cast("int"))))

    return let(F.struct(strip(answer).alias("own"), given.alias("given")), pick)


def perturbation(answer: Column | str, answer_type: Column | str, candidates: Column, seed: int | None) -> Column:
    """``struct<answer, kind>`` of the perturbed answer, null where there is none."""
    kind = _c(answer_type)
    new = (
        F.when(kind == "yes_no", flip(answer))
        .when(kind == "numeric", shift_number(strip(answer)))
        .when(kind.isin("multiple_choice", "text"), alternate(answer, candidates, seed))
    )
    name = (
        F.when(kind == "yes_no", "yes_no_flip").when(kind == "numeric", "numeric_shift").when(kind == "multiple_choice", "choice_swap").when(kind == "text", "text_swap")
    )
    return let(F.struct(new.alias("answer"), name.alias("kind")), lambda p: F.when(p["answer"].isNotNull(), p))


def replace_answer(output: Column | str, answer: Column) -> Column:
    """The output with the body of its first answer tag replaced; null without one."""
    text = _c(output)
    pattern = r"(?is)^(.*?<answer>).*?(</answer>.*)$"
    head, tail = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
    return F.when(text.rlike(r"(?is)<answer>.*?</answer>"), F.concat(head, answer, tail))


def candidate_values(options_json: Column | str) -> Column:
    """Candidates from JSON text: the sorted keys of an object, the strings of a list."""
    raw = _c(options_json)
    keys = F.array_sort(F.map_keys(F.from_json(raw, "map<string,string>")))
    return F.when(F.substring(F.trim(raw), 1, 1) == "{", keys).when(F.substring(F.trim(raw), 1, 1) == "[", F.from_json(raw, "array<string>")).otherwise(
        F.array().cast("array<string>")
    )
