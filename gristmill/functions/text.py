"""Text normalisers and type inference as column functions.

Everything here is built from JVM-side expressions, so it stays inside
whole-stage code generation and can be pushed below joins and aggregates.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's ``str`` methods see it.
WS = r"(?U)[\s\x1c-\x1f]"
#: The same characters one by one, for trimming without a pattern.
WS_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Text that is a float, once white space round it is gone.
FLOAT = r"(?i)^[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?|nan|inf|infinity)$"
#: Text that is a decimal number.
DECIMAL = r"(?i)^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:e[+-]?[0-9]+)?$"

# The words and terms that decide types and tasks.
YES_NO = ("yes", "no", "true", "false")
YES_NO_PREFIXES = ("is ", "are ", "does ", "do ", "was ", "were ")
ARITHMETIC = ("difference", "sum", "average", "ratio")
EXTREMA = ("highest", "lowest", "maximum", "minimum")
VALUE = ("how many", "what is the value")
CHART = ("chart", "graph")
PLOT_ARITHMETIC = ("difference", "ratio", "average", "total", "sum", "combined", "more than", "less than")
PLOT_LABEL = ("label", "title", "represent", "legend")
PLOT_VALUE_PREFIXES = ("how many", "in how many", "what is the value")
FIXED_TYPES = ("yes_no", "text", "multiple_choice")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body names it.

    It goes through an array function, which isn't compiled: for expressions that
    would otherwise grow with every level, not for the hot path."""
    return F.get(F.transform(F.array(value), body), 0)


def any_of(tests) -> Column:
    return reduce(lambda a, b: a | b, tests)


def contains_any(text: Column, terms) -> Column:
    return any_of([text.contains(t) for t in terms])


def starts_any(text: Column, terms) -> Column:
    return any_of([text.startswith(t) for t in terms])


def strip(text: Column | str) -> Column:
    """Without white space at both ends."""
    return F.btrim(_c(text), F.lit(WS_CHARS))


def collapse(text: Column | str) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(_c(text), f"{WS}+", " "))


def rstrip_chars(text: Column, chars: str) -> Column:
    return F.rtrim(text, F.lit(chars))


def normalize_text(text: Column | str) -> Column:
    """Lower case, no white space or ``.!?`` at the ends, single spaces within."""
    low = F.lower(strip(text))
    return collapse(F.btrim(low, F.lit(" \t\r\n.!?")))


def normalize_yes_no(text: Column | str) -> Column:
    t = normalize_text(text)
    return F.when(t == "true", "yes").when(t == "false", "no").otherwise(t)


def parse_float(text: Column) -> Column:
    """A double, or null where the text isn't a float."""
    return F.regexp_extract(strip(text), FLOAT, 0).try_cast("double")


def float_of(text: Column | str) -> Column:
    """Of text that may have thousands separators and a percent sign."""
    return parse_float(rstrip_chars(F.replace(strip(text), F.lit(","), F.lit("")), "%"))


def float_text(x: Column) -> Column:
    """Doubles as text: whole numbers below 1e16 in full with ``.0``, others in Java's form."""
    whole = (F.abs(x) < 1e16) & (x == F.floor(x)) & (x != 0)
    return F.when(whole, F.concat(x.cast("decimal(17,0)").cast("string"), F.lit(".0"))).otherwise(x.cast("string"))


def normalize_numeric(text: Column | str) -> Column:
    value = float_of(text)
    return F.when(value.isNotNull(), float_text(value)).otherwise(normalize_text(text))


def normalize_by_type(answer_type: Column | str, text: Column | str) -> Column:
    kind = _c(answer_type)
    return F.when(kind == "numeric", normalize_numeric(text)).when(kind == "yes_no", normalize_yes_no(text)).otherwise(normalize_text(text))


def infer_answer_type(answer: Column | str, has_options: Column | None = None) -> Column:
    """``multiple_choice`` with options, else by the text: ``yes_no``, ``numeric`` or ``text``."""
    t = rstrip_chars(F.lower(strip(answer)), "!.?")
    number = parse_float(rstrip_chars(F.replace(t, F.lit(","), F.lit("")), "%"))
    by_text = F.when(t.isin(*YES_NO), "yes_no").when(number.isNotNull(), "numeric").otherwise("text")
    return by_text if has_options is None else F.when(F.coalesce(has_options, F.lit(False)), "multiple_choice").otherwise(by_text)


def infer_task_type(question: Column | str) -> Column:
    q = F.lower(_c(question))
    return (
        F.when(starts_any(q, YES_NO_PREFIXES), "yes_no")
        .when(contains_any(q, ARITHMETIC), "arithmetic")
        .when(contains_any(q, EXTREMA), "global_extrema")
        .when(contains_any(q, VALUE), "value_extraction")
        .when(contains_any(q, CHART), "chart_reasoning")
    )


def plot_task_type(question: Column | str, question_type: Column | None = None) -> Column:
    q = F.lower(_c(question))
    kind = F.lower(F.coalesce(question_type, F.lit(""))) if question_type is not None else F.lit("")
    return (
        F.when(kind.startswith("yes_no") | starts_any(q, YES_NO_PREFIXES), "yes_no")
        .when(contains_any(q, PLOT_ARITHMETIC), "arithmetic")
        .when(contains_any(q, EXTREMA), "global_extrema")
        .when(contains_any(q, PLOT_LABEL), "chart_reasoning")
        .when(starts_any(q, PLOT_VALUE_PREFIXES), "value_extraction")
        .otherwise(infer_task_type(question))
    )


def answer_mode(question: Column | str, answer_type: Column | str, task_type: Column | str) -> Column:
    """The mode that the source adapter records."""
    return (
        F.when(_c(answer_type).isin(*FIXED_TYPES), "fixed_vocabulary")
        .when(_c(task_type) == "arithmetic", "computed_oov")
        .when(contains_any(F.lower(_c(question)), EXTREMA), "computed_or_extractive")
        .otherwise("extractive_or_count")
    )


def scorer_mode(answer_type: Column | str, task_type: Column | str) -> Column:
    """The mode that the scorer records: as above without extrema."""
    return F.when(_c(answer_type).isin(*FIXED_TYPES), "fixed_vocabulary").when(_c(task_type) == "arithmetic", "computed_oov").otherwise("extractive_or_count")


def decimal_bare(text: Column | str) -> Column:
    """The text of a number without separators, a percent sign and a last full stop."""
    return strip(rstrip_chars(rstrip_chars(F.replace(strip(text), F.lit(","), F.lit("")), "."), "%"))


def bare_decimal(bare: Column) -> Column:
    return F.regexp_extract(bare, DECIMAL, 0).try_cast("decimal(38,12)")


def parse_decimal(text: Column | str) -> Column:
    """``decimal(38,12)``, or null where the text is no number or doesn't fit.

    Texts with an exponent go through the same cast, which reads exponents."""
    return bare_decimal(decimal_bare(text))


def plain_decimal(bare: Column, value: Column) -> Column:
    """A parsed number in plain notation without trailing zeros, with the sign that its
    bare text has even for zero.  The twelve places of the type end every text."""
    digits = F.regexp_replace(F.regexp_replace(F.abs(value).cast("decimal(38,12)").cast("string"), r"(?i)^0e-?[0-9]+$", "0."), r"\.?0*$", "")
    return F.concat(F.when(bare.startswith("-"), F.lit("-")).otherwise(F.lit("")), F.when(digits == "", "0").otherwise(digits))


def decimal_text(text: Column | str) -> Column:
    """The number in plain notation; null where the text is no number."""
    bare = decimal_bare(text)
    return plain_decimal(bare, bare_decimal(bare))


def normalize_decimal(text: Column | str) -> Column:
    return F.coalesce(decimal_text(text), normalize_text(text))


def normalize_decimal_by_type(answer_type: Column | str, text: Column | str) -> Column:
    kind = _c(answer_type)
    return F.when(kind == "numeric", normalize_decimal(text)).when(kind == "yes_no", normalize_yes_no(text)).otherwise(normalize_text(text))


def first_present(*columns: Column | str) -> Column:
    return F.coalesce(*map(_c, columns))


def first_truthy(*columns: Column | str) -> Column:
    """The first text that is neither null nor empty."""
    return F.coalesce(*(F.nullif(_c(c), F.lit("")) for c in columns))


def numbers(text: Column | str) -> Column:
    """Number tokens in the order of the text."""
    return F.regexp_extract_all(_c(text), F.lit(r"(?U)\b\d+(?:\.\d+)?\b"), F.lit(0))


def word_count(text: Column | str) -> Column:
    return F.regexp_count(_c(text), F.lit(r"(?U)[^\s\x1c-\x1f]+"))


def safe_name(text: Column | str) -> Column:
    """A file name: runs of other characters as ``_``, none of ``._-`` at the ends."""
    name = F.regexp_replace(strip(text), r"[^A-Za-z0-9_.-]+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(name, r"^[._-]+|[._-]+$", ""), F.lit("")), F.lit("batch"))


def metric_name(text: Column | str) -> Column:
    """A metric key: spaces and slashes as ``_``."""
    return F.translate(_c(text), " /", "__")


def artifact_name(text: Column | str) -> Column:
    """A file name for an artifact: everything but letters, digits and ``-_.`` as ``_``."""
    return F.regexp_replace(_c(text), r"[^\p{L}\p{N}_.-]", "_")


def percent(ratio: Column | str) -> Column:
    return F.format_string("%.1f%%", _c(ratio) * 100)


def accuracy(correct: Column, total: Column) -> Column:
    return F.coalesce(F.try_divide(correct.cast("double"), total.cast("double")), F.lit(0.0))


def media_type(data: Column | str) -> Column:
    """By magic bytes: jpeg, png, gif or webp; png where none fits."""
    head = F.hex(F.substring(_c(data), 1, 12))
    return (
        F.when(head.startswith("FFD8FF"), "image/jpeg")
        .when(head.startswith("89504E470D0A1A0A"), "image/png")
        .when(head.startswith("474946383761") | head.startswith("474946383961"), "image/gif")
        .when(head.startswith("52494646") & head.endswith("57454250"), "image/webp")
        .otherwise("image/png")
    )


def data_url(data: Column | str) -> Column:
    return F.concat(F.lit("data:"), media_type(data), F.lit(";base64,"), F.regexp_replace(F.base64(_c(data)), "[\r\n]", ""))


def metadata_value(metadata: Column | str, key: str) -> Column:
    """A field of metadata (JSON text), as text; null where there is none or no metadata."""
    return F.get_json_object(_c(metadata), f"$.{key}")


def latency_ms(value: Column | str) -> Column:
    """A latency, if the JSON value is a number; a quoted one isn't."""
    text = strip(_c(value))
    return F.when(text.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"), text.try_cast("double"))
