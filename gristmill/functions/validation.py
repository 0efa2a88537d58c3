"""Validation of tagged responses as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill.functions.text import _c, contains_any, let, numbers, parse_float, rstrip_chars, starts_any, strip, word_count

# Required tags, terms and messages.
STAGE1_TAGS = ("perceive", "extract", "answer")
STAGE1_COMPUTE_TAGS = ("perceive", "extract", "compute", "answer")
STAGE2_TAGS = ("perceive", "extract", "compare", "verdict", "confidence", "rubric")
COMPUTE_TERMS = ("difference", "ratio", "average", "total", "sum", "combined", "how much more", "how much less")
COUNT_TERMS = ("how many", "count", "number of")
CHANGE_TERMS = ("increase", "decrease", "change", "difference", "higher", "lower", "minimum", "maximum")
SIMPLE_PREFIXES = ("is ", "are ", "was ", "were ", "does ", "do ", "how many")
NOT_NUMERIC_TYPES = ("yes_no", "text", "multiple_choice", "structure")
EXTRA_NUMBERS = ("extract includes unnecessary numeric/date evidence: ", ". Keep only facts needed to answer the question.")
TOO_BROAD = "extract is too broad for a simple question. Keep only the minimal evidence needed."
BROAD_WORDS = 42


def tag_value(text: Column | str, tag: str) -> Column:
    """The body of the first tag of that name, trimmed; null if there is none or it is empty."""
    body = F.regexp_extract(_c(text), rf"(?is)<{tag}>(.*?)</{tag}>", 1)
    return F.nullif(strip(body), F.lit(""))


def verdict(text: Column | str) -> Column:
    word = F.regexp_extract(tag_value(text, "verdict"), r"(?iU)\b(PASS|FAIL)\b", 1)
    return F.nullif(F.upper(word), F.lit(""))


def vote(text: Column | str, stage: int = 1) -> Column:
    return tag_value(text, "answer") if stage == 1 else verdict(text)


def normalize_vote(text: Column | str) -> Column:
    """Lower case with single spaces; punctuation stays."""
    return F.regexp_replace(F.lower(strip(text)), r"(?U)[\s\x1c-\x1f]+", " ")


def required_tags(stage: int, requires_compute: Column | None = None) -> Column:
    tags = lambda names: F.array(*map(F.lit, names))
    if stage != 1:
        return tags(STAGE2_TAGS)
    return tags(STAGE1_TAGS) if requires_compute is None else F.when(requires_compute, tags(STAGE1_COMPUTE_TAGS)).otherwise(tags(STAGE1_TAGS))


def validation_error(text: Column | str, stage: int = 1, requires_compute: Column | None = None) -> Column:
    """Null for a valid response, else what is missing, in the order of the tags."""
    t = _c(text)
    names = STAGE2_TAGS if stage != 1 else STAGE1_TAGS if requires_compute is None else STAGE1_COMPUTE_TAGS
    absent = []
    for name in names:
        need = requires_compute if name == "compute" else F.lit(True)
        absent.append(F.when(need & tag_value(t, name).isNull(), F.lit(name)))
    missing = F.array_compact(F.array(*absent))
    return F.when(t.isNull() | (t == ""), "empty response").when(F.size(missing) > 0, F.concat(F.lit("missing or empty XML tags: "), F.array_join(missing, ", ")))


def is_valid(text: Column | str, stage: int = 1, requires_compute: Column | None = None) -> Column:
    return validation_error(text, stage, requires_compute).isNull()


def looks_numeric(text: Column | str) -> Column:
    bare = rstrip_chars(rstrip_chars(F.replace(strip(text), F.lit(","), F.lit("")), "%"), ".")
    return F.coalesce(parse_float(bare).isNotNull(), F.lit(False))


def requires_compute(question, answer, answer_type, task_type, mode) -> Column:
    """Whether a stage-1 trace has to show a computation."""
    q = F.lower(F.coalesce(_c(question), F.lit("")))
    kind = _c(answer_type)
    return (
        F.when(kind.isin(*NOT_NUMERIC_TYPES), False)
        .when(kind.isNull() & _c(answer).isNotNull() & ~looks_numeric(answer), False)
        .when(_c(mode) == "computed_oov", True)
        .when(_c(task_type) == "arithmetic", True)
        .otherwise(looks_numeric(answer) & contains_any(q, COMPUTE_TERMS))
    )


def extra_numbers(extract: Column | str, allowed_text: Column) -> Column:
    """Numbers of the extract that the other text hasn't, repeats kept."""
    return let(numbers(allowed_text), lambda allowed: F.filter(numbers(extract), lambda x: ~F.array_contains(allowed, x)))


def allowance(question: Column | str) -> Column:
    q = F.lower(_c(question))
    return F.when(contains_any(q, COUNT_TERMS), 1).when(contains_any(q, CHANGE_TERMS), 2).otherwise(1)


def simple_question(question: Column | str) -> Column:
    return starts_any(F.lower(_c(question)), SIMPLE_PREFIXES)


def lint_errors(text: Column | str, question: Column | str, answer: Column | str, stage: int = 1) -> Column:
    """Messages about an extract that says too much; none without an extract."""
    if stage != 1:
        return F.array().cast("array<string>")
    q = F.coalesce(_c(question), F.lit(""))
    allowed = F.concat(q, F.lit(" "), F.coalesce(_c(answer), F.lit("")))

    # The extract and its numbers are found once each.
    def told(extract: Column) -> Column:
        many = let(extra_numbers(extract, allowed), lambda extra: F.when(F.size(extra) > allowance(q), F.concat(F.lit(EXTRA_NUMBERS[0]), F.array_join(extra, ", "), F.lit(EXTRA_NUMBERS[1]))))
        broad = F.when(simple_question(q) & (word_count(extract) > BROAD_WORDS), F.lit(TOO_BROAD))
        return F.when(extract.isNull(), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(many, broad)))

    return let(tag_value(text, "extract"), told)


def lint_message(errors: Column) -> Column:
    return F.when(F.size(errors) > 0, F.array_join(errors, " "))


def numeric_adjudication(dataset, answer_type, stage: int = 1) -> Column:
    """Whether a disagreement may be settled by adjudication."""
    return F.lit(stage == 1) & (_c(dataset) == "plotqa_qa") & (_c(answer_type) == "numeric")


