"""SQL fragments for DuckDB that say what the column functions say."""

from __future__ import annotations

from gristmill.functions import text as X
from gristmill.functions import validation as V


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def collapse(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def normalize(x: str) -> str:
    inner = rf"regexp_replace(lower({strip(x)}), '^[ \t\r\n.!?]+|[ \t\r\n.!?]+$', '', 'g')"
    return collapse(inner)


def parse_float(x: str) -> str:
    return rf"CASE WHEN regexp_full_match({strip(x)}, '[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|nan|inf|infinity)', 'i') THEN TRY_CAST({strip(x)} AS DOUBLE) END"


def float_of(x: str) -> str:
    return parse_float(f"rtrim(replace({strip(x)}, ',', ''), '%')")


def yes_no(x: str) -> str:
    n = normalize(x)
    return f"CASE {n} WHEN 'true' THEN 'yes' WHEN 'false' THEN 'no' ELSE {n} END"


def same(kind: str, gold: str, prediction: str) -> str:
    """Whether two texts are equal after normalising by type."""
    g, p = float_of(gold), float_of(prediction)
    number = f"CASE WHEN ({g}) IS NOT NULL AND ({p}) IS NOT NULL THEN ({g}) = ({p}) WHEN ({g}) IS NULL AND ({p}) IS NULL THEN {normalize(gold)} = {normalize(prediction)} ELSE false END"
    return f"CASE {kind} WHEN 'numeric' THEN {number} WHEN 'yes_no' THEN ({yes_no(gold)}) = ({yes_no(prediction)}) ELSE {normalize(gold)} = {normalize(prediction)} END"


def decimal_bare(x: str) -> str:
    return strip(f"rtrim(rtrim(replace({strip(x)}, ',', ''), '.'), '%')")


def decimal(x: str) -> str:
    return rf"CASE WHEN regexp_full_match({decimal_bare(x)}, '[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)(e[+-]?[0-9]+)?', 'i') THEN TRY_CAST({decimal_bare(x)} AS DECIMAL(38,12)) END"


def same_decimal(kind: str, gold: str, prediction: str) -> str:
    g, p = decimal(gold), decimal(prediction)
    number = f"CASE WHEN ({g}) IS NOT NULL AND ({p}) IS NOT NULL THEN ({g}) = ({p}) WHEN ({g}) IS NULL AND ({p}) IS NULL THEN {normalize(gold)} = {normalize(prediction)} ELSE false END"
    return f"CASE {kind} WHEN 'numeric' THEN {number} WHEN 'yes_no' THEN ({yes_no(gold)}) = ({yes_no(prediction)}) ELSE {normalize(gold)} = {normalize(prediction)} END"


def _has(x: str, terms) -> str:
    return "(" + " OR ".join(f"contains({x}, '{t}')" for t in terms) + ")"


def _starts(x: str, terms) -> str:
    return "(" + " OR ".join(f"starts_with({x}, '{t}')" for t in terms) + ")"


def answer_type(x: str) -> str:
    t = f"rtrim(lower({strip(x)}), '!.?')"
    number = parse_float(f"rtrim(replace({t}, ',', ''), '%')")
    return f"CASE WHEN {t} IN {X.YES_NO} THEN 'yes_no' WHEN ({number}) IS NOT NULL THEN 'numeric' ELSE 'text' END"


def task_type(x: str) -> str:
    q = f"lower({x})"
    return f"""CASE WHEN {_starts(q, X.YES_NO_PREFIXES)} THEN 'yes_no' WHEN {_has(q, X.ARITHMETIC)} THEN 'arithmetic'
  WHEN {_has(q, X.EXTREMA)} THEN 'global_extrema' WHEN {_has(q, X.VALUE)} THEN 'value_extraction' WHEN {_has(q, X.CHART)} THEN 'chart_reasoning' END"""


def plot_task_type(x: str) -> str:
    q = f"lower({x})"
    return f"""CASE WHEN {_starts(q, X.YES_NO_PREFIXES)} THEN 'yes_no' WHEN {_has(q, X.PLOT_ARITHMETIC)} THEN 'arithmetic'
  WHEN {_has(q, X.EXTREMA)} THEN 'global_extrema' WHEN {_has(q, X.PLOT_LABEL)} THEN 'chart_reasoning'
  WHEN {_starts(q, X.PLOT_VALUE_PREFIXES)} THEN 'value_extraction' ELSE {task_type(x)} END"""


def answer_mode(question: str, kind: str, task: str) -> str:
    return f"CASE WHEN {kind} IN {X.FIXED_TYPES} THEN 'fixed_vocabulary' WHEN {task} = 'arithmetic' THEN 'computed_oov' WHEN {_has(f'lower({question})', X.EXTREMA)} THEN 'computed_or_extractive' ELSE 'extractive_or_count' END"


def scorer_mode(kind: str, task: str) -> str:
    return f"CASE WHEN {kind} IN {X.FIXED_TYPES} THEN 'fixed_vocabulary' WHEN {task} = 'arithmetic' THEN 'computed_oov' ELSE 'extractive_or_count' END"


def tag_value(x: str, tag: str) -> str:
    return f"nullif({strip(f"regexp_extract({x}, '(?is)<{tag}>(.*?)</{tag}>', 1)")}, '')"


def validation_error(x: str, tags=V.STAGE1_TAGS) -> str:
    missing = "list_filter([" + ", ".join(f"CASE WHEN {tag_value(x, t)} IS NULL THEN '{t}' END" for t in tags) + "], lambda t: t IS NOT NULL)"
    return f"CASE WHEN {x} IS NULL OR {x} = '' THEN 'empty response' WHEN len({missing}) > 0 THEN 'missing or empty XML tags: ' || array_to_string({missing}, ', ') END"


def normalize_vote(x: str) -> str:
    return rf"regexp_replace(lower({strip(x)}), '\s+', ' ', 'g')"


def numbers(x: str) -> str:
    return rf"regexp_extract_all({x}, '\b\d+(?:\.\d+)?\b')"


def lint(text: str, question: str, answer: str) -> str:
    extract = tag_value(text, "extract")
    q = f"lower({question})"
    extra = f"list_filter({numbers(extract)}, lambda n: NOT list_contains({numbers(f"concat({question}, ' ', {answer})")}, n))"
    allowed = f"CASE WHEN {_has(q, V.COUNT_TERMS)} THEN 1 WHEN {_has(q, V.CHANGE_TERMS)} THEN 2 ELSE 1 END"
    words = rf"len(regexp_extract_all({extract}, '\S+'))"
    many = f"CASE WHEN len({extra}) > {allowed} THEN '{V.EXTRA_NUMBERS[0]}' || array_to_string({extra}, ', ') || '{V.EXTRA_NUMBERS[1]}' END"
    broad = f"CASE WHEN {_starts(q, V.SIMPLE_PREFIXES)} AND {words} > {V.BROAD_WORDS} THEN '{V.TOO_BROAD}' END"
    return f"CASE WHEN {extract} IS NULL THEN NULL ELSE nullif(concat_ws(' ', {many}, {broad}), '') END"
