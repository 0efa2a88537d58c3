"""Stable keys and hash draws."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill.functions.text import first_truthy

KEY_VERSION = "sft-record-key-v1"
#: The fields of a record key in the order of their names.
KEY_FIELDS = ("answer", "answer_type", "dataset", "image_sha256", "input", "sample_id_fallback", "split", "task_type", "version")


def _or_empty(c: Column | str | None) -> Column:
    if c is None:
        return F.lit("")
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


#: Characters that aren't shown as they are in a list: all but printable ones and the space.
_HIDDEN = r"[\p{C}\p{Zl}\p{Zp}\p{Zs}&&[^ ]]"


def quoted(text: Column) -> Column:
    """The literal form of a text in a list: single quotes, double ones where the text
    has single quotes only, escapes for what isn't printable; ``None`` for null."""
    double = text.contains("'") & ~text.contains('"')
    body = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c, e in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        body = F.replace(body, F.lit(c), F.lit(e))

    def hidden(c: Column) -> Column:
        h = F.lower(F.hex(F.encode(c, "UTF-32")))
        short = F.when(h.startswith("000000"), F.concat(F.lit("\\x"), F.substring(h, 7, 2))).when(h.startswith("0000"), F.concat(F.lit("\\u"), F.substring(h, 5, 4)))
        return F.when(c.rlike(_HIDDEN), F.coalesce(short, F.concat(F.lit("\\U"), h))).otherwise(c)

    parts = F.transform(F.regexp_extract_all(body, F.lit(rf"(?s){_HIDDEN}|(?:(?!{_HIDDEN}).)+"), F.lit(0)), hidden)
    body = F.when(body.rlike(_HIDDEN), F.array_join(parts, "")).otherwise(body)
    single = F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(text.isNull(), F.lit("None")).when(double, F.concat(F.lit('"'), body, F.lit('"'))).otherwise(single)


def short_id(*parts: Column) -> Column:
    """Twelve hex digits of the SHA-1 of a text, or of several in their list form."""
    text = parts[0] if len(parts) == 1 else F.concat(F.lit("["), F.concat_ws(", ", *map(quoted, parts)), F.lit("]"))
    return F.substring(F.sha1(text.cast("binary")), 1, 12)


def ascii_json(json: Column) -> Column:
    """JSON with every character beyond ASCII written as ``\\uXXXX``, in two halves
    beyond the first 65,536."""
    units = lambda c: F.lower(F.hex(F.encode(c, "UTF-16BE")))
    halves = lambda h: F.concat(F.lit("\\u"), F.substring(h, 1, 4), F.when(F.length(h) > 4, F.concat(F.lit("\\u"), F.substring(h, 5, 4))).otherwise(""))
    escaped = F.transform(F.regexp_extract_all(json, F.lit(r"(?s)[\x00-\x7f]+|[^\x00-\x7f]"), F.lit(0)), lambda c: F.when(c.rlike(r"[^\x00-\x7f]"), halves(units(c))).otherwise(c))
    return F.when(json.rlike(r"[^\x00-\x7f]"), F.array_join(escaped, "")).otherwise(json)


def record_key(*, dataset, split, image_sha256=None, input_text=None, answer=None, answer_type=None, task_type=None, sample_id=None, ascii_only: bool = False) -> Column:
    """SHA-256 of compact JSON with sorted keys; the sample id counts only where the
    image's hash or the input is missing.  ``ascii_only`` escapes what isn't ASCII, which
    gives the keys of records that other writers made so."""
    image, text = _or_empty(image_sha256), _or_empty(input_text)
    fallback = F.when((image == "") | (text == ""), F.lit(None) if sample_id is None else F.col(sample_id) if isinstance(sample_id, str) else sample_id).otherwise("")
    values = dict(
        zip(
            KEY_FIELDS,
            (_or_empty(answer), _or_empty(answer_type), _or_empty(dataset), image, text, fallback, _or_empty(split), _or_empty(task_type), F.lit(KEY_VERSION)),
            strict=True,
        )
    )
    payload = F.to_json(F.struct(*(v.cast("string").alias(k) for k, v in values.items())), {"ignoreNullFields": "false"})
    return F.sha2(ascii_json(payload) if ascii_only else payload, 256)


def recovered_key(record: str = "record", metadata: str = "metadata") -> Column:
    """The key a record has, in itself or its metadata, else the key its fields give.

    ``record`` and ``metadata`` are columns of type map<string,string>."""
    r = lambda k: F.element_at(F.col(record), k)
    m = lambda k: F.element_at(F.col(metadata), k)
    made = record_key(
        dataset=first_truthy(m("dataset"), r("dataset")),
        split=first_truthy(m("split"), r("split")),
        image_sha256=m("image_sha256"),
        input_text=first_truthy(r("input"), r("question")),
        answer=first_truthy(m("answer"), r("answer")),
        answer_type=first_truthy(m("answer_type"), r("answer_type")),
        task_type=first_truthy(m("task_type"), r("task_type")),
        sample_id=first_truthy(m("sample_id"), r("sample_id")),
    )
    return F.coalesce(first_truthy(r("record_key"), m("record_key")), made)


def _seeded(value: Column, seed: int | None) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed or 0}:"), value), 256)


def hash_fraction(key: Column, seed: int | None) -> Column:
    """The first 64 bits of a seeded SHA-256 as a fraction of the largest such number."""
    return F.conv(F.substring(_seeded(key, seed), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(2**64 - 1))


def hash_draw(key: Column, rate: float, seed: int | None) -> Column:
    """True for a share ``rate`` of all keys: never up to 0 or where the rate isn't
    finite, always from 1 on."""
    if rate != rate or rate in (float("inf"), float("-inf")) or rate <= 0:
        return F.lit(False)
    if rate >= 1:
        return F.lit(True)
    return hash_fraction(key, seed) < F.lit(float(rate))


def stable_index(value: Column, seed: int | None, size: Column) -> Column:
    """A number below ``size`` from the first 32 bits of a seeded SHA-256."""
    return F.conv(F.substring(_seeded(value, seed), 1, 8), 16, 10).cast("long") % size


def draw_key(record_key_: Column, dataset: Column, sample_id: Column) -> Column:
    """What a sample is drawn by: its record key, else dataset and sample id."""
    missing = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    return F.coalesce(F.nullif(record_key_, F.lit("")), F.concat(missing(dataset), F.lit(":"), missing(sample_id)))
