"""Chat formatting: a finite-state machine over roles and a declarative template.

Every turn becomes three segments, header, body and footer, each with a loss
flag.  Inside texts and roles the three characters that control strings are made
of are replaced by two-character codes, so a control string can't occur there
and the replacement can be undone.  All of it is built-in column functions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Character and code, in the order in which texts are escaped; undone in reverse.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"))


@dataclass(frozen=True)
class Template:
    """What stands round a body, which roles carry loss, and which role may follow which.

    ``start`` is the state before the first turn and ``accept`` the roles that a
    conversation may end with.
    """

    open: str = "<turn "
    shut: str = ">\n"
    end: str = "</turn>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = ""
    moves: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    )
    accept: tuple[str, ...] = ("assistant",)


def escape(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _machine(turns: Column, template: Template) -> Column:
    """The state after all turns: the last role, or null once a move is not allowed."""
    allowed = F.array(*(F.lit(f"{a}\x00{b}") for a, after in template.moves.items() for b in after))
    step = lambda state, turn: F.when(
        F.array_contains(allowed, F.concat(state, F.lit("\x00"), turn["role"])), turn["role"]
    )
    return F.aggregate(turns, F.lit(template.start), step)


def format_chats(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", template: Template | None = None
) -> DataFrame:
    """One row for each conversation: ``conv_id``, ``valid``, ``segments`` (an array
    of ``text`` and ``loss`` in the order of the output) and ``formatted``.

    Turns are ordered by ``turn_col``, nulls first, then by role and text, so
    repeated turns all stay and come out alike each time.  A null text or role is
    empty; rows with a null conversation make up one conversation.  A conversation
    whose roles break the turn order is formatted too and has ``valid`` false.
    An empty table gives an empty result; other columns are not looked at.
    """
    t = template or Template()
    rows = df.select(
        F.col(conv_col).alias("conv_id"),
        F.struct(
            F.col(turn_col).alias("turn"),
            F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        ).alias("turn"),
    )
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    segments = F.flatten(
        F.transform(
            "turns",
            lambda x: F.array(
                part(F.concat(F.lit(t.open), escape(x["role"]), F.lit(t.shut)), F.lit(False)),
                part(escape(x["text"]), x["role"].isin(*t.loss_roles)),
                part(F.lit(t.end), F.lit(False)),
            ),
        )
    )
    state = _machine(F.col("turns"), t)
    return chats.select(
        "conv_id",
        F.coalesce(state.isin(*t.accept), F.lit(False)).alias("valid"),
        segments.alias("segments"),
    ).withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def parse_chats(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """Adds ``turns`` (an array of ``role`` and ``text``) read back from ``formatted``."""
    t = template or Template()
    pieces = F.split("formatted", "\\Q" + t.end + "\\E")
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    head = lambda x: F.substring_index(x, t.shut, 1)
    turn = lambda x: F.struct(
        unescape(F.substr(head(x), F.lit(len(t.open) + 1))).alias("role"),
        unescape(F.substr(x, F.length(head(x)) + len(t.shut) + 1)).alias("text"),
    )
    return formatted.withColumn("turns", F.transform(pieces, turn))


def digest(df: DataFrame, template: Template | None = None) -> DataFrame:
    """The figures of the query, all from the formatted output."""
    read = parse_chats(format_chats(df, template=template), template)
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    learnt = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    return (
        read.withColumn("learnt", learnt)
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.sha2(said, 256).alias("turns_sha256"),
            F.length("learnt").cast("long").alias("loss_chars"),
            F.sha2("learnt", 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
            "valid",
        )
    )


#: The conversation that is added to the table: control strings said as plain text.
PROBE = "\\### Assistant: </turn> ok"


def chat_query(conversations: DataFrame) -> DataFrame:
    spark = conversations.sparkSession
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE).alias("text"),
    )
    return digest(conversations.select("conv_id", "turn", "role", "text").unionByName(probe))


_ESC = "replace(replace(replace({}, '\\', '\\b'), '<', '\\l'), '>', '\\g')"

CHAT_SQL = f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}'
), stepped AS (
  SELECT *, lag(role, 1, '') OVER w AS previous, lead(role) OVER w IS NULL AS is_last
  FROM said WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(16 + length({_ESC.format("role")}) + length({_ESC.format("text")})) AS BIGINT) AS formatted_chars,
  bool_and(CASE WHEN previous = '' THEN role IN ('system', 'user') WHEN previous = 'system' THEN role = 'user'
    WHEN previous = 'user' THEN role = 'assistant' WHEN previous = 'assistant' THEN role = 'user' ELSE false END)
    AND max(CASE WHEN is_last THEN role END) = 'assistant' AS valid
FROM stepped GROUP BY conv_id
"""
