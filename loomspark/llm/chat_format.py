r"""Chat formatting with a grammar round trip; DataFrame functions only.

A conversation is rendered by the grammar::

    conversation = turn*
    turn         = "### " role ": " text "</turn>" "\n"

In a role or text ``\`` before a control string (``###``, ``</turn>``, in a role ``: `` too) or before another ``\`` stands for what
follows; any other ``\`` stands for itself. A bare control string ends the role or text. The parser is one regular expression
anchored where the turn before ended, with possessive loops alone, so it never backtracks and needs no stack.

A turn is rendered as it is, parsed, and compared with its source; where they differ it is rendered with ``\`` before the
control strings, and where that still differs with ``\`` doubled as well. So texts are escaped as little as their round trip
allows (``level`` 0, 1 or 2). That happens before turns meet, row by row; only the source and its level are shuffled.
Conversations are then put together, parsed as a whole and compared with all their turns once more; one that would not come
back is an error, never a row.

The loss mask has a span for each turn of a ``loss_role``: turn number, start and length in code points of the turn's
rendered text, within which the escaped text lies.

Defined results: turns ascend by turn (nulls first), ties by role and then text, so rows that repeat are turns that repeat; a null role
or text is empty; rows without a conv_id are one conversation, whose id is null; an empty table gives no rows; other columns of
the input are not taken along, whatever their names. A conversation is a row, so the text of one is bounded by what a row may
hold (2 GB); texts of any length below that are parsed in linear time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: The template: what opens a turn, what parts role and text, what ends a turn, and what makes a control string literal.
OPEN, COLON, CLOSE, ESCAPE = "### ", ": ", "</turn>", "\\"
_TEXT_CONTROLS = r"###|</turn>"
_ROLE_CONTROLS = r"###|</turn>|: "
_LITERALS = r"[^\\<#]++|<(?!/turn>)|#(?!##)"
_ROLE_LITERALS = r"[^\\<#:]++|<(?!/turn>)|#(?!##)|:(?! )"
_ROLE = rf"((?:{_ROLE_LITERALS}|\\(?:\\|{_ROLE_CONTROLS})?)*+)"
_TEXT = rf"((?:{_LITERALS}|\\(?:\\|{_TEXT_CONTROLS})?)*+)"
#: One turn, from where the one before ended.
TURN = rf"\G### {_ROLE}: {_TEXT}</turn>\n"


def escaped(text: Column, level: Column, controls: str) -> Column:
    """``text`` with as many escapes as ``level`` has: none, before control strings, before these and every backslash."""
    before = lambda what: F.regexp_replace(text, f"({what})", r"\\$1")
    return F.when(level == 0, text).when(level == 1, before(controls)).otherwise(before(rf"\\|{controls}"))


def unescaped(text: Column, controls: str) -> Column:
    return F.regexp_replace(text, rf"\\(\\|{controls})", "$1")


def rendered(role: Column, text: Column, level: Column) -> Column:
    return F.concat(F.lit(OPEN), escaped(role, level, _ROLE_CONTROLS), F.lit(COLON), escaped(text, level, _TEXT_CONTROLS), F.lit(f"{CLOSE}\n"))


def _found(formatted: Column, group: int) -> Column:
    return F.regexp_extract_all(formatted, F.lit(TURN), F.lit(group))


def parsed(formatted: Column) -> Column:
    """The turns (role, text, piece) of a rendered conversation; what they don't cover shows by the pieces, which then don't make up the whole."""
    roles = F.transform(_found(formatted, 1), lambda x: unescaped(x, _ROLE_CONTROLS))
    texts = F.transform(_found(formatted, 2), lambda x: unescaped(x, _TEXT_CONTROLS))
    return F.arrays_zip(roles.alias("role"), texts.alias("text"), _found(formatted, 0).alias("piece"))


def _comes_back(role: Column, text: Column, level: int) -> Column:
    """The rendered turn is one turn for the parser, with this role and text."""
    line = rendered(role, text, F.lit(level))
    is_one = (F.regexp_extract(line, TURN, 0) == line)
    return is_one & (unescaped(F.regexp_extract(line, TURN, 1), _ROLE_CONTROLS) == role) & (unescaped(F.regexp_extract(line, TURN, 2), _TEXT_CONTROLS) == text)


def levels(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (nulls empty) and level: the least escaping with which the turn comes back."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"))
    level = F.when(_comes_back(F.col("role"), F.col("text"), 0), 0).when(_comes_back(F.col("role"), F.col("text"), 1), 1).otherwise(2)
    return rows.withColumn("level", level.cast("tinyint"))


def formatted(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """A row for each conversation: conv_id, formatted (its text) and loss (the mask's spans: turn, start, length)."""
    rows = levels(turns).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "level"))).alias("source"))
    whole = F.array_join(F.transform("source", lambda t: rendered(t["role"], t["text"], t["level"])), "")
    span = lambda t, i: F.when(
        t["role"] == loss_role,
        F.struct(
            i.cast("int").alias("turn"),
            (F.char_length(escaped(t["role"], t["level"], _ROLE_CONTROLS)) + len(OPEN) + len(COLON)).alias("start"),
            F.char_length(escaped(t["text"], t["level"], _TEXT_CONTROLS)).alias("length"),
        ),
    )
    loss = F.filter(F.transform("source", span), lambda x: x.isNotNull())
    out = rows.select("conv_id", "source", whole.alias("formatted"), loss.alias("loss")).withColumn("back", parsed(F.col("formatted")))
    same = (
        (F.transform("back", lambda x: F.struct(x["role"], x["text"])) == F.transform("source", lambda x: F.struct(x["role"], x["text"])))
        & (F.array_join(F.transform("back", lambda x: x["piece"]), "") == F.col("formatted"))
    )
    checked = F.when(same, F.col("formatted")).otherwise(F.raise_error(F.concat(F.lit("conversation does not come back: "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))))
    return out.select("conv_id", checked.alias("formatted"), "loss")


def read_back(chats: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (role, text, piece) as the parser finds them, and loss_text: what the mask's spans hold, unescaped."""
    under = F.transform("loss", lambda s: unescaped(F.substring(F.get(F.col("turns"), s["turn"])["piece"], s["start"] + 1, s["length"]), _TEXT_CONTROLS))
    return chats.withColumn("turns", parsed(F.col("formatted"))).withColumn("loss_text", F.array_join(under, ""))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "\\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    out = read_back(formatted(chats.unionByName(more)))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


_DUCK_LEVEL = r"""CASE WHEN regexp_matches(text, '\\(\\|###|</turn>|$)') OR regexp_matches(role, '\\(\\|###|</turn>|: |$)') THEN 2 WHEN regexp_matches(text, '###|</turn>') OR regexp_matches(role, '###|</turn>|: ') THEN 1 ELSE 0 END"""
OP13_SQL = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
l AS (SELECT *, {_DUCK_LEVEL} AS level FROM c),
r AS (SELECT *, length(CASE level WHEN 0 THEN role WHEN 1 THEN regexp_replace(role, '(###|</turn>|: )', '\\\1', 'g') ELSE regexp_replace(role, '(\\|###|</turn>|: )', '\\\1', 'g') END)
  + length(CASE level WHEN 0 THEN text WHEN 1 THEN regexp_replace(text, '(###|</turn>)', '\\\1', 'g') ELSE regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g') END) + 14 AS chars FROM l)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM r GROUP BY conv_id
"""
