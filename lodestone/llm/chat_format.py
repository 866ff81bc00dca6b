"""Conversations as training texts, by relational expressions alone.

Turn structs are collected and sorted, adjacent turns of one role are merged with array
aggregation, and the messages are concatenated with role markers. One shuffle on conv_id; no
user function; the work on a conversation is linear in its turns.

Defined results: null conv_id: row ignored. Null or blank text (nothing but spaces, tabs and line ends): turn ignored; a conversation
without other turns has no row. Null turn numbers come last; ties are ordered by role, then text. Null or blank
role: 'unknown'; roles are trimmed and in lower case, and each run of signs but letters, digits, '_', '-', '.' and spaces in them is written
'_'. Repeated rows count once. A marker's start '<|' inside a text is written '< |'. So neither texts nor roles can forge markers.
An empty table gives an empty result. Texts of any length are kept whole. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


BLANK, SOLID, UNSAFE = r"[ \t\n\f\r]", r"[^ \t\n\f\r]", r"[^\p{L}\p{N}_. -]+"


def _merge(turns: Column) -> Column:
    """Sorted turns as messages: structs of role and the texts of adjacent turns, joined by line ends."""
    at = F.sequence(F.lit(0), F.size(turns) - 1)
    begin = F.filter(at, lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"]))
    end = F.concat(F.slice(begin, F.lit(2), F.size(begin)), F.array(F.size(turns)))
    return F.zip_with(begin, end, lambda b, e: F.struct(F.get(turns, b)["role"].alias("role"), F.array_join(F.transform(F.slice(turns, b + 1, e - b), lambda t: t["text"]), "\n").alias("content")))


def chat_format(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, n_turns, n_messages, roles, text, n_chars), one row a conversation."""
    trimmed = F.regexp_replace(F.lower(F.col(f"`{role_col}`").cast("string")), rf"^{BLANK}+|{BLANK}+$", "")
    role = F.coalesce(F.nullif(F.regexp_replace(trimmed, UNSAFE, "_"), F.lit("")), F.lit("unknown"))
    turn = F.col(f"`{turn_col}`").cast("long")
    rows = df.select(
        F.col(f"`{conv_col}`").cast("long").alias("conv_id"),
        F.struct(turn.isNull().alias("no"), turn.alias("turn"), role.alias("role"), F.replace(F.col(f"`{text_col}`").cast("string"), F.lit("<|"), F.lit("< |")).alias("text")).alias("t"),
    ).where(F.col("conv_id").isNotNull() & F.col("t.text").rlike(SOLID))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_set("t")).alias("turns"))
    messages = turns.select("conv_id", F.size("turns").alias("n_turns"), _merge(F.col("turns")).alias("m"))
    text = F.array_join(F.transform("m", lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), m["content"], F.lit("<|end|>\n"))), "")
    out = messages.select("conv_id", "n_turns", F.size("m").alias("n_messages"), F.array_join("m.role", ",").alias("roles"), text.alias("text"))
    return out.withColumn("n_chars", F.length("text"))


ORACLE = f"""
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(nullif(regexp_replace(regexp_replace(lower(role), '^{BLANK}+|{BLANK}+$', '', 'g'), '{UNSAFE}', '_', 'g'), ''), 'unknown') AS role, replace(text, '<|', '< |') AS text
  FROM conversations WHERE conv_id IS NOT NULL AND regexp_matches(text, '{SOLID}')
), o AS (
  SELECT *, row_number() OVER w AS n, lag(role) OVER w IS DISTINCT FROM role AS fresh
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY (turn IS NULL), turn, role, text)
), g AS (
  SELECT *, sum(fresh::INT) OVER (PARTITION BY conv_id ORDER BY n) AS message FROM o
), m AS (
  SELECT conv_id, message, any_value(role) AS role, count(*) AS turns, string_agg(text, chr(10) ORDER BY n) AS content
  FROM g GROUP BY conv_id, message
), c AS (
  SELECT conv_id, sum(turns)::INT AS n_turns, count(*)::INT AS n_messages, string_agg(role, ',' ORDER BY message) AS roles,
         string_agg('<|' || role || '|>' || chr(10) || content || '<|end|>' || chr(10), '' ORDER BY message) AS text
  FROM m GROUP BY conv_id
)
SELECT conv_id, n_turns, n_messages, roles, text, length(text)::INT AS n_chars FROM c
"""
