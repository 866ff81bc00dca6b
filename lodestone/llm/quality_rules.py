"""Quality rules: a table of thresholds compiled into one Spark projection.

``RULES`` has a row for each rule: the metric and the range in which it must lie. Metrics are
length, symbol, stop-word, repetition and line ratios, all built-in expressions; the same table makes the
equivalent SQL. No shuffle, no user function; one pass.

Two rules depend on length, as documented here: stop words and repeated words are held against documents of ``STOP_FROM`` words or more only,
since a few words may well hold no stop word; and distinct words are put in relation to ``DISTINCT_OF`` words at most, since in a
longer text words recur anyway. No document is too long.

Defined results: null text counts as empty. An empty or wordless text has all ratios 0 and fails the
length rule. A null or unknown language is held against the stop words of all languages. Each row is
judged by itself, so repeated rows all stay or all go, and a row whose id is null is judged too. Other
columns are passed on by ``keep_good``, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

SYMBOLS = "#$%&*|{}<>~^=\\"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÄÆÇÈÉÊËÍÎÏÑÓÔÖŒÙÚÛÜ"
MARKS = ",.;:!?\"()[]"
STOP = {
    "en": "the of and to in is that for it was on are as with be at by this from or an a not have but".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le".split(),
}


@dataclass(frozen=True)
class Rule:
    name: str
    metric: str
    low: float
    high: float


#: A document is kept if every metric is within its range.
RULES = [
    Rule("length", "n_words", 3, math.inf),
    Rule("word_length", "mean_word_length", 2.0, 14.0),
    Rule("symbols", "symbols_per_word", 0.0, 0.1),
    Rule("capitals", "capital_ratio", 0.0, 0.5),
    Rule("stop_words", "stop_word_ratio", 0.02, 1.0),
    Rule("repeated_words", "distinct_word_ratio", 0.3, 1.0),
    Rule("repeated_lines", "repeated_line_ratio", 0.0, 0.35),
    Rule("bullets", "bullet_line_ratio", 0.0, 0.9),
    Rule("ellipses", "ellipsis_line_ratio", 0.0, 0.3),
]
#: Documents of fewer words aren't held against stop words and repeated words.
STOP_FROM = 20
#: Words of longer documents recur anyway: their number counts as this at most when distinct words are put in relation to it.
DISTINCT_OF = 1000


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, F.round(a.cast("double") / b.cast("double"), 6)).otherwise(F.lit(0.0))


def _count(text: Column, chars: str) -> Column:
    """How many characters of the text are among these: a scan for a character class, far cheaper than translate()."""
    return F.regexp_count(text, F.lit("[" + "".join("\\" + c if c in "[]\\^-&" else c for c in chars) + "]"))


def counts(text: Column, lang: Column) -> Column:
    """What the metrics are made of, each taken from the text once: a struct."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    flat = t
    for c in "\t\n\r":
        flat = F.replace(flat, F.lit(c), F.lit(" "))
    words = F.split(F.regexp_replace(F.lower(flat), r"[,.;:!?\"()\[\]]", ""), " ")

    def among(known: list[str]) -> Column:
        return F.size(F.filter(words, lambda w: w.isin(known)))

    stops = among(sorted({w for s in STOP.values() for w in s}))
    for code, known in reversed(STOP.items()):
        stops = F.when(lang == code, among(known)).otherwise(stops)
    return F.struct(
        F.size(F.filter(F.split(flat, " "), lambda w: w != "")).alias("n_words"),
        F.length(F.replace(flat, F.lit(" "), F.lit(""))).alias("solid"),
        _count(t, SYMBOLS).alias("symbols"),
        _count(t, UPPER).alias("capitals"),
        stops.alias("stops"),
        F.size(F.array_remove(F.array_distinct(words), "")).alias("distinct"),
        F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), lambda x: x != "").alias("lines"),
    )


def metrics(c: Column) -> dict[str, Column]:
    """Each metric as a built-in expression over the counts."""
    n, lines = c["n_words"], c["lines"]
    return {
        "n_words": n,
        "mean_word_length": _ratio(c["solid"], n),
        "symbols_per_word": _ratio(c["symbols"], n),
        "capital_ratio": _ratio(c["capitals"], c["solid"]),
        "stop_word_ratio": _ratio(c["stops"], n),
        "distinct_word_ratio": F.least(_ratio(c["distinct"], F.least(n, F.lit(DISTINCT_OF))), F.lit(1.0)),
        "repeated_line_ratio": _ratio(F.size(lines) - F.size(F.array_distinct(lines)), F.size(lines)),
        "bullet_line_ratio": _ratio(F.size(F.filter(lines, lambda x: F.substring(x, 1, 1).isin("-", "*", "•"))), F.size(lines)),
        "ellipsis_line_ratio": _ratio(F.size(F.filter(lines, lambda x: x.endswith("...") | x.endswith("…"))), F.size(lines)),
    }


def _passes(rule: Rule, m: dict[str, Column]) -> Column:
    ok = m[rule.metric] >= rule.low
    if rule.high < math.inf:
        ok = ok & (m[rule.metric] <= rule.high)
    return ok | (m["n_words"] < STOP_FROM) if rule.name in ("stop_words", "repeated_words") else ok


def _counted(df: DataFrame, text_col: str, lang_col: str, keep: list[Column]) -> tuple[DataFrame, str]:
    """df's columns with the counts. They pass through a generator of one row, past which the optimizer moves no
    filter; so they are taken once a document, not once a rule."""
    name = "counts"
    while name in df.columns:
        name = f"_{name}"
    return df.select(*keep, F.explode(F.array(counts(F.col(f"`{text_col}`"), F.col(f"`{lang_col}`")))).alias(name)), name


def verdicts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rules: list[Rule] = RULES) -> DataFrame:
    """(doc_id, all metrics, failed): the names of the rules that each document fails, '' if it is kept."""
    made, name = _counted(df, text_col, lang_col, [F.col(f"`{id_col}`").alias("doc_id")])
    made = made.select("doc_id", *[c.alias(k) for k, c in metrics(F.col(name)).items()])
    m = {k: F.col(k) for k in made.columns[1:]}
    return made.withColumn("failed", F.concat_ws(",", *[F.when(~_passes(r, m), F.lit(r.name)) for r in rules]))


def keep_good(df: DataFrame, text_col: str = "text", lang_col: str = "lang", rules: list[Rule] = RULES) -> DataFrame:
    """The rows of df that pass all rules, with their columns as they are."""
    made, name = _counted(df, text_col, lang_col, [F.col(f"`{c}`") for c in df.columns])
    m, keep = metrics(F.col(name)), F.lit(True)
    for r in rules:
        keep = keep & _passes(r, m)
    return made.where(keep).drop(name)


def _sql() -> str:
    def q(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def ratio(a: str, b: str) -> str:
        return f"CASE WHEN {b} > 0 THEN round(({a})::DOUBLE / ({b})::DOUBLE, 6) ELSE 0.0 END"

    def count(chars: str) -> str:
        return f"length(t) - length(translate(t, {q(chars)}, ''))"

    def stops(known: list[str]) -> str:
        return f"len(list_filter(words, lambda w: w IN ({', '.join(map(q, known))})))"

    stop = "CASE " + " ".join(f"WHEN lang = '{k}' THEN {stops(s)}" for k, s in STOP.items()) + f" ELSE {stops(sorted({w for s in STOP.values() for w in s}))} END"
    blank = r"[ \t\n\r]+"
    fails = ", ".join(f"CASE WHEN NOT ({r.metric} >= {r.low}" + (f" AND {r.metric} <= {r.high}" if r.high < math.inf else "") + (f" OR n_words < {STOP_FROM}" if r.name in ("stop_words", "repeated_words") else "") + f") THEN '{r.name}' END" for r in RULES)
    return f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
s AS (SELECT *, list_filter(regexp_split_to_array(translate(lower(t), {q(MARKS)}, ''), '{blank}'), lambda w: w <> '') AS words,
  len(list_filter(regexp_split_to_array(t, '{blank}'), lambda w: w <> ''))::INT AS n_words,
  list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines,
  length(translate(t, ' ' || chr(9) || chr(10) || chr(13), '')) AS solid FROM d),
m AS (SELECT doc_id, n_words, {ratio("solid", "n_words")} AS mean_word_length, {ratio(count(SYMBOLS), "n_words")} AS symbols_per_word,
  {ratio(count(UPPER), "solid")} AS capital_ratio, {ratio(stop, "n_words")} AS stop_word_ratio,
  least({ratio("len(list_distinct(words))", f"least(n_words, {DISTINCT_OF})")}, 1.0) AS distinct_word_ratio,
  {ratio("len(lines) - len(list_distinct(lines))", "len(lines)")} AS repeated_line_ratio,
  {ratio("len(list_filter(lines, lambda x: x[1:1] IN ('-', '*', '•')))", "len(lines)")} AS bullet_line_ratio,
  {ratio("len(list_filter(lines, lambda x: x LIKE '%...' OR x LIKE '%…'))", "len(lines)")} AS ellipsis_line_ratio FROM s),
f AS (SELECT *, concat_ws(',', {fails}) AS failed FROM m)
SELECT * FROM f WHERE failed = ''
"""


ORACLE = _sql()
