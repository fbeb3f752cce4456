"""Quality rules: a threshold table compiled into Spark projections; no user functions, no shuffle.

Words are runs of anything but ASCII white space. Each text becomes a few
numbers (lengths, symbols, stop words, repeated lines and word windows) by
array functions in linear or sorting time, and the table of rules becomes one
boolean expression over them.

A null or empty text has no words and fails the base rules. Rows are judged one
by one, so ties, repeated rows, null ids and further columns change nothing; columns that
are called like a measure are carried as they are. A very long text is judged
whole, by array functions over its words. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsewright.llm.rows import pack, unpack

# Frequent function words of the supported languages.
STOP_WORDS = {
    "en": "the of and to in is that for it as was with be by on this are from or have an they which at not but his he you".split(),
    "fr": "de la le et les des en un une du est que dans qui par pour au sur pas ne se plus avec ce il".split(),
    "de": "der die und den von das mit sich des auf für ist im dem nicht ein eine als auch es an wie zu".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o".split(),
}
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """`value` (a SQL expression over the measures) must lie within [least, most]."""

    name: str
    value: str
    least: float | None = None
    most: float | None = None


#: What every text must meet first.
BASE = (Rule("n_words", "n_words", least=50), Rule("repeat_share", "100 * n_repeat_words - 50 * n_words", most=0))
RULES = (
    Rule("mean_word_chars", "word_chars / n_words", least=2, most=15),
    Rule("symbol_share", "n_symbols / n_words", most=0.1),
    Rule("stop_word_share", "n_stop_words / n_words", least=0.04),
    Rule("dup_line_share", "n_dup_lines / n_lines", most=0.45),
)


def compiled(rules: tuple[Rule, ...]) -> Column:
    """Names of the rules that a row breaks; a share of nothing breaks its rule."""
    broken = []
    for r in rules:
        top, _, below = r.value.partition(" / ")
        value = F.try_divide(F.expr(top), F.expr(below)) if below else F.expr(top)
        bad = F.lit(False)
        if r.least is not None:
            bad = bad | (value < r.least)
        if r.most is not None:
            bad = bad | (value > r.most)
        broken.append(F.when(F.coalesce(bad, F.lit(True)), F.lit(r.name)))
    return F.array_compact(F.array(*broken))


_SPACE = r"[\x20\x09-\x0D]+"


def measures(docs: DataFrame) -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and n_stop_words."""
    stops = sorted({w for ws in STOP_WORDS.values() for w in ws})
    bare = F.col("_text")
    for s in SYMBOLS:
        bare = F.replace(bare, F.lit(s), F.lit(""))
    df = docs.withColumn("_text", F.coalesce("text", F.lit("")))
    df = df.withColumns({
        "_words": F.filter(F.split("_text", _SPACE), lambda w: w != ""),
        "_lines": F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        "n_symbols": (F.length("_text") - F.length(bare)).cast("long"),
    })
    n = F.size("_words")
    df = df.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_stop_words": F.size(F.filter("_words", lambda w: F.rtrim(F.lower(w), F.lit(".,;:!?")).isin(stops))).cast("long"),
        "_grams": F.when(n >= 3, F.slice(F.transform("_words", lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2))), F.lit(1), n - 2)),
    })
    df = df.withColumn("_sorted", F.array_sort(F.transform("_grams", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    same = lambda x, j: F.get("_sorted", j)["h"].eqNullSafe(x["h"])
    df = df.withColumn("_at", F.array_sort(F.transform(F.filter("_sorted", lambda x, j: same(x, j + 1) | ((j > 0) & same(x, F.greatest(j - 1, F.lit(0))))), lambda x: x["i"])))
    cover = F.transform("_at", lambda x, j: F.least(F.lit(3), F.coalesce(F.get("_at", j + 1), x + 3) - x))
    df = df.withColumn("n_repeat_words", F.coalesce(F.aggregate(cover, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"))
    return df.drop("_text", "_words", "_lines", "_grams", "_sorted", "_at")


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`docs` with the measures, base_failed, broken (names of broken rules) and kept."""
    df = measures(docs).withColumns({"base_failed": F.size(compiled(BASE)) > 0, "broken": compiled(rules)})
    return df.withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))


def digest(docs: DataFrame) -> DataFrame:
    return judge(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of `docs` that break no rule; columns as they were."""
    return unpack(judge(pack(docs), rules).filter("kept"), docs.columns)


_STOPS_SQL = ", ".join(f"'{w}'" for w in sorted({w for ws in STOP_WORDS.values() for w in ws}))
ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS ls FROM d
), g AS (SELECT doc_id, p, ws[p] || ' ' || ws[p + 1] || ' ' || ws[p + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS p FROM w)),
r AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS k FROM g),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS p FROM r WHERE k > 1) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    len(ls) AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(ws, lambda x: rtrim(lower(x), '.,;:!?') IN ({_STOPS_SQL}))) AS n_stop_words
  FROM w LEFT JOIN rep USING (doc_id)
), b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(word_chars / n_words BETWEEN 2 AND 15 AND n_symbols / n_words <= 0.1 AND n_stop_words / n_words >= 0.04 AND n_dup_lines / n_lines <= 0.45, false) AS kept
FROM b
"""
