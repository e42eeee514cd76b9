"""Quality rules as a short-circuit cascade (operator 9), in DataFrame functions only.

A rule is a boolean column that is true where it rejects.  On a bounded sample each rule's selectivity (share
of rows rejected) and cost (seconds for the sample) are estimated; the rules then run as one CASE expression in
descending order of rejection per cost, so that a row stops at the first rule that rejects it.  The order moves only
the work: a row is kept when no rule rejects it, whatever the order.

Cases: null text has no words; texts of any length are read whole; repeated rows count each; a rule that is null for a
row does not reject it; an empty table gives an empty result (the rules keep their given order).
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from payscope.llm.common import SPACES, WORD, about, free_name, keep, let, table, text_or_empty

#: Symbols, thresholds and stop words of the rules (fixed values).
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_SYMBOLS_PER_100_WORDS = 50
MAX_DUP_LINE_PERCENT = 60
MAX_WORD_CHARS = 25
MAX_SHOUT_PERCENT = 90
SAMPLE_ROWS = 2000


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column


# -- statistics of a text ---------------------------------------------------------------------------------------

def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def word_chars(text: Column) -> Column:
    return F.length(F.translate(text, SPACES, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line of the text."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACES, "") != "")
    return let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long")


def n_repeat_words(words: Column, width: int = 3) -> Column:
    """Words that lie in a window of ``width`` words found twice or more in the text.

    Windows are compared by a 64-bit hash.  (hash, place) pairs are sorted, so equal windows are neighbours; the
    places of repeated windows, sorted again, give the covered words from the gaps between them.  O(n log n).
    """
    def windows(h):
        at = lambda i: F.struct(F.xxhash64(*[F.get(h, i + k) for k in range(width)]).alias("h"), i.alias("i"))
        return F.sort_array(F.transform(F.sequence(F.lit(0), F.size(h) - width), at))

    def repeated(s):
        same = lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"])
        return F.sort_array(F.transform(F.filter(s, lambda x, j: F.coalesce(same(x, j), F.lit(False))), lambda x: x["i"]))

    def covered(p):
        gaps = F.transform(p, lambda x, j: F.least(F.lit(width), F.coalesce(F.get(p, j + 1) - x, F.lit(width))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    whole = let(hashes, lambda h: let(windows(h), lambda s: let(repeated(s), covered)))
    return F.when(F.size(words) > width, whole).otherwise(F.lit(0).cast("long"))


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; columns of these names are replaced."""
    docs = docs.drop("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    words = free_name(docs.columns, "_words")
    text = text_or_empty(text_col)
    return (docs.withColumn(words, words_of(text))
            .select("*", F.size(words).cast("long").alias("n_words"), word_chars(text).alias("word_chars"),
                    n_symbols(text).alias("n_symbols"), n_dup_lines(text).alias("n_dup_lines"),
                    n_repeat_words(F.col(words)).alias("n_repeat_words")).drop(words))


# -- rules ------------------------------------------------------------------------------------------------------

def base_rules(n_words: Column, n_repeat_words_: Column) -> list[Rule]:
    return [Rule("few_words", n_words < MIN_WORDS),
            Rule("repeated_words", 100 * n_repeat_words_ > MAX_REPEAT_PERCENT * n_words)]


def further_rules(text: Column, n_words: Column, chars: Column, symbols: Column, dup_lines: Column) -> list[Rule]:
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    small = F.length(F.regexp_replace(text, r"[^\p{Ll}\p{Lo}]+", ""))
    n_lines = F.regexp_count(text, F.lit("[^\n]*" + WORD + "[^\n]*"))
    return [Rule("symbols", 100 * symbols > MAX_SYMBOLS_PER_100_WORDS * n_words),
            Rule("long_words", chars > MAX_WORD_CHARS * n_words),
            Rule("duplicate_lines", (dup_lines >= 3) & (100 * dup_lines > MAX_DUP_LINE_PERCENT * n_lines)),
            Rule("no_letters", 2 * letters < chars),
            Rule("shouting", (letters > 0) & (100 * (letters - small) > MAX_SHOUT_PERCENT * letters))]


# -- cascade ----------------------------------------------------------------------------------------------------

def sample_of(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """About ``rows`` rows by row hash (all, if fewer), at most twice as many, written once."""
    key = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    return keep(about(docs, rows, docs.count(), key).limit(2 * rows), "quality-sample")


def cascade_order(sample: DataFrame, rules: list[Rule]) -> list[dict]:
    """The rules in descending rejection per cost, with their figures on ``sample``."""

    def timed(condition: Column) -> tuple[float, float]:
        began = time.perf_counter()
        hits, n = sample.agg(F.count(F.when(condition, 1)), F.count("*")).first()
        return hits / max(n, 1), time.perf_counter() - began

    base = min(timed(F.lit(False))[1] for _ in range(2))
    figures = []
    for i, r in enumerate(rules):
        share, first = timed(r.rejects)
        cost = max(min(first, timed(r.rejects)[1]) - base, 1e-4)
        figures.append({"rule": r, "name": r.name, "selectivity": share, "cost_s": cost, "given": i})
    return sorted(figures, key=lambda f: (-f["selectivity"] / f["cost_s"], f["given"]))


def rejected_by(rules: list[Rule]) -> Column:
    """Name of the first rule that rejects the row, or null; later rules are not evaluated."""
    out = None
    for r in rules:
        out = F.when(r.rejects, r.name) if out is None else out.when(r.rejects, r.name)
    return F.lit(None).cast("string") if out is None else out


def judge(docs: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with the statistics, base_failed, kept and rejected_by."""
    text = text_or_empty(text_col)
    n, chars = F.col("n_words"), F.col("word_chars")
    rows = with_statistics(docs, text_col)
    rules = further_rules(text, n, chars, F.col("n_symbols"), F.col("n_dup_lines"))
    order = [f["rule"] for f in cascade_order(with_statistics(sample_of(docs, sample_rows), text_col), rules)]
    base = base_rules(n, F.col("n_repeat_words"))
    return (rows.withColumn("rejected_by", rejected_by(base + order))
            .withColumn("base_failed", F.col("rejected_by").isin([r.name for r in base]) & F.col("rejected_by").isNotNull())
            .withColumn("kept", F.col("rejected_by").isNull()))


def keep_good(docs: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with their columns.

    Every rule is in the cascade here, the two base rules too, each with its own statistics inside its
    expression, so that a row computes only what the rules before its rejection need.
    """
    text, wish = text_or_empty(text_col), free_name(docs.columns, "_n_words")
    count = F.regexp_count(text, F.lit(WORD)).cast("long")
    n = F.col(wish)
    rules = base_rules(n, n_repeat_words(words_of(text))) + further_rules(text, n, word_chars(text), n_symbols(text), n_dup_lines(text))
    order = [f["rule"] for f in cascade_order(sample_of(docs, sample_rows).withColumn(wish, count), rules)]
    return docs.withColumn(wish, count).where(rejected_by(order).isNull()).drop(wish)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                              "base_failed", "kept")


QUERIES = {"op9_quality_rules": op9_quality_rules}

ORACLE_SQL = {"op9_quality_rules": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
t AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
pos AS (SELECT doc_id, unnest(range(1, greatest(len(w) - 2, 0) + 1)) AS i, w FROM t WHERE len(w) >= 3),
win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM pos),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS c FROM win, range(3) g(k) WHERE n > 1 GROUP BY doc_id),
s AS (SELECT t.doc_id, text, lines, CAST(len(w) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(c, 0) AS BIGINT) AS n_repeat_words,
        length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) AS letters,
        length(regexp_replace(text, '[^\\p{{Ll}}\\p{{Lo}}]', '', 'g')) AS small
      FROM t LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_symbols > {MAX_SYMBOLS_PER_100_WORDS} * n_words OR word_chars > {MAX_WORD_CHARS} * n_words
       OR (n_dup_lines >= 3 AND 100 * n_dup_lines > {MAX_DUP_LINE_PERCENT} * len(lines))
       OR 2 * letters < word_chars OR (letters > 0 AND 100 * (letters - small) > {MAX_SHOUT_PERCENT} * letters)) AS kept
FROM b
"""}
