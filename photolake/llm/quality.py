"""Quality rules: a table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_columns, whole_row

WHITE = " \t\n\x0b\x0c\r"
#: Very frequent words of English, German, French and Spanish.
STOP_WORDS = (
    "the be to of and that have it with for is was on by in a this are from as an "
    "der die das und ist mit von für im den des dem ein eine nicht zu auf als sich auch "
    "le la les de et des est dans une un pour que qui sur par pas du au avec ou "
    "el los las en y una por con para del se no es al lo su"
).split()
SYMBOLS = "#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """A ratio of two counts that must lie between ``low`` and ``high`` in texts of at least ``words`` words."""

    name: str
    part: str
    whole: str
    low: float | None = None
    high: float | None = None
    words: int = 1


#: The production table. The counts are columns of ``measure``.
RULES = (
    Rule("word_length", "word_chars", "n_words", low=2.5, high=15.0),
    Rule("symbols", "n_symbols", "n_words", high=0.1),
    Rule("exclamations", "n_exclamations", "n_words", high=0.5),
    Rule("stop_words", "n_stop_words", "n_words", low=0.02, words=50),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=0.4),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(WHITE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def repeat_words(words: Column) -> Column:
    """Words that lie in a window of five which the text holds twice or more.

    Windows are compared by a 64-bit hash of their five words. Texts without a repeated one, nearly all, stop at
    the distinct count; else the sorted hashes bring equal windows together, in n log n steps.
    """
    at = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(places, k + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def of_sorted(pairs: Column) -> Column:
        same = lambda e, k: F.coalesce(e["h"] == F.get(pairs, k)["h"], F.lit(False))
        again = F.filter(pairs, lambda e, k: same(e, k - 1) | same(e, k + 1))
        return let(F.sort_array(F.transform(again, lambda e: e["i"])), covered)

    def of_hashes(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(pairs, of_sorted))

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), at)
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(let(hashes, of_hashes))


def measure(docs: DataFrame, *also: Column) -> DataFrame:
    """Counts of each document's whole text (null: no words), beside ``doc_id``, ``text`` and what else is named."""
    text = F.coalesce("text", F.lit(""))
    without = lambda chars: F.length(F.translate(text, chars, ""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")

    def counts(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
            repeat_words(words).cast("long").alias("n_repeat_words"),
        )

    by_line = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    found = docs.select(
        "doc_id",
        "text",
        F.struct(F.lit(0).alias("_"), *also).alias("_also"),
        let(words_of(text), counts).alias("_words"),
        by_line.alias("_lines"),
        (F.length(text) - without(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))).cast("long").alias("n_exclamations"),
    )
    return found.select("doc_id", "text", "_also.*", "_words.*", "_lines.*", "n_symbols", "n_exclamations").drop("_")


def verdict(rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Whether the base rules fail a text, and the names of the table's rules that it breaks, comma-joined."""
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))

    def broken(rule: Rule) -> Column:
        ratio = F.try_divide(F.col(rule.part), F.col(rule.whole))
        out = F.lit(False)
        if rule.low is not None:
            out = out | (ratio < rule.low)
        if rule.high is not None:
            out = out | (ratio > rule.high)
        return F.when(F.coalesce(out, F.lit(False)) & (F.col("n_words") >= rule.words), rule.name)

    return base, F.concat_ws(",", *[broken(x) for x in rules])


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *also: Column) -> DataFrame:
    """``doc_id, text``, the counts, ``base_failed``, ``failed`` (names of broken rules) and ``kept``.

    One projection over the scan: no shuffle, no user function. Null or empty text: no words, so base_failed.
    Very long texts: judged whole. A value that equals a threshold passes. Null ids, repeated rows: kept as rows. Other
    columns aren't read. Empty table: no rows.
    """
    base, failed = verdict(rules)
    judged = measure(docs, *also).withColumns({"base_failed": base, "failed": failed})
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("failed") == ""))


def kept_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs``, all their columns, that the rules keep.

    Null or empty text: too few words, so it goes. Very long texts: judged whole. Null ids and repeated rows: each
    is judged by itself. Columns whose names clash with inner ones are kept as they are. Empty table: no rows.
    """
    return apply_rules(docs, rules, whole_row(docs)).where("kept").select(*row_columns(docs))


#: The same in DuckDB's SQL, on the view ``documents``.
SQL = f"""
WITH w AS (
  SELECT doc_id, rid, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words, coalesce(text, '') AS text
  FROM (SELECT *, row_number() OVER () AS rid FROM documents)
),
grams AS (
  SELECT rid, i, array_to_string(list_slice(words, i, i + {WINDOW - 1}), ' ') AS g
  FROM (SELECT rid, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w WHERE len(words) >= {WINDOW})
),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM grams) WHERE n > 1),
covered AS (
  SELECT rid, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS n_repeat_words
  FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM again) GROUP BY rid
),
lines AS (
  SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM w
),
counts AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines,
    len(list_filter(words, lambda x: lower(x) IN ({", ".join(f"'{x}'" for x in dict.fromkeys(STOP_WORDS))})))::BIGINT AS n_stop_words,
    (length(text) - length(replace(text, '!', '')))::BIGINT AS n_exclamations
  FROM w JOIN lines USING (rid) LEFT JOIN covered USING (rid)
),
judged AS (
  SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed, concat_ws(',', {{broken}}) AS failed FROM counts
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed = '' AS kept, failed FROM judged
"""


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    def broken(rule: Rule) -> str:
        ratio = f"{rule.part}::DOUBLE / nullif({rule.whole}, 0)"
        out = [f"{ratio} < {rule.low}"] * (rule.low is not None) + [f"{ratio} > {rule.high}"] * (rule.high is not None)
        return f"CASE WHEN ({' OR '.join(out)}) AND n_words >= {rule.words} THEN '{rule.name}' END"

    return SQL.replace("{broken}", ", ".join(map(broken, rules)))
