"""Secret scans: fixed patterns, and character Markov models of random strings and ordinary ones.

All is written with built-in functions: patterns cut a text into matches and the parts between them, whose lengths
give the places; the log-likelihood ratio of two bigram models is a sum over a table that was counted by Spark.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_columns, whole_row, written
from .quality import let

#: Fixed patterns of the base kinds, in the order in which ties are listed.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")
LEAST_VALUE = 6
#: What the models judge: long runs without white space or punctuation.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Documents from which the models are trained, at most: those whose hashed ids are smallest.
TRAINING_DOCUMENTS = 2000
#: Part of the documents that is held out of the counts and sets the threshold: one in so many.
HELD_OUT = 4
#: The threshold lies half way between the ratio that this share of the ordinary held-out strings exceeds and the one that
#: this share of the random ones stays below.
ORDINARY_ABOVE, RANDOM_BELOW = 0.001, 0.01
#: Weight of a pair's class (capital, small letter, digit, sign) beside the pair itself, for pairs that were seldom seen.
BACKOFF = 0.3
#: Shape of identifiers that are public by their format, and runs of one character; both are left out of what is judged.
UUID = r"(?i)(?<![0-9a-z])[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}(?![0-9a-z])"
RUN = r"(.)\1{3,}"
LEAST_LENGTH = 20
MARK = "<secret>"


@dataclass(frozen=True)
class Models:
    """The log-likelihood ratio of each pair of characters, random over ordinary, by place in ``ALPHABET``, and the mean
    ratio from which a string counts as random."""

    table: list[float]
    threshold: float


def labelled_samples(docs: DataFrame, most: int = TRAINING_DOCUMENTS) -> DataFrame:
    """``random``, ``held`` (booleans), ``sample``: strings labelled by their origin, from a bounded number of documents.

    Ordinary: the words of these documents' texts, but for what the base patterns find, and what people make of words:
    names in several writings, paths, names with dates and numbers, and numbers. Random: digests of the texts in
    several alphabets, without signs of padding.
    """
    hashed = docs.where("text is not null").select("text", F.xxhash64("doc_id", "text").alias("_h"))
    last = hashed.select("_h").distinct().orderBy("_h").limit(most).agg(F.max("_h").alias("h")).first()["h"]
    chosen = hashed.where(F.col("_h") <= F.lit(last)).dropDuplicates(["_h"])  # only hashes were sorted, no texts
    held = (F.pmod("_h", F.lit(HELD_OUT)) == 0).alias("held")
    plain = F.regexp_replace("text", f"{ASSIGN}|{ACCESS}|{HEX}", " ")
    words = F.regexp_extract_all(plain, F.lit(r"[A-Za-z]{2,}"), F.lit(0))
    digest = F.sha2(F.col("text").cast("binary"), 512)
    numbers = F.translate(digest, "abcdef", "012345")
    rows = chosen.select(held, words.alias("words"), digest.alias("digest"), numbers.alias("numbers"))

    def made(at: Column) -> Column:
        four = F.transform(F.slice("words", at + 1, 4), lambda w: F.lower(w))
        tall = F.concat_ws("", F.transform(four, lambda w: F.initcap(w)))
        number = F.substring("numbers", at % 100 + 1, F.lit(8))
        camel = F.concat(F.lower(F.substring(tall, 1, 1)), F.substring(tall, F.lit(2), F.length(tall)))
        return F.array(
            F.array_join(four, "_"), F.array_join(four, "-"), F.upper(F.array_join(four, "_")), F.concat(F.lit("/"), F.array_join(four, "/")), tall, camel, F.array_join(four, ""), F.concat_ws("_", F.slice(four, 1, 2), number),
            F.concat(F.get(four, 0), F.substring(number, 1, 2), F.lit("/"), F.get(four, 1), F.lit("-"), F.substring(number, 3, 4), F.lit("-"), F.substring(number, 5, 2)),
        )

    places = F.when(F.size("words") >= 4, F.sequence(F.lit(0), F.size("words") - 4, F.lit(4))).otherwise(F.array().cast("array<int>"))
    ordinary = F.concat("words", F.flatten(F.transform(places, made)), F.array("numbers"))
    sixty_four = F.rtrim(F.base64(F.unhex("digest")), F.lit("="))
    letters = F.translate(sixty_four, "+/", "")
    drawn = F.array(sixty_four, F.translate(sixty_four, "+/", "-_"), letters, F.lower(letters), F.translate(F.upper(letters), "0189", "2345"), F.upper("digest"), F.substring("digest", 1, 23))
    both = rows.select("held", F.explode(F.array(F.struct(F.lit(False).alias("random"), ordinary.alias("samples")), F.struct(F.lit(True).alias("random"), drawn.alias("samples")))).alias("s"))
    return both.select("s.random", "held", F.explode("s.samples").alias("sample"))


def kind_of(c: str) -> int:
    return 0 if c.isupper() else 1 if c.islower() else 2 if c.isdigit() else 3


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio of each pair of characters, random over ordinary, by place in ``ALPHABET``.

    Spark counts the pairs; the two models have one number for each pair of the alphabet, so what reaches the driver
    is bounded. A pair's own share of what follows its first character is mixed with the share of its classes, spread
    evenly inside them. An empty sample gives equal odds.
    """
    size = len(ALPHABET)
    pairs = samples.select("random", F.explode(F.transform(F.sequence(F.lit(1), F.length("sample") - 1), lambda i: F.substring("sample", i, F.lit(2)))).alias("pair"))
    counted = pairs.groupBy("random", "pair").count().where((F.length("pair") == 2) & (F.length(F.translate("pair", ALPHABET, "")) == 0))
    counts = {True: [0.5] * size * size, False: [0.5] * size * size}
    for row in counted.collect():
        counts[row["random"]][ALPHABET.index(row["pair"][0]) * size + ALPHABET.index(row["pair"][1])] += row["count"]
    kinds = [kind_of(c) for c in ALPHABET]

    def logs(own: list[float]) -> list[float]:
        sums = [sum(own[i * size : (i + 1) * size]) for i in range(size)]
        classes = [[0.0] * 4 for _ in range(4)]
        for k, n in enumerate(own):
            classes[kinds[k // size]][kinds[k % size]] += n
        share = lambda a, b: classes[a][b] / sum(classes[a]) / kinds.count(b)
        return [math.log((1 - BACKOFF) * n / sums[k // size] + BACKOFF * share(kinds[k // size], kinds[k % size])) for k, n in enumerate(own)]

    return [round(a - b, 6) for a, b in zip(logs(counts[True]), logs(counts[False]), strict=True)]


def fit(docs: DataFrame) -> Models:
    """Both models, counted on the samples that aren't held out, and the threshold, from those that are.

    It lies half way between nearly all ordinary ones and nearly all random ones, and is 0 at least.
    """
    samples = written(labelled_samples(docs), "secret-samples")
    table = train(samples.where("NOT held"))
    judged = samples.where("held").select("random", F.regexp_replace("sample", RUN, "$1$1").alias("s")).where(F.length("s") >= LEAST_LENGTH).select("random", ratio(F.col("s"), table).alias("r"))
    ends = judged.groupBy("random").agg(F.percentile_approx("r", F.lit(RANDOM_BELOW), 10_000).alias("low"), F.percentile_approx("r", F.lit(1 - ORDINARY_ABOVE), 10_000).alias("high"))
    found = {r.random: r for r in ends.collect()}  # two rows
    plain = found[False].high if False in found else 0.0
    return Models(table, max(0.0, (plain + max(plain, found[True].low)) / 2 if True in found else plain))


def ratio(string: Column, table: list[float]) -> Column:
    """Mean log-likelihood ratio a character pair of a string over ``ALPHABET``; -1 for one of a single character."""
    weights = F.from_json(F.lit(json.dumps(table)), "array<double>")
    places = F.transform(F.split(string, "(?!^)"), lambda c: F.instr(F.lit(ALPHABET), c) - 1)

    def mean(at: Column) -> Column:
        pairs = F.sequence(F.lit(1), F.size(at) - 1)
        total = F.aggregate(pairs, F.lit(0.0), lambda a, i: a + F.get(weights, F.get(at, i - 1) * len(ALPHABET) + F.get(at, i)))
        return total / (F.size(at) - 1)

    return F.when(F.length(string) > 1, let(places, mean)).otherwise(F.lit(-1.0))


def is_random(found: Column, models: Models) -> Column:
    """Whether a string counts as random. Identifiers of public shape and all but two of a run of one character are left
    out first; what is too short then isn't."""
    core = F.regexp_replace(F.regexp_replace(found, UUID, ""), RUN, "$1$1")
    return let(core, lambda c: (F.length(c) >= LEAST_LENGTH) & (ratio(c, models.table) > models.threshold))


def matches(text: Column, pattern: str, kind: int) -> Column:
    """All matches of a pattern, leftmost and apart: array of ``at, to, kind, found`` in code points."""
    none = F.array().cast("array<struct<at:int,to:int,kind:int,found:string>>")

    def placed(both: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            at = acc["at"] + F.length(F.get(both["between"], i))
            to = at + F.length(F.get(both["found"], i))
            here = F.struct(at.alias("at"), to.alias("to"), F.lit(kind).alias("kind"), F.get(both["found"], i).alias("found"))
            return F.struct(to.alias("at"), F.concat(acc["out"], F.array(here)).alias("out"))

        start = F.struct(F.lit(0).alias("at"), none.alias("out"))
        return F.when(F.size(both["found"]) == 0, none).otherwise(F.aggregate(F.sequence(F.lit(0), F.size(both["found"]) - 1), start, step, lambda acc: acc["out"]))

    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("between"))
    return F.when(text.rlike(pattern), let(parts, placed)).otherwise(none)


def scan(docs: DataFrame, models: Models | None = None, *also: Column) -> DataFrame:
    """``doc_id, text, base, added``: the secrets of each whole text as arrays of ``at, to, kind, found``.

    ``base`` holds what the patterns find, ``added`` what only the models find, which never touches a base span; they
    judge strings of 20 characters or more (``CANDIDATE``). Base spans of two kinds may overlap; both stay. The
    models are trained first unless they are given. Null or empty text: no spans. Very long texts are scanned whole.
    Null ids and repeated rows: rows of their own. Empty table: no rows. No shuffle but for the models' counts.
    """
    models = fit(docs) if models is None else models
    text = F.coalesce("text", F.lit(""))
    assign = F.filter(matches(text, ASSIGN, 0), lambda m: F.length(F.regexp_extract(m["found"], ASSIGN, 2)) >= LEAST_VALUE)
    fixed = docs.select("doc_id", text.alias("text"), *also, F.array_sort(F.concat(assign, matches(text, ACCESS, 1), matches(text, HEX, 2))).alias("base"))
    maybe = F.filter(matches(F.col("text"), CANDIDATE, 3), lambda m: is_random(m["found"], models))
    apart = lambda m: ~F.exists("base", lambda b: (b["at"] < m["to"]) & (m["at"] < b["to"]))
    return fixed.withColumn("added", F.filter(maybe, apart))


def listed(spans: Column) -> Column:
    """kind:start:end of spans, by start and then by kind, comma-joined."""
    names = F.array(*[F.lit(x) for x in KINDS])
    ordered = F.sort_array(F.transform(spans, lambda m: F.struct(m["at"], m["kind"], m["to"])))
    return F.array_join(F.transform(ordered, lambda m: F.concat_ws(":", F.get(names, m["kind"]), m["at"].cast("string"), m["to"].cast("string"))), ",")


def redacted() -> Column:
    """The text of a scanned row with each run of overlapping spans replaced by a mark."""
    spans = F.sort_array(F.transform(F.concat("base", "added"), lambda m: F.struct(m["at"].alias("at"), m["to"].alias("to"))))

    def step(acc: Column, m: Column) -> Column:
        gap = F.substring("text", acc["to"] + 1, m["at"] - acc["to"])
        out = F.when(m["at"] < acc["to"], acc["out"]).otherwise(F.concat(acc["out"], gap, F.lit(MARK)))
        return F.struct(F.greatest(acc["to"], m["to"]).alias("to"), out.alias("out"))

    start = F.struct(F.lit(0).alias("to"), F.lit("").alias("out"))
    ended = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring("text", acc["to"] + 1, F.length("text"))))
    return F.when(F.size(spans) == 0, F.col("text")).otherwise(ended)


def without_secrets(docs: DataFrame, models: Models | None = None) -> DataFrame:
    """The rows of ``docs``, all their columns, with secrets in ``text`` replaced by a mark.

    Null text: stays null. Empty and very long texts: as any other. Null ids and repeated rows: rows of their own.
    Columns whose names clash with inner ones are kept as they are. Empty table: no rows.
    """
    scanned = scan(docs, models, whole_row(docs))
    return scanned.select(*row_columns(docs, text=F.when(F.col("_doc.text").isNotNull(), redacted())))
