"""Quality rules: counts of a text, and the divergence of its letters and common words from those of known languages.

DataFrame operations only.  References are histograms over the whole corpus:
shares of character classes for each language of the corpus that has enough
documents, and shares of each common word and of all others for those that have a
list of common words here.  A document is held against every reference, and its distance is the least Jensen-Shannon distance
(square root of the divergence, base 2, 0 to 1).  Against common words the limit
is set for each language from the distance of a text without any of them.  What
there is no reference for is no fault of a document: one whose language has none
is not held against others, nor is one in a script that no reference is written in.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import SPACE_RUN, SPACES, Scratch, load, words

#: The most common function words of each language, in small letters.
COMMON = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "en": "the of and to in a is that for it on was with be as by at this are from".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur au plus il".split(),
}
SYMBOLS = "#*$%&|<>"
MARKS = SYMBOLS + ".,;:!?'\"()[]{}-_=+/\\^~`@"
#: Documents of fewer words than these are not held against the histogram: too little to tell.
MIN_WORDS_FOR_CLASSES = 40
MIN_WORDS_FOR_COMMON = 60
#: Documents of those sizes that a language needs for a reference of its character classes.
MIN_DOCUMENTS = 20
#: Share of a text's characters in words that are letters outside ASCII, above which it is in another script; likewise a reference.
OTHER_SCRIPT = 0.5
#: Distances above which a document is unlike all languages.
MAX_CLASS_DISTANCE = 0.20
MAX_COMMON_DISTANCE = 0.60
#: Share of the distance that a text without common words has from a language, which is itself out of the limit above
#: where they are a quarter of all words (0.38): beyond this share a document is unlike the language too.
MAX_OF_WORDLESS = 0.875
#: Character classes, each by the characters that make it up; all others are "rest".
CLASSES = {
    "small": "abcdefghijklmnopqrstuvwxyz",
    "large": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": "0123456789",
    "space": SPACES,
    "stop": ".,;:?'\"()-",
    "shout": "!",
    "symbol": SYMBOLS + "@_=+/\\^~`{}[]",
}


def _without(text: Column, characters: str) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, characters, ""))


def text_counts(docs: DataFrame) -> DataFrame:
    """doc_id, h, lang and the counts of each text; null counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", "lang", F.xxhash64("text").alias("h"), text.alias("text"))
    base = base.withColumn("ws", words(F.col("text")))
    windows = F.expr("CASE WHEN size(ws) >= 5 THEN slice(transform(ws, (x, i) -> xxhash64(x, get(ws, i + 1), get(ws, i + 2), get(ws, i + 3), get(ws, i + 4))), 1, size(ws) - 4) ELSE array() END")
    lines = F.expr(r"filter(split(text, '\n', -1), x -> length(btrim(x, ' \t\n\u000B\f\r')) > 0)")
    base = base.withColumn("grams", windows).withColumn("lines", lines)
    # places of windows that occur again, in order: neighbours in a sort by hash
    base = base.withColumn(
        "sorted",
        F.expr("CASE WHEN size(array_distinct(grams)) < size(grams) THEN array_sort(transform(grams, (x, i) -> struct(x AS x, i AS i))) END"),
    )
    again = "array_sort(transform(filter(sorted, (s, j) -> s.x <=> get(sorted, j - 1).x OR s.x <=> get(sorted, j + 1).x), s -> s.i))"
    base = base.withColumn("places", F.expr(f"CASE WHEN sorted IS NOT NULL THEN {again} END"))
    covered = F.expr("CASE WHEN places IS NULL THEN 0L ELSE aggregate(transform(places, (p, j) -> CAST(CASE WHEN j = 0 THEN 5 ELSE least(5, p - get(places, j - 1)) END AS BIGINT)), 0L, (s, v) -> s + v) END")
    # small letters, then spaces, are taken out by runs; what is left, a tenth as a rule, is looked at by each class
    base = base.withColumn("no_small", F.regexp_replace("text", "[a-z]+", "")).withColumn("rest", F.regexp_replace("no_small", SPACE_RUN, ""))
    whole = F.char_length("text")
    classes = {name: _without(F.col("rest"), chars) for name, chars in CLASSES.items()}
    classes["small"], classes["space"] = whole - F.char_length("no_small"), F.char_length("no_small") - F.char_length("rest")
    out = base.select(
        "doc_id",
        "h",
        "lang",
        F.size("ws").cast("long").alias("n_words"),
        whole.cast("long").alias("n_chars_"),
        *(c.cast("long").alias(f"c_{name}") for name, c in classes.items()),
        _without(F.col("rest"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.col("rest").alias("rest_"),
    )
    rest = F.col("n_chars_") - reduce(lambda a, b: a + b, (F.col(f"c_{n}") for n in CLASSES))
    out = out.withColumn("c_rest", rest).withColumn("word_chars", F.col("n_chars_") - F.col("c_space")).drop("n_chars_")
    foreign = F.col("c_rest") > OTHER_SCRIPT * F.col("word_chars")  # few texts, whose letters are worth a pattern
    letters = F.regexp_count(F.col("rest_"), F.lit(r"[\p{L}\p{M}&&[^\x00-\x7F]]"))
    return out.withColumn("other_script", F.when(foreign, letters > OTHER_SCRIPT * F.col("word_chars")).otherwise(F.lit(False))).drop("rest_")


def common_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, h, lang, word, n): how often each common word of any language is in a text, marks around it aside."""
    every = sorted({w for ws in COMMON.values() for w in ws})
    ws = words(F.lower(F.col("text")))
    each = docs.select("doc_id", F.xxhash64("text").alias("h"), "lang", F.explode(ws).alias("w"))
    each = each.select("doc_id", "h", "lang", F.btrim("w", F.lit(MARKS)).alias("word")).filter(F.col("word").isin(every))
    return each.groupBy("doc_id", "h", "lang", "word").agg(F.count(F.lit(1)).alias("n"))


def _term(p: Column, q: Column) -> Column:
    """What one bin adds to the divergence."""
    m = (p + q) / 2
    return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) / 2 + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0) / 2


def _distance(divergence: Column) -> Column:
    return F.sqrt(F.greatest(divergence, F.lit(0.0)))


def _histogram_distance(shares: Column, reference: list[float]) -> Column:
    terms = F.zip_with(shares, F.array(*map(F.lit, reference)), _term)
    return _distance(F.aggregate(terms, F.lit(0.0), lambda a, b: a + b))


def _least(distances: list[Column]) -> Column:
    return F.least(*distances) if len(distances) > 1 else distances[0] if distances else F.lit(0.0)


def class_references(counts: DataFrame) -> dict[str, list[float]]:
    """Shares of the classes in each language of the corpus: medians over its documents, which unlike means a share of odd ones doesn't move."""
    shares = [F.percentile_approx(F.col("shares")[i], 0.5, 1000).alias(f"s{i}") for i in range(len(CLASSES) + 1)]
    usable = F.col("lang").isNotNull() & (F.col("n_words") >= MIN_WORDS_FOR_CLASSES)
    rows = counts.filter(usable).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), *shares).filter((F.col("n") >= MIN_DOCUMENTS) | F.col("lang").isin(list(COMMON)))
    out = {}
    for r in rows.collect():  # a row for each language of the corpus
        if sum(r[2:]):
            out[r["lang"]] = [float(x) / sum(r[2:]) for x in r[2:]]
    return dict(sorted(out.items()))


def common_references(counts: DataFrame, common: DataFrame) -> dict[str, dict[str, float]]:
    """Shares of the common words among all words of each language."""
    known = F.col("lang").isin(list(COMMON))
    every = {r["lang"]: r["n"] for r in counts.filter(known).groupBy("lang").agg(F.sum("n_words").alias("n")).collect()}
    out: dict[str, dict[str, float]] = {}
    for r in common.filter(known).groupBy("lang", "word").agg(F.sum("n").alias("n")).collect():  # words of COMMON in languages of COMMON
        if r["word"] in COMMON[r["lang"]] and every.get(r["lang"]):
            out.setdefault(r["lang"], {})[r["word"]] = r["n"] / every[r["lang"]]
    return dict(sorted(out.items()))


def common_limit(reference: dict[str, float]) -> float:
    """The distance from a language's common words above which a text is unlike it."""
    rest = 1 - sum(reference.values())
    middle = (1 + rest) / 2
    divergence = (1 - rest) / 2 - math.log2(middle) / 2 + (rest * math.log2(rest / middle) / 2 if rest > 0 else 0.0)
    return min(MAX_COMMON_DISTANCE, MAX_OF_WORDLESS * math.sqrt(divergence))


def judge(docs: DataFrame) -> DataFrame:
    """The counts of every document with class_distance, common_distance, base_failed and kept.

    Without words a document fails the base rule; null text counts as empty, a
    null lang adds to no reference and is held against all.  A language that no
    row has gives no reference, and without any reference nothing is rejected by
    divergence; nor is a document whose lang has no reference of that kind, or
    that is in a script of which there is none.
    Repeated rows are judged alike.  Columns other than doc_id, text and lang
    are not read.
    """
    docs = docs.select("doc_id", "text", "lang")
    scratch = Scratch(docs.sparkSession)
    bins = [f"c_{b}" for b in (*CLASSES, "rest")]
    size = reduce(lambda a, b: a + b, map(F.col, bins))
    shares = F.when(size > 0, F.array(*((F.col(b) / size) for b in bins)))
    counts = scratch.save(text_counts(docs).withColumn("shares", shares).drop(*bins))
    common = scratch.save(common_counts(docs))
    letters, spoken = class_references(counts), common_references(counts, common)
    judged = counts.withColumn("class_distance", F.when(F.col("shares").isNotNull(), _least([_histogram_distance(F.col("shares"), r) for r in letters.values()])))
    # a common word adds its term; the reference's words that a text lacks add half their share each
    sums = []
    for lang, own in spoken.items():
        q = F.create_map(*(F.lit(x) for w in sorted(own) for x in (w, own[w])))[F.col("word")]
        sums += [F.sum(F.when(q.isNotNull(), _term(F.col("p"), q) - q / 2)).alias(f"d_{lang}"), F.sum(F.when(q.isNotNull(), F.col("p"))).alias(f"p_{lang}")]
    if sums:
        same = F.col("doc_id").eqNullSafe(F.col("d_")) & (F.col("h") == F.col("h_"))
        rows = counts.groupBy("doc_id", "h").agg((F.count(F.lit(1)) * F.first("n_words")).alias("all_"))  # equal rows are counted together
        heard = common.groupBy(F.col("doc_id").alias("d_"), F.col("h").alias("h_"), "word").agg(F.sum("n").alias("n"))
        summed = heard.join(rows, same).withColumn("p", F.col("n") / F.col("all_")).groupBy("d_", "h_").agg(*sums)
        judged = judged.join(summed, same, "left")
    distances = []
    for lang, own in spoken.items():
        listed, heard_ = F.coalesce(F.col(f"p_{lang}"), F.lit(0.0)), sum(own.values())
        distances.append(_distance(F.coalesce(F.col(f"d_{lang}"), F.lit(0.0)) + heard_ / 2 + _term(1 - listed, F.lit(1 - heard_))))
    judged = judged.withColumn("common_distance", F.when(F.col("n_words") > 0, _least(distances)))
    known = [d <= common_limit(own) for d, own in zip(distances, spoken.values(), strict=True)]
    common_like = reduce(lambda a, b: a | b, known) if known else F.lit(True)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    solid, last = list(CLASSES).index("space"), len(CLASSES)
    written = any(r[last] > OTHER_SCRIPT * (1 - r[solid]) for r in letters.values())  # some language of the corpus is in such a script
    foreign = F.col("other_script") & F.lit(not written)
    unknown = lambda known: F.col("lang").isNotNull() & ~F.col("lang").isin(list(known))
    like_letters = (F.col("n_words") < MIN_WORDS_FOR_CLASSES) | (F.col("class_distance") <= MAX_CLASS_DISTANCE) | foreign | unknown(letters)
    like = like_letters & ((F.col("n_words") < MIN_WORDS_FOR_COMMON) | common_like | F.col("other_script") | unknown(spoken))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "common_distance"]
    return judged.select(*names, failed.alias("base_failed"), (~failed & F.coalesce(like, F.lit(True))).alias("kept"))


def op5_quality_rules(spark, sf_dir):
    judged = judge(load(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "common_distance")
