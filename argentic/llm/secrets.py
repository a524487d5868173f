"""Secret scans over a trigram index, in DataFrame operations only.

From each rule's regular expression follows a Boolean query of trigrams that any
match must contain (_trigrams.py).  The index has a posting for each trigram of
these queries, as bits of the row that the text is in: bit i of a document is
set if trigram i occurs in it, so postings are intersected by bitwise AND where
the text is, without a shuffle.  Candidates are verified with the expression; a
rule without a mandatory trigram scans every text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import load
from ._trigrams import trigram_query, trigrams

BITS = 62


@dataclass(frozen=True)
class Rule:
    """A kind of secret.  Matches are leftmost and don't overlap; those whose ``group`` has fewer than ``least`` characters are dropped after."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


#: The base rules, then public formats of credentials.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    # a run of one character class is matched whole or not at all, so its least length can stand in the pattern
    Rule("access", r"AKIA[A-Z0-9]{16,}", base=True),
    Rule("hex", r"[0-9a-f]{24,}", base=True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)


def vocabulary(rules) -> list[str]:
    return sorted(set().union(*(trigrams(trigram_query(r.pattern)) for r in rules)))


def postings(text: Column, grams: list[str]) -> Column:
    """Which of the trigrams occur in the text, as an array of bit sets."""
    low = F.lower(text)
    sets = []
    for at in range(0, max(len(grams), 1), BITS):
        bits = [F.when(F.contains(low, F.lit(g)), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, g in enumerate(grams[at : at + BITS])]
        sets.append(reduce(lambda a, b: a.bitwiseOR(b), bits, F.lit(0).cast("long")))
    return F.array(*sets)


def _holds(query, at: dict[str, int]) -> Column:
    """The query over the column ``grams``."""
    if query is True:
        return F.lit(True)
    if isinstance(query, str):
        return F.col("grams")[at[query] // BITS].bitwiseAND(F.lit(1 << at[query] % BITS)) != 0
    parts = [_holds(q, at) for q in query[1:]]
    return reduce(lambda a, b: a & b if query[0] == "and" else a | b, parts)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _starts(parts: Column) -> Column:
    """Starts of matches from (gap, size, ...) in turn: running totals in blocks of the root of their number, so that many matches in a long text stay far from a square."""

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0), lambda s, e: s + e["gap"] + e["size"])

    def blocks(x: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(x))).cast("int")
        each = lambda b: _let(
            total(F.slice(x, F.lit(1), b * width)),
            lambda base: F.transform(F.slice(x, b * width + 1, width), lambda e, j: base + total(F.slice(x, b * width + 1, j)) + e["gap"]),
        )
        return F.flatten(F.transform(F.sequence(F.lit(0), F.ceil(F.size(x) / width).cast("int") - 1), each))

    return _let(parts, blocks)


def _matches(rule: Rule, rank: int, query) -> Column:
    """(start, rank, end) of the rule's matches in ``text``, if the query holds."""
    nothing = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    text, pattern = F.col("text"), F.lit(rule.pattern)
    found, kept = F.regexp_extract_all(text, pattern, F.lit(0)), F.regexp_extract_all(text, pattern, F.lit(rule.group))

    def spans(hits: Column) -> Column:
        gaps = F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(hits))
        parts = F.zip_with(gaps, hits, lambda g, m: F.struct(F.char_length(g).alias("gap"), F.char_length(m).alias("size")))
        placed = F.zip_with(_starts(parts), hits, lambda s, m: F.struct(s.alias("start"), F.lit(rank).alias("rank"), (s + F.char_length(m)).alias("end")))
        if not rule.least:
            return placed
        long_ = F.zip_with(placed, kept, lambda p, k: F.when(F.char_length(k) >= rule.least, p))
        return F.filter(long_, lambda p: p.isNotNull())

    return F.when(query, _let(found, lambda hits: F.when(F.size(hits) > 0, spans(hits)).otherwise(nothing))).otherwise(nothing)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans): an array of (start, rank, end), in code points, by start and then by the rank of the rule.

    Null texts count as empty and have no spans; repeated rows are scanned each.
    Columns other than doc_id and text are not read.
    """
    grams = vocabulary(rules)
    at = {g: i for i, g in enumerate(grams)}
    table = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    table = table.withColumn("grams", postings(F.col("text"), grams))
    each = [_matches(r, i, _holds(trigram_query(r.pattern), at)) for i, r in enumerate(rules)]
    return table.select("doc_id", F.array_sort(F.concat(*each)).alias("spans"))


def _listed(spans: Column, rules) -> Column:
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    name = lambda x: F.concat_ws(":", F.get(kinds, x["rank"]), x["start"].cast("string"), x["end"].cast("string"))
    return F.array_join(F.transform(spans, name), ",")


def digest(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, n_<base kind>..., base_sha256, spans) of scan(); the base rules come first."""
    n = sum(r.base for r in rules)
    found = scan(docs, rules)

    def of(rank: int) -> Column:
        return F.filter("spans", lambda x: x["rank"] == rank)

    counts = [F.size(of(i)).cast("long").alias(f"n_{r.kind}") for i, r in enumerate(rules) if r.base]
    base = _listed(F.filter("spans", lambda x: x["rank"] < n), rules)
    return found.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans"), rules).alias("spans"))


def op7_secrets(spark, sf_dir):
    return digest(load(spark, sf_dir, "documents"))


def _oracle() -> str:
    parts = []
    for i, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        parts.append(
            f"SELECT doc_id, {i} AS rank, '{r.kind}' AS kind, k, string_split_regex(t, '{p}') AS gaps, regexp_extract_all(t, '{p}', 0) AS hits, "
            f"regexp_extract_all(t, '{p}', {r.group}) AS kept, {r.least} AS least FROM (SELECT doc_id, t, unnest(generate_series(1, len(regexp_extract_all(t, '{p}', 0)))) AS k FROM d)"
        )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(parts)}),
s AS (
  SELECT doc_id, rank, kind, length(hits[k]) AS size,
    coalesce(list_sum(list_transform(gaps[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(hits[1:k - 1], lambda x: length(x))), 0) AS start
  FROM m WHERE length(kept[k]) >= least
), j AS (
  SELECT doc_id, kind || ':' || start::BIGINT || ':' || (start + size)::BIGINT AS name, start, rank FROM s
), g AS (
  SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
    string_agg(name, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg(name, ',' ORDER BY start, rank) AS spans
  FROM j GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""


ORACLE = _oracle()
