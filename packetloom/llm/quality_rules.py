"""Quality rules judged per host: rule failures of a domain, shrunk towards all domains.

Counting words, symbols, repeated lines and repeated windows is one projection over whole texts.
Failures are summed by host and rule with partial aggregation, so a host with a large part of all
documents is no group in one task.  Hosts with few documents are judged mostly by the prior, a beta
distribution fitted to all hosts by its moments; a host whose shrunk failure rate passes the limit
loses all its documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.llm.support import materialize, whole_row

WINDOW = 8
FEWEST_WORDS = 20
MOST_REPEATED_PERCENT = 30
# A host goes if more than this share of its documents, after shrinking, breaks one rule.
HOST_LIMIT = 0.5
_SPACE = "[\\x20\\x09-\\x0D]"
_SYMBOLS = "[^#*$%&|<>]"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _covered(hashes: Column) -> Column:
    """Words inside windows whose hash occurs more than once, from the windows' hashes in order."""
    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(rows: Column) -> Column:
        def same(row: Column, at: Column) -> Column:
            before, after = F.get(rows, at - 1)["h"], F.get(rows, at + 1)["h"]
            return F.coalesce(before == row["h"], F.lit(False)) | F.coalesce(after == row["h"], F.lit(False))

        return F.sort_array(F.transform(F.filter(rows, same), lambda row: row["i"]))

    def spanned(starts: Column) -> Column:
        steps = F.transform(starts, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, step: total + step)

    return _let(_let(ordered, repeated), spanned)


def _repeated_words(words: Column) -> Column:
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    runs = _let(
        hashes,
        lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda at: F.xxhash64(F.slice(h, at, WINDOW))),
    )
    found = _let(
        runs, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(_covered(w))
    )
    return F.when(F.size(words) > WINDOW, found).otherwise(F.lit(0).cast("long"))


def rule_counts(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns and the counts of every whole text (NULL: all 0)."""
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, f"{_SPACE}+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    counted = _let(
        words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeated_words(w).alias("n_repeat_words"))
    )
    return docs.select(
        *keep,
        counted.alias("_c"),
        F.length(F.regexp_replace(text, _SPACE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, _SYMBOLS, "")).cast("long").alias("n_symbols"),
        _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        F.size(lines).cast("long").alias("n_lines"),
    ).select(*keep, "_c.n_words", "word_chars", "n_symbols", "n_dup_lines", "_c.n_repeat_words", "n_lines")


def base_failed() -> Column:
    return (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))


#: Failures that are summed by host.
RULES: dict[str, Callable[[], Column]] = {
    "few_words": lambda: F.col("n_words") < FEWEST_WORDS,
    "repetition": lambda: 100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"),
    "symbols": lambda: 10 * F.col("n_symbols") > F.col("n_words"),
    "repeated_lines": lambda: 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
    "word_length": lambda: (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 12 * F.col("n_words")),
}


def host_rates(counts: DataFrame, host: str) -> DataFrame:
    """``host, rule, failures, documents, rate``: failure rates shrunk by a beta prior over all hosts.

    The prior has the mean of all documents, and as strength what the spread of the host rates beyond
    sampling noise allows (moments); without such spread the hosts count as alike.
    """
    named = counts.where(F.col(host).isNotNull())
    sums = [F.sum(rule().cast("long")).alias(name) for name, rule in RULES.items()]
    wide = named.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("documents"), *sums)
    rates = materialize(wide.unpivot(["host", "documents"], list(RULES), "rule", "failures"), "hosts")
    share = F.col("failures") / F.col("documents")
    totals = rates.groupBy("rule").agg(
        (F.sum("failures") / F.sum("documents")).alias("mean"),
        (F.sum(F.col("documents") * share * share) / F.sum("documents")).alias("square"),
        (F.count("*") / F.sum("documents")).alias("hosts_per_document"),
    )
    noise = F.col("mean") * (1 - F.col("mean"))
    spread = F.col("square") - F.col("mean") * F.col("mean") - noise * F.col("hosts_per_document")
    strength = F.when(spread > 1e-9 * noise, F.greatest(noise / spread - 1, F.lit(1.0))).otherwise(F.lit(1e9))
    prior = totals.select("rule", "mean", strength.alias("strength"))
    return rates.join(prior, "rule").select(
        "host", "rule", "failures", "documents",
        ((F.col("failures") + F.col("mean") * F.col("strength")) / (F.col("documents") + F.col("strength"))).alias("rate"),
    )


def judge(docs: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``host_failed`` and ``kept`` of every document.

    NULL and empty texts have no words and fail.  A NULL host is no host: its documents are judged by
    the base rules alone.  Repeated rows are judged each, and count each for their host.  Other columns
    are ignored.  An empty table gives an empty table.
    """
    plain = docs.select(F.col("doc_id"), F.col("text"), F.col(host).alias("host"))
    counts = materialize(rule_counts(plain, "doc_id", "host"), "rule-counts")
    failed = host_rates(counts, "host").where(F.col("rate") > limit).select("host").distinct()
    verdicts = counts.join(failed.withColumn("_bad", F.lit(True)), "host", "left")
    bad = F.coalesce("_bad", F.lit(False))
    return verdicts.select(
        "doc_id", *COUNTS, base_failed().alias("base_failed"), (~base_failed() & ~bad).alias("kept"), bad.alias("host_failed")
    )


def keep_good(docs: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns.

    Texts are counted once: the rows are written with their counts, hosts are judged from the narrow
    columns of that table, and the kept rows are read from it.
    """
    rows = docs.select(whole_row(docs).alias("_row"), "text", F.col(host).alias("host"))
    counts = materialize(rule_counts(rows, "_row", "host"), "rule-rows")
    bad = host_rates(counts, "host").where(F.col("rate") > limit).select("host").distinct()
    return counts.where(~base_failed()).join(bad, "host", "left_anti").select("_row.*")


ORACLE = r"""
WITH texts AS (SELECT doc_id, source AS host, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT doc_id, host, text,
         list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM texts),
runs AS (
  SELECT doc_id, pos, ws[pos:pos + 7] AS run FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS pos FROM words)),
repeated AS (SELECT doc_id, pos FROM runs QUALIFY count(*) OVER (PARTITION BY doc_id, run) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT word) AS n FROM (SELECT doc_id, unnest(range(pos, pos + 8)) AS word FROM repeated) GROUP BY 1),
counts AS (
  SELECT w.doc_id, host, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, len(ls) AS n_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM words w LEFT JOIN covered c USING (doc_id)),
rules AS (
  SELECT host, unnest([n_words < 20, 100 * n_repeat_words > 30 * n_words, 10 * n_symbols > n_words,
                       10 * n_dup_lines > 3 * n_lines, word_chars < 2 * n_words OR word_chars > 12 * n_words]) AS failed,
         unnest([1, 2, 3, 4, 5]) AS rule FROM counts WHERE host IS NOT NULL),
rates AS (SELECT host, rule, count(*) AS d, sum(CAST(failed AS INT)) AS f FROM rules GROUP BY 1, 2),
totals AS (
  SELECT rule, sum(f) / sum(d) AS mean, sum(d * (f / d) * (f / d)) / sum(d) AS square, count(*) / sum(d) AS share
  FROM rates GROUP BY 1),
prior AS (
  SELECT rule, mean, CASE WHEN square - mean * mean - mean * (1 - mean) * share > 1e-9 * mean * (1 - mean)
                     THEN greatest(mean * (1 - mean) / (square - mean * mean - mean * (1 - mean) * share) - 1, 1.0)
                     ELSE 1e9 END AS strength FROM totals),
bad AS (SELECT DISTINCT host FROM rates JOIN prior USING (rule) WHERE (f + mean * strength) / (d + strength) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND bad.host IS NULL AS kept,
       bad.host IS NOT NULL AS host_failed
FROM counts LEFT JOIN bad ON counts.host = bad.host
"""
