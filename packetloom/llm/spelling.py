"""Spelling variants by permuterm rotations.

A word is marked with a terminator and turned: ``x c y`` becomes ``y $ x c``, so the edited character comes
last.  Every word that differs only in ``c`` shares the prefix ``y $ x``, and the word without ``c`` is that
prefix itself.  All rotations are therefore sorted by that prefix and scanned group by group: the rotations
of a group with a last character are replacements of each other, the one without is an insertion or a
deletion away from them.  A group holds one word per character and the shorter word, so its size is
bounded by the alphabet, whatever the table; a scan hands every word its number of neighbours there and
the best of them, and no pair of words is ever a row.

A character deleted from a run of equal ones gives the same word at every place of the run; only the
first place of a run counts, so a neighbour is counted once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from packetloom.llm.support import materialize

LEAST_LENGTH = 5
LEAST_COUNT = 3
# One word in this many is misspelt on purpose, by the hash of its document and itself.
DAMAGE = 97
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_RUN = "[a-z\\u00C0-\\u00FF]+"
_END = "$"
# A rotation without its last character, after an equal one or not, and a whole one.
_REPEATED, _FIRST, _WHOLE = 0, 1, 2


def damaged_words(docs: DataFrame) -> DataFrame:
    """``word, n``: runs of letters, lower-cased in A-Z, one in ``DAMAGE`` with a character deleted, and
    how often each occurs, for words of enough characters and occurrences."""
    lowered = F.translate("text", _UPPER, _UPPER.lower())
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"),
        F.explode(F.regexp_extract_all(lowered, F.lit(_RUN), F.lit(0))).alias("run"),
    ).where(F.length("run") >= LEAST_LENGTH)
    marked = runs.select("run", F.crc32(F.concat_ws(":", "_id", "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    words = marked.select(F.when(F.col("h") % DAMAGE == 0, shorter).otherwise(F.col("run")).alias("word"))
    counted = words.where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= LEAST_COUNT)


def rotations(words: DataFrame) -> DataFrame:
    """``key, kind, word, n``: every rotation of every word, sorted later by ``key``: the whole rotation, or
    the rotation without the edited character at its end."""

    def turned(at: Column, skip: int) -> Column:
        return F.concat(F.substr("word", at + 1 + skip), F.lit(_END), F.substr("word", F.lit(1), at))

    def letter(at: Column) -> Column:
        return F.substr("word", at + 1, F.lit(1))

    size = F.length("word")
    cut = F.transform(
        F.sequence(F.lit(0), size - 1),
        lambda at: F.struct(
            turned(at, 1).alias("key"),
            F.when((at > 0) & (letter(at) == letter(at - 1)), F.lit(_REPEATED)).otherwise(F.lit(_FIRST)).alias("kind"),
        ),
    )
    whole = F.transform(F.sequence(F.lit(0), size), lambda at: F.struct(turned(at, 0).alias("key"), F.lit(_WHOLE).alias("kind")))
    return words.select("word", "n", F.explode(F.concat(cut, whole)).alias("r")).select("r.key", "r.kind", "word", "n")


def neighbours(words: DataFrame) -> DataFrame:
    """``word, n_near, best``: how many words are one edit away, and the most frequent of them (ties: the
    smallest) as ``(order, word)`` with the negated count."""
    turned = rotations(words).withColumn("me", F.struct((-F.col("n")).alias("order"), F.col("word")))
    group = W.partitionBy("key")
    ranked = group.orderBy("me").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    cut, first, whole = F.col("kind") != _WHOLE, F.col("kind") == _FIRST, F.col("kind") == _WHOLE

    def least(condition: Column) -> Column:
        return F.min(F.when(condition, F.col("me"))).over(ranked)

    scanned = turned.select(
        "word", "kind", "me",
        F.count_if(cut).over(ranked).alias("cuts"),
        F.count_if(first).over(ranked).alias("firsts"),
        least(cut).alias("best_cut"),
        F.nth_value(F.when(cut, F.col("me")), 2, ignoreNulls=True).over(ranked).alias("next_cut"),
        least(first).alias("best_first"),
        least(whole).alias("shorter"),
    )
    other = F.when(F.col("best_cut") == F.col("me"), F.col("next_cut")).otherwise(F.col("best_cut"))
    shorter = F.when(F.col("kind") == _FIRST, F.col("shorter"))
    found = scanned.select(
        "word",
        F.when(whole, F.col("firsts")).otherwise(F.col("cuts") - 1 + shorter.isNotNull().cast("int")).alias("near"),
        F.when(whole, F.col("best_first")).otherwise(F.least(other, shorter)).alias("best"),
    )
    return found.where("near > 0").groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for the words of ``word, form``: where following forms ends, by doubling the step.

    A form is at least twice as frequent as its word, so chains are logarithmic in the largest count and
    rounds in that.
    """
    steps = materialize(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = materialize(steps.join(ahead, "root", "left").select("word", "root", "_next"), "roots")
        if moved.where("_next is not null").isEmpty():
            return moved.select("word", "root")
        steps = moved.select("word", F.coalesce("_next", "root").alias("root"))


def variants(docs: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n``: one row per word of ``docs`` (``doc_id``, ``text``).

    ``form`` is the most frequent word one edit away if it is at least twice as frequent as the word, else
    NULL; ``root`` is where following forms ends.  NULL and empty texts have no words, and a NULL ``doc_id``
    counts as empty in the hash; repeated rows count as often as they come; other columns are ignored; an
    empty table gives an empty table.  Words are compared by code points, so no normal form is applied.
    """
    return grouped(materialize(damaged_words(docs), "words"))


def grouped(words: DataFrame) -> DataFrame:
    """:func:`variants` of a table of distinct words and their counts (``word, n``)."""
    near = neighbours(words)
    joined = words.join(near, "word", "left")
    count = -F.col("best.order")
    usual = count >= 2 * F.col("n")
    named = materialize(
        joined.select(
            "word", F.when(usual, F.col("best.word")).alias("form"), "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(usual, count).alias("form_n"),
        ),
        "spellings",
    )
    roots = _roots(named.where("form is not null"))
    return named.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


ORACLE = r"""
WITH RECURSIVE steps AS (
  SELECT CAST(i AS UBIGINT) AS i, CAST(i AS UBIGINT) AS c, 0 AS k FROM range(256) t(i)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS UBIGINT)) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
runs AS (
  SELECT doc_id, run, count(*) AS times FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[a-z\x{00C0}-\x{00FF}]+')) AS run FROM documents) WHERE length(run) >= 5 GROUP BY 1, 2),
marked AS (
  SELECT run, times, xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT),
    list_transform(range(0, octet_length(b)), lambda i: CAST('0x' || hex(b[i + 1:i + 1]) AS UBIGINT))),
    lambda x, y: xor(x >> 8, t[CAST(xor(x, y) & 255 AS INTEGER) + 1])), CAST(4294967295 AS UBIGINT)) AS h
  FROM (SELECT run, times, encode(concat(doc_id, ':', run)) AS b FROM runs), crc),
words AS (
  SELECT word, CAST(sum(times) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN left(run, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2)
                ELSE run END AS word, times FROM marked) WHERE length(word) >= 5 GROUP BY 1 HAVING sum(times) >= 3),
cuts AS (SELECT word, n, length(word) AS m, p, left(word, p - 1) || ' ' || substr(word, p + 1) AS hole,
                left(word, p - 1) || substr(word, p + 1) AS rest
         FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words)),
pairs AS (
  SELECT a.word AS u, b.word AS v, b.n AS n FROM cuts a JOIN cuts b ON a.hole = b.hole AND a.p = b.p AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word),
near AS (SELECT u, count(*) AS n_near, min(struct_pack(o := -n, w := v)) AS best FROM pairs GROUP BY 1),
named AS (
  SELECT word, CASE WHEN -best.o >= 2 * n THEN best.w END AS form, n, coalesce(n_near, 0) AS n_near,
         CASE WHEN -best.o >= 2 * n THEN -best.o END AS form_n
  FROM words LEFT JOIN near ON u = word),
walk AS (
  SELECT word, word AS root, 0 AS step FROM named
  UNION ALL SELECT w.word, f.form, step + 1 FROM walk w JOIN named f ON f.word = w.root WHERE f.form IS NOT NULL),
ends AS (SELECT word, arg_max(root, step) AS root FROM walk GROUP BY 1)
SELECT word, form, root, n, n_near, form_n FROM named JOIN ends USING (word)
"""
