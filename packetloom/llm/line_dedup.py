"""Line deduplication over overlapping windows of three lines.

The lines of a text that hold a word are numbered; every run of three of them is a window, named by
two 64-bit hashes.  A window that occurs more than once anywhere keeps its first occurrence (by
document id, then position); every later one marks the three lines it covers, overlapping marks merge,
and marked lines go.  Window rows are a few numbers each; repeated windows are found by an aggregation
with partial sums, so a passage in a third of all documents is one small row per task, and the marks
meet the texts in a join by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.llm.support import materialize, whole_row

LINES = 3
_WORD = "[^\\x20\\x09-\\x0D]"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _filled(text: Column) -> Column:
    """Positions of the lines that hold a word, with the line."""
    numbered = F.transform(_lines(text), lambda line, at: F.struct(at.alias("at"), line.alias("line")))
    return F.filter(numbered, lambda row: row["line"].rlike(_WORD))


def windows(docs: DataFrame, short_texts: bool = False) -> DataFrame:
    """``doc_id, text_key, at, a, b``: every window of three filled lines; ``at`` numbers filled lines.

    With ``short_texts`` the one or two filled lines of a shorter text are a window, too, which only
    another text of as many lines can repeat.
    """
    hashed = F.transform(
        _filled(F.col("text")),
        lambda row: F.struct(F.xxhash64(row["line"]).alias("x"), F.xxhash64(F.lit(9), row["line"]).alias("y")),
    )

    def runs(rows: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(rows) - (LINES - 1), F.lit(1)))
        return F.transform(starts, lambda at: F.slice(rows, at, LINES))

    # The array is bound once, as the element of a one-element array.
    cut = F.when(F.size(hashed) >= (1 if short_texts else LINES), F.transform(F.array(hashed), runs)[0])
    return (
        docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.posexplode(cut).alias("at", "run"))
        .select("doc_id", "text_key", "at", F.xxhash64(F.size("run"), "run.x").alias("a"), F.xxhash64(F.size("run"), "run.y").alias("b"))
    )


def covered(docs: DataFrame, short_texts: bool = False) -> DataFrame:
    """``doc_id, text_key, marks``: first filled lines of the windows to remove, for documents that have any."""
    found = materialize(windows(docs, short_texts), "line-windows")
    place = F.struct("doc_id", "text_key", "at")
    repeated = found.groupBy("a", "b").agg(F.min(place).alias("first"), F.count("*").alias("times")).where("times > 1")
    later = found.join(repeated.select("a", "b", "first"), ["a", "b"]).where(
        ~(
            F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
            & (F.col("text_key") == F.col("first.text_key"))
            & (F.col("at") == F.col("first.at"))
        )
    )
    return later.groupBy("doc_id", "text_key").agg(F.collect_set("at").alias("marks"))


def _reduced(docs: DataFrame, short_texts: bool) -> DataFrame:
    """``_row`` (all columns), ``_text`` (what remains), ``_lines`` and ``_removed``."""
    marks = covered(docs.select("doc_id", "text"), short_texts).toDF("_id", "_key", "_marks")
    rows = docs.select(whole_row(docs).alias("_row"), F.col("text").alias("_text"))
    same = F.col("_row.doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("_text") == F.col("_key"))
    filled = _filled(F.col("_text"))

    def dropped(lines: Column) -> Column:
        """Positions in the text of the lines that the marked windows cover."""
        covers = F.flatten(F.transform("_marks", lambda s: F.array(*[s + i for i in range(LINES)])))
        return F.transform(F.filter(F.array_distinct(covers), lambda n: n < F.size(lines)), lambda n: F.get(lines, n)["at"])

    gone = F.transform(F.array(filled), dropped)[0]
    return (
        rows.join(marks, same, "left")
        .select("_row", "_text", F.coalesce(F.size(filled), F.lit(0)).cast("long").alias("_lines"),
                F.when(F.col("_marks").isNotNull(), gone).alias("_gone"))
        .select("_row", F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(_without(_lines(F.col("_text")), F.col("_gone"))).alias("_text"),
                "_lines", F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("_removed"))
    )


def _restored(columns: list[str], **changed: Column) -> list[Column]:
    return [changed.get(c, F.col(f"_row.`{c}`")).alias(c) for c in columns]


def dedup_lines(docs: DataFrame, short_texts: bool = False) -> DataFrame:
    """All columns of ``docs`` with ``text`` reduced to its remaining lines, and ``n_lines`` (lines that
    held a word) and ``n_removed``.

    Lines without a word are never part of a window and stay; a line survives unless a later
    occurrence of a repeated window covers it.  NULL texts stay NULL with 0 lines.  Texts of fewer
    than three filled lines have no window and stay as they are, copies included, unless ``short_texts``
    makes a window of all their lines (as ``ORACLE`` does).  Rows that repeat a document (same id
    and text) count as one, and all stay alike.  A window that occurs twice in one text loses the later
    occurrence, too.  Columns named like the results are replaced; an empty table gives an empty table.
    """
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    reduced = _reduced(docs, short_texts)
    return reduced.select(
        *_restored(columns, text=F.col("_text")), F.col("_lines").alias("n_lines"), F.col("_removed").alias("n_removed")
    )


def drop_repeated_lines(docs: DataFrame, short_texts: bool = False) -> DataFrame:
    """``docs`` with reduced texts (and ``n_chars``, where there is one, brought up to date), without the
    documents that lost every line that held a word; their columns stay as they are.  ``short_texts`` as
    in :func:`dedup_lines`."""
    reduced = _reduced(docs, short_texts).where("_removed = 0 or _removed < _lines")
    changed = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        size = F.when(F.col("_removed") > 0, F.length("_text")).otherwise(F.col("_row.n_chars"))
        changed["n_chars"] = size.cast(docs.schema["n_chars"].dataType)
    return reduced.select(*_restored(docs.columns, **changed))


def _without(lines: Column, positions: Column) -> Column:
    """Lines outside ``positions``, as a text; both are merged in one sorted pass, so cost does not grow with their product."""
    marked = F.transform(positions, lambda p: F.struct(p.alias("at"), F.lit(0).alias("kind"), F.lit("").alias("line")))
    rows = F.transform(lines, lambda line, at: F.struct(at.alias("at"), F.lit(1).alias("kind"), line.alias("line")))
    merged = F.sort_array(F.concat(marked, rows))

    def stay(all_rows: Column) -> Column:
        def alone(row: Column, at: Column) -> Column:
            return (row["kind"] == 1) & ~F.coalesce(F.get(all_rows, at - 1)["kind"] == 0, F.lit(False))

        return F.array_join(F.transform(F.filter(all_rows, alone), lambda row: row["line"]), "\n")

    return F.transform(F.array(merged), stay)[0]


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
filled AS (
  SELECT doc_id, pos, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS no
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
runs AS (
  SELECT doc_id, no, line AS x, lead(line) OVER w AS y, lead(line, 2) OVER w AS z FROM filled
  WINDOW w AS (PARTITION BY doc_id ORDER BY no)),
later AS (
  SELECT doc_id, no FROM runs WHERE z IS NOT NULL OR no = 0
  QUALIFY row_number() OVER (PARTITION BY x, y, z ORDER BY doc_id, no) > 1),
covers AS (SELECT DISTINCT doc_id, unnest([no, no + 1, no + 2]) AS no FROM later),
gone AS (SELECT doc_id, no FROM covers SEMI JOIN filled USING (doc_id, no)),
rest AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) AS text
  FROM lines l LEFT JOIN filled f ON l.doc_id = f.doc_id AND l.pos = f.pos
  LEFT JOIN gone g ON f.doc_id = g.doc_id AND f.no = g.no WHERE g.no IS NULL GROUP BY 1)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(r.text, '') END AS text,
       CAST(coalesce(n.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed
FROM documents d LEFT JOIN rest r USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n FROM filled GROUP BY 1) n USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1) g USING (doc_id)
"""
