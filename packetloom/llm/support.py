"""What the corpus operators share: reading tables, written intermediate tables, text blocks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.operators.skew import join_counted
from packetloom.session import materialize

__all__ = ["BLOCK_BYTES", "fold_of", "join_counted", "labelled_sample", "materialize", "table", "text_blocks", "texts_of", "whole_row"]

# Bytes of text that one NumPy step handles; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` and ``text`` (NULL as empty) of a documents table, whatever else it holds."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *more)


def whole_row(df: DataFrame) -> Column:
    """All columns of a table as one struct, out of the way of columns that an operator adds."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def fold_of(doc_id: Column, folds: int) -> Column:
    """The fold of a document: crc32 of its id as text, modulo ``folds`` (a NULL id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def _drawn(rows: DataFrame, label: str, per_label: int) -> DataFrame:
    """``per_label`` rows of each label, by a hash.  A top-k for each label, so that every task hands on
    ``per_label`` ids at most; a window does so only for numbers up to a threshold of Spark's."""
    order = F.xxhash64(F.lit(label), "doc_id"), F.col("doc_id")
    zero, one = (rows.where(F.col("label") == value).orderBy(*order).limit(per_label) for value in (0, 1))
    return zero.union(one)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, per_label: int
) -> tuple[list[tuple[bytes, int]], dict[int, int]]:
    """A sample of whole labelled texts outside the held-out fold, and how many there are of each label.

    At most ``per_label`` documents of each label, drawn by a hash.  A document with contradicting labels has
    the larger one; rows without text or label are left out.
    """
    marks = labels.where(F.col(label).isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.col(label).cast("int")).alias("label")
    )
    usable = docs.where(F.col("text").isNotNull() & (fold_of(F.col("doc_id"), folds) != held_out))
    ids = usable.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    rows = materialize(ids.join(marks, "doc_id"), "labelled")
    totals = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    drawn = _drawn(rows, label, per_label)
    # Two times per_label ids at most: only their texts are looked up, in a join that moves no other text.
    texts = usable.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = texts.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).collect()
    return [(r.text.encode(), r.label) for r in sorted(found, key=lambda r: r.doc_id * 0x9E3779B1 % (1 << 32))], totals


def text_blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts of an Arrow column as UTF-8, grouped to about ``size`` bytes: (first row, texts)."""
    first, texts, held = 0, [], 0
    for row, value in enumerate(column.cast(pa.binary())):
        text = value.as_py() or b""
        if texts and held + len(text) > size:
            yield first, texts
            first, texts, held = row, [], 0
        texts.append(text)
        held += len(text)
    if texts:
        yield first, texts
