"""From raw documents to packed training sequences: rules, lines, near copies, benchmarks, packing."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from packetloom.llm.decontaminate import drop_contaminated
from packetloom.llm.line_dedup import drop_repeated_lines
from packetloom.llm.near_dedup import keep_representatives
from packetloom.llm.packing import pack
from packetloom.llm.quality_rules import keep_good
from packetloom.llm.support import materialize, table
from packetloom.session import drop_tables, written_tables

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Folders of what earlier stages wrote for themselves, with the number of the stage.
_held: list[tuple[int, str]] = []


def _in_turn(number: int, stage: Stage) -> Stage:
    """A stage that begins by dropping what earlier stages wrote for themselves, unless its input still reads it.

    A stage's result therefore has to be written before a later stage begins, as ``run`` does.
    """

    @wraps(stage)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if any(of < number for of, _ in _held):
            read = {file.rsplit("/", 2)[-2] for file in docs.inputFiles()}
            done = [(of, path) for of, path in _held if of < number and path.rsplit("/", 1)[-1] not in read]
            drop_tables(spark, [path for _, path in done])
            _held[:] = [x for x in _held if x not in done]
        with written_tables() as own:
            try:
                return stage(spark, docs, sf_dir)
            finally:
                _held.extend((number, path) for path in own)

    return begun


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the verdict on their host keep."""
    return keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later occurrences of three-line windows, or of texts too short for one; documents that
    lose every line go."""
    return drop_repeated_lines(docs, short_texts=True)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity of 0.8 or more)."""
    return keep_representatives(docs, width=5, percent=80)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes among sequences of 2048 tokens."""
    return pack(docs)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("near_dedup", near_copies),
    ("decontamination", benchmarks),
    ("packing", packing),
]
STAGES = [(name, _in_turn(number, stage)) for number, (name, stage) in enumerate(STAGES)]

#: Packing has no SQL; tests compare the whole run with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every result but the last is written and read again, and goes
    when the next one is written."""
    docs, read = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with written_tables() as written:
            docs = materialize(stage(spark, docs, sf_dir), name)
        drop_tables(spark, read)
        read = written[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
