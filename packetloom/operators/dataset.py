"""Dataset operators: combine, dedup, split, balance, folds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.operators.cut import (
    COPY_COLUMN,
    exact_cut,
    fold_sizes,
    holdout_sizes,
    number_copies,
    proportional_sizes,
    split_sizes,
    stratified_fold_sizes,
)
from packetloom.schema import LABEL


def combine(sources: list[DataFrame]) -> DataFrame:
    """UNION ALL by name; a column missing in one source is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def dedup_rows(df: DataFrame) -> DataFrame:
    """Exact dedup over all columns; NULLs equal each other."""
    return df.dropDuplicates()


def class_counts(df: DataFrame, label: str = LABEL) -> DataFrame:
    return df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def normal_only(df: DataFrame, label: str = LABEL) -> DataFrame:
    return df.filter(F.col(label) == 0)


def count_dropped(df: DataFrame, label: str = LABEL) -> int:
    """How many rows ``normal_only`` leaves out."""
    return df.filter(F.col(label).isNull() | (F.col(label) != 0)).count()


def require_label(df: DataFrame, label: str) -> None:
    if label not in df.columns:
        raise ValueError(f"no label column {label!r} in {df.columns}")


def _keyed(df: DataFrame, keys: list[str] | None) -> tuple[DataFrame, list[str]]:
    if keys:
        return df, keys
    numbered = number_copies(df)
    return numbered, numbered.columns


def _without_copy_number(df: DataFrame, keys: list[str] | None) -> DataFrame:
    return df if keys else df.drop(COPY_COLUMN)


def assign_split(
    df: DataFrame,
    keys: list[str] | None = None,
    label: str = LABEL,
    train_size: float | None = 0.8,
    test_size: float | None = None,
    stratify: bool = True,
    seed: int = 42,
) -> DataFrame:
    """Adds ``part``: 0 for training, 1 for test rows."""

    def sizes_of(rows: int) -> list[int]:
        return split_sizes(rows, train_size) if test_size is None else holdout_sizes(rows, test_size)

    def stratified(counts: dict[object, int]) -> dict[object, list[int]]:
        return proportional_sizes(counts, sizes_of(sum(counts.values()))[0])

    def plain(counts: dict[object, int]) -> dict[object, list[int]]:
        return {c: sizes_of(n) for c, n in counts.items()}

    if stratify:
        require_label(df, label)
    keyed, columns = _keyed(df, keys)
    cut = exact_cut(
        keyed, columns, stratified if stratify else plain, by=label if stratify else None, seed=seed
    )
    return _without_copy_number(cut, keys)


def parts_of(df: DataFrame, count: int = 2, part: str = "part") -> list[DataFrame]:
    return [df.filter(F.col(part) == i).drop(part) for i in range(count)]


def split_dataset(
    df: DataFrame,
    label: str = LABEL,
    train_size: float = 0.8,
    stratify: bool = True,
    seed: int = 42,
    keys: list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Training and test rows; the label column must exist even when not stratifying."""
    require_label(df, label)
    train, test = parts_of(assign_split(df, keys, label, train_size, None, stratify, seed))
    return train, test


def balance_labels(
    df: DataFrame, label: str = LABEL, seed: int = 42, keys: list[str] | None = None
) -> DataFrame:
    """The larger of exactly two classes cut to the size of the smaller, without replacement.

    Row order carries no meaning here; write with ``shuffled`` where a file needs it.
    """
    require_label(df, label)

    def sizes(counts: dict[object, int]) -> dict[object, list[int]]:
        if len(counts) != 2:
            raise ValueError("balancing needs exactly two classes")
        least = min(counts.values())
        return {c: [least, n - least] for c, n in counts.items()}

    keyed, columns = _keyed(df.filter(F.col(label).isNotNull()), keys)
    cut = exact_cut(keyed, columns, sizes, by=label, seed=seed)
    return _without_copy_number(cut.filter("part = 0").drop("part"), keys)


def shuffled(df: DataFrame, seed: int = 42) -> DataFrame:
    """Rows in a seeded pseudo-random order; copies of one row are spread over it like any others.

    A row's hash names its partition and its place there, so partitions are even and no range has to be
    found; which of them a row falls into is as random as its place.
    """
    numbered = number_copies(df)
    place = F.xxhash64(F.lit(seed), *numbered.columns)
    return numbered.repartition(place).sortWithinPartitions(place).drop(COPY_COLUMN)


def assign_folds(
    df: DataFrame,
    k: int = 5,
    label: str | None = None,
    keys: list[str] | None = None,
    seed: int = 42,
    fold: str = "fold",
) -> DataFrame:
    """Adds ``fold`` (0 … k-1); within each class when a label column is named."""
    if label is not None:
        require_label(df, label)

    def plain(counts: dict[object, int]) -> dict[object, list[int]]:
        return {c: fold_sizes(n, k) for c, n in counts.items()}

    def stratified(counts: dict[object, int]) -> dict[object, list[int]]:
        return stratified_fold_sizes(counts, k)

    keyed, columns = _keyed(df, keys)
    cut = exact_cut(keyed, columns, stratified if label else plain, by=label, seed=seed, part=fold)
    return _without_copy_number(cut, keys)
