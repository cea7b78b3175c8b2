from __future__ import annotations

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from packetloom.operators import cut, dataset
from packetloom.operators.cut import exact_cut, fold_sizes, number_copies, proportional_sizes, stratified_fold_sizes


def key_order(keys, seed=42):
    return sorted(keys, key=lambda k: (int(hashlib.md5(f"{seed}|{k}".encode()).hexdigest()[:8], 16), k))


@pytest.fixture(scope="module")
def keyed(spark):
    return spark.range(3000).selectExpr("id", "cast(id % 7 = 0 as int) as label")


@pytest.mark.parametrize("bits", [1, 8, 16])
@pytest.mark.parametrize("few", [0, 16])
def test_cut_equals_a_full_sort(keyed, monkeypatch, bits, few):
    """With boundaries as literals, after one or several histograms, and as a table."""
    monkeypatch.setattr(cut, "BUCKET_BITS", bits)
    monkeypatch.setattr(cut, "STEP_BITS", bits)
    monkeypatch.setattr(cut, "GATHER_ROWS", 10)
    monkeypatch.setattr(cut, "FEW_CLASSES", few)
    out = exact_cut(keyed, ["id"], lambda counts: {c: [100, n - 350, 250] for c, n in counts.items()})
    parts = {r.id: r.part for r in out.collect()}
    order = key_order(range(3000))
    assert parts == {k: 0 if i < 100 else 1 if i < 2750 else 2 for i, k in enumerate(order)}


def test_cut_by_class_whatever_the_partitioning(keyed):
    def sizes(counts):
        return {c: [n // 3, n - n // 3] for c, n in counts.items()}

    one = {tuple(r) for r in exact_cut(keyed.repartition(1), ["id"], sizes, by="label").collect()}
    many = {tuple(r) for r in exact_cut(keyed.repartition(9, "label"), ["id"], sizes, by="label").collect()}
    assert one == many
    other = {tuple(r) for r in exact_cut(keyed, ["id"], sizes, by="label", seed=1).collect()}
    assert one != other


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    rows = df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return rows, plan[: plan.find("== Initial Plan ==")] if "== Initial Plan ==" in plan else plan


@pytest.mark.parametrize("by", [None, "label"])
def test_few_classes_move_no_row(spark, tmp_path, by):
    spark.range(0, 200_000, 1, 6).selectExpr("id", "cast(id % 3 as int) as label").write.parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t")
    out = exact_cut(table, ["id"], lambda c: {k: [n // 5, n - n // 5] for k, n in c.items()}, by=by)
    rows, plan = final_plan(out)
    assert not any(word in plan for word in ("Exchange", "Join", "Sort", "Generate"))
    assert Counter(r.part for r in rows)[0] in (40_000, 3 * (66_667 // 5) - 1, 39_999)


def test_shuffle_has_no_range_sort(spark, keyed):
    rows, plan = final_plan(dataset.shuffled(keyed.union(keyed)))
    assert "rangepartitioning" not in plan and len(rows) == 6000
    ids = [r.id for r in rows]
    assert ids != sorted(ids) and abs(sum(ids[:600]) / 600 - 1500) < 150


def test_many_classes_are_broadcast_and_more_are_joined(spark, keyed, monkeypatch):
    table = keyed.selectExpr("id", "cast(if(id % 10 = 0, null, id % 50) as int) as label")
    sizes = lambda c: {k: [n // 4, n - n // 4] for k, n in c.items()}
    few, plan = final_plan(exact_cut(table, ["id"], sizes, by="label"))
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan
    monkeypatch.setattr(cut, "BROADCAST_CLASSES", 3)
    more = exact_cut(table, ["id"], sizes, by="label").collect()
    assert {tuple(r) for r in more} == {tuple(r) for r in few} and len(more) == 3000


def test_empty_parts_and_repeated_keys(spark, keyed):
    out = exact_cut(keyed, ["id"], lambda c: {k: [0, n, 0] for k, n in c.items()})
    assert {r.part for r in out.select("part").distinct().collect()} == {1}
    same = spark.range(100).selectExpr("1 as id")
    with pytest.raises(ValueError, match="not unique"):
        exact_cut(same, ["id"], lambda c: {k: [50, n - 50] for k, n in c.items()})
    with pytest.raises(ValueError, match="add up"):
        exact_cut(keyed, ["id"], lambda c: {k: [1, 1] for k in c})


def test_null_keys_and_null_classes(spark):
    df = spark.createDataFrame([(None, None), (1, None), (2, 1), (3, 1)], "id INT, label INT")
    out = exact_cut(df, ["id"], lambda c: {k: [1, n - 1] for k, n in c.items()}, by="label").collect()
    assert Counter((r.label, r.part) for r in out) == {(None, 0): 1, (None, 1): 1, (1, 0): 1, (1, 1): 1}


@pytest.mark.parametrize("chunk", [3, 1_000_000])
def test_copies_are_numbered_without_loss(spark, monkeypatch, chunk):
    monkeypatch.setattr(cut, "COPY_CHUNK", chunk)
    rows = [(1.0, None)] * 40 + [(2.0, 5)] * 3 + [(3.0, 1)]
    out = number_copies(spark.createDataFrame(rows, "a DOUBLE, b INT")).collect()
    assert Counter((r.a, r.b) for r in out) == Counter(rows)
    assert sorted(r.copy_no for r in out if r.a == 1.0) == list(range(40))


def test_many_classes(spark):
    df = spark.range(6000).selectExpr("id", "id % 1200 as label")
    out = exact_cut(df, ["id"], lambda c: {k: [2, n - 2] for k, n in c.items()}, by="label").collect()
    assert Counter((r.label, r.part) for r in out) == {(k, p): 2 + p for k in range(1200) for p in (0, 1)}


def test_copies_spread_over_partitions(spark):
    df = spark.range(400_000).selectExpr("id % 2 as a")
    sizes = [r["count"] for r in number_copies(df).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 400_000 and len(sizes) == 4 and max(sizes) < 250_000


def test_hot_row_is_split_in_proportion(spark):
    df = spark.range(900).selectExpr("cast(if(id < 300, -1, id) as double) as a", "cast(id % 2 as int) as label")
    train, test = dataset.split_dataset(df, stratify=False)
    assert (train.count(), test.count()) == (720, 180)
    hot = train.filter("a = -1").count()
    assert 200 <= hot <= 280  # close to 80% of 300, not all or none
    assert train.unionAll(test).exceptAll(df).count() == 0


def test_size_rules():
    assert proportional_sizes({0: 90, 1: 10}, 80) == {0: [72, 18], 1: [8, 2]}
    assert proportional_sizes({0: 5, 1: 5, 2: 5}, 11) == {0: [4, 1], 1: [4, 1], 2: [3, 2]}
    with pytest.raises(ValueError):
        proportional_sizes({0: 9, 1: 1}, 8)
    assert fold_sizes(10, 3) == [4, 3, 3]
    with pytest.raises(ValueError):
        fold_sizes(2, 3)
    dealt = stratified_fold_sizes({0: 7, 1: 6}, 5)
    assert {c: sum(s) for c, s in dealt.items()} == {0: 7, 1: 6}
    assert [a + b for a, b in zip(*dealt.values())] == [3, 3, 3, 2, 2]
    with pytest.raises(ValueError):
        stratified_fold_sizes({0: 2, 1: 2}, 3)


def test_split(spark):
    df = spark.range(100).selectExpr("cast(id as int) as a", "cast(id + 100 as int) as b", "cast(id % 2 as int) as label")
    train, test = dataset.split_dataset(df)
    assert (train.count(), test.count()) == (80, 20)
    assert {r.label: r.n for r in dataset.class_counts(test).collect()} == {0: 10, 1: 10}
    assert train.columns == df.columns and train.intersect(test).count() == 0
    with pytest.raises(ValueError):
        dataset.split_dataset(df.drop("label"))


def test_balance(spark):
    df = spark.createDataFrame([(i, int(i >= 5)) for i in range(15)], "a INT, label INT")
    out = dataset.balance_labels(df)
    assert {r.label: r.n for r in dataset.class_counts(out).collect()} == {0: 5, 1: 5}
    assert out.exceptAll(df).count() == 0
    even = df.filter("a < 10")
    assert dataset.balance_labels(even).count() == 10
    with pytest.raises(ValueError):
        dataset.balance_labels(df.filter("label = 1"))
    assert sorted(map(tuple, dataset.shuffled(df).collect())) == sorted(map(tuple, df.collect()))


def test_folds(spark, keyed):
    out = dataset.assign_folds(keyed, 7, keys=["id"])
    assert sorted(r["count"] for r in out.groupBy("fold").count().collect()) == [428] * 3 + [429] * 4
    by_class = dataset.assign_folds(keyed, 5, "label", ["id"])
    sizes = {r["fold"]: r["count"] for r in by_class.groupBy("fold").count().collect()}
    assert sizes == {i: 600 for i in range(5)}


def test_combine_and_dedup(spark):
    one = spark.createDataFrame([(1, 2, 0), (1, 2, 0)], "a INT, b INT, label INT")
    two = spark.createDataFrame([(0, 1, 2), (1, 1, 2)], "label INT, a INT, b INT")
    three = spark.createDataFrame([(9, None), (9, None)], "a INT, c INT")
    out = dataset.dedup_rows(dataset.combine([one, two, three]))
    assert {tuple(r) for r in out.collect()} == {(1, 2, 0, None), (1, 2, 1, None), (9, None, None, None)}
    assert out.count() == 3


def test_normal_only(labelled):
    assert dataset.normal_only(labelled).count() == 14
    assert dataset.count_dropped(labelled) == 12
