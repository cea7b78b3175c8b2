"""Every operator and stage on NULLs, empty and long texts, ties, repeated rows, extra columns and empty tables."""

from __future__ import annotations

import pytest

from corpus_pipeline import STAGES
from packetloom.llm import decontaminate, html_extract, language_id, line_dedup, near_dedup, packing, pii, quality_classifier, quality_rules, toxicity

LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(20_000))
TEXTS = [
    (1, "One two three four five six seven eight nine ten.\nSecond line here.\nThird line there.\nFourth.", "en", "a"),
    (2, None, "en", "a"),
    (3, "", "en", None),
    (4, " \n\t ", None, "a"),
    (5, LONG, "en", "b"),
    (6, LONG, "en", "b"),
    (6, LONG, "en", "b"),
    (None, "a text without an id that has some words", "de", "b"),
    (None, None, None, None),
    (7, "12345 67890 !!! ???", "fr", "b"),
]
# Names that operators use inside.
CLASHING = ["_row", "_id", "_key", "_text", "key", "label", "rank", "node", "n_lines", "n_removed", "kept", "id", "text_key", "host", "a.b"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in TEXTS], "doc_id long, text string, lang string, source string, n_chars long")
    for name in CLASHING:
        df = df.withColumn(name, df.doc_id * 0 + 1)
    return df


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(1, "five six seven eight nine ten second line here third"), (2, None), (3, ""), (None, "two words"), (1, "five six seven eight nine ten second line here third")]
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 0, 1), (6, 1, None), (6, 0, 1), (None, 1, 1), (99, 1, 0)], "doc_id long, quality int, toxic int")


def per_document(docs, benchmark, labels):
    return {
        "language": lambda d: language_id.identify(d, language_id.learn(d)),
        "near": lambda d: near_dedup.near_duplicates(d, 2, 80),
        "toxicity": lambda d: toxicity.tag(d, toxicity.learn(d, labels)),
        "pii": lambda d: pii.replace(d),
        "rules": lambda d: quality_rules.judge(d),
        "quality": lambda d: quality_classifier.score_quality(d, quality_classifier.learn(d, labels)),
        "lines": lambda d: line_dedup.dedup_lines(d),
    }


@pytest.mark.parametrize("name", ["language", "near", "toxicity", "pii", "rules", "quality", "lines"])
def test_one_row_per_document(docs, benchmark, labels, name):
    run = per_document(docs, benchmark, labels)[name]
    rows = run(docs).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(t[0]) for t in TEXTS)
    assert run(docs.limit(0)).count() == 0


def test_values_of_empty_texts(docs, labels):
    empty = {2, 3, 4}
    found = {r.doc_id: r for r in language_id.identify(docs, language_id.learn(docs)).collect()}
    assert {found[i].lang_pred for i in empty | {7}} == {"und"} and all(0 <= r.score <= 1 for r in found.values())
    near = {r.doc_id: r for r in near_dedup.near_duplicates(docs, 2, 80).collect()}
    assert all(near[i].n_shingles == 0 and near[i].component_id == i and near[i].kept for i in empty)
    assert near[6].component_id == 5 and not near[6].kept
    rules = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    assert all(rules[i].n_words == 0 and rules[i].base_failed and not rules[i].kept for i in empty)
    lines = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert lines[2].text is None and lines[3].text == "" and lines[4].text == " \n\t " and lines[5].text == LONG
    assert {c for c in CLASHING if c not in ("n_lines", "n_removed")} <= set(line_dedup.dedup_lines(docs).columns)


def test_packing_and_pairs(docs, benchmark):
    rows = packing.pack(docs).collect()
    by_id = {r.doc_id for r in rows}
    assert by_id == {t[0] for t in TEXTS}
    assert {r.length for r in rows if r.doc_id in (2, 3)} == {1}
    assert packing.pack(docs.limit(0)).count() == 0
    found = decontaminate.contaminated(docs, benchmark).collect()
    assert [(r.doc_id, r.item_id) for r in found] == [(1, 1)]
    assert decontaminate.contaminated(docs.limit(0), benchmark).count() == 0
    assert decontaminate.contaminated(docs, benchmark.limit(0)).count() == 0


@pytest.mark.parametrize("name,stage", STAGES)
def test_stages(spark, docs, benchmark, tmp_path, name, stage):
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = stage(spark, docs, str(tmp_path))
    if name != STAGES[-1][0]:
        assert rows.columns == docs.columns and [f.dataType for f in rows.schema] == [f.dataType for f in docs.schema]
    found = [r.doc_id for r in rows.select("doc_id").collect()]
    if name == "quality_rules":
        assert found == []  # too few words, or mostly repeated windows
    if name == "near_dedup":
        assert sorted(map(str, found)) == ["1", "2", "3", "4", "5", "7", "None", "None"]
    if name == "decontamination":
        assert 1 not in found and len(found) == len(TEXTS) - 1
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "no markup at all"), (4, "u", "<p>cut <b"), (None, "u", "<div><p>x</div></p></b>" * 2000), (4, "u", "<p>cut <b")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    trees = html_extract.learn(pages)
    found = html_extract.extract(pages, trees).collect()
    assert [r.page_id for r in found] == [r[0] for r in rows]
    assert found[0].text == found[1].text == "" and all(r.n_chars == len(r.text) for r in found)
    assert html_extract.extract(pages.limit(0), html_extract.learn(pages.limit(0))).count() == 0
