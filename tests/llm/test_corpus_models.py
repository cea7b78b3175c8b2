"""Quality of the trained operators on held-out rows, and of extraction on known layouts."""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pytest

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from packetloom.llm import html_extract, language_id, quality_classifier, support, toxicity
from packetloom.llm.dom import block_text, parse
from packetloom.llm.support import table

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF_DIR, "documents")


@pytest.fixture(scope="module")
def labels(spark):
    return table(spark, SF_DIR, "labels")


def ranking(scores, marks):
    scores, marks = np.array(scores), np.array(marks)
    return np.mean([(scores[marks == 0] < s).mean() + (scores[marks == 0] == s).mean() / 2 for s in scores[marks == 1]])


def test_sample_is_a_top_k_of_each_label(spark):
    rows = spark.range(9000).select(F.col("id").alias("doc_id"), (F.col("id") % 5 == 0).cast("int").alias("label"))
    drawn = support._drawn(rows, "toxic", 1500)
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("TakeOrderedAndProject(limit=1500") >= 2
    order = W.partitionBy("label").orderBy(F.xxhash64(F.lit("toxic"), "doc_id"), "doc_id")
    want = rows.withColumn("n", F.row_number().over(order)).where("n <= 1500").drop("n")
    assert sorted(map(tuple, drawn.collect())) == sorted(map(tuple, want.collect())) and drawn.count() == 3000


def test_languages_of_held_out_texts(docs):
    got = language_id.identify(docs, language_id.learn(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got if r.lang]) > 0.96


def test_quality_of_held_out_texts(docs, labels):
    got = quality_classifier.score_quality(docs, quality_classifier.learn(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    assert ranking([r.score for r in got], [r.quality for r in got]) > 0.95


def test_toxicity_of_held_out_texts(docs, labels):
    found = toxicity.tag(docs, toxicity.learn(docs, labels)).join(labels, "doc_id").join(docs.select("doc_id", "text"), "doc_id")
    got = found.where("held_out").collect()
    assert ranking([r.score for r in got], [r.toxic for r in got]) > 0.7
    assert all(0 <= s.start < s.end <= len(r.text) for r in got for s in r.spans)


def test_article_of_the_corpus_pages(spark):
    pages = table(spark, SF_DIR, "pages")
    got = html_extract.extract(pages, html_extract.learn(pages)).join(pages.select("page_id", "html"), "page_id").collect()
    for r in got:
        article = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", article[1])]
        assert r.text == "\n\n".join(b for b in blocks if b)


def test_layouts_without_telling_names():
    draw = np.random.default_rng(77)
    words = [f"{a}{b}" for a in ("bal", "cor", "den", "fil", "gos") for b in ("a", "emo", "iri", "o", "uta", "ent")]
    trees = html_extract.fit([])
    right = total = 0
    for _ in range(60):
        html = html_extract.layout(draw, words)
        page = parse(html)
        held = np.array([any(n == i and html_extract._MARK in t for _, n, t, _ in page.pieces) for i in range(len(page.tags))])
        want = set(block_text(page, held).replace(html_extract._MARK, "").split("\n\n"))
        got = set(html_extract.main_text([html.replace(html_extract._MARK, "")], trees)[0].split("\n\n"))
        right += len(want & got)
        total += len(want | got)
    assert right / total > 0.85


def test_markup_is_read_as_browsers_do():
    html = (
        "<title>no</title><p>one &amp; <b>two<p>three&nbsp;four<script>if (a<b) {'</p>'}</script> five<!-- no --><br>six"
        '<ul><li>a<li>b</ul><div title="x>y">seven</div><table><tr><td>c<td>d</table>1 < 2<p>last <em'
    )
    page = parse(html)
    assert block_text(page, np.ones(len(page.tags), bool)).split("\n\n") == [
        "one & two", "three four five six", "a", "b", "seven", "c", "d", "1 < 2", "last",
    ]
