"""Cases that once went wrong."""

from __future__ import annotations

import time
from zlib import crc32

import numpy as np
import pytest

from packetloom.llm import decontaminate, html_extract, packing, pii
from packetloom.llm.byte_cnn import ByteCNN, cut_windows
from packetloom.llm.dom import block_text, parse


@pytest.mark.parametrize("text", ["a" + " " * 1_000_000 + "b", "\n" * 1_000_000, "x \n\t" * 300_000])
def test_long_white_space_is_packed(spark, text):
    import public_tokenizers
    from tokenizers import Tokenizer

    ids = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids + [0]
    rows = packing.pack(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("piece").collect()
    assert sum(r.length for r in rows) == len(ids)
    assert [r.ids_crc32 for r in rows] == [crc32(np.array(ids[r.start : r.start + r.length], np.uint32).tobytes()) for r in rows]


def test_addresses_keep_their_range_and_mails_their_letters():
    key = b"k"
    for norm in ("10.1.2.3", "127.0.0.1", "172.16.3.4", "172.31.9.9", "192.168.7.7", "169.254.1.1", "8.8.8.8", "172.32.1.1", "224.0.0.5"):
        for attempt in range(30):
            found = pii.surrogate("ip", norm, attempt, key)
            parts = [int(p) for p in found.split(".")]
            assert len(parts) == 4 and max(parts) < 256
            assert pii._reach(*parts[:2]) == pii._reach(*map(int, norm.split(".")[:2]))
    for norm in ("dad@cafe.com", "ab12@deed.org"):
        found = pii.surrogate("email", norm, 0, key)
        assert [c.isalpha() for c in found] == [c.isalpha() for c in norm] and found != norm
    assert all(c in "0123456789abcdef" for c in pii.surrogate("secret", "deadbeef01", 0, key))


def test_many_names_get_distinct_surrogates(spark):
    rows = [("surname-latin", f"name{i:04d}") for i in range(1500)] + [("ip", f"10.0.0.{i}") for i in range(200)]
    got = pii.assign(spark.createDataFrame(rows, "kind string, norm string"), b"key").collect()
    assert len(got) == len({(r.kind, r.norm) for r in got}) == len({(r.kind, r.surrogate) for r in got}) == 1700
    assert not {r.surrogate for r in got} & {n for _, n in rows}


def test_formulas_and_fallbacks_stay_in_their_block():
    page = parse(
        "<p>Formula <math><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac><annotation>tex</annotation></math> holds</p><object data=f><p>plain</p></object>"
    )
    assert block_text(page, np.ones(len(page.tags), bool)).split("\n\n") == ["Formula x=12 holds", "plain"]


def test_deep_pages_are_read_in_one_pass():
    def seconds(html):
        begin = time.perf_counter()
        parse(html)
        return time.perf_counter() - begin

    for unit in ("<div>x</b>", "<center>x", "<p><ul>", "<td><p><table><td><center>"):
        short, long = (min(seconds(unit * n) for _ in range(3)) for n in (2_000, 16_000))
        assert long < 24 * short


def test_vocabulary_and_pages_of_any_length(spark):
    page = "<html><body><nav>menu</nav><article><p>" + " ".join(f"word{i}" for i in range(20_000)) + "</p></article></body></html>"
    pages = spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")
    got = html_extract.extract(pages, html_extract.learn(pages)).first()
    assert got.text.startswith("word0 word1") and got.text.endswith("word19999")


def test_questions_in_scripts_without_spaces(spark):
    question = "中国最长的河流叫什么名字？它流经多少个省份。"
    docs = [(1, "前言文字在这里" + question + "后面还有一些别的内容"), (2, "完全不同的一段文字没有任何题目"), (3, "แม่น้ำที่ยาวที่สุดในประเทศ")]
    items = [(1, question), (2, "แม่น้ำที่ยาวที่สุดในประเทศ")]
    found = decontaminate.contaminated(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    ).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(1, 1), (3, 2)}


def test_slopes_are_those_of_the_loss():
    draw = np.random.default_rng(3)
    texts = [bytes(draw.integers(97, 110, n).astype(np.uint8)) for n in (30, 900, 5)]
    windows, owner = cut_windows(texts, 64, 48)
    network = ByteCNN.fresh([0, 1], (3, 5), 4, 3, True, seed=1)
    counts, wanted = np.bincount(owner), np.array([0, 1, 1])

    def loss():
        top = np.maximum.reduceat(network.pooled(windows), np.r_[0, np.cumsum(counts)[:-1]], axis=0)
        return -network.log_probabilities(top)[np.arange(3), wanted].mean()

    slopes = dict(zip(("table", "filters", "bias", "top", "top_bias"), network._slopes(windows, counts, wanted)))
    for name, slope in slopes.items():
        values = getattr(network, name)
        at = np.unravel_index(np.abs(slope).argmax(), slope.shape)
        kept, step = values[at], 1e-2
        values[at] = kept + step
        high = loss()
        values[at] = kept - step
        low = loss()
        values[at] = kept
        assert abs((high - low) / (2 * step) - slope[at]) < 0.1 * abs(slope[at]) + 1e-4
