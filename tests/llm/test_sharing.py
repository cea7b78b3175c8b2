"""Repeated passages, spelling variants and lexical search against brute force."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pandas as pd
import pytest

from packetloom.llm import lexical_search, spelling, substring_dedup
from packetloom.llm.suffix_array import suffix_array

DOCS = "doc_id long, text string, lang string, at long, a string, word string, n long, key string, marks string"


def docs_of(spark, rows):
    """Documents with more columns, named like the operators' own."""
    return spark.createDataFrame([(i, t, None, 1, "a", "w", None, "k", "m") for i, t in rows], DOCS)


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_removed(rows, size=400):
    places = Counter()
    texts = [(i, (t or "").encode()) for i, t in rows]
    for _, t in texts:
        places.update(t[at : at + size] for at in range(len(t) - size + 1))
    out = []
    for i, t in texts:
        gone = np.zeros(len(t) + 1, int)
        for at in range(len(t) - size + 1):
            if places[t[at : at + size]] > 1:
                gone[at] += 1
                gone[at + size] -= 1
        mark = np.cumsum(gone)[:-1] > 0
        kept = bytes(np.frombuffer(t, np.uint8)[~mark]) if t else b""
        spans = int((np.diff(mark.astype(int), prepend=0) == 1).sum())
        out.append((i, len(t), int(mark.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def removed(spark, rows):
    df = substring_dedup.digest(substring_dedup.remove_repeats(docs_of(spark, rows)))
    return sorted((tuple(r) for r in df.collect()), key=repr)


def passages(seed=3):
    draw = np.random.default_rng(seed)

    def words(n):
        return " ".join("".join(draw.choice(list("abcdeéß"), draw.integers(1, 9))) for _ in range(n))

    shared = [words(90) for _ in range(3)]
    rows = [(n, words(draw.integers(0, 60)) + draw.choice(shared)[draw.integers(0, 40) :] + words(draw.integers(0, 60))) for n in range(40)]
    base = words(300)
    for n in range(40, 70):
        at = draw.integers(0, len(base) - 3)
        rows.append((n, base[:at] + draw.choice(["", "x", "yy"]) + base[at + draw.integers(0, 3) :]))
    exact = shared[0][:400].encode()[:398].decode(errors="ignore")
    rows += [(70, base), (71, base), (71, base), (None, base[5:]), (72, None), (73, ""), (74, exact), (75, exact), (76, "a" * 900), (77, "ab" * 300)]
    rows += [(78, "z" * 399), (79, "z" * 399), (80, "q" * 400), (81, "q" * 400), (82, shared[1] * 3), (83, " " * 3000 + words(4))]
    return rows


def test_suffix_array_equals_sorting():
    draw = np.random.default_rng(7)
    for _ in range(400):
        n, kinds = draw.integers(0, 50), draw.choice([1, 2, 3, 9])
        text = draw.integers(1, kinds + 1, n).tolist()
        if draw.random() < 0.3 and n:
            text = (text[: draw.integers(1, 6)] * 30)[:n]
        text.append(0)
        assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])
    assert suffix_array([]) == []


@pytest.mark.parametrize("members", [substring_dedup.MEMBERS, 2])
def test_repeated_passages_equal_brute_force(spark, monkeypatch, members):
    """Also where every core counts as a hot one."""
    monkeypatch.setattr(substring_dedup, "MEMBERS", members)
    rows = passages()
    found = removed(spark, rows)
    assert found == brute_removed(rows)
    assert sum(r[2] > 0 for r in found) > 60 and sum(0 < r[2] < r[1] for r in found) > 30


def test_repeated_passages_without_rows_and_long(spark):
    assert removed(spark, []) == []
    draw = np.random.default_rng(1)
    long = "".join(draw.choice(list("abcdefgh "), 1_500_000))
    found = {r[0]: r for r in removed(spark, [(1, long + "x" * 50), (2, long[700_000:700_500]), (3, "y" * 300_000)])}
    assert found[1][2:4] == (500, 1) and found[2][2:4] == (500, 1) and found[3][2:4] == (300_000, 1)


def test_kept_bytes_and_spans(spark):
    passage = "".join(f"{i:04d}" for i in range(150))
    rows = substring_dedup.remove_repeats(docs_of(spark, [(1, "vor" + passage + "nach"), (2, passage)])).collect()
    by_id = {r.doc_id: r for r in rows}
    assert bytes(by_id[1].kept) == b"vornach" and [tuple(s) for s in by_id[1].spans] == [(3, 603)]
    assert bytes(by_id[2].kept) == b""


def brute_words(rows):
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = lowered(run)
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(words):
    forms, out = {}, {}
    for w, n in words.items():
        near = [v for v in words if one_apart(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best is not None and words[best] >= 2 * n else None
        out[w] = [n, len(near)]
    rows = set()
    for w in words:
        root = w
        while forms[root]:
            root = forms[root]
        rows.add((w, forms[w], root, *out[w], words.get(forms[w])))
    return rows


def test_spelling_variants_equal_brute_force(spark):
    draw = np.random.default_rng(5)
    stems = ["".join(draw.choice(list("abÀß"), draw.integers(4, 8))) for _ in range(60)] + ["aaaaa", "aaaaaa", "aaaaaaa", "Zebra×÷"]
    rows = []
    for n in range(60):
        text = []
        for stem in draw.choice(stems, 120):
            at = draw.integers(0, len(stem))
            text.append(stem if draw.random() < 0.7 else stem[:at] + draw.choice(["", "b", "À", "aa"]) + stem[at + 1 :])
        rows.append((n, draw.choice([" ", "\n", "9", "_"]).join(text)))
    rows += [(3, None), (4, ""), (None, rows[0][1]), (5, rows[1][1]), (5, rows[1][1]), (6, "lange" * 50_000)]
    found = spelling.variants(docs_of(spark, rows)).collect()
    wanted = brute_variants(brute_words(rows))
    assert {tuple(r) for r in found} == wanted and len(found) == len(wanted) > 200
    assert spelling.variants(docs_of(spark, [])).collect() == []


def test_spelling_chains_and_ties(spark):
    words = spark.createDataFrame([("kitten", 3), ("mitten", 8), ("bitten", 8), ("bitter", 40), ("better", 200), ("aloof", 5)], "word string, n long")
    found = {r.word: tuple(r)[1:] for r in spelling.grouped(words).collect()}
    assert found["kitten"] == ("bitten", "better", 3, 2, 8)
    assert found["bitten"] == ("bitter", "better", 8, 3, 40)
    assert found["better"] == (None, "better", 200, 1, None)
    assert found["aloof"] == (None, "aloof", 5, 0, None)


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_search(rows, items):
    docs = [(i, c) for i, t in rows if (c := Counter(TERM.findall(lowered(t))))]
    count, total = len(docs), sum(sum(c.values()) for _, c in docs)
    out = set()
    for item, text in set(items):
        scored = []
        for i, c in docs:
            score = 0
            m = 25 + 75 * sum(c.values()) * count // total
            for term, times in Counter(TERM.findall(lowered(text))).items():
                if c[term]:
                    w = math.floor(1000 * math.log((2 * count + 2) / (2 * sum(term in d for _, d in docs) + 1)))
                    score += times * w * (10**9 * c[term] // (1000 * c[term] + 8 * m))
            if score > 0:
                scored.append((-score, i is None, i, score))
        out |= {(item, rank + 1, i, s) for rank, (_, _, i, s) in enumerate(sorted(scored, key=lambda x: x[:2] + (x[2] or 0,))[:10])}
    return out


@pytest.mark.parametrize("block", [lexical_search.BLOCK_TERMS, 40])
def test_search_equals_brute_force(spark, monkeypatch, block):
    """Also with the items dealt to several blocks."""
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", block)
    monkeypatch.setattr(lexical_search, "HELD", 500)
    draw = np.random.default_rng(11)
    vocabulary = [f"{c}{i}é" if i % 5 == 0 else f"{c}{i}" for c in "aB" for i in range(30)] + ["ÀX", "日本"]
    rows = [(int(i), draw.choice([" ", "-", "\n", "€ "]).join(draw.choice(vocabulary, draw.integers(0, 60)))) for i in range(150)]
    rows += [(150, None), (151, "?!"), (7, rows[3][1]), (8, rows[3][1]), (8, rows[3][1]), (None, rows[3][1]), (152, "a1 " * 200_000)]
    items = [(int(i), " ".join(draw.choice(vocabulary[: 8 + i], 12))) for i in range(25)]
    items += [(25, None), (26, ""), (27, "unknown"), (28, rows[3][1]), (28, rows[3][1]), (None, "a1 a2")]
    asked = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, doc_id long, score long")
    found = lexical_search.search(docs_of(spark, rows), asked).collect()
    wanted = brute_search(rows, items)
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, wanted)) or {tuple(r) for r in found} == wanted
    assert len({(r.item_id, r["rank"]) for r in found}) == len(found) > 200


def test_search_without_rows(spark):
    asked = spark.createDataFrame([(1, "a1")], "item_id long, text string")
    assert lexical_search.search(docs_of(spark, []), asked).collect() == []
    assert lexical_search.search(docs_of(spark, [(1, "a1")]), asked.limit(0)).collect() == []


def test_shared_sets_save_additions():
    draw = np.random.default_rng(2)
    common = draw.choice(500, 40, replace=False)
    rows = [(key, int(term), int(draw.integers(1, 3))) for key in range(60) for term in {*draw.choice(common, 15), *draw.choice(500, 8)}]
    graph = lexical_search.mine(pd.DataFrame(rows, columns=["key", "term", "times"]))
    plan = lexical_search.Plan(list(graph.itertuples()))
    partial = draw.integers(0, 1000, (len(plan.terms), 7))
    wanted = defaultdict(lambda: np.zeros(7, np.int64))
    for key, term, times in rows:
        wanted[key] += times * partial[np.searchsorted(plan.terms, np.uint64(term))]
    assert (plan.scores(partial) == np.stack([wanted[k] for k in plan.keys])).all()
    assert len(plan.rounds) > 1 and plan.additions() < 0.8 * (len(rows) - len(plan.keys))
