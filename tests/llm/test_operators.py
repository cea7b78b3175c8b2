"""Operators against brute-force versions and known answers."""

from __future__ import annotations

import re
from array import array
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest

from pyspark.sql import functions as F

from packetloom.llm import byte_cnn, decontaminate, line_dedup, near_dedup, packing, pii, pii_detect, shingles, toxicity
from packetloom.llm.boosted_trees import BoostedTrees
from packetloom.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles_of(text, width):
    w = words_of(text)
    if 0 < len(w) < width:
        return frozenset([tuple(w)])
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1))


def brute_components(texts, width, percent):
    sets = {i: shingles_of(t, width) for i, t in texts}
    head = {i: i for i in sets}

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * (n := len(sets[a] & sets[b])) >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                head[max(x, y)] = min(x, y)
    return {(i, len(sets[i]), find(i), find(i) == i) for i in ids}


def family_texts(seed=0):
    """Groups of copies with edits of varying strength, chains, and texts with common passages."""
    draw = np.random.default_rng(seed)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(400)]
    texts, n = [], 0
    for _ in range(12):
        base = list(draw.choice(vocabulary, draw.integers(30, 200)))
        for _ in range(draw.integers(1, 14)):
            copy = [w if draw.random() > draw.choice([0, 0.01, 0.04, 0.06]) else draw.choice(vocabulary) for w in base]
            texts.append((n := n + 1, draw.choice([" ", "\n", " \t"]).join(copy)))
            if draw.random() < 0.3:
                base = copy
    return texts + [(1000, "one"), (1001, "ONE"), (1002, "one two"), (1003, "one  two\n"), (1004, None), (1005, "")]


@pytest.mark.parametrize("width,dense", [(2, 0), (2, 3), (5, 3)])
def test_near_duplicates_equal_brute_force(spark, width, dense, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 8)  # buckets are cut into several pairs of blocks
    monkeypatch.setattr(near_dedup, "DENSE", dense)
    texts = family_texts(width)
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {tuple(r) for r in near_dedup.near_duplicates(df, width, 80).collect()}
    assert got == brute_components(texts, width, 80)


def test_word_hashes_follow_words():
    draw = np.random.default_rng(1)
    texts = ["".join(draw.choice(list("aAbBé \t\n\x0b.x"), 60)).encode() for _ in range(50)] + [b"", b" "]
    hashes, firsts, _, _ = shingles.hashed_words(texts)
    by_word = defaultdict(set)
    for i, text in enumerate(texts):
        words = words_of(text.decode())
        assert len(words) == firsts[i + 1] - firsts[i]
        for word, value in zip(words, hashes[firsts[i] : firsts[i + 1]]):
            by_word[word].add(int(value))
    assert all(len(v) == 1 for v in by_word.values())
    assert len({next(iter(v)) for v in by_word.values()}) == len(by_word)


def test_sketches_estimate_similarity():
    draw = np.random.default_rng(2)
    for share in (0.95, 0.9, 0.8, 0.7):
        size = 2000
        a = draw.integers(0, 1 << 64, size, np.uint64)
        common = int(2 * size * share / (1 + share))
        b = np.r_[a[:common], draw.integers(0, 1 << 64, size - common, np.uint64)]
        pair = near_dedup.odd_sketch(np.stack([near_dedup.minhash(a), near_dedup.minhash(b)])).view(np.uint64)
        bits = np.bitwise_count(pair[0] ^ pair[1]).sum()
        assert abs(near_dedup.estimated_similarity(bits) - share) < 0.08
        assert bits <= near_dedup.most_differing_bits(80) or share < 0.8


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(300, 299), (299, 300), (7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {**dict.fromkeys(range(1, 41), 1), **dict.fromkeys(range(100, 160), 100), 299: 299, 300: 299}


def brute_best_fit(lengths, capacity):
    rooms = []
    for length in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= length]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - length)
        else:
            rooms.append(capacity - length)
    return len(rooms), Counter(r for r in rooms)


def test_plan_is_best_fit_decreasing():
    draw = np.random.default_rng(3)
    for _ in range(60):
        capacity = int(draw.integers(5, 60))
        lengths = draw.integers(1, capacity + 1, draw.integers(1, 300)).tolist()
        runs = packing.plan_bins(Counter(lengths), capacity)
        used = defaultdict(list)
        for length, first, each, first_bin, offset in runs:
            later = [r[1] for r in runs if r[0] == length and r[1] > first]
            for k in range(first, min(later, default=lengths.count(length))):
                used[first_bin + (k - first) // each].append((offset + (k - first) % each * length, length))
        assert sum(map(len, used.values())) == len(lengths)
        for spans in used.values():
            at = 0
            for offset, length in sorted(spans):
                assert offset == at
                at += length
            assert at <= capacity
        rooms = Counter(capacity - sum(n for _, n in s) for s in used.values())
        assert (len(used), rooms) == brute_best_fit(lengths, capacity)


def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    draw = np.random.default_rng(4)
    texts = [(i, " ".join(draw.choice(["alpha", "bêta", "γάμμα", "12", "don't", "<|endoftext|>", "\n", "!?"], draw.integers(0, 400)))) for i in range(120)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    rows = packing.pack(df, capacity=256, with_ids=True).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for doc_id, text in texts:
        pieces = sorted(by_doc[doc_id], key=lambda r: r.piece)
        ids = [i for r in pieces for i in r.ids]
        assert ids == exact.encode(text, add_special_tokens=False).ids + [0]
        assert [r.piece for r in pieces] == list(range(len(pieces))) and all(r.length == 256 for r in pieces[1:])
        assert [r.start for r in pieces] == [sum(p.length for p in pieces[:k]) for k in range(len(pieces))]
        assert all(crc32(array("I", r.ids).tobytes()) == r.ids_crc32 for r in pieces)
    for held in by_sequence.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    assert len(by_sequence) == brute_best_fit([r.length for r in rows], 256)[0]


def test_templates_catch_other_parameters(spark):
    item = "Alice Baker has 12 apples and walks 5 km to the market where Bob buys 12 apples from her for 3 dollars each day."
    other = "Carol Miller has 40 apples and walks 7 km to the market where Tom buys 40 apples from her for 9 euros each day."
    broken = "Carol Miller has 40 apples and walks 40 km to the market where Carol buys 41 apples from her for 40 dollars each day."
    docs = [
        (1, f"Some words before it. {item} And some words after it."), (2, item.upper()), (3, f"Before. {other} After."),
        (4, f"Before. {broken} After."), (5, " ".join(reversed(item.split()))), (6, "and walks to the market " * 5), (7, item[: len(item) // 4]),
    ]
    found = decontaminate.contaminated(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(9, item)], "item_id long, text string")
    )
    rows = {r.doc_id: r for r in found.collect()}
    assert {1, 2, 3} <= set(rows) <= {1, 2, 3, 4} and rows[3].n_changed >= 5 and rows[1].n_changed == 0
    assert 4 not in rows or rows[4].n_changed == 0


def test_decontamination_equals_brute_force(spark):
    draw = np.random.default_rng(6)
    vocabulary = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne") for b in ("ro", "su", "ta", "vi", "we")]
    items = [(i, " ".join(draw.choice(vocabulary, draw.integers(3, 30)))) for i in range(30)]
    docs = []
    for i in range(80):
        text = list(draw.choice(vocabulary, 60))
        if i % 3 == 0:
            words = items[draw.integers(0, 30)][1].split()
            part = words[: max(1, int(len(words) * draw.choice([0.3, 0.6, 1])))]
            at = draw.integers(0, 60)
            text[at:at] = part
        docs.append((i, " ".join(text)))
    want = set()
    for i, text in docs:
        d = text.split()
        for j, item in items:
            w = item.split()
            size = min(8, len(w))
            covered = set()
            for q in range(len(w) - size + 1):
                if any(d[p : p + size] == w[q : q + size] for p in range(len(d) - size + 1)):
                    covered.update(range(q, q + size))
            if 100 * len(covered) >= 50 * len(w):
                want.add((i, j, len(covered)))
    found = decontaminate.contaminated(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    )
    assert {(r.doc_id, r.item_id, r.n_covered) for r in found.collect()} == want


def test_copies_of_short_texts_lose_their_lines(spark):
    texts = [(1, "only line"), (2, "only line"), (3, "only line\n \n"), (4, "one\ntwo"), (5, "one\n\ntwo"), (6, "two\none"), (7, "one\ntwo\nthree"),
             (8, "one\ntwo\nthree"), (9, "only line\nonly line"), (None, "one\ntwo"), (2, "only line"), (10, " "), (11, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    lost = {(2, ""), (3, " \n"), (5, ""), (8, ""), (4, "")}
    rows = line_dedup.dedup_lines(df, short_texts=True).collect()
    kept = {(i, t) for i, t in texts if i not in (2, 3, 4, 5, 8)}
    assert {(r.doc_id, r.text) for r in rows} == kept | lost and len(rows) == len(texts)
    assert all(r.n_removed == (r.n_lines if (r.doc_id, r.text) in lost else 0) for r in rows)
    assert {r.doc_id for r in line_dedup.drop_repeated_lines(df, short_texts=True).collect()} == {i for i, _ in kept}
    assert {r.doc_id for r in line_dedup.dedup_lines(df).where("n_removed > 0").collect()} == {8}


def test_surrogates_keep_type_and_stay_distinct(spark):
    lines = [f"Mail person{i}@firm{i % 5}.example.org or call +1 ({200 + i}) 555-{1000 + i}; card 4111 1111 1111 {1000 + i}." for i in range(60)]
    lines += ["Mr. John Smith met Dr. Anna Weber. Later Mr Smith left.", "Mr. JOHN SMITH; Mr. John Smith again, PERSON1@firm1.example.org", "Call +1 200 555 1000 now."]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.replace(df, "k").collect()}
    mapping = defaultdict(set)
    for i, text in enumerate(lines):
        for mention, entity in zip(pii_detect.detect(text), rows[i].entities):
            raw = text[entity.start : entity.end]
            mapping[mention.kind, mention.norm].add(entity.surrogate.lower() if mention.kind in ("email",) else re.sub(r"[ ()+-]", "", entity.surrogate).lower())
            if mention.kind in ("phone", "card"):
                assert re.sub(r"\d", "0", raw) == re.sub(r"\d", "0", entity.surrogate)
            assert raw.lower() not in rows[i].text.lower()
    assert all(len(v) == 1 for v in mapping.values())
    for kind in {k for k, _ in mapping}:
        made = [next(iter(v)) for (k, _), v in mapping.items() if k == kind]
        assert len(set(made)) == len(made)
    again = {r.doc_id: r.text for r in pii.replace(df, "k").collect()}
    assert again == {i: r.text for i, r in rows.items()}
    assert pii.luhn(pii.surrogate("card", "4111111111111111", 0, b"k")) == 0


def test_parts_of_names_and_numbers_keep_one_surrogate(spark):
    lines = [
        "Mary Smith met us. Later Smith left, and Mary's friend asked for SMITH's coat; Mary-Smith-Park.",
        "John F. Kennedy spoke. I saw Kennedy. A fact.", "Juan Carlos Garcia Lopez came; Garcia and Lopez and Carlos sat down.",
        "Mr Zed Smith called.", "Dr Zed Smith called, Zed said.", "Prof. Dr. J. R. Weber; Mr Kennedy Jones; Ms Taylor Green; Mr Baker",
        "Call +1 (200) 555-1000 now.", "Call (200) 555-1000 now or 200-555-1000.", "Smith is a common word here, and I am F.",
    ]
    rows = {r.doc_id: r for r in pii.replace(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"), "k").collect()}
    mapping = defaultdict(set)
    for i, line in enumerate(lines):
        for entity in rows[i].entities:
            mapping[line[entity.start : entity.end].lower()].add(entity.surrogate.lower())
    words = "mary smith john f kennedy juan carlos garcia lopez zed j r weber jones taylor green baker".split()
    phones = [p for p in mapping if p[-1].isdigit()]
    assert set(mapping) == {*words, *phones} and all(len(v) == 1 for v in mapping.values())
    made = [next(iter(mapping[w])) for w in words if len(w) > 1]
    assert len(set(made)) == len(made) and not set(made) & set(words)
    assert all(next(iter(mapping[w])) != w and len(next(iter(mapping[w]))) == 1 for w in "fjr")
    assert len(phones) == 3 and len({re.sub(r"\D", "", next(iter(mapping[p])))[-10:] for p in phones}) == 1
    assert rows[6].text.startswith("Call +1 (") and rows[8].text == lines[8]
    for i, gone in ((0, "mary smith"), (1, "john kennedy"), (2, "juan carlos garcia lopez"), (4, "zed smith")):
        assert not set(re.findall(r"[a-z]+", rows[i].text.lower())) & set(gone.split())
    kinds = {line[e.start : e.end].lower(): e.kind for i, line in enumerate(lines) for e in rows[i].entities}
    assert kinds["zed"] == "given-m-latin" and kinds["kennedy"] == "surname-latin" and kinds["carlos"] == "given-m-latin"


def test_names_of_all_kinds_share_one_pool(spark):
    kinds = ("surname-latin", "given-m-latin", "given-f-latin", "given-u-latin")
    entities = [(kinds[i % 4], f"name{i}") for i in range(120)] + [("given-f-latin", n.lower()) for n in pii.SURNAMES["latin"][:20]]
    rows = pii.assign(spark.createDataFrame(entities, "kind string, norm string"), b"k").collect()
    assert len({r.surrogate for r in rows}) == len(rows) == 140 and not {r.surrogate for r in rows} & {n for _, n in entities}


def test_colliding_names_draw_again(spark):
    entities = spark.createDataFrame([("surname-latin", f"name{i}") for i in range(300)], "kind string, norm string")
    rows = pii.assign(entities, b"k").collect()
    assert len(rows) == 300 and len({r.surrogate for r in rows}) == 300


def test_chain_marginals_equal_enumeration():
    draw = np.random.default_rng(7)
    scores = draw.normal(0, 2, 9)
    starts = np.array([1, 0, 0, 0, 1, 1, 0, 0, 0], bool)
    field = toxicity.Field(np.zeros(1), draw.normal(0, 1, (2, 2)), 0.4, np.zeros(3))
    forward, backward, _ = field.chain(scores, starts)
    got = forward * backward / (1 + forward * backward)
    weight = np.zeros(9)
    total = 0.0
    for code in range(1 << 9):
        y = [code >> t & 1 for t in range(9)]
        s = sum(scores[t] for t in range(9) if y[t])
        s += sum(0.4 * y[t] if starts[t] else field.moves[y[t - 1], y[t]] for t in range(9))
        total += np.exp(s)
        weight += np.exp(s) * np.array(y)
    assert np.allclose(got, weight / total)


def test_network_slopes_equal_differences():
    draw = np.random.default_rng(8)
    texts = [bytes(draw.integers(97, 101, n).tolist()) for n in (30, 70, 12)]
    windows, owner = byte_cnn.cut_windows(texts, 32, 24)
    network = byte_cnn.ByteCNN.fresh([0, 1], (2, 4), 3, 4, True, seed=1)
    for name in ("table", "filters", "bias", "top", "top_bias"):
        setattr(network, name, getattr(network, name).astype(np.float64))
    wanted, counts = np.array([0, 1, 1]), np.bincount(owner)

    def loss():
        pooled = network._patches(windows).astype(np.float64) @ network.filters
        firsts = np.r_[0, np.cumsum(counts)[:-1]]
        features = np.maximum(np.maximum.reduceat(pooled.max(axis=1), firsts, axis=0) + network.bias, 0)
        return -network.log_probabilities(features)[np.arange(3), wanted].mean()

    slopes = network._slopes(windows, counts, wanted)
    for name, slope in zip(("table", "filters", "bias", "top", "top_bias"), slopes):
        value = getattr(network, name)
        for index in [tuple(draw.integers(0, s) for s in value.shape) for _ in range(8)]:
            if name == "filters" and not network.mask[index]:
                continue
            held = value[index]
            value[index] = held + 1e-5
            up = loss()
            value[index] = held - 1e-5
            down = loss()
            value[index] = held
            assert abs((up - down) / 2e-5 - slope[index]) < 1e-4


def test_windows_cover_every_byte():
    for size in (0, 1, 511, 512, 513, 896, 897, 5000):
        text = bytes(1 + i % 255 for i in range(size))
        windows, owner = byte_cnn.cut_windows([b"x", text], 512, 384)
        own = windows[owner == 1]
        assert (own > 0).sum() >= size
        for at in range(size):
            assert any(text[at] == own[k, at - 384 * k] for k in range(len(own)) if 0 <= at - 384 * k < 512)


def test_trees_learn_an_interaction():
    draw = np.random.default_rng(9)
    x = draw.normal(0, 1, (2000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    trees = BoostedTrees(3).fit(x[:1000], y[:1000], trees=30)
    assert ((trees.probability(x[1000:]) > 0.5) == y[1000:]).mean() > 0.95


@pytest.mark.parametrize("turned", [False, True])
def test_an_id_with_several_texts_links_by_each(spark, turned):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(3, base), (5, "quite another text of its own"), (5, base + " more"), (None, base), (None, "alone here now")]
    df = spark.createDataFrame(rows[::-1] if turned else rows, "doc_id long, text string").coalesce(1)
    found = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(df, 2, 80).collect()]
    assert sorted(found, key=repr) == sorted(
        [(3, 59, 3, True), (5, 5, 5, True), (5, 60, 3, False), (None, 59, 3, False), (None, 2, None, True)], key=repr
    )


def test_links_just_above_the_threshold_are_found(spark):
    draw = np.random.default_rng(8)
    texts, pairs = [], 0
    for n in range(400):
        words = [f"v{x}" for x in draw.integers(0, 1 << 40, 150)]
        copy = list(words)
        for at in draw.permutation(150):
            copy[at] = "x" + copy[at]
            a, b = shingles_of(" ".join(words), 2), shingles_of(" ".join(copy), 2)
            if 0.80 <= (share := len(a & b) / len(a | b)) <= 0.82:
                break
        pairs += 0.80 <= share <= 0.82
        texts += [(2 * n, " ".join(words)), (2 * n + 1, " ".join(copy))] if 0.80 <= share <= 0.82 else []
    df = spark.createDataFrame(texts, "doc_id long, text string")
    kept = near_dedup.near_duplicates(df, 2, 80).where("kept").count()
    assert kept == pairs > 300


def test_block_rows_are_members(spark):
    rows = spark.range(3000).select((F.col("id") % 3).alias("key"), F.col("id").alias("node"), F.col("id").alias("component"))
    rows = rows.withColumns({"main": F.col("key"), "n_main": F.lit(1), "n": F.lit(1000)})
    assert near_dedup._in_blocks(rows).count() == 3000
