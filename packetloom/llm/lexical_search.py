"""Ranked lexical search of many queries at once, sharing what they have in common.

All items of a block are evaluated over all documents in one pass.  Their terms are mined for shared sets:
terms that occur in the same items (as often) are one node, and the nodes that most items hold together are
paired into new nodes, round by round, until no pair is held by two items.  The result is a graph in which every shared set is a sum of smaller ones.  Per document the partial score of each node is
accumulated once, level by level, and items add up the few nodes that cover them.

Documents pass twice: once for their length and the frequencies of the block's terms, which are written, and
once, from that table, for scores, when the corpus counts are known.  A task keeps ten results per item, so
what is shuffled does not grow with the documents of a task.  Items are dealt to blocks of bounded size, so
what is broadcast does not grow with their number.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from packetloom.llm.shingles import LOWER, joined, span_hashes
from packetloom.llm.support import materialize, text_blocks, texts_of

TOP = 10
# Terms of the items that are evaluated together, about; more items are further passes over the documents.
BLOCK_TERMS = 200_000
# Nodes of an item that are tried as partners of each of its nodes when shared sets are mined.
NEAREST = 64
# Partial scores that a task holds at a time.
HELD = 1 << 22

_TERM = np.ones(256, bool)
_TERM[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False


def hashed_terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Term hashes of all texts in order, and the first term of each text (one more at the end)."""
    data, offsets = joined(texts)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = _TERM[data]
    edge = np.diff(inside.astype(np.int8), prepend=0)
    starts = offsets[:-1][np.diff(offsets) > 0]
    begins = inside & (edge == 1)
    begins[starts] = inside[starts]
    ends = np.r_[~inside[1:], True] & inside
    ends[starts[1:] - 1] = inside[starts[1:] - 1]
    begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return span_hashes(LOWER[data], begins, ends), np.searchsorted(begins, offsets)


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``key, term, times`` of every item."""
    for batch in batches:
        for first, texts in text_blocks(batch.column("text")):
            hashes, starts = hashed_terms(texts)
            for at in range(len(texts)):
                terms, times = np.unique(hashes[starts[at] : starts[at + 1]], return_counts=True)
                key = np.full(len(terms), batch.column("key")[first + at].as_py(), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(terms.view(np.int64)), pa.array(times.astype(np.int64))], names=["key", "term", "times"]
                )


def mine(rows: pd.DataFrame) -> pd.DataFrame:
    """The sharing graph of a block's ``key, term, times`` as rows ``part, a, b, c``.

    ``atom``: term a, b times, belongs to node c.  ``pair``: node c is nodes a and b together; pairs come in
    rounds, so both are known before.  ``item``: the item of key a adds node c (b is its round).
    """
    holders: dict[tuple[int, int], list[int]] = {}
    for key, term, times in sorted(zip(rows.key, rows.term, rows.times)):
        holders.setdefault((term, times), []).append(key)
    # Terms of the same items are one node.
    classes: dict[tuple[int, ...], list[tuple[int, int]]] = {}
    for atom, keys in holders.items():
        classes.setdefault(tuple(keys), []).append(atom)
    ordered = sorted(classes, key=lambda keys: (-len(keys), keys))
    out = [("atom", term, times, node) for node, keys in enumerate(ordered) for term, times in classes[keys]]
    holding = {node: set(keys) for node, keys in enumerate(ordered)}
    level = 0
    while True:
        lists: dict[int, list[int]] = {}
        for node in sorted(holding, key=lambda n: (-len(holding[n]), n)):
            for key in holding[node]:
                lists.setdefault(key, []).append(node)
        counts: Counter = Counter()
        for held in lists.values():
            shared = [node for node in held if len(holding[node]) > 1]
            for lag in range(1, min(NEAREST, len(shared))):
                counts.update((min(x), max(x)) for x in zip(shared, shared[lag:]))
        taken: dict[int, set[int]] = {key: set() for key in lists}
        low = len(holding)
        for (left, right), times in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
            if times < 2:
                break
            keys = {k for k in holding[left] & holding[right] if not taken[k] & {left, right}}
            if len(keys) > 1:
                node = len(holding)
                out.append(("pair", left, right, node))
                holding[node] = keys
                for rest in (left, right):
                    holding[rest] -= keys
                for key in keys:
                    taken[key] |= {left, right, node}
        if len(holding) == low:
            break
        level += 1
        out.append(("round", level, len(holding), 0))
    out += [("item", key, 0, node) for key, held in lists.items() for node in held]
    return pd.DataFrame(out, columns=["part", "a", "b", "c"])


class Plan:
    """The sharing graph of a block as arrays."""

    def __init__(self, rows: list) -> None:
        atoms = sorted(((r.c, r.a, r.b) for r in rows if r.part == "atom"))
        self.atom_times = np.array([times for _, _, times in atoms], np.int64)
        atom_terms = np.array([term for _, term, _ in atoms], np.int64).view(np.uint64)
        self.terms = np.unique(atom_terms)
        self.atom_term = np.searchsorted(self.terms, atom_terms)
        nodes = np.array([node for node, _, _ in atoms], np.int64)
        self.class_starts = np.flatnonzero(np.diff(nodes, prepend=-1))
        pairs = sorted((r.c, r.a, r.b) for r in rows if r.part == "pair")
        self.nodes = len(self.class_starts) + len(pairs)
        bounds = [len(self.class_starts), *sorted(r.b for r in rows if r.part == "round")]
        parts = np.array(pairs, np.int64).reshape(-1, 3)
        first = len(self.class_starts)
        self.rounds = [parts[low - first : high - first] for low, high in zip(bounds, bounds[1:])]
        members = sorted((r.a, r.c) for r in rows if r.part == "item")
        self.keys = np.unique([key for key, _ in members]).astype(np.int64)
        self.item_nodes = np.array([node for _, node in members], np.int64)
        self.item_starts = np.flatnonzero(np.diff(np.array([key for key, _ in members], np.int64), prepend=members[0][0] - 1 if members else 0))

    def additions(self) -> int:
        """Additions per document, sharing included."""
        return len(self.atom_times) - len(self.class_starts) + sum(map(len, self.rounds)) + len(self.item_nodes) - len(self.keys)

    def scores(self, partial: np.ndarray) -> np.ndarray:
        """Scores of every item, from the terms' partial scores; one column per document."""
        held = np.empty((self.nodes, partial.shape[1]), np.int64)
        low = len(self.class_starts)
        np.add.reduceat(partial[self.atom_term] * self.atom_times[:, None], self.class_starts, axis=0, out=held[:low])
        for pairs in self.rounds:
            held[pairs[:, 0]] = held[pairs[:, 1]] + held[pairs[:, 2]]
        return np.add.reduceat(held[self.item_nodes], self.item_starts, axis=0)


def _frequencies(terms: np.ndarray):
    """``doc_id, n, terms, times`` of every document that has a term: its length and the wanted terms it holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for first, texts in text_blocks(batch.column("text")):
                hashes, starts = hashed_terms(texts)
                place = np.minimum(np.searchsorted(terms, hashes), max(len(terms) - 1, 0))
                wanted = np.flatnonzero(terms[place] == hashes) if len(terms) else np.zeros(0, np.int64)
                row = np.searchsorted(starts, wanted, side="right") - 1
                code, times = np.unique(row * max(len(terms), 1) + place[wanted], return_counts=True)
                row, term = np.divmod(code, max(len(terms), 1))
                length = np.diff(starts)
                kept = np.flatnonzero(length)
                offsets = np.r_[np.searchsorted(row, kept), len(row)].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(first, len(texts)).take(pa.array(kept)),
                        pa.array(length[kept].astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(term.astype(np.int32))),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(times.astype(np.int64))),
                    ],
                    names=["doc_id", "n", "terms", "times"],
                )

    return run


class _Best:
    """The TOP results per item so far: highest score first, equal scores by id, a missing id last."""

    def __init__(self, items: int) -> None:
        self.items = items
        self.least = np.ones(items, np.int64)
        self.item, self.score, self.doc = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, scores: np.ndarray, docs: np.ndarray) -> None:
        item, column = np.nonzero(scores >= self.least[:, None])
        item, score, doc = np.r_[self.item, item], np.r_[self.score, scores[item, column]], np.r_[self.doc, docs[column]]
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        firsts = np.searchsorted(item, np.arange(self.items))
        kept = np.arange(len(item)) - firsts[item] < TOP
        self.item, self.score, self.doc = item[kept], score[kept], doc[kept]
        full = np.bincount(self.item, minlength=self.items) == TOP
        lasts = np.searchsorted(self.item, np.arange(self.items), side="right") - 1
        self.least[full] = self.score[lasts[full]]


def _ranked(plan: Plan, weights: np.ndarray, documents: int, terms_in_all: int):
    """The TOP documents of the task for every item: ``key, score, doc_id``."""
    none = np.iinfo(np.int64).max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(len(plan.keys))
        step = max(16, HELD // (len(plan.terms) + len(plan.atom_times) + plan.nodes + len(plan.item_nodes)))
        for batch in batches:
            for first in range(0, batch.num_rows, step):
                part = batch.slice(first, step)
                # As Python integers where 64 bits could overflow: n is bounded by a text, N is not.
                slack = np.array([25 + 75 * n * documents // terms_in_all for n in part.column("n").to_pylist()], np.int64)
                held, times = part.column("terms"), part.column("times")
                row = np.repeat(np.arange(part.num_rows), held.value_lengths().to_numpy())
                term, tf = held.flatten().to_numpy(), times.flatten().to_numpy()
                partial = np.zeros((len(plan.terms), part.num_rows), np.int64)
                partial[term, row] = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * slack[row]))
                best.add(plan.scores(partial), part.column("doc_id").fill_null(none).to_numpy())
        doc = pa.array(best.doc, mask=best.doc == none)
        yield pa.RecordBatch.from_arrays([pa.array(plan.keys[best.item]), pa.array(best.score), doc], names=["key", "score", "doc_id"])

    return run


def search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ten best documents of every item, by a term weighting in integers.

    Terms are runs of letters, digits and non-ASCII characters with A-Z lowered.  NULL and empty texts have
    none: such documents count nowhere, such items (and items without any match) have no rows.  Repeated rows
    of ``docs`` are documents of their own, repeated items count once; an item that has several texts has ranks
    for each.  Equal scores go by ``doc_id``, a NULL id last.  Other columns are ignored; empty tables give an
    empty table.  All counts cover all documents.
    """
    spark = docs.sparkSession
    asked = items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
    asked = materialize(asked.withColumn("key", F.xxhash64("item_id", "text")), "items")
    terms = materialize(asked.select("key", "text").mapInArrow(_item_terms, "key long, term long, times long"), "item-terms")
    blocks = max(1, -(-terms.count() // BLOCK_TERMS))
    graph = terms.groupBy(F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block")).applyInPandas(
        lambda key, rows: mine(rows).assign(block=key[0]), "block long, part string, a long, b long, c long"
    )
    graph = materialize(graph, "sharing")
    texts = texts_of(docs)
    found = [_block(texts, Plan(rows)) for b in range(blocks) if (rows := graph.where(F.col("block") == b).collect())]
    empty = spark.createDataFrame([], "key long, score long, doc_id long")
    results = empty
    for part in found:
        results = results.union(part)
    best = W.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = results.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= TOP)
    return asked.drop("text").join(ranked, "key").select("item_id", "rank", "doc_id", "score")


def _block(texts: DataFrame, plan: Plan) -> DataFrame:
    """The results of every task for the items of one block."""
    schema = "doc_id long, n long, terms array<int>, times array<long>"
    held = materialize(texts.mapInArrow(_frequencies(plan.terms), schema), "frequencies")
    count, total = held.agg(F.count("*"), F.sum("n")).first()
    holders = held.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
    df = np.zeros(len(plan.terms), np.int64)
    df[[r.term for r in holders]] = [r["count"] for r in holders]
    weights = np.array([math.floor(1000 * math.log((2 * count + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    return held.mapInArrow(_ranked(plan, weights, count or 0, total or 1), "key long, score long, doc_id long")


ORACLE = r"""
WITH terms AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
wanted AS (SELECT item_id, term, count(*) AS times FROM asked GROUP BY 1, 2),
lengths AS (SELECT doc_id, count(*) AS n FROM terms GROUP BY 1),
corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM lengths),
held AS (SELECT doc_id, term, count(*) AS tf FROM terms WHERE term IN (SELECT term FROM wanted) GROUP BY 1, 2),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM held GROUP BY 1), corpus),
parts AS (
  SELECT h.doc_id, h.term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total))) AS part
  FROM held h JOIN weights USING (term) JOIN lengths USING (doc_id), corpus),
scores AS (
  SELECT item_id, doc_id, CAST(sum(times * part) AS BIGINT) AS score FROM wanted JOIN parts USING (term) GROUP BY 1, 2)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
WHERE rank <= 10
"""
