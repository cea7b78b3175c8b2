"""Toxic spans by a linear-chain conditional random field over words, and a document score from its marginals.

Training needs labelled tokens, but labels are per document.  A token of a toxic document is labelled
toxic if its word or its beginning is many times more frequent among toxic documents than among others;
all other tokens are not.  The field learns from words, beginnings and ends, so it also tags words it has
not seen.  Forward-backward marginals of all words of a whole text give spans and, through a logistic
regression on the strongest marginal and the expected number of toxic words, the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.shingles import LOWER, hashes_from, joined, mix, running_sums, shingle_sets, word_spans
from packetloom.llm.support import fold_of, labelled_sample, text_blocks, texts_of

FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
#: The sample that the field learns from: documents of each label, with their whole texts.
TEXTS_PER_LABEL = 1000
TABLE_BITS = 18
PREFIXES, SUFFIXES = (3, 4, 5, 6, 7, 8), (3, 4)
# A feature marks toxic tokens if it is this many times more frequent among toxic documents.
ODDS = 15.0
SEGMENT = 32
EPOCHS, BATCH, RATE, DECAY = 4, 256, 0.05, 1e-5
_SPAN = 64
_ORDERS = np.random.default_rng(40).integers(0, 1 << 64, 3, np.uint64) | np.uint64(1)
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[33:48] = _PUNCTUATION[58:65] = _PUNCTUATION[91:97] = _PUNCTUATION[123:127] = True


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lowered bytes, begin and end of every word without outer punctuation, and each text's first word."""
    data, offsets = joined(texts)
    if not len(data):
        return data, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    begins, ends = word_spans(data, offsets[:-1])
    firsts = np.searchsorted(begins, offsets)
    solid = ~_PUNCTUATION[data]
    places = np.arange(len(data))
    last = np.maximum.accumulate(np.where(solid, places, -1))
    next_ = np.minimum.accumulate(np.where(solid, places, len(data))[::-1])[::-1]
    inner = next_[begins] < ends
    begins, ends = np.where(inner, next_[begins], begins), np.where(inner, last[ends - 1] + 1, ends)
    return LOWER[data], begins, ends, firsts


def features(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Table places of the word, its beginnings and its ends, a row per word; 0 where it is too short."""
    sums = running_sums(data)
    sizes = ends - begins
    out = np.zeros((len(begins), 1 + len(PREFIXES) + len(SUFFIXES)), np.int32)
    spans = [(begins, ends, None)]
    spans += [(begins, np.minimum(begins + k, ends), k) for k in PREFIXES]
    spans += [(np.maximum(ends - k, begins), ends, k) for k in SUFFIXES]
    for column, (begin, end, least) in enumerate(spans):
        place = (mix(hashes_from(sums, begin, end) + np.uint64(column)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        out[:, column] = place if least is None else np.where(sizes > least, place, 0)
    return out


def _scan(m00: np.ndarray, m01: np.ndarray, m10: np.ndarray, m11: np.ndarray, begin: float) -> np.ndarray:
    """State ratio after every step of a chain of 2 x 2 matrices, in two levels: products of spans, then
    all spans at once from the ratio that each begins with."""
    count = len(m00)
    rows = -(-count // _SPAN)

    def shaped(values: np.ndarray, fill: float) -> np.ndarray:
        padded = np.full(rows * _SPAN, fill, np.float64)
        padded[:count] = values
        return np.ascontiguousarray(padded.reshape(rows, _SPAN).T)

    a, b, c, d = shaped(m00, 1), shaped(m01, 0), shaped(m10, 0), shaped(m11, 1)
    p, q, r, s = np.ones(rows), np.zeros(rows), np.zeros(rows), np.ones(rows)
    for step in range(_SPAN):
        p, q, r, s = p * a[step] + q * c[step], p * b[step] + q * d[step], r * a[step] + s * c[step], r * b[step] + s * d[step]
        scale = 1 / (p + q + r + s)
        p, q, r, s = p * scale, q * scale, r * scale, s * scale
    starts = []
    for p1, q1, r1, s1 in zip(p.tolist(), q.tolist(), r.tolist(), s.tolist()):
        starts.append(begin)
        begin = min(max((q1 + begin * s1) / max(p1 + begin * r1, 1e-300), 1e-100), 1e100)
    ratio, out = np.array(starts), np.empty((_SPAN, rows))
    for step in range(_SPAN):
        ratio = np.clip((b[step] + ratio * d[step]) / (a[step] + ratio * c[step]), 1e-100, 1e100)
        out[step] = ratio
    return out.T.ravel()[:count]


@dataclass
class Field:
    """Weights of features for a toxic word, log weights of transitions and of a toxic first word."""

    weights: np.ndarray
    moves: np.ndarray
    first: float
    logistic: np.ndarray

    def chain(self, scores: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Forward and backward ratios (toxic : other) of every word, and the step matrices."""
        emit = np.exp(np.clip(scores, -30, 30))
        moves = np.exp(self.moves)
        m00, m10 = np.where(starts, 1.0, moves[0, 0]), np.where(starts, 1.0, moves[1, 0])
        begin = np.exp(self.first)
        m01, m11 = np.where(starts, begin, moves[0, 1]) * emit, np.where(starts, begin, moves[1, 1]) * emit
        forward = _scan(m00, m01, m10, m11, 1.0)
        # Backward: the step into the next word, from the end; behind a text's last word both states are alike.
        n00, n01, n10, n11 = (np.r_[m[1:], 1.0][::-1] for m in (m00, m01, m10, m11))
        backward = _scan(n00, n10, n01, n11, 1.0)[::-1]
        return forward, backward, [m00, m01, m10, m11]

    def marginals(self, places: np.ndarray, starts: np.ndarray) -> np.ndarray:
        if not len(places):
            return np.zeros(0)
        forward, backward, _ = self.chain(self.weights[places].sum(axis=1), starts)
        odds = forward * backward
        return odds / (1 + odds)

    def slopes(self, places: np.ndarray, starts: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Gradient of the negative log likelihood: expected minus observed counts."""
        forward, backward, (m00, m01, m10, m11) = self.chain(self.weights[places].sum(axis=1), starts)
        odds = forward * backward
        expected = odds / (1 + odds)
        error = expected - tags
        weights = np.bincount(places.ravel(), np.repeat(error, places.shape[1]), 1 << TABLE_BITS)
        weights[0] = 0
        before = np.r_[1.0, forward[:-1]]
        joint = np.stack([m00, m01 * backward, before * m10, before * m11 * backward])
        joint /= joint.sum(axis=0)
        inner = ~starts
        earlier = np.r_[0, tags[:-1]]
        seen = np.stack([(1 - earlier) * (1 - tags), (1 - earlier) * tags, earlier * (1 - tags), earlier * tags])
        moves = (joint - seen)[:, inner].sum(axis=1).reshape(2, 2)
        return weights, moves, float(error[starts].sum())

    def document_features(self, marginals: np.ndarray, words: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """Strongest marginal and log expected number of different likely toxic words, a row per text.

        ``words`` tells words apart: one that a text repeats counts once, with its strongest marginal.
        """
        out = np.zeros((len(firsts) - 1, 3))
        out[:, 0] = 1
        filled = np.flatnonzero(firsts[1:] > firsts[:-1])
        if len(filled):
            out[filled, 1] = np.maximum.reduceat(marginals, firsts[filled])
        hot = np.flatnonzero(marginals >= 0.5)
        text = np.searchsorted(firsts, hot, "right") - 1
        order = np.lexsort((-marginals[hot], words[hot], text))
        hot, text = hot[order], text[order]
        new = np.ones(len(hot), bool)
        new[1:] = (text[1:] != text[:-1]) | (words[hot[1:]] != words[hot[:-1]])
        out[:, 2] = np.log1p(np.bincount(text[new], marginals[hot[new]], len(out)))
        return out

    def scores(self, marginals: np.ndarray, words: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.document_features(marginals, words, firsts) @ self.logistic))


def _without_copies(sample: list[tuple[bytes, int]]) -> list[tuple[bytes, int]]:
    """One text of each group of near copies, as far as any of three smallest shingles tells: a copied
    text would make all its words look typical of its label."""
    seen: set[tuple[int, int, int]] = set()
    kept = []
    for (text, label), shingles in zip(sample, shingle_sets([t for t, _ in sample], 5)):
        marks = {(label, i, int((shingles * factor).min())) for i, factor in enumerate(_ORDERS)} if len(shingles) else set()
        if not marks & seen:
            kept.append((text, label))
        seen |= marks
    return kept


def _weak_tags(places: np.ndarray, text: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """1 for words of toxic texts with a feature that is ODDS times more frequent among toxic texts."""
    totals = np.bincount(labels, minlength=2)
    counts = []
    for label in (0, 1):
        held = labels[text] == label
        count = np.zeros(1 << TABLE_BITS, np.int64)
        for column in range(places.shape[1]):
            pairs = np.unique(text[held] << TABLE_BITS | places[held, column])
            count += np.bincount(pairs & ((1 << TABLE_BITS) - 1), minlength=1 << TABLE_BITS)
        counts.append(count)
    others, toxic = counts
    least = max(2, totals[1] // 75)
    marked = (toxic >= least) & (toxic * totals[0] >= ODDS * (others + 0.5) * totals[1])
    marked[0] = False
    return marked[places].any(axis=1) & (labels[text] == 1)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + 0.1 * w
        w -= np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w)), slope)
    return w


def learn(docs: DataFrame, labels: DataFrame) -> Field | None:
    """A field from labelled texts outside the held-out fold; None unless both labels occur."""
    sample, totals = labelled_sample(docs, labels, "toxic", FOLDS, HELD_OUT, TEXTS_PER_LABEL)
    if len(totals) < 2:
        return None
    return fit(sample, totals)


def fit(sample: list[tuple[bytes, int]], totals: dict[int, int]) -> Field:
    """A field from texts with labels, both of which occur; ``totals`` are the labels' true shares."""
    sample = _without_copies(sample)
    marks = np.array([label for _, label in sample])
    data, begins, ends, firsts = words_of([text for text, _ in sample])
    places = features(data, begins, ends)
    text = np.repeat(np.arange(len(marks)), np.diff(firsts))
    tags = _weak_tags(places, text, marks).astype(float)
    starts = np.zeros(len(text), bool)
    starts[firsts[:-1][np.diff(firsts) > 0]] = True

    # Segments with a toxic word, and as many others from all texts.
    draw = np.random.default_rng(4)
    segments = np.arange(len(text)) // SEGMENT
    hot = np.bincount(segments, tags) > 0
    cold = draw.permutation(np.flatnonzero(~hot))[: max(2 * hot.sum(), 200)]
    chosen = draw.permutation(np.r_[np.flatnonzero(hot), cold])
    field = Field(np.zeros(1 << TABLE_BITS), np.zeros((2, 2)), 0.0, np.zeros(3))
    first, second, step = np.zeros(1 << TABLE_BITS), np.zeros(1 << TABLE_BITS), 0
    for _ in range(EPOCHS):
        for at in range(0, len(chosen), BATCH):
            rows = (chosen[at : at + BATCH, None] * SEGMENT + np.arange(SEGMENT)).ravel()
            rows = rows[rows < len(text)]
            begin = starts[rows] | (rows % SEGMENT == 0)
            weights, moves, opening = field.slopes(places[rows], begin, tags[rows])
            step += 1
            weights = weights / len(rows) + DECAY * field.weights
            first += 0.1 * (weights - first)
            second += 0.001 * (weights**2 - second)
            field.weights -= RATE * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
            field.moves -= 2.0 * moves / len(rows)
            field.first -= 2.0 * opening / max(1, begin.sum())
        draw.shuffle(chosen)
    share = np.array([totals[0], totals[1]]) / np.bincount(marks, minlength=2)
    x = field.document_features(field.marginals(places, starts), places[:, 0], firsts)
    field.logistic = _logistic(x, marks, share[marks] / share.min())
    return field


def _spans(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, firsts: np.ndarray, marginals: np.ndarray, offsets: np.ndarray) -> list:
    """Runs of likely toxic words of each text as (start, end, score), in code points of the text."""
    found: list[list] = [[] for _ in range(len(firsts) - 1)]
    hot = np.flatnonzero(marginals >= 0.5)
    if len(hot):
        letters = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
        text = np.searchsorted(firsts, hot, "right") - 1
        for word, of in zip(hot, text):
            base, spans = letters[offsets[of]], found[of]
            start, end = int(letters[begins[word]] - base), int(letters[ends[word]] - base)
            if spans and spans[-1]["last"] == word - 1:
                spans[-1].update(end=end, last=word, score=max(spans[-1]["score"], float(marginals[word])))
            else:
                spans.append({"start": start, "end": end, "score": float(marginals[word]), "last": word})
    return [[{k: v for k, v in s.items() if k != "last"} for s in spans] for spans in found]


_FIELDS = pa.schema(
    [("doc_id", pa.int64()), ("score", pa.float64()),
     ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))]
)


def _predict(field: Field | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in text_blocks(batch.column("text")):
                scores, spans = np.zeros(len(texts)), [[] for _ in texts]
                if field is not None:
                    data, begins, ends, firsts = words_of(texts)
                    starts = np.zeros(len(begins), bool)
                    starts[firsts[:-1][np.diff(firsts) > 0]] = True
                    places = features(data, begins, ends)
                    marginals = field.marginals(places, starts)
                    scores = field.scores(marginals, places[:, 0], firsts)
                    offsets = np.r_[0, np.cumsum([len(t) for t in texts])]
                    spans = _spans(data, begins, ends, firsts, marginals, offsets)
                ids = batch.column("doc_id").slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([ids, pa.array(scores), pa.array(spans, _FIELDS.field("spans").type)], schema=_FIELDS)

    return run


def tag(docs: DataFrame, field: Field | None) -> DataFrame:
    """``doc_id, held_out, score, predicted, spans`` of every document; spans are ``start, end, score`` in
    code points.

    NULL and empty texts have no words and the score of a text without a toxic word.  Without a field
    scores are 0.  Repeated rows come back each; other columns are ignored; an empty table gives an empty table.
    """
    scored = texts_of(docs).mapInArrow(
        _predict(field), "doc_id long, score double, spans array<struct<start: int, end: int, score: double>>"
    )
    return scored.select(
        "doc_id", (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "spans",
    )
