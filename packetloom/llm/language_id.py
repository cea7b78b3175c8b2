"""Language identification by a convolutional network over the bytes of fixed-length windows.

The network learns from a bounded sample of labelled texts per language and is applied to all windows of
every whole text; the mean log probability of a text's windows gives its language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from packetloom.llm.byte_cnn import ByteCNN, cut_windows
from packetloom.llm.support import fold_of, materialize, text_blocks

UNKNOWN = "und"
FOLDS, HELD_OUT = 4, 2
WIDTHS, PER_WIDTH, EMBEDDING = (2, 3, 4, 5), 16, 8
WINDOW, OVERLAP = 256, 4
#: The sample that the network learns from: texts per language, whole.
TEXTS_PER_LANGUAGE = 400
EPOCHS, BATCH, RATE = 4, 64, 0.01
_LETTER = "\\p{L}"


def learn(docs: DataFrame) -> ByteCNN | None:
    """A network from labelled texts outside the held-out fold; None if there are none."""
    order = W.partitionBy("lang").orderBy("rank", "doc_id")
    usable = F.col("lang").isNotNull() & F.col("text").rlike(_LETTER) & (fold_of(F.col("doc_id"), FOLDS) != HELD_OUT)
    ranked = docs.where(usable).select("lang", "doc_id", F.xxhash64(F.lit(2), "doc_id", "text").alias("rank"), "text")
    # The ranks first, without texts: so a task sends numbers, and only the texts of the sample are looked up.
    drawn = ranked.drop("text").withColumn("n", F.row_number().over(order)).where(F.col("n") <= TEXTS_PER_LANGUAGE)
    drawn = F.broadcast(materialize(drawn.select("lang", "rank").distinct(), "language-sample"))
    sample = ranked.join(drawn, ["lang", "rank"]).select("lang", "text").distinct().collect()
    if not sample:
        return None
    sample.sort()
    classes = sorted({r.lang for r in sample})
    windows, owner = cut_windows([r.text.encode() for r in sample], WINDOW, WINDOW - OVERLAP)
    wanted = np.array([classes.index(r.lang) for r in sample])[owner]
    # The few bytes that end a text say little of its language.
    full = (windows > 0).sum(axis=1) >= np.minimum(32, (windows > 0).sum(axis=1).max())
    windows, wanted = windows[full], wanted[full]
    network = ByteCNN.fresh(classes, WIDTHS, PER_WIDTH, EMBEDDING, False, seed=2)
    return network.fit(windows, np.arange(len(windows)), wanted, EPOCHS, BATCH, RATE, seed=2)


def _predict(network: ByteCNN | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_blocks(batch.column("text")):
                ids = batch.column("doc_id").slice(first, len(texts))
                letters = batch.column("letters").slice(first, len(texts)).to_numpy(zero_copy_only=False)
                if network is None:
                    names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
                else:
                    windows, owner = cut_windows(texts, WINDOW, WINDOW - OVERLAP)
                    size = (windows > 0).sum(axis=1).astype(float)
                    logs = network.log_probabilities(network.pooled(windows)) * size[:, None]
                    starts = np.searchsorted(owner, np.arange(len(texts)))
                    mean = np.add.reduceat(logs, starts, axis=0) / np.maximum(1, np.add.reduceat(size, starts))[:, None]
                    shares = np.exp(mean - mean.max(axis=1, keepdims=True))
                    shares /= shares.sum(axis=1, keepdims=True)
                    names = [network.classes[i] if has else UNKNOWN for i, has in zip(shares.argmax(axis=1), letters)]
                    scores = np.where(letters, shares.max(axis=1), 0.0)
                yield pa.RecordBatch.from_arrays([ids, pa.array(names), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, network: ByteCNN | None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document.

    NULL texts and texts without a letter are ``und`` with score 0, and so is everything if nothing was
    labelled.  Repeated rows come back each; other columns are ignored; an empty table gives an empty table.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("text").rlike(_LETTER), F.lit(False)).alias("letters"))
    scored = rows.mapInArrow(_predict(network), "doc_id long, lang_pred string, score double")
    return scored.select("doc_id", (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")
