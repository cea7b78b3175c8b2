"""Document quality by a convolutional network over the bytes of overlapping chunks.

Chunks cover the whole text and overlap by a quarter; the largest response of every filter over all
chunks of a document goes into one probability.  Besides the byte itself, the filters see whether the
last bytes repeat what stood shortly before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.byte_cnn import ByteCNN, cut_windows
from packetloom.llm.support import fold_of, labelled_sample, text_blocks, texts_of

FOLDS, HELD_OUT = 3, 1
WIDTHS, PER_WIDTH, EMBEDDING = (3, 5), 24, 8
CHUNK, STRIDE = 512, 384
#: The sample that the network learns from: documents of each label, with their whole texts.
TEXTS_PER_LABEL = 1000
EPOCHS, BATCH, RATE = 5, 32, 0.01
THRESHOLD = 0.5


def learn(docs: DataFrame, labels: DataFrame) -> ByteCNN | None:
    """A network from labelled texts outside the held-out fold; None unless both labels occur.

    Labels are sampled evenly; the output bias is then moved so that scores fit the labels' true shares.
    """
    sample, totals = labelled_sample(docs, labels, "quality", FOLDS, HELD_OUT, TEXTS_PER_LABEL)
    if len(totals) < 2:
        return None
    windows, owner = cut_windows([text for text, _ in sample], CHUNK, STRIDE)
    wanted = np.array([label for _, label in sample])
    network = ByteCNN.fresh([0, 1], WIDTHS, PER_WIDTH, EMBEDDING, True, seed=8)
    network.fit(windows, owner, wanted, EPOCHS, BATCH, RATE, seed=8)
    drawn = np.bincount(wanted, minlength=2)
    network.top_bias += np.log([totals[0] / drawn[0], totals[1] / drawn[1]]).astype(np.float32)
    return network


def _predict(network: ByteCNN | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_blocks(batch.column("text")):
                scores = np.full(len(texts), 0.5)
                if network is not None:
                    windows, owner = cut_windows(texts, CHUNK, STRIDE)
                    starts = np.searchsorted(owner, np.arange(len(texts)))
                    pooled = np.maximum.reduceat(network.pooled(windows), starts, axis=0)
                    scores = np.exp(network.log_probabilities(pooled))[:, 1]
                ids = batch.column("doc_id").slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([ids, pa.array(scores)], names=["doc_id", "score"])

    return run


def score_quality(docs: DataFrame, network: ByteCNN | None) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document.

    NULL and empty texts are one chunk of padding.  Without a network every score is 0.5.  Repeated rows
    come back each; other columns are ignored; an empty table gives an empty table.
    """
    scored = texts_of(docs).mapInArrow(_predict(network), "doc_id long, score double")
    return scored.select(
        "doc_id", (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
