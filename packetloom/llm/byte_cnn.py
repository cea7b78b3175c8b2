"""A convolutional network over bytes in NumPy: embedding, filters of several widths, max pooling, softmax.

Texts are cut into windows of fixed length; groups of windows belong to one example and are pooled
together, so one group per window classifies windows and one group per text classifies whole texts.
Filters narrower than the widest are zero-padded, so a block of windows is one matrix product.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Bytes per matrix product: the widest intermediate stays within a few tens of megabytes.
_BYTES = 1 << 16
_LAGS = range(2, 22)


def cut_windows(texts: list[bytes], size: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """Zero-padded windows that cover every byte of every text (one empty window for an empty text), and whose they are."""
    counts = np.array([max(1, -(-(len(t) - size) // stride) + 1) for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), counts)
    out = np.zeros((len(owner), size), np.uint8)
    row = 0
    for text, count in zip(texts, counts):
        data = np.frombuffer(text, np.uint8)
        whole = max(0, (len(data) - size) // stride + 1) if len(data) >= size else 0
        if whole:
            out[row : row + whole] = np.lib.stride_tricks.sliding_window_view(data, size)[::stride]
        for at in range(whole, count):
            part = data[at * stride : at * stride + size]
            out[row + at, : len(part)] = part
        row += count
    return out, owner


def repeats(windows: np.ndarray) -> np.ndarray:
    """Whether the four bytes that end here stood a few bytes earlier in the window, too."""
    found = np.zeros(windows.shape, bool)
    for lag in _LAGS:
        same = windows[:, lag:] == windows[:, :-lag]
        run = same[:, 3:] & same[:, 2:-1] & same[:, 1:-2] & same[:, :-3]
        found[:, lag + 3 :] |= run & (windows[:, lag + 3 :] > 0)
    return found


@dataclass
class ByteCNN:
    """``widths`` filters of each width over an embedding of bytes and, if asked, a repetition channel."""

    classes: list
    table: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    top: np.ndarray
    top_bias: np.ndarray
    mask: np.ndarray
    repetition: bool

    @classmethod
    def fresh(cls, classes: list, widths: tuple[int, ...], per_width: int, embedding: int, repetition: bool, seed: int) -> ByteCNN:
        draw = np.random.default_rng(seed)
        channels, count, widest = embedding + repetition, per_width * len(widths), max(widths)
        mask = np.zeros((widest, channels, count), np.float32)
        for i, width in enumerate(widths):
            mask[:width, :, i * per_width : (i + 1) * per_width] = 1
        mask = mask.reshape(widest * channels, count)
        table = draw.normal(0, 1, (256, embedding)).astype(np.float32)
        table[0] = 0
        filters = draw.normal(0, 1, mask.shape).astype(np.float32) * mask / np.sqrt(mask.sum(axis=0))
        top = draw.normal(0, 1, (count, len(classes))).astype(np.float32) / np.sqrt(count)
        zeros = np.zeros(count, np.float32), np.zeros(len(classes), np.float32)
        return cls(classes, table, filters.astype(np.float32), zeros[0], top, zeros[1], mask, repetition)

    def _patches(self, windows: np.ndarray) -> np.ndarray:
        embedded = self.table[windows]
        if self.repetition:
            embedded = np.concatenate([embedded, repeats(windows)[..., None].astype(np.float32)], axis=2)
        widest = len(self.filters) // embedded.shape[2]
        seen = np.lib.stride_tricks.sliding_window_view(embedded, widest, axis=1)
        return np.ascontiguousarray(seen.transpose(0, 1, 3, 2)).reshape(len(windows), -1, len(self.filters))

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        """Largest response of every filter in every window."""
        step = max(1, _BYTES // windows.shape[1])
        out = np.empty((len(windows), self.filters.shape[1]), np.float32)
        for at in range(0, len(windows), step):
            out[at : at + step] = (self._patches(windows[at : at + step]) @ self.filters).max(axis=1)
        return np.maximum(out + self.bias, 0)

    def log_probabilities(self, features: np.ndarray) -> np.ndarray:
        scores = (features @ self.top + self.top_bias).astype(np.float64)
        scores -= scores.max(axis=1, keepdims=True)
        return scores - np.log(np.exp(scores).sum(axis=1, keepdims=True))

    def fit(self, windows: np.ndarray, owner: np.ndarray, wanted: np.ndarray, epochs: int, batch: int, rate: float, seed: int) -> ByteCNN:
        """Adam on the cross entropy of examples; ``owner`` (sorted) names the example of each window."""
        draw = np.random.default_rng(seed)
        starts = np.searchsorted(owner, np.arange(len(wanted) + 1))
        names = ("table", "filters", "bias", "top", "top_bias")
        moments = {n: [np.zeros_like(getattr(self, n)), np.zeros_like(getattr(self, n))] for n in names}
        step, steps = 0, epochs * -(-len(wanted) // batch)
        for _ in range(epochs):
            order = draw.permutation(len(wanted))
            for at in range(0, len(order), batch):
                chosen = order[at : at + batch]
                rows = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in chosen])
                counts = starts[chosen + 1] - starts[chosen]
                step += 1
                slopes = self._slopes(windows[rows], counts, wanted[chosen])
                pace = rate * (1 - (step - 1) / steps)
                for name, slope in zip(names, slopes):
                    first, second = moments[name]
                    first += 0.1 * (slope - first)
                    second += 0.001 * (slope * slope - second)
                    shift = first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
                    setattr(self, name, (getattr(self, name) - pace * shift).astype(np.float32))
                self.filters *= self.mask
                self.table[0] = 0
        return self

    def _slopes(self, windows: np.ndarray, counts: np.ndarray, wanted: np.ndarray) -> list[np.ndarray]:
        # A few windows at a time; of a long text, too, only the winning places are kept.
        step = max(1, _BYTES // windows.shape[1])
        best = np.empty((len(windows), self.filters.shape[1]), np.int64)
        peak = np.empty(best.shape, np.float32)
        for at in range(0, len(windows), step):
            response = self._patches(windows[at : at + step]) @ self.filters
            best[at : at + step] = response.argmax(axis=1)
            peak[at : at + step] = np.take_along_axis(response, best[at : at + step, None], axis=1)[:, 0]
        # Pool the windows of an example; remember which window won.
        firsts = np.r_[0, np.cumsum(counts)[:-1]]
        owner = np.repeat(np.arange(len(counts)), counts)
        top = np.maximum.reduceat(peak, firsts, axis=0)
        filters = np.arange(peak.shape[1])
        winner = np.zeros(top.shape, np.int64)
        hit_row, hit_filter = np.nonzero(peak == top[owner])
        winner[owner[hit_row], hit_filter] = hit_row
        features = np.maximum(top + self.bias, 0)
        error = np.exp(self.log_probabilities(features)).astype(np.float32)
        error[np.arange(len(wanted)), wanted] -= 1
        error /= len(wanted)
        back = (error @ self.top.T) * (features > 0)
        place = best[winner, filters]
        channels = self.table.shape[1] + self.repetition
        widest = len(self.filters) // channels
        read = windows[winner[:, :, None], place[:, :, None] + np.arange(widest)]
        won = self.table[read]
        if self.repetition:
            rows, back_to = np.unique(winner, return_inverse=True)
            marks = repeats(windows[rows])[back_to.reshape(winner.shape)[:, :, None], place[:, :, None] + np.arange(widest)]
            won = np.concatenate([won, marks[..., None].astype(np.float32)], axis=3)
        slope_filters = np.einsum("nfk,nf->kf", won.reshape(*winner.shape, -1), back)
        sent = (back[:, :, None] * self.filters.T[None]).reshape(*back.shape, widest, channels)[..., : self.table.shape[1]]
        slope_table = np.zeros_like(self.table)
        np.add.at(slope_table, read.ravel(), sent.reshape(-1, self.table.shape[1]))
        return [slope_table, slope_filters, back.sum(axis=0), features.T @ error, error.sum(axis=0)]
