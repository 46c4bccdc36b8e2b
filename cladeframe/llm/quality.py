"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded, learned filters run over every position of the whole text, and each
filter is max-pooled over overlapping chunks (two blocks each, one block apart). The
largest and the mean chunk value of each filter are combined into one probability.

Training takes a bounded sample of labelled rows (`samples.PER_CLASS` a class); scoring
runs inside tasks on Arrow batches, so nothing of the corpus passes through the driver.

Defined results: null and empty texts are texts of no byte and get the score that the
network gives those; without labelled rows of both classes every score is the share of
label 1 (0.5 if nothing is labelled). Other columns stay as they are; one that has the
name of the new column is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .samples import LONGEST_TEXT, PER_CLASS, Adam, class_weights, fitted_in_task, flat_bytes, labelled, one_each, sigmoid

WIDTH = 6
DIM = 8
FILTERS = 16
BLOCK = 128
SLAB = 64 * BLOCK
EPOCHS = 10
BATCH = 24
FOLDS, HELD_OUT = 5, 0


class ByteConv:
    """The network; `share` stands in for it when it could not be trained."""

    def __init__(self, share: float = 0.5, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.share, self.trained = share, False
        self.embed = rng.normal(0, 0.5, (256, DIM)).astype(np.float32)
        self.embed[0] = 0
        self.filters = rng.normal(0, (WIDTH * DIM) ** -0.5, (FILTERS, WIDTH * DIM)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.shift = np.zeros(1, np.float32)

    def _blocks(self, flat: np.ndarray, starts: np.ndarray):
        """Texts laid out in whole blocks, each with room for one last window."""
        n = np.diff(starts)
        blocks = (n + WIDTH) // BLOCK + 1
        first = np.concatenate(([0], np.cumsum(blocks)))
        padded = np.zeros(first[-1] * BLOCK + WIDTH, np.uint8)
        for i in range(len(n)):
            at = first[i] * BLOCK
            padded[at : at + n[i]] = flat[starts[i] : starts[i + 1]]
        return padded, first

    def _windows(self, padded: np.ndarray, start: int, stop: int) -> np.ndarray:
        x = self.embed[padded[start : stop + WIDTH - 1]]
        view = np.lib.stride_tricks.as_strided(
            x, (stop - start, WIDTH * DIM), (x.strides[0], x.strides[1])
        )
        return np.ascontiguousarray(view)

    def _pooled(self, padded: np.ndarray, first: np.ndarray, where: bool = False):
        """Each filter's largest value in each block, and the position that has it.

        The last windows of a text's last block would reach into the next text; they
        count as padding, which embeds to zero.
        """
        total = (len(padded) - WIDTH) // BLOCK
        last = np.zeros(total, bool)
        last[first[1:] - 1] = True
        top = np.empty((FILTERS, total), np.float32)
        at = np.empty((FILTERS, total), np.int64) if where else None
        for start in range(0, total * BLOCK, SLAB):
            stop = min(start + SLAB, total * BLOCK)
            values = (self.filters @ self._windows(padded, start, stop).T).reshape(FILTERS, -1, BLOCK)
            b = slice(start // BLOCK, stop // BLOCK)
            values[:, last[b], BLOCK - WIDTH + 1 :] = 0
            if where:
                arg = values.argmax(2)
                at[:, b] = arg + (np.arange(b.start, b.stop) * BLOCK)[None, :]
                top[:, b] = np.take_along_axis(values, arg[:, :, None], 2)[:, :, 0]
            else:
                top[:, b] = values.max(2)
        return top, at

    @staticmethod
    def _chunks(top: np.ndarray, first: np.ndarray):
        """Chunks of two neighbouring blocks: which block has the larger value, chunk counts."""
        n = top.shape[1]
        right = np.minimum(np.arange(n) + 1, n - 1)
        last = first[1:] - 1
        right[last] = last
        alone = np.diff(first) == 1
        is_chunk = np.ones(n, bool)
        is_chunk[last[~alone]] = False
        pick = np.where(top[:, right] > top, right, np.arange(n))
        return pick, is_chunk, np.maximum(np.diff(first) - 1, 1)

    def _features(self, top: np.ndarray, first: np.ndarray):
        pick, is_chunk, counts = self._chunks(top, first)
        act = np.maximum(top + self.bias[:, None], 0)
        chunk = np.where(is_chunk, np.take_along_axis(act, pick, 1), 0)
        largest = np.maximum.reduceat(act, first[:-1], axis=1)
        mean = np.add.reduceat(chunk, first[:-1], axis=1) / counts
        return np.concatenate((largest, mean)), act, pick, is_chunk, counts

    def score(self, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        if not self.trained or len(starts) < 2:
            return np.full(len(starts) - 1, self.share)
        padded, first = self._blocks(flat, starts)
        features = self._features(self._pooled(padded, first)[0], first)[0]
        return sigmoid((self.out @ features + self.shift).astype(np.float64))

    def fit(self, texts: list[bytes], y: np.ndarray, weights: np.ndarray, seed: int = 5) -> ByteConv:
        rng = np.random.default_rng(seed)
        params = [self.embed, self.filters, self.bias, self.out, self.shift]
        adam = Adam(params, 0.004)
        for epoch in range(EPOCHS):
            adam.rate = 0.004 * (1 - epoch / EPOCHS) + 0.0004
            order = rng.permutation(len(texts))
            for k in range(0, len(order), BATCH):
                ids = order[k : k + BATCH]
                flat = np.frombuffer(b"".join(texts[i] for i in ids), np.uint8)
                starts = np.concatenate(([0], np.cumsum([len(texts[i]) for i in ids])))
                adam.step(self._gradients(flat, starts, y[ids], weights[ids]))
                self.embed[0] = 0
        self.trained = True
        return self

    def _gradients(self, flat, starts, y, weights):
        padded, first = self._blocks(flat, starts)
        top, at = self._pooled(padded, first, where=True)
        features, act, pick, is_chunk, counts = self._features(top, first)
        p = sigmoid(self.out @ features + self.shift)
        slope = (weights * (p - y) / len(y)).astype(np.float32)
        d_out, d_shift = features @ slope, slope.sum(keepdims=True)
        doc = np.repeat(np.arange(len(y)), np.diff(first))
        # To each block: from the largest value of its text, and from the chunks that chose it.
        d_block = np.zeros_like(top)
        d_mean = np.where(is_chunk, (self.out[FILTERS:, None] * (slope / counts))[:, doc], 0)
        rows = np.repeat(np.arange(FILTERS), top.shape[1])
        np.add.at(d_block, (rows, pick.ravel()), d_mean.ravel())
        best = act == np.repeat(features[:FILTERS], np.diff(first), axis=1)
        ties = np.add.reduceat(best, first[:-1], axis=1)[:, doc]
        d_block += best / ties * (self.out[:FILTERS, None] * slope)[:, doc]
        d_block[act <= 0] = 0
        f, b = np.nonzero(d_block)
        grad = d_block[f, b]
        taps = padded[at[f, b][:, None] + np.arange(WIDTH)]
        x = self.embed[taps].reshape(len(f), -1)
        d_filters = np.zeros_like(self.filters)
        d_embed = np.zeros_like(self.embed)
        for i in range(FILTERS):
            mine = f == i
            d_filters[i] = grad[mine] @ x[mine]
        d_x = (grad[:, None] * self.filters[f]).reshape(-1, DIM)
        for j in range(DIM):
            d_embed[:, j] = np.bincount(taps.ravel(), d_x[:, j], 256)
        return [d_embed, d_filters, d_block.sum(1), d_out, d_shift]


def train_quality(
    docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, longest: int = LONGEST_TEXT
) -> ByteConv:
    """Fit the network, in a task, on a bounded sample of labelled rows outside the held-out fold."""
    picked, share = labelled(docs, labels, "quality", FOLDS, HELD_OUT, per_class, longest)
    model = ByteConv(share)
    if len(set(picked.values())) < 2:
        return model

    def fit(frame) -> dict:
        frame = frame.sort_values("doc_id", ignore_index=True)
        y = frame["_class"].to_numpy(np.float32)
        texts = [(t or "").encode() for t in frame["text"]]
        return vars(model.fit(texts, y, class_weights(y, share)))

    model.__dict__.update(fitted_in_task(one_each(docs, picked, ["text"]), fit))
    return model


def with_quality(docs: DataFrame, model: ByteConv, column: str = "score") -> DataFrame:
    """Add the probability of label 1 of every whole `text`."""

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        return pa.array(model.score(*flat_bytes(text)))

    return docs.withColumn(column, score("text"))
