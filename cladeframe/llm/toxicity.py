"""Toxicity: a convolutional text classifier in numpy.

Words are hashed twice, each hash picks a row of its own small embedding, so that only a
word that meets a learned one in both tables looks like it. Filters of several widths run
over the whole sequence of words and are max-pooled into one probability. Decision
thresholds are calibrated by language; the score itself sees nothing but the text.

Every labelled document outside the held-out fold counts, in full. They are dealt by id to shards of
bounded size; counts of words, thresholds and the share of label 1 are sums over all shards. The network is
trained in rounds: each shard goes on from the common network in a task of its own, and the next common
network is the mean of theirs, by their texts. Words are hashed inside Spark and scored in tasks on Arrow batches.

Defined results: a text without words, null included, gets the score of an empty sequence;
without labelled rows of both classes every score is the share of label 1. A document labelled more than
once has its smallest label; of rows that repeat an id the smallest (lang, text) is learned from. A language
without enough calibration rows, null included, has the threshold of all languages
together. Other columns stay; those with the names of new ones are replaced.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.staging import counted, fresh_path, remove, stage
from .samples import Adam, flat_lists, sigmoid
from .selecting import named
from .words import crc_fold, plain_words

BUCKETS = 1 << 16
DIM = 6
WIDTHS = (1, 2, 3)
FILTERS = 8
EPOCHS = 12
BATCH = 32
# Words that are in one pass over the filters.
SLAB = 1 << 15
# Words of a training step, but for a longer text.
STEP_WORDS = 1 << 17
# Texts and words of a shard, about, and rounds of training when there are several.
SHARD_TEXTS, SHARD_WORDS = 1 << 14, 1 << 22
ROUNDS, ROUND_EPOCHS = 3, 2
# Pieces in which numbers of shards are added up.
SLICES = 16
SEED = 23
# A language gets a threshold of its own from this many calibration rows of either class.
CALIBRATION_ROWS = 20
FOLDS, HELD_OUT = 5, 0


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the lower-case words, in order."""
    return F.transform(plain_words(text), lambda w: F.xxhash64(w))


class WordConv:
    """The network; `share` stands in for it when it could not be trained."""

    def __init__(self, share: float = 0.5, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.share, self.trained = share, False
        self.embed = rng.normal(0, 0.05, (2 * BUCKETS, DIM)).astype(np.float32)
        self.filters = [
            rng.normal(0, (w * 2 * DIM) ** -0.5, (FILTERS, w * 2 * DIM)).astype(np.float32) for w in WIDTHS
        ]
        self.bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.out = rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32)
        self.shift = np.zeros(1, np.float32)
        self.thresholds: dict[str | None, float] = {}

    @staticmethod
    def buckets(hashes: np.ndarray) -> np.ndarray:
        """Rows of the two tables that a word uses."""
        h = hashes.astype(np.int64).view(np.uint64)
        low = (h & np.uint64(BUCKETS - 1)).astype(np.int64)
        high = (h >> np.uint64(48)).astype(np.int64) % BUCKETS + BUCKETS
        return np.stack((low, high), 1)

    @staticmethod
    def _layout(starts: np.ndarray):
        """Where each text's words go when every text is followed by the widest filter's gap."""
        n, gap = np.diff(starts), max(WIDTHS)
        first = np.concatenate(([0], np.cumsum(n + gap)))
        place = np.arange(starts[-1] - starts[0]) + np.repeat(np.arange(len(n)) * gap, n)
        return place, first

    def _pooled(self, pairs: np.ndarray, starts: np.ndarray, where: bool = False):
        """Each filter's largest value in each text, and where it is.

        A padding row embeds to zero, so a filter never falls below that of an empty text.
        Windows that begin in the padding after a text and reach the next one do not count.
        """
        place, first = self._layout(starts)
        own = np.stack((first[:-1], first[:-1] + np.diff(starts) + 1), 1).ravel()
        x = np.zeros((first[-1] + max(WIDTHS), 2 * DIM), np.float32)
        x[place] = self.embed[pairs].reshape(len(pairs), -1)
        tops, ats = [], []
        for width, filters in zip(WIDTHS, self.filters, strict=True):
            values = np.empty((FILTERS, first[-1]), np.float32)
            for a in range(0, first[-1], SLAB):
                b = min(a + SLAB, first[-1])
                view = np.lib.stride_tricks.as_strided(
                    x[a:], (b - a, width * 2 * DIM), (x.strides[0], x.strides[1])
                )
                values[:, a:b] = filters @ np.ascontiguousarray(view).T
            top = np.maximum.reduceat(values, own, axis=1)[:, ::2]
            tops.append(top)
            if where:
                spans, places = np.diff(first), np.arange(first[-1])
                at = [np.where(v == np.repeat(t, spans), places, first[-1]) for v, t in zip(values, top, strict=True)]
                ats.append(np.stack([np.minimum.reduceat(a, first[:-1]) for a in at]))
        return np.concatenate(tops), ats, x, place

    def score(self, hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return self.scores(lambda at: self.buckets(hashes[at]), starts)

    def scores(self, pairs: Callable[[slice], np.ndarray], starts: np.ndarray) -> np.ndarray:
        """Scores of texts; `pairs` gives the table rows of words by their places."""
        if not self.trained or len(starts) < 2:
            return np.full(len(starts) - 1, self.share)
        scores, k = np.empty(len(starts) - 1), 0
        while k < len(scores):  # texts of some 100,000 words at a time, or one longer text
            m = max(k + 1, int(np.searchsorted(starts, starts[k] + 100_000, "right")) - 1)
            top = self._pooled(pairs(slice(starts[k], starts[m])), starts[k : m + 1] - starts[k])[0]
            act = np.maximum(top + self.bias[:, None], 0)
            scores[k:m] = sigmoid((self.out @ act + self.shift).astype(np.float64))
            k = m
        return scores

    def fit(self, pairs, y, starts, epochs=range(EPOCHS), of: int = EPOCHS, seed: int = 5) -> WordConv:
        """Go on learning for some epochs `of` all; `pairs` gives the table rows of words by their places."""
        adam = Adam([*self.filters, self.bias, self.out, self.shift], 0.01)
        squares = np.full(len(self.embed), 1e-4, np.float32)
        sizes = np.diff(starts)
        for epoch in epochs:
            adam.rate = 0.01 * (1 - epoch / of) + 0.001
            order = np.random.default_rng((seed, epoch)).permutation(len(y))
            ends = np.cumsum(sizes[order])
            k = 0
            while k < len(order):
                m = int(np.searchsorted(ends, (ends[k - 1] if k else 0) + STEP_WORDS, "right"))
                ids = order[k : min(k + BATCH, max(k + 1, m))]
                words = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in ids])
                own = np.concatenate(([0], np.cumsum(sizes[ids])))
                self._step(adam, squares, pairs(words), own, y[ids])
                k += len(ids)
        self.trained = True
        return self

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, self.bias, self.out, self.shift]

    def flat(self) -> np.ndarray:
        """All parameters in a row."""
        return np.concatenate([p.ravel() for p in self.parameters()])

    def take(self, flat: np.ndarray) -> WordConv:
        """Parameters from such a row."""
        at = 0
        for p in self.parameters():
            p[...] = flat[at : at + p.size].reshape(p.shape)
            at += p.size
        self.trained = True
        return self

    @staticmethod
    def seen_in(pairs, starts, y) -> np.ndarray:
        """For each row of the tables the texts of label 1 and of label 0 that use it."""
        out, k = np.zeros((2, 2 * BUCKETS)), 0
        while k < len(y):  # a few texts at a time, or one longer text
            m = max(k + 1, int(np.searchsorted(starts, starts[k] + STEP_WORDS, "right")) - 1)
            own = pairs(slice(starts[k], starts[m]))
            doc = np.repeat(np.arange(k, m), np.diff(starts[k : m + 1]))
            for side in (0, 1):
                seen = np.unique(doc * 2 * BUCKETS + own[:, side])
                rows, label = seen % (2 * BUCKETS), y[seen // (2 * BUCKETS)]
                out[0] += np.bincount(rows, label, 2 * BUCKETS)
                out[1] += np.bincount(rows, 1 - label, 2 * BUCKETS)
            k = m
        return out

    def _seed_embedding(self, pairs, starts, y) -> None:
        self.seed_embedding(*self.seen_in(lambda at: pairs[at], starts, y), float(y.mean()))

    def seed_embedding(self, ones, zeros, share: float) -> None:
        """Start the first number of each row at its smoothed log odds over all texts learned from."""
        share = min(max(share, 0.01), 0.99)
        odds = np.log((ones + 8 * share) / (zeros + 8 * (1 - share))) - np.log(share / (1 - share))
        self.embed[:, 0] += 0.3 * odds.astype(np.float32)
        for i, filters in enumerate(self.filters):
            own = self.out[i * FILTERS : (i + 1) * FILTERS]
            filters[:, ::DIM] = np.abs(filters[:, ::DIM]) * np.sign(own)[:, None]

    def _step(self, adam, squares, pairs, starts, y) -> None:
        top, ats, x, place = self._pooled(pairs, starts, where=True)
        act = np.maximum(top + self.bias[:, None], 0)
        p = sigmoid(self.out @ act + self.shift)
        slope = ((p - y) / len(y)).astype(np.float32)
        d_top = np.where(act > 0, self.out[:, None] * slope, 0)
        row_of = np.full((len(x), 2), -1)
        row_of[place] = pairs
        grads, rows, steps = [], [], []
        for i, (width, filters) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            d = d_top[i * FILTERS : (i + 1) * FILTERS]
            taps = ats[i][:, :, None] + np.arange(width)
            seen = x[taps].reshape(FILTERS, len(y), -1)
            grads.append(np.einsum("fd,fdk->fk", d, seen))
            d_x = (d[:, :, None] * filters[:, None, :]).reshape(FILTERS, len(y), width, 2, DIM)
            used = row_of[taps]
            keep = (used >= 0) & (np.abs(d_x).max(-1) > 0)
            rows.append(used[keep])
            steps.append(d_x[keep])
        adam.step([*grads, d_top.sum(1), act @ slope, slope.sum(keepdims=True)])
        rows, steps = np.concatenate(rows), np.concatenate(steps)
        if len(rows):
            ids, back = np.unique(rows, return_inverse=True)
            total = np.stack([np.bincount(back, steps[:, j], len(ids)) for j in range(DIM)], 1)
            squares[ids] += (total * total).mean(1)
            self.embed[ids] -= (0.05 / np.sqrt(squares[ids]))[:, None] * total.astype(np.float32)

    def calibrate(self, counts: pd.DataFrame) -> None:
        """For each language the threshold with the best F1, nearest to 0.5, within 0.3 to 0.7.

        `counts` has for each lang and place in GRID how many texts are of label 1 and 0, score that much, and both.
        """

        def best(rows: pd.DataFrame) -> float:
            f1 = 2 * rows["both"] / np.maximum(1, rows["hit"] + rows["ones"])
            return float(min(zip(GRID[rows["at"]], f1, strict=True), key=lambda x: (-x[1], abs(x[0] - 0.5)))[0])

        whole = counts.groupby("at", as_index=False)[["ones", "zeros", "hit", "both"]].sum()
        self.thresholds = {None: best(whole) if len(whole) else 0.5}
        for lang, rows in counts.dropna(subset="lang").groupby("lang"):
            if rows[["ones", "zeros"]].to_numpy().min() >= CALIBRATION_ROWS:
                self.thresholds[lang] = best(rows.sort_values("at"))


GRID = np.linspace(0.3, 0.7, 17)


class Shard:
    """Texts of a shard: words packed in 32 bits, where each text begins, labels, languages, which calibrate."""

    def __init__(self, frame: pd.DataFrame):
        frame = frame.sort_values("doc_id", ignore_index=True)
        words = frame.pop("words")
        self.words = np.concatenate([np.asarray(w, np.int32) for w in words])
        self.starts = np.concatenate(([0], np.cumsum([len(w) for w in words])))
        self.y = frame["label"].to_numpy(np.float32)
        self.langs = [None if pd.isna(x) else str(x) for x in frame["lang"]]
        self.rest = frame["rest"].to_numpy(bool)

    def pairs(self, at) -> np.ndarray:
        """Rows of the two tables that words use."""
        packed = self.words[at].view(np.uint32)
        return np.stack((packed & np.uint32(BUCKETS - 1), (packed >> np.uint32(16)) + np.uint32(BUCKETS)), 1).astype(np.int64)

    def part(self, rest: bool) -> Shard:
        """Only the texts that calibrate, or only those that do not."""
        out, ids = Shard.__new__(Shard), np.flatnonzero(self.rest == rest)
        sizes = np.diff(self.starts)
        out.words = self.words[np.repeat(self.rest == rest, sizes)]
        out.starts = np.concatenate(([0], np.cumsum(sizes[ids])))
        out.y, out.langs, out.rest = self.y[ids], [self.langs[i] for i in ids], self.rest[ids]
        return out

    def packed(self) -> bytes:
        raw = pickle.dumps(vars(self), protocol=5)
        return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)

    @staticmethod
    def unpacked(data: bytes) -> Shard:
        out = Shard.__new__(Shard)
        out.__dict__.update(pickle.loads(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True, codec="zstd")))
        return out


def _learnable(docs: DataFrame, known: DataFrame) -> DataFrame:
    """One staged row per labelled document that may be learned from: doc_id, lang, words, label, rest."""
    own = named(docs.select("doc_id", F.struct("lang", "text").alias("row")), known.select("doc_id"))
    one = own.groupBy("doc_id").agg(F.min("row").alias("row"))
    # Sixteen bits from each end of the hash are all that is used of it.
    packed = F.transform(
        word_hashes(F.col("row.text")),
        lambda h: (F.shiftleft(F.shiftright(h, 48), 16).bitwiseOR(h.bitwiseAND(F.lit(BUCKETS - 1)))).cast("int"),
    )
    rest = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(5)) == 0
    rows = one.join(known, "doc_id").select(
        "doc_id", F.col("row.lang").cast("string").alias("lang"), packed.alias("words"), "label", rest.alias("rest")
    )
    learn = F.when(~F.col("rest"), F.col("label"))
    return stage(rows, texts=F.count(learn), ones=F.sum(learn), words=F.sum(F.size("words").cast("long")))


def _dealt(rows: DataFrame, parts: int) -> DataFrame:
    """The rows as packed shards (shard, packed), a file each."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"packed": [Shard(frame.drop(columns="shard")).packed()], "shard": frame["shard"].iloc[:1]})

    shard = F.pmod(F.xxhash64(F.lit(SEED + 1), "doc_id"), F.lit(parts)).cast("int").alias("shard")
    return rows.select("*", shard).groupBy("shard").applyInPandas(run, "packed binary, shard int")


def _total(shards: DataFrame, work: Callable[[Shard], tuple[int, np.ndarray]]) -> np.ndarray:
    """The mean of what `work` makes of the shards' texts to learn from, numbers in a row, weighed as it says.

    The rows of numbers travel and are added up in pieces; the driver gets the sum only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, data in zip(batch.column("shard").to_pylist(), batch.column("packed"), strict=True):
                weight, numbers = work(Shard.unpacked(data.as_py()).part(False))
                pieces = [p.tobytes() for p in np.array_split(numbers.astype(np.float32), SLICES)]
                columns = [range(SLICES), [shard] * SLICES, [weight] * SLICES, pieces]
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary()]
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, ["slice", "shard", "weight", "numbers"])

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total, weight = 0.0, 0
        for row in frame.sort_values("shard").itertuples():
            total = total + row.weight * np.frombuffer(row.numbers, np.float32).astype(np.float64)
            weight += row.weight
        return pd.DataFrame({"slice": frame["slice"].iloc[:1], "numbers": [(total / max(1, weight)).tobytes()]})

    made = shards.mapInArrow(run, "slice int, shard int, weight bigint, numbers binary")
    summed = made.groupBy("slice").applyInPandas(add, "slice int, numbers binary").collect()
    return np.concatenate([np.frombuffer(r["numbers"]) for r in sorted(summed, key=lambda r: r["slice"])])


def _calibration(shards: DataFrame, model: WordConv) -> pd.DataFrame:
    """What `calibrate` needs of the texts set apart for it: a row for each language and place in GRID."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("packed"):
                part = Shard.unpacked(data.as_py()).part(True)
                scores = model.scores(part.pairs, part.starts)
                over = scores[:, None] >= GRID
                frame = pd.DataFrame({"lang": pd.Series(part.langs, dtype=object), "y": part.y})
                rows = []
                for lang, ids in frame.groupby("lang", dropna=False).indices.items():
                    one, hit = part.y[ids] == 1, over[ids]
                    known = None if pd.isna(lang) else lang
                    for at in range(len(GRID)):
                        both = int((hit[:, at] & one).sum())
                        rows.append((known, at, int(one.sum()), int((~one).sum()), int(hit[:, at].sum()), both))
                if rows:
                    kinds = [pa.string(), *[pa.int64()] * 5]
                    arrays = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(arrays, ["lang", "at", "ones", "zeros", "hit", "both"])

    made = shards.mapInArrow(run, "lang string, at bigint, ones bigint, zeros bigint, hit bigint, both bigint")
    names = ["ones", "zeros", "hit", "both"]
    return made.groupBy("lang", "at").agg(*[F.sum(n).alias(n) for n in names]).toPandas()


def train_toxicity(
    docs: DataFrame, labels: DataFrame, shard_texts: int = SHARD_TEXTS, shard_words: int = SHARD_WORDS
) -> WordConv:
    """Fit on four fifths of all labelled documents that may be learned from; calibrate thresholds on the rest."""
    known = stage(
        labels.where(F.col("toxic").isin(0, 1) & (crc_fold(F.col("doc_id"), FOLDS) != HELD_OUT))
        .groupBy("doc_id")
        .agg(F.min("toxic").cast("int").alias("label")),
        ones=F.sum("label"),
    )
    n = counted(known).rows
    share = (counted(known).measures["ones"] or 0) / n if n else 0.5
    model = WordConv(share)
    if share in (0.0, 1.0) or not n:
        return model
    rows = _learnable(docs, known)
    texts, ones, words = (counted(rows).measures[x] or 0 for x in ("texts", "ones", "words"))
    if not 0 < ones < texts:
        return model
    parts = max(-(-counted(rows).rows // shard_texts), -(-words // shard_words), 1)
    path = fresh_path(docs.sparkSession)
    shards = stage(_dealt(rows, parts), path, by="shard")
    used = shards.where("packed is not null").select("shard").distinct().count()
    one, zero = used * _total(shards, lambda s: (1, WordConv.seen_in(s.pairs, s.starts, s.y))).reshape(2, -1)
    model.seed_embedding(one, zero, ones / texts)
    # One shard learns in one go; several have far more texts, and need fewer epochs.
    epochs = ROUNDS * ROUND_EPOCHS if parts > 1 else EPOCHS
    for some in np.array_split(np.arange(epochs), ROUNDS if parts > 1 else 1):

        def learned(s: Shard, some=some, flat=model.flat()) -> tuple[int, np.ndarray]:
            return len(s.y), WordConv(share).take(flat).fit(s.pairs, s.y, s.starts, some, epochs).flat()

        model.take(_total(shards, learned))
    model.calibrate(_calibration(shards, model))
    remove(docs.sparkSession, path)
    return model


def with_toxicity(docs: DataFrame, model: WordConv, column: str = "score") -> DataFrame:
    """Add the probability of label 1 of every whole `text`."""

    @F.arrow_udf("double")
    def score(hashes: pa.Array) -> pa.Array:
        return pa.array(model.score(*flat_lists(hashes)))

    return docs.withColumn(column, score(word_hashes(F.col("text"))))


def toxicity_threshold(model: WordConv, lang: Column) -> Column:
    """The calibrated threshold of a document's language."""
    common = model.thresholds.get(None, 0.5)
    pairs = [F.lit(x) for k, v in model.thresholds.items() if k is not None for x in (k, v)]
    if not pairs:
        return F.lit(common)
    return F.coalesce(F.create_map(*pairs)[lang], F.lit(common))
