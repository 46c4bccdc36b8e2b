"""Language ID with error-correcting output codes.

Each language has a codeword; one binary classifier per code bit looks at hashed byte
n-grams of the whole text. Decoding adds up each bit's logistic loss against every
codeword and takes the nearest; a small lead over the next one flags ambiguity.

Codewords: with few languages every split into two non-empty parts is a bit (the exhaustive
code); with more, seeded random splits, chosen greedily for distance between codewords.

Training takes a bounded sample of labelled rows (PER_LANGUAGE a language); scoring runs in
tasks on Arrow batches.

Defined results: `und`, score 0 and no ambiguity for a text that is null or has no letter;
with a single learned language that one, with score 1; with none, `und` for all. Other
columns stay; those with the names of new ones are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .samples import Adam, fitted_in_task, flat_bytes, one_each, pick, sigmoid
from .words import crc_fold, free_name

BUCKETS = 1 << 13
ORDERS = (1, 2, 3, 4)
# The bounds of the training sample.
PER_LANGUAGE = 400
MOST_LANGUAGES, MOST_TEXTS = 512, 8000
LONGEST_TEXT = 16_384
# Bits of the code when there are too many languages for the exhaustive one.
RANDOM_BITS = 31
EXHAUSTIVE_UP_TO = 5
STEPS = 150
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
# Decoded probabilities nearer than this are ambiguous.
AMBIGUOUS_LEAD = 0.2
SLAB = 1 << 18
SEED = 13


def codewords(languages: int, seed: int = SEED) -> np.ndarray:
    """One row of 0/1 bits per language; every column splits the languages in two."""
    if languages < 2:
        return np.zeros((languages, 1), np.int8)
    if languages <= EXHAUSTIVE_UP_TO:
        splits = np.arange(1, 2 ** (languages - 1))
        return np.array([(splits >> i) & 1 for i in range(languages)], np.int8)
    rng = np.random.default_rng(seed)
    code = np.zeros((languages, 0), np.int8)
    while code.shape[1] < max(RANDOM_BITS, 4 * int(np.ceil(np.log2(languages)))):
        tries = rng.integers(0, 2, (64, languages)).astype(np.int8)
        tries = [t for t in tries if 0 < t.sum() < languages]

        def spread(t):
            whole = np.column_stack((code, t)).astype(int)
            apart = (whole[:, None, :] != whole[None, :, :]).sum(2)[np.triu_indices(languages, 1)]
            return apart.min(), apart.mean()

        code = np.column_stack((code, max(tries, key=spread)))
    return code


class CodeModel:
    """Bit classifiers over n-gram shares, and the codewords they decode to."""

    def __init__(self, languages: list[str]):
        self.languages = languages
        self.code = codewords(len(languages))
        self.weights = np.zeros((BUCKETS, self.code.shape[1]), np.float32)
        self.shift = np.zeros(self.code.shape[1], np.float32)

    @staticmethod
    def grams(flat: np.ndarray, order: int) -> np.ndarray:
        """Bucket of the n-gram that begins at each byte (upper-case ASCII as lower-case)."""
        lower = np.where((flat >= 65) & (flat <= 90), flat + 32, flat).astype(np.uint32)
        h = np.full(max(0, len(flat) - order + 1), order * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for i in range(order):
            h = (h ^ lower[i : i + len(h)]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        return (h >> np.uint32(19)).astype(np.int64)

    def _sums(self, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Mean weight of each text's n-grams, for each bit; long texts in slabs."""
        sums = np.zeros((len(starts) - 1, self.code.shape[1]))
        counts = np.zeros(len(starts) - 1)
        overlap = max(ORDERS) - 1
        for a in range(0, len(flat), SLAB):
            b = min(len(flat), a + SLAB)
            lo, hi = np.searchsorted(starts, [a, b - 1], "right") - [1, 0]
            edges = np.clip(starts[lo : hi + 1], a, b)
            for order in ORDERS:
                g = self.grams(flat[a : min(len(flat), b + overlap)], order)
                # An n-gram belongs to the text it begins in, if it also ends there.
                ends = np.minimum(edges[1:], starts[lo + 1 : hi + 1] - order + 1)
                begin, stop = edges[:-1] - a, np.maximum(ends - a, edges[:-1] - a)
                values = self.weights[np.append(g[: b - a], 0)]
                top = len(values) - 1
                begin, stop = np.minimum(begin, top), np.minimum(stop, top)
                pieces = np.add.reduceat(values, np.stack((begin, stop), 1).ravel(), axis=0)[::2]
                sums[lo:hi] += np.where((stop > begin)[:, None], pieces, 0)
                counts[lo:hi] += stop - begin
        return sums / np.maximum(counts, 1)[:, None]

    def decode(self, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest codeword by summed loss: its index, its probability, and its lead."""
        sign = 2.0 * self.code - 1
        loss = np.logaddexp(0, -bits[:, None, :] * sign[None]).sum(2)
        # Every language is right in some bits of every other, hence the mean over bits.
        share = np.exp(-(loss - loss.min(1, keepdims=True)) * 2 / self.code.shape[1])
        share /= share.sum(1, keepdims=True)
        best = share.argmax(1)
        ordered = np.sort(share, 1)
        lead = ordered[:, -1] - ordered[:, -2] if share.shape[1] > 1 else np.ones(len(share))
        return best, ordered[:, -1], lead

    def predict(self, flat: np.ndarray, starts: np.ndarray):
        return self.decode(self._sums(flat, starts) + self.shift)

    def fit(self, texts: list[bytes], langs: np.ndarray) -> CodeModel:
        """Logistic regression of all bits at once on n-gram shares."""
        x = np.zeros((len(texts), BUCKETS), np.float32)
        for i, t in enumerate(texts):
            flat = np.frombuffer(t, np.uint8)
            for order in ORDERS:
                x[i] += np.bincount(self.grams(flat, order), minlength=BUCKETS)
        x /= np.maximum(x.sum(1, keepdims=True), 1)
        scale = 1 / (x.std(0) + 1e-3 * x.std(0).max() + 1e-9)
        x *= scale
        want = self.code[langs].astype(np.float32)
        per_lang = np.bincount(langs, minlength=len(self.languages))
        each = (1 / per_lang[langs] / (per_lang > 0).sum()).astype(np.float32)[:, None]
        adam = Adam([self.weights, self.shift], 0.003)
        for _ in range(STEPS):
            gap = (sigmoid(x @ self.weights + self.shift) - want) * each
            adam.step([x.T @ gap + 1e-5 * self.weights, gap.sum(0)])
        self.weights *= scale[:, None]
        return self


def train_language(
    docs: DataFrame,
    per_language: int = PER_LANGUAGE,
    longest: int = LONGEST_TEXT,
    most_languages: int = MOST_LANGUAGES,
    most_texts: int = MOST_TEXTS,
) -> CodeModel:
    """Fit, in a task, on at most `per_language` texts of each language outside the held-out fold.

    The ids of a language with the smallest seeded hash are taken, each once however many rows
    repeat it; an id that stands with several languages counts for the smallest. The sample
    is bounded: texts of up to `longest` bytes, the `most_languages` commonest languages,
    and `most_texts` in all.
    """
    known = (
        docs.where(
            F.col("lang").isNotNull()
            & F.coalesce("text", F.lit("")).rlike(r"\p{L}")
            & (F.octet_length("text") <= longest)
            & (crc_fold(F.col("doc_id"), FOLDS) != HELD_OUT)
        )
        .groupBy("doc_id")
        .agg(F.min("lang").alias("lang"))
    )
    common = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages)
    names = [r["lang"] for r in common.collect()]
    if not names:
        return CodeModel([])
    most = max(1, min(per_language, most_texts // len(names)))
    picked = pick(known.where(F.col("lang").isin(names)), "lang", most)
    languages = sorted(set(picked.values()))
    model = CodeModel(languages)
    if len(languages) < 2:
        return model

    def fit(frame) -> dict:
        frame = frame.sort_values("doc_id", ignore_index=True)
        texts = [t.encode() for t in frame["text"]]
        return vars(model.fit(texts, np.array([languages.index(x) for x in frame["_class"]])))

    letters = docs.where(F.octet_length("text") <= longest)
    model.__dict__.update(fitted_in_task(one_each(letters, picked, ["text"]), fit))
    return model


def with_language(
    docs: DataFrame, model: CodeModel, column: str = "lang_pred", score: str = "score", flag: str = "ambiguous"
) -> DataFrame:
    """Add the predicted language of every whole `text`, its score, and whether it is unsure."""
    if not model.languages:
        return docs.withColumns({column: F.lit(UNKNOWN), score: F.lit(0.0), flag: F.lit(False)})

    @F.arrow_udf("struct<lang: string, score: double, unsure: boolean>")
    def predict(text: pa.Array) -> pa.Array:
        best, share, lead = model.predict(*flat_bytes(text))
        return pa.StructArray.from_arrays(
            [
                pa.array(np.array(model.languages, object)[best], pa.string()),
                pa.array(share),
                pa.array(lead < AMBIGUOUS_LEAD),
            ],
            ["lang", "score", "unsure"],
        )

    guess, has = free_name(docs, "_found"), free_name(docs, "_letters")
    letters = F.coalesce("text", F.lit("")).rlike(r"\p{L}")
    found = docs.withColumn(guess, predict("text")).withColumn(has, letters)
    return found.withColumns(
        {
            column: F.when(F.col(has), F.col(f"{guess}.lang")).otherwise(UNKNOWN),
            score: F.when(F.col(has), F.col(f"{guess}.score")).otherwise(0.0),
            flag: F.col(has) & F.col(f"{guess}.unsure"),
        }
    ).drop(guess, has)
