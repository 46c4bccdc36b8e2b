"""Phrases whose words keep together, counted by weighted acyclic automata.

Shards of the texts become automata of their n-grams with counts, built from the sorted n-grams
(`automata`). Splitters cut the order of all n-grams into prefix ranges; a shard's automaton is
sent in parts, one a range, and the automata of a range are united with their weights summed.
A range that starts inside the n-grams of a word also gets the counts of the splitter's own
prefixes, which belong to an earlier range, so the first parts of a candidate are read off along
its path in its own automaton. The rests of the candidates are looked up among the united n-grams.

Scores are floor(1000000 * a * a / (l * r)) in decimals of 38 digits, exact for counts up to 10^15.

Defined results: a null text has no words and a null language is `und`; texts of one language are
one corpus however rows repeat; a language without candidates has no rows; an empty table gives
an empty result. Only A to Z are lower-cased. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import lookup
from ..operators.staging import derived, stage
from .automata import Automaton, build, place_of, rows_of, summed, union

MAX_WORDS = 3
MIN_COUNT = 10
TOP = 2000
# A candidate goes if a longer one holds it at this share of its count, in percent.
HELD_PERCENT = 50
SCALE = 1_000_000
UNDEFINED = "und"
# Bytes of text to a prefix range, most ranges, and sampled n-grams to a range.
RANGE_BYTES = 8 << 20
MOST_RANGES = 1 << 16
SAMPLED = 32
# Words of a shard.
SHARD_WORDS = 1 << 19
# Groups that the best of a language are first sought in.
DEALT = 64
SEED = 17

# Piece ends become line ends, tabs blanks, A to Z small.
_TABLE = bytearray(range(256))
for _c in b".,;:!?\x0b\x0c\r":
    _TABLE[_c] = 10
_TABLE[9] = 32
for _c in range(65, 91):
    _TABLE[_c] = _c + 32
_TABLE = bytes(_TABLE)


def numbered(texts: list[bytes], longest: int) -> tuple[list[bytes], list[tuple[np.ndarray, np.ndarray]]]:
    """Words of the texts in byte order, and for each n the distinct n-grams with their counts."""
    blob = b"\n".join(texts).translate(_TABLE)
    split = blob.split()
    if not split:
        return [], []
    codes, found = pd.factorize(np.array(split, dtype=object))
    by_bytes = np.array(sorted(range(len(found)), key=found.__getitem__), np.int64)
    rank = np.empty(len(found), np.int64)
    rank[by_bytes] = np.arange(1, len(found) + 1)
    ids = rank[codes]
    raw = np.frombuffer(blob, np.uint8)
    plain = (raw != 32) & (raw != 10)
    begins = np.flatnonzero(plain & np.concatenate(([True], ~plain[:-1])))
    piece = np.cumsum(raw == 10)[begins]
    bits = len(found).bit_length()
    out = []
    for n in range(1, min(longest, len(ids)) + 1):
        starts = np.flatnonzero(piece[n - 1 :] == piece[: len(ids) - n + 1])
        if bits * n <= 63:
            key = np.zeros(len(starts), np.int64)
            for d in range(n):
                key = (key << bits) | ids[starts + d]
            distinct, counts = np.unique(key, return_counts=True)
            grams = np.zeros((len(distinct), longest), np.int64)
            for d in range(n):
                grams[:, d] = (distinct >> (bits * (n - 1 - d))) & ((1 << bits) - 1)
        else:
            grams = np.zeros((len(starts), longest), np.int64)
            for d in range(n):
                grams[:, d] = ids[starts + d]
            grams, counts = summed(grams, np.ones(len(grams), np.int64))
        out.append((grams, counts))
    return [found[i] for i in by_bytes], out


def shard(texts: list[bytes], longest: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Words in byte order, and all n-grams of up to `longest` words, sorted, with counts."""
    words, by_length = numbered(texts, longest)
    if not words:
        return [], np.zeros((0, longest), np.int64), np.zeros(0, np.int64)
    grams, counts = (np.concatenate(part) for part in zip(*by_length, strict=True))
    return words, *summed(grams, counts)


def _by_lang(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[str, list[bytes]]]:
    """Texts of one language at a time, about `most` words of them."""
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for part in _parts(text, most * 6):
                held.setdefault(lang, []).append(part)
                # A word takes two bytes at least, mostly six or more.
                sizes[lang] = sizes.get(lang, 0) + len(part)
                if sizes[lang] >= most * 6:
                    yield lang, held.pop(lang)
                    sizes.pop(lang)
            if sum(sizes.values()) >= 4 * most * 6:
                largest = max(sizes, key=sizes.get)
                yield largest, held.pop(largest)
                sizes.pop(largest)
    yield from held.items()


def _parts(text: bytes, most: int) -> Iterator[bytes]:
    """A text cut at piece ends into parts of about `most` bytes; a piece is never cut."""
    if len(text) <= 2 * most:
        yield text
        return
    flat = text.translate(_TABLE)
    at = 0
    while at < len(flat):
        cut = flat.find(b"\n", at + most)
        cut = len(flat) if cut < 0 else cut + 1
        yield flat[at:cut]
        at = cut


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit(UNDEFINED)).alias("lang"),
        F.col("text").cast("string").cast("binary").alias("text"),
    ).where(F.octet_length("text") > 0)


def _splitters(texts: DataFrame, longest: int, range_bytes: int) -> dict[str, list[tuple[bytes, ...]]]:
    """For each language the n-grams that its prefix ranges begin with, but for the first.

    Sampled; they only decide which range a row travels to, never what is counted. Their
    number is bounded, and so is the sample.
    """
    sizes = {
        r["lang"]: r["bytes"]
        for r in texts.groupBy("lang")
        .agg(F.sum(F.octet_length("text").cast("long")).alias("bytes"))
        .where(F.col("bytes") > range_bytes)
        .collect()
    }
    total = sum(sizes.values())
    if not total:
        return {}
    ranges = {lang: min(-(-n // range_bytes), max(1, MOST_RANGES * n // total)) for lang, n in sizes.items()}
    # Of every text a few n-grams, at places that a hash chooses.
    wanted = sum(ranges.values()) * SAMPLED
    share = min(1.0, 64 * wanted / total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, grams = [], []
            for lang, text, salt in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if lang not in ranges:
                    continue
                rng = np.random.default_rng(salt % (1 << 63))
                for at in rng.integers(0, len(text), rng.poisson(share * len(text) / 64)):
                    words = text[at : at + 64 * longest].translate(_TABLE).split(b"\n")[0].split()[1 : longest + 1]
                    if words:
                        langs.append(lang)
                        grams.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(grams, pa.binary())], ["lang", "gram"])

    salted = texts.select("lang", "text", F.xxhash64(F.lit(SEED), "text").alias("salt"))
    sampled = salted.mapInArrow(run, "lang string, gram binary").toArrow()
    out = {}
    langs = np.array(sampled.column("lang").to_pylist(), dtype=object)
    grams = sampled.column("gram").to_pylist()
    for lang, n in ranges.items():
        own = sorted(tuple(grams[i].split()) for i in np.flatnonzero(langs == lang))
        step = len(own) / n
        picked = {own[int(i * step)] for i in range(1, n)} if own else set()
        out[lang] = sorted(picked)
    return out


def _shards(texts: DataFrame, longest: int, splitters: dict, shard_words: int) -> DataFrame:
    """Automata of shards by range: lang, range, automaton, and counts of the splitter's prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, own in _by_lang(batches, shard_words):
            words, grams, counts = shard(own, longest)
            if not words:
                continue
            cuts = splitters.get(lang, [])
            lookup_words = np.array(words, dtype=object)
            number = {w: i + 1 for i, w in enumerate(words)}
            places = [0, *(place_of(c, lookup_words, grams) for c in cuts), len(grams)]
            borders = np.zeros((len(cuts), longest), np.int64)
            ask = np.zeros((len(cuts) * (longest - 1), longest), np.int64)
            for i, cut in enumerate(cuts):
                for d in range(1, len(cut)):
                    ids = [number.get(w, -1) for w in cut[:d]]
                    if min(ids) > 0:
                        ask[i * (longest - 1) + d - 1, :d] = ids
            at = rows_of(ask, grams)
            found = np.where((at >= 0) & (ask[:, 0] > 0), counts[np.maximum(at, 0)], 0)
            borders[:, : longest - 1] = found.reshape(len(cuts), longest - 1)
            rows = []
            for r in range(len(cuts) + 1):
                a, b = places[r], places[r + 1]
                border = borders[r - 1].tolist() if r else [0] * longest
                if b > a or any(border):
                    rows.append((lang, r, build(words, grams[a:b], counts[a:b]).to_bytes(), border))
            langs, numbers, blobs, edge = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(langs, pa.string()),
                    pa.array(numbers, pa.int32()),
                    pa.array(blobs, pa.binary()),
                    pa.array(edge, pa.list_(pa.int64())),
                ],
                ["lang", "range", "automaton", "border"],
            )

    return texts.mapInArrow(run, "lang string, range int, automaton binary, border array<bigint>")


def _united(shards: DataFrame, longest: int, splitters: dict, min_count: int) -> DataFrame:
    """Frequent n-grams: lang, phrase, size, n, firsts (counts of its first 1, 2, ... words).

    A row of size 0 has in `n` how many words a range's n-grams of one word count.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        lang, number = frame["lang"].iloc[0], int(frame["range"].iloc[0])
        words, grams, counts = union((Automaton.from_bytes(b) for b in frame["automaton"]), longest)
        border = np.sum(np.stack(frame["border"].to_list()), axis=0)
        alone = int(counts[(grams > 0).sum(1) == 1].sum())
        # A first part occurs wherever its phrase does, so it is among the frequent ones itself.
        often = counts >= min_count
        grams, counts = grams[often], counts[often]
        size = (grams > 0).sum(1)
        firsts = np.zeros((len(grams), longest), np.int64)
        cut = splitters[lang][number - 1] if number else ()
        for d in range(1, longest):
            asked = grams.copy()
            asked[:, d:] = 0
            at = rows_of(asked, grams)
            # A first part that is not here is a prefix of the splitter the range begins with.
            known = counts[np.maximum(at, 0)] if len(counts) else 0
            firsts[:, d - 1] = np.where(at >= 0, known, border[d - 1] if d < len(cut) else 0)
        phrases = [b" ".join(words[i - 1] for i in g if i) for g in grams.tolist()]
        return pd.DataFrame(
            {
                "lang": lang,
                "phrase": [b"", *phrases],
                "size": np.concatenate(([0], size)).astype(np.int32),
                "n": np.concatenate(([alone], counts)),
                "firsts": [[], *(f[: max(0, s - 1)].tolist() for f, s in zip(firsts, size, strict=True))],
            }
        )

    schema = "lang string, phrase binary, size int, n bigint, firsts array<bigint>"
    rows = shards.groupBy("lang", "range").applyInPandas(run, schema)
    return rows.withColumn("phrase", F.col("phrase").cast("string"))


def phrase_scores(
    docs: DataFrame,
    max_words: int = MAX_WORDS,
    min_count: int = MIN_COUNT,
    range_bytes: int = RANGE_BYTES,
    shard_words: int = SHARD_WORDS,
) -> tuple[DataFrame, DataFrame]:
    """All candidates (lang, phrase, size, a, l, r, score), and the words of each language (lang, n)."""
    if max_words < 2:
        raise ValueError("a phrase has two words at least")
    texts = _texts(docs)
    splitters = _splitters(texts, max_words, range_bytes)
    united = stage(_united(_shards(texts, max_words, splitters, shard_words), max_words, splitters, min_count))
    totals = united.where("size = 0").groupBy("lang").agg(F.sum("n").alias("n"))
    # Neither a phrase nor its rest has a tab, so a key names one pair of language and phrase.
    key = F.concat_ws("\t", "lang", "phrase")
    known = derived(
        united.where(F.col("size").between(1, max_words - 1)).select(key.alias("_of"), F.col("n").alias("r")), united
    )
    words = F.split("phrase", " ")
    cut = F.explode(F.sequence(F.lit(1), F.col("size") - 1))
    asked = (
        united.where(F.col("size") > 1)
        .select("lang", "phrase", "size", F.col("n").alias("a"), "firsts", cut.alias("cut"))
        .select(
            "lang",
            "phrase",
            "size",
            "a",
            "cut",
            F.get("firsts", F.col("cut") - 1).alias("l"),
            F.concat_ws("\t", "lang", F.array_join(F.slice(words, F.col("cut") + 1, F.col("size")), " ")).alias("rest"),
        )
    )
    parts = lookup(asked, known, "rest", "_of")
    score = F.expr(
        f"(CAST(a AS DECIMAL(16,0)) * CAST(a AS DECIMAL(15,0)) * {SCALE})"
        " DIV (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(18,0)))"
    )
    scored = parts.withColumn("score", score.cast("long"))
    best = F.min(F.struct("score", "cut", "l", "r"))
    lowest = scored.groupBy("lang", "phrase", "size", "a").agg(best.alias("b"))
    return lowest.select("lang", "phrase", "size", "a", "b.l", "b.r", "b.score"), totals


def collocations(
    docs: DataFrame,
    max_words: int = MAX_WORDS,
    min_count: int = MIN_COUNT,
    top: int = TOP,
    held_percent: int = HELD_PERCENT,
    range_bytes: int = RANGE_BYTES,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """The `top` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    a counts the phrase, l and r the two parts of the cut with the lowest score, n the words of the
    language. By score, then a, falling, then phrase. A phrase that a longer candidate
    holds nearly as often as it occurs is left out.
    """
    found, totals = phrase_scores(docs, max_words, min_count, range_bytes, shard_words)
    found = stage(found)
    words = F.split("phrase", " ")
    spans = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.col("size") - 1),
            lambda n: F.transform(
                F.sequence(F.lit(1), F.col("size") - n + 1), lambda i: F.array_join(F.slice(words, i, n), " ")
            ),
        )
    )
    holders = (
        found.where("size > 2")
        .select("lang", F.explode(spans).alias("phrase"), F.col("a").alias("_longer"))
        .groupBy("lang", "phrase")
        .agg(F.max("_longer").alias("_longer"))
    )
    held = F.lit(100) * F.col("_longer") >= F.lit(held_percent) * F.col("a")
    left = found.join(holders, ["lang", "phrase"], "left").where(~F.coalesce(held, F.lit(False)))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    dealt = F.pmod(F.xxhash64("phrase"), F.lit(DEALT))
    some = (
        left.withColumn("_deal", dealt)
        .withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "_deal").orderBy(*order)))
        .where(F.col("_rank") <= top)
        .drop("_deal", "_rank")
    )
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return (
        ranked.where(F.col("rank") <= top)
        .join(totals, "lang")
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    )
