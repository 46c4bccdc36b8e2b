"""Count automata and phrase mining against plain counting."""

import itertools
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cladeframe.llm import automata
from cladeframe.llm.automata import Automaton, build, place_of, rows_of, union
from cladeframe.llm.collocations import collocations, shard

SCHEMA = "doc_id bigint, text string, lang string"


def counted(texts, longest=3):
    """Plain counts of all n-grams, as tuples of words."""
    out = Counter()
    for text in texts:
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            for n in range(1, longest + 1):
                out.update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    return out


def plain(rows, least=10, top=2000, longest=3, percent=50):
    out = []
    by_lang = {}
    for _, text, lang in rows:
        by_lang.setdefault("und" if lang is None else lang, []).append(text)
    for lang, texts in by_lang.items():
        f = counted(texts, longest)
        n = sum(c for g, c in f.items() if len(g) == 1)
        candidates = {}
        for g, a in f.items():
            if len(g) < 2 or a < least:
                continue
            cuts = [(1_000_000 * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g))]
            score, k = min(cuts)
            candidates[g] = (score, a, f[g[:k]], f[g[k:]])
        kept = []
        for g, (score, a, left, right) in candidates.items():
            inside = any(
                len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h))) and 100 * f[h] >= percent * a
                for h in candidates
            )
            if not inside:
                kept.append((-score, -a, " ".join(g).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def invented(seed, docs):
    rng = random.Random(seed)
    words = ["The", "the", "of", "é", "É", "und", "a b", "x", "York", "New", "big", "apple", "zz"]
    rows = []
    for i in range(docs):
        text = "".join(
            rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", " ! ", "\x1c"])
            for _ in range(rng.randint(0, 60))
        )
        rows.append((i, text, rng.choice(["en", "fr", None, "und", "a\tb"])))
    return [*rows, (-1, None, "en"), (-2, "", "en"), (-3, " .\t", None), (None, "New York " * 30, "en")]


def test_automaton_holds_its_ngrams():
    texts = [t for _, t, _ in invented(2, 200) if t]
    words, grams, counts = shard([t.encode() for t in texts], 3)
    machine = Automaton.from_bytes(build(words, grams, counts).to_bytes())
    again, weights = machine.grams()
    found = {tuple(machine.words[i - 1].decode() for i in g if i): w for g, w in zip(again.tolist(), weights.tolist())}
    assert found == counted(texts)
    assert [tuple(g) for g in again.tolist()] == sorted(tuple(g) for g in again.tolist())
    # Equal states are one: fewer states than distinct prefixes.
    assert len(machine.starts[2]) - 1 < len({g[:2] for g in counted(texts) if len(g) > 2})


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.lists(st.sampled_from("abcde"), min_size=1, max_size=6), max_size=8), min_size=1, max_size=4))
def test_union_adds_counts(shards):
    machines, total = [], Counter()
    for pieces in shards:
        text = ".".join(" ".join(p) for p in pieces)
        total += counted([text])
        machines.append(build(*shard([text.encode()], 3)))
    words, grams, counts = union(machines, 3)
    found = {tuple(words[i - 1].decode() for i in g if i): c for g, c in zip(grams.tolist(), counts.tolist())}
    assert found == total
    order = sorted(found)
    for g in [*itertools.product("abf", repeat=3), ("a",), ("b", "c"), ("z",)]:
        coded = tuple(w.encode() for w in g)
        place = place_of(coded, np.array(words, dtype=object), grams)
        assert place == sum(h < g for h in order)


def test_union_holds_distinct_ngrams_and_not_all_parts(monkeypatch):
    """Memory of many alike parts is that of few; also where words outgrow the packed numbers."""
    monkeypatch.setattr(automata, "UNION_ROWS", 1 << 10)
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(300)}" for _ in range(3000)).encode()]
    blob = build(*shard(texts, 3)).to_bytes()

    def peak(parts):
        tracemalloc.start()
        words, grams, counts = union((Automaton.from_bytes(blob) for _ in range(parts)), 3)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        found = {tuple(words[i - 1].decode() for i in g if i): c for g, c in zip(grams.tolist(), counts.tolist())}
        assert found == {g: c * parts for g, c in counted([texts[0].decode()]).items()}
        return most

    assert peak(60) < 1.5 * peak(6)
    own = [[" ".join(f"v{rng.randrange(k, k + 40)}" for _ in range(90))] for k in range(0, 400, 30)]
    machines = [build(*shard([t.encode() for t in text], 9)) for text in own]
    words, grams, counts = union(machines, 9)
    found = {tuple(words[i - 1].decode() for i in g if i): c for g, c in zip(grams.tolist(), counts.tolist())}
    assert found == sum((counted(text, 9) for text in own), Counter())


def test_long_ngrams_do_not_fit_in_numbers():
    """Words times length beyond 63 bits."""
    texts = [" ".join(f"w{i * i % 9973}" for i in range(4000))] * 2
    words, grams, counts = shard([t.encode() for t in texts], 6)
    found = {tuple(words[i - 1].decode() for i in g if i): c for g, c in zip(grams.tolist(), counts.tolist())}
    assert found == counted(texts, 6)


def test_rows_of_finds_each_ngram_with_and_without_packing():
    rng = np.random.default_rng(1)
    grams = np.unique(rng.integers(0, 50, (300, 3)), axis=0)
    wide = grams * (1 << 30)
    asked = np.concatenate((grams[::7], grams[:5] + 1000))
    expected = [*range(0, len(grams), 7), *[-1] * 5]
    assert rows_of(asked, grams).tolist() == expected
    assert rows_of(np.concatenate((wide[::7], wide[:5] + 1)), wide).tolist() == expected


@pytest.mark.parametrize("range_bytes, shard_words", [(8 << 20, 1 << 19), (600, 64)])
def test_phrases_are_those_of_plain_counting(spark, range_bytes, shard_words):
    """Also with many ranges, which begin inside the n-grams of frequent words, and many shards."""
    rows = invented(4, 400)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = collocations(df, range_bytes=range_bytes, shard_words=shard_words)
    assert sorted(map(tuple, found.collect())) == plain(rows)


def test_other_lengths_and_limits(spark, forced_shuffle):
    rows = invented(6, 300)
    df = spark.createDataFrame(rows, SCHEMA)
    found = collocations(df, max_words=4, min_count=3, top=15, held_percent=80, range_bytes=2000, shard_words=256)
    assert sorted(map(tuple, found.collect())) == plain(rows, 3, 15, 4, 80)
    with pytest.raises(ValueError):
        collocations(df, max_words=1)


def test_products_beyond_64_bits():
    """The score's decimals: a * a * 10^6 and l * r past 64 bits."""
    from cladeframe.llm.collocations import SCALE

    a, left, right = 10**12 + 7, 3 * 10**12 + 1, 2 * 10**12 + 9
    assert SCALE * a * a > 2**64
    assert SCALE * a * a // (left * right) == 166_666


def test_decimal_score_is_exact(spark):
    a, left, right = 10**12 + 7, 3 * 10**12 + 1, 2 * 10**12 + 9
    df = spark.sql(
        f"SELECT (CAST({a}L AS DECIMAL(16,0)) * CAST({a}L AS DECIMAL(15,0)) * 1000000) DIV "
        f"(CAST({left}L AS DECIMAL(19,0)) * CAST({right}L AS DECIMAL(18,0))) AS score"
    )
    assert df.first()["score"] == 1_000_000 * a * a // (left * right)


def test_empty_and_clashing_names(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert collocations(empty).count() == 0
    rows = invented(8, 120)
    df = spark.createDataFrame(rows, SCHEMA)
    more = df.selectExpr(
        "*", "'x' AS phrase", "'x' AS range", "'x' AS n", "'x' AS a", "'x' AS l", "'x' AS cut", "'x' AS rest", "'x' AS _of"
    )
    assert sorted(map(tuple, collocations(more).collect())) == plain(rows)
    doubled = df.unionByName(df)
    assert sorted(map(tuple, collocations(doubled).collect())) == plain(rows + rows)


def test_a_very_long_text(spark):
    text = " ".join(f"w{i % 37}{'.' if i % 11 == 0 else ''}" for i in range(30_000))
    rows = [(1, text, "en"), (2, "no end " * 20_000, "en")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, collocations(df, shard_words=1024, range_bytes=20_000).collect())) == plain(rows)
