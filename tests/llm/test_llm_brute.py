"""Operators against brute force on small tables."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from cladeframe.llm import anchors, suffixes
from cladeframe.llm.components import components
from cladeframe.llm.language import codewords
from cladeframe.llm.mixing import sainte_lague, targets
from cladeframe.llm.set_join import set_join
from cladeframe.llm.substrings import dedup_substrings
from cladeframe.llm.suffixes import dedup_bytes, multikey_quicksort
from cladeframe.llm.token_counts import CHANGES, TokenRollup
from cladeframe.operators.staging import fresh_path

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    """Texts that share passages, are near copies of each other, or repeat themselves."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    some = lambda n: [rng.choice(words) for _ in range(n)]
    passages = [some(rng.randint(30, 120)) for _ in range(5)]
    out = []
    for i in range(60):
        text = some(rng.randint(0, 150))
        if i % 2:
            at = rng.randint(0, len(text))
            text[at:at] = rng.choice(passages)
        if i % 7 == 3 and out:
            text = rng.choice(out).split()
            if text and i % 14 == 3:
                text[rng.randrange(len(text))] = "changed"
        if i % 11 == 5:
            text = text[:20] * 9
        out.append(" ".join(text))
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)


def test_anchors_of_equal_stretches_agree():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 3, 4000).astype(np.uint8)
    data[3000:3150] = data[100:250]
    places = set(anchors.anchor_places(anchors.rolled(data, 32, 1), 69).tolist())
    for start in range(100, 150):
        own = {p - start for p in places if start <= p <= start + 68}
        other = {p - start - 2900 for p in places if start + 2900 <= p <= start + 2968}
        assert own & other


def test_multikey_quicksort():
    rng = np.random.default_rng(2)
    rows = rng.integers(0, 2, (3000, 24)).astype(np.uint8)
    ordered = [bytes(r) for r in rows[multikey_quicksort(rows)]]
    assert ordered == sorted(bytes(r) for r in rows)


@pytest.mark.parametrize("range_rows", [1 << 14, 1])
def test_dedup_bytes(docs, texts, monkeypatch, range_rows):
    monkeypatch.setattr(suffixes, "RANGE_ROWS", range_rows)
    found = {r["doc_id"]: r for r in dedup_bytes(docs).collect()}
    seen = set()
    for doc, text in enumerate(texts):
        data = text.encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - 99):
            if data[i : i + 100] in seen:
                gone[i : i + 100] = True
            seen.add(data[i : i + 100])
        assert found[doc]["n_removed"] == gone.sum()
        assert bytes(found[doc]["kept"]) == bytes(np.frombuffer(data, np.uint8)[~gone])
        assert found[doc]["n_spans"] == len(re.findall("1+", "".join("01"[int(g)] for g in gone)))


@pytest.mark.parametrize("cells", [1 << 18, 64])
def test_dedup_substrings(docs, texts, monkeypatch, cells):
    """With a sketch that is full, everything is grouped exactly and nothing is lost."""
    from cladeframe.llm import substrings

    monkeypatch.setattr(substrings, "STRIPE", 64 if cells == 64 else 1 << 18)
    found = {r["doc_id"]: r for r in dedup_substrings(docs, cells=cells).collect()}
    first = {}
    for doc, text in enumerate(texts):
        words = re.findall("[^\x20\x09-\x0d]+", text)
        gone = [False] * len(words)
        for i in range(len(words) - 49):
            if first.setdefault(tuple(words[i : i + 50]), doc) < doc:
                gone[i : i + 50] = [True] * 50
        assert found[doc]["n_removed"] == sum(gone)
        assert found[doc]["kept_text"] == " ".join(w for w, g in zip(words, gone, strict=True) if not g)


def plain_links(texts, threshold=0.8):
    sets = {}
    for doc, text in enumerate(texts):
        words = text.split()
        n = min(5, len(words))
        if n:
            sets[doc] = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}
    near = lambda a, b: len(a & b) >= threshold * len(a | b)
    return {a: {b for b in sets if b != a and a in sets and near(sets[a], sets[b])} for a in range(len(texts))}


def reach(links):
    least = {i: i for i in links}
    for _ in links:
        for a, others in links.items():
            least[a] = min([least[a], *(least[b] for b in others)])
    return least


@pytest.mark.parametrize("options", [{}, {"small_bucket": 1, "block_sets": 2, "block_tokens": 300}])
def test_set_join(docs, texts, options):
    found = {r["doc_id"]: r for r in set_join(docs, **options).collect()}
    links = plain_links(texts)
    assert {i: r["n_links"] for i, r in found.items()} == {i: len(x) for i, x in links.items()}
    assert {i: r["component_id"] for i, r in found.items()} == reach(links)


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(i, i + 1) for i in range(1000, 1100)]
    found = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    links = collections.defaultdict(set)
    for a, b in edges:
        if a != b:
            links[a].add(b)
            links[b].add(a)
    assert found == reach(links)


def test_targets_and_quotas(spark):
    sizes = {"a": 10, "b": 1000, "c": 400, "d": 0, None: 90}
    found = targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint"))
    weight = dict(zip(["a", "b", "c", "d", None], [1, 2, 3, 1, 2], strict=True))
    want, rest, open_ = {}, sum(sizes.values()), set(sizes)
    while open_:
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        want |= {s: 3 * sizes[s] for s in over} or share
        rest, open_ = rest - sum(3 * sizes[s] for s in over), open_ - over if over else set()
    assert {r["source"]: r["target"] for r in found.collect()} == pytest.approx(want)
    rng = random.Random(8)
    claims = [(g, i, rng.random() * 100) for g in range(3) for i in range(7)]
    parts = spark.createDataFrame(claims, "g int, i int, claim double").withColumn("seats", F.lit(23))
    got = {(r["g"], r["i"]): r["quota"] for r in sainte_lague(parts, ["g"], "claim", "seats", "i").collect()}
    for g in range(3):
        quotients = sorted(((-c / (2 * a + 1), i) for k, i, c in claims if k == g for a in range(23)))[:23]
        assert {i: got[g, i] for i in range(7)} == {i: sum(j == i for _, j in quotients) for i in range(7)}


def test_rollup(spark):
    rollup = TokenRollup(spark, fresh_path(spark))
    schema = "seq int, op string, doc_id bigint, source string, lang string, tokenizer string, tokens bigint"

    def changes(rows):
        return spark.createDataFrame(rows, schema).select(*CHANGES)

    first = [
        (0, "insert", 1, "a", "en", "t", 5), (0, "insert", 2, "a", None, "t", 7), (0, "insert", 3, "b", "en", "t", None),
        (0, "insert", None, "a", "en", "t", 9), (0, "insert", 1, "a", "en", "u", 50), (0, "delete", 8, "a", "en", "t", 0),
    ]
    assert rollup.commit(0, changes(first))
    second = [(0, "revise", 1, "b", "en", "t", 6), (1, "revise", 1, "b", "en", "t", 4), (0, "delete", 2, None, None, "t", 0)]
    assert rollup.commit(1, changes(second))
    assert not rollup.commit(1, changes(second))
    assert rollup.commit(2, changes([]))
    with pytest.raises(ValueError):
        TokenRollup(spark, rollup.path).commit(-1, changes([]))
    found = {tuple(r)[:3]: tuple(r)[3:] for r in rollup.totals().collect()}
    assert found == {
        ("a", "en", "t"): (0, 0), ("a", None, "t"): (0, 0), ("b", "en", "t"): (4, 2), ("a", "en", "u"): (50, 1),
    }


def test_bpe_round_trip(spark, texts):
    from cladeframe.llm.token_counts import VOCABULARY, _encoding, with_bpe_count

    with open(VOCABULARY, "rb") as file:
        encoding = _encoding(file.read())
    found = with_bpe_count(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    for r in found:
        ids = encoding.encode_ordinary(r["text"])
        assert encoding.decode(ids) == r["text"]
        assert r["tokens"] == len(ids)


@pytest.mark.parametrize("languages", [2, 4, 5, 6, 40])
def test_codewords(languages):
    code = codewords(languages).astype(int)
    apart = (code[:, None] != code[None]).sum(2)[np.triu_indices(languages, 1)]
    assert apart.min() >= (1 if languages == 2 else 2)
    assert all(0 < c.sum() < languages for c in code.T)


def test_held_out_accuracy(spark):
    """Rows that were not learned from are told apart."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = driver.queries()["op5_language_id"](spark, SMALL).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    rows = found.collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    data = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{data}/labels.parquet")
    for name, label in (("op1_quality", "quality"), ("op9_toxicity", "toxic")):
        rows = driver.queries()[name](spark, data).join(labels, "doc_id").where("held_out").collect()
        good = [r["score"] for r in rows if r[label] == 1]
        bad = [r["score"] for r in rows if r[label] == 0]
        area = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / len(good) / len(bad)
        assert area > 0.85


def test_near_vectors_and_decontamination(spark):
    import pandas as pd

    data = "/root/testdata/sf0.01"
    found = driver.queries()["op6_near_vectors"](spark, data).toPandas().set_index("vec_id")
    table = pd.read_parquet(f"{data}/embeddings.parquet")
    links = {}
    for _, part in table.groupby("label"):
        x = np.array(part.embedding.tolist(), float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for i, row in zip(part.vec_id, x @ x.T >= 0.93, strict=True):
            links[i] = set(part.vec_id[row]) - {i}
    want = sum(len(x) for x in links.values())
    assert found.n_links.sum() >= 0.9 * want
    assert all(found.n_links[i] <= len(x) for i, x in links.items())
    docs = pd.read_parquet(f"{SMALL}/documents.parquet")
    items = pd.read_parquet(f"{SMALL}/benchmark.parquet")
    plain = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    grams = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    want = set()
    for doc, text in zip(docs.doc_id, docs.text, strict=True):
        own = grams(plain(text))
        have = set(own)
        for item, other in zip(items.item_id, items.text, strict=True):
            need = collections.Counter(grams(plain(other)))
            size = sum(need.values())
            if sum(g in have for g in need) < 0.5 * len(need):
                continue
            for i in range(len(own) - size + 1):
                both = sum((collections.Counter(own[i : i + size]) & need).values())
                if both >= 0.8 * (2 * size - both):
                    want.add((doc, item))
    got = driver.queries()["op2_decontamination"](spark, SMALL).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    assert want


def test_pipeline(spark):
    """Every stage keeps documents as they are but for its own decision."""
    import corpus_pipeline as pipeline

    data, names = SMALL, ["doc_id", "text", "lang", "source", "n_chars"]
    docs = spark.read.parquet(f"{data}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, step in pipeline.STAGES:
        path = fresh_path(spark)
        step(spark, docs, data).write.parquet(path)
        docs = spark.read.parquet(path)
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert set(after) <= set(before)
        if name != "mixing":
            assert docs.columns == names
        if name == "toxicity":
            rude = [i for i, t in before.items() if re.search("idiot|moron|scum|pathetic", t or "")]
            # Some ten labelled toxic documents are all there is to learn from at this size.
            assert sum(i in after for i in rude) <= 0.7 * len(rude)
            assert len(after) >= 0.8 * (len(before) - len(rude))
        if name == "near_copies":
            order = sorted(before)
            least = reach(plain_links([before[i] for i in order]))
            assert set(after) == {order[i] for i, k in least.items() if i == k}
        if name == "repeated_bytes":
            seen = set()
            for i in sorted(before):
                text = before[i].encode()
                gone = np.zeros(len(text), bool)
                for k in range(len(text) - 99):
                    piece = hashlib.md5(text[k : k + 100]).digest()
                    if piece in seen:
                        gone[k : k + 100] = True
                    seen.add(piece)
                own = np.frombuffer(text, np.uint8)
                # A character goes whole if any of its bytes does.
                first = np.flatnonzero((own & 0xC0) != 0x80)
                for a, b in zip(first, [*first[1:], len(own)]):
                    gone[a:b] = gone[a:b].any()
                assert after[i] == bytes(own[~gone]).decode()
                assert gone.any() or after[i] == before[i]
        before, whole = after, before
    assert all(r["taken"] > 0 for r in docs.collect())
    assert math.isclose(sum(r["taken"] for r in docs.collect()), sum(len((t or "").split()) for t in whole.values()), rel_tol=0.02)
