"""Items and windows whose n-grams repeat, and pairs that share too little to be compared."""

import collections
import random

import pytest

from cladeframe.llm.decontamination import contaminated, decontaminate

ITEMS, LENGTH, KEPT = 30, 300, 269


def grams(words, n=5):
    return collections.Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def share(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def made(where):
    """Items and documents that hold most of them with one filler word at an end, both ends or inside."""
    rng = random.Random(where)
    items, docs = {}, {}
    for i in range(ITEMS):
        item = [f"w{rng.randrange(10**6)}" for _ in range(LENGTH)]
        filler = ["um"] * (LENGTH - KEPT)
        half = len(filler) // 2
        body = {
            "end": item[:KEPT] + filler,
            "start": filler + item[LENGTH - KEPT :],
            "both": filler[:half] + item[half : half + KEPT] + filler[half:],
            "inside": item[:136] + filler[:-4] + item[136 + len(filler) - 4 :],
        }[where]
        items[i], docs[i] = item, body
    return items, docs


def frame(spark, texts, name):
    return spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], f"{name} bigint, text string")


@pytest.mark.parametrize("where", ["end", "start", "both", "inside"])
def test_filler_words_hide_nothing(spark, where):
    items, docs = made(where)
    near = {i for i in items if share(grams(items[i]), grams(docs[i])) >= 0.8}
    assert len(near) == ITEMS
    found = contaminated(frame(spark, docs, "doc_id"), frame(spark, items, "item_id")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(i, i) for i in near}
    for r in found:
        window = docs[r["doc_id"]][r["start"] : r["start"] + LENGTH]
        assert r["similarity"] == pytest.approx(share(grams(window), grams(items[r["item_id"]])))


def test_windows_of_few_words(spark):
    """Random texts of three words, where nearly every n-gram repeats, against all windows."""
    rng = random.Random(4)
    texts = {i: rng.choices("abc", weights=[8, 1, 1], k=rng.randint(10, 60)) for i in range(25)}
    items = {i: rng.choices("abc", weights=[8, 1, 1], k=rng.randint(5, 30)) for i in range(12)}
    want = {}
    for d, text in texts.items():
        for i, item in items.items():
            best = []
            for at in range(max(0, len(text) - len(item)) + 1):
                s = share(grams(text[at : at + len(item)]), grams(item))
                if s >= 0.8 - 1e-9:
                    best.append((-s, at))
            if best:
                want[d, i] = (pytest.approx(-min(best)[0]), min(best)[1], len(best))
    found = contaminated(frame(spark, texts, "doc_id"), frame(spark, items, "item_id"), radius=32).collect()
    assert {(r["doc_id"], r["item_id"]): (r["similarity"], r["start"], r["n_windows"]) for r in found} == want
    assert want


def test_names_of_the_caller_stay(spark):
    items, docs = made("end")
    more = frame(spark, docs, "doc_id").selectExpr("*", "'x' AS _bad", "'x' AS grams", "'x' AS item_id", "'x' AS size")
    left = decontaminate(more.limit(5).unionByName(more.selectExpr("doc_id + 1000 AS doc_id", "'clean' AS text", "_bad", "grams", "item_id", "size")), frame(spark, items, "item_id"))
    assert left.columns == more.columns
    assert {r["doc_id"] for r in left.collect()} == {i + 1000 for i in docs}
