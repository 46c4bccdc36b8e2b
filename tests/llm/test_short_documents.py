"""Documents with fewer words than the benchmark item they hold most of."""

import collections

import pytest

from cladeframe.llm.decontamination import contaminated, decontaminate

ITEM = [f"w{i}" for i in range(64)]
OTHER = [f"v{i % 9}" for i in range(30)]
TEXTS = {
    1: ITEM[:60],
    2: ITEM[4:],
    3: ITEM[:52],
    4: ITEM[:51],
    5: ITEM[:30] + ["x"] + ITEM[30:60],
    6: ITEM[:60] + ["x"] * 3,
    7: ITEM[:4],
    8: OTHER[:26],
    9: OTHER[:24],
    10: ["y", *ITEM, "y"],
    11: [],
    12: ["one"],
}


def grams(words, n):
    return collections.Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def test_short_documents(spark):
    items = {1: ITEM, 2: OTHER, 3: ["one", "two"]}
    want = {}
    for d, text in TEXTS.items():
        for i, item in items.items():
            n = min(5, len(item))
            need, best = grams(item, n), []
            for at in range(max(0, len(text) - len(item)) + 1):
                own = grams(text[at : at + len(item)], n)
                both = sum((own & need).values())
                share = both / (sum(own.values()) + sum(need.values()) - both)
                if share >= 0.8:
                    best.append((-share, at))
            if best:
                want[d, i] = (pytest.approx(-min(best)[0]), min(best)[1], len(best))
    assert {(1, 1), (2, 1), (3, 1), (8, 2)} <= set(want) and (4, 1) not in want
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in TEXTS.items()], "doc_id bigint, text string")
    benchmark = spark.createDataFrame([(i, " ".join(t)) for i, t in items.items()], "item_id bigint, text string")
    found = contaminated(docs, benchmark).collect()
    assert {(r["doc_id"], r["item_id"]): (r["similarity"], r["start"], r["n_windows"]) for r in found} == want
    clean = {r["doc_id"] for r in decontaminate(docs, benchmark).collect()}
    assert clean == set(TEXTS) - {d for d, _ in want}
