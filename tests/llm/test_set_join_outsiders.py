"""Buckets of one large group and some hundred other sets are settled without a further split."""

import random

from cladeframe.llm import set_join as module
from cladeframe.llm.set_join import BLOCK_SETS, SMALL_BUCKET, set_join

GROUP, OTHERS = 640, 100


def _shingles(text):
    words = text.split()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def test_buckets_with_a_block_of_others_go_no_deeper(spark, monkeypatch):
    assert SMALL_BUCKET < OTHERS < BLOCK_SETS < GROUP
    dice = random.Random(3)
    passage, base = [f"p{i}" for i in range(60)], [f"b{i}" for i in range(60)]
    texts = []
    for i in range(GROUP):
        own = list(base)
        own[dice.randrange(60)] = f"x{i}"
        texts.append(" ".join(passage + own))
    for i in range(OTHERS):
        texts.append(" ".join(passage + [f"w{dice.randrange(10**6)}" for _ in range(60)]))
    # Two pairs among the others.
    texts += [texts[-1] + " more", texts[-2] + " more"]
    dice.shuffle(texts)
    sets = [_shingles(t) for t in texts]
    near = [[10 * len(a & b) >= 8 * len(a | b) for b in sets] for a in sets]
    deep, plain = [], module._placed
    monkeypatch.setattr(module, "_placed", lambda *args: deep.append(1) or plain(*args))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    found = {r["doc_id"]: r for r in set_join(docs).collect()}
    assert {i: r["n_links"] for i, r in found.items()} == {i: sum(row) - 1 for i, row in enumerate(near)}
    for i, row in enumerate(near):
        assert len({found[j]["component_id"] for j, linked in enumerate(row) if linked}) == 1
    # One look at large buckets, after the first level; before, these were split at the second as well.
    assert len(deep) == 1
