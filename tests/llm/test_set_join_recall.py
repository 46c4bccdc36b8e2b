"""Pairs whose tokens all stand in many other sets are found as often as promised."""

import collections
import random

from cladeframe.llm.set_join import SMALL_BUCKET, set_join

SIZE, PAIRS, VOCABULARY = 40, 400, 100


def test_recall_where_every_token_is_common(spark):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(VOCABULARY)]
    texts = []
    for _ in range(PAIRS):
        whole = rng.sample(words, SIZE)
        texts += [whole, rng.sample(whole, SIZE * 8 // 10)]
    sets = [frozenset(t) for t in texts]
    assert len(set(sets)) == len(sets)
    seen = collections.Counter(w for s in sets for w in s)
    assert min(seen.values()) > 2 * SMALL_BUCKET
    near = lambda a, b: 10 * len(a & b) >= 8 * len(a | b)
    want = {i: {j for j, b in enumerate(sets) if j != i and near(a, b)} for i, a in enumerate(sets)}
    # Nothing but the pairs, so that no link is found through another one.
    assert want == {i: {i ^ 1} for i in want}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    found = {r["doc_id"]: r["n_links"] for r in set_join(docs, words=1).collect()}
    assert all(n <= len(want[i]) for i, n in found.items())
    assert sum(found.values()) >= 0.995 * sum(len(x) for x in want.values())
