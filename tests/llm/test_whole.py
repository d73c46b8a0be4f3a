"""Operators over all rows of their input: nothing that a table holds is left out of the result."""

import random

import pytest

from factlens.llm import ngram_join


@pytest.mark.parametrize("block", [4, 256])
def test_ngram_join_counts_every_link(spark, monkeypatch, block):
    """Near copies of two texts, exact copies, repeated and null ids, texts without words: links against brute force."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    r = random.Random(5)
    texts = [None, "", "one", "one", "ONE", "one two"]
    for size, many in ((40, 40), (12, 3)):
        base = [f"b{size}-{i}" for i in range(size)]
        for _ in range(many):
            w = list(base)
            for _ in range(r.randint(0, size // 10)):
                w[r.randrange(size)] = f"x{r.randrange(60)}"
            texts.append(" ".join(w))
    texts += texts[6:12] + [texts[6]] * 3
    rows = [(None if i in (7, 50) else 3 if i in (3, 8) else i, t) for i, t in enumerate(texts)]

    def shingled(t):
        w = (t or "").lower().split()
        return {tuple(w[j : j + 4]) for j in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())

    sets = [shingled(t) for t in texts]
    want = [sum(i != j and 10 * len(a & b) >= 7 * len(a | b) for j, b in enumerate(sets)) if a else 0 for i, a in enumerate(sets)]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 4, 7, 10).collect()
    assert max(want) > 20
    assert sorted((str(x["doc_id"]), x["n_links"]) for x in got) == sorted((str(i), n) for (i, _), n in zip(rows, want, strict=True))
