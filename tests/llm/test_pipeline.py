"""Each stage of the pipeline against a brute-force version, over its own input: repeated and null ids, null and empty texts, extra columns."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from factlens.llm import language_id
from factlens.llm.scratch import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
STAGES = dict(corpus_pipeline.STAGES)
WORDS = {"en": "the of and thing there other water under house small great world every".split(), "fr": "le la elan queue etre oiseau maison petit grand monde chaque jour nuit".split()}


def corpus():
    r = random.Random(11)
    rows, texts = [], []
    for i in range(70):
        lang = ("en", "fr")[i % 2]
        texts.append("\n".join(" ".join(r.choice(WORDS[lang]) + r.choice(("", "s", "x")) for _ in range(r.randint(3, 12))) for _ in range(r.randint(1, 6))))
        rows.append((i, texts[-1], lang, ("a", "b", None)[i % 3]))
    for i in range(0, 70, 5):
        w = texts[i].split(" ")
        w[len(w) // 2] = "Edited"
        rows.append((100 + i, " ".join(w), "en", "a"))
    rows += [(i, texts[i], "en", "b") for i in (3, 3, 4)] + [(None, texts[6], "en", "a"), (None, texts[7].upper(), "fr", None), (300, None, "en", "a"), (301, "", "en", "a"), (302, "12 -- 34", "en", "a"), (303, "漢字 仮名", "en", "a")]
    rows += [(310 + i, "a line that many documents share\n" + texts[i], "en", "a") for i in (1, 2)] + [(3, "another text of the same document", "en", "a"), (320, " ".join(texts[9].split()[::-1]), "en", "b")]
    return [(*x, 0) for x in rows]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The input and output rows of each stage."""
    at = tmp_path_factory.mktemp("pipeline")
    rows = corpus()
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{at}/documents.parquet")
    items = [(1, " ".join((rows[9][1] or "").split())), (2, "too short"), (3, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    scratch, d, out = Scratch(spark, "stages"), spark.read.parquet(f"{at}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(x) for x in d.collect()]
        d = scratch.write(stage(spark, d, str(at)), name)
        out[name] = before, d
    return out, items, str(at)


def counted(rows):
    return collections.Counter(map(str, rows))


def test_columns_stay_until_the_mix(stages):
    out, _, _ = stages
    names = DOCS.replace(" long", "").replace(" string", "").split(", ")
    assert list(out) == ["language_id", "line_dedup", "ngram_join", "decontaminate", "mix"]
    assert all(d.columns == names for name, (_, d) in out.items() if name != "mix")


def test_language(spark, stages):
    before, d = stages[0]["language_id"]
    p = language_id.fit(spark.createDataFrame(before, DOCS))

    def stays(text):
        g = language_id.ranked(*language_id.grams(text or ""), p.top).tolist()
        at = {int(x): i for i, x in enumerate(p.known)}
        away = [sum(abs(k - p.rank[at[x]][j]) if x in at and p.rank[at[x]][j] >= 0 else p.top for k, x in enumerate(g)) for j in range(len(p.languages))]
        return bool(g) and 1 - min(away) / (p.top * len(g)) >= corpus_pipeline.LEAST_LIKE

    want = [x for x in before if stays(x[1])]
    assert counted(map(tuple, d.collect())) == counted(want) and len(before) - len(want) == 4


def test_lines(stages):
    before, d = stages[0]["line_dedup"]
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    no_id = 1 << 63
    where = collections.defaultdict(set)
    for i, t, *_ in before:
        for x in t.split("\n"):
            where[key(x)].add(no_id if i is None else i)
    keep = lambda i, x: len(key(x)) < 10 or len(where[key(x)]) < 2 or min(where[key(x)]) == (no_id if i is None else i)
    want = []
    for i, t, *rest in before:
        text = "\n".join(x for x in t.split("\n") if keep(i, x))
        want.append((i, text, *rest[:-1], len(text)))
    assert counted(map(tuple, d.collect())) == counted(want)


def test_near_copies(stages):
    before, d = stages[0]["ngram_join"]
    sets = []
    for _, t, *_ in before:
        w = t.lower().split()
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    up = list(range(len(before)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                up[top(i)] = top(j)
    groups = collections.defaultdict(list)
    for i, s in enumerate(sets):
        groups[top(i) if s else ("empty", i)].append(before[i])
    assert max(map(len, groups.values())) > 2
    got = [tuple(x) for x in d.collect()]
    assert len(got) == len(groups) and not counted(got) - counted(before)
    first = lambda x: (x[0] is None, x[0] or 0)
    assert sorted(map(first, got)) == sorted(min(map(first, g)) for g in groups.values())


def greedy_cover(item, doc, least=5):
    """Words of an item that greedy tiles of at least `least` words mark in a document."""
    used_a, used_b, total = [False] * len(item), [False] * len(doc), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and not used_a[i + n] and not used_b[j + n]:
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best
        if n < least:
            return total
        total += n
        for k in range(n):
            used_a[k - i] = used_b[k - j] = True


def test_benchmark(stages):
    out, items, _ = stages
    before, d = out["decontaminate"]
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    leak = lambda t: any(len(w) >= 5 and greedy_cover(w, words(t)) >= 0.8 * len(w) for w in (words(x) for _, x in items))
    want = [x for x in before if not leak(x[1])]
    assert counted(map(tuple, d.collect())) == counted(want) and len(want) < len(before)


def test_mix(spark, stages):
    out, _, at = stages
    before, d = out["mix"]
    got = d.collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = collections.Counter()
    for _, t, _, s, _ in before:
        total[s] += size(t)
    taken, goal = collections.Counter(), {}
    for r in got:
        assert r["size"] == size(r["text"]) and r["taken"] in (r["size"], 2 * r["size"]) and r["source_size"] == total[r["source"]]
        taken[r["source"]] += r["taken"]
        goal[r["source"]] = r["target"]
    most = max(size(t) for _, t, *_ in before)
    assert sum(goal.values()) == pytest.approx(1.5 * sum(total.values()))
    assert all(abs(taken[s] - goal[s]) <= 2 * most and goal[s] <= 2 * total[s] for s in goal)
    assert not counted(tuple(r)[:5] for r in got) - counted(before)
    assert counted(map(tuple, corpus_pipeline.run(spark, at).collect())) == counted(map(tuple, got))


def test_empty_tables_and_clashing_columns(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    empty = spark.createDataFrame([], DOCS)
    extra = spark.createDataFrame([(1, "the same house is there under every great small world", "en", "a", 0)] * 2, DOCS)
    for name in ("score", "gone", "e", "root", "__taken", "line", "n_lines"):
        extra = extra.withColumn(name, F.lit("clash"))
    for name, stage in STAGES.items():
        assert stage(spark, empty, str(tmp_path)).count() == 0
        got = stage(spark, extra, str(tmp_path))
        assert got.count() == (1 if name == "ngram_join" else 2) and set(got.columns) >= set(extra.columns)
