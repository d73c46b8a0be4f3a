"""Each operator against a brute-force version, over nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from factlens.llm import decontaminate, exact_dedup, html_text, language_id, line_dedup, lm_scoring, mixing, ngram_join, token_counts
from factlens.llm.components import components
from factlens.llm.scratch import Scratch
from factlens.llm.text import plain, shingles, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=0, n=60):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    base = [[" ".join(r.choice(vocab) for _ in range(r.randint(3, 14))) for _ in range(r.randint(1, 9))] for _ in range(n)]
    texts = ["\n".join(x) for x in base]
    for i in range(0, n, 4):
        w = texts[i].split(" ")
        w[r.randrange(len(w))] = "Edited"
        texts.append(" ".join(w))
    texts += [texts[1], texts[1], texts[2].upper(), None, "", "\n\n", " \t ", "one", "one two", "\n".join(["a repeated line here"] * 3), "A Repeated Line Here  \nother", " ".join(r.choice(vocab) for _ in range(5000))]
    return [(i, t, "en" if i % 3 else None, ("a", "b", None)[i % 3], 0) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def shingle_sets(rows, k):
    out = {}
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    return out


def brute_components(sets, num, den):
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


@pytest.mark.parametrize(("k", "num", "den"), [(4, 85, 100), (5, 4, 5), (2, 1, 2)])
def test_ngram_join(docs, rows, k, num, den):
    got = by_id(ngram_join.jaccard_components(docs, k, num, den))
    sets = shingle_sets(rows, k)
    want = brute_components(sets, num, den)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == {i: (len(sets[i]), want[i]) for i in sets}


def test_ngram_join_cluster(spark, monkeypatch):
    """Many copies that differ in a few words: compared in small blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    r = random.Random(3)
    base = [f"b{i}" for i in range(40)]
    rows = []
    for i in range(50):
        w = list(base)
        for _ in range(r.randint(0, 5)):
            w[r.randrange(len(w))] = f"x{r.randrange(60)}"
        rows.append((i, " ".join(w), "en", "s", 0))
    got = by_id(ngram_join.jaccard_components(spark.createDataFrame(rows, DOCS), 4, 7, 10))
    assert {i: x["component_id"] for i, x in got.items()} == brute_components(shingle_sets(rows, 4), 7, 10)


def test_ngram_join_edges(spark, empty):
    assert ngram_join.jaccard_components(empty).count() == 0
    rows = [(None, "a b c d e f", "x", "y", 0), (5, "a b c d e f", "x", "y", 0), (5, "a b c d e f", "x", "y", 0), (6, None, "x", "y", 0)]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((str(r["doc_id"]), r["component_id"]) for r in got) == [("5", 5), ("5", 5), ("6", 6), ("None", 5)]


def test_components_by_brute_force(spark):
    r = random.Random(1)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    up = {x: x for e in edges for x in e}
    for _ in up:
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"), "t").collect()}
    assert got == {x: y for x, y in up.items() if any(x in e and e[0] != e[1] for e in edges)}


def test_words_and_shingles():
    texts = ["The cat\tsat", "", "THE CAT SAT ON", "x\x0by\x0cz", "é É"]
    h, off = words(plain(__import__("pyarrow").array(texts)))
    assert np.diff(off).tolist() == [3, 0, 4, 3, 2]
    assert (h[:3] == h[3:6]).all() and h[-1] != h[-2] and len(set(h[6:].tolist())) == 6
    g, o = shingles(h, off, 3)
    assert np.diff(o).tolist() == [1, 0, 2, 1, 1] and g[0] in g[1:3]


def test_exact_dedup(docs, rows, empty, spark):
    for block in (4, 4096):
        got = by_id(exact_dedup.exact_dedup(docs, block))
        same = collections.defaultdict(list)
        for i, t, *_ in rows:
            same[t or ""].append(i)
        for i, t, *_ in rows:
            g = same[t or ""]
            assert tuple(got[i])[1:] == (max(g), len(g), i == max(g), hashlib.sha256((t or "").encode()).hexdigest())
    assert exact_dedup.exact_dedup(empty).count() == 0
    null = spark.createDataFrame([(None, "a", "", "", 0), (1, "a", "", "", 0), (1, "a", "", "", 0)], DOCS)
    assert sorted((str(r["doc_id"]), r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(null).collect()) == [("1", 1, 3, True), ("1", 1, 3, True), ("None", 1, 3, False)]


def test_exact_dedup_hot_block(spark):
    rows = [(i, "same text" if i % 3 else f"t{i}", "", "", 0) for i in range(90)]
    got = by_id(exact_dedup.exact_dedup(spark.createDataFrame(rows, DOCS), 4))
    assert got[1]["group_size"] == 60 and got[1]["keep_id"] == 89 and got[3]["group_size"] == 1


def test_line_dedup(docs, rows, empty):
    space = " \t\n\x0b\x0c\r"
    key = lambda x: x.strip(space).translate({c: c + 32 for c in range(65, 91)})
    where = collections.defaultdict(set)
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            where[key(x)].add(i)
    got = by_id(line_dedup.dedup_lines(docs, shard_keys=50))
    assert sum(r["n_dropped"] for r in got.values()) > 0
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or len(where[key(x)]) < 2 or min(where[key(x)]) == i]
        assert (got[i]["text"], got[i]["n_lines"], got[i]["n_dropped"]) == ("\n".join(kept), len(lines), len(lines) - len(kept))
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_dedup_extra_columns_and_null_id(spark):
    df = spark.createDataFrame([(None, "a repeated line", 7), (2, "A REPEATED LINE\t", 8)], "doc_id long, text string, n_lines long").withColumn("gone", F.lit("x")).withColumn("shard", F.lit(1))
    out = line_dedup.dedup_lines(df.drop("gone"))
    assert sorted(out.columns) == ["doc_id", "n_dropped", "n_lines", "shard", "text"]
    assert sorted((str(r["doc_id"]), r["text"], r["n_dropped"]) for r in out.collect()) == [("2", "A REPEATED LINE\t", 0), ("None", "", 1)]


def test_perfect_hash():
    r = np.random.default_rng(0)
    a, b = (r.integers(0, 1 << 63, 5000).astype(np.uint64) for _ in range(2))
    a[1] = a[0]
    h = line_dedup.PerfectHash(*line_dedup.PerfectHash.build(a, b))
    assert sorted(h.slots(a, b).tolist()) == list(range(5000))
    assert len(line_dedup.PerfectHash(*line_dedup.PerfectHash.build(a[:0], b[:0])).slots(a[:0], b[:0])) == 0


def test_language(spark, empty):
    r = random.Random(0)
    words_ = {"en": "the of and thing there other".split(), "fr": "le la élan queue étre oiseau".split()}
    rows = [(i, " ".join(r.choice(words_[x]) for _ in range(40)), x, "s", 0) for i in range(80) for x in [("en", "fr")[i % 2]]]
    rows += [(80, None, "en", "s", 0), (81, "", "fr", "s", 0), (82, "12 !!", None, "s", 0), (83, "the thing", None, "s", 0)]
    df = spark.createDataFrame(rows, DOCS)
    p = language_id.fit(df.where("doc_id % 4 != 0"))
    got = by_id(language_id.predict(df.withColumn("score", F.lit("clash")), p))
    assert all(got[i]["lang_pred"] == x for i, _, x, *_ in rows[:80]) and got[83]["lang_pred"] == "en"
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (80, 81, 82)) and all(0 <= x["score"] <= 1 for x in got.values())
    # by the definition of the distance
    g = language_id.ranked(*language_id.grams(rows[0][1]), p.top).tolist()
    known = {int(x): i for i, x in enumerate(p.known)}
    away = [sum(abs(k - p.rank[known[x]][j]) if x in known and p.rank[known[x]][j] >= 0 else p.top for k, x in enumerate(g)) for j in range(2)]
    assert got[0]["score"] == pytest.approx(1 - min(away) / (p.top * len(g)))
    assert language_id.predict(empty, language_id.fit(empty)).count() == 0
    assert {x["doc_id"] for x in language_id.keep_known(df).collect()} == {*range(80), 83}


def test_lm_scoring(docs, rows, empty):
    got = by_id(lm_scoring.score(docs, batch_bytes=2000, shard_keys=500))
    toks = {i: [*(t or "").encode().lower().split(), None] for i, t, *_ in rows}
    train = {i for i in toks if zlib.crc32(str(i).encode()) % 5 != 1}
    c, pairs = collections.Counter(), collections.Counter()
    for i in train:
        c.update(toks[i])
        pairs.update(zip(["start", *toks[i]], toks[i], strict=False))
    n, v = sum(c.values()), len(c)
    for i, t in toks.items():
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t))
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"], got[i]["held_out"]) == (len(t), sum(c[x] > 0 for x in t), n, i not in train)
        assert got[i]["score"] <= 0
    assert sum(got[i]["score"] for i in train) > sum(got[i]["base_score"] for i in train)
    assert lm_scoring.score(empty).count() == 0


def test_lm_weights_are_a_mixture(spark):
    cases = spark.createDataFrame([(2, 1, 2, 3, 10), (3, 0, 5, 1, 4), (0, 0, 0, 2, 1)], "bucket long, pair long, context long, word long, times long")
    w = lm_scoring.learn(cases, 100, 20)
    assert np.allclose(w.sum(1), 1) and w[0, 0] == 0 and w[2, 0] > 0.9 and (w[:, 2] > 0).all()


def test_lm_packing():
    x = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 999).astype(np.uint64))
    assert (lm_scoring.unpack_sorted(lm_scoring.pack_sorted(x)) == x).all()


PAGES = [
    ("", ""),
    (None, ""),
    ("<p>only", "only"),
    ("<html><body><nav><ul><li><a href=/>Home</a></ul></nav><div class='sidebar'>Side text, with commas, here</div><article><header>By me</header><h1>Head</h1><p>One &amp; two,\n three<p>Four<br>five &#233;</article><div id=comments><p>A reader, said, something long enough to score</div><footer>c</footer>", "Head\n\nOne & two, three\n\nFour five é"),
    ("<body><div class='cookie-notice'>We use cookies</div><div id=content><p>The first paragraph is long enough, with a comma.</p><p>So is the second one, it has words enough.</p></div><form>Sign <p>up now, please, do</p></form><div class=ad>Buy</div>", "The first paragraph is long enough, with a comma.\n\nSo is the second one, it has words enough."),
    ("<article><p>kept text<script>var a='</p>'</script></p></article><foo", "kept text"),
]


def test_html(spark):
    rows = [(i, None if i == 1 else "u", h) for i, (h, _) in enumerate(PAGES)]
    got = {r["page_id"]: r for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, (_, want) in enumerate(PAGES):
        assert (got[i]["text"], got[i]["n_chars"]) == (want, len(want))


def test_mixing(docs, rows, empty):
    got = by_id(mixing.mix(docs, part_rows=20))
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in rows}
    source = {i: s for i, _, _, s, _ in rows}
    total = collections.Counter()
    for i, s in source.items():
        total[s] += size[i]
    goal = {got[i]["source_size"]: got[i]["target"] for i in got}
    assert sum(goal.values()) == pytest.approx(1.5 * sum(total.values())) and all(t <= 2 * s for s, t in goal.items())
    for s in total:
        mine = [i for i in source if source[i] == s]
        assert all(got[i]["size"] == size[i] and got[i]["source_size"] == total[s] and got[i]["taken"] in (0, size[i], 2 * size[i]) for i in mine)
        assert abs(sum(got[i]["taken"] for i in mine) - got[mine[0]]["target"]) <= 2 * max(size[i] for i in mine)
    assert sum(r["taken"] for r in got.values()) <= 1.5 * sum(total.values())
    again = by_id(mixing.mix(docs.repartition(2), part_rows=7))
    assert {i: r["taken"] for i, r in got.items()} == {i: r["taken"] for i, r in again.items()}
    assert mixing.mix(empty).count() == 0


def test_tiles_and_leaks(spark, empty):
    w = lambda n, m: [f"q{i}" for i in range(n, m)]
    item = " ".join(w(0, 30))
    benchmark = spark.createDataFrame([(1, item), (2, None), (3, "too short"), (4, " ".join(w(100, 120)))], "item_id long, text string")
    rows = [
        (1, "start " + item.upper() + "! end", "", "", 0),
        (2, " ".join([*w(15, 30), "mid", *w(0, 15)]), "", "", 0),
        (3, " ".join(w(0, 20)), "", "", 0),
        (4, None, "", "", 0),
        (5, "too short", "", "", 0),
        (6, " ".join([*w(0, 10), "x", *w(11, 21), "y", *w(22, 30)]), "", "", 0),
    ]
    df = spark.createDataFrame(rows, DOCS)
    for block_words in (10, 10_000):
        got = {(r["doc_id"], r["item_id"]): r["coverage"] for r in decontaminate.leaks(df, benchmark, block_words=block_words).collect()}
        assert got == {(1, 1): 1.0, (2, 1): 1.0, (6, 1): pytest.approx(28 / 30), (5, 3): 1.0}
        assert sorted(r["doc_id"] for r in decontaminate.clean(df, benchmark, block_words=block_words).collect()) == [3, 4, 5]
    assert decontaminate.leaks(empty, benchmark).count() == 0 and decontaminate.leaks(df, benchmark.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_tiles_by_brute_force(seed):
    r = random.Random(seed)
    a, b = ([r.randrange(4) for _ in range(n)] for n in (18, 30))
    got = decontaminate.tiles(np.array(a, np.uint64), np.array(b, np.uint64), 3)
    x, y = [False] * len(a), [False] * len(b)
    want = []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not x[i + n] and not y[j + n]:
                    n += 1
                if n > best[2]:
                    best = (i, j, n)
        if best[2] < 3:
            break
        want.append(best)
        for k in range(best[2]):
            x[best[0] + k] = y[best[1] + k] = True
    assert sorted(t[2] for t in got) == sorted(t[2] for t in want)


def test_token_rollup(spark, tmp_path):
    cols = "source string, lang string, tokenizer_version string, tokens long, old_tokens long"
    a = spark.createDataFrame([("s", "en", "1", 5, 0), ("s", None, "1", 2, 0), (None, "en", "1", 0, 0), ("t", "en", "1", 4, 0)], cols)
    roll = token_counts.Rollup(spark, f"file://{tmp_path}/r")
    assert roll.totals().count() == 0
    roll.commit("a", token_counts.inserted(a))
    for _ in range(3):
        roll.commit("b", token_counts.deleted(a.where("source = 't'")).union(token_counts.revised(spark.createDataFrame([("s", "en", "1", 9, 5)], cols))))
    assert {tuple(r) for r in roll.totals().collect()} == {("s", "en", "1", 1, 9), ("s", None, "1", 1, 2), (None, "en", "1", 1, 0)}
    assert roll.batches() == ["a", "b"]
    want = {tuple(r) for r in roll.totals().collect()}
    # a batch that was not completed does not count, and its number is not taken again
    a.write.parquet(f"{tmp_path}/r/b-000000000099-a")
    (tmp_path / "r/b-000000000099-a/_SUCCESS").unlink()
    for _ in range(2):
        roll.compact()
        assert {tuple(r) for r in roll.totals().collect()} == want and roll.batches() == ["a", "b"]
    # a batch that was compacted is replaced too
    roll.commit("b", token_counts.deleted(a.where("source = 't'")))
    assert {tuple(r) for r in roll.totals().collect()} == {("s", "en", "1", 1, 5), ("s", None, "1", 1, 2), (None, "en", "1", 1, 0)}
    roll.commit("none", token_counts.inserted(a.limit(0)))
    assert roll.batches() == ["a", "b", "none"]
    with pytest.raises(ValueError):
        roll.commit("a/b", a)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_have_the_tokens_of_whole_texts(spark, name):
    """Words, signs and white space of all sorts in a row, cut and counted apart, against the tokenizer over whole texts."""
    from tokenizers import Tokenizer

    r = random.Random(8)
    parts = ["word", "it's", "we'LL", "  ", " ", "\n", "\n\n", "\t", "\r\n", "\u00a0", "\u2003 ", "\x1c", "é", "ß.", "12", "3.5", "...", "(", "漢字", "😀", "<|endoftext|>", "_x_", "-", "\u200b", "A"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(600)] + [None, "", " ", "a "]
    model = Tokenizer.from_file(f"/opt/tokenizers/{name}")
    model.encode_special_tokens = True
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    got = {x["i"]: x["tokens"] for x in token_counts.bpe_tokens(df, f"/opt/tokenizers/{name}").collect()}
    assert got == {i: len(model.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_rollup_of_a_vocabulary(spark, docs, rows, tmp_path):
    """The query's totals against the tokenizer itself."""
    from tokenizers import Tokenizer

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    model = Tokenizer.from_file(token_counts.VOCABULARY)
    want = collections.defaultdict(lambda: [0, 0])
    for i, t, lang, source, _ in rows:
        if i % 10 != 3:
            group = want[source, lang]
            group[0] += 1
            group[1] += len(model.encode(t or "", add_special_tokens=False).ids) + (i % 10 == 7)
    got = {(r["source"], r["lang"]): [r["docs"], r["tokens"]] for r in token_counts.op2(spark, str(tmp_path)).collect() if r["tokenizer_version"] == "byte_bpe_50k"}
    assert got == want


def test_bpe_tokens(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    model = Tokenizer(models.WordLevel({"a": 0, "b": 1, "?": 2}, "?"))
    model.pre_tokenizer = pre_tokenizers.Whitespace()
    model.save(f"{tmp_path}/v.json")
    df = spark.createDataFrame([("a b c",), (None,), ("",)], "text string")
    assert [r["tokens"] for r in token_counts.bpe_tokens(df, f"{tmp_path}/v.json").collect()] == [3, 0, 0]
