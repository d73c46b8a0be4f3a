"""Whole results in hard cases: hot keys, long and nested texts, repeats, ties, nulls, empty tables, clashing columns; each against brute force."""

import collections
import hashlib
import math
import random
import resource
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from factlens.llm import decontaminate, exact_dedup, html_text, language_id, line_dedup, lm_scoring, mixing, ngram_join, token_counts

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def clashing(df, *names):
    for n in names:
        df = df.withColumn(n, F.lit("clash"))
    return df


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# --- exact dedup ----------------------------------------------------------------------------


def test_hot_texts_of_many_blocks(spark):
    """A third of all rows is one text of many blocks, and others share its pairs of blocks, surrogates included."""
    long = "".join(chr(97 + i % 7) for i in range(60)) + "😀" * 9
    texts = [long] * 40 + [long[:-1]] * 20 + [long + "x", long[4:], "", None] + [f"{i}{long}" for i in range(30)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = by_id(exact_dedup.exact_dedup(clashing(df, "name", "row", "rounds", "keep_id", "salt"), 4))
    same = collections.defaultdict(list)
    for i, t in enumerate(texts):
        same[t or ""].append(i)
    assert {i: tuple(r)[1:] for i, r in got.items()} == {i: (max(same[t or ""]), len(same[t or ""]), i == max(same[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in enumerate(texts)}


# --- html -----------------------------------------------------------------------------------

BODY = "".join(f"<p>Sentence number {i} of the article, with a comma and enough words to count.</p>" for i in range(4))
TEXT = "\n\n".join(f"Sentence number {i} of the article, with a comma and enough words to count." for i in range(4))


@pytest.mark.parametrize("wrapper", ["div class='content has-sidebar'", "div class='layout no-sidebar'", "div class='post tags-news'", "div class='main ad-free'", "div class='single header-fixed'", "section class='related-work'", "div id='with-nav'", "form action='/'", "div class='comments'"])
def test_names_around_an_article(wrapper):
    tag = wrapper.split()[0]
    assert html_text.main_text(f"<body><nav><a href=/>Home</a></nav><{wrapper}>{BODY}</{tag}><div class='sidebar'>Side, text</div><footer>c</footer></body>") == TEXT


@pytest.mark.parametrize("box", ["<div class='site-footer'>", "<div class='comment-list'><p>A reader, says, something, long enough to score a lot of points here.</p>", "<div class='cookieNotice'>", "<aside>", "<div hidden>", "<div role='complementary'>", "<form>", "<div class='post-tags'><a href=/>one</a>", "<ul class='share2 links'>", "<div style='display: none'>"])
def test_boxes_beside_an_article(box):
    tag = box[1:].split(">")[0].split()[0]
    for page in (f"<main>{BODY}{box}<p>Not the article, but, some, other text.</p></{tag}></main>", f"<div>{BODY}{box}<p>Not the article, but, some, other text.</p></{tag}></div>"):
        assert html_text.main_text(page) == TEXT


@pytest.mark.parametrize("seed", range(30))
def test_articles_in_random_pages(seed):
    """An article of known paragraphs among menus, adverts and comments, in divs, sections or an article, properly nested or not."""
    r = random.Random(seed)
    vocab = [f"word{i}" for i in range(80)] + ["naïve", "&amp;", "&#233;t&eacute;"]
    plain = lambda t: t.replace("&amp;", "&").replace("&#233;t&eacute;", "été")
    paragraphs = [" ".join(r.choice(vocab) for _ in range(r.randint(8, 60))) + ", end." for _ in range(r.randint(2, 12))]
    inner = "".join(f"<p>{x}</p>" if r.random() < 0.8 else f"<p><b>{x}</b>" for x in paragraphs)
    side = [f"<nav><ul>{'<li><a href=/>Item one</a>' * r.randint(1, 9)}</ul></nav>", "<div class=ad>Buy this, now, please, today</div>", "<div class='widget social'>Follow us, here, and, there</div>", "<header>The site</header>", "<script>if (a<b) x('<p>no</p>')</script>", f"<div id=comments>{'<p>I think, as a reader, that this is so, really.</p>' * r.randint(1, 4)}</div>"]
    tag = r.choice(("article", "div", "section", "main"))
    page = "<html><body>" + "".join(r.sample(side, r.randint(1, 6))) + f"<{tag}>{inner}</{tag}>" + "".join(r.sample(side, r.randint(0, 3))) + "<footer>&copy; 2020, all, rights</footer>"
    assert html_text.main_text(page) == "\n\n".join(map(plain, paragraphs))


def test_deep_and_stray_nesting_is_linear():
    for page in ("<div>" * 200_000 + "deep text that is long enough to be a paragraph" + "</div>" * 200_000, "<div>" * 100_000 + "<p>text of the page</p>" + "</section></b>" * 100_000, "<p>" + "<span>" * 100_000 + "<div>x</div>" * 1000, "<table><tr><td><p>" + "<div>" * 50_000 + "text"):
        began = time.perf_counter()
        assert html_text.main_text(page)
        assert time.perf_counter() - began < 20


def test_html_rows(spark):
    df = spark.createDataFrame([(1, "u", f"<article>{BODY}</article>")] * 2 + [(None, None, None)], "page_id long, url string, html string")
    got = html_text.extract(clashing(df, "text", "n_chars")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(1, "u", TEXT, len(TEXT))] * 2 + [(None, None, "", 0)]))
    assert html_text.extract(df.limit(0)).count() == 0


# --- mixing ---------------------------------------------------------------------------------


def mix_rows():
    rows = [(1, "a b c", "x", "s", 0), (1, "a b", "x", "t", 0), (1, "a b", "x", "t", 0), (2, None, "x", "s", 0), (None, "q " * 30, "x", None, 0)]
    return rows + [(i % 9, "w " * (1 + i % 5), "x", ("s", "t", None)[i % 3], 0) for i in range(60)]


def test_mix_of_repeated_ids_does_not_depend_on_order(spark):
    key = lambda df: sorted(map(str, (tuple(r) for r in df.drop("__row").collect())))
    rows = mix_rows()
    a = key(mixing.mix(spark.createDataFrame(rows, DOCS)))
    assert a == key(mixing.mix(spark.createDataFrame(rows[::-1], DOCS).repartition(3))) and len(a) == len(rows)


def test_mixed_keeps_each_row_once(spark):
    rows = mix_rows()
    df = clashing(spark.createDataFrame(rows, DOCS), "taken", "__row", "size")
    taken = mixing.mix(spark.createDataFrame(rows, DOCS)).where("taken > 0").collect()
    got = mixing.mixed(df).collect()
    assert len(got) == len(taken) and sum(r["taken"] for r in got) == sum(r["taken"] for r in taken)
    assert all(r["size"] == len((r["text"] or "").split()) and r["taken"] <= 2 * r["size"] for r in got)
    two = spark.createDataFrame([(1, "a b c", "x", "s", 0), (1, "a b c", "x", "t", 0)], DOCS)
    assert mixing.mixed(two).count() == 2
    assert mixing.mixed(df.limit(0)).count() == 0


# --- decontamination ------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(6))
def test_tiles_by_length_are_the_same(seed):
    r = random.Random(seed)
    item, doc = (np.array([r.randrange(k) for _ in range(n)], np.uint64) for k, n in ((3, 40), (3, 70)))
    assert sorted(decontaminate.tiles(item, doc, 3)) == sorted(decontaminate.tiles_by_length(item, doc, 3)) == sorted(decontaminate.tiles(item, doc, 3, most=5))


def test_tiles_of_repeated_words_take_bounded_memory():
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    item, doc = np.full(10_000, 7, np.uint64), np.full(100_000, 7, np.uint64)
    assert decontaminate.tiles(item, doc, 5) == [(0, 0, 10_000)]
    half = item.copy()
    half[5000] = 8
    assert sorted(t[2] for t in decontaminate.tiles(half, doc, 5)) == [4999, 5000]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000


def test_leaks_of_short_repeated_and_clashing_rows(spark):
    items = [(1, "alpha beta"), (1, "alpha beta"), (2, " ".join("abcdefgh")), (3, ""), (None, "gamma")]
    rows = [(1, "x ALPHA, beta y", 0), (1, "x ALPHA, beta y", 0), (2, "beta alpha", 0), (3, "a b c d e f g h " * 3, 0), (None, "gamma", 0)]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string, n_words long"), "coverage", "item_id")
    bench = clashing(spark.createDataFrame(items, "item_id long, text string"), "doc_id")
    got = [(r["doc_id"], r["item_id"], r["n_words"], r["n_marked"], r["coverage"]) for r in decontaminate.leaks(df, bench, block_words=3).collect()]
    assert collections.Counter(got) == collections.Counter([(1, 1, 2, 2, 1.0)] * 4 + [(3, 2, 8, 8, 1.0), (None, None, 1, 1, 1.0)])
    kept = decontaminate.clean(df, bench)
    assert kept.columns == df.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "1", "2", "None"]


# --- language models ------------------------------------------------------------------------


def brute_scores(rows, batch_of):
    """Deleted interpolation of the rows (key, text, train), in plain Python."""
    tokens = {k: [*(t or "").encode().lower().split(), None] for k, t, _ in rows}
    pairs = {k: list(zip(["start", *t[:-1]], t, strict=True)) for k, t in tokens.items()}

    def counts(keys):
        one = collections.Counter(x for k in keys for x in tokens[k])
        return one, collections.Counter(p for k in keys for p in pairs[k])

    train = [k for k, _, is_train in rows if is_train]
    deleted = [k for k in train if batch_of[k] % lm_scoring.DELETE == 0]
    one, two = counts([k for k in train if k not in set(deleted)])
    # a text's start is counted as its end is
    context = lambda c, v: c[None] if v == "start" else c[v]
    bucket = lambda c: min(int(math.log2(c)) + 1, lm_scoring.BUCKETS - 1) if c else 0
    n, v = sum(one.values()), len(one)
    parts = lambda one, two, n, v, p: (two[p] / context(one, p[0]) if context(one, p[0]) else 0.0, one[p[1]] / max(n, 1), 1 / (v + 1))
    weight = {b: [0.5, 0.4, 0.1] if b else [0.0, 0.8, 0.2] for b in range(lm_scoring.BUCKETS)}
    cases = [(bucket(context(one, p[0])), parts(one, two, n, v, p)) for k in deleted for p in pairs[k]]
    for _ in range(lm_scoring.ROUNDS):
        mine = collections.defaultdict(lambda: [0.0, 0.0, 0.0])
        for b, x in cases:
            share = [w * y for w, y in zip(weight[b], x, strict=True)]
            for i in range(3):
                mine[b][i] += share[i] / sum(share)
        new = dict(weight)
        for b, m in mine.items():
            m = [max(x, 1e-6 * sum(m)) for x in m]
            new[b] = [x / sum(m) for x in m]
        new[0] = [0.0, *(x / sum(new[0][1:]) for x in new[0][1:])]
        moved = max(abs(a - b) for k in weight for a, b in zip(weight[k], new[k], strict=True))
        weight = new
        if moved < 1e-3:
            break
    one, two = counts(train)
    n, v = sum(one.values()), len(one)
    return {k: sum(math.log10(sum(w * y for w, y in zip(weight[bucket(context(one, p[0]))], parts(one, two, n, v, p), strict=True))) for p in pairs[k]) for k in tokens}


def test_scores_by_brute_force(spark):
    r = random.Random(2)
    vocab = [f"w{int(r.paretovariate(0.8))}" for _ in range(300)]
    rows = [(i, " ".join(r.choice(vocab) for _ in range(r.randint(0, 60))), "en", "s", 0) for i in range(150)] + [(150, None, "en", "s", 0), (151, "", "en", "s", 0)]
    df = clashing(spark.createDataFrame(rows, DOCS), "train", "batch", "score")
    size = sum(len(t.encode()) for _, t, *_ in rows if t)
    n = lm_scoring.DELETE * max(1, -(-size // (300 * lm_scoring.DELETE)))
    batch = {x["doc_id"]: (x["batch"], x["train"]) for x in lm_scoring._batches(df.select("doc_id", "text"), n).collect()}
    want = brute_scores([(i, t, batch[i][1]) for i, t, *_ in rows], {i: b for i, (b, _) in batch.items()})
    got = {x["doc_id"]: x["score"] for x in lm_scoring.score(df, batch_bytes=300, shard_keys=100).collect()}
    assert got == pytest.approx(want, rel=1e-6)


def test_scores_of_null_and_repeated_ids(spark):
    rows = [(None, "a b c", "", "", 0), (3, "a b", "", "", 0), (3, "a b", "", "", 0), (3, "c", "", "", 0)]
    got = lm_scoring.score(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got) == [("3", 2), ("3", 3), ("3", 3), ("None", 4)]


# --- languages, lines, joins and counts -----------------------------------------------------


def test_language_ties_repeats_and_long_texts(spark):
    rows = [(i, "same words here", x, "s", 0) for i, x in enumerate(("b", "a"))] + [(9, "same words here " * 20_000, None, "s", 0)] * 2 + [(10, "ab " * 5, "solo", "s", 0)] * 50
    df = spark.createDataFrame(rows, DOCS)
    p = language_id.fit(df, fit_rows=5)
    assert p.languages == ["a", "b", "solo"]
    got = language_id.predict(clashing(df, "lang_pred"), p).collect()
    assert {r["lang_pred"] for r in got if r["doc_id"] in (0, 1, 9)} == {"a"} and len([r for r in got if r["doc_id"] == 9]) == 2
    # the draw goes by the text alone, so the other columns can't change a profile
    q = language_id.fit(df.withColumn("doc_id", F.col("doc_id") + 7).withColumn("source", F.lit("other")), fit_rows=5)
    assert p.languages == q.languages and (p.rank == q.rank).all()


def test_lines_of_very_long_and_repeated_rows(spark):
    long = "\n".join(f"line number {i % 5000}" for i in range(20_000))
    rows = [(1, "line number 17\nshort", 0), (2, long, 0), (2, long, 0), (None, "LINE NUMBER 17 \nnull id here", 0), (None, "null id here", 0)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, n_lines long"), shard_keys=100).collect()
    assert sorted((str(r["doc_id"]), r["n_lines"], r["n_dropped"]) for r in got) == [("1", 2, 0), ("2", 20_000, 4), ("2", 20_000, 4), ("None", 1, 0), ("None", 2, 1)]


def test_join_clashing_columns_and_kept_rows(spark):
    near = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    rows = [(4, near), (4, near), (None, near), (None, near + " more"), (7, near + " other"), (8, ""), (8, None), (9, "alone here"), (None, "alone too")]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"), "e", "root", "n", "row", "component_id", "__row")
    got = ngram_join.jaccard_components(df, 4, 8, 10).collect()
    assert len(got) == len(rows) and {r["component_id"] for r in got if r["n_shingles"] > 10} == {4} and {r["n_links"] for r in got if r["n_shingles"] > 10} == {4}
    kept = ngram_join.keep_one(df.drop("__row"), 4, 4, 5)
    assert kept.columns == df.drop("__row").columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.where("text != ''").collect()) == [("4", near), ("9", "alone here"), ("None", "alone too")]
    assert kept.where("coalesce(text, '') = ''").count() == 2


@pytest.mark.parametrize("long_block", [1, 2000])
def test_join_cut_by_shingle(spark, monkeypatch, long_block):
    """Chains of near copies through many words: classes are cut into cells, of bounded length too."""
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    monkeypatch.setattr(ngram_join, "LONG", long_block)
    r = random.Random(9)
    texts = []
    for c in range(6):
        w = [f"c{c % 3}-{i}" for i in range(40)]
        for _ in range(14):
            w = list(w)
            for _ in range(r.randint(1, 4)):
                w[r.randrange(40)] = f"z{r.randrange(30)}"
            texts.append(" ".join(w))
    sets = [{tuple(t.split()[j : j + 2]) for j in range(39)} for t in texts]
    up = list(range(len(texts)))
    links = [0] * len(texts)

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 7 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                up[max(top(i), top(j))] = min(top(i), top(j))
    got = by_id(ngram_join.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4), 2, 7, 10))
    assert {i: (x["component_id"], x["n_links"]) for i, x in got.items()} == {i: (top(i), links[i]) for i in range(len(texts))}


def test_counts_of_null_empty_and_repeated_texts(spark):
    df = clashing(spark.createDataFrame([("a b-c",), (None,), ("",), ("a b-c",)], "text string"), "tokens")
    assert [r["n"] for r in df.select(token_counts.pattern_tokens("pieces-1").alias("n")).collect()] == [4, 0, 0, 4]
