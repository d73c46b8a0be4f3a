"""N-gram Jaccard join: grouped prefix join over word shingles.

1.  Documents become sets of 64-bit shingle identities, in one pass over the texts; equal
    sets (by 128 bits) are one entity, which gets a number and carries its postings.
2.  Shingles have one global order: those in the low part of the hash range by how
    often they occur, then all others by hash.  Two sets that are similar share a
    shingle among the first n - ceil(t n) + 1 of each, the prefix.  Shingles that only
    one entity holds can't be shared, so only their number is kept.
3.  Entities of one size with one prefix form a group; groups that meet in a prefix
    shingle are filtered by size and position, then expanded and verified on whole texts.
4.  What leaves the join is components, so no pair is emitted for its own sake.  Each
    shingle pairs its groups with one pivot, twice, with other pivots: a row a posting.
5.  Entities of shingles that then still meet several components are indexed anew by
    all their shingles, counted among themselves.  Those that can still meet form
    classes.  A class is compared as a whole or shingle by shingle, whichever reads fewer
    texts, so that the cost never exceeds that of its postings.  Either is cut into blocks
    of bounded number and length; a task compares two blocks by counting common shingles
    as a product of matrices, and returns a spanning forest of the links.  Blocks of one
    component are skipped.  No pair is left out, and none is a row.
6.  Links lie inside components, so they are counted there, once components are known:
    a task compares two blocks of a component and returns row sums of the product, each
    entity weighted by its copies.  Small components share a block.

Defined results: texts without words have no set, link with nothing, and are components
of their own.  Rows of one doc_id are nodes of one id.  A null doc_id counts as the
largest.  Repeated rows are exact copies.  A document with fewer than k words has its
whole sequence as its one shingle.  Columns beside doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch
from .text import buffers, longs, mix, plain, segment_sum, shingles, slices, words

NO_ID = (1 << 63) - 1
#: Entities of a block; a task compares two blocks.
BLOCK = 256
#: A set of this many shingles counts as two entities of a block, and so on.
LONG = 2000
#: Shingles of one step of that comparison.
STEP = 4096
_SIDE = (np.uint64(0x5851F42D4C957F2D), np.uint64(0x2545F4914F6CDD1D))


def _sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(shingles, offsets, sizes, both halves of the entity identities) of a slice of texts."""
    g, off = shingles(*words(texts), k)
    n = np.diff(off)
    return g, off, n, [mix(segment_sum(mix(g ^ side), off) + n.astype(np.uint64)) for side in _SIDE]


def _low(num: int, den: int) -> int:
    """Shingles below this are ordered by count; about 1.35 prefixes of a set lie there."""
    return int(min(1.0, 1.35 * (den - num) / den) * ((1 << 64) - 1))


def _prefix(n: np.ndarray, num: int, den: int) -> np.ndarray:
    return n - -(-num * n // den) + 1


def _members(rows: DataFrame, k: int, num: int, den: int, below: int) -> DataFrame:
    """(row, doc_id, e1, e2, n, u, items) of rows (row, doc_id, text): items are a set's u shingles of the low part, and as many of the next ones as its prefix lacks."""
    low = np.uint64(below)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, part in slices(plain(b.column(2))):
                g, off, n, e = _sets(part, k)
                d = np.repeat(np.arange(len(n)), n)
                u = segment_sum((g < low).astype(np.int64), off)
                most = np.minimum(n, np.maximum(u, _prefix(n, num, den)))
                take = (np.arange(len(g)) - off[d]) < most[d]
                items = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(most))).astype(np.int32)), longs(g[take]))
                yield pa.record_batch([b.column(0).slice(first, len(part)), b.column(1).slice(first, len(part)), longs(e[0]), longs(e[1]), pa.array(n), pa.array(u), items], ["row", "doc_id", "e1", "e2", "n", "u", "items"])

    return rows.mapInArrow(work, "row long, doc_id long, e1 long, e2 long, n long, u long, items array<long>")


def _close(n1: Column, p1: Column, n2: Column, p2: Column, num: int, den: int) -> Column:
    """Size and position filter for two sets that meet first at these positions."""
    rest = F.least(n1 - p1, n2 - p2)
    return (F.least(n1, n2) * den >= F.greatest(n1, n2) * num) & (rest * (num + den) >= (n1 + n2) * num)


def _verified(pairs: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of entities whose shingle sets are similar, by their whole texts."""

    def both(ta: pa.Array, tb: pa.Array) -> np.ndarray:
        (ga, oa), (gb, ob) = (shingles(*words(t), k) for t in (ta, tb))
        na, nb = np.diff(oa), np.diff(ob)
        i = np.concatenate((np.repeat(np.arange(len(na)), na), np.repeat(np.arange(len(nb)), nb)))
        g = np.concatenate((ga, gb))
        order = np.lexsort((g, i))
        i, g = i[order], g[order]
        common = np.bincount(i[1:][(g[1:] == g[:-1]) & (i[1:] == i[:-1])], minlength=len(na))
        return den * common >= num * (na + nb - common)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ta, tb = plain(b.column(2)), plain(b.column(3))
            size = np.diff(buffers(ta)[1]) + np.diff(buffers(tb)[1])
            part = np.cumsum(size) // (1 << 20)
            for at in np.split(np.arange(len(size)), np.flatnonzero(np.diff(part)) + 1):
                if len(at):
                    ok = both(ta.slice(at[0], len(at)), tb.slice(at[0], len(at)))
                    yield pa.record_batch([b.column(0).slice(at[0], len(at)), b.column(1).slice(at[0], len(at))], ["a", "b"]).filter(pa.array(ok))

    a = texts.select(F.col("e").alias("a"), F.col("text").alias("ta"))
    b = texts.select(F.col("e").alias("b"), F.col("text").alias("tb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "ta", "tb").mapInArrow(work, "a long, b long")


def _prefixes(entity: DataFrame, num: int, den: int, scratch: Scratch, name: str) -> DataFrame:
    """(e, n, prefix) of entities with a shared shingle in their prefix: an array of (s, pos) in the global order.

    entity (e, n, u, items): the first u items are ordered by count, the others as they stand.
    """
    held = entity.select("e", "u", F.posexplode("items").alias("i", "s")).select("s", "e", F.when(F.col("i") < F.col("u"), -1).otherwise(F.col("i") - F.col("u")).cast("int").alias("k"))
    shared = held.groupBy("s").agg(F.count("*").alias("c")).where("c > 1")
    shared = scratch.write(shared, f"{name}-shared")
    scratch.release()
    item = F.struct(F.when(F.col("k") < 0, 0).otherwise(1).alias("cls"), F.when(F.col("k") < 0, F.col("c")).otherwise(0).alias("c"), F.col("k").alias("k"), "s")
    own = held.join(shared, "s").groupBy("e").agg(F.array_sort(F.collect_list(item)).alias("items")).join(entity.select("e", "n", "u"), "e")
    own = own.withColumn("low", F.size(F.filter("items", lambda x: x["cls"] == 0)).cast("long")).withColumn("p", F.expr(f"n - (({num} * n + {den - 1}) div {den}) + 1"))
    first = F.expr("transform(slice(items, 1, cast(greatest(0, least(low, p - (u - low))) as int)), (x, i) -> struct(x.s as s, u - low + i as pos))")
    then = F.expr("transform(filter(items, x -> x.cls = 1 and u + x.k < p), x -> struct(x.s as s, u + x.k as pos))")
    own = own.select("e", "n", F.concat(first, then).alias("prefix")).where(F.size("prefix") > 0)
    out = scratch.write(own, name)
    scratch.drop(f"{name}-shared")
    return out


def _forest(a: np.ndarray, b: np.ndarray, names: list[int]) -> list[tuple[int, int]]:
    """Links that join something new, of links between positions."""
    up = list(range(len(names)))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        i, j = top(x), top(y)
        if i != j:
            up[j] = i
            out.append((names[x], names[y]))
    return out


def _near(texts: pa.Array, k: int, num: int, den: int) -> np.ndarray:
    """Which pairs of texts have similar sets: common shingles are counted by products of 0-1 matrices over a step of shingles each."""
    sets = [_sets(part, k)[:3] for _, part in slices(texts)]
    size = np.concatenate([x[2] for x in sets]).astype(np.int64)
    g, n = np.concatenate([x[0] for x in sets]), len(size)
    doc = np.repeat(np.arange(n), size)
    _, at, times = np.unique(g, return_inverse=True, return_counts=True)
    rank = np.cumsum(times > 1) - 1
    keep = times[at] > 1
    doc, at = doc[keep], rank[at[keep]]
    order = np.argsort(at, kind="stable")
    doc, at = doc[order], at[order]
    common = np.zeros((n, n), np.int64)
    for lo in range(0, int(at[-1]) + 1 if len(at) else 0, STEP):
        i, j = np.searchsorted(at, (lo, lo + STEP))
        x = np.zeros((n, STEP), np.float32)
        x[doc[i:j], at[i:j] - lo] = 1
        common += (x @ x.T).astype(np.int64)
    return common * (den + num) >= num * (size[:, None] + size[None, :])


def _counted(blocks: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(e, links): for each entity of a group (cls, i, j) of `blocks` (cls, i, j, block, e, copies, text) the rows of similar sets in the other block, or in its own if i = j."""

    def work(table: pa.Table) -> pa.Table:
        near = _near(plain(table.column("text")), k, num, den)
        np.fill_diagonal(near, False)
        if table.column("i")[0].as_py() != table.column("j")[0].as_py():
            block = table.column("block").to_numpy()
            near &= block[:, None] != block[None, :]
        return pa.table({"e": table.column("e"), "links": pa.array(near @ table.column("copies").to_numpy())})

    return blocks.groupBy("cls", "i", "j").applyInArrow(work, "e long, links long")


def _weight(n: Column) -> Column:
    """What a set takes of a block."""
    return 1 + F.floor(n / LONG)


def _degrees(known: DataFrame, texts: DataFrame, k: int, num: int, den: int, scratch: Scratch) -> DataFrame:
    """(e, links): the number of rows whose sets are similar to that of an entity of `known` (e, n, root, copies), without its own copies."""
    sized = scratch.write(known.join(known.groupBy("root").agg(F.sum(_weight(F.col("n"))).alias("load")), "root"), "sized")
    small = F.col("load") <= BLOCK
    in_bins = sized.where(small).agg(F.sum(_weight(F.col("n")))).first()[0] or 0
    bins = F.lit(max(1, -(-in_bins // BLOCK)))
    large = F.ceil(F.col("load") / BLOCK)
    # components of up to a block are dealt whole to bins; a larger one is a class of its own
    placed = sized.select(
        F.when(small, F.pmod(F.xxhash64("root"), bins)).otherwise(F.col("root")).alias("cls"), F.when(small, F.lit(-1)).otherwise(F.pmod(F.xxhash64("e"), large)).cast("long").alias("block"), F.when(small, F.lit(0)).otherwise(large).cast("long").alias("blocks"), "e", "copies"
    )
    other = F.when(F.col("blocks") == 0, F.array(F.col("block"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    pairs = placed.select("cls", "block", "e", "copies", F.explode(other).alias("o"))
    pairs = pairs.select("cls", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "e", "copies")
    tasks = pairs.join(texts, "e").select("cls", "i", "j", "block", "e", "copies", "text")
    return _counted(tasks, k, num, den).groupBy("e").agg(F.sum("links").alias("links"))


def _compared(blocks: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links (a, b) that span each group (cls, s, i, j) of `blocks` (cls, s, i, j, e, text)."""

    def work(table: pa.Table) -> pa.Table:
        a, b = np.nonzero(np.triu(_near(plain(table.column("text")), k, num, den), 1))
        got = _forest(a, b, table.column("e").to_pylist())
        return pa.table({"a": pa.array([x[0] for x in got], pa.int64()), "b": pa.array([x[1] for x in got], pa.int64())})

    return blocks.groupBy("cls", "s", "i", "j").applyInArrow(work, "a long, b long")


def _cells(open_: DataFrame, scratch: Scratch) -> DataFrame:
    """(cls, s, i, j, e): the blocks to compare of postings (cls, s, e, n, root) of shingles that meet several components.

    A class is compared as a whole (s null) or shingle by shingle, whichever reads fewer
    texts.  Blocks of one component are not compared.
    """
    load = F.sum(_weight(F.col("n"))).alias("load")
    cost = F.col("load") * F.ceil(F.col("load") / BLOCK)
    member = scratch.write(open_.select("cls", "e", "n", "root").distinct(), "class-members")
    whole = member.groupBy("cls").agg(load)
    by_s = open_.groupBy("cls", "s").agg(load)
    cheap = by_s.groupBy("cls").agg(F.sum(cost).alias("parts")).join(whole.withColumn("all", cost), "cls").select("cls", "load", (F.col("parts") < F.col("all")).alias("cut"))
    cheap = scratch.write(cheap, "class-costs")
    at_once = member.join(cheap.where("NOT cut"), "cls").select("cls", F.lit(None).cast("long").alias("s"), "e", "n", "root", "load")
    one_by_one = open_.join(cheap.where("cut").select("cls"), "cls", "left_semi").join(by_s, ["cls", "s"]).select("cls", "s", "e", "n", "root", "load")
    group = at_once.unionByName(one_by_one).withColumn("blocks", F.ceil(F.col("load") / BLOCK))
    # a component of up to a block stays together
    own = group.groupBy("cls", "s", "root").agg(load.alias("own"))
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in ("cls", "s", "root")]
    dealt = group.alias("x").join(own.alias("y"), same[0] & same[1] & same[2])
    part = F.pmod(F.xxhash64("x.e"), F.ceil(F.col("y.own") / BLOCK))
    dealt = dealt.select("x.cls", "x.s", "x.e", "x.root", F.pmod(F.xxhash64("x.root", part), F.col("x.blocks")).alias("block"))
    dealt = scratch.write(dealt, "dealt")
    block = dealt.groupBy("cls", "s", "block").agg(F.min("root").alias("r0"), F.max("root").alias("r1"))
    several = (F.col("x.r0") != F.col("x.r1")) | (F.col("y.r0") != F.col("y.r1")) | (F.col("x.r0") != F.col("y.r0"))
    couples = block.alias("x").join(block.alias("y"), (F.col("x.cls") == F.col("y.cls")) & F.col("x.s").eqNullSafe(F.col("y.s")) & (F.col("x.block") <= F.col("y.block")) & several)
    sides = couples.select("x.cls", "x.s", F.col("x.block").alias("i"), F.col("y.block").alias("j")).select("*", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    return dealt.alias("x").join(sides.alias("y"), (F.col("x.cls") == F.col("y.cls")) & F.col("x.s").eqNullSafe(F.col("y.s")) & (F.col("x.block") == F.col("y.block"))).select("y.cls", "y.s", "i", "j", "e")


def _clustered(rows: DataFrame, k: int, num: int, den: int, scratch: Scratch, links_too: bool) -> DataFrame:
    """(row, doc_id, n, root, component_id, n_links) of rows (row, doc_id, text), doc_id not null.

    Sets of one root are linked; empty ones have n = 0 and a null root.
    """
    low = _low(num, den)
    member = scratch.write(_members(rows, k, num, den, low), "member")
    entity = member.where("n > 0").groupBy("e1", "e2").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("u").alias("u"), F.count("*").alias("copies"), F.first("items").alias("items"))
    entity = scratch.write(entity.withColumn("e", F.monotonically_increasing_id()), "entity-items")
    # postings take disk, so the tables that carry them go as soon as they are read
    member = scratch.write(member.select("row", "doc_id", "n", "e1", "e2"), "member-ids")
    scratch.drop("member")
    scratch.release()
    prefix = _prefixes(entity.select("e", "n", "u", "items"), num, den, scratch, "prefix")
    entity = scratch.write(entity.drop("items", "u"), "entity")
    scratch.drop("entity-items")
    scratch.release()

    # an unshared shingle in front makes a prefix unlike any other
    alone = F.when(F.col("prefix")[0]["pos"] > 0, F.col("e"))
    keyed = prefix.withColumn("key", F.struct("n", alone.alias("alone"), F.transform("prefix", lambda x: x["s"]).alias("s")))
    groups = keyed.groupBy("key").agg(F.min("e").alias("g"), F.count("*").alias("size"))
    index = scratch.write(keyed.join(groups, "key").select("g", "size", "e", "n", "prefix"), "grouped")
    scratch.drop("prefix")
    # one row for a group stands for its members until they are expanded; members of a group meet in a token of their own
    heads = index.where("e = g").select("e", "n", "size", F.explode("prefix").alias("x")).select(F.col("x.s").alias("s"), F.lit(0).alias("kind"), "e", "n", F.col("x.pos").alias("pos"), "size")
    inner = index.where("size > 1").select(F.col("g").alias("s"), F.lit(1).alias("kind"), "e", "n", F.lit(0).cast("long").alias("pos"), F.lit(1).cast("long").alias("size"))
    tokens = heads.union(inner)
    counted = tokens.groupBy("s", "kind").agg(F.count("*").alias("held"), F.max("size").alias("largest")).where("held > 1 or largest > 1")
    tokens = scratch.write(tokens.join(counted, ["s", "kind"]), "tokens")
    scratch.release()

    needed = index.select("e").join(entity.select("e", "doc_id", "e1", "e2"), "e")
    texts = needed.join(rows.select("doc_id", "text"), "doc_id").select("e", "e1", "e2", "text")

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of other texts may have the id too."""
        for b in batches:
            for at, part in slices(plain(b.column(3))):
                one, two = (x.view(np.int64) for x in _sets(part, k)[3])
                ok = (one == b.column(1).to_numpy()[at : at + len(part)]) & (two == b.column(2).to_numpy()[at : at + len(part)])
                yield pa.record_batch([b.column(0).slice(at, len(part)), part.cast(pa.string())], ["e", "text"]).filter(pa.array(ok))

    texts = scratch.write(texts.mapInArrow(same, "e long, text string").dropDuplicates(["e"]), "texts")
    scratch.release()

    def met(x: DataFrame, y: DataFrame, more: Column) -> DataFrame:
        """Pairs of two aliased sides that share a token and pass the filters."""
        near = _close(F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos"), num, den)
        on = (F.col("x.s") == F.col("y.s")) & (F.col("x.kind") == F.col("y.kind")) & near & more
        return x.alias("x").join(y.alias("y"), on).select(F.least("x.e", "y.e").alias("a"), F.greatest("x.e", "y.e").alias("b")).distinct()

    def with_root(t: DataFrame, roots: DataFrame | None) -> DataFrame:
        if roots is None:
            return t.withColumn("root", F.col("e"))
        return t.join(roots.withColumnRenamed("node", "e"), "e", "left").withColumn("root", F.coalesce("root", "e"))

    def linked(links: list[DataFrame], name: str) -> DataFrame:
        edges = links[0]
        for x in links[1:]:
            edges = edges.union(x)
        return scratch.write(components(edges, scratch, f"{name}-cc"), f"{name}-roots")

    links: list[DataFrame] = []
    roots = None
    for turn in range(2):
        side = with_root(tokens, roots)
        pick = F.struct(F.xxhash64("e", F.lit(turn)).alias("h"), "e", "n", "pos", "root")
        pivot = side.groupBy("s", "kind").agg(F.min(pick).alias("p"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 != r1").select("s", "kind", F.col("p.e").alias("e"), F.col("p.n").alias("n"), F.col("p.pos").alias("pos"), F.col("p.root").alias("root"))
        tried = scratch.write(met(side, pivot, F.col("x.root") != F.col("y.root")), f"pairs-{turn}")
        links.append(scratch.write(_verified(tried, texts, k, num, den), f"links-{turn}"))
        roots = linked(links, f"turn-{turn}")
        scratch.release()
    # entities of tokens that still meet several components, among themselves and by all their shingles
    expand = tokens.where("kind = 0").withColumnRenamed("e", "g").join(index.select("g", "e"), "g").select("s", "kind", "e").union(tokens.where("kind = 1").select("s", "kind", "e"))
    open_ = with_root(expand, roots).groupBy("s", "kind").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 != r1")
    open_ = scratch.write(expand.join(open_.select("s", "kind"), ["s", "kind"], "left_semi").select("e").distinct(), "open")
    again = scratch.write(texts.join(open_, "e", "left_semi"), "open-texts")
    renamed = _members(again.select(F.col("e").alias("row"), F.col("e").alias("doc_id"), "text"), k, num, den, (1 << 64) - 1).select(F.col("row").alias("e"), "n", F.col("n").alias("u"), "items")
    again_prefix = _prefixes(scratch.write(renamed, "open-sets"), num, den, scratch, "again")
    held = scratch.write(with_root(again_prefix.select("e", "n", F.explode("prefix.s").alias("s")), roots), "open-postings")
    centre = held.groupBy("s").agg(F.min("e").alias("b"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 != r1").select("s", "b")
    held = scratch.write(held.join(centre, "s"), "open-met")
    scratch.drop("open-sets", "open-postings", "again", "tokens")
    scratch.release()
    classes = scratch.write(components(held.select(F.col("e").alias("a"), "b"), scratch, "classes"), "class")
    postings = held.join(classes.select(F.col("node").alias("e"), F.col("root").alias("cls")), "e").select("cls", "s", "e", "n", "root")
    tasks = _cells(postings, scratch).join(again, "e").select("cls", "s", "i", "j", "e", "text")
    links.append(scratch.write(_compared(tasks, k, num, den), "links-2"))
    roots = linked(links, "all")

    known = roots.withColumnRenamed("node", "e").join(entity.select("e", "n", "doc_id", "copies"), "e")
    known = scratch.write(known, "known")
    lowest = known.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    label = entity.select("e", "e1", "e2", "doc_id", "copies").join(known.join(lowest, "root").select("e", "root", "component_id"), "e", "left")
    count = F.lit(0).cast("long")
    if links_too:
        label = label.join(_degrees(known.select("e", "n", "root", "copies"), texts, k, num, den, scratch), "e", "left")
        count = F.coalesce("links", count) + F.col("copies") - 1
    label = scratch.write(label.select("e1", "e2", F.coalesce("root", "e").alias("root"), F.coalesce("component_id", "doc_id").alias("component_id"), count.alias("n_links")), "label")
    scratch.drop("texts", "tokens", "grouped", "entity", "open", "open-texts", "open-sets", "open-postings", "open-met", "again", "dealt", "sized")
    scratch.release()
    out = member.select("row", "doc_id", "n", "e1", "e2").join(label, ["e1", "e2"], "left")
    filled = F.col("n") > 0
    return out.select("row", "doc_id", "n", F.when(filled, F.col("root")).alias("root"), F.when(filled, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.when(filled, F.col("n_links")).otherwise(0).alias("n_links"))


def _known_id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id")


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) per row of `docs` (doc_id, text).

    Documents link when den * |A and B| >= num * |A or B| for their sets of k-word
    shingles.  component_id is the smallest doc_id that links reach.  n_links counts the
    other rows that the row links with, exact copies included.
    """
    rows = docs.select(F.lit(0).cast("long").alias("row"), _known_id(), "text")
    out = _clustered(rows, k, num, den, Scratch(docs.sparkSession, "ngram-join"), True)
    back = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return out.select(back("doc_id"), F.col("n").alias("n_shingles"), back("component_id"), "n_links")


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return jaccard_components(docs, k=4, num=85, den=100)


def keep_one(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """`docs` with one row of each component, one of the smallest doc_id, null ids last; rows without words stay."""
    scratch = Scratch(docs.sparkSession, "keep-one")
    numbered = scratch.write(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    found = scratch.write(_clustered(numbered.select(F.col("__row").alias("row"), _known_id(), "text"), k, num, den, scratch, False).where("root IS NOT NULL").select("row", "doc_id", "root"), "found")
    stay = found.groupBy("root").agg(F.min(F.struct("doc_id", "row")).alias("least"))
    gone = found.join(stay, "root").where("row != least.row").select(F.col("row").alias("__row"))
    return numbered.join(gone, "__row", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
