"""N-gram Jaccard join with several global token orders.

A document is its set of distinct word n-grams; documents with equal sets are one node. Two nodes link when their Jaccard
similarity is at least `percent` / 100. Linked nodes share a token in their prefixes under *every* total order of tokens
(a prefix is all but ceil(t * size) - 1 of the tokens), so candidates must pass several orders:

1. Order by hash. A node may have at most size - ceil(t * size) tokens that no other node has. The `PREFIX` share with
   the smallest hashes already shows more than that for nearly every node without a near copy; those nodes leave, and
   only the others' texts are read again.
2. Order by rarity: among the nodes left, tokens by (number of nodes, hash). Tokens of one node only come first and cannot
   match, which shortens the prefixes; nodes with nothing left of their prefix leave.
3. Order by rarity class: tokens by (log2 of the number of nodes, another hash). Candidates of order 2 must also share a
   prefix token under this order. Only then are the sets compared.

Big families are never expanded into all their pairs. The members of a token group are compared with one pivot of the
group, and each is then described by its difference from the pivot, a small set: for members x and y with differences dx
and dy, |x ^ y| = |dx| + |dy| - 2 |dx & dy|. Two members that both link with the pivot are in one component and need no
comparison. Any other pair that links meets in one of two ways. What x and y share of the pivot is at most what either has
of it, so from the sizes follows how many tokens they must share that the pivot lacks. Where that is one at least, they meet
in a prefix of those tokens alone. This holds for nearly all pairs of which one does not link with the pivot, and such tokens
are rarely common, while those that two members lack of the pivot meet by chance. Only where a pair may do without (one of the
two is so small that the pivot's tokens are enough), it meets in a prefix of the whole differences, which must share a number
of tokens that follows from their sizes. Prefixes take the rarest tokens first, and skip those of one member only. Members of
a meeting who ask for more than it can offer leave it. The meetings are the groups of the next level, where the same is done
with new pivots; after `levels` levels the pairs that are left are compared one by one. Groups whose members are all in one
component are dropped before each level. No link between components is lost.

Tokens are counted a share of them at a time (`PARTS`), so that shuffle files of the whole corpus never lie on disk at once.

Nodes are told apart by a 64-bit hash of their set and its size.

Defined results: a null or empty text has an empty set, links with nothing and is its own component. Null ids are no
component's smallest id unless all its ids are null. Very long texts are one set like any other. A similarity that equals the
limit links; tokens that are equally rare are ordered by their hash. Repeated rows are copies of each other. An empty table
gives no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import forget, gathered, release, settings
from .common import Rolling, lists, mix, signed, stored, text_chunks, text_of, word_spans

#: Size of the hash order's prefixes, in multiples of the tokens that a node may have for itself.
PREFIX = 4 / 3
LEVELS = 2
#: Tokens are counted, and their nodes ranked, in so many steps; each takes its share of disk.
PARTS = 4
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes, ascending within each text, and their number in each text."""
    texts = len(offsets) - 1
    starts, ends, owner = word_spans(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(texts, np.int64)
    h = Rolling(LOWER[data]).ranges(starts, ends)
    count = np.bincount(owner, minlength=texts)
    gram, valid = np.zeros(len(h), np.uint64), np.ones(len(h), bool)
    first = np.cumsum(count) - count
    local = np.arange(len(h)) - first[owner]
    size = np.minimum(count[owner], n)
    valid = local <= count[owner] - size
    for j in range(n):
        at = np.minimum(np.arange(len(h)) + j, len(h) - 1)
        gram = np.where(j < size, mix(gram * np.uint64(0x9E3779B97F4A7C15) + h[at] + np.uint64(j + 1)), gram)
    gram, owner = gram[valid], owner[valid]
    order = np.lexsort((gram, owner))
    gram, owner = gram[order], owner[order]
    new = np.concatenate([[True], (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])])
    return gram[new], np.bincount(owner[new], minlength=texts)


def set_hashes(tokens: np.ndarray, count: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(tokens ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
    end = np.cumsum(count)
    return mix(total[end] - total[end - count] + count.astype(np.uint64))


def needed(size: Column, percent: int) -> Column:
    """Least overlap with a partner: ceil(t * size)."""
    return F.ceil(size * percent / 100)


def can_link(size: Column, own: Column, others_own: Column, percent: int) -> Column:
    """May a set with `own` tokens that no other set has link with one that has `others_own`?

    The overlap is at most size - own, and the union at least size + others_own.
    """
    return 100 * (size - own) >= percent * (size + others_own)


def _nodes(n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch["text"]):
                tokens, count = shingle_sets(data, offsets, n)
                spare = count - -(-count * percent // 100)
                take = np.minimum(count, (spare * PREFIX).astype(np.int64) + 1)
                take[count == 0] = 0
                local = np.arange(len(tokens)) - np.repeat(np.cumsum(count) - count, count)
                node = signed(set_hashes(tokens, count)) if len(count) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([*[batch[c].slice(lo, hi - lo) for c in ("doc_id", "t")], pa.array(count), pa.array(node, mask=count == 0), lists(signed(tokens[local < np.repeat(take, count)]), take, pa.int64())], names=["doc_id", "t", "size", "hash", "prefix"])

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch["text"]):
                tokens, count = shingle_sets(data, offsets, n)
                yield pa.RecordBatch.from_arrays([pa.array(signed(set_hashes(tokens, count))), pa.array(count), lists(signed(tokens), count, pa.int64())], names=["hash", "size", "tokens"])

    return run


def components(links: DataFrame, name: str = "component") -> DataFrame:
    """links(a, b) -> (node, root): each linked node's smallest reachable node, by label exchange and pointer jumping."""
    both = stored(links.select("a", "b").union(links.select("b", "a")).distinct().toDF("a", "b"), name, narrow=True)
    labels = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"), name, narrow=True)
    while True:
        near = both.join(labels.toDF("b", "r"), "b").groupBy("a").agg(F.min("r").alias("r")).withColumnRenamed("a", "node")
        lower = labels.join(near, "node").select("node", F.least("root", "r").alias("root"), F.col("root").alias("old"))
        # the jump follows the roots of the round before, so that a round stores one table
        target = labels.select(F.col("node").alias("root"), F.col("root").alias("top"))
        after = stored(lower.join(target, "root").select("node", F.least("root", "top").alias("root"), "old"), name, narrow=True)
        moved = after.where("root != old").limit(1).count()
        forget(labels)
        labels = after.select("node", "root")
        if not moved:
            forget(both)
            return labels


def close(delta: Column, sizes: Column, percent: int) -> Column:
    """Jaccard similarity of at least percent / 100, from the sizes' sum and the symmetric difference's size."""
    return delta * (100 + percent) <= (100 - percent) * sizes


def _only(a: str, b: str, c: str, d: str) -> Column:
    """Tokens of a that are not in b, and of c that are not in d; a and c have none in common."""
    return F.concat(F.array_except(a, b), F.array_except(c, d))


def _shared(tokens: DataFrame, part: int) -> DataFrame:
    """tokens(node, token) -> the rows of one part of the tokens, with `df`, the number of their nodes, where it is 2 or more.

    The tokens are shuffled once, for the count and for the join.
    """
    dealt = tokens.where(F.pmod("token", F.lit(PARTS)) == part).repartition("token")
    return dealt.join(dealt.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df >= 2"), "token")


def _compared(groups: DataFrame, described: DataFrame, roots: DataFrame | None, percent: int) -> tuple[DataFrame, DataFrame]:
    """One level: groups(g, ref, node), described(ref, node, size, own, other, plus, minus): the tokens that
    a node has and the pivot `ref` stands for has not, and the reverse.

    Returns the members' descriptions relative to their groups' pivots, with `linked` (ref, node, size, own, other, plus, minus,
    pivot, linked), and the links (a, b).
    """
    described = described.select("ref", "node", "size", "own", "other", "plus", "minus")
    known = groups.select("g", "ref", "node").join(described.select("ref", "node", "size", "own"), ["ref", "node"])
    known = known.withColumn("root", F.col("node")) if roots is None else known.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    pivots = known.groupBy("g", "ref").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min(F.struct("own", "node")).alias("first")).where("low != high").select("g", "ref", F.col("first.node").alias("pivot"))
    met = known.select("g", "ref", "node").join(pivots, ["g", "ref"]).where("node != pivot").select("ref", "node", "pivot").distinct()
    centre = described.select("ref", F.col("node").alias("pivot"), F.col("size").alias("psize"), F.col("plus").alias("pplus"), F.col("minus").alias("pminus"), F.col("other").alias("pother"))
    both = met.join(described, ["ref", "node"]).join(centre, ["ref", "pivot"])
    delta = both.withColumns({"plus": _only("plus", "pplus", "pminus", "minus"), "minus": _only("pplus", "plus", "minus", "pminus")})
    # the third order's prefixes must meet as well
    linked = F.arrays_overlap("other", "pother") & close(F.size("plus") + F.size("minus"), F.col("size") + F.col("psize"), percent)
    new = stored(delta.select(F.xxhash64("ref", "pivot").alias("ref"), "node", "size", "own", "other", "plus", "minus", "pivot", "psize", linked.alias("linked")), "described")
    return new, new.where("linked").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))


def _offered(size: Column, partner: Column, psize: Column, lacking: Column, percent: int) -> Column:
    """Least number of tokens beyond the pivot that two sets of these sizes share if they link, when one lacks `lacking` of its tokens."""
    return F.ceil((size + partner) * percent / (100 + percent)) - (psize - lacking)


def _next_groups(described: DataFrame, percent: int) -> DataFrame:
    """(g, ref, node, own, shared, any, short): members that may link, as their differences from a pivot share a token of their prefixes.

    Those of groups with `own` share at least one token that the pivot lacks, of the `shared` ones that others have as well; the
    others may share none. Pairs of a group matter if one of them has `any`, or both have `short`.
    """
    c = (100 - percent) / (100 + percent)
    size, psize, linked, lacking = F.col("size"), F.col("psize"), F.col("linked"), F.col("lacking")
    spare = size - needed(size, percent)
    described = described.withColumns({"beyond": F.size("plus") > spare, "lacking": F.size("minus")})
    # one of two that matter does not link with the pivot; where all members do, nothing is left to compare
    limits = [F.min("size").alias("least"), F.min(F.when(~linked, size)).alias("far_least"), F.min(F.when(~linked, lacking)).alias("far_lacking")]
    kinds = described.groupBy("ref").agg(F.max(~linked & ~F.col("beyond")).alias("apart"), *limits).where("far_least is not null")
    heads = described.join(kinds, "ref")

    def asked() -> Column:
        """How many tokens beyond the pivot a member shares with any partner within the `limits`."""
        near = F.greatest(F.when(linked, F.col("far_least")).otherwise(F.col("least")), needed(size, percent))
        return _offered(size, near, psize, F.when(linked, F.greatest(lacking, F.col("far_lacking"))).otherwise(lacking), percent)

    # Members with more beyond the pivot than they can spare meet others in that only, whatever the sizes.
    whole = F.col("apart") & ~F.col("beyond")
    spread = heads.select("ref", "node", F.size("plus").alias("n"), F.posexplode(F.when(whole, F.concat("plus", "minus")).otherwise(F.col("plus"))).alias("i", "token")).select("ref", "node", (F.col("i") < F.col("n")).alias("own"), "token")
    counted = spread.groupBy("ref", "own", "token").agg(F.count(F.lit(1)).alias("df")).where("df >= 2")
    held = F.struct("df", "token")
    listed = spread.join(counted, ["ref", "own", "token"]).groupBy("ref", "node").agg(F.collect_list(held).alias("x"), F.collect_list(F.when(F.col("own"), held)).alias("beyond_x"))
    heads, d = heads.withColumns({"d": F.size("plus") + F.size("minus"), "whole": whole, "asked": asked()}).drop("plus", "minus", "other", "own"), F.col("d")
    excess = d - c * (size + psize)
    # The least number of shared tokens of a pair that matters; one of its two does not link with the pivot. A partner that
    # does not link asks for `far` of them, whoever the other is; one that links may ask a member that does not for fewer.
    far, any_ = F.ceil((1 - c) * d / 2 - 1e-9), F.ceil((excess + 1 - c) / 2 - 1e-9)
    length = lambda least: (d - F.greatest(F.lit(1), least) + 1 - (d - F.size("x"))).cast("int")
    prefix = lambda x, k: F.slice(F.array_sort(x), 1, F.greatest(k, F.lit(0)))
    ranked = heads.join(listed, ["ref", "node"]).withColumns({"near": length(far), "shared": F.size("beyond_x")})
    views = F.array(
        F.struct(F.lit(True).alias("own"), prefix("beyond_x", (F.col("shared") - F.greatest(F.lit(1), F.col("asked")) + 1).cast("int")).alias("p")),
        # all that are left ask for nothing beyond the pivot of some partner
        F.struct(F.lit(False).alias("own"), F.when(F.col("whole") & (F.col("asked") <= 0), prefix("x", F.when(linked, length(far)).otherwise(length(any_)))).otherwise(F.array()).alias("p")),
    )
    kept = ["ref", "node", "size", "psize", "lacking", "linked", "shared", "near"]
    rows = ranked.select(*kept, F.explode(views).alias("v")).select(*kept, "v.own", F.posexplode("v.p").alias("i", "s"))
    rows = rows.select(F.xxhash64("ref", "own", "s.token").alias("g"), *kept[:-1], "own", F.when(F.col("own"), ~linked).otherwise(linked).alias("any"), (~F.col("own") & (F.col("i") < F.col("near"))).alias("short"))
    # members who ask for more than their group can offer go
    offers = rows.groupBy("g", "ref").agg(F.count(F.lit(1)).alias("n"), *limits).where("n >= 2 and far_least is not null").drop("n")
    rows = rows.join(offers, ["g", "ref"]).where(asked() <= F.when(F.col("own"), F.col("shared")).otherwise(0)).select("g", "ref", "node", "own", "shared", "any", "short")
    # groups, and members of them, without a pair that matters go
    count = lambda x: F.sum(x.cast("int"))
    wide, rest = F.col("any"), ~F.col("any")
    kinds = rows.groupBy("g", "ref").agg(count(wide).alias("nw"), count(rest).alias("nr"), count(rest & F.col("short")).alias("ns")).where("ns >= 2 or (nw >= 1 and nw + nr >= 2)")
    # two that link with the pivot are in one component
    matters = F.when(wide, (F.col("nr") >= 1) | F.col("own")).otherwise((F.col("nw") >= 1) | (F.col("short") & (F.col("ns") >= 2)))
    return rows.join(kinds, ["g", "ref"]).where(matters).select("g", "ref", "node", "own", "shared", "any", "short")


def _pairwise(groups: DataFrame, described: DataFrame, roots: DataFrame | None, percent: int) -> DataFrame:
    """Links (a, b) among all members of each group that are not in one component yet."""
    known = groups.join(described.select("ref", "node", "size", "psize", F.size("minus").alias("lacking"), (F.size("plus") + F.size("minus")).alias("d")), ["ref", "node"])
    known = known.withColumn("root", F.col("node")) if roots is None else known.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = known.groupBy("g", "ref").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("g", "ref")
    rest = known.join(mixed, ["g", "ref"])
    one, two = (rest.select("g", "ref", *[F.col(x).alias(f"{x}{k}") for x in ("node", "size", "psize", "root", "d", "lacking", "own", "shared", "any", "short")]) for k in "ab")
    # differences of very different sizes are too far apart whatever they share
    matters = F.col("anya") | F.col("anyb") | (F.col("shorta") & F.col("shortb"))
    asked = _offered(F.col("sizea"), F.col("sizeb"), F.col("psizea"), F.greatest("lackinga", "lackingb"), percent) <= F.when(F.col("owna"), F.least("shareda", "sharedb")).otherwise(0)
    near = matters & asked & (one["g"] == two["g"]) & (one["ref"] == two["ref"]) & (F.col("nodea") < F.col("nodeb")) & (F.col("roota") != F.col("rootb")) & close(F.abs(F.col("da") - F.col("db")), F.col("sizea") + F.col("sizeb"), percent)
    pairs = one.join(two, near).select(one["ref"], F.col("nodea").alias("a"), F.col("nodeb").alias("b")).distinct()
    sides = [described.select("ref", F.col("node").alias(k), *[F.col(x).alias(f"{x}_{k}") for x in ("size", "plus", "minus", "other")]) for k in "ab"]
    both = pairs.join(sides[0], ["ref", "a"]).join(sides[1], ["ref", "b"])
    delta = sum(F.size(f"{x}_a") + F.size(f"{x}_b") - 2 * F.size(F.array_intersect(f"{x}_a", f"{x}_b")) for x in ("plus", "minus"))
    return both.where(F.arrays_overlap("other_a", "other_b")).where(close(delta, F.col("size_a") + F.col("size_b"), percent)).select("a", "b").distinct()


def ngram_join(docs: DataFrame, n: int = 4, percent: int = 85, key: str = "doc_id", levels: int = LEVELS) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id. More levels of pivots leave fewer pairs to compare; the result is the same."""
    spark, kind = docs.sparkSession, dict(docs.dtypes)[key]
    source = docs.select(F.col(f"`{key}`").alias("doc_id"), text_of().alias("text")).withColumn("t", F.xxhash64("text"))
    hashed = stored(source.mapInArrow(_nodes(n, percent), f"doc_id {kind}, t long, size long, hash long, prefix array<long>"), "hashed")
    size = F.col("size")

    # one row for each set; from here on a node is a running number, which is short in a shuffle
    sets = hashed.where("hash is not null").groupBy("hash", "size").agg(F.first("prefix").alias("prefix"), F.min("t").alias("t"), F.min("doc_id").alias("least"))
    nodes = stored(sets.withColumn("node", F.monotonically_increasing_id()), "nodes")
    base = stored(hashed.select("doc_id", "size", "hash"), "documents")
    forget(hashed), release(spark)

    # order 1: which tokens of the hash prefixes have two nodes?
    seen = nodes.select("node", F.explode("prefix").alias("token"))
    found = gathered(spark, lambda i: _shared(seen, i).groupBy("node").agg(F.count(F.lit(1)).alias("common")), PARTS, "common")
    common = found.groupBy("node").agg(F.sum("common").alias("common"))
    tried = nodes.select("node", "hash", "size", "t", F.size("prefix").alias("tried"))
    left = stored(tried.join(common, "node").where(F.col("tried") - F.col("common") <= size - needed(size, percent)).drop("tried", "common"), "left")
    # the prefixes are not needed any more
    narrow = stored(nodes.select("node", "hash", "size", "least"), "nodes")
    forget(found), forget(nodes), release(spark)
    nodes = narrow

    # their whole sets; a Bloom filter of a bounded size, which the join makes itself, keeps most other texts from being shuffled
    again = source.select("t", "text").join(left.where("size > 0").select("t"), "t", "left_semi").mapInArrow(_sets(n), "hash long, size long, tokens array<long>")
    sets = again.groupBy("hash", "size").agg(F.first("tokens").alias("tokens")).join(left.select("node", "hash", "size"), ["hash", "size"]).select("node", "size", "tokens")
    bloom = "spark__sql__optimizer__runtime__bloomFilter__"
    with settings(spark, **{bloom + "enabled": "true", bloom + "applicationSideScanSizeThreshold": "0", bloom + "creationSideThreshold": "1g"}):
        sets = stored(sets, "sets")
    forget(left), release(spark)

    # orders 2 and 3
    tokens = sets.select("node", F.explode("tokens").alias("token"))
    counted = gathered(spark, lambda i: _shared(tokens, i).groupBy("node").agg(F.collect_list(F.struct("df", "token")).alias("x")), PARTS, "counted")
    spare = size - needed(size, percent) + 1 - (size - F.size("x"))
    rare = F.slice(F.array_sort("x"), 1, F.col("k"))
    classed = F.slice(F.array_sort(F.transform("x", lambda s: F.struct(F.floor(F.log2(s["df"])).alias("c"), F.xxhash64(s["token"], F.lit(7)).alias("h")))), 1, F.col("k"))
    own = (size - F.size("x")).alias("own")

    def ordered(i: int) -> DataFrame:
        """The nodes of one part that have anything left of their prefix, with their prefixes under both orders."""
        mine = lambda df: df.where(F.pmod("node", F.lit(PARTS)) == i)
        listed = mine(counted).groupBy("node").agg(F.flatten(F.collect_list("x")).alias("x"))
        listed = mine(sets).select("node", "size").join(listed, "node").withColumn("k", spare.cast("int")).where("k > 0")
        prefixes = listed.select("node", own, F.transform(rare, lambda s: s["token"]).alias("first"), F.transform(classed, lambda s: s["h"]).alias("other"))
        return mine(sets).join(prefixes, "node").select(F.lit(0).cast("long").alias("ref"), "node", "size", "own", F.col("tokens").alias("plus"), F.array().cast("array<long>").alias("minus"), "first", "other")

    ranked = gathered(spark, ordered, PARTS, "ranked")
    forget(counted), forget(sets), release(spark)

    # what a node could reach with the partner of the group that has the fewest tokens of its own
    postings = ranked.select(F.explode("first").alias("g"), "ref", "node", "size", "own")
    least_own = postings.groupBy("g").agg(F.min("own").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    groups = postings.join(least_own, "g").where(can_link(size, F.col("own"), F.col("least"), percent)).select("g", "ref", "node", F.lit(True).alias("own"), (size - F.col("own")).cast("int").alias("shared"), F.lit(False).alias("any"), F.lit(True).alias("short"))
    # the first pivot is the empty set
    described, links, roots, used = ranked.drop("first").withColumn("psize", F.lit(0).cast("long")), None, None, [ranked]
    for i in range(levels + 1):
        groups = stored(groups, "groups")
        used.append(groups)
        if i == levels:
            found = stored(_pairwise(groups, described, roots, percent), "links")
        else:
            described, found = _compared(groups, described, roots, percent)
            groups = _next_groups(described, percent)
        used += [found, described]
        links = found if links is None else links.union(found)
        forget(roots)
        roots = components(links)
        release(spark)

    # classes back to documents
    placed = nodes.select("node", "hash", "size", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    of = placed.join(placed.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("hash", "size", "component_id")
    out = base.join(of, ["hash", "size"], "left").withColumnRenamed("size", "n_shingles")
    # the narrow result is stored, so that what it was made from can go
    out = stored(out.select("doc_id", "n_shingles", F.when(F.col("hash").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")), "groups")
    for gone in (base, nodes, roots, *used):
        forget(gone)
    return out.withColumnRenamed("doc_id", key)
