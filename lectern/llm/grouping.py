"""Connected groups from buckets of candidates, without expanding a bucket into pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.session import materialise


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in ``links`` (a, b): the smallest id reachable from it.

    Alternating star contractions: each round hangs larger neighbours, then smaller ones, on the smallest neighbour, so
    the depth of a component halves. Each round is a written table; minima are pre-aggregated, so a centre with many
    links is no hot spot.
    """
    spark = links.sparkSession
    oriented = lambda df: df.filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).distinct()
    state = materialise(oriented(links), "links")
    before = None
    while True:
        mark = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == before:
            break
        before = tuple(mark)
        both = state.union(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("u")).filter("b > u").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = oriented(large)
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        small = large.join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        state = materialise(oriented(small), "links")
    roots = state.select(F.col("b").alias("id")).distinct().withColumn("component", F.col("id"))
    return state.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots.select("id", "component"))


#: Rounds in which bucket members are compared with a single one before those still apart are compared in pairs.
ROUNDS = 6
#: Different members that large buckets of one group take as their centre in a round.
CENTRES = 8
#: Buckets with more members still apart are compared by blocks, where the caller can.
CROWD = 64
BLOCK = 512


def link_buckets(
    members: DataFrame,
    possible: Callable[[str, str], Column],
    confirmer: Callable[[DataFrame], Callable[[DataFrame], DataFrame]],
    block_links: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """(id, component) for every ``x`` that has a confirmed link; others are absent.

    ``members`` has x, keys (an array) and attributes; members with a common key share a bucket and may be linked.
    ``possible(p, q)`` is a condition on the attributes of two members, whose columns carry the prefixes p_ and q_.
    ``confirmer`` is given every ``x`` that shares a bucket and returns the function that picks the links out of pairs
    (a, b).

    In a round every member is compared with one member of its bucket, chosen by a hash, unless both are already in one
    component. Each round joins the links into components, so a bucket full of copies costs a few comparisons a member.
    When rounds no longer halve the pairs whose members are in different components, or few are left, those pairs are
    compared one by one, each in the first bucket that it shares. So every possible pair of a bucket is compared or
    connected: nothing is capped.

    Crowds, members of large buckets that stay apart, are not expanded into pairs. ``block_links``, if given, compares
    them block by block: it gets rows (family, i, j, side, x, c), a bounded number for each (family, i, j), and returns
    the links (a, b) between side 0 and side 1 of different components ``c``.
    """
    rows = members.select(F.explode("keys").alias("key"), "x")
    attributes = members.drop("keys")
    names = [c for c in attributes.columns if c != "x"]
    shared = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    apart = materialise(materialise(rows.join(shared, "key"), "members").join(attributes, "x"), "buckets").withColumn("c", F.col("x"))
    ids = materialise(apart.select("x").distinct(), "ids")
    confirm = confirmer(ids)
    labels = compared = before = None
    for turn in range(ROUNDS):
        by = F.xxhash64("x", F.pmod(F.xxhash64("key"), F.lit(CENTRES)), F.lit(turn))
        centre = apart.groupBy("key").agg(*[F.min_by(c, by).alias(f"p_{c}") for c in ("x", "c", *names)])
        others = apart.select("key", *[F.col(c).alias(f"q_{c}") for c in ("x", "c", *names)])
        pairs = unseen(ordered_pairs(others.join(centre, "key"), possible), compared)
        compared = pairs if compared is None else compared.union(pairs)
        labels = connect(labels, confirm(pairs))
        apart = still_apart(apart.drop("c"), labels)
        sizes = apart.groupBy("key", "c").agg(F.count("*").alias("n")).groupBy("key").agg(
            F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("square")
        )
        left, n = sizes.agg(F.sum((F.col("n") * F.col("n") - F.col("square")) / 2), F.sum("n")).first()
        if not n or left <= 4 * n or before and left > before / 2:
            break
        before = left
    if not n:
        return labels
    # Different components that share a key are both in its bucket here, so these keys tell the first one of a pair.
    keys = apart.groupBy("x").agg(F.collect_list("key").alias("keys"))
    if block_links is not None:
        crowded = apart.groupBy("key").agg(F.count("*").alias("n"), F.min("x").alias("head")).filter(F.col("n") > CROWD)
        crowded = materialise(crowded, "crowded")
        if not crowded.isEmpty():
            labels = connect(labels, block_links(block_pairs(apart.join(crowded, "key"))))
            apart = still_apart(apart.drop("c").join(crowded.select("key"), "key", "left_anti"), labels)
    keyed = materialise(apart.join(keys, "x"), "apart")
    one, two = (keyed.select("key", *[F.col(c).alias(f"{p}{c}") for c in ("x", "c", "keys", *names)]) for p in ("p_", "q_"))
    first = F.array_min(F.array_intersect("p_keys", "q_keys")) == F.col("key")
    rest = ordered_pairs(one.join(two, "key").filter((F.col("p_x") < F.col("q_x")) & first), possible)
    return connect(labels, confirm(unseen(rest, compared)))


def block_pairs(crowd: DataFrame) -> DataFrame:
    """(family, i, j, side, x, c): crowds that share members are a family, dealt into blocks; every pair of blocks meets."""
    family = components(crowd.select(F.col("x").alias("a"), F.col("head").alias("b"))).select(F.col("id").alias("x"), F.col("component").alias("family"))
    dealt = crowd.select("x", "c").distinct().join(family, "x")
    blocks = dealt.groupBy("family").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    at = dealt.join(blocks, "family").withColumn("block", F.pmod(F.xxhash64("x"), F.col("blocks")))
    meets = F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)
    # A block is side 0 against itself and later blocks, and side 1 of itself and earlier ones.
    sides = F.flatten(F.transform(meets, lambda other: F.when(
        F.col("block") == other, F.array(F.struct(other.alias("i"), other.alias("j"), F.lit(0).alias("side")), F.struct(other.alias("i"), other.alias("j"), F.lit(1).alias("side")))
    ).when(other > F.col("block"), F.array(F.struct(F.col("block").alias("i"), other.alias("j"), F.lit(0).alias("side"))))
    .otherwise(F.array(F.struct(other.alias("i"), F.col("block").alias("j"), F.lit(1).alias("side"))))))
    return at.select("family", "x", "c", F.explode(sides).alias("s")).select("family", "s.i", "s.j", "s.side", "x", "c")


def ordered_pairs(joined: DataFrame, possible: Callable[[str, str], Column]) -> DataFrame:
    """Distinct pairs (a, b), a < b, of different components that may be linked."""
    kept = joined.filter((F.col("p_x") != F.col("q_x")) & (F.col("p_c") != F.col("q_c")) & possible("p_", "q_"))
    return kept.select(F.least("p_x", "q_x").alias("a"), F.greatest("p_x", "q_x").alias("b")).distinct()


def unseen(pairs: DataFrame, compared: DataFrame | None) -> DataFrame:
    return materialise(pairs if compared is None else pairs.join(compared, ["a", "b"], "left_anti"), "pairs")


def connect(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components after more links; the components so far stand for the links that made them."""
    links = materialise(links, "confirmed")
    if labels is not None:
        if links.isEmpty():
            return labels
        links = links.union(labels.select(F.col("id").alias("a"), F.col("component").alias("b")))
    return materialise(components(links), "components")


def still_apart(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The members, with their component ``c``, of buckets that hold several components."""
    marked = rows.join(labels.withColumnRenamed("id", "x"), "x", "left").withColumn("c", F.coalesce("component", "x"))
    mixed = marked.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("key")
    return materialise(marked.drop("component").join(mixed, "key"), "apart")
