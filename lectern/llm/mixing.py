"""Mixing sources to target weights, by a multivariate-hypergeometric splitting tree. DataFrame operations only.

Every source is cut into blocks of documents in a random order fixed by a hash. Its target says how many blocks the mix
draws: whole passes over the source, then the first blocks of the order, then as much of the next few as fits. The
draws are quotas of the root of a binary tree over output shards. Each node hands a random half of its draws to its
left child: how many of each source that half holds is a multivariate hypergeometric variate, drawn source by source
from its exact distribution. The leaves say how many blocks of each source a shard gets; shards take consecutive,
hence disjoint, draws of each source's order, and every shard orders its documents by a hash of its own.

Work on documents is by (source, block), and blocks are of even size whatever the source's, so a source with a third of
all rows is no hot spot. Sources and blocks (about a million at most) are the only things that meet in single windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import materialise

WEIGHTS = (5, 2, 1)
PERCENT = 150
MAX_REPEATS = 2
#: Blocks hold about this many words, or a 2^20th of all words where that is more.
BLOCK_WORDS = 4096
MAX_BLOCKS = 1 << 20
#: So many blocks at least, and twice the missing words, are the documents that may fill what is left of a target.
FILL_BLOCKS = 4
SHARD_WORDS = 1 << 21
WORD = r"[^\x20\x09-\x0D]+"


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) fixed by its arguments."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) * F.lit(2.0**-53)


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, the row's key (128 bits of doc_id and text) and its size in words."""
    return docs.select("doc_id", "source", *keys(), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"))


def keys() -> list[Column]:
    return [F.xxhash64("doc_id", "text").alias("key"), F.xxhash64("text", F.lit("mix"), "doc_id").alias("key2")]


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, cap: int = MAX_REPEATS) -> DataFrame:
    """source_no, source, source_size, target: how many words of each source the mix takes.

    ``sizes`` has a row per source. Sources in code point order, null last, weigh ``weights`` in turn and share
    ``percent`` of all words; what exceeds ``cap`` times a source goes to the others by weight, again and again. That
    ends at a level L with target = min(cap * size, weight * L), which prefix sums over the sources by cap / weight find.
    """
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    numbered = sizes.withColumn(
        "source_no", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    )
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("source_no") % len(weights) + 1)
    weighed = numbered.select("*", weight.alias("w"), (F.col("source_size") * float(cap)).alias("cap")).withColumn(
        "ratio", F.col("cap") / F.col("w")
    )
    order = Window.orderBy("ratio", "source_no")
    summed = weighed.select(
        "*",
        (F.sum("source_size").over(everything) * (percent / 100.0)).alias("total"),
        (F.sum("cap").over(order) - F.col("cap")).alias("full"),
        (F.sum("w").over(everything) - F.sum("w").over(order) + F.col("w")).alias("open"),
    )
    level = (F.col("total") - F.col("full")) / F.col("open")
    # The first source, by ratio, that its cap would not stop at the level of those that are left.
    first = F.when(F.col("ratio") * F.col("open") + F.col("full") >= F.col("total"), F.struct("ratio", level.alias("level")))
    return summed.select("*", F.min(first).over(everything)["level"].alias("level")).select(
        "source_no", "source", "source_size",
        F.least("cap", F.coalesce(F.col("w") * F.col("level"), F.col("cap"))).alias("target"),
    )


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of ``marked`` among ``total`` are in a sample of ``drawn``: the distribution's quantile at ``u``.

    The probabilities, up to a factor, follow from each other by a ratio. The sum runs over ten standard deviations to
    either side of the mean, beyond which less than 1e-20 lies.
    """
    n, k, d = (x.cast("double") for x in (total, marked, drawn))
    mean = F.when(n > 0, d * k / n).otherwise(0.0)
    sd = F.sqrt(F.when(n > 1, mean * (1 - k / n) * (n - d) / (n - 1)).otherwise(0.0))
    low = F.greatest(F.lit(0.0), d - (n - k), F.floor(mean - 10 * sd - 1).cast("double")).cast("bigint")
    high = F.least(d, k, F.ceil(mean + 10 * sd + 1).cast("double")).cast("bigint")
    values = F.sequence(low, high)

    def following(w: Column, x: Column) -> Column:
        return w * (k - x) * (d - x) / ((x + 1) * (n - k - d + x + 1))

    zero = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"))
    mass = F.aggregate(
        values, zero, lambda s, x: F.struct(following(s["w"], x.cast("double")).alias("w"), (s["sum"] + s["w"]).alias("sum")),
        lambda s: s["sum"],
    )
    start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"), mass.alias("goal"), high.alias("found"), F.lit(False).alias("done"))

    def step(s: Column, x: Column) -> Column:
        upto = s["sum"] + s["w"]
        here = ~s["done"] & (upto > s["goal"])
        return F.struct(
            following(s["w"], x.cast("double")).alias("w"), upto.alias("sum"), s["goal"].alias("goal"),
            F.when(here, x).otherwise(s["found"]).alias("found"), (s["done"] | here).alias("done"),
        )

    start = start.withField("goal", mass * u)
    return F.aggregate(values, start, step, lambda s: s["found"])


def split_quotas(quotas: DataFrame, levels: int, seed: int) -> DataFrame:
    """(shard, source_no, n) from (source_no, quota): the tree's leaves."""
    part = F.struct("source_no", F.col("quota").alias("quota"))
    nodes = quotas.agg(F.array_sort(F.collect_list(part)).alias("parts")).select(F.lit(0).cast("bigint").alias("node"), "parts")
    for level in range(levels):
        total = F.aggregate("parts", F.lit(0).cast("bigint"), lambda s, p: s + p["quota"])
        empty = F.array().cast("array<bigint>")

        def take(s: Column, p: Column) -> Column:
            u = uniform(F.lit(seed), F.lit(level), F.col("node"), p["source_no"])  # noqa: B023
            got = hypergeometric(s["total"], p["quota"], s["drawn"], u)
            return F.struct(
                (s["total"] - p["quota"]).alias("total"), (s["drawn"] - got).alias("drawn"),
                F.concat(s["left"], F.array(got)).alias("left"),
            )

        # An odd draw more goes left or right by the node's number, so that shards stay even.
        half = F.floor((total + F.col("node") % 2) / 2).cast("bigint")
        begin = F.struct(total.alias("total"), half.alias("drawn"), empty.alias("left"))
        got = nodes.withColumn("left", F.aggregate("parts", begin, take, lambda s: s["left"]))
        child = lambda right: F.zip_with(
            "parts", "left",
            lambda p, x: F.struct(p["source_no"].alias("source_no"), (p["quota"] - x if right else x).alias("quota")),  # noqa: B023
        )
        both = F.array(
            F.struct((F.col("node") * 2).alias("node"), child(False).alias("parts")),
            F.struct((F.col("node") * 2 + 1).alias("node"), child(True).alias("parts")),
        )
        nodes = got.select(F.explode(both).alias("c")).select("c.node", "c.parts")
    return nodes.select(F.col("node").cast("int").alias("shard"), F.explode("parts").alias("p")).select(
        "shard", "p.source_no", F.col("p.quota").alias("n")
    )


def plan_mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, cap: int = MAX_REPEATS,
    block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = 11,
) -> DataFrame:
    """doc_id, source, key, key2, size, source_size, target, shards: one row per row of ``docs``.

    ``shards`` lists the output shard of every copy that the mix takes, so its length is the number of copies, at most
    ``cap``. Null and empty texts have size 0 and are not taken. Rows equal in doc_id, source and text are drawn
    together. Null is a source of its own. An empty table gives no rows. Reruns agree.
    """
    rows = materialise(sized(docs), "mix-sizes")
    goals = materialise(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, percent, cap), "mix-targets")
    words, wanted = goals.agg(F.sum("source_size"), F.sum("target")).first()
    block_words = max(block_words, -(-(words or 0) // MAX_BLOCKS))
    levels = max(0, (int((wanted or 0) // shard_words)).bit_length())

    same_source = lambda a, b: a["source"].eqNullSafe(b["source"])
    units = rows.groupBy("source", "key", "key2", "size").agg((F.count("*") * F.col("size")).alias("words"))
    blocks_of = F.greatest(F.ceil(F.col("source_size") / F.lit(block_words)), F.lit(1))
    placed = units.filter("words > 0").join(F.broadcast(goals) if goals.count() <= 10_000 else goals, same_source(units, goals)).select(
        "source_no", "key", "key2", "words", F.pmod(F.xxhash64("key", F.lit(seed)), blocks_of).alias("block")
    )
    placed = materialise(placed, "mix-units")
    blocks = placed.groupBy("source_no", "block").agg(F.sum("words").alias("words")).join(
        goals.select("source_no", "source_size", "target"), "source_no"
    )
    order = Window.partitionBy("source_no").orderBy(F.xxhash64("block", F.lit(seed + 1)), "block")
    passes = F.floor(F.col("target") / F.col("source_size") + 1e-12)
    drawn = blocks.select(
        "source_no", "block", "words", passes.alias("passes"),
        (F.col("target") - passes * F.col("source_size")).alias("rest"),
        (F.row_number().over(order) - 1).alias("rank"),
        (F.sum("words").over(order) - F.col("words")).alias("before"),
        F.count("*").over(Window.partitionBy("source_no")).alias("n_blocks"),
    ).select("*", (F.col("before") < F.col("rest")).alias("last"), (F.col("before") + F.col("words") > F.col("rest")).alias("over"))
    # What is left of the target after the last whole block is filled with documents of the next few blocks.
    own, edge = Window.partitionBy("source_no"), F.col("last") & F.col("over")
    first, room = F.min(F.when(edge, F.col("rank"))).over(own), F.min(F.when(edge, F.col("rest") - F.col("before"))).over(own)
    passed = F.col("before") - F.min(F.when(edge, F.col("before") + F.col("words"))).over(own)
    near = (F.col("rank") < first + FILL_BLOCKS) | (passed <= 2 * room)
    drawn = drawn.withColumn("room", room).withColumn("partial", F.coalesce((F.col("rank") >= first) & near, F.lit(False)))
    drawn = materialise(
        drawn.select(
            "source_no", "block", "rank", "n_blocks", "partial", "room",
            (F.col("passes") + (F.col("last") | F.col("partial")).cast("int")).alias("draws"),
        ),
        "mix-blocks",
    )
    quotas = drawn.groupBy("source_no").agg(F.sum("draws").alias("quota"))
    leaves = split_quotas(quotas, levels, seed)
    upto = Window.partitionBy("source_no").orderBy("shard")
    leaves = materialise(leaves.filter("n > 0").select("*", (F.sum("n").over(upto) - F.col("n")).alias("start")), "mix-shards")
    slots = leaves.select("source_no", "shard", F.explode(F.expr("sequence(start, start + n - 1)")).alias("draw"))
    # Pass p draws the source's blocks in their order, so draw numbers run through the passes without a gap.
    draws = drawn.filter("draws > 0").select(
        "source_no", "block", F.explode(F.expr("sequence(0, draws - 1)")).alias("pass"), "rank", "n_blocks"
    ).select("source_no", "block", "pass", (F.col("pass") * F.col("n_blocks") + F.col("rank")).alias("draw"))
    shards = draws.join(slots, ["source_no", "draw"]).groupBy("source_no", "block").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pass", "shard"))), lambda x: x["shard"]).alias("shards")
    )
    shards = materialise(shards.join(drawn.select("source_no", "block", "partial", "room"), ["source_no", "block"]), "mix-draws")

    inside = placed.join(shards, ["source_no", "block"])
    whole = inside.filter("not partial").select("source_no", "key", "key2", "shards")
    # The largest documents first, as many as fit. A few bounded blocks per source.
    filled = inside.filter("partial").groupBy("source_no", "room").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("words")).alias("minus"), "key", "key2", "shards"))).alias("docs")
    )
    state = F.struct(F.col("room").alias("room"), F.array().cast("array<boolean>").alias("taken"))

    def fill(s: Column, d: Column) -> Column:
        fits = -d["minus"] <= s["room"]
        return F.struct(
            F.when(fits, s["room"] + d["minus"]).otherwise(s["room"]).alias("room"), F.concat(s["taken"], F.array(fits)).alias("taken")
        )

    taken = F.aggregate("docs", state, fill, lambda s: s["taken"])
    last = filled.select(
        "source_no", F.explode(F.arrays_zip(F.col("docs").alias("d"), taken.alias("fits"))).alias("x")
    ).select(
        "source_no", "x.d.key", "x.d.key2",
        F.when(F.col("x.fits"), F.col("x.d.shards")).otherwise(F.slice("x.d.shards", F.lit(1), F.size("x.d.shards") - 1)).alias("shards"),
    )
    chosen = whole.union(last).join(goals.select("source_no", F.col("source").alias("of")), "source_no")
    chosen = chosen.select(F.col("key").alias("k"), F.col("key2").alias("k2"), "of", "shards")
    out = rows.join(goals.select(F.col("source").alias("s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("s"))).join(
        chosen, (F.col("key") == F.col("k")) & (F.col("key2") == F.col("k2")) & F.col("source").eqNullSafe(F.col("of")), "left"
    )
    return out.select(
        "doc_id", "source", "key", "key2", "size", "source_size", "target",
        F.coalesce("shards", F.array().cast("array<int>")).alias("shards"),
    )


def mix(docs: DataFrame, seed: int = 11, **options) -> DataFrame:
    """The mix: the columns of ``docs`` with ``shard``, a row per taken copy, grouped by shard and shuffled inside it."""
    plan = plan_mix(docs, seed=seed, **options).select("key", "key2", "source", "shards").distinct()
    # The row travels as one struct, so its columns clash with none of the plan's.
    given = docs.select(F.struct(*docs.columns).alias("row"), *keys(), "source")
    on = (given["key"] == plan["key"]) & (given["key2"] == plan["key2"]) & given["source"].eqNullSafe(plan["source"])
    copies = given.join(plan, on).select("row", given["key"].alias("k"), F.posexplode("shards").alias("pass", "to"))
    dealt = copies.repartition("to").sortWithinPartitions("to", F.xxhash64("k", "pass", "to", F.lit(seed)), "k")
    return dealt.select(*[F.col(f"row.{c}").alias(c) for c in docs.columns if c != "shard"], F.col("to").alias("shard"))
