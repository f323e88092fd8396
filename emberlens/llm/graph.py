"""Connected components of a distributed edge list."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlens.llm.common import staged


def components(edges: DataFrame) -> DataFrame:
    """``node, comp`` for every node of ``edges`` (columns ``a, b``); ``comp`` is its least node.

    Every node points to a node of its component, at first to its least neighbour. In each
    round (FastSV: Zhang, Azad and Hu, 2020) a node hears the least of what its neighbours'
    pointers point to; it takes that itself and offers it to the node it points to, and then
    takes what its pointer pointed to. So whole trees of pointers are hooked at once, and the
    rounds grow with the logarithm of the number of nodes, on long chains too. Every round is
    written to the shared folder; the driver sees one sum. When a round changes nothing, both
    ends of every edge point to the same node, which points to itself.
    """
    both = staged(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges", packed=True)
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("comp")), "labels", packed=True)
    before = None
    while True:
        total = labels.agg(F.sum(F.col("comp").cast("decimal(38,0)")).alias("s")).first()["s"]
        if total == before:
            return labels
        before = total
        up = labels.select(F.col("node").alias("up"), F.col("comp").alias("higher"))
        high = staged(labels.join(up, labels["comp"] == up["up"]).select("node", "comp", "higher"), "higher", packed=True)
        heard = both.join(high.select("node", "higher"), both["b"] == high["node"]).groupBy("a").agg(F.min("higher").alias("heard"))
        moved = heard.join(high, heard["a"] == high["node"])
        own = F.struct("node", F.least("higher", "heard").alias("comp"))
        offer = F.struct(F.col("comp").alias("node"), F.col("heard").alias("comp"))
        news = moved.select(F.explode(F.when(F.col("heard") < F.col("higher"), F.array(own, offer)).otherwise(F.array(own))).alias("n"))
        labels = staged(news.groupBy("n.node").agg(F.min("n.comp").alias("comp")), "labels", packed=True)


def merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """``found`` with further ``links``: only the components that these join are worked on."""
    of = {c: found.select(F.col("node").alias(c), F.col("comp").alias(f"c{c}")) for c in ("a", "b")}
    joined = links.join(of["a"], "a", "left").join(of["b"], "b", "left")
    joined = joined.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    joined = staged(joined.where("a != b").distinct(), "joined", packed=True)
    if joined.isEmpty():
        return found
    up = components(joined)
    higher = up.select(F.col("node").alias("comp"), F.col("comp").alias("higher"))
    old = found.join(higher, "comp", "left").select("node", F.coalesce("higher", "comp").alias("comp"))
    return staged(old.union(up.join(found, "node", "left_anti").select("node", "comp")), "merged", packed=True)


#: Partners that a node outside its bucket's main component meets in a round: offsets up to
#: these, then eight times as many each round, until the bucket is through.
OFFSETS = (4, 32, 256, 2048, 16384)
#: Torn buckets of more nodes than this are left to ``within``, where one is given.
SMALL = 32


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _placed(members: DataFrame, found: DataFrame) -> DataFrame:
    return members.join(found, "node", "left").select(*members.columns, F.coalesce("comp", "node").alias("comp"))


def main_parts(placed: DataFrame, key: str) -> DataFrame:
    """``key, main``: the component with most nodes of each group of ``placed``."""
    counts = placed.groupBy(key, "comp").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(key).agg(F.max(F.struct("n", "comp")).alias("m")).select(key, F.col("m.comp").alias("main"))


def linked(
    banded: DataFrame,
    prepare: Callable[[DataFrame], Callable[[DataFrame], DataFrame]],
    within: Callable[[DataFrame], list[Callable[[DataFrame], DataFrame]]] | None = None,
) -> DataFrame:
    """Components of the nodes that share a bucket and pass verification.

    ``banded`` has ``node, bucket``. ``prepare`` gets the nodes that share some bucket and
    returns a function that takes pairs ``a < b`` and returns those that are linked. The
    result is that of ``components``, for nodes with some link; an empty table gives an empty
    one.

    In each bucket the nodes are paired with the bucket's hub first: the node that shares most
    with others, by the sizes of all its buckets (of equals the least). What copies were made
    from agrees with more of them than they do with each other, so most of a large group
    joins here. Where a bucket is not in one component then, every link between two of its
    components is still found:

    * a bucket of more than ``SMALL`` nodes is left to ``within``. It gets the groups ``hub,
      node`` of such buckets and returns functions, called one after the other on ``hub, node,
      comp`` with components as they are then; together they have to propose every pair of a
      group that may be linked and lies in two components;
    * in other buckets (without ``within`` in all) each node outside the largest component
      meets further nodes of the bucket, at growing distances in an order by hash, until it
      has joined that component or has met every node.
    """
    counted = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = staged(banded.select("node", "bucket").join(counted, "bucket"), "met")
    central = met.groupBy("node").agg(F.sum("n").alias("central"))
    most = F.max(F.struct("central", (-F.col("node")).alias("back"))).alias("most")
    hubs = met.join(central, "node").groupBy("bucket").agg(most).select("bucket", (-F.col("most.back")).alias("hub"))
    met = staged(met.join(hubs, "bucket"), "buckets")
    verify = prepare(met.select("node").distinct())
    stars = met.where("node != hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    tested = staged(_ordered(stars).distinct(), "stars", packed=True)
    found = components(staged(verify(tested), "links"))
    members = met.select("bucket", "node")

    if within is not None:
        large = _placed(met.where(F.col("n") > SMALL).select("bucket", "hub", "node"), found)
        torn = large.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x != y").select("bucket")
        groups = staged(large.join(torn, "bucket").select("hub", "node").distinct(), "groups")
        for propose in [] if groups.isEmpty() else within(groups):
            pairs = staged(_ordered(propose(_placed(groups, found))).distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
            tested = tested.union(pairs)
            if not pairs.isEmpty():
                found = merged(found, staged(verify(pairs), "links"))
        members = met.where(F.col("n") <= SMALL).select("bucket", "node")

    low = 1
    rounds = iter(OFFSETS)
    while True:
        placed = _placed(members, found)
        torn = placed.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("size"))
        torn = torn.where((F.col("x") != F.col("y")) & (F.col("size") >= 2 * low)).select("bucket", "size")
        apart = staged(placed.join(torn, "bucket"), "apart")
        if apart.isEmpty():
            return found
        high = next(rounds, None) or low * 8
        order = Window.partitionBy("bucket").orderBy(F.xxhash64("node"), "node")
        ranked = staged(apart.withColumn("at", F.row_number().over(order) - 1), "ranked")
        # Of two nodes that are apart, one at least is outside the main component. If half the
        # bucket is outside, every node looks one way round; else those outside look both ways.
        sized = ranked.join(main_parts(apart, "bucket"), "bucket")
        sized = sized.groupBy("bucket", "main").agg((F.count_if(F.col("comp") != F.col("main")) * 2 >= F.count(F.lit(1))).alias("all"))
        outside = ranked.join(sized, "bucket").where("all or comp != main")
        last = F.least(F.lit(high - 1), F.floor(F.col("size") / 2)).cast("int")
        steps = F.when(last >= low, F.sequence(F.lit(low), last))
        steps = F.when(F.col("all"), steps).otherwise(F.concat(steps, F.transform(steps, lambda s: -s)))
        seek = outside.select("bucket", "node", "comp", F.explode(steps).alias("step"), "at", "size")
        seek = seek.select("bucket", "node", "comp", F.pmod(F.col("at") + F.col("step"), "size").cast("int").alias("at"))
        other = ranked.select(*[F.col(c).alias(f"{c}2") for c in ("bucket", "at", "node", "comp")])
        meet = (F.col("bucket") == F.col("bucket2")) & (F.col("at") == F.col("at2")) & (F.col("comp") != F.col("comp2"))
        pairs = seek.join(other, meet).select(F.col("node").alias("a"), F.col("node2").alias("b"))
        pairs = staged(_ordered(pairs).distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
        tested, low = tested.union(pairs), high
        if not pairs.isEmpty():
            found = merged(found, staged(verify(pairs), "links"))
        members = apart.select("bucket", "node")
