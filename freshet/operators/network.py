"""Drainage networks: edges, upstream closure and what is summed over it."""

from __future__ import annotations

import tempfile
from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element kinds whose Downstream makes an edge, and the one that also diverts.
LINKED = ("Subbasin", "Junction", "Reach", "Diversion")
DIVERTING = "Diversion"
MERGE = 16
HOPS = 4
SHALLOW = 15
FRONTIER = 100_000


class Deep(RuntimeError):
    """A chain is longer than the rounds allowed."""


def shared_folder(spark) -> str:
    """spark.checkpoint.dir, set to a new folder where it is unset; only a local session may do without that setting."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        given = sc.getConf().get("spark.checkpoint.dir")
        if given is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="freshet-checkpoints-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df cut off from its lineage in spark.checkpoint.dir."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df written as columns below spark.checkpoint.dir and read back: for what many rounds read, as rows of a checkpoint are read slowly."""
    path = f"{shared_folder(df.sparkSession)}/{uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def edges(elements: DataFrame) -> DataFrame:
    """(src, src_type, dst) of elements(kind, name, downstream, divert_to)."""
    down = elements.where(F.col("kind").isin(*LINKED) & F.col("downstream").isNotNull()).select(F.col("name").alias("src"), F.col("kind").alias("src_type"), F.col("downstream").alias("dst"))
    aside = elements.where((F.col("kind") == DIVERTING) & F.col("divert_to").isNotNull()).select(F.col("name").alias("src"), F.col("kind").alias("src_type"), F.col("divert_to").alias("dst"))
    return down.union(aside)


def closure(edge: DataFrame, targets: DataFrame, max_depth: int = 10_000, growing: bool = False) -> DataFrame:
    """(target, node): every node upstream of each target, found by breadth-first rounds; cycles end and a chain longer
    than ``max_depth`` raises; with ``growing`` only once a round finds fewer nodes than there were.

    Each round follows ``HOPS`` edges from the newest nodes and drops those already found, so diamonds are walked once. While
    they are at most ``FRONTIER`` rows they are broadcast, and the edges stay where they are; more are joined through a shuffle.
    A round writes its new nodes; what was found before is rewritten once in ``MERGE`` rounds, to keep the plan short.
    """
    e = stored(edge.select("src", "dst").distinct())
    new = stored(targets.groupBy("target").agg(F.min("target").alias("node")))  # an alias would be carried on as a constraint by every round
    parts, n, left = [new], new.count(), max_depth + 1
    total, doubled = n, False
    while left > 0 or doubled:
        seen = reduce(DataFrame.union, parts)
        hops, few = min(HOPS, left) if left > 0 else HOPS, n <= FRONTIER
        at = F.broadcast(new) if few else new
        found = []
        for k in range(1, hops + 1):
            at = at.join(e.toDF("src", "node"), "node").select("target", F.col("src").alias("node"))
            at = (at if few else at.repartition("node")).distinct()  # one shuffle for this and for the next hop
            found.append(at.withColumn("hop", F.lit(k)))
        step = reduce(DataFrame.union, found).groupBy("target", "node").agg(F.min("hop").alias("hop"))
        near = stored(step.join(seen, ["target", "node"], "left_anti"))
        n, far = near.agg(F.count("*"), F.max("hop")).first()
        new = near.select("target", "node")
        if not n or far < hops:
            return seen.union(new)
        parts = [stored(seen), new] if len(parts) >= MERGE else [*parts, new]
        left -= hops
        total, doubled = total + n, growing and n >= total
    raise Deep(f"closure is not complete after {max_depth} rounds")


def _jumped(state: DataFrame) -> DataFrame:
    """state(node, at, done) with each pointer moved on to where the one it points to points."""
    ahead = state.select(F.col("node").alias("_p"), F.col("at").alias("_at"), F.col("done").alias("_done"))
    moved = state.where("not done").join(ahead, F.col("at") == F.col("_p")).select("node", F.col("_at").alias("at"), F.col("_done").alias("done"))
    return state.where("done").union(moved)


def owners(edge: DataFrame, stops: DataFrame) -> DataFrame:
    """(node, owner): the first of stops(node) at or downstream of each node; nodes that reach none are left out.

    Nodes with several ways down must be stops themselves. Pointers are doubled, so rounds follow the logarithm of the longest
    way to a stop; nodes on or above a cycle without a stop are given up after as many rounds as all nodes could need.
    """
    way = edge.groupBy("src").agg(F.min("dst").alias("dst"))
    nodes = edge.select(F.col("src").alias("node")).union(edge.select("dst")).distinct()
    stop = stops.select("node").distinct().withColumn("stop", F.lit(True))
    state = nodes.join(way, F.col("node") == F.col("src"), "left").join(stop, "node", "left")
    state = checkpointed(state.select("node", F.when(F.col("stop"), F.col("node")).otherwise(F.col("dst")).alias("at"), (F.col("stop").isNotNull() | F.col("dst").isNull()).alias("done")))
    n, open_ = state.agg(F.count("*"), F.count_if(~F.col("done"))).first()
    for _ in range(n.bit_length() + 1):
        if not open_:
            break
        state = checkpointed(_jumped(_jumped(state)))
        open_ = state.where("not done").count()
    return state.where("done and at is not null").select("node", F.col("at").alias("owner"))


def chained(pairs: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(target, node) of all chains of pairs(target, node), by joining the pairs with themselves: a round doubles the length."""
    found, n = checkpointed(pairs.distinct()), -1
    for _ in range(max_rounds):
        count = found.count()
        if count == n:
            return found
        n = count
        far = found.select(F.col("target").alias("node"), F.col("node").alias("_n"))
        found = checkpointed(found.union(found.join(far, "node").select("target", F.col("_n").alias("node"))).distinct())
    raise RuntimeError("chained: no fixed point")


def upstream(edge: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, name, kind): a row for each edge whose head is the target or upstream of it, so an element with two
    such edges is listed twice and a cycle lists the target itself.

    A network of at most ``SHALLOW`` levels above the targets, or one that at least doubles every few levels, is walked in a few rounds. In a deeper one
    every node belongs to the first target or diversion downstream of it (see owners). What lies upstream of a target are
    the nodes of those that lie upstream of it, so only these few are followed: by doubling, or by breadth-first rounds
    where there are diversions.
    """
    edge = stored(edge)
    try:
        c = closure(edge, targets.select("target").where("target is not null").distinct(), SHALLOW, growing=True)
        return edge.join(c, edge.dst == c.node).select("target", F.col("src").alias("name"), F.col("src_type").alias("kind"))
    except Deep:
        pass
    split = edge.groupBy("src").agg(F.countDistinct("dst").alias("ways")).where("ways > 1").select(F.col("src").alias("node"))
    split = checkpointed(split)
    wanted = targets.select("target").where("target is not null").distinct()
    stops = checkpointed(wanted.select(F.col("target").alias("node")).union(split).distinct())
    owner = checkpointed(owners(edge, stops))
    heads = edge.join(owner, edge.dst == owner.node).select("src", "src_type", "owner")
    steps = heads.join(stops, heads.src == stops.node, "left_semi").select("src", F.col("owner").alias("dst")).distinct()
    if split.isEmpty():
        c = chained(steps.select(F.col("dst").alias("target"), F.col("src").alias("node"))).union(wanted.select("target", F.col("target").alias("node"))).distinct()
    else:
        c = closure(steps, wanted)
    return heads.join(c, heads.owner == c.node).select("target", F.col("src").alias("name"), F.col("src_type").alias("kind"))


def contributing_area(edge: DataFrame, areas: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, area, n_subbasins): areas(name, area) summed over the distinct subbasins upstream, nulls left out."""
    names = upstream(edge, targets).where("kind = 'Subbasin'").select("target", "name").distinct()
    found = names.join(areas, "name").groupBy("target").agg(F.coalesce(F.sum("area"), F.lit(0.0)).alias("area"), F.count("*").alias("n_subbasins"))
    return targets.select("target").join(found, "target", "left").select("target", F.coalesce("area", F.lit(0.0)).alias("area"), F.coalesce("n_subbasins", F.lit(0)).alias("n_subbasins"))


def area_table(edge: DataFrame, areas: DataFrame, junctions: DataFrame) -> DataFrame:
    """contributing_area with the sorted names of the subbasins, ascending by area."""
    names = upstream(edge, junctions).where("kind = 'Subbasin'").select("target", "name").distinct()
    out = names.join(areas, "name").groupBy("target").agg(F.coalesce(F.sum("area"), F.lit(0.0)).alias("area"), F.count("*").alias("n_subbasins"), F.sort_array(F.collect_list("name")).alias("subbasins"))
    return out.orderBy("area", "target")


def tree_closure(spark, edge_view: str, root) -> DataFrame:
    """The same for a tree, as a recursive query over a view(src, dst); a tree deeper than the session's
    spark.sql.cteRecursionLevelLimit raises."""
    return spark.sql(
        "WITH RECURSIVE up(node) AS (SELECT :root UNION ALL SELECT e.src FROM IDENTIFIER(:edges) e JOIN up ON e.dst = up.node) SELECT DISTINCT node FROM up",
        args={"root": root, "edges": edge_view},
    )


def link_topology(links: DataFrame) -> DataFrame:
    """links(link, ds_link, length, order): the downstream link's order, how many links come in, whether it is an outlet."""
    up = links.where("ds_link is not null").groupBy(F.col("ds_link").alias("link")).agg(F.count("*").alias("n_upstream"))
    down = links.select(F.col("link").alias("ds_link"), F.col("order").alias("ds_order"))
    return links.join(up, "link", "left").join(down, "ds_link", "left").select("link", "ds_link", "order", "ds_order", F.coalesce("n_upstream", F.lit(0)).alias("n_upstream"), F.col("ds_order").isNull().alias("outlet"), (F.coalesce("n_upstream", F.lit(0)) >= 2).alias("junction"))


def stream_summary(links: DataFrame) -> DataFrame:
    """By order and, where order is null, in all: links and length."""
    return links.groupBy(F.col("order")).agg(F.count("*").alias("n_links"), F.sum("length").alias("length")).union(links.select(F.lit(None).cast("int").alias("order"), F.col("link"), F.col("length")).groupBy("order").agg(F.count("link").alias("n_links"), F.sum("length").alias("length")))


def reconcile(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): keys in both, only in the left or only in the right table."""
    x, y = a.select(key).distinct().withColumn("_a", F.lit(True)), b.select(key).distinct().withColumn("_b", F.lit(True))
    return x.join(y, key, "full").select(key, F.when(F.col("_a") & F.col("_b"), "both").when(F.col("_a"), "left").otherwise("right").alias("side"))


def nearest_outlet(crossings: DataFrame, group: list[str], farthest: bool = False) -> DataFrame:
    """crossings(group, idx, order, distance): among those of the highest order the nearest (or farthest), ties by idx.

    One aggregate; a single crossing is its group's outlet whatever its order.
    """
    d = -F.col("distance") if farthest else F.col("distance")
    best = F.min_by(F.struct(*[c for c in crossings.columns if c not in group]), F.struct(-F.col("order"), d, F.col("idx")))
    return crossings.groupBy(*group).agg(best.alias("_b")).select(*group, "_b.*").select(*crossings.columns)


def max_order(links: DataFrame) -> DataFrame:
    """Links, their length and the highest order of the network in one row; without links zeros and a null order."""
    return links.agg(F.count("*").alias("n_links"), F.coalesce(F.sum("length"), F.lit(0.0)).alias("length"), F.max("order").alias("max_order"))


def area_closure(subbasins: DataFrame, boundary: DataFrame, key: list[str]) -> DataFrame:
    """subbasins(key, area) against boundary(key, area): sums, difference and percent of the boundary (null for area 0)."""
    own = subbasins.groupBy(*key).agg(F.sum("area").alias("subbasin_area"))
    d = F.coalesce("subbasin_area", F.lit(0.0)) - F.col("boundary_area")
    return boundary.withColumnRenamed("area", "boundary_area").join(own, key, "left").select(*key, F.coalesce("subbasin_area", F.lit(0.0)).alias("subbasin_area"), "boundary_area", d.alias("difference"), F.when(F.col("boundary_area") != 0, d / F.col("boundary_area") * 100).alias("percent"))


def dedupe_points(points: DataFrame, digits: int = 6) -> DataFrame:
    """First of the points(idx, x, y) that agree on rounded coordinates."""
    return points.groupBy(F.round("x", digits).alias("rx"), F.round("y", digits).alias("ry")).agg(F.min(F.struct("idx", "x", "y")).alias("p")).select("p.*")


def components(edge: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component) of edges(src, dst): the smallest node reachable, by rounds of taking the smallest label around.

    Labels also jump to their own label's label, so long chains take few rounds.
    """
    e = checkpointed(edge.select("src", "dst").union(edge.select("dst", "src")).where("src <> dst").distinct())
    lab = checkpointed(e.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.min("src")).alias("component")))
    for _ in range(max_rounds):
        around = e.join(lab, e.dst == lab.node).groupBy(F.col("src").alias("n")).agg(F.min("component").alias("low"))
        step = lab.join(around, lab.node == around.n).select("node", F.col("component").alias("was"), F.least("component", "low").alias("component"))
        up = step.select(F.col("node").alias("component"), F.col("component").alias("above"))
        new = checkpointed(step.join(up, "component", "left").select("node", "was", F.coalesce(F.least("component", "above"), "component").alias("component")))
        changed = not new.where("was <> component").isEmpty()
        lab = new.select("node", "component")
        if not changed:
            return lab
    raise RuntimeError("components: no fixed point")
