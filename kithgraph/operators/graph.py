"""Graph operators as joins: adjacency, reach, brokerage, cheapest paths, components, dependency graphs.

Every iteration cuts its lineage by a table in the shared folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithgraph.session import written


def adjacency(edges: DataFrame, *carry: str) -> DataFrame:
    """Both directions of every edge: (workspace_id, a, b, ...)."""
    one = edges.select("workspace_id", F.col("src").alias("a"), F.col("dst").alias("b"), *carry)
    return one.unionByName(edges.select("workspace_id", F.col("dst").alias("a"), F.col("src").alias("b"), *carry))


def degrees(edges: DataFrame) -> DataFrame:
    """Incident edges (parallel types count each) and the sum of their strength."""
    return adjacency(edges, "strength").groupBy("workspace_id", F.col("a").alias("node")).agg(F.count("*").alias("degree"), F.sum("strength").alias("weighted_degree"))


def reach_sets(pairs: DataFrame, hops: int) -> DataFrame:
    """(workspace_id, start, node, hops): the nodes first reached within `hops` steps, the start itself at 0."""
    step = pairs.select("workspace_id", "a", "b").distinct()
    starts = step.select("workspace_id", F.col("a").alias("start"), F.col("a").alias("node")).distinct().withColumn("hops", F.lit(0))
    reached = starts
    for h in range(1, hops + 1):
        out = reached.where(F.col("hops") == h - 1).join(step.withColumnRenamed("a", "node"), ["workspace_id", "node"]).select("workspace_id", "start", F.col("b").alias("node")).distinct()
        reached = reached.unionByName(out.join(reached, ["workspace_id", "start", "node"], "left_anti").withColumn("hops", F.lit(h)))
        reached = written(reached, "reach") if h < hops else reached
    return reached


def reach_counts(edges: DataFrame, hops: int = 3) -> DataFrame:
    """(workspace_id, node, reach): other nodes within `hops` steps."""
    return reach_sets(adjacency(edges), hops).where("hops > 0").groupBy("workspace_id", F.col("start").alias("node")).agg(F.count("*").alias("reach"))


def brokerage(edges: DataFrame) -> DataFrame:
    """(workspace_id, node, reach, brokerage): the share of the 3-hop reach lost without the node.

    For each (node, neighbour): the neighbour's 2-hop reach on paths that avoid the node, joined per pair.
    """
    step = written(adjacency(edges).select("workspace_id", "a", "b").distinct(), "steps")
    pair = step.select("workspace_id", F.col("a").alias("me"), F.col("b").alias("n"))
    second = pair.join(step.select("workspace_id", F.col("a").alias("n"), F.col("b").alias("x")), ["workspace_id", "n"]).where("x <> me").select("workspace_id", "me", "n", "x").distinct()
    third = second.join(step.select("workspace_id", F.col("a").alias("x"), F.col("b").alias("y")), ["workspace_id", "x"]).where("y <> me").select("workspace_id", "me", "n", F.col("y").alias("x"))
    near = second.select("workspace_id", "me", "n", "x").unionByName(third).where("x <> n").distinct().groupBy("workspace_id", "me", "n").agg(F.count("*").alias("k"))
    best = near.groupBy("workspace_id", F.col("me").alias("node")).agg(F.max("k").alias("without"))
    reach = reach_counts(edges, 3)
    share = F.greatest(F.lit(0.0), (F.col("reach") - F.coalesce("without", F.lit(0))) / F.col("reach"))
    return reach.join(best, ["workspace_id", "node"], "left").select("workspace_id", "node", "reach", share.alias("brokerage"))


def cheapest_steps(edges: DataFrame, min_strength: float = 0.0, exclude: tuple[str, ...] = ()) -> DataFrame:
    """(workspace_id, a, b, cost, edge): the cheapest usable edge of every ordered pair."""
    kept = edges.where(F.col("strength") >= min_strength)
    if exclude:
        kept = kept.where(~F.col("relationship_type").isin(*exclude))
    both = adjacency(kept.withColumn("cost", -F.log("probability")), "cost", "relationship_type")
    return both.groupBy("workspace_id", "a", "b").agg(F.min(F.struct("cost", "relationship_type")).alias("m")).select("workspace_id", "a", "b", "m.cost", "m.relationship_type")


def shortest_paths(edges: DataFrame, starts: DataFrame, max_hops: int = 4, min_strength: float = 0.0, exclude: tuple[str, ...] = (), avoid: DataFrame | None = None) -> DataFrame:
    """(workspace_id, start, node, cost, hops, prev, path): one label per node as a hop-capped settle-in-order search leaves it.

    A fixpoint of relaxation from scratch: each round recomputes every label from the whole previous table, as labels
    may get worse when their parent loses the right to expand. The k cheapest labels of a start are final after k
    rounds, as a label depends on cheaper ones only, so the rounds end. `starts` has workspace_id and start.
    """
    step = written(cheapest_steps(edges, min_strength, exclude), "costs")
    if avoid is not None:
        step = step.join(avoid.select("workspace_id", F.col("node").alias("b")), ["workspace_id", "b"], "left_anti")
    pinned = starts.select("workspace_id", "start", F.col("start").alias("node"), F.lit(0.0).alias("cost"), F.lit(0).alias("hops"), F.lit(None).cast("string").alias("prev"), F.array("start").alias("path"))
    labels = written(pinned, "labels")
    while True:
        out = labels.where(F.col("hops") < max_hops).join(step.withColumnRenamed("a", "node").withColumnRenamed("cost", "step_cost"), ["workspace_id", "node"]).where("b <> start")
        offer = out.select("workspace_id", "start", F.col("b").alias("node"), F.struct((F.col("cost") + F.col("step_cost")).alias("cost"), (F.col("hops") + 1).alias("hops"), F.col("node").alias("prev"), F.array_append("path", F.col("b")).alias("path")).alias("m"))
        new = pinned.unionByName(offer.groupBy("workspace_id", "start", "node").agg(F.min("m").alias("m")).select("workspace_id", "start", "node", "m.*"))
        new = written(new, "labels")
        same = new.join(labels.select("workspace_id", "start", "node", F.col("cost").alias("c0"), F.col("hops").alias("h0"), F.col("prev").alias("p0")), ["workspace_id", "start", "node"], "full")
        settled = same.where(~(F.col("cost").eqNullSafe(F.col("c0")) & F.col("hops").eqNullSafe(F.col("h0")) & F.col("prev").eqNullSafe(F.col("p0")))).isEmpty()
        labels = new
        if settled:
            return labels


def bounded_paths(edges: DataFrame, starts: DataFrame, max_hops: int = 3, min_strength: float = 0.0, exclude: tuple[str, ...] = ()) -> DataFrame:
    """(workspace_id, start, node, cost, hops): the cheapest path of at most `max_hops` steps (Bellman-Ford by rounds)."""
    step = written(cheapest_steps(edges, min_strength, exclude), "costs").withColumnRenamed("a", "node").withColumnRenamed("cost", "step_cost")
    best = starts.select("workspace_id", "start", F.col("start").alias("node"), F.lit(0.0).alias("cost"), F.lit(0).alias("hops"))
    for _ in range(max_hops):
        offer = best.join(step, ["workspace_id", "node"]).select("workspace_id", "start", F.col("b").alias("node"), (F.col("cost") + F.col("step_cost")).alias("cost"), (F.col("hops") + 1).alias("hops"))
        best = written(best.unionByName(offer).groupBy("workspace_id", "start", "node").agg(F.min(F.struct("cost", "hops")).alias("m")).select("workspace_id", "start", "node", "m.cost", "m.hops"), "best")
    return best.where("hops > 0")


def connectors(paths: DataFrame) -> DataFrame:
    """(workspace_id, start, connector, unlocks, score, targets): first hops of paths of two steps or more."""
    far = paths.where("hops >= 2").withColumn("connector", F.get("path", F.lit(1)))
    return far.groupBy("workspace_id", "start", "connector").agg(F.count("*").alias("unlocks"), F.sum(F.exp(-F.col("cost"))).alias("score"), F.array_sort(F.collect_list("node")).alias("targets"))


def alternatives(edges: DataFrame, pair: DataFrame, k: int = 3, max_hops: int = 4) -> DataFrame:
    """(workspace_id, start, node, ban, cost, hops, path): the best path, and one more for each of its intermediaries banned.

    `pair` has workspace_id, start, target. All bans run at once: a banned variant is a workspace of its own.
    """
    base = shortest_paths(edges, pair.select("workspace_id", "start").distinct(), max_hops).join(pair.withColumnRenamed("target", "node"), ["workspace_id", "start", "node"])
    base = written(base, "base")
    inner = base.select("workspace_id", "start", "node", F.explode(F.slice("path", F.lit(2), F.greatest(F.size("path") - 2, F.lit(0)))).alias("ban"))
    variant = F.concat_ws("#", "workspace_id", "start", "node", "ban")
    bans = written(inner.select("*", variant.alias("v")), "bans")
    copied = edges.join(bans.select("workspace_id", "v", "ban"), "workspace_id").where("src <> ban AND dst <> ban").drop("workspace_id", "ban").withColumnRenamed("v", "workspace_id")
    found = shortest_paths(copied, bans.select(F.col("v").alias("workspace_id"), "start"), max_hops).withColumnRenamed("workspace_id", "v")
    more = found.join(bans.withColumnRenamed("node", "target").drop("start"), "v").where("node = target").select("workspace_id", "start", "node", "ban", "cost", "hops", "path")
    every = base.select("workspace_id", "start", "node", F.lit(None).cast("string").alias("ban"), "cost", "hops", "path").unionByName(more)
    once = every.groupBy("workspace_id", "start", "node", "path").agg(F.min("cost").alias("cost"), F.min("hops").alias("hops"), F.min("ban").alias("ban"))
    ranked = once.groupBy("workspace_id", "start", "node").agg(F.slice(F.array_sort(F.collect_list(F.struct("cost", "hops", "path", "ban"))), 1, k).alias("best"))
    return ranked.select("workspace_id", "start", "node", F.inline("best"))


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component): smallest node reachable by links (a, b) taken both ways; label propagation with shortcuts until
    no label changes."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = written(both, "links")
    label = written(nodes.select("node", F.col("node").alias("component")), "component")
    while True:
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("low"))
        new = label.join(near, "node", "left").select("node", F.least("component", F.coalesce("low", "component")).alias("component"))
        jump = new.select(F.col("node").alias("component"), F.col("component").alias("lower"))
        new = written(new.join(jump, "component", "left").select("node", F.coalesce("lower", "component").alias("component")), "component")
        done = new.join(label.withColumnRenamed("component", "old"), "node").where("component <> old").isEmpty()
        label = new
        if done:
            return label


def downstream(links: DataFrame, open_nodes: DataFrame) -> DataFrame:
    """(source, node): everything that waits for a node through open nodes. `links` (task, needs).

    Ends when a round reaches nothing new, after as many rounds as the longest shortest chain.
    """
    step = links.join(open_nodes.select(F.col("node").alias("task")), "task", "left_semi").select(F.col("needs").alias("source"), F.col("task").alias("node")).distinct()
    step = written(step, "waits")
    found, frontier = step, step
    while True:
        out = frontier.join(step.select(F.col("source").alias("node"), F.col("node").alias("next")), "node").select("source", F.col("next").alias("node")).distinct()
        frontier = written(out.join(found, ["source", "node"], "left_anti"), "frontier")
        if frontier.isEmpty():
            break
        found = written(found.unionByName(frontier), "found")
    return found.where("source <> node")


def levels(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, level): longest chain of needs below each node; level null for nodes in or behind a cycle (peeling).

    Ends when nothing is left to peel, after as many rounds as the longest chain has nodes.
    """
    needs = written(links.select("task", "needs").distinct().join(nodes.select(F.col("node").alias("needs")), "needs", "left_semi"), "needs")
    left = written(nodes.select("node").distinct(), "left")
    done = None
    for level in count():
        blocked = needs.join(left.select(F.col("node").alias("needs")), "needs", "left_semi").select(F.col("task").alias("node")).distinct()
        peel = written(left.join(blocked, "node", "left_anti").withColumn("level", F.lit(level)), "peel")
        if peel.isEmpty():
            break
        done = peel if done is None else done.unionByName(peel)
        if level % 64 == 63:  # keeps the plan of a long chain short
            done = written(done, "done")
        left = written(left.join(peel, "node", "left_anti"), "left")
    rest = left.withColumn("level", F.lit(None).cast("int"))
    return rest if done is None else done.unionByName(rest)


def dependency_errors(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(error, node): repeated nodes, missing targets, and nodes in or behind a cycle."""
    twice = nodes.groupBy("node").count().where("count > 1").select(F.lit("duplicate").alias("error"), "node")
    missing = links.join(nodes.select(F.col("node").alias("needs")), "needs", "left_anti").select(F.lit("missing target").alias("error"), F.col("needs").alias("node")).distinct()
    cycle = levels(nodes, links).where("level IS NULL").select(F.lit("cycle").alias("error"), "node")
    return twice.unionByName(missing).unionByName(cycle)
