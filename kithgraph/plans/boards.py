"""Task boards and timeline plans: histories, counters, blockers, lanes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HISTORY = "array<struct<id:string,at:string,event:string,text:string>>"


def recorded(history: Column, ident: Column, at: Column, event: Column, text: Column) -> Column:
    """A history with one event appended."""
    return F.array_append(F.coalesce(history, F.array().cast(HISTORY)), F.struct(ident.alias("id"), at.alias("at"), event.alias("event"), text.alias("text")))


def resolved_at(history: Column) -> Column:
    """Time of the last `resolved` event."""
    return F.get(F.reverse(F.transform(F.filter(history, lambda h: h["event"] == "resolved"), lambda h: h["at"])), F.lit(0))


def plan_lines(text: Column, longest: int = 200) -> Column:
    """Non-empty lines without bullets; (title, rest) of lines over the longest title."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda l: F.trim(F.regexp_replace(l, r"^\s*(?:[-*•]|\d+[.)])\s*", ""))), lambda l: l != "")
    return F.transform(lines, lambda l: F.struct(F.left(l, F.lit(longest)).alias("title"), F.substring(l, longest + 1, 100_000).alias("rest")))


def toggle_step(steps: Column, ident: Column, done: Column, at: Column) -> Column:
    return F.transform(steps, lambda s: F.when(s["id"] == ident, s.withField("done", done).withField("completedAt", F.when(done, at))).otherwise(s))


def complete_next(steps: Column, at: Column) -> Column:
    """The first open step done."""
    first = F.array_position(F.transform(steps, lambda s: s["done"]), False)
    return F.transform(steps, lambda s, i: F.when(i + 1 == first, s.withField("done", F.lit(True)).withField("completedAt", at)).otherwise(s))


def progress(steps: Column, history: Column, next_move: Column) -> Column:
    """struct(done, total): finished steps and moves, of these and open steps and a pending move."""
    finished = F.size(F.filter(steps, lambda s: s["done"])) + F.size(F.filter(history, lambda h: h["event"] == "move"))
    left = F.size(F.filter(steps, lambda s: ~s["done"])) + F.when(F.coalesce(next_move, F.lit("")) != "", 1).otherwise(0)
    return F.struct(finished.alias("done"), (finished + left).alias("total"))


def trail(moves: Column, steps: Column, next_move: Column) -> Column:
    """Past moves, then steps, the pending move before the first open step."""
    first = F.array_position(F.transform(steps, lambda s: s["done"]), False)
    names = F.transform(steps, lambda s: s["text"])
    cut = F.when(first > 0, first - 1).otherwise(F.size(steps)).cast("int")
    pending = F.when(F.coalesce(next_move, F.lit("")) != "", F.array(next_move)).otherwise(F.array().cast("array<string>"))
    return F.concat(moves, F.slice(names, F.lit(1), cut), pending, F.slice(names, cut + 1, F.size(steps)))


def needs_my_move(resolved: Column, mine: Column, review: Column, today: Column) -> Column:
    return ~resolved & (mine | F.coalesce(review <= today, F.lit(False)))


def blockers(items: DataFrame) -> DataFrame:
    """(id, blocker): unresolved direct dependencies; `items` has id, resolved, depends_on."""
    need = items.select("id", F.explode("depends_on").alias("blocker"))
    return need.join(items.where(~F.col("resolved")).select(F.col("id").alias("blocker")), "blocker", "left_semi").select("id", "blocker")


def connect(items: DataFrame, source: str, target: str) -> str | None:
    """Why `target` can't be made to depend on `source`, or None: self, missing, already there, cycle."""
    from kithgraph.operators.graph import levels

    if source == target:
        return "self"
    rows = {r["id"]: set(r["depends_on"] or []) for r in items.where(F.col("id").isin(source, target)).select("id", "depends_on").collect()}  # two rows at most
    if len(rows) < 2:
        return "missing"
    if source in rows[target]:
        return "duplicate"
    links = items.select(F.col("id").alias("task"), F.explode_outer("depends_on").alias("needs")).where("needs IS NOT NULL")
    more = links.unionByName(items.sparkSession.createDataFrame([(target, source)], "task string, needs string"))
    cyclic = not levels(items.select(F.col("id").alias("node")), more).where("level IS NULL").isEmpty()
    return "cycle" if cyclic else None


def clean_dependencies(items: DataFrame) -> DataFrame:
    """Dependencies on ids that are gone removed, and none twice."""
    live = items.select("id").distinct()
    kept = items.select("id", F.posexplode("depends_on").alias("pos", "need")).join(live.withColumnRenamed("id", "need"), "need", "left_semi")
    back = kept.groupBy("id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "need"))), lambda x: x["need"])).alias("depends_on"))
    return items.drop("depends_on").join(back, "id", "left").withColumn("depends_on", F.coalesce("depends_on", F.array().cast("array<string>")))


def restore_dependencies(after: Column, before: Column, restored: Column) -> Column:
    return F.array_union(after, F.array_intersect(before, restored))


def move_item(items: DataFrame, ident: str, destination: str, before: str | None) -> DataFrame:
    """`items` (id, list, pos) with one item moved before another of the destination list, or to its end."""
    moved = F.col("id") == ident
    target = items.where((F.col("list") == destination) & (F.col("id") == before)).select(F.min("pos").alias("_at"))
    j = items.crossJoin(F.broadcast(target)).withColumn("list", F.when(moved, destination).otherwise(F.col("list")))
    key = F.when(moved, F.coalesce(F.col("_at") - 0.5, F.lit(1e18))).otherwise(F.col("pos").cast("double"))
    return j.withColumn("pos", F.row_number().over(W.partitionBy("list").orderBy(key, "id")) - 1).drop("_at")


def lanes(threads: DataFrame, gap: float) -> DataFrame:
    """`threads` (unit, thread, position, height) with `top`: the running offset of each lane in its unit."""
    before = W.partitionBy("unit").orderBy("position").rowsBetween(W.unboundedPreceding, -1)
    return threads.withColumn("top", F.coalesce(F.sum(F.col("height") + gap).over(before), F.lit(0.0)))


def boxes_in(boxes: DataFrame, areas: DataFrame) -> DataFrame:
    """(id, area): the first area (by position) that holds each box's centre; a range join on the rectangle."""
    inside = (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1"))
    hit = boxes.join(areas, inside).groupBy("id").agg(F.min(F.struct("position", "area")).alias("a"))
    return hit.select("id", "a.area")


def overlapping(boxes: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    return boxes.where((F.col("x") < x1) & (F.col("x") + F.col("w") > x0) & (F.col("y") < y1) & (F.col("y") + F.col("h") > y0))


def bounds(boxes: DataFrame) -> DataFrame:
    return boxes.agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(F.col("x") + F.col("w")).alias("x1"), F.max(F.col("y") + F.col("h")).alias("y1"))


def tag_match(node_tags: Column, wanted: dict[str, list[str]]) -> Column:
    """Any wanted tag within each group, all groups."""
    out = F.lit(True)
    for tags in wanted.values():
        out = out & F.arrays_overlap(node_tags, F.array(*[F.lit(t) for t in tags]))
    return out


def board_errors(items: DataFrame) -> DataFrame:
    """(error, id): repeated ids and dependencies on nothing."""
    twice = items.groupBy("id").count().where("count > 1").select(F.lit("duplicate id").alias("error"), "id")
    gone = items.select("id", F.explode("depends_on").alias("need")).join(items.select(F.col("id").alias("need")), "need", "left_anti")
    return twice.unionByName(gone.select(F.lit("missing target").alias("error"), "id").distinct())
