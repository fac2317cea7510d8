"""Filling fixed-capacity containers with items, by minimum bin slack over the multiset of lengths.

What a container holds depends on lengths only, and there are at most `capacity` of them: the histogram of lengths
is all the planner sees, whatever the number of items. It takes the largest remaining length, and a bitset
subset-sum over the remaining lengths (with their counts, by binary splitting) finds the multiset that fills the
rest closest to the capacity; backtracking yields its counts. The found pattern is applied as often as the counts
allow, which uses up at least one length, so a plan has at most `capacity` distinct patterns and is small enough to
ship. Items are then ranked within their length (per hash bucket, so that a length of very many items is spread) and
looked up in the plan.

Defined results: null texts are no items; texts of 0 tokens go to container 0; equal texts are items of their own;
an item above the capacity is cut into full containers and a rest, which is packed like any item; a capacity below 1
is refused; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from kithgraph.llm.tokens import RANKS, count_tokens
from kithgraph.session import written

ITEMS_PER_BUCKET = 100_000


def fill(room: int, lengths: list[int], counts: list[int]) -> dict[int, int]:
    """The multiset of lengths (count by length) whose sum is closest below or at `room`; larger lengths first."""
    reached, stages = 1, []
    top = 1 << room
    keep = (top << 1) - 1
    for length, n in zip(lengths, counts):
        if length > room or n <= 0:
            continue
        n, part = min(n, room // length), 1
        while n > 0:
            take = min(part, n)
            stages.append((length, take, reached))
            reached |= (reached << (length * take)) & keep
            n -= take
            part *= 2
            if reached & top:
                break
        if reached & top:
            break
    at, out = reached.bit_length() - 1, {}
    for length, take, before in reversed(stages):
        if not (before >> at) & 1:
            at -= length * take
            out[length] = out.get(length, 0) + take
    return out


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """[(pattern as count by length, containers filled so)] for lengths from 1 to the capacity."""
    left = {k: n for k, n in histogram.items() if 0 < k <= capacity and n > 0}
    out = []
    while left:
        order = sorted(left, reverse=True)
        first = order[0]
        left[first] -= 1
        pattern = fill(capacity - first, order, [left[k] for k in order])
        left[first] += 1
        pattern[first] = pattern.get(first, 0) + 1
        times = min(left[k] // c for k, c in pattern.items())
        for k, c in pattern.items():
            left[k] -= times * c
            if not left[k]:
                del left[k]
        out.append((pattern, times))
    return out


def _segments(patterns: list[tuple[dict[int, int], int]], first_bin: int) -> tuple[dict[int, np.ndarray], int]:
    """By length, rows (first rank, first container, items a container); and the number of the next container."""
    rows: dict[int, list] = {}
    used: dict[int, int] = {}
    at = first_bin
    for pattern, times in patterns:
        for length, c in pattern.items():
            rows.setdefault(length, []).append((used.get(length, 0), at, c))
            used[length] = used.get(length, 0) + c * times
        at += times
    return {k: np.array(v, dtype=np.int64) for k, v in rows.items()}, at


def ranked(items: DataFrame, by: list[str], order: list[str], total: int) -> DataFrame:
    """`items` with `rank`, 0, 1, ... within the columns `by`: counted per hash bucket, so no group is sorted whole."""
    buckets = max(1, -(-total // ITEMS_PER_BUCKET))
    bucketed = items.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    before = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = bucketed.groupBy(*by, "_bucket").count().withColumn("_start", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    inside = F.row_number().over(W.partitionBy(*by, "_bucket").orderBy(*order)) - 1
    return bucketed.withColumn("_inside", inside).join(starts, [*by, "_bucket"]).withColumn("rank", F.col("_start") + F.col("_inside")).drop("_bucket", "_start", "_inside")


def pack(documents: DataFrame, limits: DataFrame, tokenizer: str = RANKS) -> DataFrame:
    """(run_name, doc_id, piece_no, tokens, container): every text, or piece of a text above the capacity, once."""
    sized = written(documents.where(F.col("text").isNotNull()).select("doc_id", count_tokens(F.col("text"), tokenizer).alias("size")), "sizes")
    total = sized.count()
    runs = [(r["run_name"], int(r["capacity_tokens"])) for r in limits.orderBy("run_name").collect()]  # one row a run: fixed
    if any(c < 1 for _, c in runs):
        raise ValueError("a capacity must be 1 token or more")
    histogram: dict[str, dict[int, int]] = {}
    full_of: dict[str, int] = {}
    capacity = F.create_map(*[F.lit(x) for run, c in runs for x in (run, c)]) if runs else None
    out = None
    if not runs:
        return sized.select(F.lit("").alias("run_name"), "doc_id", F.lit(0).alias("piece_no"), F.col("size").alias("tokens"), F.lit(0).cast("long").alias("container")).limit(0)
    items = sized.select(F.explode(F.array(*[F.lit(r) for r, _ in runs])).alias("run_name"), "doc_id", "size").withColumn("cap", F.element_at(capacity, F.col("run_name")).cast("long"))
    whole = items.select("run_name", "doc_id", F.expr("int(size div cap)").alias("full"), (F.col("size") % F.col("cap")).alias("rest"), "size", "cap")
    rest = whole.where((F.col("rest") > 0) | (F.col("size") == 0)).select("run_name", "doc_id", F.col("full").alias("piece_no"), F.col("rest").alias("tokens"))
    counts = rest.groupBy("run_name", "tokens").count().collect()  # at most `capacity` lengths a run
    cuts = whole.where("full > 0").groupBy("run_name").agg(F.sum("full").alias("n")).collect()
    full_of = {r["run_name"]: int(r["n"]) for r in cuts}
    for r in counts:
        histogram.setdefault(r["run_name"], {})[int(r["tokens"])] = int(r["count"])
    plans = {run: _segments(plan(histogram.get(run, {}), c), 1 + full_of.get(run, 0))[0] for run, c in runs}

    @F.pandas_udf(T.LongType())
    def container(run: pd.Series, tokens: pd.Series, rank: pd.Series) -> pd.Series:
        to = np.zeros(len(run), dtype=np.int64)
        frame = pd.DataFrame({"run": run, "tokens": tokens})
        for (name, length), at in frame.groupby(["run", "tokens"], sort=False).indices.items():
            if length > 0:
                seg = plans[name][int(length)]
                k = np.searchsorted(seg[:, 0], rank.to_numpy()[at], side="right") - 1
                to[at] = seg[k, 1] + (rank.to_numpy()[at] - seg[k, 0]) // seg[k, 2]
        return pd.Series(to)

    placed = ranked(rest, ["run_name", "tokens"], ["doc_id"], total).select("run_name", "doc_id", "piece_no", "tokens", container("run_name", "tokens", "rank").alias("container"))
    pieces = whole.where("full > 0").select("run_name", "doc_id", F.col("cap").alias("tokens"), F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("piece_no"))
    cut = ranked(pieces, ["run_name"], ["doc_id", "piece_no"], max(1, sum(full_of.values()))).select("run_name", "doc_id", "piece_no", "tokens", (F.col("rank") + 1).cast("long").alias("container"))
    return placed.unionByName(cut)


def report(packed: DataFrame, limits: DataFrame) -> DataFrame:
    """(run_name, capacity_tokens, containers, items, tokens, fill): how full the containers of each run are."""
    bins = packed.where("tokens > 0").groupBy("run_name", "container").agg(F.sum("tokens").alias("held"), F.count("*").alias("items"))
    runs = bins.groupBy("run_name").agg(F.count("*").alias("containers"), F.sum("items").alias("items"), F.sum("held").alias("tokens"), F.max("held").alias("fullest"))
    return runs.join(limits.select("run_name", "capacity_tokens"), "run_name").select("run_name", "capacity_tokens", "containers", "items", "tokens", "fullest", (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("fill"))
