"""Deduplicating new batches against all history, by a table of pivot distances.

The metric is the L1 distance between bags of spoken words: what is left of a transcript without labels, stamps,
sound notes, hesitation, case and layout. The fixed pivots are 1,024 sets of texts, pivot j holding the texts
without any word of hash class j; a text's distance to pivot j is the count of its words in that class. Such
distances are 1-Lipschitz, and as the classes are disjoint their differences add up: for disjoint groups of pivots,
the sum over groups of |d(x, P) - d(y, P)| is at most d(x, y). Two texts within r words therefore agree in *all* pivot
distances of at least one of r + 1 groups. That turns the triangle inequality into an equi-join on a hash of a
group's distances, inside ranges of the length (the distance to the empty text): the join is partitioned by range of
length, group and distances, never by workspace alone, so a large workspace is spread. Sums over 16 coarser pivots
carried in the rows prune again, and the true distance is verified on the bags of the few pairs left.

A batch computes its own pivot rows and appends them and their keys to the stored tables (`History`) before anything is
compared: rows are bucketed by arrival and keys by key, so that each is shuffled once, and everything after reads them
where they lie; nothing of the history is computed again.
Every arrival gets a root: the first arrival accepted of those it repeats, directly or through others. A family of
near copies may be very large, so rows are first tied to the earliest member of a few buckets; afterwards only rows
of *different* roots are compared, and again where a root has changed, until no root changes. A batch, or all batches
at once, therefore end with the same roots as a comparison of all with all.

Defined results: arrivals without a transcript repeat only by external id or content hash; null, blank and
placeholder ids and hashes match nothing; null workspaces match nothing; a null batch is the first; exact copies of a
bag are represented by their first arrival, so a group of copies costs one row per key, however large; a repeat of a
repeat belongs to the arrival that was accepted; source_seq grows from batch to batch.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from functools import lru_cache, reduce
from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kithgraph.llm import transcripts
from kithgraph.operators.skew import SALTS, salted_join
from kithgraph.session import append_bucketed, dropped, written

#: Largest distance of a repeat, as a share of the longer text's words (a replaced word counts twice).
RADIUS = 0.10
#: Fewest pivots; ranges of long texts take as many as they need (`pivots_of`).
PIVOTS = 1024
COARSE = 16
#: Fewest buckets of the stored tables; with more shuffle partitions there are as many.
BUCKETS = 32
#: Groups of each range by which a large family of near copies is first tied to its earliest member.
LEADS = 4
#: Lengths of one range differ by at most this factor.
RANGE = 1.25

# External ids that are none.
PLACEHOLDER_IDS = ("", "-", "--", "n/a", "na", "none", "null", "nil", "unknown", "undefined", "tbd", "0", "?", "not set", "(not set)", "missing", "test", "id")

_WORD = re.compile(r"[^\W_]+")
#: What `_WORD` leaves out of plain ASCII.
_BETWEEN = {i: " " for i in range(128) if not _WORD.match(chr(i))}


class _Heard(dict):
    """Whether a word is more than hesitation."""

    def __missing__(self, word: str) -> bool:
        if len(self) > 200_000:
            self.clear()
        self[word] = heard = transcripts.HESITATION.fullmatch(word) is None
        return heard


_heard = _Heard()


def spoken_words(body: str | None, hints: str | None) -> list[str]:
    """The words of a body's transcript, without everything an exporter adds to them."""
    transcript, names = transcripts._from_body(body, hints)
    if not transcript:
        return []
    said = "\n".join(text for _, _, text in transcripts._utterances(transcript, transcripts.Cast(names), {}))
    text = transcripts._no_notes(said).lower()
    words = text.translate(_BETWEEN).split() if text.isascii() else _WORD.findall(text)
    return list(compress(words, map(_heard.__getitem__, words)))


@lru_cache(maxsize=100_000)
def _levels(n: int) -> tuple[int, ...]:
    return tuple(levels(n))


def levels(n: int) -> list[int]:
    """The length ranges a text of n words takes part in: any two texts within the radius share one."""
    if n == 0:
        return []
    low, high = math.ceil(math.log(n, RANGE) - 1e-9), math.log(n * RANGE / (1 - RADIUS), RANGE)
    return [v for v in range(low, math.floor(high) + 1) if v < high or v == low]


def groups_of(level: int) -> int:
    """One group more than the words two texts of that range may differ by."""
    return int(RADIUS * RANGE**level) + 2


def pivots_of(level: int) -> int:
    """Hash classes of a range: never fewer than its groups, so that no group is empty and the bound always holds."""
    return max(PIVOTS, 1 << (groups_of(level) - 1).bit_length())


@lru_cache(maxsize=64)
def _weights(pivots: int) -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 2**63 - 1, size=pivots, dtype=np.int64) | 1


@lru_cache(maxsize=64)
def _cuts(level: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the groups of a range begin among its pivots, and what tells the keys of its groups apart."""
    g = groups_of(level)
    return (np.arange(g) * pivots_of(level)) // g, np.arange(g, dtype=np.int64) * np.int64(7_919) + np.int64(level * 104_729)


class _Codes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = code = zlib.crc32(word.encode())
        return code


_codes = _Codes()
_FEATURES = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("same", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("leads", T.ArrayType(T.LongType())), T.StructField("coarse", T.ArrayType(T.ShortType())), T.StructField("bag", T.BinaryType())])


def _features(words: list[str]) -> tuple:
    codes = np.fromiter(map(_codes.__getitem__, words), np.uint32, len(words))
    if not len(codes):
        return 0, None, _NONE, _NONE, _FLAT, None
    codes.sort()
    counts = np.bincount(codes & np.uint32(PIVOTS - 1), minlength=PIVOTS)
    weighted = {PIVOTS: counts * _weights(PIVOTS)}  # wraps around
    keys = []
    for level in _levels(len(codes)):
        p = pivots_of(level)
        if p not in weighted:
            weighted[p] = np.bincount(codes & np.uint32(p - 1), minlength=p) * _weights(p)
        starts, own = _cuts(level)
        keys.append(np.add.reduceat(weighted[p], starts) * np.int64(1_000_003) + own)
    bag = codes.tobytes()
    same = (zlib.crc32(bag) * 1_000_003 + int(weighted[PIVOTS].sum()) + 2**63) % 2**64 - 2**63
    coarse = np.minimum(np.add.reduceat(counts, _COARSE_STARTS), 32767)
    return len(codes), same, np.concatenate(keys), np.concatenate([k[:LEADS] for k in keys]), coarse.astype(np.int16), bag


_NONE, _FLAT, _COARSE_STARTS = np.zeros(0, dtype=np.int64), np.zeros(COARSE, dtype=np.int16), np.arange(COARSE) * (PIVOTS // COARSE)


@F.pandas_udf(_FEATURES)
def features(body: pd.Series, hints: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_features(spoken_words(b, h)) for b, h in zip(body, hints)], columns=["n", "same", "keys", "leads", "coarse", "bag"])


def _real(c: Column, least: int = 2) -> Column:
    v = F.trim(c)
    return F.when(~F.lower(v).isin(*PLACEHOLDER_IDS) & (F.length(v) >= least), v)


def pivot_table(sources: DataFrame, batch: Column | None = None) -> DataFrame:
    """One row per arrival: its workspace, real ids, length, pivot keys, coarse pivot distances and bag."""
    more = [] if batch is None else [batch.alias("batch")]
    return sources.where(F.col("workspace_id").isNotNull()).select(
        F.col("source_seq").alias("seq"), F.col("workspace_id").alias("ws"), _real(F.col("external_id")).alias("ext"), F.lower(_real(F.col("content_hash"), 32)).alias("hash"), features("body", "attendee_hints").alias("f"), *more
    ).select("seq", "ws", "ext", "hash", "f.*", *(["batch"] if more else []))


@F.pandas_udf(T.DoubleType())
def bag_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """L1 distance of two bags, as a share of the longer text."""

    def one(x: bytes, y: bytes) -> float:
        u, v = np.frombuffer(x, dtype=np.uint32), np.frombuffer(y, dtype=np.uint32)
        every = np.concatenate([u, v])
        signs = np.concatenate([np.ones(len(u), dtype=np.int64), -np.ones(len(v), dtype=np.int64)])
        order = np.argsort(every, kind="stable")
        every, signs = every[order], signs[order]
        starts = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
        return float(np.abs(np.add.reduceat(signs, starts)).sum()) / max(len(u), len(v))

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype=float)


def _spread(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join whose left side may hold any share of its rows under one key: all keys are salted, so nothing has to be
    counted first; `right` has one small row a key."""
    salted = left.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    return salted.join(right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), [key, "_salt"]).drop("_salt")


def verified(pairs: DataFrame, bags: DataFrame) -> DataFrame:
    """The candidate pairs (earlier, later, ...) within the radius; a pair's hot side is salted. `bags` has seq, n, coarse
    and bag. Lengths and coarse pivot distances are compared before any bag is."""
    pairs = written(pairs, "pairs")
    if pairs.isEmpty():
        return pairs
    side = lambda name: bags.select(F.col("seq").alias(name), F.struct("n", "coarse").alias(f"_{name}"))
    bound = F.greatest("_earlier.n", "_later.n") * RADIUS
    apart = F.aggregate(F.zip_with("_earlier.coarse", "_later.coarse", lambda x, y: F.abs(x - y).cast("int")), F.lit(0), lambda s, x: s + x)
    near = salted_join(pairs, side("earlier"), "earlier").join(side("later"), "later").where((F.abs(F.col("_earlier.n") - F.col("_later.n")) <= bound) & (apart <= bound)).select(pairs.columns)
    near = written(near, "pairs")
    # only the bags of these pairs leave the place where they are stored
    bag = lambda side, name: bags.join(near.select(F.col(side).alias("seq")).distinct(), "seq", "left_semi").select(F.col("seq").alias(side), F.col("bag").alias(name))
    with_bags = salted_join(near, bag("earlier", "x"), "earlier").join(bag("later", "y"), "later")
    return with_bags.where(bag_distance("x", "y") <= RADIUS).select(pairs.columns)


class History:
    """What has been accepted: append-only tables of pivot rows, bucketed by arrival, and of keys, bucketed by key.

    Kinds of keys: 0 exact (ids, hashes, equal bags), 1 the lead groups, 2 all groups; 0 and 1 hold the first arrival of a
    key only. A row of the index holds the arrival, its root if that is another, and for kind 2 its length. Keys of kind 2
    are stored before they are compared; the few roots that change afterwards are kept in `moved`. Lengths, coarse pivot
    distances and bags are kept once an arrival. Every append is a lot.
    """

    def __init__(self, buckets: int | None = None):
        self.name, self.buckets, self.lots = f"pivots_{uuid.uuid4().hex}", buckets, 0
        self.rows: DataFrame | None = None
        self.index: DataFrame | None = None
        self.moved: DataFrame | None = None

    def _append(self, df: DataFrame, what: str, key: str, *partitions: str) -> DataFrame:
        self.buckets = self.buckets or max(BUCKETS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        return append_bucketed(df, f"{self.name}{what}", key, self.buckets, *partitions, plain=("key", "same", "bag", "keys.list.element", "leads.list.element"))

    def store(self, rows: DataFrame, lot: Column, lots: int = 1) -> list[int]:
        """Append pivot rows, of which `lot` says to which of so many new lots they belong; the numbers of these lots."""
        self.rows = self._append(rows.select("seq", "ws", "ext", "hash", "n", "same", "keys", "leads", "coarse", "bag", (lot + self.lots).cast("int").alias("lot")), "_rows", "seq", "lot")
        self.lots += lots
        return list(range(self.lots - lots, self.lots))

    def append(self, index: DataFrame, lot: int) -> None:
        tied = F.when(F.col("root") < F.col("seq"), F.col("root"))
        self.index = self._append(index.select("key", "seq", tied.alias("root"), "n", "kind", F.lit(lot).alias("lot")), "", "key", "kind", "lot")

    def move(self, roots: DataFrame) -> None:
        """Keep the roots of arrivals whose keys were stored under another."""
        self.moved = self._append(roots.select("seq", "root"), "_moved", "seq")

    def keys(self, kind: int, lots: Column) -> DataFrame:
        """(key, seq, root, n) of a kind as it was stored."""
        return self.index.where((F.col("kind") == kind) & lots).select("key", "seq", F.coalesce("root", "seq").alias("root"), "n")

    def lookup(self, keys: DataFrame, kind: int, lot: int) -> DataFrame | None:
        """Rows of a kind stored before a lot that have one of the keys, with the roots they ended with."""
        if self.index is None or not lot:
            return None
        found = self.keys(kind, F.col("lot") < lot).join(keys.select("key"), "key", "left_semi")
        if kind < 2 or self.moved is None:
            return found
        return found.join(self.moved.select("seq", F.col("root").alias("now")), "seq", "left").select("key", "seq", F.coalesce("now", "root").alias("root"), "n")


def _roots(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """(seq, root): the least root an arrival reaches over edges (later, earlier, root of a stored earlier one or null)."""
    stored = edges.where("root IS NOT NULL").groupBy(F.col("later").alias("seq")).agg(F.min("root").alias("low"))
    label = written(rows.select("seq").distinct().join(stored, "seq", "left").select("seq", F.least("seq", F.coalesce("low", "seq")).alias("root")), "roots")
    inner = edges.where("root IS NULL").select("later", "earlier")
    if inner.isEmpty():
        return label
    links = inner = written(inner.distinct(), "links")
    while True:  # along the links and along the roots of their ends, so a chain halves each round
        ends = inner.select(F.col("earlier").alias("seq")).distinct().join(label, "seq")
        higher = ends.join(label.select(F.col("seq").alias("root"), F.col("root").alias("higher")), "root", "left")
        low = _spread(inner, higher.select(F.col("seq").alias("earlier"), F.coalesce("higher", "root").alias("low")), "earlier")
        low = low.groupBy(F.col("later").alias("seq")).agg(F.min("low").alias("low"))
        new = written(label.join(low, "seq", "left").select("seq", F.least("root", F.coalesce("low", "root")).alias("root"), (F.col("low") < F.col("root")).alias("fell")), "roots")
        over = new.where("fell").isEmpty()
        dropped(label, links) if over else dropped(label)
        label = new
        if over:
            return label


def _firsts(keyed: DataFrame, stored: DataFrame | None, *carry: Column) -> DataFrame:
    """(key, last, earlier, root, is_new, ...): the first arrival of every key, its root if it is a stored one, and the last new one."""
    first = keyed.groupBy("key").agg(F.min("seq").alias("f"), F.max("seq").alias("last"), *carry)
    if stored is None:
        return first.select("*", F.col("f").alias("earlier"), F.lit(None).cast("long").alias("root"), F.lit(True).alias("is_new")).drop("f")
    known = stored.groupBy("key").agg(F.min(F.struct("seq", "root")).alias("s"))
    return first.join(known, "key", "left").select("*", F.coalesce("s.seq", "f").alias("earlier"), F.col("s.root").alias("root"), F.col("s").isNull().alias("is_new")).drop("f", "s")


def _candidates(rows: DataFrame) -> DataFrame:
    """(earlier, later, root): pairs that share a key, may be within the radius, and whose earlier one has a lesser root.

    `rows` holds (key, seq, root, n, is_new, early); new ones may be later, `early` ones earlier. The roots that meet
    under a key are found first by a partial aggregation over every row once; keys of one root only, as most keys and
    those of a family of near copies are, take no part in the join, whose both sides are picked from one stored table.
    """
    met = rows.groupBy("key").agg(F.min(F.when(F.col("early"), F.col("root"))).alias("low"), F.max(F.when(F.col("is_new"), F.col("root"))).alias("high"))
    shared = written(met.where("low < high"), "shared")
    shared = written(rows.join(shared, "key").where("is_new AND root > low OR early AND root < high"), "shared")
    later = shared.where("is_new AND root > low").select("key", F.col("seq").alias("later"), F.col("root").alias("root_b"), F.col("n").alias("n_b"))
    earlier = shared.where("early AND root < high").select("key", "seq", "root", "n", "is_new")
    bound = F.greatest("n", "n_b") * RADIUS
    pairs = earlier.join(later, "key").where((F.col("seq") < F.col("later")) & (F.col("root") < F.col("root_b")) & (F.abs(F.col("n") - F.col("n_b")) <= bound))
    return pairs.select(F.col("seq").alias("earlier"), "later", F.when(~F.col("is_new"), F.col("root")).alias("root")).distinct()


def accept(history: History, lot: int) -> DataFrame:
    """(accepted_seq, duplicate_seq) of a stored lot against all lots before; its keys are added to the index."""
    rows = history.rows.where(F.col("lot") == lot)
    key = lambda kind, c: F.when(c.isNotNull(), F.struct(F.xxhash64(F.lit(kind), "ws", c).alias("key"), F.lit(kind == "same").alias("bag")))
    own = F.array_compact(F.array(key("ext", F.col("ext")), key("hash", F.when(F.col("same").isNull(), F.col("hash"))), key("same", F.col("same"))))
    exact = written(rows.select("seq", F.explode(own).alias("k")).select("seq", "k.*"), "exact")
    firsts = written(_firsts(exact, history.lookup(exact, 0, lot), F.max("bag").alias("bag")), "firsts")
    met = lambda firsts: firsts.where("earlier < last").select("key", "earlier", "root")
    edges = _spread(exact.select(F.col("seq").alias("later"), "key"), met(firsts), "key").where("earlier < later").select("earlier", "later", "root")

    # one row of each bag that is not stored; its near copies are looked for
    kept = rows.join(firsts.where("bag AND is_new").select(F.col("earlier").alias("seq")), "seq", "left_semi")
    bags = history.rows.where(F.col("lot") <= lot).select("seq", "n", "coarse", "bag")
    lead = written(kept.select("seq", F.explode("leads").alias("lead"), "ws").select("seq", F.xxhash64("ws", "lead").alias("key")), "lead")
    leads = written(_firsts(lead, history.lookup(lead, 1, lot)), "leads")
    tied = _spread(lead.withColumnRenamed("seq", "later"), met(leads), "key").where("earlier < later").select("earlier", "later", "root").distinct()
    edges = written(edges.unionByName(verified(tied, bags)), "edges")
    dropped(exact, lead)
    roots = _roots(rows, edges)

    # the group keys of the new bags, stored with their present roots, which are joined before the keys are spread out
    spread = lambda kept: kept.select("seq", "n", "ws", F.explode("keys").alias("k")).select(F.xxhash64("ws", "k").alias("key"), "seq", "n")
    rooted = kept.select("seq", "ws", "n", "keys").join(roots.select("seq", "root"), "seq").select("seq", "root", "n", "ws", F.explode("keys").alias("k"))
    history.append(rooted.select(F.xxhash64("ws", "k").alias("key"), "seq", "root", "n", F.lit(2).alias("kind")), lot)
    mine = history.keys(2, F.col("lot") == lot)
    stored = history.lookup(mine, 2, lot)
    stored = None if stored is None else written(stored.withColumn("is_new", F.lit(False)).withColumn("early", F.lit(True)), "stored")
    first_roots, changed = roots, None
    while True:
        if changed is None:  # keys that one root has alone stay where they are
            shared = mine.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
            shared = shared if stored is None else shared.unionByName(stored.select("key")).distinct()
            near = mine.join(shared, "key", "left_semi").withColumn("is_new", F.lit(True)).withColumn("early", F.lit(True))
            near = near if stored is None else near.unionByName(stored)
        else:  # only what shares a key with a row whose root has changed
            touched = spread(kept.join(changed, "seq", "left_semi")).select("key").distinct()
            near = mine.join(touched, "key", "left_semi").drop("root").join(roots.select("seq", "root"), "seq").withColumn("is_new", F.lit(True))
            near = near.join(changed.withColumn("early", F.lit(True)), "seq", "left").withColumn("early", F.coalesce("early", F.lit(False)))
        near = written(near, "met")
        pairs = _candidates(near)
        more = written(verified(pairs, bags), "near")
        dropped(near)
        if more.isEmpty():
            break
        edges, before = edges.unionByName(more), roots
        roots = _roots(rows, edges)
        changed = written(roots.select("seq", "root").join(before.select("seq", F.col("root").alias("old")), "seq").where("root < old").select("seq"), "changed")
    if changed is not None:
        history.move(roots.select("seq", "root").join(first_roots.select("seq", F.col("root").alias("old")), "seq").where("root < old"))
    ends = lambda d: d.where("is_new").drop("root").withColumnRenamed("earlier", "seq").join(roots.select("seq", "root"), "seq").select("key", "seq", "root", F.lit(None).cast("int").alias("n"))
    history.append(ends(firsts).withColumn("kind", F.lit(0)).unionByName(ends(leads).withColumn("kind", F.lit(1))), lot)
    dropped(firsts, leads, *([] if stored is None else [stored]))
    return roots.where("root < seq").select(F.col("root").alias("accepted_seq"), F.col("seq").alias("duplicate_seq"))


def first_arrivals(table: DataFrame) -> DataFrame:
    """(accepted_seq, duplicate_seq) over a pivot table, all its rows taken as one batch."""
    history = History()
    return accept(history, *history.store(table, F.lit(0)))


def append_batch(history: History, batch: DataFrame) -> DataFrame:
    """(accepted_seq, duplicate_seq) of a new batch of sources; only its texts are read, and it is added to the history."""
    return accept(history, *history.store(pivot_table(batch), F.lit(0)))


def repeats(sources: DataFrame, history: History | None = None, one_by_one: bool = False) -> DataFrame:
    """(accepted_seq, duplicate_seq) of every arrival that repeats an earlier one of its workspace.

    The pivot rows of every arrival are computed once and stored by lot. Batch 0 is the accepted history; what has
    arrived since meets it through the index, all new batches together, or each on its own (`one_by_one`). Both give the
    same pairs; a batch costs some twenty jobs, however small it is.
    """
    history = history or History()
    batch = F.coalesce("batch_id", F.lit(0)).cast("int") if "batch_id" in sources.columns else F.lit(0)
    numbers = sorted(r["batch"] for r in sources.where("workspace_id IS NOT NULL").select(batch.alias("batch")).distinct().collect())  # one row a batch
    lots = [[b] for b in numbers] if one_by_one else [lot for lot in ([b for b in numbers if b <= 0], [b for b in numbers if b > 0]) if lot]
    if not lots:
        return sources.sparkSession.createDataFrame([], "accepted_seq long, duplicate_seq long")
    starts = [lot[0] for lot in lots[1:]]
    number = sum(((F.col("batch") >= b).cast("int") for b in starts), F.lit(0))
    found = [accept(history, lot) for lot in history.store(pivot_table(sources, batch), number, len(lots))]
    return reduce(DataFrame.unionByName, found)
