"""Mixing sources to target weights, with soft membership of texts whose source is not known.

A multinomial classifier over hashed words is learned from all texts with a known source; it gives every other text
posterior probabilities of the sources. Projected-gradient least squares then fits a nonnegative rate for each text
so that the expected token totals of the sources match the targets, with rates at most the repeats allowed. The
state of the descent is one residual per source and step, so a step is a single aggregation over the sized texts and
nothing is collected but one row per source. Rates become whole copies by a threshold on a hash of the id, placed per
source by a histogram, so that the totals are met to within one cell of it.

Defined results: null and empty texts have no tokens and are not used; sources without a target are not used; a text
without a source may be repeated as often as its likely sources (posterior 0.1 or more) all allow; if a source can't
reach its share even with all repeats, the total is lowered until it can; equal texts are texts of their own.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from kithgraph.llm.tokens import RANKS, count_tokens
from kithgraph.session import written

FEATURES = 4096
CELLS = 8192
STEPS = 40
_WORD = re.compile(r"[^\W\d_]+|\n\S?|[^\w\s]")


def hashed_words(text: str) -> np.ndarray:
    return np.array([zlib.crc32(w.encode()) % FEATURES for w in _WORD.findall(text.lower())], dtype=np.int64)


def learn(labelled: DataFrame, sources: list[str]) -> np.ndarray:
    """Log weights (sources, 1 + FEATURES) from all labelled (source, text) rows; counts are summed per partition."""
    index = {s: i for i, s in enumerate(sources)}

    def count(frames):
        held = np.zeros((len(sources), FEATURES + 1))
        for f in frames:
            for s, t in zip(f["source"], f["text"]):
                if s in index:
                    held[index[s], 0] += 1
                    np.add.at(held[index[s]], np.unique(hashed_words(t)) + 1, 1)
        i, j = np.nonzero(held)
        yield pd.DataFrame({"i": i, "j": j, "n": held[i, j]})

    table = np.zeros((len(sources), FEATURES + 1))
    for r in labelled.select("source", "text").mapInPandas(count, "i long, j long, n double").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():  # sources x features
        table[r["i"], r["j"]] = r["n"]
    docs = table[:, :1]
    rates = (table[:, 1:] + 0.5) / (docs + 1.0)
    prior = np.log((docs + 1.0) / (docs.sum() + len(sources)))
    rates = np.clip(rates, 1e-6, 1 - 1e-6)
    return np.hstack([prior + np.log1p(-rates).sum(1, keepdims=True), np.log(rates) - np.log1p(-rates)])


def posteriors(texts: list[str], weights: np.ndarray) -> np.ndarray:
    out = np.empty((len(texts), len(weights)))
    for n, t in enumerate(texts):
        z = weights[:, 0] + weights[:, np.unique(hashed_words(t)) + 1].sum(1)
        z = np.exp(z - z.max())
        out[n] = z / z.sum()
    return out


def _weigh(weights: np.ndarray, sources: list[str]):
    index = {s: i for i, s in enumerate(sources)}

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def membership(source: pd.Series, text: pd.Series) -> pd.Series:
        rows = [None] * len(source)
        unknown = [k for k, s in enumerate(source) if not isinstance(s, str)]
        for k, p in zip(unknown, posteriors([text.iloc[k] for k in unknown], weights) if unknown else ()):
            rows[k] = p.tolist()
        for k, s in enumerate(source):
            if rows[k] is None:
                rows[k] = [float(i == index.get(s, -1)) for i in range(len(sources))]
        return pd.Series(rows, dtype=object)

    return membership


def _rates(member: np.ndarray, caps: np.ndarray, path: np.ndarray) -> np.ndarray:
    """Rates (rows) after the steps of the path, each a vector of preconditioned residuals by source."""
    most = np.where(member >= 0.1, caps, np.inf).min(1)
    most = np.where(np.isfinite(most), most, 0.0)
    r = np.zeros(len(member))
    for step in path:
        r = np.clip(r - member @ step, 0.0, most)
    return r


def _cells(sizes: np.ndarray, wanted: float) -> np.ndarray:
    """Cells whose sizes add up to about `wanted`: as many as fit in order, then the largest that fit what is missing."""
    cut = int(np.searchsorted(sizes.cumsum(), wanted + 1e-9, side="right"))
    missing, out = wanted - sizes[:cut].sum(), list(range(cut))
    for c in np.argsort(-sizes[cut:], kind="stable") + cut:
        if 0 < sizes[c] <= missing + 1e-9:
            out.append(c)
            missing -= sizes[c]
    return np.array(out, dtype=np.int64)


def mix(documents: DataFrame, targets: DataFrame, tokenizer: str = RANKS, total_tokens: float | None = None) -> DataFrame:
    """(doc_id, source, likeliest, tokens, copies, member): how often each used text is taken; `member` are the posteriors
    of the sources in the order of their names, 1 at the source of a text that has one.

    The total is `total_tokens`, or the largest at which every source can reach its share within its repeats.
    """
    goals = targets.orderBy("source").collect()  # one row a source: fixed
    sources = [g["source"] for g in goals]
    share, caps = np.array([g["target_share"] for g in goals], dtype=float), np.array([g["max_repeats"] for g in goals], dtype=float)
    usable = documents.select("doc_id", "source", "text").where(F.length("text") > 0)
    if not sources:
        return usable.select("doc_id", "source", F.col("source").alias("likeliest"), F.lit(0).cast("long").alias("tokens"), F.lit(0).alias("copies"), F.array().cast("array<double>").alias("member")).limit(0)
    weights = learn(usable.where(F.col("source").isNotNull()), sources)
    known = usable.where(F.col("source").isin(sources) | F.col("source").isNull())
    sized = written(known.select("doc_id", "source", count_tokens(F.col("text"), tokenizer).alias("tokens"), _weigh(weights, sources)("source", "text").alias("member")), "mix")
    n = len(sources)
    schema = "i int, total double, curve double"

    def totals(path: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """By source: expected tokens at the rates of a path (or of one use each), and the curvature."""

        def part(frames):
            a, h = np.zeros(n), np.zeros(n)
            for f in frames:
                if len(f):
                    m, t = np.array(f["member"].tolist(), dtype=float), f["tokens"].to_numpy(dtype=float)
                    r = np.ones(len(f)) if path is None else _rates(m, caps, path)
                    a += (m * (r * t)[:, None]).sum(0)
                    h += (m * m.sum(1, keepdims=True) * t[:, None]).sum(0)
            yield pd.DataFrame({"i": np.arange(n, dtype=np.int32), "total": a, "curve": h})

        a, h = np.zeros(n), np.zeros(n)
        for r in sized.select("tokens", "member").mapInPandas(part, schema).groupBy("i").agg(F.sum("total").alias("total"), F.sum("curve").alias("curve")).collect():  # one row a source
            a[r["i"]], h[r["i"]] = r["total"], r["curve"]
        return a, h

    once, curve = totals(None)
    reach = np.where(share > 0, once * caps / np.maximum(share, 1e-12), np.inf).min() if n else 0.0
    goal = share * min(reach * 0.9999, total_tokens or np.inf)
    path, before = np.empty((0, n)), None
    for _ in range(STEPS):
        got, _ = totals(path) if len(path) else (np.zeros(n), None)
        residual = got - goal
        if np.abs(residual).max() <= 1e-5 * goal.sum() or (before is not None and np.abs(residual - before).max() <= 1e-6 * goal.sum()):
            break  # met, or what is missing lies beyond the repeats allowed
        before = residual
        path = np.vstack([path, residual / np.maximum(curve, 1.0)])

    @F.pandas_udf(T.DoubleType())
    def rate(member: pd.Series) -> pd.Series:
        return pd.Series(_rates(np.array(member.tolist(), dtype=float).reshape(len(member), n), caps, path))

    names = F.array(*[F.lit(s) for s in sources])
    cell = F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(CELLS)).cast("int")
    likeliest = F.element_at(names, F.array_position("member", F.array_max("member")).cast("int"))
    rated = written(sized.select("doc_id", "source", likeliest.alias("likeliest"), "tokens", "member", rate("member").alias("rate"), cell.alias("cell")), "rates")

    def whole(rows: DataFrame, wanted: np.ndarray | None) -> DataFrame:
        """`copies` of rows by likeliest source: their rates' whole part, one more in the cells that make up the rest."""
        base, part = F.floor("rate"), F.col("rate") - F.floor("rate")
        by = np.zeros((n, CELLS, 2))
        index = {s: i for i, s in enumerate(sources)}
        for r in rows.groupBy("likeliest", "cell").agg(F.sum("tokens").alias("all"), F.sum(part * F.col("tokens")).alias("wanted")).collect():  # sources x cells
            by[index[r["likeliest"]], r["cell"]] = r["all"], r["wanted"]
        taken = [(s, int(c)) for i, s in enumerate(sources) for c in _cells(by[i, :, 0], by[i, :, 1].sum() if wanted is None else wanted[i])]
        chosen = rows.sparkSession.createDataFrame(taken, "likeliest string, cell int").withColumn("more", F.lit(1))
        more = F.when(part > 1e-9, F.coalesce("more", F.lit(0))).otherwise(0)
        return rows.join(F.broadcast(chosen), ["likeliest", "cell"], "left").select("doc_id", "source", "likeliest", "tokens", (base + more).cast("int").alias("copies"), "member").where("copies > 0")

    # Texts without a source are rounded first. The fitted rates of the others then take one more projected step with those
    # copies held fixed: against a residual of one source only, its step is the residual over the tokens of that source.
    soft = written(whole(rated.where(F.col("source").isNull()), None), "soft")
    fixed, held, fitted = np.zeros(n), np.zeros(n), np.zeros(n)
    for r in soft.select((F.col("tokens") * F.col("copies")).alias("t"), F.posexplode("member").alias("i", "p")).groupBy("i").agg(F.sum(F.col("t") * F.col("p")).alias("t")).collect():  # one row a source
        fixed[r["i"]] = r["t"]
    for r in rated.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum("tokens").alias("t"), F.avg("rate").alias("rate")).collect():  # one row a source
        held[sources.index(r["source"])], fitted[sources.index(r["source"])] = r["t"], r["rate"]
    last = np.clip(fitted - (fixed + held * fitted - goal) / np.maximum(held, 1), 0, caps)
    rates = F.create_map(*[F.lit(x) for s, r in zip(sources, last) for x in (s, float(r))])
    hard = rated.where(F.col("source").isNotNull()).withColumn("rate", F.element_at(rates, F.col("source")))
    return whole(hard, (last - np.floor(last)) * held).unionByName(soft)


def shares(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, tokens, actual_share, labelled_share, texts, most_repeats) of a mixture.

    `actual_share` counts a text without a source by its posteriors, `labelled_share` leaves such texts out.
    """
    used = F.col("tokens") * F.col("copies")
    names = targets.orderBy("source").select("source")
    order = names.withColumn("i", F.row_number().over(W.orderBy("source")) - 1)  # one row a source
    parts = mixture.select("source", used.alias("used"), "copies", F.posexplode("member").alias("i", "p")).where("p > 0")
    held = parts.groupBy("i").agg(F.sum(F.col("used") * F.col("p")).alias("tokens"), F.sum(F.when(F.col("source").isNotNull(), F.col("used")).otherwise(0)).alias("labelled"), F.count(F.when(F.col("source").isNotNull(), 1)).alias("texts"), F.max(F.when(F.col("source").isNotNull(), F.col("copies"))).alias("most_repeats"))
    targets = targets.select("source", "target_share")
    both = targets.join(order, "source").join(held, "i", "left").select("source", "target_share", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tokens", "labelled", "texts", "most_repeats")])
    every = both.agg(F.sum("tokens").alias("every"), F.sum("labelled").alias("every_labelled"))
    return both.crossJoin(F.broadcast(every)).select("source", "target_share", "tokens", (F.col("tokens") / F.nullif("every", F.lit(0))).alias("actual_share"), (F.col("labelled") / F.nullif("every_labelled", F.lit(0))).alias("labelled_share"), "texts", "most_repeats")
