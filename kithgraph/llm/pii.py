"""Personal information inside free text, found by a character-level BiLSTM-CRF and replaced by its type.

The tagger reads whole texts, character by character: every line of every text, with the line break before it. Lines
longer than a window are covered by overlapping windows, whose emissions are joined with weights falling towards the
window's edges; one Viterbi pass over the whole line then reconciles all windows at once. The transitions know where
words are: no piece begins or ends inside one. Places for which the emissions prove that no tag can win are not decoded.
Equal lines are read once per batch. No pattern chooses what is read or decides what is found; of what is decoded,
punctuation at the edges is left out. No shuffle.

The weights are trained by `pii_train.py` from labelled spans and kept in `pii_weights.npz`.

Defined results: null, empty and blank texts have no pieces; texts of any length are processed whole; no piece runs
over a line break; a piece that occurs several times in a text is one row; repeated rows give the same pieces under
their own key.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kithgraph.llm.tagger import Tagger, encode, inside_words

TYPES = ("email", "phone", "id_number", "street_address", "person_name")
#: Tag 0 is outside; of type i, 2i + 1 begins and 2i + 2 continues a piece.
TAGS = 1 + 2 * len(TYPES)
WINDOW, STRIDE, BATCH = 240, 180, 768
#: Characters read at once.
AT_ONCE = 1_500_000
WEIGHTS = os.path.join(os.path.dirname(__file__), "pii_weights.npz")


def lines(text: str) -> list[tuple[int, str]]:
    """(place, line with the break before it) of every line that holds a letter or digit."""
    out, at = [], 0
    for line in text.split("\n"):
        if not line.isspace() and line:
            out.append((at - 1, "\n" + line))
        at += len(line) + 1
    return out


@lru_cache(maxsize=1)
def _model() -> Tagger:
    return Tagger.load(WEIGHTS)


def _spans(texts: list[str], model: Tagger) -> list[list[tuple[int, int, int]]]:
    """(start, end, type number) of the pieces of every text, in order of place; long ones by overlapping windows whose emissions are joined before decoding."""
    pieces = []  # (text number, start, end)
    for n, t in enumerate(texts):
        s = 0
        while True:
            pieces.append((n, s, min(len(t), s + WINDOW)))
            if s + WINDOW >= len(t):
                break
            s += STRIDE
    order = sorted(range(len(pieces)), key=lambda i: pieces[i][2] - pieces[i][1])
    long: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    found: list[tuple[int, int, np.ndarray, np.ndarray]] = []  # (text number, start, emissions, places inside words)

    def keep(numbers: list[int], e: np.ndarray, lengths: np.ndarray) -> None:
        found.extend((numbers[j], start, own, inside) for j, start, own, inside in model.cut(e, lengths, [texts[n] for n in numbers]))

    for at in range(0, len(order), BATCH):
        part = [pieces[i] for i in order[at : at + BATCH]]
        x, lengths = encode([texts[n][s:e] for n, s, e in part])
        e = model.emissions(x, lengths)
        whole = [j for j, (n, _, _) in enumerate(part) if len(texts[n]) <= WINDOW]
        if whole:
            keep([part[j][0] for j in whole], e[:, whole] if len(whole) < len(part) else e, lengths[whole])
        for j, (n, s, stop) in enumerate(part):
            if len(texts[n]) > WINDOW:
                total, weight = long.setdefault(n, (np.zeros((len(texts[n]), TAGS), np.float32), np.zeros((len(texts[n]), 1), np.float32)))
                size = stop - s
                w = np.minimum(np.arange(1, size + 1), np.arange(size, 0, -1)).astype(np.float32)[:, None]
                if s == 0:
                    w[: size // 2] = w.max()
                if stop == len(texts[n]):
                    w[size // 2 :] = w.max()
                total[s:stop] += e[:size, j] * w
                weight[s:stop] += w
    order = sorted(long, key=lambda n: len(texts[n]))
    at = 0
    while at < len(order):  # few at once if they are very long
        part = order[at : at + max(1, min(64, 2_000_000 // len(texts[order[at]])))]
        at += len(part)
        lengths = np.array([len(texts[n]) for n in part])
        e = np.zeros((lengths.max(), len(part), TAGS), np.float32)
        for j, n in enumerate(part):
            total, weight = long.pop(n)
            e[: lengths[j], j] = total / weight
        keep(part, e, lengths)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for (n, start, _, _), tags in zip(found, model.decode([x[2:] for x in found])):
        out[n] += [(start + s, start + t, kind) for s, t, kind in spans_of(tags)]
    return [sorted(x) for x in out]


#: A piece in a row of tags: either tag of a type, and the second one as long as it goes on.
_SPAN = re.compile(b"|".join(b"[\\x%02x\\x%02x]\\x%02x*" % (2 * i + 1, 2 * i + 2, 2 * i + 2) for i in range(len(TYPES))))


def spans_of(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, type number) of the pieces in a row of tags."""
    row = tags.astype(np.uint8).tobytes()
    return [(m.start(), m.end(), (row[m.start()] - 1) // 2) for m in _SPAN.finditer(row)]


_EDGE = " \t\r\n,;:.!?-–—/*<>|"


def trimmed(text: str, s: int, e: int, kind: int) -> tuple[int, int]:
    """A decoded piece without punctuation at its edges; the point of an initial at the end of a name stays."""
    while s < e and text[s] in _EDGE:
        s += 1
    while s < e and text[e - 1] in _EDGE and not (text[e - 1] == "." and kind == 4 and e - s > 2 and text[e - 3] in " ,."):
        e -= 1
    return s, e


class _Cache(dict):
    LIMIT = 150_000


_seen = _Cache()


def find(texts: list[str | None], model: Tagger | None = None) -> list[list[tuple[int, int, int]]]:
    """(start, end, type number) of every piece in each text, in order of place."""
    model = model or _model()
    places, wanted = [], {}
    for t in texts:
        own = lines(t) if t else []
        for _, read in own:
            if read not in _seen and read not in wanted:
                wanted[read] = len(wanted)
        places.append(own)
    if len(_seen) + len(wanted) > _Cache.LIMIT:
        kept = {read for own in places for _, read in own if read in _seen}
        for k in [k for k in _seen if k not in kept]:
            del _seen[k]
    reads = list(wanted)
    for read, spans in zip(reads, _spans(reads, model) if reads else ()):
        found = [(*trimmed(read, s, e, kind), kind) for s, e, kind in spans]
        _seen[read] = [x for x in found if x[0] < x[1]]
    return [[(start + s, start + e, kind) for start, read in own for s, e, kind in _seen[read]] for own in places]


def masked(text: str, pieces: list[tuple[int, int, int]]) -> str:
    """The text with every piece replaced by its type in brackets."""
    out, at = [], 0
    for s, e, kind in pieces:
        if s >= at:
            out += [text[at:s], f"[{TYPES[kind].upper()}]"]
            at = e
    return "".join(out) + text[at:]


_PIECES = T.ArrayType(T.StructType([T.StructField("pii_type", T.StringType()), T.StructField("pii_text", T.StringType())]))


@F.pandas_udf(_PIECES)
def _pieces(texts: pd.Series) -> pd.Series:
    rows = [t if isinstance(t, str) else "" for t in texts]
    ends = np.cumsum([len(t) for t in rows]) // AT_ONCE
    out = []
    for part in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(ends)) + 1):
        some = [rows[i] for i in part]
        out += [list(dict.fromkeys((TYPES[k], t[s:e]) for s, e, k in found)) for t, found in zip(some, find(some))]
    return pd.Series(out, dtype=object)


@F.pandas_udf(T.StringType())
def _mask(texts: pd.Series) -> pd.Series:
    rows = [t if isinstance(t, str) else "" for t in texts]
    return pd.Series([masked(t, found) if isinstance(raw, str) else None for raw, t, found in zip(texts, rows, find(rows))], dtype=object)


def mask_text(text: Column) -> Column:
    """The text with typed placeholders for personal data; null stays null."""
    return _mask(text)


def pieces(sources: DataFrame, claims: DataFrame) -> DataFrame:
    """(origin, row_key, pii_type, pii_text) of every distinct piece in sources.body and claims.quote."""
    a = sources.where(F.length("body") > 0).select(F.lit("sources").alias("origin"), F.col("source_seq").alias("row_key"), F.col("body").alias("t"))
    b = claims.where(F.length("quote") > 0).select(F.lit("claims").alias("origin"), F.col("claim_no").alias("row_key"), F.col("quote").alias("t"))
    read = lambda d: d.select("origin", "row_key", F.inline(_pieces("t")))
    return read(a).unionByName(read(b))
