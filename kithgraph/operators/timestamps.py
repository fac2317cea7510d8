"""Mixed timestamp formats and zones to one UTC instant.

Each text becomes a shape mask: digits `9`, words a letter of their class (month, weekday, am/pm, zone ...), the
rest as it stands, one mask character per text character. Every distinct mask is matched against the date
grammar once and yields the character spans of its fields; all texts of that mask are then converted together
by array slices, without parsing a single row on its own.

Defined results: null, empty or unreadable text (of any length), and text naming no real day or
time, give null; a missing or unknown workspace zone counts as UTC, a missing date order as `mdy`.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kithgraph.functions.zones import ZoneTables

#: Texts are laid out in tables of this width; longer ones in tables of their own, by powers of two.
WIDTH = 96

# Month and weekday names of the four languages, and zone abbreviations with offsets in minutes.
MONTHS = {
    1: "january jan januar jän janvier janv enero ene",
    2: "february feb februar février fevr févr febrero",
    3: "march mar märz marz mär mars marzo mrz",
    4: "april apr avril avr abril abr",
    5: "may mai mayo",
    6: "june jun juni juin junio",
    7: "july jul juli juillet juil julio",
    8: "august aug août aout agosto ago",
    9: "september sep sept septembre septiembre setiembre",
    10: "october oct oktober okt octobre octubre",
    11: "november nov novembre noviembre",
    12: "december dec dezember dez décembre déc decembre diciembre dic",
}
WEEKDAYS = (
    "monday mon tuesday tue tues wednesday wed thursday thu thur thurs friday fri saturday sat sunday sun "
    "montag mo dienstag di mittwoch mi donnerstag do freitag fr samstag sa sonntag so "
    "lundi lun mardi mercredi mer jeudi jeu vendredi ven samedi sam dimanche dim "
    "lunes martes miércoles mié jueves viernes vie sábado sáb domingo"
)
ABBREVIATIONS = {
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "AKST": -540, "AKDT": -480, "HST": -600, "AST": -240, "ADT": -180, "NST": -210, "NDT": -150, "BRT": -180,
    "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180, "SAST": 120,
    "IST": 330, "PKT": 300, "SGT": 480, "HKT": 480, "AWST": 480, "JST": 540, "KST": 540, "ACST": 570, "ACDT": 630,
    "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
}
FILLERS = "at on of de del à a um le las los the den der el"


def _fold(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c))


_WORDS: dict[str, tuple[str, int]] = {}
for _w in FILLERS.split():
    _WORDS[_fold(_w)] = ("f", 0)
for _w in WEEKDAYS.split():
    _WORDS[_fold(_w)] = ("W", 0)
for _m, _names in MONTHS.items():
    for _w in _names.split():
        _WORDS[_fold(_w)] = ("M", _m)
for _w in "st nd rd th er".split():
    _WORDS[_w] = ("o", 0)
_WORDS |= {"am": ("P", 0), "pm": ("P", 12), "t": ("T", 0), "z": ("U", 0), "utc": ("U", 0), "gmt": ("U", 0), "uhr": ("u", 0), "h": ("h", 0)}
for _w in ABBREVIATIONS:
    _WORDS[_w.lower()] = ("Z", ABBREVIATIONS[_w])
# "mar"/"mars"/"mardi" are settled by the table order above: a month name wins over a weekday or filler

_ZONE = r"(?:\s*(?:(?P<utc>U+)(?:(?P<gs>[+-])(?P<gh>99):?(?P<gm>99)?)?|(?P<os>[+-])(?P<oh>99)(?::?(?P<om>99))?|(?P<abbr>Z+)|\[?(?P<iana>x+(?:[/_\-]x+)+)\]?))?\s*(?:\(.*\))?"
_TIME = r"(?P<H>99?)(?::|h+)(?P<M>99)(?::(?P<S>99)(?:[.,](?P<f>9+))?)?\s*(?P<ap>P+)?(?:\s*u+)?" + _ZONE
_PACKED = r"(?P<H>99)(?P<M>99)(?P<S>99)?(?:[.,](?P<f>9+))?" + _ZONE
_WEEKDAY = r"(?:W+[.,]?\s+)?"
_SEP = r"(?:\s*T+\s*|,?\s+(?:f+\s+)*|,)"
_YMD = r"(?P<y>9999)(?P<s1>[-/.])(?P<m>99?)(?P=s1)(?P<d>99?)"
_DATES = [
    _YMD,
    r"(?P<d>99?)\.\s?(?P<m>99?)\.\s?(?P<y>9999|99)",
    r"(?P<a>99?)(?P<s1>[-/])(?P<b>99?)(?P=s1)(?P<y>9999|99)",
    r"(?P<mon>M+)\.?\s+(?P<d>99?)o*,?\s+(?P<y>9999)",
    r"(?P<d>99?)(?:o+|\.)?[\s-]+(?:f+\s+)*(?P<mon>M+)\.?,?[\s-]+(?:f+\s+)*(?P<y>9999|99)",
    r"(?P<y>9999)[\s-]+(?P<mon>M+)[\s-]+(?P<d>99?)",
]
GRAMMAR = [re.compile(f"{_WEEKDAY}{d}(?:{_SEP}{_TIME})?") for d in _DATES]
GRAMMAR += [re.compile(r"(?P<y>9999)(?P<m>99)(?P<d>99)T+" + _PACKED), re.compile(_YMD + r"T+" + _PACKED), re.compile(_YMD + _ZONE)]
GRAMMAR += [re.compile(r"(?P<num>9{1,18})(?:\.(?P<frac>9+))?")]


@lru_cache(maxsize=65536)
def parser_of(mask: str) -> dict[str, tuple[int, int]] | None:
    """The field spans of one mask, found once; None for a mask of no known form."""
    for form in GRAMMAR:
        if m := form.fullmatch(mask):
            return {k: m.span(k) for k, v in m.groupdict().items() if v is not None}
    return None


def _class_table() -> np.ndarray:
    lut = np.arange(0x3000, dtype=np.uint32)
    for c in range(0x3000):
        ch = chr(c)
        if "0" <= ch <= "9":
            lut[c] = ord("9")
        elif ch.isalpha():
            lut[c] = ord("x")
        elif ch.isspace() and c:
            lut[c] = ord(" ")
    for c in (0x2010, 0x2011, 0x2012, 0x2013, 0x2212):
        lut[c] = ord("-")
    return lut


_LUT = _class_table()
_RUN = re.compile(r"x+")
_MARK = re.compile(r"x+(?:[/_-]x+)*/x+(?:[/_-]x+)*")


def masks(codes: np.ndarray) -> np.ndarray:
    """Character-class masks of a matrix of code points, one row per text, padded by 0."""
    return np.where(codes < len(_LUT), _LUT[np.minimum(codes, len(_LUT) - 1)], ord("x")).astype(np.uint32)


def _text(codes: np.ndarray) -> np.ndarray:
    """The rows of a matrix of code points as strings."""
    c = np.ascontiguousarray(codes, dtype=np.uint32)
    return c.view(f"<U{c.shape[1]}").ravel()


def _number(codes: np.ndarray) -> np.ndarray:
    digits = codes.astype(np.int64) - 48
    return digits @ (10 ** np.arange(codes.shape[1] - 1, -1, -1, dtype=np.int64))


_CUM = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Days since 1970 of civil dates, and which of them exist."""
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    ok = (y >= 1) & (m >= 1) & (m <= 12) & (d >= 1)
    ok &= d <= _CUM[np.clip(m, 0, 12)] + (leap & (m == 2))
    yy = y - (m <= 2)
    era = yy // 400
    yoe = yy - era * 400
    doy = (153 * (m + np.where(m > 2, -3, 9)) + 2) // 5 + d - 1
    return era * 146097 + yoe * 365 + yoe // 4 - yoe // 100 + doy - 719468, ok


def _convert(span: dict[str, tuple[int, int]], codes: np.ndarray, zones: np.ndarray, orders: np.ndarray, tables: ZoneTables) -> tuple[np.ndarray, np.ndarray]:
    """Microseconds UTC of texts that share one mask, and which of them are readable."""
    n = len(codes)
    part = lambda k: codes[:, span[k][0] : span[k][1]]
    num = lambda k, default=0: _number(part(k)) if k in span else np.full(n, default, dtype=np.int64)

    def micros(k: str, digits: int) -> np.ndarray:
        if k not in span:
            return np.zeros(n, dtype=np.int64)
        cut = part(k)[:, :digits]
        return _number(cut) * 10 ** (digits - cut.shape[1])

    if "num" in span:
        v = num("num")
        per = np.where(v < 10**11, 10**6, np.where(v < 10**14, 10**3, 1)).astype(np.int64)
        fraction = np.where(per == 10**6, micros("frac", 6), np.where(per == 10**3, micros("frac", 3), 0))
        return np.where(v < 10**17, v, 0) * per + fraction, v < 10**17

    y, ok = num("y"), np.ones(n, dtype=bool)
    if span["y"][1] - span["y"][0] == 2:
        y = y + 2000
    if "a" in span:
        a, b = num("a"), num("b")
        dmy = np.array([o == "dmy" for o in orders])
        d, m = np.where(dmy, a, b), np.where(dmy, b, a)
    else:
        d, m = num("d"), num("m")
    if "mon" in span:
        m = _lookup(part("mon"))
    days, real = _days(y, m, d)
    hour, minute, second = num("H"), num("M"), num("S")
    ok &= real & (minute < 60) & (second < 60)
    if "ap" in span:
        ok &= (hour >= 1) & (hour <= 12)
        hour = hour % 12 + _lookup(part("ap"))
    ok &= hour < 24
    wall = days * 86400 + hour * 3600 + minute * 60 + second

    given = [k for k in ("os", "gs") if k in span]
    if given:
        h, mi = num("oh" if given[0] == "os" else "gh"), num("om" if given[0] == "os" else "gm")
        sign = np.where(part(given[0])[:, 0] == ord("+"), 1, -1)
        ok &= (h <= 15) & (mi < 60)
        utc = wall - sign * (h * 3600 + mi * 60)
    elif "utc" in span:
        utc = wall
    elif "abbr" in span:
        utc = wall - _lookup(part("abbr")) * 60
    elif "iana" in span:
        utc, known = tables.wall_to_utc(wall, _text(part("iana")).astype(object))
        ok &= known
    else:
        utc, _ = tables.wall_to_utc(wall, zones)
    return utc * 10**6 + micros("f", 6), ok


def _lookup(codes: np.ndarray) -> np.ndarray:
    words, back = np.unique(_text(codes), return_inverse=True)
    return np.array([_WORDS[_fold(str(w))][1] for w in words], dtype=np.int64)[back]


def read_texts(texts: np.ndarray, zones: np.ndarray, orders: np.ndarray, tables: ZoneTables) -> tuple[np.ndarray, np.ndarray]:
    """Microseconds UTC and readability of texts with their workspace's zone and date order."""
    n = len(texts)
    out, ok = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
    kept = [(i, t) for i, t in enumerate(s.strip() if isinstance(s, str) else "" for s in texts) if any(c.isdigit() for c in t)]
    widths = np.array([max(WIDTH, 1 << (len(t) - 1).bit_length()) for _, t in kept], dtype=np.int64)
    for width in np.unique(widths):
        some = [kept[i] for i in np.flatnonzero(widths == width)]
        codes = np.array([t for _, t in some], dtype=f"<U{width}").view(np.uint32).reshape(len(some), width)
        _read_table(codes, np.array([i for i, _ in some]), zones, orders, tables, out, ok)
    return out, ok


def _read_table(codes: np.ndarray, rows: np.ndarray, zones: np.ndarray, orders: np.ndarray, tables: ZoneTables, out: np.ndarray, ok: np.ndarray) -> None:
    """Fill `out` and `ok` at `rows` from texts of one width."""
    coarse = _text(masks(codes))
    for mask in np.unique(coarse):
        at = np.flatnonzero(coarse == mask)
        own = codes[at][:, : len(mask)]
        marked = [m.span() for m in _MARK.finditer(mask)]  # words of a zone name such as Area/City stay unknown words
        runs = [r.span() for r in _RUN.finditer(mask)]
        fine = np.zeros(len(at), dtype=np.int64)
        kinds: list[list[str]] = []
        for s, e in runs:
            words, back = np.unique(_text(own[:, s:e]), return_inverse=True)
            known = ["x" if any(a <= s < b for a, b in marked) else _WORDS.get(_fold(str(w)), ("x", 0))[0] for w in words]
            levels = sorted(set(known))
            kinds.append(levels)
            fine = fine * len(levels) + np.array([levels.index(k) for k in known])[back]
        for shape in np.unique(fine):
            letters, rest = list(mask), int(shape)
            for (s, e), levels in zip(reversed(runs), reversed(kinds)):
                rest, k = divmod(rest, len(levels))
                letters[s:e] = levels[k] * (e - s)
            span = parser_of("".join(letters))
            if span is None:
                continue
            here = np.flatnonzero(fine == shape)
            to = rows[at[here]]
            out[to], ok[to] = _convert(span, own[here], zones[to], orders[to], tables)


def utc_micros(fields: list[Column], zone: Column, date_order: Column, tables: ZoneTables | None = None) -> Column:
    """Microseconds since 1970 UTC of the first readable field, null if none is readable.

    A zone, offset or abbreviation in the text holds, else the wall clock of `zone`; a repeated wall time is the
    first one, a skipped one moves on by the skip. Slash dates without a leading year follow `date_order`.
    """
    tables, count = tables or ZoneTables(), len(fields)

    @F.pandas_udf(T.LongType())
    def first_readable(x: pd.DataFrame) -> pd.Series:
        zones = np.array([z if isinstance(z, str) and tables.get(z) is not None else "UTC" for z in x["zone"]], dtype=object)
        orders = x["date_order"].to_numpy(dtype=object)
        value, found = np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=bool)
        for k in range(count):
            rest = np.flatnonzero(~found)
            if len(rest):
                value[rest], found[rest] = read_texts(x[f"f{k}"].to_numpy(dtype=object)[rest], zones[rest], orders[rest], tables)
        return pd.Series(np.where(found, value, 0)).astype("Int64").mask(~found)

    return first_readable(F.struct(*[c.cast("string").alias(f"f{k}") for k, c in enumerate(fields)], zone.alias("zone"), date_order.alias("date_order")))


def normalise_notes(notes: DataFrame, workspaces: DataFrame) -> DataFrame:
    """Each note with `utc_us`, by the zone and date order of its workspace's settings.

    Only the four used columns and the key leave the scan. The settings are reduced to one row per workspace
    before the join, whose side is broadcast only if the planner finds it small enough.
    """
    settings = workspaces.groupBy(F.col("id").alias("_ws")).agg(F.min(F.get_json_object("settings", "$.timezone")).alias("_tz"), F.min(F.get_json_object("settings", "$.date_order")).alias("_order"))
    joined = notes.join(settings, F.col("workspace_id") == F.col("_ws"), "left")
    at = utc_micros([F.col("created_at"), F.col("createdat"), F.col("note_date")], F.col("_tz"), F.col("_order"))
    return joined.withColumn("utc_us", at).drop("_ws", "_tz", "_order")


def notes_in_utc(notes: DataFrame, workspaces: DataFrame) -> DataFrame:
    """(row_id, utc_us) of every note with a readable field."""
    columns = notes.select("row_id", "workspace_id", "created_at", "createdat", "note_date")
    return normalise_notes(columns, workspaces).where(F.col("utc_us").isNotNull()).select("row_id", "utc_us")
