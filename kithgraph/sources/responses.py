"""Lenient readers of service responses: JSON in prose or fences, tag soup, wrapped lists."""

from __future__ import annotations

import html
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Keys under which payloads, collections and transcripts are found.
WRAPPERS = "structuredContent content data result results meetings meeting notes documents items text answer response".split()
COLLECTIONS = "meetings notes documents items results data".split()
TRANSCRIPT_KEYS = "transcript text content markdown body full_transcript raw_transcript value".split()
DEEPEST = 12
# Patterns of fences, tags and empty listings.
FENCE = re.compile(r"```json\s*(.*?)```", re.I | re.S)
TAG = re.compile(r"""<meeting\b(?:"[^"]*"|'[^']*'|[^'">])*>""", re.I)
ATTRIBUTE = re.compile(r"""([\w:-]+)\s*=\s*(?:"([^"]*)"|'([^']*)')""")
NOTHING = re.compile(r"\s*<meetings\b[^>]*(?:/\s*>|>\s*</meetings>)\s*|\s*(?:no meetings(?: found| available)?(?:[.!]| for[^\n]*)?|0 meetings)\s*", re.I)


def lenient_json(text: str):
    """The JSON a text is, holds in a fence, or holds between its outermost braces; None if there is none."""
    bare = re.sub(r"\s*```$", "", re.sub(r"^```(?:json)?\s*", "", text.strip(), flags=re.I))
    fence = FENCE.search(text)
    brace = bare[bare.find("{") : bare.rfind("}") + 1] if 0 <= bare.find("{") < bare.rfind("}") else None
    for attempt in (bare, fence[1] if fence else None, None if fence else brace):
        if attempt is not None:
            try:
                return json.loads(attempt)
            except ValueError:
                continue
    return None


def decode_entities(text: str) -> str:
    """The five named and the numeric entities; surrogates and impossible numbers stay as they are."""

    def one(m: re.Match) -> str:
        body = m[1]
        if body[0] == "#":
            n = int(body[2:], 16) if body[1] in "xX" else int(body[1:])
            return chr(n) if 0 < n <= 0x10FFFF and not 0xD800 <= n <= 0xDFFF else m[0]
        return html.unescape(m[0])

    return re.sub(r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|amp|lt|gt|quot|apos);", one, text)


def meetings_of(value) -> tuple[list[dict], bool]:
    """(meetings by id, first wins; whether the payload was recognised) of JSON, tags, or both nested."""
    found: dict[str, dict] = {}
    known = [False]
    said = lambda v: isinstance(v, str) and v.strip() != ""

    def note(ident, title, date) -> None:
        if said(ident) and said(title) and len(ident) <= 200 and not re.search(r"[\x00-\x1f]", ident):
            found.setdefault(ident, {"id": ident, "title": title.strip(), "date": date if said(date) else None})
            known[0] = True

    def first(d: dict, *keys):
        return next((d[k] for k in keys if d.get(k) is not None), None)

    todo = [(value, 0, True)]
    while todo:
        v, depth, listed = todo.pop(0)
        if depth > DEEPEST:
            continue
        if isinstance(v, list):
            known[0] |= listed and not v
            todo = [(x, depth + 1, listed) for x in v] + todo
        elif isinstance(v, dict):
            note(first(v, "id", "meeting_id", "document_id", "note_id"), first(v, "title", "meeting_title", "meetingTitle", *(["name"] if listed else [])), first(v, "date", "created_at", "createdAt"))
            todo = [(v[k], depth + 1, k in COLLECTIONS) for k in WRAPPERS if k in v] + todo
        elif isinstance(v, str):
            parsed = None if re.search(r"<meeting\b", v, re.I) else lenient_json(v)
            if parsed is not None:
                todo.insert(0, (parsed, depth + 1, True))
                continue
            for m in TAG.finditer(v):
                own = {k.lower(): decode_entities(a or b) for k, a, b in ATTRIBUTE.findall(m[0])}
                stop = v.find("</meeting>", m.end())
                inside = v[m.end() : stop] if stop >= 0 and not m[0].endswith("/>") else ""
                child = lambda tag: decode_entities(c[1].strip()) if (c := re.search(rf"<{tag}\b[^>]*>(.*?)</{tag}>", inside, re.I | re.S)) else None  # noqa: B023, E731
                note(own.get("id") or own.get("meeting_id") or child("id"), own.get("title") or child("title"), own.get("date") or child("date"))
            known[0] |= bool(NOTHING.fullmatch(v))
    return list(found.values()), known[0]


def transcript_of(value, depth: int = 0) -> str | None:
    """The first non-empty transcript text under the known keys, in their order."""
    if depth > DEEPEST:
        return None
    if isinstance(value, str):
        parsed = lenient_json(value) if value.lstrip()[:1] in "{[`" else None
        return transcript_of(parsed, depth + 1) if parsed is not None else (value.strip() or None)
    if isinstance(value, list):
        if value and all(isinstance(x, dict) and "text" in x for x in value):
            lines = [f"{x['speaker']}: {x['text']}" if x.get("speaker") else str(x["text"] or "") for x in value]
            return "\n".join(t.strip() for t in lines if t.strip()) or None
        return next((t for x in value if (t := transcript_of(x, depth + 1))), None)
    if isinstance(value, dict):
        return next((t for k in [*TRANSCRIPT_KEYS, *WRAPPERS] if k in value and (t := transcript_of(value[k], depth + 1))), None)
    return None


def shape(value, depth: int = 0) -> str:
    """The shape of a value without any of its contents."""
    if isinstance(value, dict):
        return "{" + ", ".join(f"{k}: {shape(v, depth + 1)}" for k, v in sorted(value.items())[:20]) + "}" if depth < 4 else "{…}"
    if isinstance(value, list):
        return f"[{len(value)} x {shape(value[0], depth + 1)}]" if value else "[]"
    return {"str": "string", "int": "number", "float": "number", "bool": "boolean", "NoneType": "null"}[type(value).__name__]


_MEETINGS = T.StructType([T.StructField("meetings", T.ArrayType(T.StructType([T.StructField(k, T.StringType()) for k in ("id", "title", "date")]))), T.StructField("recognized", T.BooleanType())])


@F.pandas_udf(_MEETINGS)
def meetings(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([meetings_of(t) if isinstance(t, str) else ([], False) for t in texts], columns=["meetings", "recognized"])


@F.pandas_udf(T.StringType())
def transcript(texts: pd.Series) -> pd.Series:
    return pd.Series([transcript_of(t) if isinstance(t, str) else None for t in texts], dtype=object)


@F.pandas_udf(T.StringType())
def response_shape(texts: pd.Series) -> pd.Series:
    return pd.Series([shape(lenient_json(t)) if isinstance(t, str) else None for t in texts], dtype=object)


def decoded(c: Column) -> Column:
    """The five named entities decoded by built-in replacements; ampersands last."""
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        c = F.replace(c, F.lit(f"&{name};"), F.lit(char))
    return c
