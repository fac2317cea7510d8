"""Speech transcripts into clean, ordered speaker turns.

Each line of an exported transcript is parsed by a parsing-expression grammar (stamps, labels, cue tags, nested
sound notes); the parse trees become utterances with a time and a label, labels are tied to the attendee list, and
runs of one speaker become turns. One pass over each text in Arrow batches, no shuffle.

Defined results: null, empty, blank or `[]` transcripts have no turns; an utterance before any label gets speaker
null and no turn; repeated rows give the same turns under their own key; malformed JSON is read as plain lines.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kithgraph.llm.peg import Grammar

LINES = Grammar(r"""
note      <- '[' (note / ![\]\n] .)* ']' / '(' (note / ![)\n] .)* ')' / '{' (![}\n] .)* '}' / '<' (![>\n] .)* '>' / '*' ![ *] (![*\n] .)* '*' / '♪'
ws        <- [ \t  ]*
clock     <- [0-9]+ ':' [0-9][0-9] (':' [0-9][0-9])? ([.,] [0-9]+)?
stamp     <- clock
number    <- [0-9]+
speaker   <- [Ss] ([Pp] [Ee] [Aa] [Kk] [Ee] [Rr]) [ _\-#]* 
tied      <- (![)] .)+
numbered  <- speaker @number (ws '(' @tied ')')?
word      <- ![0-9] [\p{L}.'’\-@0-9_+]+
named     <- word (','? ' ' word)? (','? ' ' word)? (' ' word)? (' ' word)?
label     <- numbered / named
says      <- ws ':' ws
text      <- .*
timing    <- clock ws '-->' ws clock ws !.
bold      <- '**' ws @label ws ':'? '**' ws '(' @stamp ')' says @text
stamped   <- ('[' @stamp ']' / '(' @stamp ')') ws @label says @text
voice     <- '<v' [.a-z]* ' ' @label ws '>' @text
marked    <- '>>' ws @label says @text
header    <- @label ws @stamp ws !.
plain     <- @label says @text
""")
FORMS = {k: LINES.pattern(k) for k in ("timing", "bold", "stamped", "voice", "marked", "header", "plain")}
NOTE = LINES.pattern("note")

# Words of sound notes, hesitation sounds, and the phrases also dropped from clean text.
SOUNDS = {"laughter", "laughs", "laughing", "applause", "crosstalk", "inaudible", "silence", "music", "cough", "coughs", "coughing", "overlapping", "noise", "background", "typing", "pause", "sigh", "sighs", "unintelligible", "indistinct", "chuckles", "door", "phone", "ringing", "static"}
HESITATION = regex.compile(r"(?i)\b(?:u+h+m*|u+m+|e+r+m*|h+m+|a+h+|o+h+|e+h+|m+|mm?[- ]?hm+|mhm+|uh[- ]?huh|huh)\b")
PHRASES = regex.compile(r"(?i),?\s*\b(?:you know|i mean|sort of|like)\b(?:,|\.\.\.)+")
BANNERS = {"webvtt", "transcript generated automatically", "recording started", "recording stopped", "recording ended", "end of transcript"}
_LETTER = regex.compile(r"[\p{L}\p{N}]")
_CAPITAL, _LETTERS = regex.compile(r"\p{Lu}"), regex.compile(r"\p{L}+")
_AFTER_NAME = regex.compile(r"\s*<|\s+[—–]\s|\s+-\s|\s*\(")
_NOTE_OPENS = re.compile(r"[\[({<*♪]")


@lru_cache(maxsize=100_000)
def folded(s: str) -> str:
    return " ".join("".join(c for c in unicodedata.normalize("NFD", s.casefold()) if not unicodedata.combining(c)).split())


def name_of(entry) -> str | None:
    """The name in one attendee entry: an object, or `Name <email> — Company`."""
    if isinstance(entry, dict):
        entry = entry.get("name") or entry.get("email")
    return _name(entry) if isinstance(entry, str) else None


@lru_cache(maxsize=20_000)
def _name(entry: str) -> str | None:
    return _AFTER_NAME.split(entry.strip(), maxsplit=1)[0].strip() or None


@lru_cache(maxsize=5_000)
def _forms(name: str) -> frozenset[str]:
    """The ways a label may name this person."""
    w = folded(name).replace(",", " ").split()
    if not w:
        return frozenset()
    forms = {" ".join(w)}
    if len(w) > 1:
        first, last = w[0], w[-1]
        forms |= {f"{last}, {' '.join(w[:-1])}", f"{last} {first}", f"{last}, {first}", f"{first} {last}", f"{first[0]}. {last}", f"{first[0]} {last}", f"{last}, {first[0]}.", f"{first} {last[0]}.", f"{first} {last[0]}", first, last, "".join(x[0] for x in w), ".".join(x[0] for x in w) + ".", first[0] + last[0]}
    return frozenset(forms)


class Cast:
    """The attendees of one transcript and the ways a label may name one of them."""

    def __init__(self, names: list[str]):
        self.keys: dict[str, str | None] = {}
        self.labels: dict[str, str | None] = {}
        for name in dict.fromkeys(names):
            for f in _forms(name):
                self.keys[f] = name if self.keys.get(f, name) == name else None

    def person(self, label: str) -> str | None:
        if label not in self.labels:
            self.labels[label] = self.keys.get(folded(label).strip(" .")) or self.keys.get(folded(label))
        return self.labels[label]


def _is_sound(note: str) -> bool:
    """Sound notes are tags, or written in small letters, or made of sound words in any case; bracketed names and figures are speech."""
    return note[0] == "<" or not _CAPITAL.search(note) or SOUNDS.issuperset(_LETTERS.findall(note.lower()))


def _no_notes(text: str) -> str:
    return NOTE.sub(lambda m: " " if _is_sound(m[0]) else m[0], text) if _NOTE_OPENS.search(text) else text


def is_noise(text: str) -> bool:
    """Only hesitation sounds or sound notes."""
    if not _LETTER.search(text):
        return True
    return not _LETTER.search(HESITATION.sub("", _no_notes(text)))


def clean(text: str) -> str:
    text = HESITATION.sub("", _no_notes(text))
    text = PHRASES.sub(" ", text)
    text = regex.sub(r"\s+([,.;:?!])", r"\1", regex.sub(r"(?:\.\.\.|,)(?=\s*[,.])|(?<=\s)[,.]+(?=\s)", "", text))
    return " ".join(text.split()).strip(" ,")


def _seconds(stamp: str) -> float:
    total = 0.0
    for part in stamp.replace(",", ".").split(":"):
        total = total * 60 + float(part)
    return total


def _utterances(transcript: str, cast: Cast, tied: dict[int, str]) -> list[tuple[float | None, object, str]]:
    """(time or None, label or None, text) as written; a label is a name, or the number of a `Speaker N`."""
    if transcript.lstrip()[:1] == "[" and transcript.lstrip()[1:].lstrip()[:1] == "{":
        try:
            rows = json.loads(transcript)
        except ValueError:
            rows = None
        if isinstance(rows, list):
            out = []
            for o in rows:
                if isinstance(o, dict):
                    label = o.get("speaker")
                    who = _who(label.strip(), cast, tied) if isinstance(label, str) and label.strip() else None
                    at = o.get("start")
                    out.append((float(at) if isinstance(at, (int, float)) else None, who if who is not None else (label.strip() if isinstance(label, str) and label.strip() else None), str(o.get("text") or "")))
            return out
    out, at, who = [], None, None
    pending = False  # a header or timing line has opened an utterance
    for line in transcript.split("\n"):
        line = line.strip()
        if not line or line.casefold() in BANNERS:
            continue
        head = line[0]
        if head.isdigit() and (m := FORMS["timing"].match(line)):
            at, who, pending = _seconds(line.split("-->")[0].strip()), None, True
            continue
        m = None
        if head == "*":
            m = FORMS["bold"].match(line)
        elif head in "[(":
            m = FORMS["stamped"].match(line)
        elif head == "<":
            m = FORMS["voice"].match(line)
        elif head == ">":
            m = FORMS["marked"].match(line)
        elif line[-1].isdigit() and (m := FORMS["header"].match(line)):
            found = _label(m, cast, tied)
            if found is not None:
                at, who, pending = _seconds(m["stamp"]), found, True
                continue
            m = None
        if m is None and ":" in line:
            m = FORMS["plain"].match(line)
        if m is not None:
            found = _label(m, cast, tied)
            if found is not None:
                stamp = m["stamp"] if head in "*[(" and "stamp" in m.re.groupindex else None
                at = _seconds(stamp) if stamp else at if pending else None
                out.append((at, found, m["text"]))
                pending, who = False, None
                continue
        if pending:
            out.append((at, who, line))
            pending, who = False, None
        else:  # an unlabelled line: it keeps the place of the line before
            out.append((out[-1][0] if out else None, None, line))
    return out


def _label(m, cast: Cast, tied: dict[int, str]):
    return _who(m["label"].strip(), cast, tied)


_NUMBERED = LINES.pattern("numbered")


def _who(label: str, cast: Cast, tied: dict[int, str]):
    if label[:1] in "sS" and (m := _NUMBERED.fullmatch(label)):
        n = int(m["number"])
        if m["tied"]:
            person = cast.person(m["tied"])
            tied[n] = person or m["tied"].strip()
        return n
    return cast.person(label)


def turns(transcript: str | None, names: list[str], with_text: bool = True) -> list[tuple[int, str, str | None]]:
    """(turn number, speaker, clean text) of one transcript."""
    if not transcript or not transcript.strip():
        return []
    tied: dict[int, str] = {}
    said = _utterances(transcript, Cast(names), tied)
    if any(at is not None for at, _, _ in said):
        last, keyed = float("-inf"), []
        for i, (at, who, text) in enumerate(said):
            last = at if at is not None else last
            keyed.append((last, i, who, text))
        keyed.sort(key=lambda k: (k[0], k[1]))
        said = [(at, who, text) for at, _, who, text in keyed]
    out: list[list] = []
    speaker = None
    for _, who, text in said:
        if who is not None:
            speaker = tied.get(who, f"Speaker {who}") if isinstance(who, int) else who
        if speaker is None or is_noise(text):
            continue
        if not out or out[-1][1] != speaker:
            out.append([len(out) + 1, speaker, []])
        if with_text:
            out[-1][2].append(clean(text))
    return [(n, s, " ".join(filter(None, t)) if with_text else None) for n, s, t in out]


_REGION = re.compile(r"\[(ATTENDEES|SUMMARY|NOTES|TRANSCRIPT)\][ \t]*\r?$", re.I | re.M)


def regions(body: str) -> dict[str, str]:
    """The tagged regions of a source body; of a repeated region the parts are joined."""
    marks = [(m, start) for m in _REGION.finditer(body) if not body[(start := body.rfind("\n", 0, m.start()) + 1) : m.start()].strip(" \t")]
    out: dict[str, str] = {}
    for (m, _), (_, end) in zip(marks, [*marks[1:], (None, len(body))]):
        k = m[1].upper()
        part = body[m.end() : end].strip("\r\n")
        out[k] = f"{out[k]}\n{part}" if k in out else part
    return out


def listed(attendees: str | None) -> list[str]:
    """Names of a JSON list of strings or objects."""
    try:
        rows = json.loads(attendees) if attendees else []
    except ValueError:
        rows = []
    return [n for n in map(name_of, rows if isinstance(rows, list) else []) if n]


def _from_body(body: str | None, hints: str | None) -> tuple[str | None, list[str]]:
    if not body:
        return None, []
    parts = regions(body.replace("\r\n", "\n"))
    lines = [name_of(x.strip().lstrip("-•* ").strip()) for x in parts.get("ATTENDEES", "").split("\n")]
    return parts.get("TRANSCRIPT"), [n for n in lines if n] or listed(hints)


_TURNS = T.ArrayType(T.StructType([T.StructField("turn_no", T.IntegerType()), T.StructField("speaker", T.StringType()), T.StructField("text", T.StringType())]))


def _note_turns(with_text: bool):
    @F.pandas_udf(_TURNS)
    def f(transcript: pd.Series, attendees: pd.Series) -> pd.Series:
        return pd.Series([turns(t, listed(a), with_text) for t, a in zip(transcript, attendees)], dtype=object)

    return f


def _source_turns(with_text: bool):
    @F.pandas_udf(_TURNS)
    def f(body: pd.Series, hints: pd.Series) -> pd.Series:
        return pd.Series([turns(*_from_body(b, h), with_text) for b, h in zip(body, hints)], dtype=object)

    return f


def speaker_turns(notes: DataFrame, sources: DataFrame, with_text: bool = True) -> DataFrame:
    """(origin, row_key, turn_no, speaker, text) of all transcripts of both tables."""
    n = notes.where(F.length(F.trim("transcript")) > 2).select(F.lit("granola_notes").alias("origin"), F.col("row_id").alias("row_key"), _note_turns(with_text)("transcript", F.coalesce("attendees", "participants")).alias("_t"))
    s = sources.where(F.col("body").contains("[TRANSCRIPT]")).select(F.lit("sources").alias("origin"), F.col("source_seq").alias("row_key"), _source_turns(with_text)("body", "attendee_hints").alias("_t"))
    return n.unionByName(s).select("origin", "row_key", F.inline("_t"))
