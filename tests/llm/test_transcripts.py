import json

import pytest

from kithgraph.llm.peg import Grammar
from kithgraph.llm.transcripts import Cast, NOTE, clean, is_noise, listed, regions, speaker_turns, turns

PEOPLE = ["Ada Quill", "Bo Ränd", "Cy Ortega"]


def who(text, people=PEOPLE):
    return [(n, s) for n, s, _ in turns(text, people)]


def test_grammar_is_ordered_and_recursive():
    g = Grammar("word <- 'ab' / 'a'\npair <- @word 'c'\nnest <- '(' (nest / ![()] .)* ')'")
    assert g.pattern("pair").fullmatch("abc")["word"] == "ab"
    assert not g.pattern("pair").fullmatch("abbc")
    assert g.pattern("nest").fullmatch("(a(b(c))d)") and not g.pattern("nest").fullmatch("(a(b)")


@pytest.mark.parametrize(
    "text, want",
    [
        ("Ada Quill: one\nada: two\nQuill, Ada: three\nBR: four\nstill four", [(1, "Ada Quill"), (2, "Bo Ränd")]),
        ("[00:00:05] BO RÄND: b\n[00:00:01] A. Quill: a", [(1, "Ada Quill"), (2, "Bo Ränd")]),
        ("**Ada Quill** (0:05): a\n**bo** (0:09): b", [(1, "Ada Quill"), (2, "Bo Ränd")]),
        (">> Ada: a\n>> CO: b", [(1, "Ada Quill"), (2, "Cy Ortega")]),
        ("Ada Quill 0:01\nhello\nBo 0:05\nhi\nand more", [(1, "Ada Quill"), (2, "Bo Ränd")]),
        ("WEBVTT\n\n00:00:01.000 --> 00:00:02.000\n<v Ada Quill>a</v>\n\n00:00:02.000 --> 00:00:03.000\nmore\n\n00:00:03.000 --> 00:00:04.000\n<v Bo>b</v>", [(1, "Ada Quill"), (2, "Bo Ränd")]),
        ("Speaker 1 (Ada Quill): a\nSPEAKER_02: b\nspeaker 1: c", [(1, "Ada Quill"), (2, "Speaker 2"), (3, "Ada Quill")]),
        ("Speaker 1: a\nSpeaker 1 (Ada): b", [(1, "Ada Quill")]),
        ("Ada: a\nBo: Uh, um.\nAda: b\nBo: [laughter (loud)]\nAda: c", [(1, "Ada Quill")]),
        ("Ada: Two things: we ship\nTwo things: more\nBo: (Cy Ortega) spoke", [(1, "Ada Quill"), (2, "Bo Ränd")]),
        ("no label at all\nAda: a", [(1, "Ada Quill")]),
        (json.dumps([{"speaker": "Bo", "text": "late", "start": 9}, {"speaker": "Ada", "text": "early", "start": 1}, {"speaker": None, "text": "also ada", "start": 2}]), [(1, "Ada Quill"), (2, "Bo Ränd")]),
        ("", []), ("   ", []), ("[]", []), (None, []), ("[{broken", []),
    ],
)
def test_turns(text, want):
    assert who(text) == want


def test_clean_text():
    assert NOTE.fullmatch("[inaudible (twice)]") and is_noise("Mm-hmm.") and is_noise("♪") and not is_noise("Um, yes")
    assert clean("Um, the [background noise] plan, you know, is uh... ready.") == "the plan is ready."


def test_cast_leaves_ambiguous_labels_out():
    c = Cast(["Ada Quill", "Ada Ost"])
    assert c.person("Ada") is None and c.person("ADA QUILL") == "Ada Quill" and c.person("Quill, A.") == "Ada Quill"


def test_tables(spark):
    long = "Ada Quill: word\n" * 20000
    n = spark.createDataFrame([(1, "Ada: a\nBo: b", '["Ada Quill <a@x.test> — X"]', None), (1, "Ada: a\nBo: b", '["Ada Quill <a@x.test> — X"]', None), (2, None, None, None), (3, long, '[{"name": "Ada Quill"}]', None), (4, "Ada: a", "no json", None)], "row_id long, transcript string, attendees string, participants string").selectExpr("*", "1 AS turn_no", "'x' AS origin")
    s = spark.createDataFrame([(9, "[ATTENDEES]\r\n- Bo Ränd — Y\r\n\r\n[TRANSCRIPT]\r\nBO: hi\r\n[NOTES]\r\nAda: no", None), (8, None, None), (7, "", None)], "source_seq long, body string, attendee_hints string")
    got = sorted((r["origin"], r["row_key"], r["turn_no"], r["speaker"]) for r in speaker_turns(n, s).collect())
    assert got == [("granola_notes", 1, 1, "Ada Quill"), ("granola_notes", 1, 1, "Ada Quill"), ("granola_notes", 3, 1, "Ada Quill"), ("sources", 9, 1, "Bo Ränd")]
    assert speaker_turns(n.limit(0), s.limit(0)).count() == 0
    assert listed("5") == [] and regions("[NOTES]\na\n[NOTES]\nb") == {"NOTES": "a\nb"}


def test_noise_of_any_length_and_capitalised_sounds():
    long = "Ada Quill: Hello there.\nBo Rand: " + "um, " * 60 + "\nAda Quill: [Laughter]\nAda Quill: Bye."
    assert turns(long, ["Ada Quill", "Bo Rand"]) == [(1, "Ada Quill", "Hello there. Bye.")]
    wordy = "Ada Quill: " + "word " * 40 + "at 10:30 we met"
    assert [t[1] for t in turns(wordy, ["Ada Quill"])] == ["Ada Quill"]
