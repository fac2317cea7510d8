import numpy as np

from kithgraph.llm import pii
from kithgraph.llm.tagger import Tagger, encode


def found(text):
    return {(pii.TYPES[k], text[s:e]) for s, e, k in pii.find([text])[0]}


def test_pieces():
    text = (
        "[ATTENDEES]\n- Robert Teskian <robert.t@hq-brimfin.test> — Brimfin Foods\n\n[TRANSCRIPT]\n[00:00:12] Teskian, Robert: Call back on +44 20 7946 0633 after six. Version 10.4.212 broke the export.\n"
        "deborah wendebaeva: Moved to 1397 Bellmead Terrace, Apt 3B in spring. Tax ID QQ 27 87 36 B still needs checking.\nThe Main Street index fell 2.12 percent. Contact: anjali.ostelsky92 at vantacore dot example dot com\n"
        "Text four eight three, five five five, oh one one seven when you land. Order 000-88-41 shipped on 2024-03-12."
    )
    assert found(text) == {
        ("person_name", "Robert Teskian"), ("email", "robert.t@hq-brimfin.test"), ("person_name", "Teskian, Robert"), ("phone", "+44 20 7946 0633"), ("person_name", "deborah wendebaeva"), ("street_address", "1397 Bellmead Terrace, Apt 3B"),
        ("id_number", "QQ 27 87 36 B"), ("email", "anjali.ostelsky92 at vantacore dot example dot com"), ("phone", "four eight three, five five five, oh one one seven"),
    }


def test_masking_keeps_the_rest():
    text = "Ping ann.lee@x.example.org about the data room. We booked 5550 units for Q4."
    assert pii.masked(text, pii.find([text])[0]) == "Ping [EMAIL] about the data room. We booked 5550 units for Q4."


def test_long_text_is_read_whole_and_windows_agree():
    filler = "nobody on the grid storage side priced the workshop before the summer. " * 3000
    text = filler + "Ping ann.lee@x.example.org about it. " + filler
    assert found(text) == {("email", "ann.lee@x.example.org")}
    crowd = " ".join(f"Ask Patricia Klimardi about {i}0." for i in range(60))  # one stretch over many windows
    assert found(crowd) == {("person_name", "Patricia Klimardi")}


def test_pieces_the_tables_do_not_hold():
    assert found("We met Hiroshi Tanaka and Lucia Moretti.") == {("person_name", "Hiroshi Tanaka"), ("person_name", "Lucia Moretti")}
    assert found("Мы встретили Сергей Волков вчера.") == {("person_name", "Сергей Волков")}
    assert found("She lives at Via Garibaldi 14 now.") == {("street_address", "Via Garibaldi 14")}
    assert found("Reach me at 0171 2345678 after six.") == {("phone", "0171 2345678")}
    assert found("We met Anna van der Berg yesterday.") == {("person_name", "Anna van der Berg")}
    assert found("IBAN DE89 3704 0044 0532 0130 00 is on the invoice.") == set()


def test_lines_that_cannot_hold_a_piece_are_those_without_one():
    m = Tagger(4, 5, seed=3)
    m.p["t"] = np.random.default_rng(1).standard_normal((5, 5)).astype(np.float32)
    texts = ["\n" + "".join(np.random.default_rng(i).choice(list("abcAB 12."), 12)) for i in range(300)]
    x, lengths = encode(texts)
    e = m.emissions(x, lengths)
    e[:, :, 0] += 3.5
    silent = m.silent(e, lengths)
    tags = m.viterbi(e, lengths)
    assert silent.any() and not tags[silent].any()


def test_table(spark):
    s = spark.createDataFrame([(1, "cc bo.rand@x.test on the thread"), (1, "cc bo.rand@x.test on the thread"), (2, None), (3, ""), (4, "nothing here")], "source_seq long, body string").selectExpr("*", "'x' AS origin", "'y' AS t")
    c = spark.createDataFrame([(7, "Ping bo.rand@x.test about bo.rand@x.test now"), (8, None)], "claim_no long, quote string")
    got = sorted((r["origin"], r["row_key"], r["pii_type"], r["pii_text"]) for r in pii.pieces(s, c).collect())
    assert got == [("claims", 7, "email", "bo.rand@x.test"), ("sources", 1, "email", "bo.rand@x.test"), ("sources", 1, "email", "bo.rand@x.test")]
    assert pii.pieces(s.limit(0), c.limit(0)).count() == 0
    assert [r[0] for r in s.select(pii.mask_text(s["body"])).collect()] == ["cc [EMAIL] on the thread"] * 2 + [None, "", "nothing here"]


def test_gradients_are_those_of_the_loss():
    m = Tagger(3, 3, seed=1)
    x, lengths = encode(["ab1", "Zq"])
    y = np.array([[0, 1, 2], [1, 2, 0]])
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    _, g = m.loss_and_gradients(x, lengths, y)
    for k in m.p:
        for at in [tuple(i) for i in np.argwhere(np.abs(g[k]) > 1e-4)[:4]]:
            old, h = m.p[k][at], 1e-3
            m.p[k][at] = old + h
            up, _ = m.loss_and_gradients(x, lengths, y)
            m.p[k][at] = old - h
            down, _ = m.loss_and_gradients(x, lengths, y)
            m.p[k][at] = old
            assert abs((up - down) / (2 * h) - g[k][at]) < 2e-3, (k, at)


def test_viterbi_equals_enumeration():
    import itertools

    m = Tagger(4, 3, seed=2)
    m.p["t"] = np.random.default_rng(0).standard_normal((3, 3)).astype(np.float32)
    x, lengths = encode(["abcd", "xy"])
    e = m.emissions(x, lengths)
    best = m.viterbi(e, lengths)
    for b, n in enumerate(lengths):
        score = lambda p: m.p["s"][p[0]] + sum(e[t, b, p[t]] for t in range(n)) + sum(m.p["t"][p[t - 1], p[t]] for t in range(1, n))  # noqa: B023, E731
        assert tuple(best[b, :n]) == max(itertools.product(range(3), repeat=int(n)), key=score)


def test_viterbi_inside_words_equals_enumeration():
    import itertools

    m = Tagger(4, 5, seed=2)
    m.p["t"] = np.random.default_rng(0).standard_normal((5, 5)).astype(np.float32)
    x, lengths = encode(["ab c", "xyz", "a"])
    e = m.emissions(x, lengths) * 3
    inside = np.array([[False, True, False, False], [False, True, True, False], [False] * 4])
    best = m.viterbi(e, lengths, inside)
    leads_on = lambda p, q: q == p and p % 2 == 0 or q % 2 == 0 and 0 < q == p + 1
    for b, n in enumerate(lengths):
        cost = lambda p, t: m.p["t"][p[t - 1], p[t]] if not inside[b, t] or leads_on(p[t - 1], p[t]) else -1e4  # noqa: B023, E731
        score = lambda p: m.p["s"][p[0]] + sum(e[t, b, p[t]] for t in range(n)) + sum(cost(p, t) for t in range(1, n))  # noqa: B023, E731
        assert tuple(best[b, :n]) == max(itertools.product(range(5), repeat=int(n)), key=score)


def test_spans_are_read_in_steps_by_pieces_not_by_places():
    import sys

    from kithgraph.llm.pii import spans_of

    def one_by_one(tags):
        out, i = [], 0
        while i < len(tags):
            j, kind = i + 1, (int(tags[i]) - 1) // 2
            if tags[i]:
                while j < len(tags) and tags[j] == 2 * kind + 2:
                    j += 1
                out.append((i, j, kind))
            i = j
        return out

    r = np.random.default_rng(3)
    for n in (0, 1, 2, 40, 300):
        for _ in range(30):
            tags = r.integers(0, 11, n) * (r.random(n) < 0.8)
            tags = np.repeat(tags, r.integers(1, 4, n))
            assert spans_of(tags) == one_by_one(tags)
    tags, steps = np.zeros(20_000, np.int64), []
    tags[500:900], tags[19_999] = 2, 9
    trace = lambda frame, event, arg: steps.append(event) or trace
    before = sys.gettrace()
    sys.settrace(trace)
    try:
        found = spans_of(tags)
    finally:
        sys.settrace(before)
    assert found == [(500, 900, 0), (19_999, 20_000, 4)] and len(steps) < 100


def test_letters_of_words_are_looked_up_as_they_were_asked():
    from kithgraph.llm.tagger import UNCASED, inside_words, symbols

    texts = ["Zoë O’Neil, 3rd fl.", "", "東京 Łódź №5 ½x²", "é́t \U0001f600a1\ud800b"]
    width = max(map(len, texts))
    for got, t in zip(inside_words(texts, width), texts):
        letter = [c.isalnum() and s != UNCASED for c, s in zip(t, symbols(t))] + [False] * (width - len(t))
        assert got.tolist() == [i > 0 and letter[i] and letter[i - 1] for i in range(width)]


def test_only_stretches_that_may_hold_a_piece_are_decoded(monkeypatch):
    decoded = []
    viterbi = Tagger.viterbi
    monkeypatch.setattr(Tagger, "viterbi", lambda self, e, *rest: decoded.append(e.shape[0] * e.shape[1]) or viterbi(self, e, *rest))
    filler = "nobody on the grid storage side priced the workshop before the summer. "
    text = "\n".join(f"{4 * filler}Ping ann.lee{i}@x.example.org about it. {4 * filler}" for i in range(40))
    assert found(text) == {("email", f"ann.lee{i}@x.example.org") for i in range(40)}
    assert 0 < sum(decoded) < len(text) / 2


def test_stretches_decoded_alone_have_the_tags_of_whole_texts():
    from kithgraph.llm.tagger import inside_words

    m, r = Tagger(4, 5, seed=5), np.random.default_rng(7)
    texts = ["\n" + "".join(r.choice(list("abcAB 12.  "), n)) for n in r.integers(1, 60, 400)] + ["x", " "]
    x, lengths = encode(texts)
    inside, pieces, cut = inside_words(texts, x.shape[1]), 0, 0
    for bias in (1.0, 2.5, 4.0):
        m.p["t"] = r.standard_normal((5, 5)).astype(np.float32) - np.float32([[0], [2], [2], [2], [2]]) * np.eye(1, 5, dtype=np.float32)
        m.p["s"] = r.standard_normal(5).astype(np.float32)
        e = (r.standard_normal((x.shape[1], len(texts), 5)) * 2).astype(np.float32)
        e[:, :, 0] += bias
        whole, own = m.viterbi(e, lengths, inside), np.zeros(x.shape, np.int64)
        stretches = m.cut(e, lengths, texts)
        for (n, start, _, _), tags in zip(stretches, m.decode([s[2:] for s in stretches], 7)):
            own[n, start : start + len(tags)] = tags
        assert (own == whole).all()
        pieces, cut = pieces + (whole > 0).sum(), cut + sum(len(s[2]) for s in stretches)
    assert pieces > 1000 and cut < 2.5 * lengths.sum()


def test_the_runtime_emits_what_numpy_does():
    import pytest

    from kithgraph.llm import recurrent

    pytest.importorskip("onnxruntime")
    m, r = Tagger(5, 7, seed=4), np.random.default_rng(2)
    for shape in ((1, 1), (9, 3), (60, 40)):
        x = r.integers(0, len(m.p["xf"]), shape)
        for d, w in (("f", m.p["w"][:5]), ("b", m.p["w"][5:])):
            got = recurrent.emissions(m.p[f"x{d}"], m.p[f"u{d}"], w)(x)
            assert got.shape == (*shape, 7) and np.abs(got - m._states(d, x) @ w).max() < 1e-5
    before = m._emitted("f", x)
    m.p["xf"] = m.p["xf"] * 2
    assert np.abs(m._emitted("f", x) - m._states("f", x) @ m.p["w"][:5]).max() < 1e-5 < np.abs(m._emitted("f", x) - before).max()


def test_without_the_runtime_the_same_pieces_are_found(monkeypatch):
    from kithgraph.llm import recurrent

    text = "deborah wendebaeva: Moved to 1397 Bellmead Terrace, Apt 3B in spring.\nWe met Hiroshi Tanaka, +44 20 7946 0633."
    with_runtime = pii.find([text], Tagger.load(pii.WEIGHTS))
    monkeypatch.setattr(recurrent, "onnxruntime", None)
    pii._seen.clear()
    assert len(with_runtime[0]) == 4 and pii.find([text], Tagger.load(pii.WEIGHTS)) == with_runtime
