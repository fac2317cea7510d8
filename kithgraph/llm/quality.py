"""Per-document text statistics, and text types by weak supervision over them.

All statistics are built-in expressions evaluated inside code generation. A text is cut into units (lines, with
soft-wrapped lines joined); thresholds on a unit's statistics are noisy labelling functions that vote prose, not
prose, or abstain. The votes of a unit form one small code; expectation-maximization learns each function's
behaviour in both classes from the agreements alone, on the counts of distinct codes (at most 3^10 of them, whatever
the size of the data). A document is not prose if more than half of its characters are expected to be none.

Defined results: null, empty and blank texts have word count 0, null ratios and no type; lines are separated by any
line break; repeated documents get equal rows; documents of any length are processed whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithgraph.session import written

#: A list of common words longer than this is refused: it becomes part of a pattern.
MOST_WORDS = 5000
FUNCTIONS = ("repeat", "common", "grammar", "symbols", "digits", "sentences", "word_length", "layout", "single_letters", "vowels")
PROSE, JUNK, ABSTAIN = 0, 1, 2


def _trie(words: list[str]) -> str:
    """An alternation of words sharing prefixes, so that a match costs the length of the word."""
    root: dict = {}
    for w in words:
        at = root
        for c in w:
            at = at.setdefault(c, {})
        at[""] = {}

    def emit(node: dict) -> str:
        ways = [c + emit(n) for c, n in sorted(node.items()) if c]
        if not ways:
            return ""
        body = ways[0] if len(ways) == 1 else "(?:" + "|".join(ways) + ")"
        return f"(?:{body})?" if "" in node else body

    return emit(root)


def common_pattern(common_words: DataFrame, least: int = 2) -> str:
    """The pattern of all common words of `least` letters or more, of any language."""
    words = [r["word"] for r in common_words.where(F.length("word") >= least).select(F.lower("word").alias("word")).distinct().limit(MOST_WORDS + 1).collect()]
    if len(words) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} common words")
    return rf"(?<!\p{{L}})(?:{_trie(words)})(?!\p{{L}})" if words else r"(?!)"


WORD = r"\p{L}+"


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def _chars(text: Column, letters: str) -> Column:
    """Characters of a class, taken away run by run and not counted one by one."""
    return (F.length(text) - F.length(F.regexp_replace(text, f"{letters}+", ""))).cast("double")


def statistics(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """(doc_id, n_words, mean_word_length, symbol_ratio, punctuated_lines, common_share) of every document."""
    t = F.coalesce("text", F.lit(""))
    words, letters = _count(t, WORD), _chars(t, r"\p{L}")
    lines = _count(t, r"(?m)^.*\S.*$")
    visible = _chars(t, r"\S")
    pattern = common_pattern(common_words)
    return documents.select(
        "doc_id",
        words.cast("long").alias("n_words"),
        F.round(letters / F.nullif(words, F.lit(0.0)), 6).alias("mean_word_length"),
        F.round(_chars(t, r"[^\p{L}\p{N}\s]") / F.nullif(visible, F.lit(0.0)), 6).alias("symbol_ratio"),
        F.round(_count(t, r"(?m)[.!?][ \t]*$") / F.nullif(lines, F.lit(0.0)), 6).alias("punctuated_lines"),
        F.round(_count(F.lower(t), pattern) / F.nullif(words, F.lit(0.0)), 6).alias("common_share"),
    )


def _vote(junk: Column, prose: Column) -> Column:
    return F.when(junk, JUNK).when(prose, PROSE).otherwise(ABSTAIN)


def unit_votes(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """(doc_id, code, chars) of every distinct unit: its votes as a base-3 code, its characters with repeats."""
    text = F.regexp_replace("text", r"\r\n?|[\x0B\x0C\x{85}\x{2028}\x{2029}]", "\n")
    joined = F.regexp_replace(text, r"(?<=[\p{L},;])[ \t]*\n[ \t]*(?=\p{Ll})|(?<=[a-z,;])[ \t]*\n[ \t]*(?=\p{L}[\p{L} ]{1,30} [^:\n]{12})", " ")
    rows = documents.where(F.col("text").rlike(r"\S")).select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    units = rows.select("doc_id", "row", F.explode(F.filter(F.split(joined, r"\n+"), lambda u: F.trim(u) != "")).alias("raw"))
    u = F.regexp_replace(F.trim("raw"), r"^\p{L}[\p{L} .'’-]{1,40}: (?=.{25})", "")
    lower = F.lower("u")
    f = units.select("doc_id", "row", u.alias("u"), F.length("raw").alias("chars")).select(
        "doc_id",
        "row",
        "chars",
        "u",
        F.xxhash64("u").alias("h"),
        F.length("u").cast("double").alias("n"),
        _count(F.col("u"), WORD).alias("words"),
        _chars(F.col("u"), r"\p{L}").alias("letters"),
        _chars(F.col("u"), r"\p{N}").alias("digits"),
        _chars(F.col("u"), r"[^\p{L}\p{M}\p{N}\s.,;:'’\"“”!?()\-—–…]").alias("symbols"),
        _count(F.col("u"), r"(?<!\p{L})\p{L}(?!\p{L})").alias("singles"),
        _count(lower, r"(?<!\p{L})[bcdfghjklmnpqrstvwxz]{3,}(?!\p{L})|[bcdfghjklmnpqrstvwxz]{6,}").alias("voiceless"),
        _count(F.col("u"), r"[.!?…](?=[\s\"'”’)]|$)").alias("ends"),
        _count(lower, common_pattern(common_words, 1)).alias("common"),
        F.col("u").rlike(r"^(?:[•*–—|<{}\[\]]|- |\d+[.)] |#)|\t|\|.*\||</|\">|\"\s*:\s|,\S[^,]*,\S[^,]*,\S|\S{40}|(?:^|\s)[#@]\p{L}+\s.*[#@]\p{L}|^\p{Lu}[\p{L} ]{0,20}: ?\S{0,3}[^.!?]{0,40}$| > ").alias("laid_out"),
    )
    w = F.col("words")
    per = lambda a: F.col(a) / F.greatest(w, F.lit(1.0))
    of = lambda a: F.col(a) / F.col("n")
    votes = {
        "common": F.when(w < 4, ABSTAIN).otherwise(_vote(per("common") <= 0.08, per("common") >= 0.16)),
        "grammar": F.when(w < 12, ABSTAIN).otherwise(_vote(per("common") <= 0.05, per("common") >= 0.1)),
        "symbols": _vote(of("symbols") >= 0.06, of("symbols") <= 0.015),
        "digits": _vote(of("digits") >= 0.15, of("digits") <= 0.04),
        "sentences": F.when(F.col("ends") > 0, _vote(w / F.col("ends") < 4, (w / F.col("ends") >= 5) & (w / F.col("ends") <= 30))).otherwise(_vote(w <= 7, F.lit(False))),
        "word_length": _vote((per("letters") < 2.8) | (per("letters") > 8), (per("letters") >= 3.3) & (per("letters") <= 6.8)),
        "layout": _vote(F.col("laid_out"), w >= 8),
        "single_letters": F.when(w < 5, ABSTAIN).otherwise(_vote(per("singles") >= 0.15, per("singles") <= 0.08)),
        "vowels": F.when(w < 5, ABSTAIN).otherwise(_vote(per("voiceless") >= 0.1, per("voiceless") <= 0.03)),
    }
    names = FUNCTIONS[1:]
    code = sum((votes[k] * (3**i) for i, k in enumerate(names, 1)), F.lit(0))
    silent = ABSTAIN * sum(3**i for i in range(1, len(FUNCTIONS)))  # what is said again and again tells nothing else
    same = f.groupBy("doc_id", "row", "h").agg(F.count("*").alias("times"), F.sum("chars").alias("chars"), F.max(code).alias("code"))
    again = F.col("times") >= 3
    return same.select("doc_id", F.when(again, JUNK + silent).otherwise(F.col("code") + ABSTAIN).cast("int").alias("code"), "chars")


def learn(codes: np.ndarray, weights: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, dict]:
    """Posteriors of not being prose, per code, by expectation-maximization over the functions' agreements."""
    votes = np.stack([(codes // 3**i) % 3 for i in range(len(FUNCTIONS))], axis=1)
    for_junk, for_prose = (votes == JUNK).sum(1), (votes == PROSE).sum(1)
    post = (for_junk + 0.5) / (for_junk + for_prose + 1.0)
    for k in ("common", "repeat"):  # the first guess of the classes: what people say is tied together by common words
        v = votes[:, FUNCTIONS.index(k)]
        post = np.where(v == JUNK, 0.9, np.where(v == PROSE, 0.1, post))
    again = votes[:, FUNCTIONS.index("repeat")] == JUNK  # no prose by definition, so not left to be learned
    one_hot = np.stack([votes == v for v in (PROSE, JUNK, ABSTAIN)], axis=2).astype(float)
    for _ in range(rounds):
        share = np.clip((weights * post).sum() / weights.sum(), 0.02, 0.98)
        tables = []
        for p in (1 - post, post):
            counts = np.einsum("n,nfv->fv", weights * p, one_hot) + 1.0
            tables.append(counts / counts.sum(1, keepdims=True))
        logs = [np.log(c) + np.einsum("nfv,fv->n", one_hot, np.log(t)) for c, t in zip((1 - share, share), tables)]
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
        new[again] = 0.99
        if np.abs(new - post).max() < 1e-7:
            break
        post = new
    return post, {"share": float(share), "prose": tables[0], "junk": tables[1]}


def text_types(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """(doc_id, junk_share): the expected share of characters that are not natural prose."""
    votes = written(unit_votes(documents, common_words), "votes")
    seen = votes.groupBy("code").agg(F.sum("chars").alias("n")).orderBy("code").collect()  # at most 3^10 codes
    if not seen:
        return votes.select("doc_id", F.lit(0.0).alias("junk_share"))
    codes, weights = np.array([r["code"] for r in seen]), np.array([float(r["n"]) for r in seen])
    post, _ = learn(codes, weights)
    table = votes.sparkSession.createDataFrame([(int(c), float(p)) for c, p in zip(codes, post)], "code int, p double")
    scored = votes.join(F.broadcast(table), "code")
    return scored.groupBy("doc_id").agg((F.sum(F.col("chars") * F.col("p")) / F.sum("chars")).alias("junk_share"))


def not_prose(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """doc_id of the documents of which more than half is not natural prose."""
    return text_types(documents, common_words).where(F.col("junk_share") > 0.5).select("doc_id")
