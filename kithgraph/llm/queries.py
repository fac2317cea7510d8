"""The queries of the subpackage by name, each (spark, sf_dir) -> DataFrame, and SQL where it can express one."""

from __future__ import annotations

from pyspark.sql import functions as F

from kithgraph.llm import arrivals, mixing, names, neighbours, packing, pii, quality, survivors, transcripts
from kithgraph.session import table


def p2_found(spark, sf_dir):
    """(id_a, id_b) with cosine 0.90 or more, one among the other's 5 most similar of both tables."""
    vectors = table(spark, sf_dir, "graph_nodes").select("id", "embedding").unionByName(table(spark, sf_dir, "entity_candidates").select("id", "embedding"))
    return neighbours.most_similar(vectors, 0.90).select("id_a", "id_b")


def p3_found(spark, sf_dir):
    """(mention_id, candidate_id) of every mention that names a known entry of its workspace."""
    candidates = table(spark, sf_dir, "entity_candidates").drop("embedding", "dossier")
    return names.link(table(spark, sf_dir, "mentions"), table(spark, sf_dir, "sources"), candidates)


def p4_found(spark, sf_dir):
    """(accepted_seq, duplicate_seq) of every arrival that repeats an earlier one of its workspace: the accepted history first, then what arrived since."""
    return arrivals.repeats(table(spark, sf_dir, "sources").select("source_seq", "batch_id", "workspace_id", "external_id", "content_hash", "body", "attendee_hints"))


def p5_found(spark, sf_dir):
    """(origin, row_key, pii_type, pii_text) of every distinct piece of personal data."""
    return pii.pieces(table(spark, sf_dir, "sources").select("source_seq", "body"), table(spark, sf_dir, "claims").select("claim_no", "quote"))


def p6_found(spark, sf_dir):
    """Speaker turns of both tables: (origin, row_key, turn_no, speaker)."""
    notes = table(spark, sf_dir, "granola_notes").select("row_id", "transcript", "attendees", "participants")
    sources = table(spark, sf_dir, "sources").select("source_seq", "body", "attendee_hints")
    return transcripts.speaker_turns(notes, sources, with_text=False).select("origin", "row_key", "turn_no", "speaker")


def p5_masked(spark, sf_dir):
    """(origin, row_key, masked) of every text, its personal data replaced by typed placeholders."""
    s = table(spark, sf_dir, "sources").select(F.lit("sources").alias("origin"), F.col("source_seq").alias("row_key"), pii.mask_text(F.col("body")).alias("masked"))
    return s.unionByName(table(spark, sf_dir, "claims").select(F.lit("claims").alias("origin"), F.col("claim_no").alias("row_key"), pii.mask_text(F.col("quote")).alias("masked")))


def p6_turns(spark, sf_dir):
    """(origin, row_key, turn_no, speaker, text): the cleaned turns of both tables."""
    notes = table(spark, sf_dir, "granola_notes").select("row_id", "transcript", "attendees", "participants")
    sources = table(spark, sf_dir, "sources").select("source_seq", "body", "attendee_hints")
    return transcripts.speaker_turns(notes, sources)


def p7_found(spark, sf_dir):
    """The surviving value of each field of each set of merged entities."""
    return survivors.survivors(table(spark, sf_dir, "entities"))


_PLACEHOLDER_LIST = ", ".join("'" + p + "'" for p in survivors.PLACEHOLDERS)


def _usable(v: str) -> str:
    space = r"[\s\x{00A0}\x{2000}-\x{200B}\x{202F}\x{3000}\x{FEFF}]+"
    t = f"regexp_replace({v}, '^{space}|{space}$', '', 'g')"
    return f"CASE WHEN {t} <> '' AND lower({t}) NOT IN ({_PLACEHOLDER_LIST}) THEN {t} END"


P7_SQL = f"""
WITH RECURSIVE up AS (
  SELECT id, id AS root_id FROM entities WHERE merged_into IS NULL
  UNION ALL
  SELECT e.id, up.root_id FROM entities e JOIN up ON e.merged_into = up.id
), m AS (
  SELECT e.*, up.root_id FROM entities e JOIN up USING (id)
  WHERE up.root_id IN (SELECT root_id FROM up GROUP BY 1 HAVING count(*) > 1)
), c AS (
  SELECT root_id, id, last_seen, updated_at, 'canonical_name' AS field_name, {_usable("canonical_name")} AS v,
    length(regexp_replace({_usable("canonical_name")}, '[^\\p{{L}}]', '', 'g')) AS rank FROM m
  {"".join(f"""
  UNION ALL SELECT root_id, id, last_seen, updated_at, '{f}', coalesce({_usable(f"attributes->'manual_profile'->>'{f}'")}, {_usable(f"attributes->>'{f}'")}),
    CASE WHEN {_usable(f"attributes->'manual_profile'->>'{f}'")} IS NOT NULL THEN 1 ELSE 0 END FROM m""" for f in survivors.FIELDS)}
), r AS (
  SELECT *, row_number() OVER (PARTITION BY root_id, field_name ORDER BY rank DESC, last_seen DESC NULLS LAST, updated_at DESC NULLS LAST, id DESC) AS n
  FROM c WHERE v IS NOT NULL
)
SELECT root_id, field_name, v AS field_value FROM r WHERE n = 1
"""

def p8_packing(spark, sf_dir):
    """(run_name, doc_id, piece_no, tokens, container) of every text in every run."""
    return packing.pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_limits"))


def p8_report(spark, sf_dir):
    """How full the containers of each run are."""
    limits = table(spark, sf_dir, "pack_limits")
    return packing.report(packing.pack(table(spark, sf_dir, "documents"), limits), limits)


def p9_mixture(spark, sf_dir):
    """(doc_id, source, likeliest, tokens, copies) of the texts used."""
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")).drop("member")


def p9_shares(spark, sf_dir):
    """Target and actual share of each source."""
    targets = table(spark, sf_dir, "mix_targets")
    return mixing.shares(mixing.mix(table(spark, sf_dir, "documents"), targets), targets)


def p10_found(spark, sf_dir):
    """doc_id of the documents of which more than half is not natural prose."""
    return quality.not_prose(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_words"))


def p10_statistics(spark, sf_dir):
    """The text statistics of every document."""
    return quality.statistics(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_words"))


P10_STATISTICS_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
line AS (
  SELECT doc_id, count(*) FILTER (regexp_matches(x, '[^\s\x{0B}]')) AS n, count(*) FILTER (regexp_matches(x, '[.!?][ \t]*$')) AS p
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) GROUP BY doc_id
), word AS (
  SELECT doc_id, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(lower(t), '\p{L}+')) AS x FROM d)
  WHERE x IN (SELECT lower(word) FROM common_words WHERE length(word) > 1) GROUP BY doc_id
), k AS (
  SELECT doc_id, len(regexp_extract_all(t, '\p{L}+')) AS w, len(regexp_extract_all(t, '\p{L}')) AS l,
    len(regexp_extract_all(t, '[^\s\x{0B}]')) AS v, len(regexp_extract_all(t, '[^\p{L}\p{N}\s\x{0B}]')) AS s FROM d
)
SELECT doc_id, w AS n_words, round(l::DOUBLE / nullif(w, 0), 6) AS mean_word_length, round(s::DOUBLE / nullif(v, 0), 6) AS symbol_ratio,
  round(p::DOUBLE / nullif(n, 0), 6) AS punctuated_lines, round(coalesce(c, 0)::DOUBLE / nullif(w, 0), 6) AS common_share
FROM k LEFT JOIN line USING (doc_id) LEFT JOIN word USING (doc_id)
"""

QUERIES = {f.__name__: f for f in (p2_found, p3_found, p4_found, p5_found, p5_masked, p6_found, p6_turns, p7_found, p8_packing, p8_report, p9_mixture, p9_shares, p10_found, p10_statistics)}
ORACLES: dict[str, str] = {"p7_found": P7_SQL, "p10_statistics": P10_STATISTICS_SQL}
