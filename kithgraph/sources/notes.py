"""Readers of meeting notes: JSON notes with field fallbacks, Markdown exports, region-tagged bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ATTENDEE = "struct<name:string,email:string,company:string>"


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, value) of the .json, .md and .txt files directly in a folder, whole, by name."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file_name"), "value")
    return files.where(F.lower("file_name").rlike(r"\.(json|md|txt)$")).orderBy("file_name")


def is_json(c: Column) -> Column:
    return F.ltrim(c).startswith("{") & F.try_parse_json(c).isNotNull()


# The patterns of addresses and of date lines.
_MONTH_DAY = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2},?\s+\d{4}"
_MAIL = r"[\w.+-]+@[\w.-]+\.\w+"


def attendee(item: Column) -> Column:
    """struct(name, email, company) of `Name <email> — Company`; the e-mail stands in for a missing name."""
    tagged, bare = F.regexp_extract(item, "<([^>]+)>", 1), F.regexp_extract(item, f"({_MAIL})", 1)
    email = F.when(tagged != "", tagged).when(bare != "", bare)
    parts = F.split(F.regexp_replace(F.regexp_replace(item, "<[^>]+>", ""), _MAIL, ""), r"\s+[—–-]\s+")
    name = F.regexp_replace(F.trim(F.get(parts, F.lit(0))), "[,;]$", "")
    company = F.trim(F.get(parts, F.lit(1)))
    return F.struct(F.when(name != "", name).otherwise(email).alias("name"), email.alias("email"), F.when(company != "", company).alias("company"))


def attendees(c: Column) -> Column:
    """array<struct> of a JSON array of strings or objects; items with neither name nor e-mail are skipped."""
    items = F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))

    def one(x: Column) -> Column:
        o = F.from_json(x, ATTENDEE)
        return F.when(F.ltrim(x).startswith("{"), F.struct(F.coalesce(o["name"], o["email"]).alias("name"), o["email"].alias("email"), o["company"].alias("company"))).otherwise(attendee(x))

    return F.filter(F.transform(items, one), lambda a: F.coalesce(a["name"], F.lit("")) != "")


def flat_transcript(c: Column) -> Column:
    """`speaker: text` lines of a JSON array of {speaker, text}; other text trimmed."""
    rows = F.from_json(c, "array<struct<speaker:string,text:string>>")
    line = F.transform(rows, lambda s: F.trim(F.concat(F.when(F.coalesce(s["speaker"], F.lit("")) != "", F.concat(s["speaker"], F.lit(": "))).otherwise(""), F.coalesce(s["text"], F.lit("")))))
    flat = F.array_join(F.filter(line, lambda x: x != ""), "\n")
    return F.when(F.ltrim(c).rlike(r"^\[\s*(\{|\])"), F.coalesce(flat, F.lit(""))).otherwise(F.coalesce(F.trim(c), F.lit("")))


def body(people: Column, summary: Column, notes: Column, transcript: Column) -> Column:
    """The region-tagged text; empty regions are left out."""
    line = F.transform(people, lambda a: F.concat(F.lit("- "), a["name"], F.coalesce(F.concat(F.lit(" <"), a["email"], F.lit(">")), F.lit("")), F.coalesce(F.concat(F.lit(" — "), a["company"]), F.lit(""))))
    region = lambda tag, v: F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"[{tag}]\n"), v))
    return F.concat_ws("\n\n", region("ATTENDEES", F.array_join(line, "\n")), region("SUMMARY", summary), region("NOTES", notes), region("TRANSCRIPT", transcript))


def content_hash(title: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws("\n", title, text), 256)


def token_estimate(c: Column) -> Column:
    return F.ceil(F.length(c) / 3.8).cast("int")


def display_transcript(raw: Column, fallback: Column) -> Column:
    t = F.get_json_object(raw, "$.transcript")
    return F.when(F.trim(t) != "", t).otherwise(fallback)


def first_date(*candidates: Column) -> Column:
    """The first candidate that is an ISO date or time, or `Mon d, yyyy`."""
    tries = []
    for c in candidates:
        iso = F.regexp_extract(c, r"^\s*(\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?)?(?:Z|[+-]\d{2}:?\d{2})?)\s*$", 1)
        named = F.regexp_replace(F.initcap(F.regexp_extract(c, rf"(?i)^\s*({_MONTH_DAY})\s*$", 1)), r"^([A-Z][a-z]{2})[a-z]*\s+(\d{1,2}),?\s+(\d{4})$", "$1 $2 $3")
        tries += [F.try_to_timestamp(F.when(iso != "", iso)), F.try_to_timestamp(F.when(named != "", named), F.lit("MMM d yyyy"))]
    return F.coalesce(*tries)


def date_line(text: Column) -> Column:
    """The first date in the first 12 lines."""
    head = F.array_join(F.slice(F.split(text, "\n"), 1, 12), "\n")
    found = F.regexp_extract(head, rf"(?i)(\d{{4}}-\d{{2}}-\d{{2}}|{_MONTH_DAY})", 1)
    return F.when(found != "", found)


def read_json_notes(notes: DataFrame) -> DataFrame:
    """Notes with the fields of the raw table to normalised sources; an empty summary wins over a later key."""
    c = F.col
    people = attendees(F.coalesce(c("attendees"), c("participants")))
    summary, detail = F.trim(F.coalesce("ai_summary", "summary", F.lit(""))), F.trim(F.coalesce("notes_markdown", "notes", F.lit("")))
    out = notes.select("row_id", "workspace_id", F.trim(F.coalesce("title", F.lit("Untitled meeting"))).alias("title"), F.col("id").alias("external_id"), first_date(c("created_at"), c("createdat"), c("note_date")).alias("occurred_at"), people.alias("attendee_hints"), summary.alias("s"), detail.alias("n"), flat_transcript(c("transcript")).alias("t"))
    out = out.withColumn("body", body(c("attendee_hints"), c("s"), c("n"), c("t"))).drop("s", "n", "t")
    return out.withColumn("content_hash", content_hash(c("title"), c("body"))).withColumn("token_estimate", token_estimate(c("body")))


# Heading words of each section, in order of priority.
SECTIONS = [("attendees", "attend|participant|people|invit"), ("summary", "summary|overview|recap|takeaway"), ("transcript", "transcript|conversation|dialogue"), ("notes", "note|detail|discussion")]


def sections(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section, content): heading-driven sections of Markdown; the last section of a kind wins.

    Gaps and islands on the lines of a text inside one array, so a text is never spread over tasks.
    """
    lines = F.split(F.replace(F.col(text), F.lit("\r\n"), F.lit("\n")), "\n")
    heading = lambda l: F.regexp_extract(l, r"^#{1,3}\s+(.*)$", 1)
    kind = F.lit("")
    of = lambda h: F.when(h.rlike(SECTIONS[0][1]), SECTIONS[0][0]).when(h.rlike(SECTIONS[1][1]), SECTIONS[1][0]).when(h.rlike(SECTIONS[2][1]), SECTIONS[2][0]).when(h.rlike(SECTIONS[3][1]), SECTIONS[3][0]).otherwise(kind)
    parts = F.filter(F.split(F.concat(F.lit("\n"), F.array_join(lines, "\n")), r"\n(?=#{1,3}\s)"), lambda p: p != "")
    named = F.transform(parts, lambda p: F.struct(of(F.lower(heading(F.split_part(p, F.lit("\n"), F.lit(1))))).alias("section"), F.trim(F.regexp_replace(p, r"^[^\n]*\n?", "")).alias("content")))
    rows = texts.select(key, F.posexplode(F.filter(named, lambda x: x["section"] != "")).alias("pos", "x")).where("x.content <> ''")
    return rows.groupBy(key, "x.section").agg(F.max_by("x.content", "pos").alias("content")).select(key, "section", "content")


def read_markdown(texts: DataFrame, key: str, text: str, fallback_title: str = "Pasted meeting") -> DataFrame:
    """Markdown exports to normalised sources; the whole text is the transcript if there is no summary and no notes."""
    c = F.col(text)
    found = F.regexp_extract(c, r"(?m)^#\s+(.*)$", 1)
    s = sections(texts, key, text).groupBy(key).pivot("section", [k for k, _ in SECTIONS]).agg(F.first("content"))
    x = texts.join(s, key, "left")
    items = F.filter(F.transform(F.split(F.coalesce("attendees", F.lit("")), "\n"), lambda l: F.trim(F.regexp_replace(l, r"^[-*]\s*", ""))), lambda l: l != "")
    whole = F.trim(F.regexp_replace(c, r"(?m)^#\s+.*$", ""))
    transcript = F.coalesce("transcript", F.when(F.coalesce("summary", "notes").isNotNull(), F.lit("")).otherwise(whole))
    out = x.select(key, F.when(found != "", F.trim(found)).otherwise(fallback_title).alias("title"), first_date(date_line(c)).alias("occurred_at"), F.transform(items, attendee).alias("attendee_hints"), F.coalesce("summary", F.lit("")).alias("s"), F.coalesce("notes", F.lit("")).alias("n"), transcript.alias("t"))
    out = out.withColumn("body", body(F.col("attendee_hints"), F.col("s"), F.col("n"), F.col("t"))).drop("s", "n", "t")
    return out.withColumn("content_hash", content_hash(F.col("title"), F.col("body"))).withColumn("token_estimate", token_estimate(F.col("body")))
