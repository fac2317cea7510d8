"""One surviving record for each set of merged records, field by field, by skyline selection.

Every usable value of a field is a candidate with a rank (is it from a manual profile; for the name: its letters),
the recency and the completeness of its record. Candidates of equal rank and completeness are first reduced to the
most recent one, by a partial aggregation; what is left of a set is a few cells, however many rows the set has.
Of these the Pareto-undominated ones form the first layer, and the policy (rank, then recency, then completeness)
picks the survivor in it. A record without a usable value of a field is no candidate, so that the field is filled
from the next layer that has one.

Defined results: null last_seen is oldest; ties go to the later updated_at, then the greater id; malformed
attributes count as empty; records in a merge cycle or under a missing parent belong to no set; repeated rows of one
id count once for the size of a set; a set whose fields are all unusable has no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithgraph.operators.skew import salted_join
from kithgraph.session import written

FIELDS = ("title", "org", "email", "location", "seniority")

# Placeholders that are no value, compared in small letters.
PLACEHOLDERS = ("-", "--", "---", "?", "??", "???", ".", "n/a", "na", "n.a.", "none", "null", "nil", "nan", "undefined", "unknown", "tbd", "tba", "(not set)", "not set", "(none)", "(unknown)", "(null)", "(empty)", "empty", "missing", "not available", "not applicable", "to be determined", "xxx", "_", "#n/a")
_SPACE = r"[\s\x{00A0}\x{2000}-\x{200B}\x{202F}\x{3000}\x{FEFF}]+"
OLDEST = -(2**62)


def usable(value: Column) -> Column:
    """The trimmed value, or null if it is blank or a mere placeholder."""
    v = F.regexp_replace(value, f"^{_SPACE}|{_SPACE}$", "")
    return F.when((v != "") & ~F.lower(v).isin(*PLACEHOLDERS), v)


def roots(entities: DataFrame) -> DataFrame:
    """(id, root_id) of every merged record that leads to a record with null merged_into.

    Only the distinct parents climb, by pointer doubling (a chain of n takes about log2 n rounds), so a root with
    very many records costs one row a round; the records themselves are joined once, hot parents salted.
    """
    links = entities.select("id", "merged_into").dropDuplicates(["id"])
    merged = links.where(F.col("merged_into").isNotNull()).withColumnRenamed("merged_into", "parent")
    step = links.select(F.col("id").alias("parent"), "merged_into")
    climb = written(merged.select("parent").distinct().join(step, "parent").select("parent", F.coalesce("merged_into", "parent").alias("top"), F.col("merged_into").isNull().alias("done")), "climb")
    left = climb.where(~F.col("done")).count()
    while left:
        higher = climb.select(F.col("parent").alias("top"), F.col("top").alias("higher"), F.col("done").alias("ends"))
        climb = written(
            climb.join(higher, "top", "left").select("parent", F.when(F.col("done"), F.col("top")).otherwise(F.coalesce("higher", "top")).alias("top"), (F.col("done") | F.coalesce("ends", F.lit(False))).alias("done")),
            "climb",
        )
        before, left = left, climb.where(~F.col("done")).count()
        if left == before:  # what is left climbs in circles
            break
    return salted_join(merged, climb.where("done").select("parent", F.col("top").alias("root_id")), "parent").select("id", "root_id")


def survivors(entities: DataFrame) -> DataFrame:
    """(root_id, field_name, field_value): the surviving value of each field of each set of two records or more."""
    chain = written(roots(entities), "roots")
    members = chain.unionByName(chain.select("root_id").distinct().select(F.col("root_id").alias("id"), "root_id"))
    manual = ", ".join(f"{f}: STRING" for f in FIELDS)
    a = F.from_json("attributes", f"STRUCT<{manual}, manual_profile: STRUCT<{manual}>>")
    rows = members.join(entities.select("id", "canonical_name", "attributes", "last_seen", "updated_at"), "id").withColumn("_a", a)
    plain, kept = {f: usable(F.col(f"_a.{f}")) for f in FIELDS}, {f: usable(F.col(f"_a.manual_profile.{f}")) for f in FIELDS}
    name = usable(F.col("canonical_name"))
    complete = sum((F.coalesce(kept[f], plain[f]).isNotNull().cast("int") for f in FIELDS), name.isNotNull().cast("int"))
    letters = F.length(F.regexp_replace(name, r"[^\p{L}]", ""))
    candidates = [F.struct(F.lit("canonical_name").alias("field_name"), letters.alias("rank"), name.alias("value"))]
    for f in FIELDS:
        candidates.append(F.struct(F.lit(f).alias("field_name"), F.when(kept[f].isNotNull(), 1).otherwise(0).alias("rank"), F.coalesce(kept[f], plain[f]).alias("value")))
    flat = (
        rows.select("root_id", "id", F.coalesce(F.unix_micros("last_seen"), F.lit(OLDEST)).alias("recency"), F.coalesce(F.unix_micros("updated_at"), F.lit(OLDEST)).alias("updated"), complete.alias("complete"), F.explode(F.array(*candidates)).alias("c"))
        .select("root_id", "id", "recency", "updated", "complete", "c.*")
        .where(F.col("value").isNotNull())
    )
    cells = flat.groupBy("root_id", "field_name", "rank", "complete").agg(F.max(F.struct("recency", "updated", "id", "value")).alias("best"))
    layers = cells.groupBy("root_id", "field_name").agg(F.collect_list(F.struct("rank", "best.recency", "complete", "best.updated", "best.id", "best.value")).alias("all"))

    def dominates(y: Column, x: Column) -> Column:
        no_less = (y["rank"] >= x["rank"]) & (y["recency"] >= x["recency"]) & (y["complete"] >= x["complete"])
        return no_less & ((y["rank"] > x["rank"]) | (y["recency"] > x["recency"]) | (y["complete"] > x["complete"]))

    skyline = F.filter("all", lambda x: ~F.exists("all", lambda y: dominates(y, x)))
    return layers.select("root_id", "field_name", F.array_max(skyline)["value"].alias("field_value"))
