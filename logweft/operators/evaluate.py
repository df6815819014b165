"""Evaluation of mines: counts by template and identifier, partition metrics, fixed shuffles."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbering import numbered
from ..functions.tokens import identifier

SHUFFLE = "sha256-sort-v1"


def assignments(lines: DataFrame, labels: DataFrame, texts: DataFrame, contributors: DataFrame) -> DataFrame:
    """(row_id, label, template, contributor, identifier, message); texts (label, text).  Every label needs a template and every template a label, or an error is raised."""
    x = lines.join(labels, "row_id").join(texts, "label", "left")
    lost = texts.join(labels, "label", "left_anti")
    if not lost.isEmpty() or not labels.join(texts, "label", "left_anti").isEmpty():
        raise ValueError("labels of rows and labels of templates differ")
    flag = contributors.select("row_id").distinct().withColumn("contributor", F.lit(True))
    return x.join(flag, "row_id", "left").select("row_id", "label", F.col("text").alias("template"), F.coalesce("contributor", F.lit(False)).alias("contributor"), identifier(F.col("raw")).alias("identifier"), F.col("raw").alias("message"))


def component_counts(labels: DataFrame, excluded: DataFrame, contributors: DataFrame) -> DataFrame:
    """(label, members, lof_excluded, accidental, excluded, support); labels (row_id, label), excluded and contributors (row_id)."""
    x = labels.join(excluded.select("row_id").distinct().withColumn("e", F.lit(1)), "row_id", "left").join(contributors.select("row_id").distinct().withColumn("c", F.lit(1)), "row_id", "left")
    n = x.groupBy("label").agg(F.count(F.lit(1)).alias("members"), F.count("e").alias("lof_excluded"), F.count("c").alias("support"))
    return n.select("label", "members", "lof_excluded", (F.col("members") - F.col("lof_excluded") - F.col("support")).alias("accidental"), (F.col("members") - F.col("support")).alias("excluded"), "support")


def identifier_counts(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("identifier").agg(F.count(F.lit(1)).alias("messages"))


def fragmentation(assigned: DataFrame) -> DataFrame:
    """(identifier, labels, templates, fragmented)."""
    return assigned.groupBy("identifier").agg(F.count_distinct("label").alias("labels"), F.array_sort(F.collect_set("label")).alias("templates")).withColumn("fragmented", F.col("labels") > 1)


def mixed(assigned: DataFrame) -> DataFrame:
    """(label, identifiers) of templates with more than one identifier."""
    return assigned.groupBy("label").agg(F.count_distinct("identifier").alias("identifiers")).where("identifiers > 1")


def distinct_examples(assigned: DataFrame, k: int = 3) -> DataFrame:
    """(label, rank, message): the first k distinct messages of each label, by row."""
    first = assigned.groupBy("label", "message").agg(F.min("row_id").alias("row_id"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy("row_id"))).where(F.col("rank") <= k).select("label", "rank", "message")


def totals(counts: DataFrame) -> DataFrame:
    return counts.agg(
        F.sum("lof_excluded").alias("lof_excluded"),
        F.sum("accidental").alias("accidental"),
        F.sum("excluded").alias("excluded"),
        F.sum("support").alias("support"),
        F.count_if(F.col("lof_excluded") > 0).alias("components_with_lof"),
        F.count_if(F.col("excluded") > 0).alias("components_with_exclusions"),
    )


def template_rows(assigned: DataFrame, counts: DataFrame, run_id: str = "") -> DataFrame:
    """One row a template, in the columns of a run's templates.csv."""
    per = assigned.groupBy("label", "identifier").agg(F.count(F.lit(1)).alias("n"))
    ids = per.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("identifier", "n"))).alias("ids"))
    split = fragmentation(assigned).where("fragmented").select("identifier")
    pieces = per.join(split, "identifier").groupBy("label").agg(F.array_join(F.array_sort(F.collect_set("identifier")), ";").alias("fragmented_identifiers"))
    shown = distinct_examples(assigned).groupBy("label").pivot("rank", [1, 2, 3]).agg(F.first("message"))
    names = assigned.groupBy("label").agg(F.first("template").alias("template"))
    x = names.join(counts, "label").join(ids, "label").join(pieces, "label", "left").join(shown, "label")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return x.select(
        F.lit(run_id).alias("run_id"),
        F.concat(F.lit("C"), F.col("label").cast("string")).alias("template_label"),
        "template",
        F.col("members").alias("component_membership_count"),
        F.lit("true").alias("contributor_status_available"),
        F.col("lof_excluded").alias("lof_excluded_count"),
        F.col("accidental").alias("accidental_excluded_count"),
        F.col("excluded").alias("excluded_from_alignment_count"),
        F.col("support").alias("alignment_support_count"),
        F.to_json(F.map_from_entries("ids")).alias("identifier_counts_json"),
        (F.size("ids") > 1).cast("string").alias("mixed_identifier"),
        text("fragmented_identifiers").alias("fragmented_identifiers"),
        text("1").alias("example_1"),
        text("2").alias("example_2"),
        text("3").alias("example_3"),
    )


def partition_comparison(left: DataFrame, right: DataFrame) -> DataFrame:
    """left and right (row_id, label) -> one row: messages, equivalent, adjusted_rand_index.

    Three aggregates: rows by both labels, by the left and by the right.
    """
    cells = left.join(right.select("row_id", F.col("label").alias("other")), "row_id").groupBy("label", "other").agg(F.count(F.lit(1)).alias("n"))
    pairs = lambda c: F.coalesce(F.sum(c * (c - 1) / 2), F.lit(0.0))
    n = F.col("n")
    a = cells.groupBy("label").agg(F.sum("n").alias("n")).agg(pairs(n).alias("a"), F.count(F.lit(1)).alias("ka"))
    b = cells.groupBy("other").agg(F.sum("n").alias("n")).agg(pairs(n).alias("b"), F.count(F.lit(1)).alias("kb"))
    c = cells.agg(pairs(n).alias("c"), F.count(F.lit(1)).alias("kc"), F.coalesce(F.sum("n"), F.lit(0)).alias("messages"))
    x = a.crossJoin(b).crossJoin(c)  # one row each
    same = (F.col("ka") == F.col("kb")) & (F.col("kb") == F.col("kc"))
    total = F.col("messages") * (F.col("messages") - 1) / 2
    # numerator and denominator times the number of pairs: whole numbers for whole counts
    product = F.col("a") * F.col("b")
    below = (F.col("a") + F.col("b")) * total / 2 - product
    ari = F.when(F.col("messages") < 2, 1.0).when(below == 0, same.cast("double")).otherwise((F.col("c") * total - product) / below)
    return x.select("messages", same.alias("equivalent"), ari.alias("adjusted_rand_index"))


def template_jaccard(left: DataFrame, right: DataFrame) -> DataFrame:
    """left and right (text) -> one row: shared, all, jaccard of their distinct texts (1 if both are empty)."""
    side = left.select("text").distinct().withColumn("s", F.lit(1)).union(right.select("text").distinct().withColumn("s", F.lit(2)))
    per = side.groupBy("text").agg(F.sum("s").alias("s"))
    out = per.agg(F.count_if(F.col("s") == 3).alias("shared"), F.count(F.lit(1)).alias("all"))
    return out.withColumn("jaccard", F.when(F.col("all") == 0, 1.0).otherwise(F.col("shared") / F.col("all")))


def shuffled(lines: DataFrame, seed: int) -> DataFrame:
    """(new_id, row_id, record_sha256, raw): rows in the order of the SHA-256 of method, seed and 1-based place."""
    zero = F.lit("\x00")
    key = F.sha2(F.concat(F.lit(SHUFFLE), zero, F.lit(str(seed)), zero, (F.col("row_id") + 1).cast("string")), 256)
    out = numbered(lines.select("row_id", "raw", key.alias("shuffle_key")), ["shuffle_key", "row_id"], "new_id")
    return out.select("new_id", "row_id", F.sha2("raw", 256).alias("record_sha256"), "raw")


def checked_row_map(rows: DataFrame) -> DataFrame:
    """rows (new_id, row_id) if it is a permutation of 0 .. n - 1; raises ValueError otherwise."""
    n = rows.count()
    state = rows.agg(F.count_distinct("new_id"), F.count_distinct("row_id"), F.min("new_id"), F.max("new_id"), F.min("row_id"), F.max("row_id")).first()
    if n and tuple(state) != (n, n, 0, n - 1, 0, n - 1):
        raise ValueError("the row map is not a permutation")
    return rows


def restored(labels: DataFrame, row_map: DataFrame) -> DataFrame:
    """labels of shuffled rows (row_id is the new place) by the rows' first places."""
    return labels.select(F.col("row_id").alias("new_id"), "label").join(checked_row_map(row_map.select("new_id", "row_id")), "new_id").select("row_id", "label")
