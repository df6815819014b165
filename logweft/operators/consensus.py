"""Consensus of a cluster's alignments, and the cluster's template.

A base token that every reference matches is constant; the rest are
placeholders.  References that alone spoil a nearly unanimous token are left
out and the votes are taken again, until none is left out.  Votes are counted
by aggregates over (label, token place), so a cluster may have any number of
lines; the rounds of all clusters run together and end when no cluster changes.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbering import checkpointed

#: fixed value: the share of votes that is nearly unanimous in large clusters
NEAR = 0.9


def vote_limit(refs: Column, cutoff: float) -> Column:
    """Votes that a nearly unanimous token has to exceed; all of them for two references or fewer."""
    if not 0 < cutoff < 1:
        raise ValueError("the threshold lies between 0 and 1")
    large = math.floor(1 / (1 - cutoff))
    return F.when(refs <= 2, refs).when(refs > large, F.floor(refs * F.lit(NEAR))).otherwise(refs - 2).cast("long")


def covered_places(path: Column) -> Column:
    """Base places that a path matches."""
    return F.flatten(F.transform(path, lambda s: F.sequence(s["b_start"], s["b_start"] + s["len"] - 1)))


def votes(paths: DataFrame) -> DataFrame:
    """(label, pos, votes, refs): references that match each base token, and references in all; unmatched places have no row."""
    refs = paths.groupBy("label").agg(F.count(F.lit(1)).alias("refs"))
    seen = paths.select("label", F.explode(covered_places(F.col("path"))).alias("pos")).groupBy("label", "pos").agg(F.count(F.lit(1)).alias("votes"))
    return seen.join(refs, "label")


def consensus(paths: DataFrame, cutoff: float = 0.9, most_rounds: int = 200) -> tuple[DataFrame, DataFrame]:
    """paths (label, ref_id, path) -> (constants (label, places), accidentals (label, ref_id))."""
    now = checkpointed(paths.select("label", "ref_id", covered_places(F.col("path")).alias("places")))
    gone = None
    for _ in range(most_rounds):
        counts = now.select("label", F.explode("places").alias("pos")).groupBy("label", "pos").agg(F.count(F.lit(1)).alias("votes"))
        counts = counts.join(now.groupBy("label").agg(F.count(F.lit(1)).alias("refs")), "label")
        near = counts.where((F.col("votes") < F.col("refs")) & (F.col("votes") > vote_limit(F.col("refs"), cutoff))).groupBy("label").agg(F.collect_list("pos").alias("near"))
        out = checkpointed(now.join(near, "label").where(F.size(F.array_except("near", "places")) > 0).select("label", "ref_id"))
        if out.isEmpty():
            break
        gone = out if gone is None else gone.union(out)
        now = checkpointed(now.join(out, ["label", "ref_id"], "left_anti"))
    else:
        raise RuntimeError(f"consensus did not settle in {most_rounds} rounds")
    full = counts.where("votes = refs").groupBy("label").agg(F.array_sort(F.collect_list("pos")).alias("places"))
    empty = now.select("label", "ref_id").limit(0)
    return full, empty if gone is None else gone


def half_consensus(paths: DataFrame, share: float = 0.5) -> DataFrame:
    """(label, places): places matched by at least floor(share * references) of them, without leaving any out; 0.5 for characters, 0.8 for tokens."""
    full = votes(paths).where(F.col("votes") >= F.greatest(F.lit(1), F.floor(F.col("refs") * F.lit(share))))
    return full.groupBy("label").agg(F.array_sort(F.collect_list("pos")).alias("places"))


def realigned_consensus(members: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Consensus with one retry: references that miss a token matched by four in five are aligned again, from the other side, and the votes are taken once more.

    members (label, local, row_id, tokens); returns (constants, accidentals), the latter still missing such a token after the retry.
    """
    from .alignment import chain

    def missing(p: DataFrame) -> DataFrame:
        near = votes(p).where((F.col("votes") < F.col("refs")) & (F.col("votes") >= F.floor(F.col("refs") * 4 / 5))).groupBy("label").agg(F.collect_list("pos").alias("near"))
        return p.join(near, "label").where(F.size(F.array_except("near", covered_places(F.col("path")))) > 0).select("label", "ref_id")

    paths = checkpointed(paths.select("label", "ref_id", "path"))
    retry = checkpointed(missing(paths))
    base = members.where("local = 0").select("label", F.col("tokens").alias("base_tokens"))
    # reversed sequences put the tie-breaks at the other end
    again = retry.join(members.select("label", F.col("row_id").alias("ref_id"), "tokens"), ["label", "ref_id"]).join(base, "label")
    n, m = F.size("base_tokens"), F.size("tokens")
    turned = again.select("label", "ref_id", n.alias("n"), m.alias("m"), chain(F.reverse("base_tokens"), F.reverse("tokens")).alias("p"))
    back = turned.select("label", "ref_id", F.reverse(F.transform("p", lambda s: F.struct((F.col("n") - s["b_start"] - s["len"]).alias("b_start"), (F.col("m") - s["r_start"] - s["len"]).alias("r_start"), s["len"].alias("len")))).alias("path"))
    paths = checkpointed(paths.join(retry, ["label", "ref_id"], "left_anti").unionByName(back))
    out = checkpointed(missing(paths))
    left = paths.join(out, ["label", "ref_id"], "left_anti")
    return votes(left).where("votes = refs").groupBy("label").agg(F.array_sort(F.collect_list("pos")).alias("places")), out


def segments_of(tokens: Column, places: Column) -> Column:
    """Segments of a base line whose places in `places` (may be null) are constant: runs of constants and placeholders in turn."""
    kinds = "array<struct<is_ph:boolean,toks:array<string>>>"
    flags = F.transform(tokens, lambda t, i: F.struct((~F.array_contains(F.coalesce(places, F.array().cast("array<int>")), i)).alias("is_ph"), t.alias("t")))

    def add(segs, x):
        last = F.element_at(segs, -1)
        toks = F.when(x["is_ph"], F.array().cast("array<string>"))
        fresh = F.array(F.struct(x["is_ph"].alias("is_ph"), F.coalesce(toks, F.array(x["t"])).alias("toks")))
        longer = F.array(F.struct(x["is_ph"].alias("is_ph"), F.coalesce(toks, F.concat(last["toks"], F.array(x["t"]))).alias("toks")))
        return F.when((F.size(segs) > 0) & (F.try_element_at(segs, F.lit(-1))["is_ph"] == x["is_ph"]), F.concat(F.slice(segs, 1, F.size(segs) - 1), longer)).otherwise(F.concat(segs, fresh)).cast(kinds)

    return F.aggregate(flags, F.array().cast(kinds), add)


def cluster_templates(members: DataFrame, constants: DataFrame) -> DataFrame:
    """members (label, local, tokens, ...) -> (label, base_id, segs): the template of each label's base line."""
    base = members.where("local = 0").join(constants, "label", "left")
    return base.select("label", F.col("row_id").alias("base_id"), segments_of(F.col("tokens"), F.col("places")).alias("segs"))


def line_regions(members: DataFrame, paths: DataFrame, constants: DataFrame, accidentals: DataFrame) -> DataFrame:
    """(label, row_id, tokens, regions array<struct<lower, upper, is_ph>>) of all members' tokens, constant and placeholder runs in turn.

    A reference has the base's constants where its path puts them; one that was
    left out is a placeholder from end to end.
    """
    lines = members.select("label", "row_id", "local", "tokens")
    inside = lambda s: F.filter("places", lambda p: (p >= s["b_start"]) & (p < s["b_start"] + s["len"]))
    moved = F.flatten(F.transform("path", lambda s: F.transform(inside(s), lambda p: p - s["b_start"] + s["r_start"])))
    known = paths.join(constants, "label").join(accidentals.select("label", "ref_id"), ["label", "ref_id"], "left_anti").select("label", F.col("ref_id").alias("row_id"), moved.alias("own"))
    rows = lines.join(known, ["label", "row_id"], "left").join(constants, "label", "left")
    places = F.coalesce(F.when(F.col("local") == 0, F.col("places")).otherwise(F.col("own")), F.array().cast("array<int>"))
    return rows.select("label", "row_id", "tokens", regions_of(F.col("tokens"), places).alias("regions"))


def regions_of(tokens: Column, places: Column) -> Column:
    """Runs of a line's tokens that are in `places` or not, as array<struct<lower, upper, is_ph>>."""
    n = F.size(tokens)
    fixed = lambda k: F.array_contains(places, k)
    starts = F.filter(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda k: (k == 0) | (fixed(k) != fixed(k - 1)))
    return F.transform(starts, lambda k, i: F.struct(k.alias("lower"), F.coalesce(F.get(starts, i + 1), n).alias("upper"), (~fixed(k)).alias("is_ph")))


def word_bounded(members: DataFrame, constants: DataFrame) -> DataFrame:
    """constants with each run of constant characters shrunk to begin and end at word bounds of the base text (members of single characters)."""
    base = members.where("local = 0").select("label", "tokens")

    def inner(tokens, places, k):
        word = lambda i: F.coalesce(F.try_element_at(tokens, i + 1).rlike("[A-Za-z0-9_]"), F.lit(False))
        # inside a word, a constant character stays only if its whole word is constant
        left = F.array_max(F.filter(F.sequence(F.lit(-1), k), lambda i: ~F.when(i < 0, False).otherwise(word(i))))
        right = F.array_min(F.filter(F.sequence(k, F.size(tokens)), lambda i: ~F.when(i >= F.size(tokens), False).otherwise(word(i))))
        whole = F.size(F.array_except(F.sequence(left + 1, F.greatest(left + 1, right - 1)), places)) == 0
        return ~word(k) | whole

    return constants.join(base, "label").select("label", F.filter("places", lambda k: inner(F.col("tokens"), F.col("places"), k)).alias("places"))
