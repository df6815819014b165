"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in a fixed shuffled order, as often as
it may repeat.  A document's virtual finish time is its source's cumulative
size divided by the source's weight, its start time that of the document
before.  All copies stand in one queue, globally range-sorted by finish time,
and the queue is cut where the total budget is used up: sums over its range
partitions, with the parts of the copies that are being served at a
partition's end, give the words served by then; the partition in which they
reach the budget holds the cut.  Inside it the rate of service changes only
where a source's last copy ends, so the time of the cut follows from those
copies.  What a copy gives is what is served of it before the cut, which shares
the words of sources that run dry among the rest by weight.

Only DataFrame functions run here.  Cumulative sizes inside a source come in
two steps, so no source is ever in one task: sums over (source, slice of the
hash order), a window over those few sums, and a window inside each slice.  The
slices follow the number of documents of a source.

Defined cases: null text has size 0; size-0 documents are never taken and not
queued; null sources are one source, last in order; repeated identifiers are
rows like any other; rows with a null identifier are shuffled by their texts.
If all that sources may give is below the budget, everything is taken.  An
empty table gives an empty result.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbering import numbered
from .session import checkpointed, partitions

#: documents in a slice of a source's shuffled order, about
SLICE = 4096
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text in one pass: each word, with the white space around it, becomes one character."""
    one = F.regexp_replace(text, r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+", "x")
    return F.when(text.rlike(r"[^\x20\x09-\x0D]"), F.length(one)).otherwise(F.lit(0)).cast("long")


def weighted_sources(sizes: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """sizes (source, source_size, n) with weight: the weights in turn, in the order of the sources' names, null last."""
    ranked = numbered(sizes, [F.col("source").asc_nulls_last()], "rank")
    return ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))).drop("rank")


def queue_cut(copies: DataFrame, budget: float, n: int) -> float | None:
    """The virtual time at which the queue has served `budget` words; None if it never does.

    copies (start, size, source_size, weight, last): start counts its source's
    words before the copy, last marks a source's last copy.
    """
    finish = (F.col("start") + F.col("size")) / F.col("weight")
    queue = copies.select("start", "size", "weight", "last", (F.col("start") / F.col("weight")).alias("begin"), finish.alias("finish"))
    queue = queue.repartitionByRange(n, "finish").withColumn("part", F.shiftright(F.monotonically_increasing_id(), 33).cast("int"))
    queue = checkpointed(queue)
    ends = {r.part: r for r in queue.groupBy("part").agg(F.max("finish").alias("end"), F.sum("size").alias("words")).collect()}  # a row a partition
    bounds, last = [], -1.0
    for part in range(max(ends, default=-1) + 1):
        last = ends[part].end if part in ends else last
        bounds.append(last)
    bound = F.array(*[F.lit(x) for x in bounds])
    # copies in service at the end of a partition before their own: at each end one a source at most
    open_ = queue.where((F.col("part") > 0) & (F.get(bound, F.col("part") - 1) > F.col("begin")))
    open_ = open_.withColumn("at", F.explode(F.filter(F.sequence(F.lit(0), F.col("part") - 1), lambda k: F.get(bound, k) > F.col("begin"))))
    partly = {r["at"]: r.words for r in open_.groupBy("at").agg(F.sum(F.get(bound, F.col("at")) * F.col("weight") - F.col("start")).alias("words")).collect()} if ends else {}
    served, cut = 0.0, None
    for part in sorted(ends):
        served += ends[part].words
        if served + partly.get(part, 0.0) >= budget:
            cut = part
            break
    if cut is None:
        return None
    # sources that ended in the partitions before; the others are served at their weight
    ended = queue.where("last")
    total = ended.agg(F.sum("weight")).first()[0]
    most = F.sum(F.col("start") + F.col("size")).alias("most")
    before = ended.where(F.col("part") < cut).agg(most, F.sum("weight").alias("weight")).first()
    left, rate = budget - (before.most or 0), total - (before.weight or 0.0)
    drying = ended.where(F.col("part") == cut).groupBy("finish").agg(most, F.sum("weight").alias("weight"))
    to = Window.orderBy("finish").rowsBetween(Window.unboundedPreceding, -1)  # over one range partition's last copies
    sums = drying.select("finish", F.coalesce(F.sum("most").over(to), F.lit(0)).alias("most"), F.coalesce(F.sum("weight").over(to), F.lit(0.0)).alias("weight"))
    time = (F.lit(left) - F.col("most")) / (F.lit(rate) - F.col("weight"))
    first = sums.select("finish", time.alias("time")).where("time <= finish").orderBy("finish").first()
    if first is not None:
        return first.time
    dry = drying.agg(F.sum("most").alias("most"), F.sum("weight").alias("weight")).first()
    rate -= dry.weight or 0.0
    return (left - (dry.most or 0)) / rate if rate > 0 else None


def fair_queue(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, repeats: int = 2, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, source, size, source_size, weight, target, taken, `finish` (the virtual finish time of its first copy), and the columns of carry.

    The document at the cut of its source is taken in part, so sources meet
    their targets to the word; `taken` counts repeats.  Columns of carry (whole
    texts, say) are moved once, by the last window.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.when(F.col(id_col).isNull(), F.md5(F.col(text_col).cast("binary"))).alias("unnamed"), *[F.col(c).alias(f"_{c}") for c in carry])
    rows = rows.withColumn("spot", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), "unnamed", F.lit(""))))).drop("unnamed")
    slim = checkpointed(rows.select("doc_id", "source", "size", "spot"))
    per_source = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    slices = F.greatest(F.lit(1), F.ceil(F.col("n") / SLICE)).cast("long")
    sources = checkpointed(weighted_sources(per_source, weights).select("source", "source_size", "weight", slices.alias("slices")))

    def sliced(x: DataFrame) -> DataFrame:
        part = F.shiftright(F.conv(F.substring("r.spot", 1, 8), 16, 10).cast("long") * F.col("t.slices"), 32)
        return x.alias("r").join(sources.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source"))).select("r.*", "t.source_size", "t.weight", part.alias("slice"))

    sums = sliced(slim).groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    before = checkpointed(sums.select("source", "slice", (F.sum("slice_size").over(Window.partitionBy("source").orderBy("slice")) - F.col("slice_size")).alias("before")))
    order = Window.partitionBy("source", "slice").orderBy("spot", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def queued(x: DataFrame) -> DataFrame:
        found = sliced(x).alias("r").join(before.alias("b"), F.col("r.source").eqNullSafe(F.col("b.source")) & (F.col("r.slice") == F.col("b.slice"))).select("r.*", "b.before")
        return found.withColumn("end", F.col("before") + F.sum("size").over(order))

    ended = queued(slim)
    ended = ended if carry else checkpointed(ended)
    copies = ended.where("size > 0").select("size", "source_size", "weight", "end", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("copy"))
    copies = copies.select((F.col("end") - F.col("size") + F.col("copy") * F.col("source_size")).alias("start"), "size", "source_size", "weight", ((F.col("end") == F.col("source_size")) & (F.col("copy") == repeats - 1)).alias("last"))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    cut = queue_cut(copies, total * float(share), partitions(docs.sparkSession))
    most = (F.col("source_size") * repeats).cast("double")
    target = most if cut is None else F.least(most, F.lit(cut) * F.col("weight"))
    rows = (queued(rows) if carry else ended).withColumn("target", target)
    words = F.round("target").cast("long")
    got = lambda k: F.greatest(F.lit(0), F.least(F.col("size"), words - (F.col("end") - F.col("size")) - k * F.col("source_size")))
    taken = got(0)
    for k in range(1, repeats):
        taken = taken + got(k)
    return rows.select("doc_id", "source", "size", "source_size", "weight", "target", taken.cast("long").alias("taken"), (F.col("end") / F.col("weight")).alias("finish"), *[F.col(f"_{c}").alias(c if c not in ("doc_id", "source") else f"_{c}") for c in carry])


def mixed_documents(docs: DataFrame, repeats: int = 2, text_col: str = "text", **kw) -> DataFrame:
    """The mix itself: the rows of docs once for each copy taken, globally range-sorted by finish time.

    The copy at a source's cut is shortened to the words taken, joined by one
    space; other copies keep their text as it is.
    """
    names = docs.columns
    held = docs.select(*[F.col(c).alias(f"in_{i}") for i, c in enumerate(names)])
    at = {c: f"in_{i}" for i, c in enumerate(names)}
    mix = fair_queue(held, repeats=repeats, id_col=at[kw.pop("id_col", "doc_id")], text_col=at[text_col], source_col=at[kw.pop("source_col", "source")], carry=tuple(at.values()), **kw).where("taken > 0")
    mix = mix.withColumn("copy", F.explode(F.sequence(F.lit(0), F.ceil(F.col("taken") / F.col("size")).cast("int") - 1)))
    left = F.col("taken") - F.col("copy") * F.col("size")
    text = F.col(at[text_col])
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"({WORD})"), 1), F.lit(1), left.cast("int")), " ")
    mix = mix.withColumn(at[text_col], F.when(left < F.col("size"), cut).otherwise(text))
    mix = mix.withColumn("turn", F.col("finish") + F.col("copy") * F.col("source_size") / F.col("weight"))
    n = partitions(docs.sparkSession)
    mix = mix.repartitionByRange(n, "turn", "doc_id").sortWithinPartitions("turn", "doc_id")
    return mix.select(*[F.col(at[c]).alias(c) for c in names])
