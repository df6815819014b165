"""Mining templates from log lines: two passes from lines to templates."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbering import checkpointed
from ..functions.tokens import tokens
from ..operators import distances, generalise, graph
from ..operators.alignment import base_paths
from ..operators.consensus import cluster_templates, consensus, line_regions
from ..operators.matching import template_match, template_text
from ..operators.outliers import retained


class SelfCheckError(RuntimeError):
    """A template does not accept one of the lines it was made from."""


@dataclass
class Assembled:
    """Templates of labelled lines, and what became of the lines."""

    #: label, ordinal, segs, text, base_id, is_catch_all
    templates: DataFrame
    #: row_id, label: lines that the template was made from
    contributors: DataFrame
    #: row_id, label, reason: lof or accidental
    exclusions: DataFrame
    #: row_id, label, n, lof, excluded, local
    scores: DataFrame
    #: row_id, label: contributors that their own template rejects (kept only with on_violation="quarantine")
    violations: DataFrame
    #: label, base_id, ref_id, path: alignments with the base lines
    paths: DataFrame
    #: label, row_id, tokens, regions: constant and placeholder runs of all aligned lines
    regions: DataFrame


@dataclass
class MineResult:
    lines: DataFrame
    #: row_id, label of the last pass
    labels: DataFrame
    assembled: Assembled
    #: row_id, label of the first pass, component; None after a single pass without refinement
    components: DataFrame | None
    #: the first pass, its coverage and its template graph
    first: Assembled | None = None
    cover: DataFrame | None = None
    edges: DataFrame | None = None
    template_components: DataFrame | None = None


def cluster(lines: DataFrame, algorithm: str = "leiden") -> DataFrame:
    """(row_id, label): communities of the lines' 1-NN graph."""
    near = checkpointed(distances.one_nearest(lines))
    edges = graph.undirected(near.select(F.col("i").alias("src"), F.col("j").alias("dst"), "weight"))
    found = graph.communities(lines.select(F.col("row_id").alias("id")), edges, algorithm)
    return found.select(F.col("id").alias("row_id"), "label")


def assemble_templates(lines: DataFrame, labels: DataFrame, threshold: float = 0.9, outlier: float = 1.5, on_violation: str = "error", paths: DataFrame | None = None) -> Assembled:
    """One template for each label: outliers out, members aligned to the first one (but for pairs whose path is given), votes, consensus."""
    labelled = lines.select("row_id", "raw").join(labels.select("row_id", "label"), "row_id")
    scores = checkpointed(retained(labelled, outlier))
    kept = scores.where("NOT excluded").select("row_id", "label", "local")
    members = checkpointed(kept.join(lines.select("row_id", tokens(F.col("raw")).alias("tokens")), "row_id"))
    paths = checkpointed(base_paths(members, paths))
    constants, accidentals = consensus(paths, threshold)
    found = checkpointed(cluster_templates(members, constants))
    templates = found.select("label", F.col("label").cast("int").alias("ordinal"), "segs", "base_id", (F.size(F.filter("segs", lambda s: ~s["is_ph"])) == 0).alias("is_catch_all"))
    templates = checkpointed(template_text(templates))
    regions = line_regions(members, paths, constants, accidentals)
    accidentals = accidentals.select(F.col("ref_id").alias("row_id"), "label")
    contributors = checkpointed(members.select("row_id", "label").join(accidentals.select("row_id"), "row_id", "left_anti"))
    checked = contributors.join(members.select("row_id", "tokens"), "row_id").join(templates.select("label", "segs"), "label")
    violations = checkpointed(checked.where(~template_match(F.col("segs"), F.col("tokens"))["accepted"]).select("row_id", "label"))
    if on_violation == "error" and (bad := violations.first()) is not None:
        raise SelfCheckError(f"generated template C{bad.label} does not accept contributor row {bad.row_id}")
    exclusions = scores.where("excluded").select("row_id", "label", F.lit("lof").alias("reason")).union(accidentals.select("row_id", "label", F.lit("accidental")))
    return Assembled(templates, contributors, exclusions, scores, violations, paths, regions)


def mine(lines: DataFrame, cluster_algo: str = "leiden", refine_algo: str = "components", threshold: float = 0.9, outlier: float = 1.5, passes: int = 2, on_violation: str = "error", labels: DataFrame | None = None, paths: DataFrame | None = None, cache: str | None = None) -> MineResult:
    """lines (row_id, source_line, raw) -> templates.

    The first pass clusters lines, makes a template of each cluster and groups
    templates that generalise one another; the second makes a template of each
    group's lines.  Given labels replace the clustering; given paths (base_id,
    ref_id, path) are not aligned again.  With a cache folder the first pass's
    labels are kept under the lines' fingerprint.
    """
    if passes not in (1, 2):
        raise ValueError("one pass or two")
    if labels is None:
        found = lambda: cluster(lines, cluster_algo)
        labels = cached(lines.sparkSession, cache, f"labels-{cluster_algo}", lines, found) if cache else checkpointed(found())
    else:
        labels = checkpointed(labels)
    first = assemble_templates(lines, labels, threshold, outlier, on_violation, paths)
    cover = checkpointed(generalise.coverage(first.templates))
    edges = checkpointed(generalise.generalisation_graph(cover))
    merged = checkpointed(generalise.refine(first.templates, cover, refine_algo))
    components = checkpointed(generalise.row_components(labels, merged))
    if passes == 1:
        return MineResult(lines, labels, first, components, first, cover, edges, merged)
    again = components.select("row_id", F.col("component").alias("label"))
    second = assemble_templates(lines, again, threshold, outlier, on_violation)
    return MineResult(lines, again, second, components, first, cover, edges, merged)


def save(result: MineResult, folder: str) -> None:
    """The result's tables as Parquet under a folder: labels, templates, contributors, exclusions, scores, paths, components."""
    tables = {"paths": result.assembled.paths, "labels": result.labels, "templates": result.assembled.templates, "contributors": result.assembled.contributors, "exclusions": result.assembled.exclusions, "scores": result.assembled.scores}
    if result.components is not None:
        tables["components"] = result.components
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}")


def load(spark, folder: str, name: str) -> DataFrame:
    """One of the tables that `save` wrote, such as paths for another mine of the same lines."""
    return spark.read.parquet(f"{folder}/{name}")


def fingerprint(lines: DataFrame) -> str:
    """A value that differs for other lines: caches of distances and labels are kept under it, not under a file's name."""
    n, h = lines.agg(F.count(F.lit(1)), F.sum(F.xxhash64("row_id", "raw").cast("decimal(38,0)"))).first()
    return f"{n}-{int(h or 0) & (1 << 64) - 1:016x}"


def cached(spark, folder: str, name: str, lines: DataFrame, make) -> DataFrame:
    """make()'s table, kept as Parquet under the fingerprint of the lines it is made from."""
    place = f"{folder}/{fingerprint(lines)}/{name}"
    path = spark._jvm.org.apache.hadoop.fs.Path(place + "/_SUCCESS")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        make().write.mode("overwrite").parquet(place)
    return spark.read.parquet(place)
