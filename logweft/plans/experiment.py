"""Experiments: a matrix of two-pass mines, their evaluation and comparisons."""
from __future__ import annotations

import hashlib
import json
import os
import subprocess
import time
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate
from ..sources import reports
from ..sources.lines import read_lines, validated_file
from .mine import MineResult, mine
from .report import report_parts

#: fixed values: the seed of the reordered run, and pairs of runs to compare
SHUFFLE_SEED = 20260710
PAIRS = (("R01", "R07"), ("R01", "R08"), ("R06", "R09"))


@dataclass(frozen=True)
class Run:
    run_id: str
    path: str
    purpose: str = ""
    shuffle_seed: int | None = None


@dataclass
class Collected:
    run: Run
    result: MineResult
    assigned: DataFrame
    counts: DataFrame
    seconds: float


def run_matrix(large: str, small: str, variants: list[str], spoofed: str, spoofed_with_prefix: str) -> list[Run]:
    """Nine runs: two normal traces, catalogue runs, a repeat and a reordering of the first, and one with prefixes kept."""
    runs = [Run("R01", large, "the larger trace"), Run("R02", small, "the smaller trace")]
    runs += [Run(f"R0{3 + k}", p, "another trace, for its templates") for k, p in enumerate([*variants, spoofed])]
    return [*runs, Run("R07", large, "the larger trace once more, which has to agree"), Run("R08", large, "the larger trace in another order", SHUFFLE_SEED), Run("R09", spoofed_with_prefix, "records with what stands before them")]


def select_runs(runs: list[Run], names: list[str] | None) -> list[Run]:
    if not names:
        return runs
    known = {r.run_id for r in runs}
    if lost := [n for n in names if n not in known]:
        raise ValueError(f"no such runs: {', '.join(lost)}")
    return [r for r in runs if r.run_id in set(names)]


def validate_inputs(spark: SparkSession, runs: list[Run]) -> None:
    for r in runs:
        validated_file(spark, r.path)


def collect(run_id: str, result: MineResult) -> tuple[DataFrame, DataFrame]:
    """(assignments, component counts) of a mine."""
    a = result.assembled
    texts = a.templates.select("label", "text")
    lof = a.exclusions.where("reason = 'lof'")
    return evaluate.assignments(result.lines, result.labels, texts, a.contributors), evaluate.component_counts(result.labels, lof, a.contributors)


def execute(spark: SparkSession, run: Run, folder: str | None = None, **options) -> Collected:
    """One run: mine, evaluate, and with a folder write its tables."""
    started = time.time()
    lines = read_lines(spark, run.path)
    row_map = None
    if run.shuffle_seed is not None:
        row_map = evaluate.shuffled(lines, run.shuffle_seed)
        lines = row_map.select(F.col("new_id").alias("row_id"), (F.col("new_id") + 1).alias("source_line"), "raw")
    result = mine(lines, **options)
    assigned, counts = collect(run.run_id, result)
    source = F.col("row_id") if row_map is None else F.col("source")
    if row_map is not None:
        assigned = assigned.join(row_map.select(F.col("new_id").alias("row_id"), F.col("row_id").alias("source")), "row_id")
    assigned = assigned.withColumn("source_row", source)
    out = Collected(run, result, assigned, counts, time.time() - started)
    if folder:
        write_run(out, f"{folder}/{run.run_id}", row_map)
    return out


def summarise(run: Collected) -> dict:
    """A run's summary as plain values; identifiers and templates are few."""
    frag = {r.identifier: {"template_count": r.labels, "templates": [f"C{x}" for x in r.templates], "fragmented": r.fragmented} for r in evaluate.fragmentation(run.assigned).orderBy("identifier").collect()}
    total = evaluate.totals(run.counts).first()
    mixed = [f"C{r.label}" for r in evaluate.mixed(run.assigned).orderBy("label").collect()]
    ids = {r.identifier: r.messages for r in evaluate.identifier_counts(run.assigned).orderBy("identifier").collect()}
    counts = run.counts.orderBy("label").collect()
    return {
        "run_id": run.run.run_id,
        "message_count": sum(ids.values()),
        "component_membership_count": sum(ids.values()),
        "template_count": len(counts),
        "identifier_counts": ids,
        "mixed_identifier_template_count": len(mixed),
        "mixed_identifier_templates": mixed,
        "identifier_fragmentation": frag,
        "fragmented_identifier_count": sum(x["fragmented"] for x in frag.values()),
        "contributor_status_available": True,
        "lof_excluded_count": total.lof_excluded,
        "accidental_excluded_count": total.accidental,
        "excluded_from_alignment_count": total.excluded,
        "alignment_support_count": total.support,
        "components_with_lof_exclusions_count": total.components_with_lof,
        "components_with_exclusions_count": total.components_with_exclusions,
        "component_support": {f"C{r.label}": r.support for r in counts},
    }


def write_run(run: Collected, folder: str, row_map: DataFrame | None = None) -> None:
    a = run.assigned
    rows = a.select(F.lit(run.run.run_id).alias("run_id"), F.col("row_id").alias("input_row_0based"), F.col("source_row").alias("source_row_0based"), F.concat(F.lit("C"), "label").alias("component_label"), F.col("template").alias("associated_template"), F.col("contributor").cast("string").alias("alignment_contributor"), F.col("identifier").alias("nmea_identifier"), "message")
    rows.write.mode("overwrite").option("header", True).csv(f"{folder}/message-assignments")
    evaluate.template_rows(a, run.counts, run.run.run_id).orderBy(F.length("template_label"), "template_label").coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/templates")
    if row_map is not None:
        index = row_map.select(F.col("new_id").alias("input_row_0based"), F.col("row_id").alias("source_row_0based"), (F.col("new_id") + 1).alias("shuffled_line_1based"), (F.col("row_id") + 1).alias("original_line_1based"), "record_sha256")
        index.write.mode("overwrite").option("header", True).csv(f"{folder}/shuffle-index")
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/summary.json", "w", encoding="utf-8") as f:
        json.dump(summarise(run) | {"duration_seconds": run.seconds}, f, indent=2)
    with open(f"{folder}/report.txt", "w", encoding="utf-8") as f:
        f.writelines(report_parts(run.result))
    run.result.labels.write.mode("overwrite").parquet(f"{folder}/labels")
    manifest = {
        "schema_version": 1,
        "run_id": run.run.run_id,
        "purpose": run.run.purpose,
        "status": "complete",
        "input": file_record(run.run.path),
        "shuffle": None if row_map is None else {"algorithm": evaluate.SHUFFLE, "seed": run.run.shuffle_seed, "mapping": {"path": f"{run.run.run_id}/shuffle-index"}},
        "report_file": f"{run.run.run_id}/report.txt",
        "labels_file": f"{run.run.run_id}/labels",
        "duration_seconds": run.seconds,
    }
    with open(f"{folder}/run.json", "w", encoding="utf-8") as f:
        json.dump(manifest, f, indent=2)


@dataclass
class Stored:
    """A run as its folder has it."""

    manifest: dict
    #: label -> text, and label -> counts, as the report prints them
    templates: dict[int, str]
    counts: dict
    #: row_id, label; by the rows' first places where the run was shuffled
    labels: DataFrame


def stored_run(spark: SparkSession, root: str, run_id: str) -> Stored:
    """Reads a run through its manifest, whose paths stay below root."""
    with open(reports.result_path(root, f"{run_id}/run.json"), encoding="utf-8") as f:
        manifest = json.load(f)
    if manifest.get("status") != "complete":
        raise ValueError(f"run {run_id} is not complete")
    with open(reports.result_path(root, reports.manifest_value(manifest, ["report_file", "paths.report"])), encoding="utf-8") as f:
        text = f.read()
    labels = spark.read.parquet(reports.result_path(root, reports.manifest_value(manifest, ["labels_file", "paths.labels"])))
    if manifest["shuffle"] is not None:
        rows = spark.read.option("header", True).csv(reports.result_path(root, reports.manifest_value(manifest, ["shuffle.mapping.path"])))
        labels = evaluate.restored(labels, rows.select(F.col("input_row_0based").cast("long").alias("new_id"), F.col("source_row_0based").cast("long").alias("row_id")))
    return Stored(manifest, reports.final_templates(text), reports.component_counts(text), labels)


def compare(left: Collected, right: Collected) -> dict:
    """Partition equivalence, adjusted Rand index over source rows, and overlap of template texts."""
    side = lambda c: c.assigned.select(F.col("source_row").alias("row_id"), "label")
    p = evaluate.partition_comparison(side(left), side(right)).first()
    j = evaluate.template_jaccard(left.result.assembled.templates, right.result.assembled.templates).first()
    return {"left_run": left.run.run_id, "right_run": right.run.run_id, "messages_compared": p.messages, "exact_partition_equivalence": p.equivalent, "adjusted_rand_index": p.adjusted_rand_index, "exact_template_set_jaccard": j.jaccard, "left_template_count": left.counts.count(), "right_template_count": right.counts.count()}


def experiment(spark: SparkSession, runs: list[Run], folder: str | None = None, **options) -> dict:
    """All runs and the comparisons between those of PAIRS that are there."""
    validate_inputs(spark, runs)
    done = {r.run_id: execute(spark, r, folder, **options) for r in runs}
    out = {"comparisons": [compare(done[a], done[b]) for a, b in PAIRS if a in done and b in done], "skipped_comparisons": [[a, b] for a, b in PAIRS if not (a in done and b in done)]}
    if folder:
        with open(f"{folder}/comparisons.json", "w", encoding="utf-8") as f:
            json.dump(out, f, indent=2)
        with open(f"{folder}/experiment.json", "w", encoding="utf-8") as f:
            json.dump({"schema_version": 1, "runs": [asdict(r) for r in runs], "inputs": {r.path: file_record(r.path) for r in runs}, "provenance": provenance(), "options": options, "artefacts": {r.run_id: artefacts(f"{folder}/{r.run_id}") for r in runs}}, f, indent=2, default=str)
    return out


def file_record(path: str) -> dict:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while piece := f.read(1 << 20):
            digest.update(piece)
    return {"path": os.path.abspath(path), "size_bytes": os.path.getsize(path), "sha256": digest.hexdigest()}


def artefacts(folder: str) -> list[dict]:
    """Records of all files below a folder, by path; links are left out."""
    found = [os.path.join(at, name) for at, _, names in os.walk(folder) for name in names]
    return [file_record(p) for p in sorted(found) if os.path.isfile(p) and not os.path.islink(p)]


def provenance() -> dict:
    """Version control state of the working folder, where there is one."""
    ask = lambda *a: subprocess.run(["git", *a], capture_output=True, text=True).stdout.strip()
    try:
        return {"revision": ask("rev-parse", "HEAD"), "changed": bool(ask("status", "--porcelain"))}
    except OSError:
        return {"revision": "", "changed": None}
