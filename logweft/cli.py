"""Commands: mine, match, prepare, evaluate."""
from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators.graph import ALGORITHMS


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="logweft")
    sub = p.add_subparsers(dest="command", required=True)
    m = sub.add_parser("mine", help="templates of a log file")
    m.add_argument("input")
    m.add_argument("-C", "--cluster-algo", choices=ALGORITHMS, default="leiden")
    m.add_argument("-R", "--refine-algo", choices=ALGORITHMS, default="components")
    m.add_argument("-T", "--threshold", type=float, default=0.9)
    m.add_argument("-L", "--outlier", type=float, default=1.5)
    m.add_argument("--passes", type=int, choices=(1, 2), default=2)
    m.add_argument("--on-violation", choices=("error", "quarantine"), default="error")
    m.add_argument("--output", help="folder for the result's tables and graphs")
    m.add_argument("--plain", action="store_true", help="no colours")
    t = sub.add_parser("match", help="lines of a file against templates, as JSON lines")
    for name in ("templates", "input", "output"):
        t.add_argument(f"--{name}", required=True)
    r = sub.add_parser("prepare", help="records from their $ sign on")
    r.add_argument("input")
    r.add_argument("output")
    r.add_argument("--keep-prefix", action="store_true")
    e = sub.add_parser("evaluate", help="two-pass mines of files, and their comparison")
    e.add_argument("inputs", nargs="+")
    e.add_argument("--output", required=True)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("logweft").getOrCreate()
    if args.command == "mine":
        from .plans.mine import mine, save
        from .plans.report import report_lines, report_parts
        from .sources.exports import automata_dot, weighted_graphml
        from .sources.lines import read_lines
        from .sources.templates import templates_list

        result = mine(read_lines(spark, args.input), args.cluster_algo, args.refine_algo, args.threshold, args.outlier, args.passes, args.on_violation)
        for piece in report_parts(result, not args.plain):
            print(piece, end="")
        if args.output:
            save(result, args.output)
            report_lines(result, False).orderBy("label", "part", "at").select("line").write.mode("overwrite").text(f"{args.output}/report")
            os.makedirs(args.output, exist_ok=True)
            with open(f"{args.output}/templates.graphml", "w", encoding="utf-8") as f:
                f.write(weighted_graphml(result.first.templates.select(F.col("label").alias("id")), result.edges, True))
            with open(f"{args.output}/automata.dot", "w", encoding="utf-8") as f:
                f.write(automata_dot(templates_list(result.first.templates)))
    elif args.command == "match":
        from .plans.match import match_file

        match_file(spark, args.templates, args.input, args.output)
    elif args.command == "prepare":
        from .sources.lines import physical_lines, prepare

        rows = prepare(physical_lines(spark, args.input), "source_line", "value", args.keep_prefix).orderBy("id", "pos").toLocalIterator()
        with open(args.output, "w", encoding="utf-8", newline="\n") as f:
            f.writelines(r.record + "\n" for r in rows)
    else:
        from .plans.experiment import Run, experiment

        print(json.dumps(experiment(spark, [Run(f"R{k:02}", p) for k, p in enumerate(args.inputs, 1)], args.output), indent=2))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
