"""python -m ontolith.cli eval --scene FILE --dataset FILE --scenario NAME --out FOLDER [--limit N]"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from ontolith.operators import evaluate
from ontolith.plans import evaluation
from ontolith.sources import files


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="ontolith")
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("eval", help="compare the two targets over a scene")
    for name in ("scene", "dataset", "scenario", "out"):
        run.add_argument(f"--{name}", required=True)
    run.add_argument("--limit", type=int)
    run.add_argument("--targets", default="constrained,plain")
    args = parser.parse_args(argv)
    known = {"constrained": evaluation.constrained, "plain": evaluation.plain}
    names = args.targets.split(",")
    if unknown := [n for n in names if n not in known]:
        print(f"unknown targets: {', '.join(unknown)}", file=sys.stderr)
        return 2
    spark = SparkSession.builder.getOrCreate()
    try:
        read = files.scene(spark, args.scene, args.scenario)
        items = files.dataset(spark, args.dataset, args.scenario)
    except (ValueError, OSError) as error:
        print(error, file=sys.stderr)
        return 2
    runtime = evaluation.Runtime.of(args.scenario, files.scene_nodes(read), files.scene_links(read), files.scene_types(read))
    _, summaries, winners, failures = evaluation.run(items, {n: known[n](runtime) for n in names}, limit=args.limit)
    markdown, html = evaluate.report(summaries, winners, f"Evaluation of {args.scenario}")
    for path in files.write_report(markdown, html, args.out, args.scenario):
        print(path)
    for name, error in failures:
        print(f"{name}: {error}", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
