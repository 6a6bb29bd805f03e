"""Command line: ``run``, ``score-class``, ``materialise`` and ``candidate``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from . import experiments
from .config import load_config


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="rollbook")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("run", "score-class", "materialise", "candidate"):
        p = sub.add_parser(name)
        p.add_argument("--config", required=True)
        if name == "score-class":
            for x in ("--as-of-date", "--school-id", "--class-id"):
                p.add_argument(x, required=True)
        if name in ("materialise", "candidate"):
            p.add_argument("--features-dir", required=True)
        if name == "candidate":
            p.add_argument("--candidate-dir", required=True)
            p.add_argument("--log", required=True)
            p.add_argument("--no-importance", action="store_true")
    a = parser.parse_args(argv)
    spark = SparkSession.builder.appName("rollbook").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    config = load_config(a.config)
    if a.command == "run":
        experiments.run(spark, config)
    elif a.command == "score-class":
        for name, path in experiments.score_class(spark, config, a.as_of_date, a.school_id, a.class_id).items():
            print(f"{name}: {path}")
    elif a.command == "materialise":
        experiments.materialise(spark, config, a.features_dir)
    else:
        experiments.run_candidate(spark, a.candidate_dir, a.features_dir, config, a.log, not a.no_importance)


if __name__ == "__main__":
    main()
