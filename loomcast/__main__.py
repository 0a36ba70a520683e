"""Commands: python -m loomcast <command> [--config FILE] [--set name=value ...] ...

  queries                         names of the registered queries
  run NAME FOLDER                 one query over the tables of a folder, its first rows
  fetch SOURCE PATH OUT           records of a named source (--accept TERMS)
  curate RECORDS OUT              index, removed rows and report of measured records
  dive LOGS                       the report of a dive's logs
  simulate OUT                    dives of the guidance (--hours, --seeds)
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession

from . import config


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="loomcast", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    out.add_argument("command", choices=["queries", "run", "fetch", "curate", "dive", "simulate"])
    out.add_argument("args", nargs="*")
    out.add_argument("--config")
    out.add_argument("--set", nargs="*", default=[], metavar="NAME=VALUE")
    out.add_argument("--accept")
    out.add_argument("--hours", type=float, default=1.0)
    out.add_argument("--seeds", type=int, nargs="+", default=[0])
    return out


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> str:
    """What a command has to say."""
    from .operators import curation, dive, simulate
    from .plans import catalogue
    from .sources import dispatch, readers, writers

    a = parser().parse_args(argv)
    if a.command == "queries":
        return "\n".join(sorted(catalogue.queries()))
    spark = spark or SparkSession.builder.appName("loomcast").getOrCreate()
    settings = config.override(config.load(spark, a.config) if a.config else {}, a.set)
    if a.command == "run":
        name, folder = a.args
        return writers.markdown(catalogue.queries()[name](spark, folder).limit(20))
    if a.command == "fetch":
        name, path, out = a.args
        writers.write_table(dispatch.fetch(spark, name, path, a.accept, **settings), out)
        return f"{name}: {spark.read.parquet(out).count()} records"
    if a.command == "curate":
        path, out = a.args
        index, removed, log = curation.curate(readers.read_table(spark, path, spark.read.parquet(path).schema), curation.Settings.of(settings))
        writers.write_table(index, f"{out}/index")
        writers.write_table(removed, f"{out}/removed")
        return curation.report(spark.read.parquet(f"{out}/index"), spark.read.parquet(f"{out}/removed"), log)
    if a.command == "dive":
        return dive.report(*readers.read_logs(spark, a.args))
    (out,) = a.args
    grid = [(s, float(light), float(settings.get("density", 0.002)), nav, seed) for s in settings.get("strategies", ["adaptive"]) for light in settings.get("lights", [0.3]) for nav in settings.get("nav", [True]) for seed in a.seeds]
    rows = simulate.dives(spark.createDataFrame(grid, "strategy string, light double, density double, nav boolean, seed int"), a.hours, config.apply(simulate.Sea(side=120.0), settings.get("sea", {})))
    writers.write_table(rows, out)
    from .operators import experiments

    return experiments.grid_report(spark.read.parquet(out), ["strategy", "light", "nav"], ["value_per_h", "animals_per_h", "detections_per_h"])


if __name__ == "__main__":
    print(main())
