"""Command line: queries over a folder of tables, and runs of configurations."""

from __future__ import annotations

import argparse
import json
import sys


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _show(value) -> None:
    print(json.dumps(value, indent=2, default=str))


def _query(args) -> int:
    from recallgrid.plans.queries import ORACLE_SQL, QUERIES

    if args.command == "list":
        print("\n".join(sorted(QUERIES)))
        return 0
    if args.name not in (ORACLE_SQL if args.command == "sql" else QUERIES):
        print(f"unknown name: {args.name}", file=sys.stderr)
        return 2
    if args.command == "sql":
        print(ORACLE_SQL[args.name])
        return 0
    result = QUERIES[args.name](_session(), args.data)
    if args.out:
        result.write.mode("errorifexists").parquet(args.out)
    else:
        result.show(20, truncate=False)
    return 0


def _config(args) -> int:
    from recallgrid.sources import experiment as X

    if getattr(args, "data", None):
        args.name = args.config
        return _query(args)
    if args.command == "smoke" and args.config is None:
        from recallgrid.sources.runner import SMOKE

        config = X.resolve(SMOKE)
    else:
        config = X.load_config(args.config)
    if args.command == "inspect-config":
        _show(config)
        return 0
    if args.command == "prepare":
        from recallgrid.sources.readers import example_index
        from recallgrid.sources.registry import dataset
        from recallgrid.sources.runner import named

        given = dict(config["dataset"])
        examples = dataset(_session(), given["type"], chunk=given.get("chunk"), limit=args.limit, **named(given.get("params", {})))
        folder = args.outputdir or "data/prepared"
        example_index(examples).write.mode("overwrite").json(f"{folder}/dataset_index")
        _show({"examples_indexed": _session().read.json(f"{folder}/dataset_index").count(), "output": folder})
        return 0
    from recallgrid.sources.runner import run_experiment

    out = args.outputdir or config["outputdir"]
    _show(run_experiment(_session(), config, out, getattr(args, "limit", None))["aggregate"])
    print(out)
    return 0


def _compare(args) -> int:
    from recallgrid.operators.stats import comparison

    spark = _session()
    read = lambda folder: spark.read.json(f"{folder.rstrip('/')}/per_example")
    report = comparison(read(args.baseline), read(args.treatment), args.metric, samples=args.samples, signs=args.signs, seed=args.seed)
    _show([r.asDict() for r in report.orderBy("metric").collect()])  # a row for each metric that was named
    return 0


def _doctor(_) -> int:
    from recallgrid.sources.experiment import doctor

    _show(doctor())
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="recallgrid")
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, does, about: str, config: bool | None = None):
        made = commands.add_parser(name, help=about)
        made.set_defaults(does=does)
        if config is not None:
            made.add_argument("config" if config else "--config", help="a JSON or YAML file")
        return made

    command("list", _query, "names of all queries")
    command("sql", _query, "the SQL that a query is checked with").add_argument("name")
    run = command("run", _config, "run a configuration, or a query by name over Parquet tables", config=True)
    run.add_argument("--data", help="folder of the tables of a query")
    run.add_argument("--out", help="folder for a query's result as Parquet; shown without it")
    smoke = command("smoke", _config, "run a small configuration that needs no files", config=False)
    prepare = command("prepare", _config, "index the dataset of a configuration", config=True)
    for made in (run, smoke, prepare):
        made.add_argument("--outputdir")
    for made in (run, prepare):
        made.add_argument("--limit", type=int)
    command("inspect-config", _config, "a configuration with all its defaults", config=True)
    compare = command("compare", _compare, "compare two runs example by example")
    compare.add_argument("baseline")
    compare.add_argument("treatment")
    compare.add_argument("--metric", action="append", required=True)
    compare.add_argument("--samples", type=int, default=10_000)
    compare.add_argument("--signs", type=int, default=100_000)
    compare.add_argument("--seed", type=int, default=0)
    command("doctor", _doctor, "versions of what the engine needs")
    args = parser.parse_args(argv)
    return args.does(args)


if __name__ == "__main__":
    sys.exit(main())
