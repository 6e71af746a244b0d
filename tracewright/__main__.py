"""``python -m tracewright list`` or
``python -m tracewright run NAME [SF_DIR] [--table NAME=PATH ...] [--size WxH] [--fps F] [--set ID=VALUE ...] [--prereq] [--out DIR]``."""

import argparse


def bound(spark, tables: list[str], size: str | None, fps: float | None):
    from tracewright.sources.bindings import Bound

    frames = {}
    for given in tables:
        name, _, path = given.partition("=")
        frames[name] = spark.read.json(path) if path.rstrip("/").endswith((".json", ".jsonl")) else spark.read.parquet(path)
    width, height = map(float, size.lower().split("x")) if size else (None, None)
    return Bound(frames, width, height, fps)


def main(argv: list[str] | None = None) -> None:
    from tracewright.operators import evidence
    from tracewright.operators.registry import OPERATORS, find
    from tracewright.plans import catalog

    p = argparse.ArgumentParser(prog="tracewright")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list")
    run = sub.add_parser("run")
    run.add_argument("name", help="an operator or a query")
    run.add_argument("sf_dir", nargs="?", help="a folder of driver tables")
    run.add_argument("--table", action="append", default=[], metavar="NAME=PATH", help="instead of a folder: a table of your own, Parquet or JSON lines; may be repeated")
    run.add_argument("--size", help="width x height of the picture that a bound table's places are in, as 1920x1080")
    run.add_argument("--fps", type=float, help="frames a second of a bound table, whose t is in seconds")
    run.add_argument("--set", action="append", default=[], metavar="ID=VALUE", help="a setting of the operator; may be repeated")
    run.add_argument("--prereq", action="store_true", help="run the operators first that this one reads from")
    run.add_argument("--out", help="write JSON lines in a folder here for each operator instead of printing 20 rows")
    a = p.parse_args(argv)
    if a.command == "list":
        for o in OPERATORS:
            print(f"stage {o.stage}  {o.id}  ({o.query})  reads {', '.join(o.reads)}  " + ", ".join(f"{s.id}={s.default} [{s.label}]" for s in o.settings))
        print("queries: " + ", ".join(sorted(catalog.QUERIES)))
        return
    from pyspark.sql import SparkSession

    given = dict(x.partition("=")[::2] for x in a.set)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    known = {o.id for o in OPERATORS}
    if bool(a.table) == bool(a.sf_dir):
        p.error("give a folder or tables of your own, one of the two")
    source = a.sf_dir or bound(spark, a.table, a.size, a.fps)
    if a.name not in known and given:
        p.error("settings belong to operators; a query has none")
    for name in [*(evidence.plan(a.name, set(), most=len(known)) if a.prereq else []), a.name]:
        settings = given if name == a.name else {}
        df = find(name).run(spark, source, settings) if name in known else catalog.QUERIES[name](spark, source)
        if a.out:
            df.write.mode("overwrite").json(f"{a.out}/{name}")
        else:
            print(name)
            df.show(20, False)


if __name__ == "__main__":
    main()
