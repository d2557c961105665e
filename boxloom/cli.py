"""Commands: generate, count, sample, inspect, validate, run-suite, aggregate."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .operators import decompose, generator, joins, records, samplers
from .plans import runs as plan
from .sources import boxfile, runs


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="boxloom", description=__doc__)
    c = p.add_subparsers(dest="command", required=True)
    g = c.add_parser("generate", help="certified synthetic boxes into a box file")
    for name, kind, default in (("n", int, 2000), ("d", int, 2), ("alpha", float, 10.0), ("family", str, "lognormal"), ("cv", float, 1.0), ("sigma", float, 0.0), ("seed", int, 0)):
        g.add_argument(f"--{name}", type=kind, default=default)
    g.add_argument("path")
    for name in ("count", "inspect"):
        c.add_parser(name).add_argument("path")
    s = c.add_parser("sample", help="join pairs as Parquet of pos, r_id, s_id")
    s.add_argument("path")
    s.add_argument("out")
    s.add_argument("-t", type=int, default=1000)
    s.add_argument("--kind", choices=samplers.KINDS, default="compiled")
    s.add_argument("--seed", default="0" * 64)
    s.add_argument("--query-id", type=int, default=0)
    v = c.add_parser("validate", help="counts, membership and distributions of all kinds of samples of box files; fails if any does")
    v.add_argument("-t", type=int, default=100_000)
    v.add_argument("paths", nargs="+")
    u = c.add_parser("run-suite", help="all tasks, modes and algorithms over box files; what has a record is not run again")
    u.add_argument("out")
    u.add_argument("paths", nargs="+")
    u.add_argument("-t", type=int, nargs="+", default=[1000])
    u.add_argument("--tasks", nargs="+", choices=sorted(plan.MODES), default=["oneshot"])
    u.add_argument("--limit", type=float, help="seconds of a run")
    a = c.add_parser("aggregate", help="a report from run records")
    a.add_argument("out")
    a.add_argument("records", nargs="+")
    o = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if o.command == "generate":
        config = generator.with_size(generator.BoxConfig(max(1, o.n // 2), max(1, o.n - o.n // 2), o.d, o.alpha, o.family, o.cv, o.sigma), o.n)
        found = generator.solve(config, o.seed)
        if found.status != "CERTIFIED":
            print(found, file=sys.stderr)
            return 3
        print(json.dumps(boxfile.save(generator.generate(spark, config, found, o.seed), o.path, generator.description(config, found, o.seed))))
    elif o.command == "count":
        print(decompose.total(decompose.atoms(boxfile.load(spark, o.path))[0]).first()["w"])
    elif o.command == "inspect":
        print(plan.describe(boxfile.load(spark, o.path), 0))
    elif o.command == "sample":
        join = boxfile.load(spark, o.path)
        sampler = samplers.make_sampler(o.kind, join, o.seed)
        sampler.sample(o.t, o.query_id).write.mode("overwrite").parquet(o.out)
        if joins.invalid_pairs(join, spark.read.parquet(o.out)).limit(1).count():
            print("MEMBERSHIP-MISMATCH", file=sys.stderr)
            return 1
        print(sampler.status(o.t))
    elif o.command == "validate":
        found = plan.validate({path: boxfile.load(spark, path) for path in o.paths}, o.t).orderBy("workload", "kind").collect()
        for row in found:
            print(*row)
        return int(any(row["status"] != "PASS" for row in found))
    elif o.command == "run-suite":
        cases = spark.createDataFrame([(path, "t", float(t), t, "t") for path in o.paths for t in o.t], "workload_id string, x_name string, x_value double, t bigint, sweep string")
        print(plan.run_suite(plan.planned(cases, tuple(o.tasks)), lambda path: boxfile.load(spark, path), o.out, o.limit))
    else:
        runs.write_report(records.RunReport(runs.read_runs(spark, *o.records)), o.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
