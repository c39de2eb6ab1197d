"""python -m gridloom.cli info|crop|resample|invert: the data operations of the command line."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from gridloom.functions.timefn import parse
from gridloom.operators import interp, solve, stack
from gridloom.plans.session import session
from gridloom.sources import files


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="gridloom")
    sub = p.add_subparsers(dest="what", required=True)
    a = sub.add_parser("info")
    a.add_argument("stack")
    a = sub.add_parser("crop")
    a.add_argument("stack")
    a.add_argument("out")
    a.add_argument("--rows", nargs=2, type=int)
    a.add_argument("--cols", nargs=2, type=int)
    a.add_argument("--times", nargs=2, type=float)
    a = sub.add_parser("resample")
    a.add_argument("raster")
    a.add_argument("like")
    a.add_argument("out")
    a.add_argument("--order", type=int, default=1)
    a = sub.add_parser("invert")
    a.add_argument("stack")
    a.add_argument("out")
    a.add_argument("--model", required=True, help="[linear(tref=2000);cos(period=1)]")
    a.add_argument("--solver", default="lsqr")
    a.add_argument("--interp", type=int, default=200)
    a.add_argument("--n-std", type=float, default=3.0)
    a.add_argument("--n-iter", type=int, default=1)
    args = p.parse_args(argv)
    spark = session()
    if args.what == "info":
        obs, epochs = files.read_stack(spark, args.stack)
        stack.shape(obs).crossJoin(stack.mean_interval(epochs)).crossJoin(stack.median_interval(epochs).withColumnRenamed("dt", "median_dt")).show()
    elif args.what == "crop":
        obs, epochs = files.read_stack(spark, args.stack)
        if args.rows and args.cols:
            obs = stack.chunk(obs, *args.rows, *args.cols)
        if args.times:
            obs = stack.crop_times(obs, epochs, *args.times)
        files.write_stack(obs, epochs, args.out)
    elif args.what == "resample":
        like = files.read_raster(spark, args.like)
        files.write_raster(interp.resample(files.read_raster(spark, args.raster), like.header, args.order), args.out)
    else:
        obs, epochs = files.read_stack(spark, args.stack)
        ends = epochs.agg(F.min("tdec").alias("a"), F.max("tdec").alias("b"))
        n = args.interp
        grid = spark.range(n).crossJoin(F.broadcast(ends)).select(F.col("id").cast("int").alias("k"), (F.col("a") + (F.col("b") - F.col("a")) * F.col("id") / (n - 1)).alias("tdec"))
        out = solve.inversion(obs, epochs, grid, parse(args.model), solver=solve.select_solver(args.solver), n_std=args.n_std, n_iter=args.n_iter)
        for name, df in out.items():
            df.write.parquet(f"{args.out}/{name}")


if __name__ == "__main__":
    main()
