"""Command line: tile, mvt, build, info."""

from __future__ import annotations

import argparse
import logging
from dataclasses import asdict

from pyspark.sql import SparkSession

from terrazzo.sources.catalog import Dataset, format_size


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="terrazzo", description=__doc__)
    p.add_argument("--log-level", default="INFO")
    sub = p.add_subparsers(dest="command", required=True)
    t = sub.add_parser("tile")
    t.add_argument("input")
    t.add_argument("outdir")
    t.add_argument("--num-tiles", type=int, default=40)
    t.add_argument("--partition-size", default="1gb")
    t.add_argument("--sort", default="zorder")
    t.add_argument("--compression", default="zstd")
    t.add_argument("--sample-cap", type=int, default=10_000)
    t.add_argument("--sample-ratio", type=float, default=1.0)
    t.add_argument("--seed", type=int, default=42)
    t.add_argument("--geom-col", default="geometry")
    t.add_argument("--sfc-bits", type=int, default=16)
    t.add_argument("--index")
    m = sub.add_parser("mvt")
    m.add_argument("tile_dir")
    m.add_argument("--zoom", type=int, default=7)
    m.add_argument("--threshold", type=float, default=0)
    m.add_argument("--outdir")
    b = sub.add_parser("build")
    b.add_argument("input")
    b.add_argument("outdir")
    b.add_argument("--zoom", type=int, default=7)
    b.add_argument("--num-tiles", type=int, default=40)
    b.add_argument("--threshold", type=float, default=100_000)
    i = sub.add_parser("info")
    i.add_argument("data_dir")
    return p


def info(path: str) -> dict:
    d = Dataset(path)
    return {"path": d.path, "tiles": d.num_tiles, "bbox": d.bbox, "zoom_levels": d.zoom_levels, "histograms": d.has_histograms, "mvt": d.has_mvt, "stats": d.has_stats, "size": format_size(d.size)}


def main(argv: list[str] | None = None) -> None:
    from . import build

    args = vars(parser().parse_args(argv))
    logging.basicConfig(level=args.pop("log_level"))
    command = args.pop("command")
    if command == "info":
        result = info(args["data_dir"])
    else:
        spark = SparkSession.builder.appName("terrazzo").config("spark.sql.session.timeZone", "UTC").getOrCreate()
        run = {"tile": build.tile, "mvt": build.generate_mvt, "build": build.build}[command]
        got = run(spark, **args)
        result = {type(r).__name__: asdict(r) for r in (got if isinstance(got, tuple) else (got,))}
    for k, v in result.items():
        print(f"{k}: {v}")


if __name__ == "__main__":
    main()
