"""Run a pipeline from a parameter file: ``python -m velofield.plans.cli piv params.xml --images 'dir/*.png' -o out``."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import SparkSession

from velofield.params import Piv, from_json, from_xml
from velofield.plans import pipelines
from velofield.sources import frames as sources
from velofield.sources import sinks


def parse(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("pipeline", choices=["piv", "mean", "preproc", "flow"])
    parser.add_argument("params", nargs="?", help="JSON or XML parameters, or a JSON list of tools")
    parser.add_argument("--images", required=True)
    parser.add_argument("--subset", default=None)
    parser.add_argument("--how", default="new_dir")
    parser.add_argument("-o", "--output", required=True)
    return parser.parse_args(argv)


def main(argv: list[str] | None = None) -> None:
    args = parse(argv)
    spark = SparkSession.builder.getOrCreate()
    frames = sources.read_images(spark, args.images)
    text = Path(args.params).read_text() if args.params else None
    if args.pipeline == "piv":
        params = Piv() if text is None else from_xml(Piv, text) if text.lstrip().startswith("<") else from_json(Piv, text)
        sinks.write_vectors(pipelines.piv_of_series(frames, params), args.output, args.how)
    elif args.pipeline == "flow":
        from velofield.operators.pairing import make_couples

        sinks.write_vectors(pipelines.optical_flow(make_couples(frames)), args.output, args.how)
    elif args.pipeline == "preproc":
        sinks.write_frames(pipelines.preprocess(frames, [tuple(t) for t in json.loads(text or "[]")]), args.output, args.how)
    else:
        row = frames.where("error is null").select("height", "width").first()
        pipelines.mean_image(frames, row["height"], row["width"]).write.mode(sinks.mode_of(args.how)).parquet(args.output)


if __name__ == "__main__":
    main()
