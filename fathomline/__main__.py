"""python -m fathomline COMMAND: preprocess or inspect survey files, make manifests, link splits, register models."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .operators import datasets, manifest, settings
from .plans import survey
from .sources import readers


def arguments(given: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="fathomline")
    commands = parser.add_subparsers(dest="command", required=True)
    own = commands.add_parser("preprocess", help="run all steps on a file")
    own.add_argument("file")
    own.add_argument("--config")
    own.add_argument("--out", help="folder for the resulting pings and tile scores")
    own.add_argument("--save-steps")
    own = commands.add_parser("inspect", help="what is in a file")
    own.add_argument("file")
    own = commands.add_parser("manifest", help="list a data set's images with their classes and splits")
    own.add_argument("root")
    own.add_argument("out")
    own.add_argument("--seed", type=int, default=1337)
    own = commands.add_parser("split", help="link a manifest's files by split")
    own.add_argument("manifest")
    own.add_argument("out")
    own.add_argument("--classes", help="names with commas between; none: images only")
    own = commands.add_parser("register", help="put a model that loads into a registry")
    own.add_argument("model")
    own.add_argument("name")
    own.add_argument("version")
    own.add_argument("--registry", default="registry.json")
    own.add_argument("--trained-on")
    own.add_argument("--metrics")
    return parser.parse_args(given)


def main(given: list[str] | None = None) -> int:
    a, log = arguments(given), settings.logger()
    if a.command == "register":
        print(settings.registered(a.registry, a.name, a.version, a.model, a.trained_on, a.metrics))
        return 0
    spark = SparkSession.builder.appName("fathomline").getOrCreate()
    if a.command == "inspect":
        readers.inspected(*readers.read_any(spark, a.file)).show(truncate=False)
    elif a.command == "preprocess":
        frames, pings = readers.read_any(spark, a.file)
        result = survey.run(pings.select("frame", "ping", "samples"), settings.load_yaml(a.config) if a.config else None, save_steps=a.save_steps)
        if a.out:
            result.pings.write.mode("overwrite").parquet(f"{a.out}/pings")
            if result.qualities is not None:
                result.qualities.write.mode("overwrite").parquet(f"{a.out}/qualities")
        for step in result.steps:
            log.info("%s: %.3f s", step, result.seconds[step])
        frames.show(truncate=False)
    elif a.command == "manifest":
        images, labels = datasets.listed(spark, a.root, "*.jpg"), datasets.label_files(spark, a.root)
        root = a.root if ":" in a.root else f"file:{a.root}"
        rows = manifest.hash_split(datasets.manifests(images, labels, root.rstrip("/")), a.seed)
        for part in ("detection", "segmentation", "anomaly"):
            manifest.write_manifest(rows.filter(rows["component"] == part), f"{a.out}/{part}")
    else:
        names = a.classes.split(",") if a.classes else None
        print(datasets.materialized_split(manifest.read_manifest(spark, a.manifest), a.out, names))
    return 0


if __name__ == "__main__":
    sys.exit(main())
