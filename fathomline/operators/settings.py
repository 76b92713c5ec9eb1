"""Configuration files, model registries, provenance and checks of records. All of it is small and lives on the driver."""

from __future__ import annotations

import datetime
import hashlib
import json
import logging
import os
import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def load_yaml(path: str) -> dict:
    """The mapping in a YAML file; an empty file is an empty one."""
    import yaml

    if not os.path.exists(path):
        raise FileNotFoundError(f"no configuration at {path}")
    with open(path, encoding="utf-8") as f:
        found = yaml.safe_load(f)
    if found is not None and not isinstance(found, dict):
        raise ValueError(f"{path} holds a {type(found).__name__}, not a mapping")
    return found or {}


def load_config(path: str, model):
    """A YAML file checked by a pydantic model."""
    return model.model_validate(load_yaml(path))


def config_hash(config) -> str:
    """Twelve hex digits that equal configurations share, whatever the order of their keys; pydantic models count as mappings.

    Fixed format: the SHA-256 of the JSON text with sorted keys.
    """
    plain = config.model_dump(mode="json") if hasattr(config, "model_dump") else config
    return hashlib.sha256(json.dumps(plain, sort_keys=True, default=str).encode()).hexdigest()[:12]


def write_threshold(path: str, key: str, value: float) -> None:
    """Puts a number into the first line of a YAML file that has the key; the rest of the line goes."""
    with open(path, encoding="utf-8") as f:
        lines = f.read().split("\n")
    for i, line in enumerate(lines):
        if line.lstrip().startswith(f"{key}:"):
            lines[i] = f"{line[: len(line) - len(line.lstrip())]}{key}: {value:.3f}"
            break
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines))


def file_digest(path: str) -> str:
    """The SHA-256 of a file, which is not held in memory."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def validated_model(path: str) -> tuple[list[str], list[str]]:
    """Names of the inputs and outputs of an ONNX file that loads on a CPU."""
    if not os.path.exists(path):
        raise FileNotFoundError(f"no model at {path}")
    try:
        import onnxruntime

        session = onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"])
    except Exception as e:
        raise ValueError(f"{path} failed to load: {e}") from e
    return [x.name for x in session.get_inputs()], [x.name for x in session.get_outputs()]


def registered(registry: str, name: str, version: str, path: str, trained_on: str | None = None, metrics_file: str | None = None, date: str | None = None) -> dict:
    """Puts a model that loads into a JSON registry, in place of one of its name; gives its entry."""
    inputs, outputs = validated_model(path)
    entry = {"version": version, "onnx_path": path, "sha256": file_digest(path), "trained_on": trained_on, "metrics_file": metrics_file, "date": date or datetime.date.today().isoformat(), "inputs": inputs, "outputs": outputs}
    known = read_registry(registry) if os.path.exists(registry) else {}
    os.makedirs(os.path.dirname(os.path.abspath(registry)), exist_ok=True)
    draft = f"{registry}.{os.getpid()}"
    with open(draft, "w", encoding="utf-8") as f:
        json.dump(known | {name: entry}, f, indent=2, sort_keys=True)
        f.write("\n")
    os.replace(draft, registry)
    return entry


def read_registry(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def model_path(registry: str, name: str) -> str:
    """Where a registered model is; KeyError for an unknown name."""
    known = read_registry(registry)
    if name not in known:
        raise KeyError(f"{name} is not in {registry}")
    return known[name]["onnx_path"]


def provenance(model_name: str, model_version: str, config, **extra) -> dict:
    """What made a result: model, version, hash of the configuration ("none" without one), and whatever else is given."""
    made = {"model_name": model_name, "model_version": model_version, "config_hash": "none" if config is None else config_hash(config)}
    return made | ({"extra": extra} if extra else {})


def stamped(df: DataFrame, made: dict) -> DataFrame:
    """df with a struct column provenance."""
    plain = {k: json.dumps(v, sort_keys=True, default=str) if k == "extra" else v for k, v in made.items()}
    return df.withColumn("provenance", F.struct(*[F.lit(v).alias(k) for k, v in plain.items()]))


def frame_faults(mode: Column, least_width: Column, greatest_width: Column, rows: Column) -> Column:
    """What is wrong with a frame: its mode, rows of unequal width, no rows; null if nothing is."""
    return F.when(~F.coalesce(mode.isin("full", "degraded"), F.lit(False)), "mode").when(rows == 0, "empty").when(least_width != greatest_width, "ragged")


def checked_frames(frames: DataFrame, pings: DataFrame) -> DataFrame:
    """frame, mode, n_pings, width and fault of every frame (frames: frame, mode; pings: frame, samples)."""
    own = pings.groupBy("frame").agg(F.count("*").alias("n_pings"), F.min(F.size("samples")).alias("_low"), F.max(F.size("samples")).alias("width"))
    rows = frames.join(own, "frame", "left").withColumn("n_pings", F.coalesce("n_pings", F.lit(0)))
    return rows.select("frame", "mode", "n_pings", "width", frame_faults(F.col("mode"), F.col("_low"), F.col("width"), F.col("n_pings")).alias("fault"))


def logger(name: str = "fathomline") -> logging.Logger:
    """One logger a name, with one handler."""
    log = logging.getLogger(name)
    if not log.handlers:
        handler = logging.StreamHandler(sys.stderr)
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
        log.addHandler(handler)
        log.setLevel(logging.INFO)
        log.propagate = False
    return log
