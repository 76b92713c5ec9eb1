"""Survey files to tables: one row a ping with its samples, one row a frame.

Files come in as Spark's binaryFile or image rows, so any store that Spark reads will do, and are parsed file by file on
the executors. XTF and JSF are read by their public layouts. Zero stands for an unknown position, heading or altitude
and becomes null; nothing unknown is invented.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import side_by_side

#: File suffixes by reader. Fixed values.
SUFFIXES = {"xtf": ["xtf"], "jsf": ["jsf"], "image": ["png", "jpg", "jpeg", "bmp", "tif", "tiff"]}
RAW = "frame string, ping int, port array<double>, starboard array<double>, lat double, lon double, heading double, altitude_m double, slant_res double"
PINGS = "frame string, ping int, samples array<double>, lat double, lon double, heading double, altitude_m double"

XTF_HEADER, XTF_MAGIC, XTF_SONAR = 1024, 0xFACE, 0
JSF_HEADER, JSF_MARKER, JSF_SONAR, JSF_BODY = struct.Struct("<HBBHBBBBHI"), 0x1601, 80, 240
JSF_KINDS = {0: "<i2", 1: "<i2", 2: "<i4", 3: "<i4", 9: "<u2"}


def known(*values: float) -> float | None:
    """The first value that is not zero."""
    return next((float(x) for x in values if x), None)


def xtf_pings(data: bytes) -> list[dict]:
    """Sonar pings of an XTF file; a missing starboard channel repeats port."""
    if len(data) < XTF_HEADER or data[0] != 123:
        raise ValueError("no XTF file")
    widths = [struct.unpack_from("<H", data, 256 + 128 * i + 6)[0] for i in range(6)]
    out, at = [], XTF_HEADER
    while at + 14 <= len(data):
        magic, kind, _, channels = struct.unpack_from("<HBBH", data, at)
        size = struct.unpack_from("<I", data, at + 10)[0]
        if magic != XTF_MAGIC or size < 14:
            at += 1
            continue
        if at + size > len(data):
            break
        if kind == XTF_SONAR:
            lat, lon = struct.unpack_from("<dd", data, at + 160)
            primary, auxiliary = struct.unpack_from("<ff", data, at + 196)
            heading = struct.unpack_from("<f", data, at + 212)[0]
            rows, res, p = [], None, at + 256
            for c in range(channels):
                slant = struct.unpack_from("<f", data, p + 4)[0]
                n = struct.unpack_from("<I", data, p + 42)[0]
                width = widths[c] if c < 6 and widths[c] in (1, 2, 4) else 2
                rows.append(np.frombuffer(data, f"<u{width}", n, p + 64).astype(float))
                if c == 0 and slant and n:
                    res = float(slant) / n
                p += 64 + n * width
            port = rows[0] if rows else np.zeros(1)
            out.append({"port": port, "starboard": rows[1] if len(rows) > 1 else port, "lat": known(lat), "lon": known(lon), "heading": known(heading), "altitude_m": known(primary, auxiliary), "slant_res": res})
        at += size
    if not out:
        raise ValueError("no sonar packets")
    return out


def jsf_pings(data: bytes) -> list[dict]:
    """Sonar messages of a JSF file, one row each whatever the channel; a bad marker is passed byte by byte."""
    out, at = [], 0
    while at + JSF_HEADER.size <= len(data):
        head = JSF_HEADER.unpack_from(data, at)
        if head[0] != JSF_MARKER:
            at = data.find(struct.pack("<H", JSF_MARKER), at + 1)
            if at < 0:
                break
            continue
        end = at + JSF_HEADER.size + head[9]
        if end > len(data):
            break
        if head[3] == JSF_SONAR:
            body = data[at + JSF_HEADER.size : end]
            samples = np.zeros(0)
            if len(body) >= JSF_BODY:
                kind = np.dtype(JSF_KINDS.get(struct.unpack_from("<H", body, 126)[0], "<i2"))
                n = min(struct.unpack_from("<H", body, 114)[0], (len(body) - JSF_BODY) // kind.itemsize)
                samples = np.frombuffer(body, kind, n, JSF_BODY).astype(float)
            out.append({"port": np.zeros(0), "starboard": samples, "channel": head[6]})
        at = end
    if not out:
        raise ValueError("no sonar-data messages")
    return out


def parsed(files: DataFrame, parse) -> DataFrame:
    """RAW rows of binaryFile rows."""

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [{"frame": path, "ping": i, "lat": None, "lon": None, "heading": None, "altitude_m": None, "slant_res": None} | {k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in x.items() if k != "channel"} for i, x in enumerate(parse(content))]
                kinds = {"frame": pa.string(), "ping": pa.int32(), "port": pa.list_(pa.float64()), "starboard": pa.list_(pa.float64())}
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds.get(k, pa.float64())) for k in (c.split()[0] for c in RAW.split(", "))], names=[c.split()[0] for c in RAW.split(", ")])

    return files.select("path", "content").mapInArrow(apply, RAW)


def files(spark: SparkSession, path: str, suffixes: list[str]) -> DataFrame:
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return rows.filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(suffixes))


def stretched_samples(pings: DataFrame) -> DataFrame:
    """Samples between a frame's 1st and 99th percentile, padding included, as 0..255 truncated."""
    ends = pings.select("frame", F.explode("samples").alias("v")).groupBy("frame").agg(F.percentile("v", F.lit(0.01)).alias("lo"), F.percentile("v", F.lit(0.99)).alias("hi"))
    top = F.when(F.col("hi") <= F.col("lo"), F.col("lo") + 1).otherwise(F.col("hi"))
    scaled = F.transform("samples", lambda v: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - F.col("lo")) / (top - F.col("lo")))) * 255).cast("double"))
    return pings.join(ends, "frame").withColumn("samples", scaled).drop("lo", "hi")


def read_xtf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Frames and pings of XTF files: port and starboard side by side, nadir in the middle."""
    raw = parsed(files(spark, path, SUFFIXES["xtf"]), xtf_pings)
    width = raw.groupBy("frame").agg(F.max(F.greatest(F.size("port"), F.size("starboard"))).alias("w"), F.percentile("slant_res", F.lit(0.5)).alias("slant_res"), (F.count("altitude_m") > 0).alias("known"))
    wide = raw.drop("slant_res").join(width.select("frame", "w"), "frame").withColumn("samples", side_by_side(F.col("port"), F.col("starboard"), F.col("w")))
    frames = width.select("frame", F.lit("full").alias("mode"), "slant_res", F.lit(None).cast("double").alias("along_res"), F.when(F.col("known"), "file").alias("altitude_source"))
    return frames, stretched_samples(wide.select(*[c.split()[0] for c in PINGS.split(", ")]))


def read_jsf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Frames and pings of JSF files, without navigation; shorter rows are filled with zeros on the right."""
    raw = parsed(files(spark, path, SUFFIXES["jsf"]), jsf_pings)
    width = raw.groupBy("frame").agg(F.max(F.size("starboard")).alias("w"))
    wide = raw.join(width, "frame").withColumn("samples", F.concat("starboard", F.array_repeat(F.lit(0.0), F.col("w") - F.size("starboard"))))
    frames = width.select("frame", F.lit("full").alias("mode"), *[F.lit(None).cast(t).alias(c) for c, t in (("slant_res", "double"), ("along_res", "double"), ("altitude_source", "string"))])
    return frames, stretched_samples(wide.select(*[c.split()[0] for c in PINGS.split(", ")]))


def grey_rows(images: DataFrame) -> DataFrame:
    """PINGS rows of image rows: colour to grey by the 601 weights in fixed point."""

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                data = np.frombuffer(x["data"], np.uint8).reshape(x["height"], x["width"], x["nChannels"]).astype(np.int64)
                grey = data[:, :, 0] if x["nChannels"] == 1 else (data[:, :, 2] * 19595 + data[:, :, 1] * 38470 + data[:, :, 0] * 7471 + 32768) >> 16
                none = pa.nulls(x["height"], pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array([x["origin"]] * x["height"]), pa.array(range(x["height"]), pa.int32()), pa.array(grey.astype(float).tolist(), pa.list_(pa.float64())), none, none, none, none], names=[c.split()[0] for c in PINGS.split(", ")])

    return images.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data").mapInArrow(apply, PINGS)


def read_image(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Frames and pings of raster images: degraded mode, navigation and resolutions unknown; unreadable files are left out."""
    images = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(path)
    frames = images.select(F.col("image.origin").alias("frame"), F.lit("degraded").alias("mode"), *[F.lit(None).cast(t).alias(c) for c, t in (("slant_res", "double"), ("along_res", "double"), ("altitude_source", "string"))])
    return frames, grey_rows(images)


def read_any(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Frames and pings of one file by its suffix."""
    suffix = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    for kind, suffixes in SUFFIXES.items():
        if suffix in suffixes:
            return {"xtf": read_xtf, "jsf": read_jsf, "image": read_image}[kind](spark, path)
    raise ValueError(f"no reader for {path}")


def inspected(frames: DataFrame, pings: DataFrame) -> DataFrame:
    """Per frame: pings, width, whether positions are known, least and greatest altitude, resolution."""
    own = pings.groupBy("frame").agg(F.count("*").alias("n_pings"), F.max(F.size("samples")).alias("width"), F.bool_or(F.col("lat").isNotNull()).alias("has_nav"), F.min("altitude_m").alias("low"), F.max("altitude_m").alias("high"))
    return frames.join(own, "frame")
