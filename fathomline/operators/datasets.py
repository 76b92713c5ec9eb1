"""Data sets from file listings: manifests of the three parts, split layouts, training tiles, detector metrics."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .manifest import CLASSES, class_set, group_of, source_of

#: Where a source's images come from, and the classes of masks.
ORIGINS = {"ai4": "real", "sctd": "real", "pipe20xx": "unverified", "pure_synth_subpipe": "synthetic", "pure_synth_uatd": "synthetic", "synth_net": "synthetic", "normal_seabed": "synthetic"}
MASK_CLASSES = ["shipwreck", "ghost_net"]
#: The provider's folders of images and of their labels, and the split that they stand for.
DETECTION_FOLDERS = [("test", "train", "train"), ("val", "val", "val")]
SEGMENTATION_FOLDERS = [("train", "train", "train"), ("val", "val", "val")]
COLUMNS = ["component", "image_path", "label_path", "source_dataset", "source_group_id", "provider_split", "label_type", "origin", "classes"]


def listed(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """path of every file that the pattern names, in order of path; contents are not read."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    return reader.load(folder).select("path").orderBy("path")


def label_files(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """path and text of label files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.decode("content", "UTF-8").alias("text"))


def stem_of(path: Column) -> Column:
    """A path's file name without its suffix."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def lookup(key: Column, table: dict[str, str], other: str) -> Column:
    """The value of a small table, or ``other``."""
    entries = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*entries), key), F.lit(other)) if entries else F.lit(other)


def labelled_class_sets(labels: DataFrame, names: list[str]) -> DataFrame:
    """label_path and the names of the classes in a label file (path, text)."""
    ids = F.transform(F.filter(F.split("text", r"\r?\n"), lambda x: F.trim(x) != ""), lambda x: F.split(F.trim(x), r"\s+")[0].cast("int"))
    return labels.select(F.col("path").alias("label_path"), class_set(ids, names).alias("classes"))


def paired(images: DataFrame, labels: DataFrame, root: str, part: str, folders: list[tuple[str, str, str]], label_type: str, names: list[str], origins: dict[str, str]) -> DataFrame:
    """Manifest rows of a part whose images have labels by stem; an image without a label file has no classes."""
    dims = [F.when(F.col("path").startswith(f"{root}/{part}/images/{i}/"), F.struct(F.lit(f"{root}/{part}/labels/{j}/").alias("labels"), F.lit(s).alias("split"))) for i, j, s in folders]
    rows = images.select(F.col("path").alias("image_path"), F.coalesce(*dims).alias("own")).filter("own IS NOT NULL")
    stem = stem_of(F.col("image_path"))
    named = rows.select("image_path", F.concat("own.labels", stem, F.lit(".txt")).alias("label_path"), source_of(stem).alias("source_dataset"), group_of(source_of(stem), stem).alias("source_group_id"), F.col("own.split").alias("provider_split"))
    joined = named.join(labelled_class_sets(labels, names), "label_path", "left")
    return joined.select(F.lit(part.lower()).alias("component"), "image_path", "label_path", "source_dataset", "source_group_id", "provider_split", F.lit(label_type).alias("label_type"), lookup(F.col("source_dataset"), origins, "unknown").alias("origin"), F.coalesce("classes", F.lit("")).alias("classes"))


def detection_rows(images: DataFrame, labels: DataFrame, root: str, origins: dict[str, str] = ORIGINS) -> DataFrame:
    """Boxes: the provider keeps the training labels of images/test in labels/train."""
    return paired(images, labels, root, "Detection", DETECTION_FOLDERS, "box", CLASSES, origins)


def segmentation_rows(images: DataFrame, labels: DataFrame, root: str, origins: dict[str, str] = ORIGINS) -> DataFrame:
    return paired(images, labels, root, "Segmentation", SEGMENTATION_FOLDERS, "mask", MASK_CLASSES, origins)


def anomaly_rows(images: DataFrame, root: str) -> DataFrame:
    """Images without objects: no labels, each its own group."""
    rows = images.filter(F.col("path").startswith(f"{root}/AnomalyScreen/normal_seabed/"))
    fixed = {"label_path": "", "source_dataset": "normal_seabed", "provider_split": "unsplit", "label_type": "none", "origin": "synthetic", "classes": ""}
    made = rows.select(F.lit("anomaly").alias("component"), F.col("path").alias("image_path"), stem_of(F.col("path")).alias("source_group_id"), *[F.lit(v).alias(k) for k, v in fixed.items()])
    return made.select(*COLUMNS)


def manifests(images: DataFrame, labels: DataFrame, root: str, origins: dict[str, str] = ORIGINS) -> DataFrame:
    """The rows of all three parts, told apart by component."""
    return detection_rows(images, labels, root, origins).unionByName(segmentation_rows(images, labels, root, origins)).unionByName(anomaly_rows(images, root))


def with_digests(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """manifest with the SHA-256 of each image; files: path, content."""
    return manifest.join(files.select(F.col("path").alias("image_path"), F.sha2("content", 256).alias("sha256")), "image_path", "left").withColumn("sha256", F.coalesce("sha256", F.lit("")))


def first_rows(manifest: DataFrame, n: int, split: str | None = None) -> DataFrame:
    """The first n rows in order of path, of one split if it is named."""
    rows = manifest if split is None else manifest.filter(F.col("split") == split)
    return rows.orderBy("image_path").limit(n)


def split_layout(manifest: DataFrame, out: str) -> DataFrame:
    """manifest with the places of its images and labels in a tree by split."""
    name = F.regexp_extract("image_path", r"([^/]+)$", 1)
    label = F.concat(F.lit(f"{out}/labels/"), "split", F.lit("/"), stem_of(F.col("image_path")), F.lit(".txt"))
    return manifest.withColumns({"image_to": F.concat(F.lit(f"{out}/images/"), "split", F.lit("/"), name), "label_to": F.when(F.coalesce(F.col("label_path"), F.lit("")) != "", label)})


def linked(layout: DataFrame) -> DataFrame:
    """Links the files of a layout on a file system that all workers share: split, images and labels that there are now.

    A link that there was is replaced; a label is linked only if its file exists.
    """

    def link(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                done = {}
                for kind in ("image", "label"):
                    source, target = (row[f"{kind}_{x}"] for x in ("path", "to"))
                    done[kind] = int(bool(target) and os.path.exists(source.removeprefix("file:")))
                    if done[kind] or (kind == "image" and target):
                        os.makedirs(os.path.dirname(target), exist_ok=True)
                        draft = f"{target}.{os.getpid()}"
                        os.symlink(os.path.abspath(source.removeprefix("file:")), draft)
                        os.replace(draft, target)
                        done[kind] = 1
                out.append((row["split"], done["image"], done["label"]))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*out, strict=True)) or [[]] * 3, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["split", "images", "labels"])

    rows = layout.select("split", "image_path", "image_to", "label_path", "label_to").mapInArrow(link, "split string, images long, labels long")
    return rows.groupBy("split").agg(F.sum("images").alias("images"), F.sum("labels").alias("labels"))


def data_file(out: str, names: list[str] | None, note: str = "") -> str:
    """The text that tells trainers where a tree's splits are (names: of its classes, none without labels)."""
    import yaml

    body = {"path": out, **{x: f"images/{x}" for x in ("train", "val", "test")}, "nc": len(names), "names": names} if names is not None else {x: f"{out}/images/{x}" for x in ("train", "val", "test")}
    return "".join(f"# {x}\n" for x in note.splitlines()) + yaml.safe_dump(body, sort_keys=False)


def materialized_split(manifest: DataFrame, out: str, names: list[str] | None, note: str = "") -> dict[str, int]:
    """Links a manifest's files by split, writes data.yaml and gives the images of each split."""
    counts = {x.split: x.images for x in linked(split_layout(manifest, out)).collect()}  # a row a split
    os.makedirs(out, exist_ok=True)
    with open(f"{out}/data.yaml", "w", encoding="utf-8") as f:
        f.write(data_file(out, names, note))
    return {x: counts.get(x, 0) for x in ("train", "val", "test")}


def source_subset(manifest: DataFrame, source: str, split: str = "test") -> DataFrame:
    """One source's rows of one split, all put in the split "test"."""
    return manifest.filter((F.col("source_dataset") == source) & (F.col("split") == split)).withColumn("split", F.lit("test"))


def chance(*key: Column) -> Column:
    """A number in 0 .. 1 that the key alone decides."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[x.cast("string") for x in key])), 1, 8), 16, 10).cast("double") / 2**32


def training_tiles(tiles: DataFrame, keep_background: float, seed: int = 1337, least_fill: float = 0.0) -> DataFrame:
    """frame, row_off, col_off and n_object of full tiles (pixels: frame, row_off, col_off, r, c, on, v) worth training on.

    Tiles without an object are kept with a chance that frame, place and seed decide; tiles with too few pixels above 5 go.
    """
    size = tiles.groupBy("frame", "row_off", "col_off").agg(F.sum("on").cast("long").alias("n_object"), F.avg((F.col("v") > 5).cast("int")).alias("fill"))
    kept = (F.col("n_object") > 0) | (chance(F.lit(seed), F.col("frame"), F.col("row_off"), F.col("col_off")) < keep_background)
    return size.filter(kept & (F.col("fill") >= least_fill)).select("frame", "row_off", "col_off", "n_object")


def class_rows(results: DataFrame, names: list[str] = CLASSES, origins: dict[str, str] | None = None) -> DataFrame:
    """class, origin, ap50, ap, p, r of a detector's result rows (arrays class_index, ap50, ap, p, r of equal length)."""
    each = results.select(F.explode(F.arrays_zip("class_index", "ap50", "ap", "p", "r")).alias("x"))
    name = F.element_at(F.array(*map(F.lit, names)), (F.col("x.class_index") + 1).cast("int"))
    return each.select(name.alias("class"), *[F.col(f"x.{k}").alias(k) for k in ("ap50", "ap", "p", "r")]).withColumn("origin", lookup(F.col("class"), origins or {}, "?"))


def detector_boxes(images: DataFrame, detect: Callable[[np.ndarray], list[tuple]], least: float = 0.25, size: int = 640) -> DataFrame:
    """tile, ord, x1, y1, x2, y2, cls, conf: a detector's boxes on grey images (tile, height, width, data), in a square of ``size``.

    detect: image -> (x1, y1, x2, y2, class, confidence) in the image's pixels; boxes below ``least`` go; corners are cut
    towards zero, after one division (77 rows times the rounded 640 / 77 would end at 639).
    """

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                image = np.frombuffer(x["data"], np.uint8).reshape(x["height"], x["width"])
                side, w, h = float(size), x["width"], x["height"]
                found = [b for b in detect(image) if b[5] >= least]
                out += [(x["tile"], i, int(a * side / w), int(b * side / h), int(c * side / w), int(d * side / h), str(cls), float(conf)) for i, (a, b, c, d, cls, conf) in enumerate(found)]
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(list(zip(*out, strict=True)) or [[]] * 8, kinds, strict=True)], names=["tile", "ord", "x1", "y1", "x2", "y2", "cls", "conf"])

    return images.select("tile", "height", "width", "data").mapInArrow(apply, "tile string, ord int, x1 int, y1 int, x2 int, y2 int, cls string, conf double")


def rescaled(boxes: DataFrame, width: Column, height: Column, size: int = 640) -> DataFrame:
    """Boxes of an image of that width and height in a square of ``size``; corners are cut towards zero."""
    return boxes.withColumns({k: (F.col(k) * F.lit(float(size)) / (width if k[0] == "x" else height)).cast("int") for k in ("x1", "y1", "x2", "y2")})


def to_full(r: Column, c: Column, row_off: Column, col_off: Column) -> tuple[Column, Column]:
    """A place in a tile as a place in the whole image."""
    return r + row_off, c + col_off
