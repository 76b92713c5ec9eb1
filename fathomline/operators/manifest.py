"""Dataset manifests: sources and groups from file names, leak-free splits, cards, registries."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Name prefixes in the order they are tried, and the constant group of one source.
PREFIXES = ["pure_synth_subpipe", "pure_synth_uatd", "ai4", "sctd", "pipe20xx", "synth_net", "normal"]
CLASSES = ["shipwreck", "aircraft", "pipe", "cylinder", "ghost_net"]
COLUMNS = ["image_path", "label_path", "source_dataset", "source_group_id", "split", "provider_split", "label_type", "origin", "classes", "sha256"]


def source_of(stem: Column) -> Column:
    """The first prefix that a file's stem has."""
    out = F.lit("other")
    for prefix in reversed(PREFIXES):
        out = F.when(stem.startswith(prefix), "normal_seabed" if prefix == "normal" else prefix).otherwise(out)
    return out


def group_of(source: Column, stem: Column) -> Column:
    """What must not be split: the site, the whole source, or the image."""
    return F.when(source == "ai4", F.regexp_replace(stem, r"_\d+$", "")).when(source == "pipe20xx", "pipe20xx_2010").otherwise(stem)


def class_set(ids: Column, names: list[str] = CLASSES) -> Column:
    """Names of the distinct class ids in range, in order of id, joined by a bar."""
    known = F.array_sort(F.array_distinct(F.filter(ids, lambda i: (i >= 0) & (i < len(names)))))
    return F.array_join(F.transform(known, lambda i: F.element_at(F.array(*map(F.lit, names)), i.cast("int") + 1)), "|")


def label_boxes(lines: DataFrame, size: int = 640) -> DataFrame:
    """image, class_id and pixel corners from lines "class cx cy w h ..." with shares of the size; shorter lines are skipped."""
    part = F.split(F.trim("line"), r"\s+")
    rows = lines.select("image", part.alias("p")).filter(F.size("p") >= 5)
    cx, cy, w, h = (F.col("p")[i].cast("double") for i in (1, 2, 3, 4))
    corner = lambda x: (x * size).cast("int")  # noqa: E731  towards zero
    return rows.select("image", F.col("p")[0].cast("double").cast("int").alias("class_id"), corner(cx - w / 2).alias("x1"), corner(cy - h / 2).alias("y1"), corner(cx + w / 2).alias("x2"), corner(cy + h / 2).alias("y2"))


def cut_points(n: Column, train: float = 0.7, val: float = 0.15) -> tuple[Column, Column]:
    """How many groups come before val and before test; halves are rounded to even."""
    first = F.bround(n * F.lit(train))
    return first, first + F.bround(n * F.lit(val))


def hash_split(manifest: DataFrame, seed: int = 1337) -> DataFrame:
    """manifest with split: groups of each source in the order of a keyed hash, so that no group is in two splits."""
    groups = manifest.select("source_dataset", "source_group_id").distinct()
    order = Window.partitionBy("source_dataset").orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), "source_group_id"), 256), "source_group_id")
    numbered = groups.withColumns({"k": F.row_number().over(order) - 1, "n": F.count("*").over(Window.partitionBy("source_dataset"))})
    train, val = cut_points(F.col("n"))
    named = numbered.select("source_dataset", "source_group_id", F.when(F.col("k") < train, "train").when(F.col("k") < val, "val").otherwise("test").alias("split"))
    return manifest.drop("split").join(named, ["source_dataset", "source_group_id"])


def seeded_split(ids: list[str], seed: int, train: float = 0.7, val: float = 0.15, test: float = 0.15) -> dict[str, str]:
    """id -> split by a seeded shuffle of the sorted distinct ids (exact for a seed; for id lists that fit the driver)."""
    if abs(train + val + test - 1) > 1e-6:
        raise ValueError("ratios must sum to 1")
    names = sorted(set(ids))
    random.Random(seed).shuffle(names)
    first = round(train * len(names))
    second = first + round(val * len(names))
    return {x: "train" if i < first else "val" if i < second else "test" for i, x in enumerate(names)}


def split_leaks(manifest: DataFrame) -> DataFrame:
    """Groups that are in more than one split."""
    return manifest.groupBy("source_group_id").agg(F.count_distinct("split").alias("n_splits")).filter("n_splits > 1")


def split_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Images that two manifests put in different splits."""
    left, right = a.select("image_path", F.col("split").alias("split_a")), b.select("image_path", F.col("split").alias("split_b"))
    return left.join(right, "image_path").filter("split_a <> split_b")


def dataset_card(manifest: DataFrame) -> DataFrame:
    """Per origin and class: images in train, val and test; an image counts for each of its classes."""
    rows = manifest.select("origin", "split", F.explode(F.split("classes", r"\|")).alias("class")).filter("class <> ''")
    return rows.groupBy("origin", "class").pivot("split", ["train", "val", "test"]).count().na.fill(0)


def card_counts(manifest: DataFrame) -> DataFrame:
    """Rows and groups in all, by split and by origin."""
    return manifest.groupingSets([[F.col("split")], [F.col("origin")], []], "split", "origin").agg(F.count("*").alias("n_rows"), F.count_distinct("source_group_id").alias("n_groups"))


def latest(registry: DataFrame) -> DataFrame:
    """The newest row of each name (by seq)."""
    order = Window.partitionBy("name").orderBy(F.col("seq").desc())
    return registry.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def not_done(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among those done."""
    return rows.join(done.select(key), key, "left_anti")


def write_manifest(manifest: DataFrame, path: str) -> None:
    """CSV with the fixed columns, missing values empty."""
    have = [F.col(c).cast("string").alias(c) if c in manifest.columns else F.lit("").alias(c) for c in COLUMNS]
    manifest.select(*have).na.fill("").write.mode("overwrite").csv(path, header=True)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(", ".join(f"{c} string" for c in COLUMNS)).csv(path, header=True)


def materialize_splits(manifest: DataFrame, path: str) -> None:
    """The manifest partitioned by split: a filter on split then reads its folder only."""
    manifest.write.mode("overwrite").partitionBy("split").parquet(path)


def append_labels(new: DataFrame, path: str, key: str = "image_path") -> None:
    """Appends label rows whose key the file set does not have yet."""
    spark = new.sparkSession
    try:
        old = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        new.dropDuplicates([key]).write.parquet(path)
        return
    not_done(new, old, key).dropDuplicates([key]).write.mode("append").parquet(path)


def registry_upsert(spark: SparkSession, old: DataFrame | None, entry: dict) -> DataFrame:
    """The registry with an entry put in or replaced by name (columns name, version, onnx_path, sha256, date)."""
    new = spark.createDataFrame([entry])
    rows = new.withColumn("seq", F.lit(1)) if old is None else old.withColumn("seq", F.lit(0)).unionByName(new.withColumn("seq", F.lit(1)), allowMissingColumns=True)
    return latest(rows).drop("seq")
