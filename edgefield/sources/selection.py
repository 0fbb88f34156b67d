"""Choosing images for a validation set from annotation tables, and reading manifests and annotation text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def select_images(annotations: DataFrame, images: DataFrame, labels: list[int], licences: list[int], least_area: float = 1024.0, least_objects: int = 3, count: int = 100) -> DataFrame:
    """Images of allowed licences with enough objects that are single, of a wanted label and large; most objects first, then by id.

    annotations: image_id, ann_id, label, iscrowd, x, y, w, h; images: image_id, licence. Objects come as an array of corner
    boxes, two decimals, by annotation id."""
    good = annotations.where(~F.col("iscrowd") & F.col("label").isin(labels) & (F.col("w") * F.col("h") >= least_area))
    objects = good.groupBy("image_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("ann_id", "label", "x", "y", (F.col("x") + F.col("w")).alias("x1"), (F.col("y") + F.col("h")).alias("y1")))).alias("objects")).where(F.col("n") >= least_objects)
    return objects.join(images.where(F.col("licence").isin(licences)), "image_id").orderBy(F.desc("n"), "image_id").limit(count)


def subject_images(annotations: DataFrame, wanted: str, main_not: str) -> DataFrame:
    """Images with a wanted object whose largest object is of another kind than main_not. annotations: image_id, ann_id, cls, area."""
    per = annotations.groupBy("image_id").agg(F.max_by("cls", F.struct("area", -F.col("ann_id"))).alias("main"), F.bool_or(F.col("cls") == wanted).alias("has"))
    return per.where(F.col("has") & (F.col("main") != main_not)).select("image_id", "main")


def parse_annotations(lines: DataFrame) -> DataFrame:
    """lines: value. Annotation text, a class and x y w h on each line, % begins a comment: cls and corner box."""
    fields = F.split(F.trim("value"), r"\s+")
    rows = lines.where((F.trim("value") != "") & ~F.col("value").startswith("%")).withColumn("f", fields).where(F.size("f") >= 5)
    x, y, w, h = (F.get("f", F.lit(i)).try_cast("double") for i in range(1, 5))
    return rows.select(F.get("f", F.lit(0)).alias("cls"), x.alias("x0"), y.alias("y0"), (x + w).alias("x1"), (y + h).alias("y1")).where("y1 IS NOT NULL AND x1 IS NOT NULL")


def manifest(spark: SparkSession, path: str, known: list[str], limit: int = 0) -> tuple[DataFrame, DataFrame]:
    """Frames and truths of a manifest: {"images": [{"file", "objects": [{"label", "box": [x0, y0, x1, y1]}]}]}.

    The limit is of images and is applied before any image is read; 0 means all. Objects of unknown labels are left out.
    Frames have image_id and file; truths have image_id, label, gt_idx and the box."""
    schema = "images array<struct<file:string,objects:array<struct<label:string,box:array<double>>>>>"
    images = spark.read.schema(schema).json(path, multiLine=True).select(F.posexplode("images").alias("image_id", "i"))
    if limit:
        images = images.where(F.col("image_id") < limit)
    numbers = F.create_map(*[F.lit(v) for i, k in enumerate(known) for v in (k, i)])
    truths = images.select("image_id", F.posexplode("i.objects").alias("at", "o")).withColumn("label", F.try_element_at(numbers, F.col("o.label"))).where("label IS NOT NULL")
    order = Window.partitionBy("image_id", "label").orderBy("at")
    box = [F.get("o.box", F.lit(i)).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))]
    return images.select("image_id", F.col("i.file").alias("file")), truths.withColumn("gt_idx", F.row_number().over(order)).select("image_id", "label", "gt_idx", *box)


def intact(wanted: DataFrame, folder: str) -> DataFrame:
    """wanted: file, sha256. Those of its files whose bytes have the digest that is wanted; missing and damaged ones go."""
    found = wanted.sparkSession.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("_sha256"))
    return wanted.join(found, "file").where(F.lower("sha256") == F.col("_sha256")).drop("_sha256")


def with_pixels(frames: DataFrame, folder: str) -> DataFrame:
    """Frames joined with their files' bytes and digest; files that are missing drop their frames."""
    files = frames.sparkSession.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content", F.sha2("content", 256).alias("sha256"))
    return frames.join(files, "file")
