"""Uploaded files, decoded images and the upload store."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from idsieve.settings import DEFAULT, Settings

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files as rows: path, modified, size_bytes, filename, content. A file of 2 GB or more does not fit; see ``read_heads``."""
    return _named(spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path))


def stream_files(spark: SparkSession, path: str, glob: str = "*", max_files: int = 10_000) -> DataFrame:
    """The same as a stream; content types declared by the sender are not used."""
    reader = spark.readStream.format("binaryFile").schema(FILE_SCHEMA)
    return _named(reader.option("pathGlobFilter", glob).option("maxFilesPerTrigger", max_files).load(path))


def _named(files: DataFrame, last: str = "content") -> DataFrame:
    return files.select(
        "path", F.col("modificationTime").alias("modified"), F.col("length").alias("size_bytes"),
        F.regexp_extract("path", r"[^/]*$", 0).alias("filename"), last)


WHOLE = 64 * 1024 * 1024  # bytes of a file that is read into one value, at most; a value cannot hold 2 GB


def read_heads(spark: SparkSession, path: str, glob: str = "*", n: int = 4, whole: int = WHOLE) -> DataFrame:
    """Files of any size as rows: path, modified, size_bytes, filename, head (the first ``n`` bytes).

    Files of at most ``whole`` bytes are read by the tasks. Of larger ones, of which any store has few for its size, the
    first bytes are asked for by the driver, in the file system that Spark uses, when this is called.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    small = files.filter(F.col("length") <= whole).withColumn("head", F.substring("content", 1, n))
    large = files.filter(F.col("length") > whole).drop("content")
    paths = [r.path for r in large.select("path").collect()]
    if not paths:
        return _named(small, "head")

    def head(name: str) -> bytearray:
        at = spark._jvm.org.apache.hadoop.fs.Path(name)
        stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
        try:
            return bytearray(stream.readNBytes(n))
        finally:
            stream.close()

    with ThreadPoolExecutor(8) as pool:
        heads = spark.createDataFrame([*zip(paths, pool.map(head, paths), strict=True)], "path string, head binary")
    return _named(small, "head").unionByName(_named(large.join(heads, "path"), "head"))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded images: path, height, width, channels, data (rows of BGR bytes).

    Files that do not decode have no row here; the left join in intake turns
    that into CORRUPT_IMAGE.
    """
    raw = spark.read.format("image").option("dropInvalid", True).load(path)
    return raw.select(
        # The two sources spell local paths differently.
        F.regexp_replace("image.origin", "^file:///", "file:/").alias("path"), F.col("image.height").alias("height"),
        F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"),
        F.col("image.data").alias("data"))


CELLS = "path string, plane string, r int, c int, value double, img_h int, img_w int"
COLOR_CELLS = "path string, r int, c int, blue double, green double, red double"


def _pixels(row) -> np.ndarray:
    a = np.frombuffer(row.data, dtype=np.uint8).reshape(row.height, row.width, row.channels)
    return np.repeat(a, 3, axis=2) if row.channels == 1 else a[:, :, :3]


def _bands(images: Iterator[pd.DataFrame], rows: int) -> Iterator[tuple]:
    """Images in bands of rows, so that a 40-Mpx image never becomes one frame of cells."""
    for pdf in images:
        for row in pdf.itertuples():
            px = _pixels(row).astype(np.float64)
            for top in range(0, row.height, rows):
                yield row, top, px[top:top + rows]


def gray_cells(images: DataFrame, band: int = 256) -> DataFrame:
    """Long table of gray cells (ITU-R 601 weights)."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row, top, px in _bands(batches, band):
            gray = np.rint(px @ np.array([0.114, 0.587, 0.299]))
            r, c = np.indices(gray.shape)
            yield pd.DataFrame({
                "path": row.path, "plane": "gray", "r": (r + top).ravel(), "c": c.ravel(),
                "value": gray.ravel(), "img_h": row.height, "img_w": row.width})

    return images.mapInPandas(cut, CELLS)


def color_cells(images: DataFrame, band: int = 256) -> DataFrame:
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row, top, px in _bands(batches, band):
            r, c = np.indices(px.shape[:2])
            yield pd.DataFrame({
                "path": row.path, "r": (r + top).ravel(), "c": c.ravel(), "blue": px[:, :, 0].ravel(),
                "green": px[:, :, 1].ravel(), "red": px[:, :, 2].ravel()})

    return images.mapInPandas(cut, COLOR_CELLS)


def stored_name(path: Column, ext: Column) -> Column:
    """Name in the store: a hash and the checked extension; nothing of the sent name is used,
    so that no path can be escaped."""
    return F.concat(F.left(F.sha2(path, 256), F.lit(32)), ext)


def store_uploads(accepted: DataFrame, path: str, settings: Settings = DEFAULT) -> DataFrame | None:
    """Keep accepted bytes by day when the policy says so, else nothing is written."""
    if not settings.retain_uploads:
        return None
    kept = accepted.filter("code IS NULL").select(
        stored_name(F.col("path"), F.col("ext")).alias("name"), "content", "modified",
        F.date_format("modified", "yyyy-MM-dd").alias("day"))
    kept.write.mode("append").partitionBy("day").parquet(path)
    return kept.drop("content")


def without(stored: DataFrame, names: DataFrame) -> DataFrame:
    """The store without the named files, to be written as its next version."""
    return stored.join(names.select("name").distinct(), "name", "left_anti")
