"""Image files as DataFrames: listing, one file a stem, and decoded grayscale frames."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names


def list_images(spark: SparkSession, folder: str) -> DataFrame:
    """(path) of the folder's own image files, by suffix in any case; file contents are not read."""
    return spark.read.format("binaryFile").load(folder).select("path").where(names.is_image(F.col("path"))).orderBy("path")


def index_images(files: DataFrame) -> DataFrame:
    """(stem, path): of several files with one stem the last in order."""
    return files.select(names.image_stem(F.col("path")).alias("stem"), "path").groupBy("stem").agg(F.max("path").alias("path"))


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, height, width, pixels): one row a frame, 8-bit gray in row order. An undecodable file raises."""
    raw = spark.read.format("image").option("dropInvalid", "false").load(folder).select("image.*")
    checked = raw.where(F.when(F.col("height") < 0, F.raise_error(F.concat(F.lit("not an image: "), F.col("origin")))).otherwise(F.lit(True)))

    def gray(batches):
        for b in batches:
            out = []
            for h, w, n, data in zip(*(b.column(k).to_pylist() for k in ("height", "width", "nChannels", "data")), strict=True):
                x = np.frombuffer(data, np.uint8).reshape(h, w, n)
                # stored as blue, green, red; the usual luma weights
                out.append((x[..., 0] if n == 1 else np.rint(x[..., :3] @ np.array([0.114, 0.587, 0.299]))).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("origin"), b.column("height"), b.column("width"), pa.array(out, pa.binary())], ["path", "height", "width", "pixels"])

    return checked.select("origin", "height", "width", "nChannels", "data").mapInArrow(gray, "path string, height int, width int, pixels binary")


def png(pixels: np.ndarray) -> bytes:
    """A PNG of an 8-bit raster (h, w) or (h, w, 3)."""
    import struct
    import zlib

    h, w = pixels.shape[:2]
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = np.concatenate((np.zeros((h, 1), np.uint8), pixels.reshape(h, -1).astype(np.uint8)), axis=1)
    out = io.BytesIO()
    out.write(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if pixels.ndim == 3 else 0, 0, 0, 0)))
    out.write(part(b"IDAT", zlib.compress(rows.tobytes())) + part(b"IEND", b""))
    return out.getvalue()


# The colours of instances, in turn, and that of annotators' outlines.
PALETTE = ((255, 99, 71), (65, 105, 225), (255, 215, 0), (186, 85, 211), (0, 206, 209), (255, 140, 0))
GREEN = (0, 255, 0)


def outlined(frame: np.ndarray, labels: np.ndarray, palette=PALETTE) -> np.ndarray:
    """A colour frame with each instance's border in one of the palette's colours."""
    out = np.repeat(frame[..., None], 3, axis=2).astype(np.uint8)
    for k in range(1, int(labels.max(initial=0)) + 1):
        m = np.pad(labels == k, 1)
        inner = m[1:-1, 1:-1] & m[:-2, 1:-1] & m[2:, 1:-1] & m[1:-1, :-2] & m[1:-1, 2:]
        out[(labels == k) & ~inner] = palette[(k - 1) % len(palette)]
    return out
