"""Admission, quality and preparation of images.

Decoding is Spark's ``image`` source (JPEG, PNG, BMP, GIF). Pixel work runs in Arrow
batches of NumPy, one output row per image.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitwarden.functions import grids as G

# Limits and formats of an upload.
MAX_UPLOAD_BYTES = 10 * 1024 * 1024
MODEL_SIZE = 224
ANALYSIS_SIDE = 360
MIN_SIDE = 3
SCALE_MODES = ("internal", "zero_one")


def image_format(content: Column) -> Column:
    """JPEG, PNG or WEBP by the leading bytes, else NULL."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(head.startswith("FFD8FF"), "JPEG")
        .when(head.startswith("89504E470D0A1A0A"), "PNG")
        .when(head.startswith("52494646") & head.substr(17, 8).eqNullSafe("57454250"), "WEBP")
    )


def admit_images(
    df: DataFrame, content: str = "content", max_bytes: int = MAX_UPLOAD_BYTES
) -> DataFrame:
    """Add ``image_format``, ``status`` (200 / 400 / 413 / 415) and ``rejection``.

    A WEBP upload has an accepted type but no decoder here, so it is reported as such.
    """
    body = F.col(content)
    size = F.coalesce(F.length(body), F.lit(0))
    kind = image_format(body)
    reason = (
        F.when(body.isNull(), "missing")
        .when(size > max_bytes, "too_large")
        .when(size == 0, "empty")
        .when(kind.isNull(), "unsupported_format")
        .when(kind == "WEBP", "no_decoder")
    )
    status = (
        F.when(reason == "missing", 400)
        .when(reason == "too_large", 413)
        .when(reason.isNotNull(), 415)
        .otherwise(200)
    )
    return df.withColumns({"image_format": kind, "rejection": reason, "status": status})


def grid_quality(
    df: DataFrame, gray: str, width: int, height: int
) -> DataFrame:
    """Brightness, sharpness and warnings of a gray grid column, in built-in functions."""
    measured = df.withColumns(
        {
            "brightness": G.brightness(gray),
            "blur_variance": G.sharpness(gray, width, height),
        }
    )
    return measured.withColumn(
        "warnings", G.quality_warnings("brightness", "blur_variance")
    )


def _pixels(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Rows x columns x RGB floats from the BGR bytes of the image source."""
    flat = np.frombuffer(data, np.uint8).astype(np.float32).reshape(height, width, channels)
    if channels == 1:
        return np.repeat(flat, 3, axis=2)
    return flat[:, :, [2, 1, 0]]


def bilinear(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Half-pixel bilinear resize without antialiasing."""

    def axis(new: int, old: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.maximum((np.arange(new) + 0.5) * old / new - 0.5, 0)
        low = np.minimum(np.floor(at).astype(int), old - 1)
        return low, np.minimum(low + 1, old - 1), (at - low).astype(np.float32)

    top, bottom, dy = axis(height, image.shape[0])
    left, right, dx = axis(width, image.shape[1])
    dx = dx[None, :, None]
    upper = image[top][:, left] * (1 - dx) + image[top][:, right] * dx
    lower = image[bottom][:, left] * (1 - dx) + image[bottom][:, right] * dx
    return upper * (1 - dy[:, None, None]) + lower * dy[:, None, None]


def luma_plane(image: np.ndarray) -> np.ndarray:
    return image @ np.asarray(G.LUMA, dtype=np.float32)


def readable_images(images: DataFrame) -> DataFrame:
    """Decoded rows of the image source as flat columns."""
    return images.select("image.*").filter("width > 0")


def _per_image(images: DataFrame, schema: str, measure) -> DataFrame:
    columns = ["origin", "height", "width", "nChannels", "data"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                {
                    "origin": r.origin,
                    **measure(_pixels(r.data, r.height, r.width, r.nChannels)),
                }
                for r in batch.itertuples(index=False)
            ]
            if rows:
                yield pd.DataFrame(rows)

    return readable_images(images).select(*columns).mapInPandas(run, schema)


def prepare_images(
    images: DataFrame, size: int = MODEL_SIZE, scale_mode: str = "internal"
) -> DataFrame:
    """RGB tensor of ``size`` x ``size`` as a flat float array, optionally divided by 255."""
    if scale_mode not in SCALE_MODES:
        raise ValueError(f"scale_mode must be one of {SCALE_MODES}")
    divisor = 255.0 if scale_mode == "zero_one" else 1.0

    def measure(pixels: np.ndarray) -> dict:
        tensor = bilinear(pixels, size, size) / divisor
        return {
            "original_width": pixels.shape[1],
            "original_height": pixels.shape[0],
            "tensor": tensor.astype(np.float32).ravel(),
        }

    return _per_image(
        images,
        "origin string, original_width int, original_height int, tensor array<float>",
        measure,
    )


def image_quality(images: DataFrame) -> DataFrame:
    """Brightness, sharpness and warnings of decoded images, long side scaled to 360."""

    def measure(pixels: np.ndarray) -> dict:
        height, width = pixels.shape[:2]
        scale = min(1.0, ANALYSIS_SIDE / max(width, height))
        new_width = max(MIN_SIDE, int(np.floor(width * scale + 0.5)))
        new_height = max(MIN_SIDE, int(np.floor(height * scale + 0.5)))
        if (new_width, new_height) != (width, height):
            pixels = bilinear(pixels, new_height, new_width)
        gray = luma_plane(pixels).astype(np.float64)
        inner = (
            4 * gray[1:-1, 1:-1]
            - gray[1:-1, :-2]
            - gray[1:-1, 2:]
            - gray[:-2, 1:-1]
            - gray[2:, 1:-1]
        )
        return {"brightness": float(gray.mean()), "blur_variance": float(inner.var())}

    measured = _per_image(
        images, "origin string, brightness double, blur_variance double", measure
    )
    return measured.withColumn(
        "warnings", G.quality_warnings("brightness", "blur_variance")
    )


def image_dhash(images: DataFrame, size: int = 8) -> DataFrame:
    """Difference hash of decoded images: gray plane resized to size x (size + 1)."""

    def measure(pixels: np.ndarray) -> dict:
        gray = luma_plane(pixels)[:, :, None]
        grid = np.rint(bilinear(gray, size, size + 1)[:, :, 0])
        return {"grid": grid.astype(np.float64).ravel()}

    grids = _per_image(images, "origin string, grid array<double>", measure)
    return grids.select("origin", G.dhash("grid", size, size + 1).alias("dhash"))
