"""Recognition of images: backends, a table of earlier results, and the preparation of images."""

from __future__ import annotations

import hashlib
import io
import shutil
from typing import Any, Protocol, runtime_checkable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.errors import OcrError
from pagewright.options import Options


@runtime_checkable
class Backend(Protocol):
    """Must survive pickling, as it is sent to the executors."""

    name: str

    def is_available(self) -> bool: ...

    def extract(self, image: bytes, *, languages: str, psm: int) -> str: ...

    def install_hint(self) -> str: ...


class Tesseract:
    """The command-line program through its Python package, where both are installed."""

    name = "tesseract"

    def is_available(self) -> bool:
        try:
            import PIL  # noqa: F401
            import pytesseract  # noqa: F401
        except ImportError:
            return False
        return shutil.which("tesseract") is not None

    def extract(self, image: bytes, *, languages: str, psm: int) -> str:
        """An image that can't be read gives an empty text."""
        try:
            import pytesseract
            from PIL import Image

            opened = Image.open(io.BytesIO(image))
            dpi = opened.info.get("dpi")

            def orientation(a: np.ndarray) -> int:
                try:
                    return int(pytesseract.image_to_osd(Image.fromarray(a), output_type=pytesseract.Output.DICT).get("rotate", 0))
                except Exception:
                    return 0

            pixels = prepare(np.array(opened.convert("L")), dpi[0] if isinstance(dpi, tuple) and dpi else 72, orientation)
            return pytesseract.image_to_string(Image.fromarray(pixels), lang=languages, config=f"--oem 3 --psm {psm}")
        except Exception:
            return ""

    def install_hint(self) -> str:
        return "Install the program tesseract with its language files, and the packages pytesseract and Pillow."


class Backends(dict[str, Backend]):
    """Engines by their names; asking for one that isn't there is an error of recognition."""

    def __missing__(self, name: str) -> Backend:
        raise OcrError(f"{name!r} is none of the backends: {', '.join(sorted(self))}")

    def add(self, engine: Backend, *, replace: bool = False) -> None:
        taken = engine.name in self and not replace
        if taken or not engine.name:
            raise ValueError(f"{engine.name!r} is {'taken' if taken else 'no name'}")
        self[engine.name] = engine


BACKENDS = Backends(tesseract=Tesseract())


def cache_key(payload: bytes, languages: str, psm: int) -> str:
    return hashlib.sha256(payload + f"|lang={languages}|psm={psm}".encode()).hexdigest()


def cache_key_column(payload: Column, languages: Column, psm: Column) -> Column:
    """The same key inside the JVM; languages begins with the backend's name and a colon."""
    suffix = F.concat(F.lit("|lang="), languages, F.lit("|psm="), psm.cast("string"))
    return F.sha2(F.concat(payload.cast("binary"), suffix.cast("binary")), 256)


def split_by_cache(images: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits with text, pending) of images with a cache_key; the cache may hold a key more than once."""
    known = cache.groupBy("cache_key").agg(F.first("text").alias("text"))
    return images.join(known, "cache_key"), images.join(known, "cache_key", "left_anti")


def recognise(images: DataFrame, options: Options, cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(images with text and cache_hit, what is new for the cache) of rows with payload (binary) and page_idx; texts known for a key aren't worked out again.

    Every distinct key is recognised once. Only keys pass through the joins with the cache; images meet the keys that are
    still wanted, each key's image once. An unavailable backend leaves null.
    """
    engine = BACKENDS[options.ocr_backend]
    psm = F.when(F.col("page_idx") == 0, F.lit(11)).otherwise(F.lit(options.ocr_psm))
    keyed = images.withColumn("cache_key", cache_key_column(F.col("payload"), F.lit(f"{engine.name}:{options.ocr_languages}"), psm)).withColumn("psm", psm)
    known = cache.select("cache_key", "text") if cache is not None and options.use_cache else images.sparkSession.createDataFrame([], "cache_key string, text string")
    known = known.groupBy("cache_key").agg(F.first("text").alias("text"), F.lit(True).alias("cache_hit"))
    new = known.select("cache_key", "text").limit(0)
    if engine.is_available():
        languages = options.ocr_languages

        @F.pandas_udf("string")
        def read(payload: pd.Series, psm: pd.Series) -> pd.Series:
            return pd.Series([engine.extract(bytes(p), languages=languages, psm=int(m)) for p, m in zip(payload, psm)], index=payload.index, dtype=object)

        wanted = keyed.select("cache_key").distinct().join(known, "cache_key", "left_anti")
        pending = keyed.select("cache_key", "payload", "psm").join(wanted, "cache_key", "left_semi").dropDuplicates(["cache_key"])
        if options.workers:
            pending = pending.repartition(options.workers)
        new = pending.select("cache_key", read("payload", "psm").alias("text"))
    texts = known.unionByName(new.withColumn("cache_hit", F.lit(False)))
    return keyed.drop("psm").join(texts, "cache_key", "left").withColumn("cache_hit", F.coalesce("cache_hit", F.lit(False))), new


def read_cache(spark: SparkSession, folder: str, ttl_days: int = 90) -> DataFrame:
    """(cache_key, text) of the texts that were kept in a folder within so many days; an empty table where there is none."""
    kinds = "cache_key string, text string, kept_at timestamp"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], kinds).select("cache_key", "text")
    kept = spark.read.schema(kinds).parquet(folder)
    return kept.where(F.col("kept_at") >= F.current_timestamp() - F.make_interval(days=F.lit(ttl_days))).select("cache_key", "text")


def keep_in_cache(new: DataFrame, folder: str) -> None:
    """Appends new texts, empty ones too, to the folder."""
    new.select("cache_key", "text", F.current_timestamp().alias("kept_at")).write.mode("append").parquet(folder)


# Preparation of grey images (height x width, uint8).


def otsu(a: np.ndarray) -> int:
    """The threshold that parts the grey levels best."""
    hist = np.bincount(a.ravel(), minlength=256).astype(float)
    weight = hist.cumsum()
    mean = (hist * np.arange(256)).cumsum()
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (mean[-1] * weight / weight[-1] - mean) ** 2 / (weight * (weight[-1] - weight))
    return int(np.nan_to_num(between[:-1], posinf=0).argmax())


def binarize(a: np.ndarray) -> np.ndarray:
    return np.where(a > otsu(a), 255, 0).astype(np.uint8)


def skew(a: np.ndarray, most: float = 10.0) -> float:
    """Angle in degrees by which the dark rows lie askew: the one whose row sums differ most."""
    ys, xs = np.nonzero(a <= otsu(a))
    if len(ys) * 2 < 100:
        return 0.0
    ys, xs = ys.astype(float), xs.astype(float)
    best, at = -1.0, 0.0
    for angle in np.arange(-most, most + 0.01, 0.25):
        rows = np.round(ys - xs * np.tan(np.radians(angle))).astype(int)
        score = float((np.bincount(rows - rows.min()) ** 2.0).sum())
        if score > best * (1 + 1e-9) or score == best and abs(angle) < abs(at):
            best, at = score, float(angle)
    return at


def deskew(a: np.ndarray, least: float = 0.3, most: float = 10.0) -> np.ndarray:
    """Turns small skews back; edges are repeated."""
    angle = skew(a, most)
    if not least <= abs(angle) <= most:
        return a
    h, w = a.shape
    y, x = np.mgrid[0:h, 0:w].astype(float)
    c, s = np.cos(np.radians(angle)), np.sin(np.radians(angle))
    cy, cx = (h - 1) / 2, (w - 1) / 2
    sy = np.clip(np.round(cy + (y - cy) * c + (x - cx) * s), 0, h - 1).astype(int)
    sx = np.clip(np.round(cx - (y - cy) * s + (x - cx) * c), 0, w - 1).astype(int)
    return a[sy, sx]


def upscale(a: np.ndarray, dpi: float, least: float = 300) -> np.ndarray:
    """Twice the size below the wanted resolution, three times below 100."""
    if dpi >= least:
        return a
    k = 3 if dpi < 100 else 2
    return np.repeat(np.repeat(a, k, axis=0), k, axis=1)


def equalise(a: np.ndarray, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Contrast-limited equalisation by tiles, blended between their centres."""
    h, w = a.shape
    if h < tiles or w < tiles:
        return a
    ys, xs = np.linspace(0, h, tiles + 1).astype(int), np.linspace(0, w, tiles + 1).astype(int)
    maps = np.zeros((tiles, tiles, 256))
    for i in range(tiles):
        for j in range(tiles):
            part = a[ys[i] : ys[i + 1], xs[j] : xs[j + 1]]
            hist = np.bincount(part.ravel(), minlength=256).astype(float)
            limit = max(1.0, clip * part.size / 256)
            over = np.maximum(hist - limit, 0).sum()
            hist = np.minimum(hist, limit) + over / 256
            maps[i, j] = hist.cumsum() * 255 / part.size
    gy = np.clip((np.arange(h) + 0.5) * tiles / h - 0.5, 0, tiles - 1)
    gx = np.clip((np.arange(w) + 0.5) * tiles / w - 0.5, 0, tiles - 1)
    y0, x0 = gy.astype(int), gx.astype(int)
    y1, x1 = np.minimum(y0 + 1, tiles - 1), np.minimum(x0 + 1, tiles - 1)
    fy, fx = (gy - y0)[:, None], (gx - x0)[None, :]
    top = maps[y0[:, None], x0[None, :], a] * (1 - fx) + maps[y0[:, None], x1[None, :], a] * fx
    low = maps[y1[:, None], x0[None, :], a] * (1 - fx) + maps[y1[:, None], x1[None, :], a] * fx
    return np.clip(np.round(top * (1 - fy) + low * fy), 0, 255).astype(np.uint8)


def median3(a: np.ndarray) -> np.ndarray:
    p = np.pad(a, 1, mode="edge")
    h, w = a.shape
    return np.median(np.stack([p[i : i + h, j : j + w] for i in range(3) for j in range(3)]), axis=0).astype(np.uint8)


def crop_borders(a: np.ndarray, least: int = 10, dark: float = 50) -> np.ndarray:
    """The box around all rows and columns that aren't dark, where an edge outside it is at least so many pixels thick."""
    box = []
    for axis, size in ((1, a.shape[0]), (0, a.shape[1])):
        light = np.flatnonzero(a.mean(axis=axis) >= dark) if size >= 3 * least else []
        box.append((int(light[0]), int(light[-1]) + 1, size) if len(light) else (0, size, size))
    if min(a.shape) < 3 * least or all(max(first, size - last) < least for first, last, size in box):
        return a
    return a[box[0][0] : box[0][1], box[1][0] : box[1][1]]


def rotate_quarter(a: np.ndarray, angle: int) -> np.ndarray:
    """Turned clockwise by a multiple of 90 degrees, which an orientation detector says would set the image upright."""
    return np.rot90(a, -(angle // 90) % 4)


def prepare(a: np.ndarray, dpi: float = 72, orientation: Any = None) -> np.ndarray:
    """The chain of steps; one that fails leaves the image as it was."""
    steps = (
        lambda x: rotate_quarter(x, orientation(x)) if orientation else x,
        deskew,
        lambda x: upscale(x, dpi),
        equalise,
        binarize,
        median3,
        crop_borders,
    )
    for step in steps:
        try:
            a = step(a)
        except (ValueError, IndexError, FloatingPointError):
            continue
    return a
