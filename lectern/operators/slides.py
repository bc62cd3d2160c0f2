"""Slide extraction over frame relations: thresholds, blank frames, duplicate slides, video passages, manifests."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import BLANK_VARIANCE, minute_time
from .timeline import scan_keys

# Fixed values of the keyframe machine: bits that count as a change (similarity < 0.92 of 256), flags in the window,
# share of flags that marks a video passage, stable samples after it, least samples between slides.
CHANGE_SIMILARITY, WINDOW, VIDEO_SHARE, STABLE, SPACING = 0.92, 6, 0.7, 4, 6
#: Side of the hashes: 16 x 16 bits, four 64-bit words.
HASH_SIDE = 16


def scene_cuts(scenes: DataFrame, media: str = "media_id", score: str = "score", threshold: float = 0.1) -> DataFrame:
    """Scenes above the threshold; media without any fall back to half of it."""
    above = F.max((F.col(score) > threshold).cast("int")).over(Window.partitionBy(media))
    return scenes.withColumn("_any", above).where((F.col(score) > threshold) | ((F.col("_any") == 0) & (F.col(score) > threshold * 0.5))).drop("_any")


def not_blank(variance: Column) -> Column:
    return variance > BLANK_VARIANCE


def slide_names(slides: DataFrame, media: str, ts: str) -> DataFrame:
    """``slides`` with its number in the medium from 1 and the file name of the image."""
    n = F.row_number().over(Window.partitionBy(media).orderBy(ts))
    t = F.floor(ts)
    return slides.withColumn("slide", n).withColumn("file", F.format_string("%s_slide_%03d_%02dm%02ds.jpg", F.col(media).cast("string"), "slide", (t / 60).cast("int"), (t % 60).cast("int")))


@dataclass
class Machine:
    """What the extraction remembers: the hash compared against, recent change flags and a slide that waits."""

    seen: int | None = None
    flags: deque = field(default_factory=lambda: deque(maxlen=WINDOW))
    video: bool = False
    wait: tuple | None = None
    calm: int = 0
    at: int = -1
    last: int = -SPACING


def advance(m: Machine, ts: float, word: int, bits: int) -> list[float]:
    """Times of the slides taken at one sample."""
    m.at += 1
    changed = m.seen is not None and 1 - (word ^ m.seen).bit_count() / bits < CHANGE_SIMILARITY
    m.flags.append(changed)
    if len(m.flags) == WINDOW:
        left = m.video
        m.video = sum(m.flags) / WINDOW >= VIDEO_SHARE
        if left and not m.video:
            m.wait, m.calm = (ts, word), 1
    spaced, taken = m.at - m.last >= SPACING, []
    if m.video:
        m.wait, m.calm = None, 0
        return taken
    if m.wait is None:
        if m.seen is None or (changed and spaced):
            taken, m.last = [ts], m.at
        m.seen = word
    elif changed:
        m.wait, m.calm = (ts, word), 0
    else:
        m.calm += 1
        if m.calm >= STABLE:
            if spaced:
                taken, m.last = [m.wait[0]], m.at
            m.wait, m.calm, m.seen = None, 0, word
    return taken


def keyframes(frames: DataFrame, media: str, ts: str, word: str, bits: int = 64) -> DataFrame:
    """(media, ts) of the slides; passages that keep changing are skipped until they settle."""
    mask = (1 << bits) - 1

    def feed(m: Machine, rows: dict[str, np.ndarray]) -> dict[str, list]:
        return {ts: [t for at, w in zip(rows[ts].tolist(), rows[word].tolist(), strict=True) for t in advance(m, at, w & mask, bits)]}

    return scan_keys(frames, [media], [ts], Machine, feed, f"{ts} {dict(frames.dtypes)[ts]}", word)


def change_ratio(frames: DataFrame, media: str, ts: str, word: str, bits: int = 64) -> DataFrame:
    """Stateless part of the machine: change flags against the sample before and their share in the last six."""
    w = Window.partitionBy(media).orderBy(ts)
    far = F.bit_count(F.col(word).bitwiseXOR(F.lag(word).over(w))) / float(bits)
    flags = frames.withColumn("changed", F.coalesce((1 - far < CHANGE_SIMILARITY).cast("int"), F.lit(0)))
    last = w.rowsBetween(-(WINDOW - 1), 0)
    full = F.count("*").over(last) == WINDOW
    return flags.withColumn("in_video", F.coalesce(full & (F.sum("changed").over(last) / float(WINDOW) >= VIDEO_SHARE), F.lit(False)))


def manifest_line(media: Column, ts: Column) -> Column:
    return F.concat_ws(" ", media.cast("string"), minute_time(ts))


def slide_manifest(media: DataFrame, slides: DataFrame, on: str, file: str, error: str = "error") -> DataFrame:
    """(media, status, slides, files): every medium that was tried, its images in name order.

    A medium without slides still gets a row, a placeholder, so that it is not tried again; one whose extraction failed
    says why.
    """
    images = slides.groupBy(on).agg(F.array_sort(F.collect_list(file)).alias("files"), F.count("*").alias("slides"))
    n = F.coalesce("slides", F.lit(0))
    status = F.when(F.col(error).isNotNull(), F.concat(F.lit("failed: "), F.col(error))).when(n > 0, F.format_string("ok (%d)", n)).otherwise("placeholder")
    return media.select(on, error).join(images, on, "left").select(on, status.alias("status"), n.alias("slides"), F.coalesce("files", F.array().cast("array<string>")).alias("files"))


def _cosines(n: int, k: int) -> np.ndarray:
    """The first ``k`` rows of the type-II cosine transform of ``n`` samples."""
    return np.cos(np.pi * np.arange(k)[:, None] * (2 * np.arange(n)[None, :] + 1) / (2 * n))


def perceptual_bits(gray: np.ndarray) -> np.ndarray:
    """Low frequencies of square gray images (n, side, side) above their median."""
    c = _cosines(gray.shape[-1], HASH_SIDE)
    low = (c @ gray @ c.T).reshape(len(gray), -1)
    return low > np.median(low, axis=1, keepdims=True)


def gradient_bits(gray: np.ndarray) -> np.ndarray:
    """Pixels of images (n, 16, 17) that are brighter than their left neighbour."""
    return (gray[:, :, 1:] > gray[:, :, :-1]).reshape(len(gray), -1)


def frame_hashes(frames: DataFrame, pixels: str = "pixels", out: str = "hash", kind: str = "perceptual") -> DataFrame:
    """``frames`` with the 256-bit hash (array of four words, first bit highest) in place of the gray bytes, row after row.

    ``perceptual`` wants square images scaled to 4 x 16 pixels a side, ``gradient`` 16 rows of 17. Frames that are null or
    of another size get a null hash.
    """
    shape, bits_of = {"perceptual": ((4 * HASH_SIDE, 4 * HASH_SIDE), perceptual_bits), "gradient": ((HASH_SIDE, HASH_SIDE + 1), gradient_bits)}[kind]
    size = shape[0] * shape[1]
    keep = [c for c in frames.columns if c not in (pixels, out)]
    frames = frames.select(*keep, pixels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(len(keep)).to_pylist()
            good = [i for i, b in enumerate(raw) if b is not None and len(b) == size]
            hashes: list[list[int] | None] = [None] * len(raw)
            if good:
                gray = np.frombuffer(b"".join(raw[i] for i in good), np.uint8).reshape(-1, *shape).astype(np.float64)
                words = np.packbits(bits_of(gray), axis=1).view(">i8").astype(np.int64)
                for i, w in zip(good, words.tolist(), strict=True):
                    hashes[i] = w
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(hashes, pa.list_(pa.int64()))], [*keep, out])

    schema = T.StructType([frames.schema[c] for c in keep] + [T.StructField(out, T.ArrayType(T.LongType()))])
    return frames.mapInArrow(run, schema)
