"""Figures of thumbnail images, by image in Arrow batches: light, colour, dominant colours, edges.

Decoding is a function of bytes to an array (height, width, 3) of red, green and blue; the one here reads binary PPM,
and another can be passed where a library for other formats is installed. What cannot be decoded gets null figures.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Some colour names.
COLOURS = {"black": (0, 0, 0), "blue": (3, 67, 223), "brown": (101, 55, 0), "green": (21, 176, 26), "grey": (146, 149, 145), "orange": (249, 115, 6), "pink": (255, 129, 192), "purple": (126, 30, 156), "red": (229, 0, 0), "white": (255, 255, 255), "yellow": (255, 255, 20)}
FIGURES = "path string, brightness double, contrast double, hue double, saturation double, value double, hue_entropy double, colours array<string>, saliency double, edges double"


def ppm(data: bytes) -> np.ndarray:
    """Binary PPM of 8 bits (P6)."""
    head, rest = [], data
    while len(head) < 4:
        line, _, rest = rest.partition(b"\n")
        head += line.split(b"#")[0].split()
        if not _:
            break
    if len(head) != 4 or head[0] != b"P6":
        raise ValueError("no binary PPM")
    width, height = int(head[1]), int(head[2])
    return np.frombuffer(rest[: 3 * width * height], np.uint8).reshape(height, width, 3)


def hsv(rgb: np.ndarray) -> np.ndarray:
    """Hue in degrees halved (0 to 180), saturation and value (0 to 255)."""
    x = rgb.reshape(-1, 3).astype(float)
    high, low = x.max(axis=1), x.min(axis=1)
    span = np.maximum(high - low, 1e-12)
    r, g, b = x.T
    hue = np.select([high == low, high == r, high == g], [0.0, (g - b) / span % 6, (b - r) / span + 2], (r - g) / span + 4) * 30
    return np.stack([hue, np.where(high > 0, (high - low) / np.maximum(high, 1e-12), 0) * 255, high], axis=1)


def dominant(rgb: np.ndarray, k: int = 3, turns: int = 20, seed: int = 42) -> np.ndarray:
    """Centres of k groups of colours, the largest group first."""
    x = rgb.reshape(-1, 3).astype(float)
    points = np.unique(x, axis=0)
    centres = points[np.random.default_rng(seed).permutation(len(points))[:k]]
    for _ in range(turns):
        near = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        new = np.array([x[near == i].mean(axis=0) if (near == i).any() else centres[i] for i in range(len(centres))])
        if np.allclose(new, centres):
            break
        centres = new
    return centres[np.argsort(-np.bincount(near, minlength=len(centres)), kind="stable")]


def named(colour: np.ndarray) -> str:
    return min(sorted(COLOURS), key=lambda n: float(((colour - np.array(COLOURS[n])) ** 2).sum()))


def figures(rgb: np.ndarray, strong: float = 100.0) -> tuple:
    grey = rgb @ np.array([0.299, 0.587, 0.114])
    levels = np.bincount(grey.round().astype(int).ravel(), minlength=256).cumsum() / grey.size
    equal = levels[grey.round().astype(int)]  # every level as its share from below: the histogram made flat
    tones = hsv(rgb)
    p = np.histogram(tones[:, 0], bins=180, range=(0, 180))[0] / len(tones)
    padded = np.pad(grey, 1, mode="edge")
    cut = lambda dy, dx: padded[1 + dy : 1 + dy + grey.shape[0], 1 + dx : 1 + dx + grey.shape[1]]
    across = cut(-1, 1) + 2 * cut(0, 1) + cut(1, 1) - cut(-1, -1) - 2 * cut(0, -1) - cut(1, -1)
    down = cut(1, -1) + 2 * cut(1, 0) + cut(1, 1) - cut(-1, -1) - 2 * cut(-1, 0) - cut(-1, 1)
    slope = np.hypot(across, down)
    return (float(grey.mean()), float(equal.std()), *map(float, tones.mean(axis=0)), float(-(p * np.log2(p + 1e-6)).sum()), [named(c) for c in dominant(rgb)], float(slope.mean() / 255), float((slope > strong).mean() * 255))


def image_figures(files: DataFrame, decode: Callable[[bytes], np.ndarray] = ppm) -> DataFrame:
    """The figures of each image of files (path, content)."""

    def made(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in FIGURES.split(", ")]
        for part in parts:
            rows = []
            for path, content in zip(part["path"], part["content"], strict=True):
                try:
                    image = decode(bytes(content))
                except (ValueError, TypeError):
                    rows.append((path, *[None] * 9))
                else:
                    rows.append((path, *figures(image)) if image.size else (path, *[None] * 9))
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(made, FIGURES)


def merged_words(words: DataFrame, least: float = 20.0, most: int = 20) -> DataFrame:
    """What text recognition found: (path, word_count, words, top, middle, bottom) from (path, word, confidence, y), y from
    0 at the top to 1. Words of at most `least` confidence don't count, and of the distinct ones at most `most` in order."""
    from pyspark.sql import functions as F

    good = words.where((F.col("confidence") > least) & (F.trim("word") != "")).select("path", F.lower(F.trim("word")).alias("word"), "y")
    third = lambda a, b: F.count_if((F.col("y") >= a) & (F.col("y") < b))
    out = good.groupBy("path").agg(F.slice(F.array_sort(F.collect_set("word")), 1, most).alias("words"), third(-1, 1 / 3).alias("top"), third(1 / 3, 2 / 3).alias("middle"), third(2 / 3, 9).alias("bottom"))
    return out.select("path", F.size("words").alias("word_count"), "words", "top", "middle", "bottom")
