"""Image fingerprints: colour and edge histograms, compared by cosine. Decoding needs an image library; raw arrays don't."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.search import cosine

SIDE, COLOURS, EDGES, ACCEPT = 96, 32, 16, 0.85


def fingerprint(pixels: np.ndarray) -> np.ndarray:
    """Three colour histograms of 32 bins and one of 16 bins over gradient magnitudes, each summing to 1, of an (h, w, 3) array."""
    parts = [np.histogram(pixels[..., c], COLOURS, (0, 256))[0] for c in range(3)]
    grey = pixels.astype(np.float64).mean(axis=2)
    pad = np.pad(grey, 1, mode="edge")
    smooth = lambda a: a[:-2] + 2 * a[1:-1] + a[2:]
    across, down = smooth(pad[:, 2:] - pad[:, :-2]), smooth((pad[2:] - pad[:-2]).T).T
    size = np.hypot(across, down)
    parts.append(np.histogram(size, EDGES, (0, max(float(size.max()), 1e-9)))[0])
    return np.concatenate([p / max(p.sum(), 1) for p in parts])


def decode(data: bytes) -> np.ndarray | None:
    """Pixels of an image scaled to SIDE x SIDE; plain binary PPM is read as it is, the rest if a library is there."""
    if data[:2] == b"P6":
        head = data.split(maxsplit=4)
        w, h = int(head[1]), int(head[2])
        raw = np.frombuffer(data[-w * h * 3 :], np.uint8).reshape(h, w, 3)
        return raw[np.linspace(0, h - 1, SIDE).astype(int)][:, np.linspace(0, w - 1, SIDE).astype(int)]
    try:
        from PIL import Image
    except ImportError:
        return None
    return np.asarray(Image.open(io.BytesIO(data)).convert("RGB").resize((SIDE, SIDE)))


def fingerprints(images: DataFrame) -> DataFrame:
    """(path, fingerprint) of (path, content); null where an image can't be decoded."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [None if (p := decode(c)) is None else fingerprint(p).tolist() for c in batch["content"]]
            yield pd.DataFrame({"path": batch["path"], "fingerprint": found})

    return images.select("path", "content").mapInPandas(run, "path string, fingerprint array<double>")


def accepted(pairs: DataFrame, original: str, changed: str, least: float = ACCEPT) -> DataFrame:
    """pairs with similarity and whether the changed image is still like its original."""
    return pairs.withColumn("similarity", F.round(cosine(original, changed), 6)).withColumn("accepted", F.col("similarity") >= least)
