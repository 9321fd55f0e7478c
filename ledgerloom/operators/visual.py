"""Marks on page images: boxes, their suppression, and scores of grey-level windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

THRESHOLDS = {"signature": 0.62, "stamp": 0.58, "qr": 0.66, "barcode": 0.68}


def iou(a: str, b: str) -> Column:
    """Intersection over union of the boxes in the columns ``a_x0`` and so on."""
    side = lambda x, lo, hi: F.greatest(F.least(f"{a}_{hi}", f"{b}_{hi}") - F.greatest(f"{a}_{lo}", f"{b}_{lo}"), F.lit(0))
    inter = side("x", "x0", "x1") * side("y", "y0", "y1")
    area = lambda p: (F.col(f"{p}_x1") - F.col(f"{p}_x0")) * (F.col(f"{p}_y1") - F.col(f"{p}_y0"))
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def suppressed(boxes: DataFrame, keys: list[str], most: float = 0.35) -> DataFrame:
    """Greedy suppression: of the boxes (score, x0, y0, x1, y1) of each key the best stays, and those that overlap a kept one by more than ``most`` go.

    Of equal scores the box further up and left comes first. The choice depends on earlier choices, so each key's boxes are gone through in one place.
    """

    def keep(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "y0", "x0", "y1", "x1"], ascending=[False, True, True, True, True])
        x0, y0, x1, y1 = (rows[c].to_numpy(float) for c in ("x0", "y0", "x1", "y1"))
        area, kept = (x1 - x0) * (y1 - y0), []
        for i in range(len(rows)):
            k = np.array(kept, int)
            inter = np.clip(np.minimum(x1[i], x1[k]) - np.maximum(x0[i], x0[k]), 0, None) * np.clip(np.minimum(y1[i], y1[k]) - np.maximum(y0[i], y0[k]), 0, None)
            union = area[i] + area[k] - inter
            if not (inter > most * union).any():
                kept.append(i)
        return rows.iloc[kept]

    return boxes.groupBy(*keys).applyInPandas(keep, boxes.schema)


def mark_counts(marks: DataFrame) -> DataFrame:
    """doc_id, n_ of each type and has_ of each."""
    counted = marks.groupBy("doc_id").agg(*[F.count_if(F.col("type") == t).alias(f"n_{t}") for t in THRESHOLDS])
    return counted.withColumns({f"has_{t}": F.col(f"n_{t}") > 0 for t in THRESHOLDS})


def window_features(grey: np.ndarray) -> dict[str, float]:
    """Ink share, dark-light changes by row and column, border share and blackness of the middle of a grey-level window."""
    ink = grey < 128
    share = float(ink.mean()) if ink.size else 0.0
    across = float(np.abs(np.diff(ink.astype(int), axis=1)).mean()) if ink.shape[1] > 1 else 0.0
    down = float(np.abs(np.diff(ink.astype(int), axis=0)).mean()) if ink.shape[0] > 1 else 0.0
    edge = np.concatenate([ink[0], ink[-1], ink[:, 0], ink[:, -1]]) if ink.size else np.zeros(1)
    middle = ink[ink.shape[0] // 4 : -(ink.shape[0] // 4) or None, ink.shape[1] // 4 : -(ink.shape[1] // 4) or None]
    return {"ink": share, "across": across, "down": down, "border": float(edge.mean()), "middle": float(middle.mean()) if middle.size else 0.0}


def window_scores(f: dict[str, float]) -> dict[str, float]:
    """Scores from 0 to 1: a barcode changes across only, a QR code both ways, a stamp has a dark border, a signature is sparse with ink in its middle."""
    clip = lambda x: float(min(1.0, max(0.0, x)))
    return {
        "barcode": clip(4 * (f["across"] - f["down"])) * clip(f["ink"] / 0.3), "qr": clip(3 * min(f["across"], f["down"])) * clip(1 - abs(f["ink"] - 0.5) * 2),
        "stamp": clip(2 * f["border"]) * clip(1 - 2 * f["middle"]), "signature": clip(1 - abs(f["ink"] - 0.08) / 0.08) * clip(4 * f["middle"]) * clip(1 - f["border"] * 10),
    }


def detected_marks(pages: DataFrame, size: int = 64) -> DataFrame:
    """doc_id, page_index, type, score, x0, y0, x1, y1 from grey images (doc_id, page_index, width, height, pixels as bytes), by windows half a window apart."""
    kind = pages.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                image = np.frombuffer(r.pixels or b"", np.uint8)
                if not r.width or not r.height or len(image) != r.width * r.height:
                    continue
                image = image.reshape(r.height, r.width)
                for y in range(0, max(1, r.height - size // 2), size // 2):
                    for x in range(0, max(1, r.width - size // 2), size // 2):
                        window = image[y : y + size, x : x + size]
                        for name, score in window_scores(window_features(window)).items():
                            if score >= THRESHOLDS[name]:
                                rows.append((r.doc_id, r.page_index, name, score, x, y, x + window.shape[1], y + window.shape[0]))
            yield pd.DataFrame(rows, columns=["doc_id", "page_index", "type", "score", "x0", "y0", "x1", "y1"])

    marks = pages.select("doc_id", "page_index", "width", "height", "pixels").mapInPandas(run, f"doc_id {kind}, page_index int, type string, score double, x0 int, y0 int, x1 int, y1 int")
    return suppressed(marks, ["doc_id", "page_index", "type"])
