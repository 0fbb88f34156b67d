"""Detections as a table function of SQL: a lateral join gives every frame its detections."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

_LOADED: dict[str, Any] = {}


def loaded(name: str, make: Callable[[], Any]) -> Any:
    """A pipeline of this worker process, built when it is first asked for."""
    if name not in _LOADED:
        _LOADED[name] = make()
    return _LOADED[name]


def register(spark: SparkSession, name: str, make: Callable[[], Any], version: str = "") -> None:
    """After this, `FROM frames f, LATERAL name(f.image_id, f.height, f.width, f.pixels) d` has a row for each detection of each frame: label,
    score and box. make() builds the pipeline, once for each worker process whatever the number of frames, tasks and queries; another
    pipeline under the same name needs another version. A frame that is null, or whose bytes are not height x width x 3, has no detections."""
    key = f"{name}@{version}"

    class Detections:
        def eval(self, image_id, height, width, pixels):
            if image_id is None or height is None or width is None or pixels is None or len(pixels) != height * width * 3:
                return
            image = np.frombuffer(pixels, np.uint8).reshape(height, width, 3)
            for label, score, *box in loaded(key, make).predict(image, image_id):
                yield int(label), float(score), *map(float, box)

    kind = "label int, score double, x0 double, y0 double, x1 double, y1 double"
    spark.udtf.register(name, udtf(Detections, returnType=kind, useArrow=True))
