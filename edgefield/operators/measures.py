"""Objective measures of frames: sharpness, contrast, noise, blockiness, resolution, level."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from edgefield.operators.kernels import correlated, stacks

NAMES = ("laplacian_var", "rms_contrast", "snr_db", "blockiness", "mtf50_cy_px", "mean_level")
_LAPLACE = np.array([[0, 1, 0], [1, -4, 1], [0, 1, 0]], float)
_NOISE = np.array([[1, -2, 1], [-2, 4, -2], [1, -2, 1]], float)


def greys(stack: np.ndarray) -> np.ndarray:
    """Luma in whole levels, by 15-bit fixed-point weights of blue, green and red, of frames stacked as channels: height x width x n."""
    b, g, r = (stack[..., i::3].astype(np.int64) for i in range(3))
    return ((3735 * b + 19235 * g + 9798 * r + (1 << 14)) >> 15).astype(np.float64)


def grey(image: np.ndarray) -> np.ndarray:
    return image.astype(np.float64) if image.ndim == 2 else greys(image)[..., 0]


# Measures take a plane, height x width, or n of them, height x width x n, and give one figure or n.
def noise_sigma(g: np.ndarray) -> np.ndarray:
    """Mean response to a mask that plane surfaces and edges leave at zero, as a Gaussian deviation."""
    response = np.abs(correlated(g, _NOISE))
    if min(g.shape[:2]) > 8:
        response = response[2:-2, 2:-2]
    return response.mean((0, 1)) * (math.sqrt(math.pi / 2) / 6)


def blockiness(g: np.ndarray) -> np.ndarray:
    """Mean step across the borders of 8 x 8 blocks by the mean step elsewhere; 0 where there is no border."""
    on, off = 0.0, 0.0
    for steps in (np.abs(np.diff(g, axis=1)), np.abs(np.diff(g, axis=0)).swapaxes(0, 1)):
        border = np.arange(steps.shape[1]) % 8 == 7
        if not border.any() or border.all():
            return np.zeros(g.shape[2:])
        on = on + steps[:, border].mean((0, 1))
        off = off + steps[:, ~border].mean((0, 1))
    return on / np.maximum(off, 2e-6)


def mtf50(g: np.ndarray) -> np.ndarray:
    """Where the radially averaged spectrum falls to half of its centre, in cycles a pixel; 0.5 if it never does, 0 for a flat or tiny frame."""
    h, w = g.shape[:2]
    bins = min(h // 2, w // 2)
    if bins < 2:
        return np.zeros(g.shape[2:])
    planes = np.moveaxis(g.reshape(h, w, -1), 2, 0)
    planes = planes - planes.mean((1, 2), keepdims=True)
    window = np.outer(np.hanning(h), np.hanning(w)).astype(np.float32)
    power = np.abs(np.fft.fftshift(np.fft.fft2(planes * window), axes=(1, 2))).reshape(len(planes), -1)
    y, x = np.indices((h, w))
    radius = np.hypot(y - h // 2, x - w // 2).astype(int).ravel()
    order = np.argsort(radius, kind="stable")
    starts = np.searchsorted(radius[order], np.arange(bins + 1))
    profile = np.add.reduceat(power[:, order], starts, axis=1)[:, :bins] / np.diff(starts)
    flat = ~planes.any((1, 2)) | (profile[:, 0] <= 0)
    profile = profile / np.where(flat, 1.0, profile[:, 0])[:, None]
    low = profile < 0.5
    i = np.maximum(low.argmax(1), 1)
    n = np.arange(len(planes))
    part = (profile[n, i - 1] - 0.5) / np.maximum(profile[n, i - 1] - profile[n, i], 1e-12)
    out = np.where(low.any(1), 0.5 * (i - 1 + part) / bins, 0.5)
    return np.where(flat, 0.0, out).reshape(g.shape[2:])


def area_resized(image: np.ndarray, most: int = 640) -> np.ndarray:
    """A frame whose longer side is at most so many pixels: each new pixel is the mean of the area it covers. Smaller frames stay."""
    h, w = image.shape[:2]
    scale = most / max(h, w)
    if scale >= 1:
        return image
    out = image.astype(np.float64)
    for axis, (n, m) in enumerate(((h, round(h * scale)), (w, round(w * scale)))):
        # areas from running sums, read at fractions of a pixel
        sums = np.concatenate([np.zeros_like(out.take([0], axis)), out.cumsum(axis)], axis)
        at = np.arange(m + 1) * (n / m)
        lo = np.minimum(at.astype(int), n - 1)
        shape = [-1 if a == axis else 1 for a in range(out.ndim)]
        edge = sums.take(lo, axis) + (at - lo).reshape(shape) * (sums.take(lo + 1, axis) - sums.take(lo, axis))
        out = np.diff(edge, axis=axis) / (n / m)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def mean_linear(image: np.ndarray, gamma: float = 2.2) -> float:
    """Mean linear luminance of a frame, 0 to 1."""
    return float(np.mean((grey(image) / 255.0) ** gamma))


def prepared(frames: DataFrame, most: int = 640) -> DataFrame:
    """frames with image_id, height, width and pixels: the same, made small enough, with mean_linear."""

    def run(batches):
        for pdf in batches:
            rows = []
            for i, p, h, w in zip(pdf["image_id"], pdf["pixels"], pdf["height"], pdf["width"]):
                image = area_resized(np.frombuffer(p, np.uint8).reshape(h, w, 3), most)
                rows.append((i, image.shape[0], image.shape[1], image.tobytes(), mean_linear(image)))
            yield pd.DataFrame(rows, columns=["image_id", "height", "width", "pixels", "mean_linear"])

    return frames.select("image_id", "height", "width", "pixels").mapInPandas(run, "image_id long, height int, width int, pixels binary, mean_linear double")


#: Each measure by itself, of a plane or of n of them.
MEASURES = {
    "laplacian_var": lambda g: correlated(g, _LAPLACE).var((0, 1)),
    "rms_contrast": lambda g: g.std((0, 1)),
    "snr_db": lambda g: 20 * np.log10(np.maximum(g.mean((0, 1)), 1e-6) / np.maximum(noise_sigma(g), 1e-6)),
    "blockiness": blockiness,
    "mtf50_cy_px": mtf50,
    "mean_level": lambda g: g.mean((0, 1)),
}


def measured_stack(stack: np.ndarray, names: tuple[str, ...] = NAMES) -> dict[str, np.ndarray]:
    """The measures named of frames of one size, stacked as channels (height x width x 3 n): n figures each."""
    g = greys(stack)
    return {name: MEASURES[name](g) for name in names}


def measured(image: np.ndarray) -> dict[str, float]:
    g = image if image.ndim == 3 else np.repeat(image[..., None], 3, axis=2)
    return {name: float(v[0]) for name, v in measured_stack(g).items()}


def measure(frames: DataFrame, keep: list[str]) -> DataFrame:
    """frames with height, width and pixels: the columns of keep and the six measures. Frames of one size are measured together."""

    def run(batches):
        for pdf in batches:
            for rows, stack in stacks(pdf):
                yield pd.concat([pdf[keep].iloc[rows].reset_index(drop=True), pd.DataFrame(measured_stack(stack), columns=list(NAMES))], axis=1)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frames.schema if f.name in keep)
    return frames.mapInPandas(run, ", ".join(x for x in (kinds, *(f"{n} double" for n in NAMES)) if x))
