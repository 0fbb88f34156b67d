"""Capture degradations of 8-bit BGR frames, in numpy, and the Arrow operator that applies them to a table of frames.

A kernel is a function of (image, parameters, generator). A condition names kernels with their values; kernels run in the
order of light: air, optics and motion, sensor, file. What a kernel is not told is the midpoint of its axis, or its default.
A probe is a pure function of condition and seed: a single kernel uses the seed itself, several use seeds derived for each step.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Callable
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgefield.functions.axes import AXES

Kernel = Callable[[np.ndarray, dict[str, float], np.random.Generator], np.ndarray]

# Fixed values.
#: Least and most of every parameter, and its value where neither an axis nor the caller gives one.
PARAMETERS: dict[str, dict[str, tuple[float, float, float | None]]] = {
    "fog": {"beta_per_m": (0, 3, None), "depth_near_m": (1e-9, 1000, 5), "depth_far_m": (1e-9, 5000, 80), "airlight": (0, 1, 0.9)},
    "motion_blur": {"exposure_ms": (0, 1000, None), "angular_velocity_deg_s": (0, 720, None), "focal_length_px": (1e-9, 20000, 900), "direction_deg": (-180, 360, 0)},
    "defocus": {"subject_distance_m": (1e-9, 1000, None), "aperture_f_number": (1e-9, 32, None), "focal_length_mm": (1e-9, 600, 8), "focus_distance_m": (1e-9, 1000, 20), "pixel_pitch_um": (1e-9, 20, 2)},
    "lens_distortion": {"k1": (-0.5, 1, None), "k2": (-0.5, 1, None), "p1": (-0.1, 0.1, 0), "p2": (-0.1, 0.1, 0)},
    "rolling_shutter": {"readout_time_ms": (0, 1000, None), "angular_velocity_deg_s": (0, 720, None), "focal_length_px": (1e-9, 20000, 900)},
    "low_light": {"illuminance_lux": (1e-9, 100000, None), "exposure_ms": (1e-9, 1000, 10), "iso_gain": (1e-9, 256, 4), "read_noise_e": (0, 100, 2), "full_well_e": (1e-9, 200000, 6000), "photons_per_lux_s": (1e-9, 100000, 180)},
    "jpeg": {"quality": (1, 100, None)},
}
STOCHASTIC = {"low_light"}
#: Kernels that draw nothing and treat every channel, or every frame, alike: frames of one size go through them together, as channels of one array.
STACKED = {"fog", "motion_blur", "defocus", "lens_distortion", "rolling_shutter", "jpeg"}


def correlated(image: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """2-D correlation with borders mirrored without the edge pixel, in double precision."""
    h, w = weights.shape
    src = image[..., None] if image.ndim == 2 else image
    at = np.argwhere(weights)
    ph, pw = np.abs(at - (h // 2, w // 2)).max(0, initial=0)  # no wider than weights that are not 0: a blur along a line has one row of them
    wide = np.pad(src.astype(np.float64), ((ph, ph), (pw, pw), (0, 0)), mode="reflect")
    out, term = np.zeros(src.shape, np.float64), np.empty(src.shape, np.float64)
    for dy, dx in at:
        y, x = dy - h // 2 + ph, dx - w // 2 + pw
        out += np.multiply(wide[y : y + src.shape[0], x : x + src.shape[1]], weights[dy, dx], out=term)
    return out[..., 0] if image.ndim == 2 else out


def _rounded(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


def _sampled(image: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bilinear look-up at positions in fractions of 1/32 pixel, mirrored at the borders."""

    def mirrored(k: np.ndarray, n: int) -> np.ndarray:
        period = max(1, 2 * (n - 1))
        k = np.mod(k, period)
        return np.where(k >= n, period - k, k)

    x, y = np.rint(x * 32) / 32, np.rint(y * 32) / 32
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    fx, fy = (x - x0)[..., None], (y - y0)[..., None]
    h, w = image.shape[:2]
    pick = lambda dy, dx: image[mirrored(y0 + dy, h), mirrored(x0 + dx, w)].astype(np.float64)
    return _rounded((1 - fy) * ((1 - fx) * pick(0, 0) + fx * pick(0, 1)) + fy * ((1 - fx) * pick(1, 0) + fx * pick(1, 1)))


@functools.lru_cache(64)  # a sweep asks for the same few, stack after stack
def line_psf(length: float, direction_deg: float) -> np.ndarray:
    """Unit mass spread along a line of sub-pixel length, 16 points a pixel, shared out to the pixels around each point."""
    size = math.ceil(length) + 3
    size += 1 - size % 2
    mid = (size - 1) / 2
    t = np.linspace(-length / 2, length / 2, max(1, math.ceil(length * 16)))
    angle = math.radians(direction_deg)
    x, y = mid + math.cos(angle) * t, mid - math.sin(angle) * t
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    out = np.zeros((size + 1, size + 1))
    for dy, wy in ((0, 1 - (y - y0)), (1, y - y0)):
        for dx, wx in ((0, 1 - (x - x0)), (1, x - x0)):
            np.add.at(out, (y0 + dy, x0 + dx), wy * wx)
    out = out[:size, :size]
    out = out / out.sum()
    out.flags.writeable = False
    return out


@functools.lru_cache(64)
def disc_psf(diameter: float) -> np.ndarray:
    """A uniform disc, each pixel weighed by 4 x 4 points inside it."""
    size = math.ceil(diameter) + 2
    size += 1 - size % 2
    points = (np.arange(4 * size) + 0.5) / 4 - 0.5 - (size - 1) / 2
    inside = points[:, None] ** 2 + points[None] ** 2 <= (diameter / 2) ** 2
    out = inside.reshape(size, 4, size, 4).mean(axis=(1, 3))
    out /= out.sum()
    out.flags.writeable = False
    return out


def _shift(p: dict, ms: str) -> float:
    return p["focal_length_px"] * math.tan(math.radians(p["angular_velocity_deg_s"] * p[ms] / 1000))


def fog(image, p, rng):
    if p["beta_per_m"] <= 0:
        return image.copy()
    depth = np.linspace(p["depth_far_m"], p["depth_near_m"], image.shape[0], dtype=np.float32)
    through = np.exp(-p["beta_per_m"] * depth)[:, None]
    mixed = np.arange(256, dtype=np.float32) / 255 * through + p["airlight"] * (1 - through)
    told = np.clip(mixed * 255, 0, 255).astype(np.uint8)  # a row's depth is one, so what it makes of each level is told once
    return np.stack([level.take(row) for level, row in zip(told, image)])


def motion_blur(image, p, rng):
    length = _shift(p, "exposure_ms")
    return image.copy() if length < 1e-6 else _rounded(correlated(image, line_psf(length, p["direction_deg"])))


def defocus(image, p, rng):
    f, focus, away = p["focal_length_mm"], p["focus_distance_m"] * 1000, p["subject_distance_m"] * 1000
    coc = 0.0 if focus <= f else abs(away - focus) / away * f * f / (p["aperture_f_number"] * (focus - f))
    diameter = coc * 1000 / p["pixel_pitch_um"]
    return image.copy() if diameter < 1 else _rounded(correlated(image, disc_psf(diameter)))


def lens_distortion(image, p, rng):
    h, w = image.shape[:2]
    f, cx, cy = 0.9 * max(h, w), (w - 1) / 2, (h - 1) / 2
    y, x = np.mgrid[0:h, 0:w].astype(np.float64)
    x, y = (x - cx) / f, (y - cy) / f
    r2 = x * x + y * y
    radial = 1 + p["k1"] * r2 + p["k2"] * r2 * r2
    dx = x * radial + 2 * p["p1"] * x * y + p["p2"] * (r2 + 2 * x * x)
    dy = y * radial + p["p1"] * (r2 + 2 * y * y) + 2 * p["p2"] * x * y
    return _sampled(image, f * dx + cx, f * dy + cy)


def rolling_shutter(image, p, rng):
    total = _shift(p, "readout_time_ms")
    if abs(total) < 1e-9:
        return image.copy()
    h, w = image.shape[:2]
    y, x = np.mgrid[0:h, 0:w].astype(np.float64)
    return _sampled(image, x + y / h * total, y)


def low_light(image, p, rng):
    full = p["illuminance_lux"] * p["exposure_ms"] / 1000 * p["photons_per_lux_s"]
    electrons = (image.astype(np.float32) / 255) ** 2.2 * full
    caught = rng.poisson(np.clip(electrons, 0, None)).astype(np.float32)
    if p["read_noise_e"] > 0:
        caught += rng.normal(0.0, p["read_noise_e"], size=caught.shape).astype(np.float32)
    level = np.clip(caught * p["iso_gain"], 0, p["full_well_e"]) / p["full_well_e"]
    return np.clip(np.clip(level, 0, 1) ** (1 / 2.2) * 255, 0, 255).astype(np.uint8)


# fixed values: the quantisation tables of the JPEG standard, annex K, by rows
_LUMA = [
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
]
_CHROMA = [
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
]
_DCT = np.array([[(math.sqrt(1 / 8) if u == 0 else 0.5) * math.cos((2 * x + 1) * u * math.pi / 16) for x in range(8)] for u in range(8)])


def _through_dct(planes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """planes: height x width x n. All blocks of a row of blocks are one product with the transform, down and then across."""
    if planes.shape[2] == 1:  # a product with one column adds in another order, and ties at the rounding would go another way than in a stack
        return _through_dct(planes.repeat(2, 2), table)[..., :1]
    h, w, n = planes.shape
    wide = np.pad(planes, ((0, -h % 8), (0, -w % 8), (0, 0)), mode="edge") - 128
    rows, blocks, by = (wide.shape[0] // 8, 8, wide.shape[1] * n), (wide.shape[0], wide.shape[1] // 8, 8, n), table[:, None, :, None]
    c = (_DCT @ (_DCT @ wide.reshape(rows)).reshape(blocks)).reshape(rows[0], 8, *blocks[1:])
    c /= by
    np.rint(c, out=c)
    c *= by
    back = _DCT.T @ (_DCT.T @ c.reshape(rows)).reshape(blocks)
    back += 128
    return back.reshape(wide.shape)[:h, :w]


def _quantised(table: list[int], p: dict) -> np.ndarray:
    q = int(round(p["quality"]))
    return np.clip((np.array(table).reshape(8, 8) * (5000 // q if q < 50 else 200 - 2 * q) + 50) // 100, 1, 255).astype(float)


def jpeg(image, p, rng):
    """What a baseline file with halved colour would lose; entropy coding loses nothing and is left out. Takes stacks."""
    b, g, r = (image[..., i::3].astype(np.float64) for i in range(3))
    h, w, n = b.shape
    planes = [_through_dct(np.rint(0.299 * r + 0.587 * g + 0.114 * b), _quantised(_LUMA, p))]
    for c in (np.rint(128 - 0.168736 * r - 0.331264 * g + 0.5 * b), np.rint(128 + 0.5 * r - 0.418688 * g - 0.081312 * b)):
        even = np.pad(c, ((0, h % 2), (0, w % 2), (0, 0)), mode="edge")
        half = np.rint(even.reshape(even.shape[0] // 2, 2, even.shape[1] // 2, 2, n).mean(axis=(1, 3)))
        planes.append(np.repeat(np.repeat(_through_dct(half, _quantised(_CHROMA, p)), 2, 0), 2, 1)[:h, :w] - 128)
    y, cb, cr = np.clip(np.rint(planes[0]), 0, 255), planes[1], planes[2]
    told = np.stack([y + 1.772 * cb, y - 0.344136 * cb - 0.714136 * cr, y + 1.402 * cr], axis=-1)  # height x width x n x 3
    return _rounded(told.reshape(h, w, 3 * n))


def _grey_jpeg(levels, p, rng):
    """A frame without colour is its luma: both planes of colour are 128, which any table keeps."""
    return _rounded(_through_dct(levels.astype(np.float64), _quantised(_LUMA, p)))


KERNELS: dict[str, Kernel] = {f.__name__: f for f in (fog, motion_blur, defocus, lens_distortion, rolling_shutter, low_light, jpeg)}
STAGES = {"fog": 0, "motion_blur": 1, "defocus": 1, "lens_distortion": 1, "rolling_shutter": 1, "low_light": 2, "jpeg": 3}


def register(name: str, kernel: Kernel, parameters: dict[str, tuple[float, float, float | None]], stage: int) -> None:
    """Adds a kernel of one's own; every parameter needs a range, and a default unless an axis gives it a midpoint."""
    KERNELS[name], PARAMETERS[name], STAGES[name] = kernel, parameters, stage


def steps(condition: dict[str, float], fixed: dict[str, float] | None = None) -> list[tuple[str, dict[str, float]]]:
    """A condition {"kernel.parameter": value} as kernels with all their parameters, in physical order. Checks names and ranges."""
    given: dict[str, dict[str, float]] = {}
    for source in (fixed or {}, condition):
        for name, value in source.items():
            kernel, _, parameter = name.partition(".")
            if parameter not in PARAMETERS.get(kernel, {}):
                raise ValueError(f"no such parameter: {name}")
            lo, hi, _ = PARAMETERS[kernel][parameter]
            if not lo <= value <= hi:
                raise ValueError(f"{name} is {value}; it lies between {lo} and {hi}")
            given.setdefault(kernel, {})[parameter] = float(value)
    out = []
    for kernel in sorted(given, key=lambda k: (STAGES[k], k)):
        values = {}
        for parameter, (_, _, default) in PARAMETERS[kernel].items():
            axis = AXES.get(f"{kernel}.{parameter}")
            values[parameter] = given[kernel].get(parameter, axis.midpoint if axis else default)
        out.append((kernel, values))
    return out


def degraded_stack(stack: np.ndarray, condition: dict[str, float], seed: int, fixed: dict[str, float] | None = None) -> np.ndarray:
    """Frames of one size under one condition. stack: height x width x 3 n, frame after frame; each comes out as it would alone."""
    if stack.dtype != np.uint8 or stack.ndim != 3 or stack.shape[2] % 3 or not stack.size:
        raise TypeError("frames are uint8, height x width x 3")
    plan = steps(condition, fixed)
    out = stack.copy()
    for i, (kernel, values) in enumerate(plan):
        own = seed if len(plan) == 1 else int(np.random.SeedSequence([seed, i]).generate_state(1)[0])
        if kernel in STACKED:
            out = KERNELS[kernel](out, values, np.random.default_rng(own))
        else:
            each = [KERNELS[kernel](np.ascontiguousarray(out[..., k : k + 3]), values, np.random.default_rng(own)) for k in range(0, out.shape[2], 3)]
            out = np.concatenate(each, axis=2)
    return out


def levels(stack: np.ndarray) -> np.ndarray | None:
    """height x width x n: the one plane of each frame of a stack without colour; None where any pixel has some."""
    planes = np.ascontiguousarray(stack[..., ::3])
    return planes if all(np.array_equal(planes, stack[..., i::3]) for i in (1, 2)) else None


def degraded_levels(planes: np.ndarray, condition: dict[str, float], seed: int, fixed: dict[str, float] | None = None) -> np.ndarray | None:
    """Frames without colour, a plane each, under one condition: the plane that degraded_stack gives three times. None where a kernel
    draws for each channel, or is not known to treat channels alike, and so may give them colour."""
    plan = steps(condition, fixed)
    if any(kernel not in STACKED for kernel, _ in plan):
        return None
    out = planes.copy()
    for kernel, values in plan:  # none of these draws
        out = (_grey_jpeg if KERNELS[kernel] is jpeg else KERNELS[kernel])(out, values, np.random.default_rng(seed))
    return out


def degraded(image: np.ndarray, condition: dict[str, float], seed: int, fixed: dict[str, float] | None = None) -> np.ndarray:
    if image.ndim != 3 or image.shape[2] != 3:
        raise TypeError("frames are uint8, height x width x 3")
    return degraded_stack(image, condition, seed, fixed)


def stacks(pdf: pd.DataFrame, most: int = 1 << 18):
    """Frames of a batch by size, as (places in the batch, stack), at most so many bytes in a stack or one frame."""
    for (h, w), at in pdf.groupby(["height", "width"]).indices.items():
        n = max(1, most // max(1, h * w * 3))
        for k in range(0, len(at), n):
            rows = at[k : k + n]
            flat = np.frombuffer(b"".join(pdf["pixels"].iloc[rows]), np.uint8).reshape(len(rows), h, w, 3)
            yield rows, np.ascontiguousarray(flat.transpose(1, 2, 0, 3)).reshape(h, w, -1)


def unstacked(stack: np.ndarray) -> list[bytes]:
    """The pixels of each frame of a stack, by rows."""
    h, w, n = stack.shape
    return [f.tobytes() for f in stack.reshape(h, w, n // 3, 3).transpose(2, 0, 1, 3)]


def apply(frames: DataFrame, condition: dict[str, float], seed: int, fixed: dict[str, float] | None = None) -> DataFrame:
    """frames: any columns, with height, width and pixels (binary, BGR by rows). The same table with pixels degraded.

    Names and ranges are checked here, before any job runs. A composite is one pass over the frames, not one for each step."""
    steps(condition, fixed)

    def run(batches):
        for pdf in batches:
            out = pd.Series([None] * len(pdf), index=pdf.index, dtype=object)
            for rows, stack in stacks(pdf):
                for i, pixels in zip(rows, unstacked(degraded_stack(stack, condition, seed, fixed))):
                    out.iloc[i] = pixels
            yield pdf.assign(pixels=out)

    return frames.mapInPandas(run, frames.schema)


def sweep(frames: DataFrame, conditions: list[tuple[str, float]], seed: int, look: Callable[[np.ndarray], dict[str, np.ndarray]], names: tuple[str, ...]) -> DataFrame:
    """frames with image_id, height, width and pixels; conditions: (axis, value). What look(stack) says of every frame under every
    condition, with a digest of its pixels: image_id, axis, value, sha256 and names.

    Conditions are of the caller's making and are checked here. A task reads its frames once and goes over the conditions itself:
    nothing is joined or shuffled, and no pixel leaves the task. Frames without pixels, or of another length than their size says, are
    an error; a repeated frame or condition has its rows repeated, and an empty table has none."""
    for axis, value in conditions:
        steps({axis: value})

    def run(batches):
        for pdf in batches:
            for rows, stack in stacks(pdf):
                for axis, value in conditions:
                    seen = degraded_stack(stack, {axis: value}, seed)
                    told = look(seen)
                    digests = [hashlib.sha256(p).hexdigest() for p in unstacked(seen)]
                    yield pd.DataFrame({"image_id": pdf["image_id"].to_numpy()[rows], "axis": axis, "value": value, "sha256": digests, **{n: told[n] for n in names}})

    out = ", ".join(["image_id long, axis string, value double, sha256 string", *(f"{n} double" for n in names)])
    return frames.select("image_id", "height", "width", "pixels").mapInPandas(run, out)


def detect(frames: DataFrame, make: Callable[[], Any]) -> DataFrame:
    """Detections of a pipeline over frames: image_id, label, score and box. make() builds the pipeline once for each task; its
    predict(image, image_id) gives (label, score, x0, y0, x1, y1) rows."""

    def run(batches):
        pipeline = make()
        for pdf in batches:
            rows = [(i, *r) for i, p, h, w in zip(pdf["image_id"], pdf["pixels"], pdf["height"], pdf["width"]) for r in pipeline.predict(np.frombuffer(p, np.uint8).reshape(h, w, 3), i)]
            yield pd.DataFrame(rows, columns=["image_id", "label", "score", "x0", "y0", "x1", "y1"])

    return frames.mapInPandas(run, "image_id long, label int, score double, x0 double, y0 double, x1 double, y1 double")
