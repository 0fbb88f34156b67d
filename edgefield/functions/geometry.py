"""Boxes, severities and physical quantities as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = ("x0", "y0", "x1", "y1")


def area(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    zero = F.lit(0.0)
    return F.greatest(x1 - x0, zero) * F.greatest(y1 - y0, zero)


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union of corner boxes. Boxes that only touch, and empty unions, give 0."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    both = w * h
    union = area(*a) + area(*b) - both
    return F.when((w > 0) & (h > 0) & (union > 0), both / union).otherwise(F.lit(0.0))


def to_severity(value: Column, lo: Column, hi: Column, severe_end: Column) -> Column:
    """0 at the benign end of an axis, 1 at the severe one."""
    return F.when(severe_end == "hi", (value - lo) / (hi - lo)).otherwise((value - hi) / (lo - hi))


def from_severity(severity: Column, lo: Column, hi: Column, severe_end: Column) -> Column:
    return F.when(severe_end == "hi", lo + severity * (hi - lo)).otherwise(hi + severity * (lo - hi))


def clamp(value: Column, lo: Column, hi: Column) -> Column:
    return F.greatest(lo, F.least(value, hi))


def psf_length_px(exposure_ms: Column, deg_per_s: Column, focal_px: float = 900.0) -> Column:
    return focal_px * F.tan(F.radians(deg_per_s * exposure_ms / 1000.0))


def circle_of_confusion_px(distance_m: Column, f_number: Column, focus_m: float = 20.0, focal_mm: float = 8.0, pitch_um: float = 3.0) -> Column:
    f, s1 = focal_mm / 1000.0, focus_m
    if s1 <= f:
        return F.lit(0.0)
    metres = F.abs(distance_m - s1) / distance_m * (f * f) / (f_number * (s1 - f))
    return metres / (pitch_um * 1e-6)


def corner_displacement_px(k1: Column, k2: Column, size: int = 256, scale: float = 0.9) -> Column:
    r = 2**0.5 / 2
    return F.abs(k1 * r**2 + k2 * r**4) * (scale * size * r)


def row_shift_px(readout_ms: Column, deg_per_s: Column, focal_px: float = 900.0) -> Column:
    return focal_px * F.tan(F.radians(deg_per_s * readout_ms / 1000.0))


def transmission(beta_per_m: Column, depth_m: Column) -> Column:
    return F.exp(-beta_per_m * depth_m)


def visibility_m(beta_per_m: Column) -> Column:
    """Where contrast falls to 2 %; null in clear air."""
    return F.when(beta_per_m > 1e-9, 3.912 / beta_per_m)


def signal_electrons(lux: Column, exposure_ms: Column) -> Column:
    return lux * exposure_ms * 180.0 / 1000.0


def shot_noise(signal: Column) -> Column:
    """Of a mid-grey patch, in electrons."""
    return F.sqrt(signal * 0.5)


def modelled_snr_db(signal: Column, read_noise_e: float = 2.0) -> Column:
    noise = F.sqrt(signal * 0.5 + read_noise_e**2)
    return 20.0 * F.log10(F.greatest(signal * 0.5, F.lit(1e-9)) / F.greatest(noise, F.lit(1e-9)))


def shift_per_row(shift_px: Column, height_px: Column) -> Column:
    return shift_px / F.nullif(height_px, F.lit(0))


def exif_lux(exposure_s: Column, f_number: Column, iso: Column, mean_linear: Column | None = None) -> Column:
    """Scene illuminance from exposure settings; null where one of them is missing or zero."""
    lux = 250.0 * f_number * f_number / (F.nullif(exposure_s, F.lit(0.0)) * F.nullif(iso, F.lit(0.0)))
    if mean_linear is not None:
        lux = lux * mean_linear / 0.18
    return F.when(f_number != 0, lux)


def letterbox_scale(width: Column, height: Column, size: float = 640.0) -> Column:
    """What an image is scaled by to fit a square input; it lies in the upper left corner, the rest is padding."""
    return F.least(size / width, size / height)


def into_letterbox(box: tuple[Column, ...], scale: Column, size: float = 640.0) -> tuple[Column, ...]:
    """A corner box of the image in the pixels of the input, clipped to it."""
    return tuple(clamp(c * scale, F.lit(0.0), F.lit(size)) for c in box)


def out_of_letterbox(box: tuple[Column, ...], scale: Column) -> tuple[Column, ...]:
    """The inverse, for boxes within the input."""
    return tuple(c / scale for c in box)


def lens_terms(x, y, lens):
    """What a lens (k1, k2, p1, p2) does at a point of the unit plane, of columns or arrays: its radial factor and its tangential shifts."""
    k1, k2, p1, p2 = lens
    r2 = x * x + y * y
    return 1 + k1 * r2 + k2 * r2 * r2, 2 * p1 * x * y + p2 * (r2 + 2 * x * x), p1 * (r2 + 2 * y * y) + 2 * p2 * x * y


def distorted(x: Column, y: Column, lens: tuple[Column, ...]) -> Column:
    """Where a lens shows a point of the unit plane: a struct of x and y."""
    radial, dx, dy = lens_terms(x, y, lens)
    return F.struct((x * radial + dx).alias("x"), (y * radial + dy).alias("y"))


def undistorted(x: Column, y: Column, lens: tuple[Column, ...], rounds: int = 20) -> Column:
    """The point that a lens shows at x, y: fixed-point rounds from the point itself, each dividing what is left of the shown point without
    the shifts by the radial factor. They close in where distortion grows by less than the radius does; distorting again tells."""

    def closer(s: Column, _: Column) -> Column:
        radial, dx, dy = lens_terms(s["x"], s["y"], lens)
        return F.struct(((x - dx) / radial).alias("x"), ((y - dy) / radial).alias("y"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct(x.alias("x"), y.alias("y")), closer)


def round_trip_px(width: Column, height: Column, lens: tuple[Column, ...], px: Column, py: Column, focal: float = 0.9) -> Column:
    """How far undistorting and distorting again moves a pixel, the larger of both coordinates; the focal length is a share of the longer side."""
    f, cx, cy = focal * F.greatest(width, height), (width - 1) / 2.0, (height - 1) / 2.0
    x, y = (px - cx) / f, (py - cy) / f
    u = undistorted(x, y, lens)
    d = distorted(u["x"], u["y"], lens)
    return F.greatest(F.abs(d["x"] * f + cx - px), F.abs(d["y"] * f + cy - py))


def ladder(lo: Column, hi: Column, n: int, ratio: Column) -> Column:
    """n values from lo to hi as an array: in equal ratios where ratio holds and both are above 0, else in equal steps. Null ends give nulls."""
    above = F.when(ratio & (lo > 0) & (hi > 0), lo)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.coalesce(above * F.pow(hi / above, k / (n - 1.0)), lo + (hi - lo) * k / (n - 1.0)))
