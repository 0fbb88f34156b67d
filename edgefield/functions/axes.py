"""Capture-condition axes: range, unit, severe end, and what a kernel of the axis is called. Plain Python; no Spark here."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Axis:
    degradation: str
    field: str
    unit: str
    lo: float
    hi: float
    severe_end: str  # lo or hi
    stage: int  # physical order in a composite

    @property
    def name(self) -> str:
        return f"{self.degradation}.{self.field}"

    @property
    def midpoint(self) -> float:
        return (self.lo + self.hi) / 2

    def clamp(self, value: float) -> float:
        return min(max(value, self.lo), self.hi)

    def from_severity(self, s: float) -> float:
        benign, severe = (self.lo, self.hi) if self.severe_end == "hi" else (self.hi, self.lo)
        return benign + s * (severe - benign)

    def to_severity(self, value: float) -> float:
        benign, severe = (self.lo, self.hi) if self.severe_end == "hi" else (self.hi, self.lo)
        return (value - benign) / (severe - benign)


# Names, units and ranges of the axes.
AXES = {
    a.name: a
    for a in (
        Axis("fog", "beta_per_m", "1/m", 0.0, 0.12, "hi", 0),
        Axis("motion_blur", "exposure_ms", "ms", 0.0, 40.0, "hi", 1),
        Axis("motion_blur", "angular_velocity_deg_s", "deg/s", 0.0, 120.0, "hi", 1),
        Axis("defocus", "subject_distance_m", "m", 0.6, 6.0, "lo", 1),
        Axis("defocus", "aperture_f_number", "f-number", 1.4, 8.0, "lo", 1),
        Axis("lens_distortion", "k1", "1", 0.0, 0.4, "hi", 1),
        Axis("lens_distortion", "k2", "1", 0.0, 0.1, "hi", 1),
        Axis("rolling_shutter", "readout_time_ms", "ms", 0.0, 40.0, "hi", 1),
        Axis("rolling_shutter", "angular_velocity_deg_s", "deg/s", 0.0, 240.0, "hi", 1),
        Axis("low_light", "illuminance_lux", "lux", 0.5, 400.0, "lo", 2),
        Axis("jpeg", "quality", "jpeg-q", 5.0, 100.0, "lo", 3),
    )
}

#: The longer suffix of a pair stands first, since the first that fits decides.
UNIT_SUFFIXES = (("_deg_s", "deg/s"), ("_per_m", "1/m"), ("_deg", "deg"), ("_ms", "ms"), ("_lux", "lux"), ("_px", "px"), ("_db", "dB"), ("_mm", "mm"), ("_um", "um"), ("_m", "m"))


def unit_of(field: str) -> str:
    return next((unit for suffix, unit in UNIT_SUFFIXES if field.endswith(suffix)), "1")
