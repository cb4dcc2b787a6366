"""Columns, limits and constants of gridded wave observations in long form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import types as T

KEYS = ["time", "latitude", "longitude"]
CELL = ["latitude", "longitude"]
VARIABLES = [
    "VMDR_SW1", "VTM01_SW1", "VHM0_SW1", "VMDR_SW2", "VTM01_SW2", "VHM0_SW2", "VMDR", "VPED", "VTM10", "VTM02", "VTPK", "VHM0",
    "VSDX", "VSDY", "VMDR_WW", "VTM01_WW", "VHM0_WW",
]

#: Inclusive quality limits (low, high, whether the low end itself fails).
QUALITY_LIMITS: dict[str, tuple[float, float, bool]] = {
    "VHM0": (0.0, 25.0, False),
    "VHM0_SW1": (0.0, 20.0, False),
    "VHM0_SW2": (0.0, 15.0, False),
    "VHM0_WW": (0.0, 15.0, False),
    "VTPK": (0.0, 30.0, True),
    "VMDR": (0.0, 360.0, False),
    "VMDR_SW1": (0.0, 360.0, False),
    "VMDR_SW2": (0.0, 360.0, False),
    "VMDR_WW": (0.0, 360.0, False),
}

#: Main study area.
STUDY_AREA = {"min_lat": 46.0, "max_lat": 50.5, "min_lon": -130.0, "max_lon": -124.0}
WINTER, SUMMER = (12, 1, 2), (6, 7, 8)

OBSERVATIONS = T.StructType(
    [T.StructField("time", T.TimestampNTZType()), *(T.StructField(c, T.DoubleType()) for c in (*CELL, *VARIABLES))]
)


def resolve_wave_columns(columns: Sequence[str]) -> tuple[str, str]:
    """(height, period) column: VHM0 and VTPK, else swh and mwp, else ``ValueError``."""
    for height, period in (("VHM0", "VTPK"), ("swh", "mwp")):
        if height in columns and period in columns:
            return height, period
    raise ValueError("no wave height and period columns: expected VHM0 and VTPK, or swh and mwp")
