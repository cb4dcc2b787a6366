"""Wave power flux, energy and revenue as column arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import resolve_wave_columns

HOURS_PER_YEAR = 8760
KW_COEFFICIENT = 0.49


def flux_coefficient(water_density: float = 1025.0, gravity: float = 9.81) -> float:
    """rho g^2 / (64 pi) in W/m per m^2 s."""
    return water_density * gravity**2 / (64 * math.pi)


def calculate_wave_power_flux(height: Column, period: Column, water_density: float = 1025.0, gravity: float = 9.81) -> Column:
    """Flux in W/m from height (m) and period (s)."""
    return F.lit(flux_coefficient(water_density, gravity)) * height * height * period


def flux_kw(height: Column, period: Column) -> Column:
    """Flux in kW/m with the rounded coefficient."""
    return F.lit(KW_COEFFICIENT) * height * height * period


def process_wave_data(df: DataFrame, out: str = "wave_power_flux") -> DataFrame:
    """Append the flux column with its unit and names as metadata; the input is left as it is."""
    height, period = resolve_wave_columns(df.columns)
    about = {"units": "W/m", "long_name": "Wave Power Flux", "description": "Power per metre of wave front"}
    return df.withColumn(out, calculate_wave_power_flux(F.col(height), F.col(period))).withMetadata(out, about)


def revenue_per_metre(flux_w: Column, price_per_mwh: float = 50.0, hours: int = HOURS_PER_YEAR) -> Column:
    """$/m/yr from flux in W/m."""
    return flux_w * hours * 1e-6 * price_per_mwh


def annual_energy_mwh(flux_kw_per_m: Column, width: float = 1.0, efficiency: float = 1.0, hours: int = HOURS_PER_YEAR) -> Column:
    """MWh/yr of a device of ``width`` metres from flux in kW/m."""
    return flux_kw_per_m * hours * width * efficiency / 1000


def device_revenue(flux_kw_per_m: Column, width: float = 10.0, efficiency: float = 0.35, price_per_mwh: float = 50.0) -> Column:
    """$/yr of a device from flux in kW/m."""
    return annual_energy_mwh(flux_kw_per_m, width, efficiency) * price_per_mwh
