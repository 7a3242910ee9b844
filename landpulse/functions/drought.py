"""Drought anomaly, fusion, observability and decision expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from landpulse.config import (DROUGHT, DROUGHT_REGIME_CONFIDENCE, DROUGHT_REGIME_WEIGHTS, DroughtSettings)
from landpulse.functions.core import as_col, clip


def z_anomaly(x, mean, std, floor: float = 0.02, bound: float | None = 4.0) -> Column:
    z = (as_col(x) - as_col(mean)) / F.greatest(as_col(std), F.lit(floor))
    z = F.when(as_col(std).isNotNull(), z)
    return z if bound is None else clip(z, -bound, bound)


def vci(x, low, high, eps: float = 1e-4, scale: float = 1.0) -> Column:
    """Condition index: position between the pixel's historical extremes."""
    x, low, high = as_col(x), as_col(low), as_col(high)
    return clip(scale * (x - low) / F.greatest(high - low, F.lit(eps)), 0.0, scale)


minmax_percentile = vci


def z_to_evidence(z, full_at: float = 2.0) -> Column:
    return clip(-as_col(z) / full_at, 0.0, 1.0)


def window_evidence(z1, z3, z6, s: DroughtSettings = DROUGHT) -> Column:
    a, b, c = s.window_weights
    return a * z_to_evidence(z1) + b * z_to_evidence(z3) + c * z_to_evidence(z6)


def soil_evidence(surface, rootzone, w_surface: float = 0.35) -> Column:
    return w_surface * z_to_evidence(surface) + (1.0 - w_surface) * z_to_evidence(rootzone)


def thermal_evidence(z) -> Column:
    return clip(as_col(z) / 2.0, 0.0, 1.0)


def fuse_modalities(veg, precip, soil, thermal, w_veg, w_precip, w_soil, w_thermal) -> Column:
    c = as_col
    return clip(c(w_veg) * c(veg) + c(w_precip) * c(precip) + c(w_soil) * c(soil) + c(w_thermal) * c(thermal), 0.0, 1.0)


def optical_evidence(z_ndvi, z_evi) -> Column:
    """Four-index optical evidence; the two moisture indices follow damped greenness."""
    return (0.40 * z_to_evidence(z_ndvi) + 0.20 * z_to_evidence(z_evi)
            + 0.20 * z_to_evidence(as_col(z_ndvi) * 0.9) + 0.20 * z_to_evidence(as_col(z_ndvi) * 0.8))


def drought_probability(evidence) -> Column:
    return 1.0 / (1.0 + F.exp(-4.0 * as_col(evidence)))


def inference_state(evidence, observability, ambiguity) -> Column:
    """Mode-engine state. Evidence is never negative, so NO_DROUGHT needs none of the
    other conditions and missing evidence is UNRESOLVED."""
    e, o, a = as_col(evidence), as_col(observability), as_col(ambiguity)
    return (F.when((e > 0.25) & (o >= 0.35) & (a < 0.50), "DROUGHT")
            .when((e < -0.10) & (o >= 0.35) & (a < 0.50), "NO_DROUGHT")
            .otherwise("UNRESOLVED"))


def observability(valid, cloud_fraction, baseline_ndvi, s: DroughtSettings = DROUGHT) -> Column:
    return clip(F.when(as_col(valid), 1.0).otherwise(0.0)
                * clip(1.0 - as_col(cloud_fraction) / s.max_cloud, 0.0, 1.0)
                * F.coalesce(clip(as_col(baseline_ndvi) / s.min_cover_ndvi, 0.25, 1.0), F.lit(1.0)), 0.0, 1.0)


def attribution_ambiguity(irrigated, harvested) -> Column:
    return F.greatest(F.when(as_col(irrigated), 0.70).otherwise(0.0),
                      F.when(as_col(harvested), 0.85).otherwise(0.0))


def tristate(score, veg, precip, soil, observability_index, ambiguity, s: DroughtSettings = DROUGHT) -> Column:
    """DROUGHT / NO_DROUGHT / UNRESOLVED; no evidence never turns into NO_DROUGHT."""
    seen = as_col(observability_index) >= s.observable
    normal = sum((F.coalesce((as_col(m) < s.watch).cast("int"), F.lit(0)) for m in (veg, precip, soil)), F.lit(0))
    return (F.when(seen & (as_col(score) >= s.detect) & (as_col(ambiguity) < s.harvest), "DROUGHT")
            .when(seen & (as_col(score) < s.detect) & (normal >= s.normal_modalities), "NO_DROUGHT")
            .otherwise("UNRESOLVED"))


def severity_tier(mean_severity) -> Column:
    m = as_col(mean_severity)
    return F.when(m >= 0.75, "EXTREME").when(m >= 0.60, "SEVERE").when(m >= 0.45, "MODERATE").otherwise("MILD")


def regime_from_features(mean_ndvi, amplitude, irrigated_share, water_share) -> Column:
    m, a = as_col(mean_ndvi), as_col(amplitude)
    return (F.when(as_col(water_share) >= 0.20, "WETLAND_HIGH_MOISTURE")
            .when(as_col(irrigated_share) >= 0.30, "IRRIGATED_AGRICULTURE")
            .when((m < 0.20) & (a < 0.20), "DRYLAND_SPARSE")
            .when(a >= 0.35, "RAINFED_AGRICULTURE")
            .when((m >= 0.55) & (a < 0.30), "FOREST")
            .otherwise("GRASSLAND_SHRUBLAND"))


def regime_confidence(regime) -> Column:
    return F.create_map(*[F.lit(v) for p in DROUGHT_REGIME_CONFIDENCE.items() for v in p])[as_col(regime)]


def regime_weight(regime, modality: int) -> Column:
    pairs = [F.lit(v) for r, w in DROUGHT_REGIME_WEIGHTS.items() for v in (r, w[modality])]
    return F.create_map(*pairs)[as_col(regime)]
