"""Spectral indices, masks, change and radar unit expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from landpulse import config
from landpulse.functions.core import as_col, clip


def normalized_difference(a, b, min_sum: float = 1e-8) -> Column:
    """(a - b) / (a + b); NULL when either input is NULL or the sum is about zero."""
    a, b = as_col(a), as_col(b)
    return F.when(F.abs(a + b) > min_sum, (a - b) / (a + b))


def bounded_index(a, b, eps: float = 1e-6) -> Column:
    """Canopy/moisture index: zero where the sum is not positive, bounded to [-1, 1]."""
    a, b = as_col(a), as_col(b)
    total = a + b
    return clip(F.when(total > eps, (a - b) / total).when(total.isNotNull(), 0.0), -1.0, 1.0)


def ndvi(nir, red) -> Column:
    return bounded_index(nir, red)


def ndre(nir, red_edge) -> Column:
    return bounded_index(nir, red_edge)


def ndwi_moisture(nir, swir) -> Column:
    return bounded_index(nir, swir)


def evi(nir, red, blue, max_nir, eps: float = 1e-6) -> Column:
    """Enhanced vegetation index; digital numbers are scaled when the tile's peak nir exceeds 10."""
    scale = F.when(as_col(max_nir) > 10.0, 10000.0).otherwise(1.0)
    n, r, b = as_col(nir) / scale, as_col(red) / scale, as_col(blue) / scale
    denominator = n + 6.0 * r - 7.5 * b + 1.0
    value = F.when(denominator > eps, 2.5 * (n - r) / denominator).when(denominator.isNotNull(), 0.0)
    return clip(value, -1.0, 1.5)


def reflectance(dn) -> Column:
    return as_col(dn) / 10000.0


def scl_usable(scl, policy: str = "default") -> Column:
    """Validity under one of the four class policies."""
    scl = as_col(scl)
    if policy == "default":
        return ~scl.isin(*config.SCL_INVALID)
    if policy == "cloud":
        return ~scl.isin(*config.SCL_CLOUD)
    if policy == "terrestrial":
        return scl.isin(*config.SCL_TERRESTRIAL)
    if policy == "flood":
        return scl.isin(*config.SCL_FLOOD_CLEAR)
    raise ValueError(f"Unknown class policy: {policy}")


def to_db(power) -> Column:
    power = as_col(power)
    return F.when(power > 0, 10.0 * F.log10(power))


def dn_to_linear(dn, scale: float) -> Column:
    scaled = as_col(dn) / scale
    return scaled * scaled


def is_changed(delta, threshold: float) -> Column:
    if threshold <= 0:
        raise ValueError("threshold must be positive")
    return F.abs(as_col(delta)) >= threshold


def disturbance_score(delta, threshold: float) -> Column:
    if threshold <= 0:
        raise ValueError("threshold must be positive")
    return clip(F.abs(as_col(delta)) / threshold, 0.0, 1.0)


def joint_event_label(scl_before, scl_after, mask_before, mask_after, vh_before, vh_after,
                      b12_before, b12_after) -> Column:
    """1 event, 0 none, 255 where optical and radar are not valid on both dates."""
    optical = (scl_usable(scl_before) & scl_usable(scl_after)
               & (as_col(mask_before) > 0) & (as_col(mask_after) > 0))
    radar = (as_col(vh_before) > 0) & (as_col(vh_after) > 0)
    event = ((as_col(b12_after) - as_col(b12_before) > config.SWIR_EVENT_DELTA)
             | (to_db(vh_after) - to_db(vh_before) < config.VH_EVENT_DELTA_DB))
    valid = F.coalesce(optical & radar, F.lit(False))
    return (F.when(~valid, config.INVALID_LABEL)
            .when(F.coalesce(event, F.lit(False)), 1).otherwise(0))


def burn_quality(qa) -> dict[str, Column]:
    """Decode the burned-area quality byte."""
    qa = as_col(qa)
    bit = lambda k: F.shiftright(qa, k).bitwiseAND(F.lit(1))
    land, valid = bit(0) == 1, bit(1) == 1
    full_month, not_relabelled = bit(2) == 0, bit(3) == 0
    return {"is_land": land, "is_valid": valid, "is_full_month": full_month,
            "is_not_relabelled": not_relabelled,
            "high_confidence": land & valid & full_month & not_relabelled}
