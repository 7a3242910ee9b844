"""Flood evidence, fusion and decision expressions."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from landpulse.config import FLOOD, FLOOD_REGIME_SETTINGS, FloodSettings
from landpulse.functions.core import as_col, bound, clip
from landpulse.functions.indices import scl_usable


def _true(condition) -> Column:
    return F.coalesce(as_col(condition), F.lit(False))


def _sar_polarisation(before, event, drop_db: float, ceiling_db: float, units: str) -> Column:
    if isinstance(drop_db, Column):
        start = F.abs(drop_db)
        span = F.greatest(F.lit(1e-6), 6.0 - start)
    elif drop_db < 0:
        start, span = -drop_db, max(1e-6, 6.0 + drop_db)
    else:
        raise ValueError("drop threshold must be negative")
    if units == "linear":
        db = lambda x: 10.0 * F.log10(bound(x, 1e-7, 10.0))
    elif units == "db":
        db = lambda x: as_col(x)
    else:
        raise ValueError("units must be linear or db")
    event_db = db(event)
    drop = bound((db(before) - event_db - start) / span, 0.0, 1.0)
    dark = bound((ceiling_db - event_db) / 8.0 + 0.5, 0.0, 1.0)
    return 0.6 * drop + 0.4 * dark


def sar_valid(vv_before, vv_event, vh_before=None, vh_event=None) -> Column:
    inputs = [vv_before, vv_event] + ([vh_before, vh_event] if vh_before is not None else [])
    valid = F.lit(True)
    for band in inputs:
        valid = valid & _true(as_col(band) > 0)
    return valid


def sar_water(vv_before, vv_event, vh_before=None, vh_event=None, s: FloodSettings = FLOOD) -> Column:
    """Radar water evidence in [0, 1]; 0 where invalid."""
    score = _sar_polarisation(vv_before, vv_event, s.vv_drop_db, s.vv_ceiling_db, s.sar_units)
    if vh_before is not None:
        vh = _sar_polarisation(vh_before, vh_event, s.vh_drop_db, s.vh_ceiling_db, s.sar_units)
        score = 0.55 * score + 0.45 * vh
    return F.when(sar_valid(vv_before, vv_event, vh_before, vh_event), bound(score, 0.0, 1.0)).otherwise(0.0)


def optical_valid(green, nir, swir=None, scl=None) -> Column:
    valid = _true(as_col(green) > 0) & _true(as_col(nir) > 0)
    if scl is not None:
        valid = valid & _true(scl_usable(scl, "flood"))
    if swir is not None:
        valid = valid & _true(as_col(swir) > 0)
    return valid


def optical_water(green, nir, swir=None, scl=None, s: FloodSettings = FLOOD) -> Column:
    """Open-water evidence from green/nir and green/swir; cloudy pixels are invalid, not dry."""
    def contrast(other, center):
        g, o = as_col(green), as_col(other)
        return bound(((g - o) / bound(g + o, 1e-4, 2.0) - center) / 0.5 + 0.5, 0.0, 1.0)

    score = contrast(nir, s.ndwi_center)
    if swir is not None:
        score = 0.4 * score + 0.6 * contrast(swir, s.mndwi_center)
    return F.when(optical_valid(green, nir, swir, scl), bound(score, 0.0, 1.0)).otherwise(0.0)


def novelty_multiplier(frequency, s: FloodSettings = FLOOD) -> Column:
    return clip(1.0 - as_col(frequency) / s.permanent_freq, 0.0, 1.0)


def water_novelty(score, frequency, s: FloodSettings = FLOOD) -> Column:
    """New water only: evidence damped by how often the pixel is normally wet."""
    value = clip(as_col(score) * novelty_multiplier(frequency, s), 0.0, 1.0)
    return F.coalesce(value, F.lit(0.0))


def normalize_occurrence(percent) -> Column:
    """Occurrence percent to frequency; values outside 0..100 are missing."""
    percent = as_col(percent)
    return F.when((percent >= 0) & (percent <= 100), percent / 100.0)


def permanent_water(frequency, threshold: float = 0.80) -> Column:
    return _true(as_col(frequency) >= threshold)


def terrain_plausibility(slope_deg, s: FloodSettings = FLOOD) -> Column:
    slope = as_col(slope_deg)
    steep = bound(1.0 - (slope - s.slope_full_deg) / (s.slope_zero_deg - s.slope_full_deg), 0.0, 1.0)
    return F.when(_true(slope >= 0), F.when(slope > s.slope_full_deg, steep).otherwise(1.0)).otherwise(0.0)


def rainfall_context(mm, anomaly_sigma, hours_since_peak, s: FloodSettings = FLOOD) -> Column:
    mm, sigma, hours = as_col(mm), as_col(anomaly_sigma), as_col(hours_since_peak)
    amount = bound(mm / s.rain_full_mm, 0.0, 1.0)
    anomaly = bound((sigma + 1.0) / 4.0, 0.0, 1.0)
    decay = F.exp(-F.greatest(F.lit(0.0), hours) / 72.0)
    score = bound(0.6 * amount + 0.4 * anomaly, 0.0, 1.0) * (0.5 + 0.5 * decay)
    return F.when(mm < s.rain_floor_mm, 0.05).when(mm.isNotNull(), bound(score, 0.0, 1.0))


def fuse_gated(sar, sar_ok, optical, optical_ok, novelty=None, terrain=None, rain=None,
               s: FloodSettings = FLOOD) -> Column:
    """Blend of the valid water channels, multiplied by novelty, terrain and rainfall gates.

    A gate passed as NULL (channel absent from the tile) is neutral. The result is 0 where
    neither water channel is valid.
    """
    sar, optical = as_col(sar), as_col(optical)
    sar_ok, optical_ok = _true(sar_ok), _true(optical_ok)
    primary = (F.when(sar_ok & optical_ok, (s.w_sar * sar + s.w_optical * optical) / (s.w_sar + s.w_optical))
               .when(sar_ok, sar).when(optical_ok, optical).otherwise(0.0))
    gate = lambda g: F.lit(1.0) if g is None else F.coalesce(as_col(g), F.lit(1.0))
    rain_gate = F.lit(1.0) if rain is None else F.coalesce(0.70 + 0.30 * as_col(rain), F.lit(1.0))
    gated = primary * gate(novelty) * gate(terrain) * rain_gate
    return F.when(sar_ok | optical_ok, bound(gated, 0.0, 1.0)).otherwise(0.0)


def fuse_linear(sar, sar_ok, optical, optical_ok, novelty, novelty_ok, terrain, terrain_ok, rain,
                s: FloodSettings = FLOOD) -> Column:
    """Weighted mean over the channels valid at the pixel."""
    overall = _true(sar_ok) | _true(optical_ok)
    channels = [(sar, _true(sar_ok), s.w_sar), (optical, _true(optical_ok), s.w_optical),
                (novelty, _true(novelty_ok), s.w_novelty), (terrain, _true(terrain_ok), s.w_terrain),
                (rain, overall & as_col(rain).isNotNull(), s.w_rain)]
    total, weight = F.lit(0.0), F.lit(0.0)
    for value, ok, w in channels:
        total = total + F.when(ok, as_col(value) * w).otherwise(0.0)
        weight = weight + F.when(ok, w).otherwise(0.0)
    return F.when(overall & (weight > 0), bound(total / weight, 0.0, 1.0)).otherwise(0.0)


def blend_regime(global_score, regime_score, confidence, regime) -> Column:
    """Regime score weighted by routing confidence; an uncertain regime keeps the global score."""
    c = F.when(as_col(regime) == "MIXED_UNCERTAIN", 0.0).otherwise(as_col(confidence))
    return (1.0 - c) * as_col(global_score) + c * as_col(regime_score)


def coastal_masks(occurrence, elevation, slope, permanent: float = 0.80, tidal_m: float = 6.0,
                  occurrence_low: float = 0.05) -> tuple[Column, Column]:
    """(marine, intertidal) conditions."""
    occ, elev = as_col(occurrence), as_col(elevation)
    marine = _true((elev <= 2.5) & (occ >= permanent))
    intertidal = _true((elev <= tidal_m) & (as_col(slope) <= 2.5) & (occ >= occurrence_low) & (occ < permanent))
    return marine, intertidal


def coastal_multiplier(occurrence, elevation, slope, is_coastal, in_marine_buffer,
                       permanent: float = 0.80, tidal_m: float = 6.0, floor: float = 0.35) -> Column:
    """Soft suppression of marine water, tidal flats and the shoreline fringe."""
    occ, elev = as_col(occurrence), as_col(elevation)
    marine, intertidal = coastal_masks(occ, elev, slope, permanent, tidal_m)
    soft = bound((elev - 1.0) / (tidal_m - 1.0), floor, 1.0) * bound(1.0 - occ / permanent, floor, 1.0)
    base = F.when(marine, 0.0).when(intertidal, bound(soft, floor, 0.85)).otherwise(1.0)
    fringe = _true(in_marine_buffer) & ~marine & (elev <= 3.5)
    value = F.when(fringe, F.greatest(F.lit(floor), F.least(base, F.lit(0.50)))).otherwise(base)
    valid = occ.isNotNull() & elev.isNotNull() & as_col(slope).isNotNull()
    return F.when(~valid, 0.0).when(_true(is_coastal), value).otherwise(1.0)


def observability(valid, slope_deg, relief_m, elevation, occurrence, scale_factor) -> Column:
    """Product of data validity, slope, relief, tidal and channel-width factors."""
    elev, occ = as_col(elevation), as_col(occurrence)
    tidal = _true((elev <= 2.5) & (occ >= 0.10) & (occ < 0.70))
    value = (F.when(_true(valid), 1.0).otherwise(0.0)
             * clip(1.0 - as_col(slope_deg) / 15.0, 0.0, 1.0)
             * clip(1.0 - clip(relief_m, 0.0, 150.0) / 150.0, 0.0, 1.0)
             * F.when(tidal, 0.35).otherwise(1.0) * as_col(scale_factor))
    return clip(value, 0.0, 1.0)


def is_valley(slope_deg, occurrence) -> Column:
    return _true(as_col(slope_deg) <= 5.0) | _true(as_col(occurrence) > 0.0)


def severity(area_ha, payload: bool = False) -> Column:
    """Area tiers. The alert package knows no RESOLVED tier, the alert machine does."""
    area = as_col(area_ha)
    tiers = F.when(area >= 100.0, "CRITICAL").when(area >= 10.0, "WARNING")
    if payload:
        return tiers.otherwise("ADVISORY")
    return tiers.when(area == 0.0, "RESOLVED").otherwise("ADVISORY")


def regime_from_features(relief, steep, mean_elev, coastal, marine, intertidal, p10, flat, dry, seasonal) -> Column:
    """Physical decision tree over tile statistics."""
    c = as_col
    return (F.when((c(relief) > 60.0) | (c(steep) > 0.10) | ((c(mean_elev) > 50.0) & (c(steep) > 0.05)),
                   "INLAND_RIVERINE_PLUVIAL")
            .when(c(coastal) & ((c(marine) > 0.04) | (c(intertidal) > 0.03) | (c(p10) <= 3.0)),
                  "COASTAL_ESTUARINE_TIDAL")
            .when((c(flat) >= 0.65) & (c(relief) <= 60.0) & (c(dry) >= 0.65), "INLAND_RIVERINE_MEGA")
            .when(c(seasonal) >= 0.20, "WETLAND_SEASONAL")
            .otherwise("MIXED_UNCERTAIN"))


def regime_confidence(regime, relief, marine, intertidal, flat) -> Column:
    c, r = as_col, as_col(regime)
    return (F.when(r == "INLAND_RIVERINE_PLUVIAL", clip(0.70 + 0.30 * F.least(F.lit(1.0), c(relief) / 200.0), 0.70, 0.95))
            .when(r == "COASTAL_ESTUARINE_TIDAL", clip(0.70 + 0.30 * (c(marine) + c(intertidal)), 0.70, 0.95))
            .when(r == "INLAND_RIVERINE_MEGA", clip(0.75 + 0.25 * c(flat), 0.75, 0.98))
            .when(r == "WETLAND_SEASONAL", 0.75).otherwise(0.50))


TUNED = ("w_sar", "w_optical", "w_novelty", "w_rain", "w_terrain", "vv_drop_db", "permanent_freq",
         "slope_full_deg", "slope_zero_deg")


def regime_settings(regime) -> dict[str, Column]:
    """Values of the regime-dependent settings as literal lookups, named ``set_<name>``."""
    def lookup(name: str) -> Column:
        pairs = [F.lit(v) for r, s in FLOOD_REGIME_SETTINGS.items() for v in (r, float(getattr(s, name)))]
        return F.create_map(*pairs)[as_col(regime)]

    return {f"set_{name}": lookup(name) for name in TUNED}


def row_settings() -> FloodSettings:
    """Settings read from the row's own ``set_<name>`` columns."""
    return replace(FLOOD, **{name: F.col(f"set_{name}") for name in TUNED})
