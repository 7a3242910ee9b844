"""Thresholds, weights, class lists and policies."""

from __future__ import annotations

from dataclasses import dataclass, field

# --- fixed values: scene classification codes -------------------------------
# 0 no data, 1 saturated, 2 dark, 3 shadow, 4 vegetation, 5 bare soil, 6 water,
# 7 unclassified, 8 cloud medium, 9 cloud high, 10 cirrus, 11 snow
SCL_INVALID = (0, 1, 3, 8, 9, 10, 11)
SCL_CLOUD = (1, 3, 8, 9, 10, 11)
SCL_TERRESTRIAL = (4, 5)
SCL_FLOOD_CLEAR = (4, 5, 6, 7)

# --- fixed values: change labels --------------------------------------------
SWIR_EVENT_DELTA = 0.15
VH_EVENT_DELTA_DB = -3.0
INVALID_LABEL = 255

# --- fixed values: radar calibration ----------------------------------------
VV_DN_SCALE = 475.0
VH_DN_SCALE = 530.0

# --- fixed values: regional 72 h rainfall climatology (mean mm, std mm) -----
RAIN_CLIMATOLOGY = {
    "Bengal_Coastal": (55.0, 45.0),
    "Indus_Basin": (18.0, 22.0),
    "Brahmaputra_Valley": (65.0, 50.0),
    "Central_India": (40.0, 35.0),
    "Global_Default": (35.0, 30.0),
}

# --- fixed values: drought regimes -> (vegetation, precipitation, soil, thermal)
DROUGHT_REGIME_WEIGHTS = {
    "WETLAND_HIGH_MOISTURE": (0.20, 0.30, 0.40, 0.10),
    "IRRIGATED_AGRICULTURE": (0.15, 0.40, 0.35, 0.10),
    "DRYLAND_SPARSE": (0.20, 0.35, 0.30, 0.15),
    "RAINFED_AGRICULTURE": (0.35, 0.35, 0.20, 0.10),
    "FOREST": (0.40, 0.25, 0.25, 0.10),
    "GRASSLAND_SHRUBLAND": (0.40, 0.35, 0.20, 0.05),
}
DROUGHT_REGIME_CONFIDENCE = {
    "WETLAND_HIGH_MOISTURE": 0.88,
    "IRRIGATED_AGRICULTURE": 0.90,
    "DRYLAND_SPARSE": 0.88,
    "RAINFED_AGRICULTURE": 0.86,
    "FOREST": 0.92,
    "GRASSLAND_SHRUBLAND": 0.82,
}

# --- fixed values: drought ablation modes -> modality weights ----------------
DROUGHT_ABLATION_MODES = {
    "MODE_A_VEG_ONLY": (1.0, 0.0, 0.0, 0.0),
    "MODE_B_PRECIP_ONLY": (0.0, 1.0, 0.0, 0.0),
    "MODE_C_SM_ONLY": (0.0, 0.0, 1.0, 0.0),
    "MODE_D_VEG_PRECIP": (0.50, 0.50, 0.0, 0.0),
    "MODE_E_VEG_SM": (0.50, 0.0, 0.50, 0.0),
    "MODE_F_PRECIP_SM": (0.0, 0.50, 0.50, 0.0),
    "MODE_G_TRI_MODAL": (0.35, 0.35, 0.30, 0.0),
    "MODE_H_FULL": (0.35, 0.30, 0.25, 0.10),
}

# --- fixed values: five-mode engine -> (optical, precipitation, soil, thermal)
INFERENCE_MODES = {
    "OPTICAL_ONLY": (1.0, 0.0, 0.0, 0.0),
    "OPTICAL_PRECIP": (0.50, 0.50, 0.0, 0.0),
    "OPTICAL_SM": (0.50, 0.0, 0.50, 0.0),
    "OPTICAL_LST": (0.50, 0.0, 0.0, 0.50),
    "FULL_MULTIMODAL": (0.35, 0.30, 0.25, 0.10),
}

# --- fixed values: flood ablation modes -> channels switched on --------------
FLOOD_ABLATION_MODES = {
    "A_SAR_Only": ("sar",),
    "B_Optical_Only": ("optical",),
    "C_SAR_Optical": ("sar", "optical"),
    "D_SAR_JRC_Novelty": ("sar", "novelty"),
    "E_SAR_DEM_Terrain": ("sar", "terrain"),
    "F_Full_5_Channel": ("sar", "optical", "novelty", "terrain", "rainfall"),
}

# --- fixed values: alarm operating points and sweeps -------------------------
ALARM_THRESHOLDS = (0.18, 0.30, 0.50)
SWEEP_THRESHOLDS = (0.15, 0.20, 0.30, 0.50)
FIRE_RADII_M = (375.0, 500.0, 1000.0)
LAG_BINS_DAYS = ((0, 30), (31, 90), (91, 180), (181, 365))
OBSERVABILITY_BINS = ((0.0, 0.20), (0.20, 0.40), (0.40, 0.60), (0.60, 0.80), (0.80, 1.001))
METERS_PER_DEG_LAT = 110750.0
METERS_PER_DEG_LON = 111320.0
MODIS_CELL_HA = 21.466

# --- fixed values: evidence tiers --------------------------------------------
EVIDENCE_STATUS = (
    "NOT_VALIDATED",
    "INTERNAL_REPRODUCIBILITY",
    "REAL_DATA_VALIDATED",
    "INDEPENDENT_REFERENCE_VALIDATED",
    "END_TO_END_VALIDATED",
)

# --- fixed values: reference roles -> (independent truth, pixel scoring allowed)
REFERENCE_ROLES = {
    "COMPETING_OPERATIONAL_PRODUCT": (False, True),
    "INDEPENDENT_VALIDATION": (True, True),
    "IMPACT_CORROBORATION": (True, False),
    "DEVELOPMENT_CONTEXT": (False, True),
}


@dataclass(frozen=True)
class FloodSettings:
    strategy: str = "gated"            # or "linear"
    w_sar: float = 0.35
    w_optical: float = 0.25
    w_novelty: float = 0.20
    w_rain: float = 0.10
    w_terrain: float = 0.10
    vv_drop_db: float = -2.0
    vh_drop_db: float = -2.0
    vv_ceiling_db: float = -14.0
    vh_ceiling_db: float = -20.0
    sar_units: str = "linear"          # or "db"
    mndwi_center: float = 0.0
    ndwi_center: float = 0.0
    permanent_freq: float = 0.80
    slope_full_deg: float = 8.0
    slope_zero_deg: float = 15.0
    rain_floor_mm: float = 15.0
    rain_full_mm: float = 100.0
    opening: bool = True
    min_event_pixels: int = 4
    pixel_m: float = 20.0
    threshold: float = 0.20


# Settings recommended per flood regime; anything not named keeps the default.
FLOOD_REGIME_SETTINGS = {
    "INLAND_RIVERINE_PLUVIAL": FloodSettings(slope_full_deg=6.0, slope_zero_deg=12.0),
    "COASTAL_ESTUARINE_TIDAL": FloodSettings(w_sar=0.32, w_optical=0.28, w_novelty=0.25, w_rain=0.08,
                                             w_terrain=0.07, vv_drop_db=-2.2, permanent_freq=0.75),
    "INLAND_RIVERINE_MEGA": FloodSettings(w_sar=0.40, w_optical=0.25, w_novelty=0.20, w_rain=0.10,
                                          w_terrain=0.05),
    "WETLAND_SEASONAL": FloodSettings(w_sar=0.30, w_optical=0.30, w_novelty=0.30, w_rain=0.05,
                                      w_terrain=0.05, permanent_freq=0.60),
    "MIXED_UNCERTAIN": FloodSettings(),
}


@dataclass(frozen=True)
class DroughtSettings:
    window_weights: tuple[float, float, float] = (0.25, 0.50, 0.25)      # 1, 3, 6 months
    modality_weights: tuple[float, float, float, float] = (0.35, 0.30, 0.25, 0.10)
    detect: float = 0.50
    watch: float = 0.35
    severe: float = 0.70
    observable: float = 0.50
    min_cover_ndvi: float = 0.15
    max_cloud: float = 0.40
    ambiguous: float = 0.60
    harvest: float = 0.80
    normal_modalities: int = 2
    watch_epochs: int = 2
    active_epochs: int = 4
    recovery_epochs: int = 3
    min_event_pixels: int = 16
    suppression_days: float = 14.0
    z_floor: dict = field(default_factory=lambda: {
        "veg": 0.02, "precip_1m": 5.0, "precip_3m": 10.0, "precip_6m": 15.0, "soil": 0.01, "thermal": 1.0})


FLOOD = FloodSettings()
DROUGHT = DroughtSettings()
