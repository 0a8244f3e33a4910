"""Fixed values that results depend on: labels, codes, lags, limits. Plain data, no logic."""

# Month labels.
MONTH_LABELS = {
    "all": (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12),
    "annual": (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12),
    "year": (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12),
    "djf": (12, 1, 2),
    "mam": (3, 4, 5),
    "jja": (6, 7, 8),
    "summer": (6, 7, 8),
    "son": (9, 10, 11),
}
# The pressure-centre tracker reads "summer" as four months.
TRACKER_SUMMER = (6, 7, 8, 9)

# Region name -> mask code, and longitude/latitude bounds (lon_min, lon_max, lat_min, lat_max).
REGION_CODES = {
    "central_arctic": 1,
    "beaufort_sea": 2,
    "chukchi_sea": 3,
    "east_siberian_sea": 4,
    "laptev_sea": 5,
    "kara_sea": 6,
    "barents_sea": 7,
    "east_greenland_sea": 8,
    "baffin_and_labrador_seas": 9,
    "gulf_of_st_lawrence": 10,
    "hudson_bay": 11,
    "canadian_archipelago": 12,
    "bering_sea": 13,
    "sea_of_okhotsk": 14,
    "sea_of_japan": 15,
    "bohai_and_yellow_seas": 16,
    "baltic_sea": 17,
    "gulf_of_alaska": 18,
}
REGION_BOUNDS = {
    "sea_of_okhotsk": (135, 165, 45, 62),
    "sea_of_japan": (127, 142, 35, 52),
    "bohai_and_yellow_seas": (117, 126, 36, 41),
    "baltic_sea": (10, 32, 53, 66),
    "bering_sea": (160, -160, 55, 67),
    "gulf_of_alaska": (-160, -135, 55, 62),
    "hudson_bay": (-96, -74, 50, 65),
    "gulf_of_st_lawrence": (-70, -55, 45, 52),
    "baffin_and_labrador_seas": (-80, -45, 50, 80),
    "east_greenland_sea": (-45, 15, 60, 85),
    "barents_sea": (15, 60, 68, 82),
    "kara_sea": (55, 100, 68, 82),
    "laptev_sea": (100, 145, 70, 82),
    "east_siberian_sea": (145, 180, 68, 82),
    "chukchi_sea": (-180, -155, 66, 76),
    "beaufort_sea": (-155, -120, 68, 82),
    "canadian_archipelago": (-125, -75, 68, 82),
    "central_arctic": (-180, 180, 80, 90),
    "pan_arctic": (-180, 180, 30.98, 90),
    "custom_barents_extended": (0, 80, 65, 85),
    "custom_arctic_atlantic": (-20, 100, 60, 85),
    "custom_greenland_nordic_seas": (-45, 30, 60, 85),
    "custom_central_basin": (-180, 180, 82, 90),
}
# Accepted other names of a region.
REGION_ALIASES = {
    "pan_arctic_reference": "pan_arctic",
    "arctic": "pan_arctic",
    "okhotsk": "sea_of_okhotsk",
    "bering": "bering_sea",
    "st_lawrence": "gulf_of_st_lawrence",
    "greenland": "east_greenland_sea",
    "greenland_sea": "east_greenland_sea",
    "east_greenland": "east_greenland_sea",
    "baffin_bay": "baffin_and_labrador_seas",
    "baffin_labrador": "baffin_and_labrador_seas",
    "baffin_labrador_seas": "baffin_and_labrador_seas",
    "japan": "sea_of_japan",
    "bohai_yellow": "bohai_and_yellow_seas",
    "baltic": "baltic_sea",
    "alaska": "gulf_of_alaska",
    "barents": "barents_sea",
    "kara": "kara_sea",
    "laptev": "laptev_sea",
    "east_siberian": "east_siberian_sea",
    "chukchi": "chukchi_sea",
    "beaufort": "beaufort_sea",
    "barents_extended": "custom_barents_extended",
    "barents_ext": "custom_barents_extended",
    "arctic_atlantic": "custom_arctic_atlantic",
    "greenland_nordic": "custom_greenland_nordic_seas",
    "greenland_nordic_seas": "custom_greenland_nordic_seas",
    "nordic_seas": "custom_greenland_nordic_seas",
    "central_basin": "custom_central_basin",
    "central_arctic_basin": "custom_central_basin",
}
# Which regions touch (one hop).
REGION_NEIGHBOURS = {
    "central_arctic": ("beaufort_sea", "chukchi_sea", "east_siberian_sea", "laptev_sea", "kara_sea", "barents_sea", "east_greenland_sea", "canadian_archipelago"),
    "beaufort_sea": ("central_arctic", "chukchi_sea", "canadian_archipelago"),
    "chukchi_sea": ("central_arctic", "beaufort_sea", "east_siberian_sea", "bering_sea"),
    "east_siberian_sea": ("central_arctic", "chukchi_sea", "laptev_sea"),
    "laptev_sea": ("central_arctic", "east_siberian_sea", "kara_sea"),
    "kara_sea": ("central_arctic", "laptev_sea", "barents_sea"),
    "barents_sea": ("central_arctic", "kara_sea", "east_greenland_sea"),
    "east_greenland_sea": ("central_arctic", "barents_sea", "baffin_and_labrador_seas"),
    "baffin_and_labrador_seas": ("east_greenland_sea", "canadian_archipelago", "hudson_bay", "gulf_of_st_lawrence"),
    "gulf_of_st_lawrence": ("baffin_and_labrador_seas",),
    "hudson_bay": ("baffin_and_labrador_seas", "canadian_archipelago"),
    "canadian_archipelago": ("central_arctic", "beaufort_sea", "baffin_and_labrador_seas", "hudson_bay"),
    "bering_sea": ("chukchi_sea", "sea_of_okhotsk", "gulf_of_alaska"),
    "sea_of_okhotsk": ("bering_sea", "sea_of_japan"),
    "sea_of_japan": ("sea_of_okhotsk",),
    "bohai_and_yellow_seas": (),
    "baltic_sea": (),
    "gulf_of_alaska": ("bering_sea",),
}
FOCUS_REGIONS = ("beaufort_sea", "laptev_sea", "kara_sea", "barents_sea", "central_arctic")
AGGREGATE_REGIONS = ("pan_arctic", "pan_arctic_reference")

# Surface-mask codes.
OCEAN_CODES = tuple(range(0, 19))
OTHER_CODES = (30, 32, 33, 34, 35, 40)

# Lag days.
BACKGROUND_LAGS = (-10, -7, -5)
EVENT_LAGS = (-1, 0)
LAG_GROUPS = {"pre-event": (-3, -1), "event-time": (0,), "post-event": (1, 3, 5)}
CYCLONE_LAGS = (-1, 0, 1)
ALL_LAGS = (-10, -7, -5, -3, -1, 0, 1, 3, 5)

# Sign a supported pressure-centre effect must have.
CYCLONE_DIRECTION = {
    "nearest_cyclone_distance_km": "negative",
    "nearest_cyclone_pressure_hpa": "negative",
    "cyclone_count_500km": "positive",
    "cyclone_count_1000km": "positive",
}

# Control matching.
CONTROL_TIERS = (30, 45, 60)
CONTROL_TARGET = 20
CONTROL_MIN = 10

# Class codes of an exclusive partition.
CLASS_NAMES = {0: "residual", 1: "broad_nonsevere", 2: "severe_nonmajor", 3: "major_severe"}

# Event window of the two tracks, days before and after the event date.
TRACKS = {"detector": (2, 1), "cdr": (5, 0)}

# Ellipsoid of the polar grid, its true-scale latitude and central meridian.
GRID_SEMI_MAJOR_M = 6378273.0
GRID_SEMI_MINOR_M = 6356889.449
GRID_TRUE_SCALE_LAT = 70.0
GRID_LON_0 = -45.0
GRID_X0_M = -3850000.0
GRID_Y0_M = 5850000.0
GRID_STEP_M = 25000.0
WGS84_SEMI_MAJOR_M = 6378137.0
WGS84_FLATTENING = 1 / 298.257223563

# Display labels of region ids by language; other ids show as themselves.
REGION_LABELS = {
    "central_arctic": {"en": "Central Arctic (NSIDC-0780 region 1)", "zh": "中央北极区（NSIDC-0780第1区）"},
    "central_basin": {"en": "Central Basin (custom 82–90°N)", "zh": "中央北极盆地（自定义82–90°N纬度带）"},
    "central_arctic_basin": {"en": "Central Basin (custom 82–90°N)", "zh": "中央北极盆地（自定义82–90°N纬度带）"},
}

# fixed values: variables whose lead counts as dynamic forcing
DYNAMIC_VARIABLES = ("era5_msl_buffer", "era5_u10_buffer", "era5_v10_buffer", "era5_wspd10_buffer")

# fixed values: wording of a region's regime; the first row whose region, least scores and proximity status hold applies
REGIME_RULES = (
    ("beaufort_sea", {"major_severe_cluster_support": 4, "location_buffer_support": 4, "wrong_region_control": 3, "year_block_bootstrap": 3}, None, "Strong preconditioned/compound regime"),
    ("beaufort_sea", {"major_severe_cluster_support": 3, "location_buffer_support": 3, "wrong_region_control": 3}, None, "Moderate preconditioned/compound regime"),
    ("beaufort_sea", {"major_severe_cluster_support": 3, "location_buffer_support": 3, "year_block_bootstrap": 3}, None, "Moderate preconditioned/compound regime"),
    ("beaufort_sea", {}, None, "Preconditioned/compound suggestive regime"),
    ("laptev_sea", {"lead_lag_directionality": 3, "wrong_region_control": 2}, None, "Dynamic-loss regime with contemporaneous forcing"),
    ("laptev_sea", {}, None, "Dynamic-loss suggestive regime"),
    ("kara_sea", {"lead_lag_directionality": 3, "location_buffer_support": 3}, "supported", "Moderate atmospheric-dynamic regime"),
    ("kara_sea", {}, None, "Atmospheric-dynamic suggestive regime"),
    ("barents_sea", {}, None, "Barents Sea atmospheric/compound suggestive regime; ocean heat not tested"),
    ("central_arctic", {}, None, REGION_LABELS["central_arctic"]["en"] + " weak/threshold-sensitive regime"),
)
REGIME_OTHERWISE = "Relative-threshold-sensitive / weak absolute-loss regime"
# fixed values: most confidence of a region (all regimes, or only those that begin so), and the most its severity score may count
CONFIDENCE_CAPS = (("central_arctic", "", "weak"), ("barents_sea", "", "weak"), ("kara_sea", "Atmospheric-dynamic suggestive", "suggestive"))
SCORE_CAPS = (("central_arctic", "major_severe_cluster_support", 1),)
