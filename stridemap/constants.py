"""Fixed values that results depend on, and the table schemas."""

from __future__ import annotations

# Weights and estimates.
PATH_LOSS, PINNED = 3.0, 0.75
HOLE = 3.0
# Places.
AT_CORNER_M, BLOCK_M = 15.0, 100.0
EARTH_RADIUS_M = 6_371_000.0
NEAR_CROSSING_M, LONGEST_DETOUR, SURROUNDINGS_M = 25.0, 3.0, 200.0
# Matching.
NEIGHBOURS, ONE_PLACE_BLOCKS, ONE_PLACE_M = 5, 3.0, 5000.0
SIMILARITY_FLOOR, RSSI_SCALE, SIGNAL_UNKNOWN, DOMINANCE = 0.15, 10.0, 0.75, 0.6
ONE_LOOK_S, ODDS_PER_TENTH = 15, 3.0
LOOK_BACK, NEXT_STRETCH, JUMP = 3, 0.5, 0.05
# Pace, band, levels, calibration.
PACE_ACCELERATION, PACE_SCAN_M, PACE_RESET_S = 0.1, 15.0, 30.0
BAND_BASE_M, BAND_SLOPE_M = 20.0, 60.0
LEVEL_UNHEARD, LEVEL_STEP_M, LEVEL_WIDTH_M, LEVEL_SUPPORT = -95.0, 2.0, 12.0, 0.5
CAL_SURE, CAL_NEAR_M, CAL_STRONG, CAL_PAIRS, CAL_KEPT, CAL_MOST = 0.4, 10.0, -75.0, 30, 500, 20.0
JUMP_SLACK_M, NEAR_A_CORNER = 5.0, 0.2
MAX_WALK_MS, JUNCTION_CLUSTER_M, NEARBY_JUNCTION_M = 2.5, 60.0, 30.0
# Capture.
DEBOUNCE_S, SUSPEND_S, FAILURE_REMINDER, SESSION_GAP_S = 1.0, 1.0, 12, 1800
BATTERY_WARNINGS = (20, 10)

NETWORK = (
    "struct<ssid:string,bssid:string,security:string,frequency:int,signal_dbm:int,signal_percent:int,connected:boolean>"
)
LOG_SCHEMA = (
    "file string, pos bigint, time timestamp, utc_offset_s int, event string, outing string, interface string, cycle bigint, "
    "ssid string, bssid string, frequency int, signal_dbm int, signal_percent int, reason string, seconds double, number bigint, "
    f"key bigint, networks array<{NETWORK}>"
)
FINGERPRINT_SCHEMA = (
    "fp_id bigint, outing string, walk string, time timestamp, name_from string, name_to string, fraction double, lat double, "
    f"lon double, length_m double, networks array<{NETWORK}>"
)
EVENTS = ("scan", "new", "connected", "disconnected", "scan_failed", "suspended", "mark", "button_lost")
