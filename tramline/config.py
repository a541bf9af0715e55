"""Constants that carry meaning, gathered in one place; all are defaults that operators take as parameters."""

# Clock periods in minutes since midnight, half-open.
PERIODS = {"AM": (420.0, 600.0), "IP": (600.0, 960.0), "PM": (960.0, 1140.0)}
AM_PEAK_HOUR = (480.0, 540.0)
REACH_SHARE = 0.5
SERVED_MIN = {"road": 8.0, "rail": 12.0}
INTERVAL_BANDS = [5.0, 10.0, 20.0, 40.0, 60.0]
DISTANCE_BANDS = [300.0, 500.0, 750.0, 1000.0]
DIRECTION_MIN_SHARE = 0.1
SCORE_CAP_DPH = 12.0
FREQUENT_HEADWAYS = [10.0, 15.0]
JOB_THRESHOLDS = [30, 45]
DECAY_BETA = 0.04
GC_WEIGHTS = {"ride": 1.0, "walk": 2.0, "wait": 2.0, "transfer": 7.5}
#: Waiting time against scheduled wait: piecewise linear, left-clamped.
WAIT_CURVE = [(0.0, 0.0), (5.0, 5.0), (10.0, 8.0), (20.0, 13.0), (40.0, 19.0)]
GAP_BANDS_KM = [("< 1 km", 0.0, 1.0), ("1–2 km", 1.0, 2.0), ("2–5 km", 2.0, 5.0), ("5–10 km", 5.0, 10.0)]
MIN_OBS, MIN_CELLS = 10, 20
CLUSTER_SAME_NAME_M, CLUSTER_ANY_NAME_M = 150.0, 40.0
EARTH_KM = 6371.0088
KM_PER_DEGREE = 111.32
TRACE_GAP_S = 120.0
MAX_KMH = 130.0
STATION_COUNT, STATION_OFFSET_KM = 3, 1.0
RAIL_SHARE_BANDS_KM, RAIL_SHARE_MIN_N = [5.0, 15.0, 50.0], 10
GRAVITY_KM = 5.0
ANPR_SOFT_SCALE, ANPR_K, ANPR_DELAY = 0.3, (0.3, 1.5), (0.0, 120.0)
