"""Fixed values that must equal the reference's for identical results.

These are stated plainly, in their natural order, and kept together here.
"""

# --- fixed values: risk buckets --------------------------------------------------------------
CRITICAL_SCORE = 0.9          # score strictly above this is 'Critical'
HIGH_PERCENT_RANK = 0.01      # percent_rank (desc) at or below this is 'High'
MEDIUM_PERCENT_RANK = 0.20    # percent_rank (desc) at or below this is 'Medium'
LOW_SCORE = 0.01              # otherwise score strictly above this is 'Low', else 'No'
BUCKET_CRITICAL, BUCKET_GENERAL = "Critical", "General"
BUCKET_HIGH, BUCKET_MEDIUM, BUCKET_LOW, BUCKET_NO = "High", "Medium", "Low", "No"

# --- fixed values: scoring defaults ------------------------------------------------------------
WILSON_Z = 1.96
WINSOR_EXTREME_SCORE = 0.99
DEFAULT_WINSOR_PERCENTILE = 0.99
DEFAULT_SIGMOID_SCALE = 0.5
DEFAULT_SOFTMAX_WEIGHTAGE = 0.9
DEFAULT_SOFTMAX_K = 4.0
DEFAULT_DECAY_RATE = 0.1
RANK_AGG_PERIOD_DAYS = 30      # require_aggregation / weighted-average input window of rank scoring
RANK_SNAPSHOT_LOOKBACK_DAYS = 365

# --- fixed values: status plane ----------------------------------------------------------------
CATEGORY_PREFIXES = ["sustxn", "auth", "hardware", "work", "bio", "document"]
TRUE_WORDS = ["true", "1", "yes"]          # parse_bool
STATUS_SUCCESS, STATUS_FAILED, STATUS_SKIPPED = "success", "failed", "skipped"
EXCLUDED_CADENCES = ["hourly"]
ERROR_MAX_CHARS = 2000        # error text keeps the first 2000 characters
TRACEBACK_MAX_CHARS = 4000    # traceback keeps the last 4000 characters

# --- fixed values: entity master ---------------------------------------------------------------
MISSING_SENTINELS = ["None", "Unknown"]     # organisation-type fields treated as missing
FEATURE_ID_VERSION_SEP = "_v"               # feature_id = feature_name || '_v' || version
ENTITY_LAT_RANGE = (-90.0, 90.0)
ENTITY_LON_RANGE = (-180.0, 180.0)
DMS_PATTERN = r"^(\d+)[°\s]+(\d+)['\s]+([\d.]+)[\"\s]*([NSEWnsew])"

# --- fixed values: cumulative features -----------------------------------------------------------
CATEGORY_INPUT_DAY_OFFSET = {"work": 0, "bio": -1}   # day of the daily input relative to D; others read D-1
