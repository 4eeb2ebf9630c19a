"""Fixed values shared by the operators (formats, limits, defaults, word lists)."""

# --- fixed values: analysis defaults --------------------------------------
DEFAULT_MIN_CONFIDENCE = 0.1
DEFAULT_CLIP_CONFIDENCE = 0.0
DEFAULT_OVERLAP_S = 0.0
DEFAULT_TOP_K = 5
DEFAULT_BATCH_SIZE = 8
MIN_BATCH_SIZE, MAX_BATCH_SIZE = 1, 512
CONFIDENCE_RANGE = (0.0, 1.0)
LATITUDE_RANGE = (-90.0, 90.0)
LONGITUDE_RANGE = (-180.0, 180.0)
DAY_OF_YEAR_RANGE = (1, 366)
CONFIDENCE_DECIMALS = 4
TIME_DECIMALS = 1

# --- fixed values: location and season --------------------------------------
WEEKS_PER_YEAR = 48
DAYS_PER_WEEK = 7.6
DAYS_IN_MONTH = [31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]
DEFAULT_RANGE_THRESHOLD = 0.01
DEFAULT_SPECIES_LIST_THRESHOLD = 0.03
UNMATCHED_POLICIES = ["keep", "drop"]
RANGE_FILTER_MODEL_TYPES = ["birdnet-v24", "birdnet-v30", "perch-v2"]
CALIBRATED_MODEL_TYPE = "bsg-finland"

# --- fixed values: clips ------------------------------------------------------
DEFAULT_PADDING_S = 5.0
MAX_PADDING_S = 300.0
REJECTED_SAMPLES_KEPT = 10

# --- fixed values: ultrasonic mode -----------------------------------------------
BAT_SAMPLE_RATE = 256_000
BAT_SEGMENT_SAMPLES = 144_000
BAT_OVERLAP_SAMPLES = 36_000

# --- fixed values: files ------------------------------------------------------------
AUDIO_EXTENSIONS = ["wav", "flac", "mp3", "m4a", "aac"]
OUTPUT_SUFFIXES = {
    "csv": ".BirdNET.results.csv",
    "raven": ".BirdNET.selection.table.txt",
    "audacity": ".BirdNET.results.txt",
    "kaleidoscope": ".BirdNET.results.kaleidoscope.csv",
    "json": ".BirdNET.json",
    "parquet": ".BirdNET.results.parquet",
}
RESULT_STEM_SUFFIXES = [".BirdNET.results", ".BirdNET"]
COMBINED_NAMES = {
    "csv": "BirdNET_CombinedTable.csv",
    "raven": "BirdNET_SelectionTable.txt",
    "kaleidoscope": "BirdNET_Kaleidoscope.csv",
    "parquet": "BirdNET_CombinedTable.parquet",
}
METADATA_COLUMNS = [
    "lat",
    "lon",
    "week",
    "model",
    "overlap",
    "sensitivity",
    "min_conf",
    "species_list",
]

# --- fixed values: tabular exports ---------------------------------------------------
CSV_HEADER = ["Start (s)", "End (s)", "Scientific name", "Common name", "Confidence", "File"]
RAVEN_HEADER = [
    "Selection",
    "View",
    "Channel",
    "Begin Time (s)",
    "End Time (s)",
    "Low Freq (Hz)",
    "High Freq (Hz)",
    "Common Name",
    "Species Code",
    "Confidence",
    "Begin Path",
    "File Offset (s)",
]
RAVEN_VIEW, RAVEN_CHANNEL = "Spectrogram 1", 1
RAVEN_LOW_HZ, RAVEN_HIGH_HZ = 150, 15000
KALEIDOSCOPE_HEADER = [
    "INDIR",
    "FOLDER",
    "IN FILE",
    "OFFSET",
    "DURATION",
    "TOP1MATCH",
    "TOP1DIST",
]

# --- fixed values: event log -------------------------------------------------------------
SPEC_VERSION = "1.1"
EVENT_KINDS = [
    "pipeline_started",
    "file_started",
    "progress",
    "file_completed",
    "pipeline_completed",
    "result",
    "error",
    "cancelled",
    "detections",
]
PROGRESS_STEP_PERCENT = 10
PROGRESS_INTERVAL_MS = 500
