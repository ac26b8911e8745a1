"""Fixed values shared by every operator, and their DataFrame form.

The tables below are part of the result definition: changing one changes what
the operators return.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: band contract (name, provider asset, native gsd in m, resampling)
BANDS = [
    ("B02", "blue", 10, "bilinear"),
    ("B03", "green", 10, "bilinear"),
    ("B04", "red", 10, "bilinear"),
    ("B05", "rededge1", 20, "bilinear"),
    ("B06", "rededge2", 20, "bilinear"),
    ("B07", "rededge3", 20, "bilinear"),
    ("B08", "nir", 10, "bilinear"),
    ("B8A", "nir08", 20, "bilinear"),
    ("B11", "swir16", 20, "bilinear"),
    ("B12", "swir22", 20, "bilinear"),
]
MASK_BAND = ("SCL", "scl", 20, "nearest")
BANDS_8 = ["B02", "B03", "B04", "B05", "B08", "B8A", "B11", "B12"]
BANDS_10 = ["B02", "B03", "B04", "B05", "B06", "B07", "B08", "B8A", "B11", "B12"]
BANDS_RGB = ["B04", "B03", "B02"]
VALID_RESAMPLE = ["nearest", "bilinear", "cubic", "average", "mode"]

# --- fixed values: reflectance convention
REFLECTANCE_MODES = ["dn_scale", "offset_applied"]
REFLECTANCE_MODE = "dn_scale"
REFLECTANCE_SCALE = 0.0001
DECLARED_OFFSET = -0.1
MAX_NEGATIVE_FRACTION = 0.02
MAX_PHYSICAL_REFLECTANCE = 1.5
SCL_INVALID = [0, 1, 3, 8, 9, 10, 11]
STORE_SCALE = 10000
STORE_CEILING = 6.5535
CHIP_CEILING = 2.0

# --- fixed values: classes
CLASS_NAMES = ["open_water", "crops_soil", "mixed_halophytes", "phragmites_australis"]
WATER, CROPS, HALOPHYTE, REED = 0, 1, 2, 3
IGNORE = -1
UNLABELLED = 255
MIN_REED_PIXELS = 500
TARGET_IOU, TARGET_F1 = 0.82, 0.85
MIN_BASELINE_IOU = 0.05

# --- fixed values: spectral indices (name, first band, second band)
INDICES = [
    ("ndvi", "B08", "B04"),
    ("ndwi", "B03", "B08"),
    ("ndre", "B08", "B05"),
    ("ndmi", "B08", "B11"),
]
INDEX_EPS = 1e-6

# --- fixed values: study areas (key, name, role, west, south, east, north, crs)
STUDY_AREAS = [
    ("burullus", "Lake Burullus (Ramsar wetland)", "wetland", 30.55, 31.38, 31.15, 31.70, "EPSG:32636"),
    ("manzala", "Lake Manzala (Damietta boundary)", "wetland", 31.80, 31.05, 32.15, 31.35, "EPSG:32636"),
    ("kafr_elsheikh_canal", "Kafr El-Sheikh agricultural canal corridor", "canal",
     30.70, 31.02, 31.00, 31.28, "EPSG:32636"),
]
AREA_ROLES = ["wetland", "canal"]

# --- fixed values: monthly nutrient content, January to December
NUTRIENT_BY_MONTH = [0.05, 0.05, 0.08, 0.15, 0.30, 0.50, 0.75, 1.00, 0.72, 0.45, 0.20, 0.08]
DAYS_IN_MONTH = [31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]
SENESCENCE_RELEASE = 0.60
PEAK_MONTH, PEAK_DAY = 8, 15

# --- fixed values: display ranges and colour anchors per index
INDEX_RANGES = {
    "ndvi": (-0.2, 0.9),
    "ndwi": (-0.6, 0.8),
    "ndre": (-0.4, 0.7),
    "ndmi": (-0.5, 0.7),
}
COLOUR_ANCHORS = {
    "ndvi": [(0.0, (165, 0, 38)), (0.25, (215, 48, 39)), (0.45, (254, 224, 139)),
             (0.65, (166, 217, 106)), (0.85, (0, 104, 55)), (1.0, (0, 60, 30))],
    "ndwi": [(0.0, (139, 69, 19)), (0.25, (240, 240, 220)), (0.5, (146, 197, 222)),
             (0.75, (40, 110, 190)), (1.0, (5, 35, 90))],
    "ndre": [(0.0, (60, 20, 60)), (0.3, (150, 60, 130)), (0.55, (230, 140, 90)),
             (0.8, (250, 220, 120)), (1.0, (255, 255, 220))],
    "ndmi": [(0.0, (140, 90, 50)), (0.35, (225, 210, 170)), (0.6, (120, 190, 180)),
             (0.85, (30, 120, 140)), (1.0, (5, 50, 80))],
}
DEFAULT_ANCHORS = [(0.0, (0, 0, 60)), (0.5, (120, 120, 120)), (1.0, (255, 255, 255))]
LUT_SIZE = 512

# --- fixed values: chip and figure colours per class, review colours, ignored and nodata greys
CLASS_COLOURS = {0: (58, 110, 165), 1: (196, 160, 90), 2: (150, 130, 170), 3: (60, 150, 80)}
FIGURE_COLOURS = {0: (40, 78, 122), 1: (196, 175, 130), 2: (110, 190, 120), 3: (232, 56, 140)}
REVIEW_COLOURS = {0: (70, 70, 70), 1: (230, 120, 40)}
IGNORED_COLOUR = (86, 94, 108)
NODATA_COLOUR = (16, 20, 32)


def class_dim(spark: SparkSession) -> DataFrame:
    """Class codes and names; always four rows, so it may be broadcast."""
    rows = list(enumerate(CLASS_NAMES))
    return spark.createDataFrame(rows, "class_code int, class_name string")


def required_bands(bands=BANDS_8) -> list[str]:
    """Bands a scene must carry to be usable, mask band included."""
    return [*bands, MASK_BAND[0]]


def band_dim(spark: SparkSession, bands=None, mask=MASK_BAND, band_sets=None,
             mode: str = REFLECTANCE_MODE) -> DataFrame:
    """Band contract as a dimension table, rejected if it contradicts itself."""
    bands = BANDS if bands is None else bands
    band_sets = band_sets or {"8": BANDS_8, "10": BANDS_10, "rgb": BANDS_RGB}
    known = {name for name, *_ in bands}
    if not bands:
        raise ValueError("the band contract defines no bands")
    for name, _, _, resample in bands:
        if resample not in VALID_RESAMPLE:
            raise ValueError(f"band {name}: resample {resample!r} is not one of {VALID_RESAMPLE}")
    if mask[3] != "nearest":
        raise ValueError("the mask band holds class codes and must use nearest resampling")
    for key, names in band_sets.items():
        unknown = [n for n in names if n not in known]
        if unknown or not names:
            raise ValueError(f"band set {key!r} is empty or names unknown bands {unknown}")
    if mode not in REFLECTANCE_MODES:
        raise ValueError(f"reflectance mode must be one of {REFLECTANCE_MODES}")
    rows = [(i, n, a, float(g), r, False) for i, (n, a, g, r) in enumerate(bands)]
    rows.append((len(bands), mask[0], mask[1], float(mask[2]), mask[3], True))
    return spark.createDataFrame(
        rows, "position int, band string, asset string, gsd double, resample string, is_mask boolean")


def area_dim(spark: SparkSession, areas=None) -> DataFrame:
    """Study areas as a dimension table; degenerate boxes are refused."""
    areas = STUDY_AREAS if areas is None else areas
    for key, _, role, west, south, east, north, _ in areas:
        if role not in AREA_ROLES:
            raise ValueError(f"area {key}: unknown role {role!r}")
        if west >= east or south >= north:
            raise ValueError(f"area {key}: degenerate bounding box")
    df = spark.createDataFrame(
        [tuple(a) for a in areas],
        "key string, name string, role string, west double, south double, east double, "
        "north double, crs string")
    return df.select("key", "name", "role", "crs",
                     F.struct("west", "south", "east", "north",
                              F.lit("EPSG:4326").alias("crs")).alias("bbox"))


def reflectance_offset(mode: str = REFLECTANCE_MODE) -> float:
    """Offset the configured convention adds after scaling."""
    if mode not in REFLECTANCE_MODES:
        raise ValueError(f"reflectance mode must be one of {REFLECTANCE_MODES}")
    return DECLARED_OFFSET if mode == "offset_applied" else 0.0
