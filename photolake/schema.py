"""Tables of the catalog: explicit schemas, the default profile, and Parquet storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

PHOTOS = (
    "photo_id string, capture_time long, name string, filename string, file_id string, rating int, latitude double, longitude double, "
    "import_time long, last_processed_time long, import_start_time long, thumb_written int, big_thumb_written int"
)
FILES = "file_id string, file_path string, camera_make string, camera_model string, sensitivity int, exposure_time string, aperture double, focal_length double, usage_count long"
QUEUE = "qt_index long, sorted_index long, processed boolean, exported boolean, output boolean, photo_id string"
LENS_PREFS = "exif_camera string, exif_lens string, lens string, lens_ca int, lens_vign int, lens_dist int, auto_ca int"

#: The default profile, by column. -1 for a lens switch means "use the preferences".
PROFILE = {
    "developer_concentration": 1.0,
    "reservoir_thickness": 1000.0,
    "layer_thickness": 0.1,
    "crystals_per_pixel": 500.0,
    "crystal_radius": 0.00001,
    "salt_density": 1.0,
    "developer_consumption": 2000000.0,
    "crystal_growth": 0.00001,
    "salt_consumption": 2000000.0,
    "development_time": 100.0,
    "agitate_count": 1,
    "development_steps": 12,
    "film_area": 864.0,
    "sigma_const": 0.2,
    "layer_mix_const": 0.2,
    "layer_time_divisor": 20.0,
    "rolloff_boundary": 51275,
    "exposure_comp": 0.0,
    "whitepoint": 0.002,
    "blackpoint": 0.0,
    "shadows_x": 0.25,
    "shadows_y": 0.25,
    "highlights_x": 0.75,
    "highlights_y": 0.75,
    "highlight_recovery": 0,
    "auto_ca": -1,
    "temperature": 5200.0,
    "tint": 1.0,
    "vibrance": 0.0,
    "saturation": 0.0,
    "monochrome": 0,
    "bw_r": 0.21,
    "bw_g": 0.78,
    "bw_b": 0.07,
    "toe_boundary": 0.0,
    "lens": "NoLens",
    "lens_ca": -1,
    "lens_vign": -1,
    "lens_dist": -1,
    "rotation_angle": 0.0,
    "rotation_point_x": -1.0,
    "rotation_point_y": -1.0,
}
#: Columns of a photo's parameters that a profile doesn't have.
CROP = {"rotation": 0, "crop_height": 0.0, "crop_aspect": 0.0, "crop_x": 0.0, "crop_y": 0.0}
_TYPE = {float: "double", int: "int", str: "string"}
PARAMS = ", ".join(["photo_id string", *[f"{k} {_TYPE[type(v)]}" for k, v in (PROFILE | CROP).items()]])
SCHEMAS = {"photos": PHOTOS, "files": FILES, "queue": QUEUE, "lens_prefs": LENS_PREFS, "params": PARAMS}


def profile(spark: SparkSession) -> DataFrame:
    """The default profile: one row."""
    columns = ", ".join(f"{k} {_TYPE[type(v)]}" for k, v in PROFILE.items())
    return spark.createDataFrame([("Default", *PROFILE.values())], f"profile_id string, {columns}")


def write_catalog(tables: dict[str, DataFrame], path: str) -> None:
    """Writes tables by name as Parquet with the columns of their schema, in its order."""
    for name, df in tables.items():
        want = StructType.fromDDL(SCHEMAS[name])
        df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in want]).write.mode("overwrite").parquet(f"{path}/{name}")


def read_catalog(spark: SparkSession, path: str, names: tuple[str, ...] = tuple(SCHEMAS)) -> dict[str, DataFrame]:
    return {n: spark.read.schema(SCHEMAS[n]).parquet(f"{path}/{n}") for n in names}
