"""Page photos, templates and job records as DataFrames.

Undecodable images stay as rows of height -1 unless dropped, so that a page fails and not its job. Missing folders give
empty tables where a record may not exist yet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed shapes of the records.
ELEMENT = "struct<character:string,id:string,category:string,unicode:string,x:double,y:double,width:double,height:double>"
MARKER = "struct<marker_id:int,corner:string,x:double,y:double,size:double>"
TEMPLATE = f"template_version string, template_id string, page_size struct<width:double,height:double,unit:string>, character_count int, pages array<struct<page:int,elements:array<{ELEMENT}>,markers:array<{MARKER}>>>"
VALIDATION = "character string, character_id string, valid boolean, confidence double, warnings array<string>"
STATUS = "job_id string, state string, template_id string, pages_uploaded int, valid_glyph_count int, invalid_glyph_count int, error string, created_at double, updated_at double"


def photos(spark: SparkSession, path: str, pattern: str = "*", drop_invalid: bool = False) -> DataFrame:
    """image (file name without its extension), height, width, channels, data; sorted reading is left to the caller."""
    read = spark.read.format("image").option("pathGlobFilter", pattern).option("dropInvalid", drop_invalid).load(path)
    name = F.regexp_extract("image.origin", r"([^/]+?)(?:\.[A-Za-z0-9]+)?$", 1)
    return read.select(name.alias("image"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")


def stored_crops(spark: SparkSession, path: str) -> DataFrame:
    """job_id, name, height, width, channels, data of the PNGs in the folders of jobs (path/job_id/name); ones that can't be read are left out."""
    read = spark.read.format("image").option("pathGlobFilter", "*.png").option("dropInvalid", True).load(f"{path}/*")
    place = [F.regexp_extract("image.origin", r"([^/]+)/([^/]+)$", i).alias(n) for i, n in ((1, "job_id"), (2, "name"))]
    return read.select(*place, "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")


def uploads(spark: SparkSession, path: str, pattern: str = "page_*") -> DataFrame:
    """name, n_bytes, content, modified of files in a landing folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("n_bytes"), "content", F.col("modificationTime").alias("modified"))


def write_records(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines in a folder that records() reads; what was there is replaced."""
    rows.write.mode("overwrite").json(path)


def settings(given: dict[str, str | None], defaults: dict[str, object]) -> dict[str, object]:
    """defaults, replaced by what is given, in the type of the default; a list is given as comma-separated text."""

    def read(name: str, value: object) -> object:
        own = given.get(name)
        if own is None:
            return value
        if isinstance(value, list):
            return [p.strip() for p in own.split(",") if p.strip()]
        return own.strip().lower() in ("1", "true", "yes", "on") if isinstance(value, bool) else type(value)(own)

    return {name: read(name, value) for name, value in defaults.items()}


def templates(spark: SparkSession, path: str) -> DataFrame:
    """Template documents; a file that isn't one is skipped."""
    schema = T.StructType.fromDDL(TEMPLATE).add("_bad", "string")
    read = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return read.filter("_bad is null and template_id is not null and pages is not null").drop("_bad")


def template_elements(documents: DataFrame) -> DataFrame:
    """template_id, page and the element columns, one row per box."""
    return documents.select("template_id", F.inline("pages")).select("template_id", "page", F.inline("elements"))


def template_markers(documents: DataFrame) -> DataFrame:
    return documents.select("template_id", F.inline("pages")).select("template_id", "page", F.inline("markers"))


def records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON records (VALIDATION, STATUS), one array or object a file or one object a line; no such path: no rows."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)
