"""Uploaded pages: which are accepted, under which names, and why the others aren't."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quern.functions import text

#: Fixed: the largest page.
MAX_BYTES = 15 * 1024 * 1024


def rejection(n_bytes: Column, accepted_type: Column, most: int = MAX_BYTES) -> Column:
    """Why a page is turned down: its size first, then its type; null if it isn't."""
    large = F.concat(F.lit("too large ("), text.megabytes(n_bytes), F.lit(f" MB of {most / 1048576:.0f} MB)"))
    return F.when(n_bytes > most, large).when(F.coalesce(n_bytes, F.lit(0)) == 0, "empty").when(~F.coalesce(accepted_type, F.lit(False)), "type")


def judged(files: DataFrame, job: str, order: list[str | Column], most: int = MAX_BYTES, numbered_before: DataFrame | None = None) -> DataFrame:
    """files (job, n_bytes, content_type; or name where content_type is null) with error, page and page_name.

    Accepted pages are numbered in order behind those a job has already (numbered_before: job, pages) and named page_N with
    the extension of their type; the original name is never used. Files of a local folder have no type: their suffix counts.
    """
    typed = F.col("content_type").isNotNull()
    extension = F.when(typed, text.type_extension(F.col("content_type"))).otherwise(text.suffix_extension(F.col("name")))
    rows = files.withColumn("error", rejection(F.col("n_bytes"), extension.isNotNull(), most))
    good = F.col("error").isNull()
    at = F.row_number().over(Window.partitionBy(job, good).orderBy(*order))
    if numbered_before is None:
        rows = rows.withColumn("_before", F.lit(0))
    else:
        rows = rows.join(numbered_before.select(job, F.col("pages").alias("_before")), job, "left").fillna(0, ["_before"])
    rows = rows.withColumn("page", F.when(good, at + F.col("_before")).cast("int")).drop("_before")
    return rows.withColumn("page_name", F.when(good, F.concat(F.lit("page_"), F.col("page").cast("string"), extension)))
