"""A landing folder as a stream: new page photos become runs, and the jobs that they belong to are worked out again.

Photos lie at folder/job_id/name. Each micro-batch writes under its own number, replacing what an earlier try of the same batch
wrote, and a job is always worked out from all its photos; so the same files give the same jobs in one batch or in many, and a
batch that is repeated changes nothing. A photo is decoded once, in the batch that brings it; later batches read its runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quern.operators import raster
from quern.operators.flow import Result

#: Fixed: the schema of Spark's image source.
IMAGE = "image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
#: Tables of results, by the attribute of Result.
TABLES = ("jobs", "validations", "pages", "events")


def photos(spark: SparkSession, folder: str, per_batch: int | None = None) -> DataFrame:
    """job_id, image (job_id/name), height, width, channels, data of a landing folder as a stream; per_batch: files a micro-batch."""
    read = spark.readStream.format("image").schema(IMAGE)
    read = read.option("maxFilesPerTrigger", per_batch) if per_batch else read
    rows = read.load(f"{folder}/*/*")
    place = [F.regexp_extract("image.origin", r"([^/]+)/([^/]+)$", i) for i in (1, 2)]
    return rows.select(place[0].alias("job_id"), F.concat_ws("/", *place).alias("image"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")


def _replaced(rows: DataFrame, path: str, batch: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def _upto(spark: SparkSession, path: str, schema: T.StructType, batch: int) -> DataFrame:
    """Rows of all batches up to this one; later ones may be there when a batch is repeated."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(path).filter(F.col("batch") <= batch).drop("batch")


class Landing:
    """work(images, runs) gives a Result of whole jobs (flow.plain_jobs or flow.template_jobs with their other tables filled in).

    images: job_id, image, width, height; runs: image, y, x0, x1. Tables are written under store.
    """

    def __init__(self, store: str, work: Callable[[DataFrame, DataFrame], Result]):
        self.store, self.work = store, work

    def take(self, batch: DataFrame, number: int) -> None:
        """One micro-batch of photos. A file that can't be decoded is an image without ink and of size 0."""
        spark = batch.sparkSession
        named = batch.select("job_id", "image", F.greatest("width", F.lit(0)).alias("width"), F.greatest("height", F.lit(0)).alias("height"))
        ink = raster.image_runs(batch.select("image", "height", "width", "channels", "data"))
        for rows, name in ((named, "images"), (ink, "runs")):
            _replaced(rows, f"{self.store}/{name}", number)
        own = spark.read.schema(named.schema).parquet(f"{self.store}/images/batch={number}")
        touched = own.select("job_id").distinct()
        images = _upto(spark, f"{self.store}/images", named.schema, number).join(touched, "job_id", "left_semi")
        runs = _upto(spark, f"{self.store}/runs", ink.schema, number).join(images.select("image"), "image", "left_semi")
        done = self.work(images, runs)
        for name in TABLES:
            _replaced(getattr(done, name), f"{self.store}/{name}", number)

    def start(self, photos: DataFrame, checkpoint: str) -> StreamingQuery:
        """Takes all that is there, in micro-batches, and stops."""
        return photos.writeStream.foreachBatch(self.take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        """The present rows of one of TABLES: each job's from the newest batch that touched it. Nothing taken yet: no rows, no columns."""
        try:
            rows = spark.read.parquet(f"{self.store}/{name}")
        except AnalysisException:
            return spark.createDataFrame([], T.StructType([]))
        newest = spark.read.parquet(f"{self.store}/jobs").groupBy("job_id").agg(F.max("batch").alias("batch"))
        return rows.join(newest, ["job_id", "batch"], "left_semi").drop("batch")
