"""Pictures as they arrive: the first stage as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import filters
from ..plans import stages
from ..sources import files


def daily_stream(observations: DataFrame, keys: list[str], value: str = "value", ts: str = "ts", late: str = "2 days") -> DataFrame:
    """Daily means and counts of a stream of observations; days close when the watermark has passed."""
    day = F.window(F.col(ts), "1 day")
    return observations.withWatermark(ts, late).groupBy(*keys, day).agg(F.avg(value).alias("avg"), F.count(value).alias("n")).select(*keys, F.to_date("window.start").alias("date"), "avg", "n")


def extract_stream(spark: SparkSession, root: str, rings: DataFrame, out: str, checkpoint: str, files_per_batch: int = 1000):
    """Appends the ratios of new pictures to a Parquet table; a batch that is run again writes its own folder anew.

    A batch has at most ``files_per_batch`` files, whose paths come to the driver. Shapes are those of the batch's
    pictures, from the first bytes of some of them, so each picture is decoded once.
    """
    found = spark.readStream.format("binaryFile").option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch).schema("path string, modificationTime timestamp, length long, content binary").load(root)

    def one(batch: DataFrame, number: int) -> None:
        paths = [r.path for r in batch.where(X.is_picture(F.col("path"))).select("path").collect()]
        if not paths:
            return
        raw = batch.sparkSession.read.format("image").option("dropInvalid", True).load(paths)
        parts = F.split(F.col("image.origin"), "/")
        keys = [F.element_at(parts, -i).alias(k) for k, i in zip(stages.SITE_YEAR, (6, 5, 4), strict=True)]
        pictures = raw.select(*keys, F.col("image.origin").alias("path"), X.picture_time(F.col("image.origin")).alias("ts"), "image.height", "image.width", "image.data")
        parts = F.split(F.col("path"), "/")
        listed = batch.sparkSession.createDataFrame([(p,) for p in paths], "path string").select(*[F.element_at(parts, -i).alias(k) for k, i in zip(stages.SITE_YEAR, (6, 5, 4), strict=True)], "path")
        shapes = filters.modal_shape(files.with_shapes(filters.strided(listed, stages.SITE_YEAR)), stages.SITE_YEAR, sample=None)
        stages.extract(pictures.where(F.col("ts").isNotNull()), rings, shapes).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return found.select("path").writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
