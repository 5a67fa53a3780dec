"""Cases that arrive as files while the engine runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracelake.functions.jsons import kind, parsed, text_at
from tracelake.operators import rules, shred
from tracelake.runtime import cut


def case_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Case records of .jsonl files as they arrive: origin, file_ord, case_ord, raw, v, kind. Blank lines are left out."""
    lines = spark.readStream.option("pathGlobFilter", "*.jsonl").text(folder).where("trim(value) <> ''")
    rows = lines.select(F.col("_metadata.file_path").alias("origin"), F.lit(0).alias("file_ord"), F.xxhash64("value").alias("case_ord"), F.col("value").alias("raw"), parsed("value").alias("v"))
    return rows.withColumn("kind", F.when(F.col("v").isNull(), "broken").otherwise(kind(F.col("v"))))


def write_tables(stream: DataFrame, folder: str, checkpoint: str, once: bool = True, on_errors: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Shred each micro-batch into the tables below folder, a subfolder per batch, so a batch done again replaces itself.

    Records that are no JSON or no object, break a rule, or have the case_id of an earlier
    record, of this batch or another, leave no rows: what is wrong with them goes to
    on_errors as (object_id, path, message, row), where row tells the record by its file.
    once: stop when all files there are done.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        row = F.concat_ws("#", "origin", F.monotonically_increasing_id().cast("string")).alias("row")
        # written, so that a record keeps its number however often it is read
        batch = cut(batch.select(row, "origin", "file_ord", "case_ord", "raw", "kind"), f"stream-{number}").withColumn("v", parsed("raw"))
        objects = batch.where("kind = 'object'")
        unread = batch.where("kind <> 'object'").select(F.lit("<unknown>").alias("object_id"), F.lit("").alias("path"), F.when(F.col("kind") == "broken", "no JSON").otherwise("no object").alias("message"), "row")
        errors = rules.case_errors(objects, "row").unionByName(unread)
        known = earlier(spark, number)
        if known is not None:
            ids = objects.select("row", F.trim(text_at(F.col("v"), "$.case_id")).alias("case_id")).join(known, "case_id", "left_semi")
            errors = errors.unionByName(ids.select(F.col("case_id").alias("object_id"), F.lit("case_id").alias("path"), F.lit("case_id was used before, in an earlier batch").alias("message"), "row"))
        errors = cut(errors, f"stream-errors-{number}")
        if on_errors is not None:
            on_errors(errors)
        cases = shred.case_rows(objects.join(errors.select("row").distinct(), "row", "left_anti"))
        for name, df in shred.history_tables(cases).items():
            df.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")

    def earlier(spark: SparkSession, number: int) -> DataFrame | None:
        """The case ids of the batches before this one."""
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/cases")
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return None
        return spark.read.schema("case_id string, batch long").option("basePath", f"{folder}/cases").parquet(f"{folder}/cases").where(F.col("batch") < number).select("case_id").distinct()

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
