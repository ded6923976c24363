"""Round lines of a growing run log, as a Structured Streaming query (#48).

Stateless: each line is parsed on its own (the record pattern of #3); the log
file (run) comes from the source's partition folder, not from earlier lines.
The file sink with its checkpoint makes the output exactly-once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fedtab.session import shared_dir
from fedtab.sources.runlog import is_round_line, round_fields


def parse_round_stream(lines: DataFrame) -> DataFrame:
    line = F.col("line")
    return lines.filter(is_round_line(line)).select("run_id", "line_no", *round_fields(line))


def stream_log_rounds(spark: SparkSession, lines: DataFrame, files_per_trigger: int = 16) -> DataFrame:
    """Land ``lines`` (run_id, line_no, line) as files, stream them through the
    parser with ``availableNow``, and return the sink as a batch DataFrame."""
    base = shared_dir(spark, "log_stream")
    src, sink, ckpt = f"{base}/source", f"{base}/sink", f"{base}/checkpoint"
    lines.write.partitionBy("run_id").parquet(src)
    schema = spark.read.parquet(src).schema
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
              .option("basePath", src).parquet(src))
    q = (parse_round_stream(stream).writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start(sink))
    q.awaitTermination()
    return spark.read.schema(parse_round_stream(stream).schema).parquet(sink)


def stream_text_rounds(spark: SparkSession, path: str, sink: str, checkpoint: str, files_per_trigger: int = 16) -> None:
    """Round records of the text logs under ``path/run_id=.../`` that have come since the checkpoint.

    A text stream has no line numbers; records carry their run and file instead.
    """
    lines = (spark.readStream.schema("value string, run_id int").option("maxFilesPerTrigger", files_per_trigger).text(path)
             .select("run_id", F.col("value").alias("line"), F.col("_metadata.file_name").alias("file")))
    line = F.col("line")
    q = (lines.filter(is_round_line(line)).select("run_id", "file", *round_fields(line))
         .writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start(sink))
    q.awaitTermination()
