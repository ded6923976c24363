"""Run-log parsing (#3): text lines -> typed round records.

Context lines set the alpha (``Starting Alpha: x``) and the method
(``--- Method: m ---``); the method is reset by every alpha line. Round lines
count only when they start with ``Round `` and match the record pattern, so
``nan`` values drop the line (trap T16). Context is carried forward per log
file with a bucketed scan, so a single huge log is not one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fedtab.operators.positions import carry_forward, range_positions

# The log's line formats.
ALPHA_MARK = "Starting Alpha: "
METHOD_MARK = "--- Method: "
ROUND_PREFIX = "Round "
ROUND_PATTERN = (r"Round (\d+) - Acc: ([\d.]+), F1: ([\d.]+), Loss: ([\d.]+), "
                 r"Comm: ([\d.]+)MB, Bias: ([\d.]+)")
CLOSE_PATTERN = r"^Round (\d+) - "
DROPOUT_PATTERN = r"\[DROPOUT\] Client (\d+) failed to upload updates"
ROUND_FIELDS = ("round", "acc", "f1", "loss", "comm_mb", "bias")


def round_fields(line: F.Column) -> list[F.Column]:
    """The six typed captures of a round line (stateless; shared by batch and stream).

    A capture that is no number (``1.2.3``) is null, never an error."""
    cols = []
    for k, name in enumerate(ROUND_FIELDS, start=1):
        raw = F.regexp_extract(line, ROUND_PATTERN, k)
        cols.append(raw.try_cast("int" if name == "round" else "double").alias(name))
    return cols


def is_round_line(line: F.Column) -> F.Column:
    """A round line all of whose captures are numbers."""
    ok = line.startswith(ROUND_PREFIX) & line.rlike(ROUND_PATTERN)
    for c in round_fields(line):
        ok = ok & c.isNotNull()
    return ok


def marked(lines: DataFrame, strip_method_tail: bool = True) -> DataFrame:
    """``lines`` (run_id, line_no, line) with what each line says by itself; the one parser of batch and stream."""
    line = F.col("line")
    is_alpha = line.contains(ALPHA_MARK)
    is_method = line.contains(METHOD_MARK) & ~is_alpha
    method = F.trim(F.regexp_extract(line, "--- Method: (.*)", 1))
    if strip_method_tail:
        method = F.trim(F.regexp_replace(method, "---$", ""))
    return lines.select(
        "run_id", "line_no", is_alpha.alias("is_alpha"), is_method.alias("is_method"),
        F.when(is_alpha, F.trim(F.regexp_extract(line, "Starting Alpha: (.*)", 1))).alias("alpha_evt"),
        F.when(is_alpha, F.lit("")).when(is_method, method).alias("method_evt"),
        is_round_line(line).alias("is_round"), *round_fields(line))


def read_log_text(spark: SparkSession, path: str) -> DataFrame:
    """``(run_id, line_no, line)`` of text logs under ``path/run_id=.../``, lines numbered from 1.

    A log is one file, or several in order of their names; large files are split and
    read in parallel. The order of lines is (file, start of the split, row in the split);
    positions in sorted pieces turn it into line numbers without one task per log.
    """
    raw = spark.read.text(path).select(
        "run_id", F.col("value").alias("line"), F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_row"))
    numbered = range_positions(raw, ["run_id"], [F.col("_file"), F.col("_start"), F.col("_row")])
    return numbered.select("run_id", (F.col("pos") + 1).alias("line_no"), "line")


def write_log_text(lines: DataFrame, path: str) -> None:
    """Write ``(run_id, line_no, line)`` as text logs, one folder per run, files in line order."""
    (lines.repartitionByRange("run_id", "line_no").sortWithinPartitions("run_id", "line_no")
     .select("run_id", F.col("line").alias("value")).write.partitionBy("run_id").text(path))


def parse_run_log(lines: DataFrame, strip_method_tail: bool = True, width: int = 1 << 20,
                  last_block_only: bool = False) -> DataFrame:
    """``lines`` = (run_id, line_no, line) -> (run_id, alpha_block, alpha, method, line_no, round, ...).

    Every block is kept, numbered by ``alpha_block`` (trap T20). ``last_block_only``
    gives the reference's overwrite semantics instead: per log and alpha value only
    the last alpha block counts (a later block with the same alpha drops the earlier
    block's methods entirely), and within it only the last block of each method.
    """
    lines = marked(lines, strip_method_tail)
    is_alpha, is_method = F.col("is_alpha"), F.col("is_method")
    ctx = carry_forward(
        lines, ["run_id"], "line_no",
        values={"alpha_txt": F.col("alpha_evt"), "method_ctx": F.col("method_evt")},
        counters={"alpha_block": is_alpha, "method_block": is_method},
        width=width,
    )
    rounds = ctx.filter(F.col("is_round") & (F.col("alpha_block") > 0)
                        & F.col("method_ctx").isNotNull() & (F.col("method_ctx") != ""))
    if last_block_only:
        # block tables: one row per (log, alpha value) and per (log, alpha block, method)
        last_alpha = (ctx.filter(is_alpha).groupBy("run_id", "alpha_txt")
                      .agg(F.max("alpha_block").alias("_last_alpha")))
        last_method = (ctx.filter(is_method).groupBy("run_id", "alpha_block", "method_ctx")
                       .agg(F.max("method_block").alias("_last_method")))
        rounds = (rounds.join(last_alpha, ["run_id", "alpha_txt"])
                  .filter(F.col("alpha_block") == F.col("_last_alpha"))
                  .join(last_method, ["run_id", "alpha_block", "method_ctx"])
                  .filter(F.col("method_block") == F.col("_last_method")))
    return rounds.select("run_id", "alpha_block", "alpha_txt", F.col("alpha_txt").try_cast("double").alias("alpha"),
                         F.col("method_ctx").alias("method"), "line_no", *ROUND_FIELDS)


def dropout_marks(lines: DataFrame) -> DataFrame:
    """Of ``(run_id, line_no, line)`` the lines that close a round or drop a client: ``(run_id, line_no, round, client_id)``.

    One of ``round`` and ``client_id`` is null. A round line closes its round even where its numbers are no record.
    """
    line = F.col("line")
    number = lambda p: F.nullif(F.regexp_extract(line, p, 1), F.lit("")).try_cast("int")
    closes = number(CLOSE_PATTERN)
    return (lines.select("run_id", "line_no", closes.alias("round"), F.when(closes.isNull(), number(DROPOUT_PATTERN)).alias("client_id"))
            .where("round is not null or client_id is not null"))


def dropped_clients(lines: DataFrame, width: int = 1 << 20) -> DataFrame:
    """Clients that dropped out of every round: ``(run_id, line_no, round, n_dropped, dropped)``.

    A dropout line stands before the line that closes its round, so it belongs to the next round line of its log: the
    one that ends its segment. Segments are numbered by a running count of round lines, taken in pieces of ``width``
    lines with a carry from the pieces before; then one aggregation brings a segment's lines together. A round that
    nobody dropped out of has 0; dropouts after a log's last round line belong to no round and are left out. A client
    counts once a round. ``line_no`` is the round line's, as in ``parse_run_log``.
    """
    marks = carry_forward(dropout_marks(lines), ["run_id"], "line_no", values={},
                          counters={"closed": F.col("round").isNotNull()}, width=width)
    segment = F.col("closed") - F.when(F.col("round").isNotNull(), 1).otherwise(0)
    found = marks.groupBy("run_id", segment.alias("_segment")).agg(
        F.max(F.when(F.col("round").isNotNull(), F.col("line_no"))).alias("line_no"), F.max("round").alias("round"),
        F.array_sort(F.collect_set("client_id")).alias("_who"))
    return found.where("round is not null").select("run_id", "line_no", "round", F.size("_who").cast("long").alias("n_dropped"),
                                                   F.array_join("_who", ",").alias("dropped"))


def unmatched_round_lines(lines: DataFrame) -> DataFrame:
    """Count of ``Round `` lines that give no record, per log (T16): the pattern or a number fails."""
    line = F.col("line")
    return (lines.filter(line.startswith(ROUND_PREFIX) & ~is_round_line(line))
            .groupBy("run_id").agg(F.count(F.lit(1)).alias("n_unmatched")))
