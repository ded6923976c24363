"""Run-log parsing with context, as a stateful Structured Streaming query (#3 on a stream).

Lines are parsed by the batch parser's own column expressions before they reach
the state; the state store keeps per run only what earlier lines have set
(alpha block, alpha, method). Lines of a run arrive in order over many
micro-batches, so a group holds one run's lines of one micro-batch. The output equals
the batch parser's.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fedtab.sources.runlog import ROUND_FIELDS, dropout_marks, marked

CONTEXT_SCHEMA = "run_id int, alpha_block long, alpha_txt string, method string, line_no long, " + ", ".join(
    f"{c} {'int' if c == 'round' else 'double'}" for c in ROUND_FIELDS)
STATE_SCHEMA = "alpha_block long, alpha_txt string, method_ctx string"


def _carry(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Carry the context over one run's new lines and keep those that are records."""
    pdf = pd.concat(list(batches), ignore_index=True).sort_values("line_no", kind="stable")
    block, alpha, method = state.get if state.exists else (0, None, None)
    pdf["alpha_block"] = block + pdf["is_alpha"].astype("int64").cumsum()
    pdf["alpha_txt"] = pdf["alpha_evt"].ffill()
    pdf["alpha_txt"] = pdf["alpha_txt"].where(pdf["alpha_txt"].notna(), alpha)
    pdf["method"] = pdf["method_evt"].ffill()
    pdf["method"] = pdf["method"].where(pdf["method"].notna(), method)
    if len(pdf):
        state.update((int(pdf["alpha_block"].iloc[-1]), pdf["alpha_txt"].iloc[-1], pdf["method"].iloc[-1]))
    keep = pdf["is_round"] & (pdf["alpha_block"] > 0) & pdf["method"].notna() & (pdf["method"] != "")
    out = pdf.loc[keep, ["run_id", "alpha_block", "alpha_txt", "method", "line_no", *ROUND_FIELDS]]
    yield out.astype({"run_id": "int32", "round": "int32"})


def parse_log_stream(lines: DataFrame) -> DataFrame:
    rounds = marked(lines).groupBy("run_id").applyInPandasWithState(
        _carry, CONTEXT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)
    return rounds.withColumn("alpha", F.col("alpha_txt").try_cast("double"))


def run_log_stream(stream: DataFrame, sink: str, checkpoint: str) -> DataFrame:
    """Process every line now in the source (``availableNow``), resuming from ``checkpoint``; the sink as a table."""
    q = (stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start(sink))
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(sink)


def stream_log_with_context(spark: SparkSession, src: str, base: str, files_per_trigger: int = 16) -> DataFrame:
    """Records of the logs under ``src``, whose files hold a run's lines in order of their times; sink and state under ``base``."""
    return run_log_stream(parse_log_stream(_lines(spark, src, files_per_trigger)), f"{base}/sink", f"{base}/checkpoint")


def _lines(spark: SparkSession, src: str, files_per_trigger: int) -> DataFrame:
    return (spark.readStream.schema("run_id int, line_no long, line string").option("maxFilesPerTrigger", files_per_trigger)
            .parquet(src))


DROPPED_SCHEMA = "run_id int, line_no long, round int, n_dropped long, dropped string"


def _gather(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Keep a run's dropouts until the round line that they belong to arrives."""
    pdf = pd.concat(list(batches), ignore_index=True).sort_values("line_no", kind="stable")
    closes = pdf["round"].notna()
    segment = closes.cumsum().shift(fill_value=0)  # a round line is the last of its segment
    open_ = list(state.get[0]) if state.exists else []
    out = []
    for at, part in pdf.groupby(segment, sort=True):
        who = set(part["client_id"].dropna().astype(int)) | (set(open_) if at == 0 else set())
        last = part.iloc[-1]
        if pd.isna(last["round"]):
            open_ = sorted(who)
        else:
            open_ = []
            out.append((int(key[0]), int(last["line_no"]), int(last["round"]), len(who), ",".join(map(str, sorted(who)))))
    state.update((open_,))
    yield pd.DataFrame(out, columns=["run_id", "line_no", "round", "n_dropped", "dropped"]).astype(
        {"run_id": "int32", "line_no": "int64", "round": "int32", "n_dropped": "int64"})


def dropped_clients_stream(lines: DataFrame) -> DataFrame:
    """``runlog.dropped_clients`` on a stream; the state holds a run's dropouts of the round that is still open."""
    return dropout_marks(lines).groupBy("run_id").applyInPandasWithState(
        _gather, DROPPED_SCHEMA, "waiting array<int>", "append", GroupStateTimeout.NoTimeout)


def stream_dropped_clients(spark: SparkSession, src: str, base: str, files_per_trigger: int = 16) -> DataFrame:
    """Dropouts per round of the logs under ``src`` (see ``stream_log_with_context``)."""
    return run_log_stream(dropped_clients_stream(_lines(spark, src, files_per_trigger)), f"{base}/sink", f"{base}/checkpoint")
