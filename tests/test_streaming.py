"""Streaming: restart from the checkpoint after a stop equals one uninterrupted run and the batch form."""

import duckdb
from pyspark.sql import functions as F

from fedtab.operators import blocks, state
from fedtab.plans import fixtures as fx
from fedtab.plans.oracle_sql import oracle_queries
from fedtab.session import materialize, shared_dir
from fedtab.sources.runlog import dropped_clients
from fedtab.streaming import round_stream as rs
from fedtab.streaming.log_context_stream import stream_dropped_clients

SF = "/root/testdata/sf0.001"


def test_round_average_survives_restart(spark):
    up = fx.v_uploads(spark, SF)
    base = shared_dir(spark, "restart-test")
    src, sink, ckpt = f"{base}/source", f"{base}/sink", f"{base}/checkpoint"
    order = ["arrival_ts", "event_id"]
    middle = up.selectExpr("percentile_approx(arrival_ts, 0.5)").first()[0]
    fx.land_in_order(up.where(up["arrival_ts"] <= middle), order, src)
    schema = spark.read.parquet(src).schema
    rs.run_round_average(spark, src, sink, ckpt, schema)      # first run, then "crash"
    fx.land_in_order(up.where(up["arrival_ts"] > middle), order, src)  # more uploads arrive
    rs.run_round_average(spark, src, sink, ckpt, schema)      # restart from the checkpoint
    got = sorted((r["round_start"], r["n"], r["sum_w"], round(r["sum_wv"], 6)) for r in
                 rs.read_round_average(spark, sink).collect())
    con = duckdb.connect()
    for t in ("events",):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want = sorted((a, b, c, round(d, 6)) for a, b, c, d, _ in con.sql(oracle_queries()["stream_round_average"]).fetchall())
    assert got == want


ORDER = ["arrival_ts", "client_id", "param_id", "k", "t"]


def averaged(spark, base):
    rows = rs.read_state_average(spark, base).collect()
    return sorted((str(r["round_start"]), r["n_clients"], r["param_id"], r["k"], r["t"],
                   tuple(None if x is None else round(x, 9) for x in r["v"])) for r in rows)


def batch_average(uploads):
    """#24 over what arrived in time, round by round."""
    timed = uploads.where("param_id is not null").withColumn("round_start", F.date_trunc("day", "ts"))
    timed = timed.where(F.col("arrival_ts") <= F.col("round_start") + F.expr("interval 25 hours"))
    clients = timed.select("round_start", "client_id", "n_samples").distinct()
    weights = state.group_weight(clients, partition_cols=["round_start"])
    n = {str(r["round_start"]): r["count"] for r in clients.groupBy("round_start").count().collect()}
    avg = blocks.average_blocks(timed.select("round_start", "client_id", *blocks.KEYS, "v"), weights, ["round_start"])
    return sorted((str(r["round_start"]), n[str(r["round_start"])], r["param_id"], r["k"], r["t"],
                   tuple(None if x is None else round(x, 9) for x in r["v"])) for r in avg.collect())


def test_state_average_equals_the_batch_at_two_trigger_sizes_and_after_a_restart(spark):
    uploads = materialize(fx.v_state_uploads(spark, SF)[0], "uploads")
    want = batch_average(uploads)
    late = uploads.where("param_id is not null and arrival_ts > date_trunc('day', ts) + interval 25 hours").count()
    assert want and late > 0
    base = shared_dir(spark, "state-average-test")
    src = fx.land_in_order(uploads, ORDER, f"{base}/source")
    for files in (1, 16):
        rs.run_state_average(spark, src, f"{base}/{files}", files)
        assert averaged(spark, f"{base}/{files}") == want
    cut = uploads.where("param_id is not null").selectExpr("percentile_approx(arrival_ts, 0.4)").first()[0]
    again = f"{base}/again"
    fx.land_in_order(uploads.where(uploads["arrival_ts"] <= cut), ORDER, f"{again}/source")
    rs.run_state_average(spark, f"{again}/source", again, 2)  # stops in the middle of a round
    fx.land_in_order(uploads.where(uploads["arrival_ts"] > cut), ORDER, f"{again}/source")
    rs.run_state_average(spark, f"{again}/source", again, 2)
    assert averaged(spark, again) == want


def test_dropouts_of_an_open_round_wait_in_the_state(spark, tmp_path):
    """A round's dropouts and its line come in different batches; the last ones have no round yet."""
    d, r = "  [DROPOUT] Client {} failed to upload updates.", "Round {} - Acc: {}, F1: 0.1, Loss: {}, Comm: 1.0MB, Bias: 0.1"
    lines = [d.format(3), "Training", d.format(11), d.format(3), r.format(1, 0.5, 0.1), r.format(2, 0.5, 0.1), d.format(4),
             "--- Method: rolora ---", r.format(1, 0.5, "nan"), "Round x", d.format(7)]
    logs = [(run, k + 1, s) for run in (0, 5) for k, s in enumerate(lines)]
    df = spark.createDataFrame(logs, "run_id int, line_no long, line string")
    want = sorted((run, *x) for run in (0, 5) for x in ((5, 1, 2, "3,11"), (6, 2, 0, ""), (9, 1, 1, "4")))
    for width in (1, 2, 3, 1 << 20):
        assert sorted(map(tuple, dropped_clients(df, width).collect())) == want
    base = str(tmp_path / "stream")
    for part in ("line_no <= 2", "line_no = 3", "line_no between 4 and 7", "line_no > 7"):
        fx.land_in_order(df.where(part), ["line_no", "run_id"], f"{base}/source")
        out = stream_dropped_clients(spark, f"{base}/source", base, files_per_trigger=1)  # a restart for each part
    assert sorted(map(tuple, out.collect())) == want
