"""Local training of low-rank factors (#46): all clients at once, each step one aggregation.

A row's features ``x`` pass a layer with a low-rank update and a head: h = x + B (A x),
logits = H h. A client's state is one row ``(keys…, rank, a, b, h)``: ``a`` holds the
rows of A, ``b`` the columns of B, ``h`` the rows of the head, so a client of lower
rank has shorter ``a`` and ``b``. The gradients of all three follow from the chain rule
within a row; their weighted sums over a client's rows are element-wise sums of vectors
in the JVM, combined before the shuffle. Rows never leave their tasks.

An epoch goes through a client's rows in a given order in micro-batches; ``accumulate``
micro-batches make one step, and what is left over is a smaller last step, or none with
``drop_tail``. Heads and factors of one client are a few thousand numbers; AQE sends
them to the rows, or splits the rows of a hot client.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fedtab.functions.hashing import seeded_digest
from fedtab.functions.params import transmits
from fedtab.operators.state import with_total
from fedtab.session import materialize

#: Names by which the transmit rule (#9) decides what a method trains.
PARAMS = {"a": "lora_A.default.weight", "b": "lora_B.default.weight", "h": "score.weight"}
ACCUMULATE = 4
BATCHES = 10


def table_value(seed: int, name: str, k: Column, j: Column, scale: float) -> Column:
    """An entry in (-scale, scale) that depends on the seed, the table's name and the place alone."""
    part = F.conv(F.substring(seeded_digest(seed, F.lit(name), k, j), 1, 8), 16, 10).cast("double")
    return (part / F.lit(float(1 << 31)) - 1.0) * F.lit(scale)


def first_state(clients: DataFrame, classes: int, dim: int, seed: int = 42, scale: float = 0.1) -> DataFrame:
    """``(…, rank, a, b, h)`` of every row of ``clients`` (with its ``rank``): A and the head from tables that all share, B = 0."""
    def rows(name: str, n: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.transform(
            F.sequence(F.lit(0), F.lit(dim - 1)), lambda j: table_value(seed, name, k, j, scale)))
    return (clients.withColumn("a", rows("A", F.col("rank"))).withColumn("h", rows("H", F.lit(classes)))
            .withColumn("b", F.transform("a", lambda r: F.transform(r, lambda _: F.lit(0.0)))))


def cropped(state: DataFrame, global_: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Clients ``(…, rank)`` with the global factors cut to their rank: where a round starts."""
    g = global_.select(*keys, "a", "b", "h")
    joined = state.drop("a", "b", "h").join(g, list(keys)) if keys else state.drop("a", "b", "h").withColumn(
        "_g", g.select(F.struct("a", "b", "h").alias("g")).scalar()).select("*", "_g.a", "_g.b", "_g.h").drop("_g")
    return joined.withColumn("a", F.slice("a", 1, F.col("rank"))).withColumn("b", F.slice("b", 1, F.col("rank")))


def in_batches(rows: DataFrame, batches: int | None = BATCHES, batch_rows: int | None = None, accumulate: int = ACCUMULATE,
               client_col: str = "client_id", pos_col: str = "pos") -> DataFrame:
    """Rows with their step: ``step``, ``whole`` (its micro-batches are all there) and ``share`` (1 / rows of the micro-batch).

    Micro-batches follow ``pos``: ``batch_rows`` rows each, or ``batches`` of nearly equal size a client (a client with
    fewer rows has one a row).
    """
    counted = with_total(rows, F.count(F.lit(1)), "_n", [client_col])
    fixed = F.expr(f"{pos_col} div {batch_rows}") if batch_rows else F.expr(f"{pos_col} * least({batches}, _n) div _n")
    placed = counted.withColumn("_mb", fixed.cast("long"))
    sizes = placed.groupBy(client_col, "_mb").agg(F.count(F.lit(1)).alias("_rows"))
    last = F.expr(f"(_n - 1) div {batch_rows}") if batch_rows else F.expr(f"least({batches}, _n) - 1")
    step = F.expr(f"_mb div {accumulate}")
    whole = (step + 1) * accumulate - 1 <= last
    return placed.join(sizes, [client_col, "_mb"]).select(
        *rows.columns, step.cast("int").alias("step"), whole.alias("whole"), (F.lit(1.0) / F.col("_rows")).alias("share"))


def _dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def _added(x: Column, rows: Column, by: Column) -> Column:
    """x + the sum of the rows, each times its factor."""
    return F.aggregate(F.arrays_zip(rows.alias("row"), by.alias("by")), x, lambda s, r: F.zip_with(s, r["row"], lambda u, v: u + v * r["by"]))


def _outer(x: Column, y: Column) -> Column:
    return F.flatten(F.transform(x, lambda a: F.transform(y, lambda b: a * b)))


def forward(rows: DataFrame) -> DataFrame:
    """Rows that carry their client's state -> cross-entropy ``loss`` and the flat gradient ``grad`` of (a, b, h)."""
    z = rows.withColumn("_u", F.transform("a", lambda r: _dot(r, F.col("x"))))
    z = z.withColumn("_h", _added(F.col("x"), F.col("b"), F.col("_u")))
    z = z.withColumn("_z", F.transform("h", lambda r: _dot(r, F.col("_h"))))
    z = z.withColumn("_m", F.array_max("_z")).withColumn("_e", F.transform("_z", lambda v: F.exp(v - F.col("_m"))))
    z = z.withColumn("_t", F.aggregate("_e", F.lit(0.0), lambda s, v: s + v))
    z = z.withColumn("_off", F.transform("_e", lambda v, c: v / F.col("_t") - F.when(c == F.col("y"), 1.0).otherwise(0.0)))
    z = z.withColumn("_q", _added(F.transform("x", lambda _: F.lit(0.0)), F.col("h"), F.col("_off")))
    z = z.withColumn("_s", F.transform("b", lambda r: _dot(r, F.col("_q"))))
    grad = F.concat(_outer(F.col("_s"), F.col("x")), _outer(F.col("_u"), F.col("_q")), _outer(F.col("_off"), F.col("_h")))
    loss = F.col("_m") + F.log("_t") - F.get("_z", F.col("y"))
    return z.withColumn("grad", grad).withColumn("loss", loss).drop("_u", "_h", "_z", "_m", "_e", "_t", "_off", "_q", "_s")


def _moved(name: str, offset: Column, dim: Column, rate: float, mu: float, accumulate: int) -> Column:
    """A tensor's rows after a step, each value pulled to where the round started (``_a``, ``_b`` or ``_h``)."""
    pull = F.col("_batches") * F.lit(mu / accumulate)
    return F.transform(name, lambda row, k: F.transform(
        row, lambda v, j: v - F.lit(rate) * (F.get("_g", (offset + k * dim + j).cast("int"))
                                             + pull * (v - F.get(F.get(f"_{name}", k), j)))))


def fit_factors(rows: DataFrame, start: DataFrame, steps: int, keys: Sequence[str] = ("client_id",), method: str | Column = "method",
                round_: str | Column = "round", rate: float = 0.5, mu: float = 0.01, accumulate: int = ACCUMULATE,
                drop_tail: bool = False) -> DataFrame:
    """#46: ``(keys…, rank, a, b, h, n_rows, n_steps, mean_loss, n_nan)`` after one epoch of every client.

    ``rows`` = (client_id, y, x, step, whole, share) from ``in_batches``; ``start`` = (keys…, rank, a, b, h, method, round),
    the global state that a round starts from and that the proximal term pulls to. Only what ``method`` sends in
    ``round`` is trained (#9); the other factor stays frozen. The gradient is that of the mean loss of a micro-batch,
    divided by ``accumulate``. ``mean_loss`` is the mean over micro-batches of loss and penalty before each step;
    ``n_nan`` counts rows whose loss is not a number. States are written after each step, so a lost executor
    repeats one step. A client without rows keeps its state.
    """
    keys = list(keys)
    on = [k for k in keys if k in rows.columns]
    train = {n: transmits(F.lit(p), method, round_) for n, p in PARAMS.items()}
    zero = F.lit(0.0)
    state = start.select(*keys, "rank", "a", "b", "h", *[F.col(n).alias(f"_{n}") for n in PARAMS],
                         *[t.alias(f"_t{n}") for n, t in train.items()], F.lit(0).cast("long").alias("n_rows"),
                         F.lit(0).alias("n_steps"), zero.alias("_loss"), zero.alias("_seen"), F.lit(0).cast("long").alias("n_nan"))
    state = materialize(state, "factors")
    for step in range(steps):
        now = rows.where(F.col("step") == step).join(state.select(*keys, "a", "b", "h"), on)
        summed = (forward(now).withColumn("_v", array_to_vector("grad")).groupBy(*keys)
                  .agg(Summarizer.metrics("sum").summary(F.col("_v"), F.col("share")).alias("_g"),
                       F.sum(F.col("loss") * F.col("share")).alias("_l"), F.sum("share").alias("_batches"),
                       F.count(F.lit(1)).alias("_n"), F.sum(F.isnan("loss").cast("int")).alias("_bad"),
                       F.max("whole").alias("_whole"))
                  .withColumn("_g", F.transform(vector_to_array(F.col("_g.sum")), lambda v: v / F.lit(float(accumulate))))
                  .withColumn("_batches", F.round("_batches")))
        j = state.join(summed, keys, "left")
        far = sum((F.when(F.col(f"_t{n}"), F.aggregate(F.flatten(F.zip_with(n, f"_{n}", lambda r, s: F.zip_with(
            r, s, lambda v, w: (v - w) * (v - w)))), zero, lambda s, v: s + v)).otherwise(zero) for n in PARAMS), zero)
        goes = F.col("_n").isNotNull() & (F.col("_whole") if drop_tail else F.lit(True))
        dim, rank = F.size(F.get("h", F.lit(0))), F.col("rank")
        offsets = {"a": F.lit(0), "b": rank * dim, "h": rank * dim * 2}
        new = {n: F.when(goes & F.col(f"_t{n}"), _moved(n, offsets[n], dim, rate, mu, accumulate)).otherwise(F.col(n)) for n in PARAMS}
        seen = F.coalesce("_batches", zero)
        state = materialize(j.select(
            *keys, "rank", *[v.alias(n) for n, v in new.items()], *[f"_{n}" for n in PARAMS], *[f"_t{n}" for n in PARAMS],
            (F.col("n_rows") + F.coalesce("_n", F.lit(0))).alias("n_rows"), (F.col("n_steps") + goes.cast("int")).alias("n_steps"),
            (F.col("_loss") + F.coalesce("_l", zero) + seen * F.lit(mu / 2) * far).alias("_loss"), (F.col("_seen") + seen).alias("_seen"),
            (F.col("n_nan") + F.coalesce("_bad", F.lit(0))).alias("n_nan")), "factors")
    return state.select(*keys, "rank", "a", "b", "h", "n_rows", "n_steps",
                        (F.col("_loss") / F.nullif(F.col("_seen"), zero)).alias("mean_loss"), "n_nan")


def factor_cells(state: DataFrame, keys: Sequence[str] = ("client_id",), layer: str = "layers.0.") -> DataFrame:
    """The trained tensors as cells ``(keys…, param, i, j, v)``, ready for averaging (#24)."""
    parts = []
    for n, suffix in PARAMS.items():
        flat = state.select(*keys, F.posexplode(n).alias("k", "row")).select(*keys, "k", F.posexplode("row").alias("l", "v"))
        i, j = ("l", "k") if n == "b" else ("k", "l")
        parts.append(flat.select(*keys, F.lit(layer + suffix).alias("param"), F.col(i).alias("i"), F.col(j).alias("j"), "v"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
