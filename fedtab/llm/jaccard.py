"""Exact n-gram Jaccard join by set-relation skipping.

A document is the set of its distinct word n-grams. Two sets link when
``100 * intersection >= percent * union``. What is returned is every document's
component, so pairs within one component need not be compared; no link between
different components is lost. Skipping keeps the join exact without listing all
pairs of a posting list:

* Sets. A set with more than ``(1 - t) n`` n-grams that no other set has cannot
  link. Counting a slice of the n-grams (those with small hashes) shows that for
  most sets, and only the others go on. A second slice is counted among those.
* Prefixes. Under one order of all n-grams, rare ones first, two linked sets
  share an n-gram in their first ``n - ceil(t n) + 1``. Rarity is read from a count
  sketch of fixed size; any order gives the same links.
* Index level. A list is cut into bands of set size (only a band and the next can
  link) and blocks sorted by size; a block whose sizes and positions leave too
  little overlap is skipped whole.
* Answer level. In each list the sets are first compared with a pivot, which
  costs as many pairs as the list has sets; a set that links to the pivot takes over
  its component. A round with several other pivots follows where a list still
  holds several components. A pair that is left is compared only if the overlaps with the
  first pivot do not rule it out, ``|x & y| <= min(ox, oy) + min(nx - ox, ny - oy)``,
  nor, in a long list, the histograms of the two sets' hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fedtab.llm.common import WORD, connected_components, pieces
from fedtab.session import materialize, release

#: Buckets of the count sketch, a fixed size whatever the corpus (16 MB), and of one of its blocks.
SKETCH, BLOCK = 1 << 22, 1 << 14
_SHIFT = np.uint64(64 - 22)
#: Rows of a list that are compared with each other in one piece; larger lists are dealt out in pairs of blocks.
LIST_ROWS, SKIP_ROWS = 2000, 64
#: Parts of the histogram of a set's hashes; the sum of two sets' smaller counts bounds their intersection.
PARTS = 512
#: Pivots of a list in each round, before the pairs that are left are listed.
PIVOTS = (1, 8)
#: Bits of the map of keys that says which rows need not be moved to a join, a fixed size whatever the corpus (4 MB).
BITS, MAP_ROW = 1 << 25, 1 << 15

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word n-grams (A-Z lower-cased).

    A text of fewer than n words has its whole word sequence as the only one; a
    text without words, or null, has none.
    """
    from xxhash import xxh3_64_intdigest
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < n:
        return np.array([xxh3_64_intdigest(b" ".join(words), 1 + len(words))], np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    size = len(h) - n + 1
    x = h[:size] * _A
    for i in range(1, n):
        x ^= x >> np.uint64(31)
        x = x * _B + h[i:i + size] * _C
    x ^= x >> np.uint64(29)
    x *= _A
    x ^= x >> np.uint64(32)
    return np.unique(x)


def _rows(column: pa.Array) -> Iterator:
    """Values of a column, a few rows at a time as Python objects."""
    for i in range(0, len(column), 128):
        yield from column.slice(i, 128).to_pylist()


def _name(s: np.ndarray) -> int:
    """A set's 64-bit name; with its size it tells sets apart."""
    from xxhash import xxh3_64_intdigest
    return xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def _describe(rows: DataFrame, n: int) -> DataFrame:
    """``(key, hash, n, name)``: a hash of each document's text, its set's size and name."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, names = [], []
            for t in _rows(batch.column(2)):
                s = shingle_set(t, n)
                sizes.append(len(s))
                names.append(_name(s))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), pa.array(names, pa.int64())],
                ["key", "hash", "n", "name"])
    return (rows.select("key", F.xxhash64("text").alias("hash"), "text")
            .mapInArrow(run, "key long, hash long, n int, name long"))


def _slice(sets: Iterator[Iterator[np.ndarray]], low: float, high: float) -> Iterator[pa.RecordBatch]:
    """``(token, name)`` of the n-grams whose hash lies in a slice; a set that comes again in a task is left out."""
    first, last = np.uint64(int(low * (1 << 64))), np.uint64(min((1 << 64) - 1, int(high * (1 << 64))))
    seen: set[int] = set()
    for batch in sets:
        tokens, names = [], []
        for s in batch:
            name = _name(s)
            if name in seen:
                continue
            seen.add(name)
            part = s[np.searchsorted(s, first):np.searchsorted(s, last)]
            tokens.append(part.view(np.int64))
            names.append(np.full(len(part), name, np.int64))
        if tokens:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(np.concatenate(names))], ["token", "name"])


def _tokens_of_texts(rows: DataFrame, n: int, low: float, high: float) -> DataFrame:
    return rows.select("text").mapInArrow(
        lambda batches: _slice(((shingle_set(t, n) for t in _rows(b.column(0))) for b in pieces(batches)), low, high),
        "token long, name long")


def _tokens_of_sets(sets: DataFrame, low: float, high: float) -> DataFrame:
    return sets.select("set").mapInArrow(
        lambda batches: _slice(((np.frombuffer(x, np.uint64) for x in _rows(b.column(0))) for b in pieces(batches)), low, high),
        "token long, name long")


def _among(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """The rows whose integer ``column`` is in the only column of ``wanted``; few of the others are moved to the join.

    A map of hash bits leaves out most of the rows that are not wanted, a join the rest.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(BITS))
    wanted = materialize(wanted.distinct().toDF("_wanted"), "wanted")
    at = wanted.select((place("_wanted") / MAP_ROW).cast("int").alias("row"), (place("_wanted") % MAP_ROW).alias("bit"))
    found = np.zeros(BITS // 8, np.uint8)
    for r in at.repartition("row").groupBy("row").agg(F.bitmap_construct_agg("bit").alias("bits")).collect():  # BITS / MAP_ROW rows at most
        found[r["row"] * MAP_ROW // 8:(r["row"] + 1) * MAP_ROW // 8] = np.frombuffer(r["bits"], np.uint8)
    bits = rows.sparkSession.sparkContext.broadcast(found)

    @F.pandas_udf("boolean")
    def known(x: pd.Series) -> pd.Series:
        k = x.to_numpy(np.int64)
        return pd.Series((bits.value[k >> 3] >> (k & 7)) & 1 == 1)
    return rows.where(known(place(column))).join(wanted.hint("merge"), rows[column] == wanted["_wanted"], "left_semi")


def _may_link(classes: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """``classes`` without the sets that have too many n-grams of their own to link with any other."""
    alone = (tokens.groupBy("token").agg(F.min("name").alias("name"), F.max("name").alias("other")).where("name = other")
             .groupBy("name").agg(F.count(F.lit(1)).alias("alone")))
    return (classes.join(alone, "name", "left")
            .where(100 * F.coalesce("alone", F.lit(0)) <= (100 - percent) * F.col("n")).drop("alone"))


def _sets(texts: DataFrame, n: int) -> DataFrame:
    """``(name, n, set)`` of texts; equal sets of a task come once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in pieces(batches):
            sets = {_name(s): s for s in (shingle_set(t, n) for t in _rows(batch.column(0))) if len(s)}
            new = [k for k in sets if k not in seen]
            seen.update(new)
            yield pa.RecordBatch.from_arrays(
                [pa.array(new, pa.int64()), pa.array([len(sets[k]) for k in new], pa.int32()),
                 pa.array([sets[k].tobytes() for k in new], pa.binary())], ["name", "n", "set"])
    return texts.select("text").mapInArrow(run, "name long, n int, set binary")


def _packed(counts: np.ndarray) -> bytes:
    """A block's counts, or the places and counts of those that are not 0 if that is shorter."""
    at = np.flatnonzero(counts)
    return counts.tobytes() if 3 * len(at) >= BLOCK else at.astype(np.uint16).tobytes() + counts[at].tobytes()


def _add(total: np.ndarray, packed: bytes) -> None:
    if len(packed) == BLOCK:
        total += np.frombuffer(packed, np.uint8)
    else:
        k = len(packed) // 3
        total[np.frombuffer(packed, np.uint16, k)] += np.frombuffer(packed, np.uint8, k, 2 * k)


def _sketch(sets: DataFrame) -> np.ndarray:
    """Counts of all sets' n-grams in an array of fixed size: summed in each task, then by block."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, any_row = np.zeros(SKETCH, np.uint32), False
        for batch in batches:
            for x in _rows(batch.column(0)):
                any_row = True
                np.add.at(counts, (np.frombuffer(x, np.uint64) >> _SHIFT).astype(np.int64), 1)
        if any_row:
            one = np.minimum(counts, 255).astype(np.uint8)  # common is common; the order stays one order
            blocks = [_packed(x) for x in np.split(one, SKETCH // BLOCK)]
            kept = [i for i, x in enumerate(blocks) if x]
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int32()), pa.array([blocks[i] for i in kept], pa.binary())],
                                             ["block", "counts"])

    def add(block: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(BLOCK, np.uint64)
        for x in block["counts"]:
            _add(total, x)
        total = np.minimum(total, np.iinfo(np.uint32).max).astype(np.uint32)
        return pd.DataFrame({"block": block["block"][:1], "counts": [total.tobytes()]})
    summed = (sets.select("set").mapInArrow(count, "block int, counts binary")
              .groupBy("block").applyInPandas(add, "block int, counts binary"))
    out = np.zeros(SKETCH, np.uint32)
    for r in summed.collect():  # SKETCH / BLOCK rows
        out[r["block"] * BLOCK:(r["block"] + 1) * BLOCK] = np.frombuffer(r["counts"], np.uint32)
    return out


def _histograms(sets: DataFrame) -> DataFrame:
    """``(name, hist)``: counts of a set's hashes by their low bits; null if a count does not fit a byte."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in _rows(batch.column(1)):
                h = np.bincount((np.frombuffer(x, np.uint64) & np.uint64(PARTS - 1)).astype(np.int64), minlength=PARTS)
                out.append(h.astype(np.uint8).tobytes() if h.max() < 256 else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["name", "hist"])
    return sets.select("name", "set").mapInArrow(run, "name long, hist binary").distinct()


def _prefixes(sets: DataFrame, percent: int, sketch) -> DataFrame:
    """``(token, name, n, pos)`` of every set's prefix."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        for batch in pieces(batches):
            tokens, names, size, pos = [], [], [], []
            for name, x in zip(_rows(batch.column(0)), _rows(batch.column(1)), strict=True):
                s = np.frombuffer(x, np.uint64)
                keep = len(s) - (percent * len(s) + 99) // 100 + 1
                # equal counts stay in the order of the hashes, so the order is the same everywhere
                first = s[np.argsort(counts[(s >> _SHIFT).astype(np.int64)], kind="stable")[:keep]]
                tokens.append(first.view(np.int64))
                names.append(np.full(keep, name, np.int64))
                size.append(np.full(keep, len(s), np.int32))
                pos.append(np.arange(keep, dtype=np.int32))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (tokens, names, size, pos)],
                                                 ["token", "name", "n", "pos"])
    return sets.select("name", "set").mapInArrow(run, "token long, name long, n int, pos int")


def _compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``(a, b, overlap, na, nb)`` of pairs ``(a, b)``; only the sets of the pairs are moved."""
    sets = _among(sets, "name", pairs.select("a").union(pairs.select("b")))
    both = (pairs.join(sets.select(F.col("name").alias("b"), F.col("set").alias("sb")), "b")
            .join(sets.select(F.col("name").alias("a"), F.col("set").alias("sa")), "a")
            .select("a", "b", "sa", "sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common, na, nb = [], [], []
            for x, y in zip(_rows(batch.column(2)), _rows(batch.column(3)), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                joined = np.concatenate((x, y))
                joined.sort(kind="stable")  # two sorted runs: one merge
                common.append(int((joined[1:] == joined[:-1]).sum()))
                na.append(len(x))
                nb.append(len(y))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(v, pa.int64()) for v in (common, na, nb))],
                ["a", "b", "overlap", "na", "nb"])
    return both.mapInArrow(run, "a long, b long, overlap long, na long, nb long").distinct()


def _least_overlap(na, nb, percent: int):
    """Least intersection of two linked sets of these sizes."""
    return F.ceil(F.lit(percent) * (na + nb) / F.lit(100 + percent) - F.lit(1e-9)) if not isinstance(na, np.ndarray) \
        else np.ceil(percent * (na + nb) / (100 + percent) - 1e-9)


def _pairs_left(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs of one list that lie in two components and that no bound rules out.

    Many lists share a task; each comes whole and sorted by size, a list of few
    rows is compared along its diagonals together with all others, a longer one
    block by block.
    """
    group, columns = ["token", "band", "p", "q"], ["n", "pos", "overlap", "comp", "name", "own", "side", "hist"]

    def close(hist: np.ndarray, known: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs the histograms do not rule out."""
        good = np.ones(len(i), bool)
        for at in range(0, len(i), 4096):
            x, y = i[at:at + 4096], j[at:at + 4096]
            most = np.minimum(hist[x], hist[y]).sum(1, dtype=np.int64)
            good[at:at + 4096] = (most >= _least_overlap(n[x], n[y], percent)) | ~known[x] | ~known[y]
        return good

    def keep(r: dict, i, j) -> np.ndarray:
        """Which pairs of rows (i, j) are left to compare; row i has no more n-grams than row j."""
        nx, ny = r["n"][i], r["n"][j]
        need = _least_overlap(nx, ny, percent)
        good = (np.minimum(nx - r["pos"][i], ny - r["pos"][j]) >= need) & (100 * nx >= percent * ny)
        good &= (r["comp"][i] != r["comp"][j]) & (r["own"][i] | r["own"][j])
        good &= ~r["cross"][i] | (r["side"][i] != r["side"][j])
        ox, oy = r["overlap"][i], r["overlap"][j]
        return good & ((ox < 0) | (oy < 0) | (np.minimum(ox, oy) + np.minimum(nx - ox, ny - oy) >= need))

    def pairs(rows: pd.DataFrame) -> pd.DataFrame:
        r = {c: rows[c].to_numpy() for c in columns}
        r["n"], r["pos"], r["overlap"] = (r[c].astype(np.int64) for c in ("n", "pos", "overlap"))
        r["cross"] = rows["p"].to_numpy() != rows["q"].to_numpy()
        keys = rows[group].to_numpy()
        edge = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)])
        end = np.repeat(np.r_[edge[1:], len(rows)], np.diff(np.r_[edge, len(rows)]))
        long = end - np.repeat(edge, np.diff(np.r_[edge, len(rows)])) > SKIP_ROWS
        a, b = [], []
        short = np.flatnonzero(~long)
        for d in range(1, SKIP_ROWS):
            short = short[short + d < end[short]]
            if not len(short):
                break
            good = keep(r, short, short + d)
            a.append(short[good])
            b.append(short[good] + d)
        left = r["n"] - r["pos"]
        for start in edge[long[edge]]:
            stop = end[start]
            given = rows["hist"].iloc[start:stop]
            known = given.notna().to_numpy()
            hist = np.zeros((stop - start, PARTS), np.uint8)
            for k in np.flatnonzero(known):
                hist[k] = np.frombuffer(given.iloc[k], np.uint8)
            for p in range(start, stop, SKIP_ROWS):
                ps = np.arange(p, min(p + SKIP_ROWS, stop))
                for q in range(p, stop, SKIP_ROWS):
                    qs = np.arange(q, min(q + SKIP_ROWS, stop))
                    if 100 * r["n"][ps[-1]] < percent * r["n"][q]:
                        break  # this block and all after it are too large for the first
                    if min(left[ps].max(), left[qs].max()) < percent * (r["n"][p] + r["n"][q]) / (100 + percent) - 1e-9:
                        continue
                    i, j = np.nonzero(keep(r, ps[:, None], qs[None, :]))
                    i, j = ps[i], qs[j]
                    i, j = i[i < j], j[i < j]
                    good = close(hist, known, r["n"][start:stop], i - start, j - start)
                    a.append(i[good])
                    b.append(j[good])
        x, y = (r["name"][np.concatenate(v)] if v else r["name"][:0] for v in (a, b))
        return pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)}).drop_duplicates()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            last = (rows[group].to_numpy() == rows[group].iloc[-1].to_numpy()).all(1)
            rest = rows[last]
            if not last.all():
                yield pairs(rows[~last].reset_index(drop=True))
        if rest is not None:
            yield pairs(rest.reset_index(drop=True))
    dealt = lists.repartition(*group).sortWithinPartitions(*group, "n", "pos").select(*group, *columns)
    return dealt.mapInPandas(run, "a long, b long").distinct()


def jaccard_components(docs: DataFrame, n: int = 3, percent: int = 90, key: str = "doc_id",
                       text: str = "text") -> DataFrame:
    """``(key, text_hash, n_shingles, component_id)`` for every row; the id is the least key reachable by links.

    Keys are integers; rows are told apart by their texts, so equal keys do no
    harm. A text without words, or null, has no shingles and links with nothing
    (its id is its own key); a null key has a null id and links with nothing. An
    empty table gives an empty one. Texts of any length are used whole.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    info = materialize(_describe(rows, n), "shingle-sizes")

    # Equal sets are one; the row with the least key speaks for all of them.
    classes = materialize(info.where("key is not null and n > 0").groupBy("name", "n")
                          .agg(F.min("key").alias("rep")), "classes")
    keyed = rows.where("key is not null")
    share = min(1.0, 1.6 * (100 - percent) / 100)  # enough of a slice to tell, with room for chance
    alive = materialize(_may_link(classes, _tokens_of_texts(keyed, n, 0.0, share), percent), "alive")
    whole = materialize(_sets(_among(keyed, "key", alive.select("rep")), n), "sets")
    own = whole.select("name", "n").distinct()
    still = _may_link(own, _tokens_of_sets(whole, 1.0 - share, 1.0), percent)
    sets = materialize(_among(whole, "name", still.select("name")), "sets-alive")
    release(alive, whole)
    sketch = spark.sparkContext.broadcast(_sketch(sets))

    postings = materialize(_prefixes(sets, percent, sketch).distinct(), "postings")
    shared = postings.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("token")
    # Sizes of linked sets differ by a factor of at most 100 / percent: a band and the next.
    band = F.floor(F.log("n") / F.log(F.lit(100.0 / percent + 0.01))).cast("int")
    both = F.array(F.struct(band.alias("band"), F.lit(True).alias("own")), F.struct((band - 1).alias("band"), F.lit(False).alias("own")))
    lists = (postings.join(shared, "token", "left_semi").withColumn("b", F.explode(both))
             .select("token", "b.band", "name", "n", "pos", "b.own"))
    written = lists = materialize(lists, "lists")
    release(postings)

    def fits(nx, px, ny, py):
        return ((F.least(nx - px, ny - py) >= _least_overlap(nx, ny, percent))
                & (100 * F.least(nx, ny) >= percent * F.greatest(nx, ny)))

    linked = (100 * F.col("overlap") >= percent * (F.col("na") + F.col("nb") - F.col("overlap")))
    done = first = links = parts = None
    for turn, many in enumerate(PIVOTS):
        # Lists that hold two components still, and pivots for each: in the first round the least name, then by hashes.
        members = lists.withColumn("comp", F.col("name")) if parts is None else (
            lists.join(parts, lists["name"] == parts["node"], "left")
            .select(*lists.columns, F.coalesce("component_id", "name").alias("comp")))
        members = materialize(members, "members")
        by = [F.xxhash64("name", F.lit(i)) if turn else F.col("name") for i in range(many)]
        chosen = F.array(*(F.min(F.when(F.col("own"), F.struct(x.alias("by"), "name", "n", "pos", "comp"))) for x in by)).alias("pivots")
        pivots = (members.groupBy("token", "band").agg(chosen, F.min("comp").alias("lo"), F.max("comp").alias("hi"))
                  .where("lo <> hi and pivots[0] is not null").select("token", "band", "pivots"))
        pivots = materialize(pivots, "pivots")
        if turn == 0:
            anchors = pivots.select("token", "band", F.col("pivots")[0]["name"].alias("pivot"))
        near = F.filter("pivots", lambda p: (F.col("comp") != p["comp"]) & fits(F.col("n"), F.col("pos"), p["n"], p["pos"]))
        listed = materialize(members.join(pivots, ["token", "band"])
                             .select(*lists.columns, near["name"].alias("with")), "listed")
        release(written, members, *([pivots] if turn else []))
        written, lists = listed, listed.select(*lists.columns)  # the other lists are done
        star = (listed.select("name", F.explode("with").alias("other"))
                .select(F.least("name", "other").alias("a"), F.greatest("name", "other").alias("b")).distinct())
        star = materialize(star if done is None else star.join(done.select("a", "b"), ["a", "b"], "left_anti"), "star")
        none = star.isEmpty()
        if none and turn:
            break
        found = materialize(_compare(star, sets), "compared")
        done = found if done is None else done.union(found)
        first = found if first is None else first
        links = done.where(linked).select("a", "b")
        parts = materialize(connected_components(links), "parts")
        if none:  # no set fits its list's pivot: the lists themselves are still to be compared
            break

    members = lists.join(parts, lists["name"] == parts["node"], "left").select(
        *lists.columns, F.coalesce("component_id", "name").alias("comp"))
    members = materialize(members, "members")
    release(written)
    mixed = (members.groupBy("token", "band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
             .where("lo <> hi").select("token", "band"))
    with_pivot = first.select("a", "b", "overlap").union(first.select("b", "a", "overlap"))
    left = (members.join(mixed, ["token", "band"], "left_semi").join(anchors, ["token", "band"])
            .join(with_pivot.toDF("pivot", "name", "o"), ["pivot", "name"], "left")
            .withColumn("overlap", F.when(F.col("pivot") == F.col("name"), F.col("n")).otherwise(F.coalesce("o", F.lit(-1))))
            .join(parts.toDF("pivot", "pivot_comp"), "pivot", "left")
            .withColumn("near", F.col("comp") == F.coalesce("pivot_comp", "pivot")))
    left = materialize(left.select(*lists.columns, "comp", "overlap", "near"), "left")
    release(members)
    links = links.union(_links_left(left, sets, done, percent).where(linked).select("a", "b"))
    return _components_of(info, classes, links, key)


def _links_left(left: DataFrame, sets: DataFrame, done: DataFrame, percent: int) -> DataFrame:
    """Compare what the pivots have left: pairs of one list in two components that no bound rules out."""
    # A set near the pivot can only link with one that has nearly as much in common with the pivot.
    far = (left.where("not near").groupBy("token", "band")
           .agg(F.max(F.when(F.col("overlap") >= 0, F.col("overlap")).otherwise(F.col("n"))).alias("most")))
    bounded = (left.join(far, ["token", "band"])
            .where((~F.col("near")) | (F.col("overlap") < 0)
                   | (100 * F.col("most") >= 100 * F.col("overlap") - (100 - percent) * F.col("n")))
            .drop("most"))
    bounded = materialize(bounded, "left-bounded")
    release(left)
    left = bounded
    sizes = left.groupBy("token", "band").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    blocks = (F.col("c") / F.lit(LIST_ROWS)).cast("int") + 1
    mine = F.pmod(F.xxhash64("name"), F.col("k")).cast("int")
    dealt = (left.join(sizes, ["token", "band"]).withColumn("k", blocks).withColumn("side", mine)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
             .withColumn("p", F.least("side", "other")).withColumn("q", F.greatest("side", "other")))
    dealt = materialize(dealt, "dealt")
    release(left)
    hists = materialize(_histograms(_among(sets, "name", dealt.where(F.col("c") > SKIP_ROWS).select("name"))), "histograms")
    dealt = (dealt.withColumn("long_name", F.when(F.col("c") > SKIP_ROWS, F.col("name")))
             .join(hists.withColumnRenamed("name", "long_name"), "long_name", "left"))
    more = materialize(_pairs_left(dealt, percent).join(done.select("a", "b"), ["a", "b"], "left_anti"), "more")
    return materialize(_compare(more, sets), "compared")


def _components_of(info: DataFrame, classes: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """Every row with the least key of its set's component."""
    parts = connected_components(links)
    named = classes.join(parts, classes["name"] == parts["node"], "left").select(
        "name", "n", "rep", F.coalesce("component_id", "name").alias("part"))
    named = materialize(named, "named")
    least = named.join(named.groupBy("part").agg(F.min("rep").alias("component_id")), "part").select("name", "n", "component_id")
    out = info.join(materialize(least, "components"), ["name", "n"], "left")
    return out.select(F.col("key").alias(key), F.col("hash").alias("text_hash"), F.col("n").cast("long").alias("n_shingles"),
                      F.when(F.col("key").isNotNull(), F.coalesce("component_id", "key")).alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 3, percent: int = 90, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay when one document of each component is kept, with their own columns.

    The one with the least key stays; of rows of equal key and text, one. A row whose key is null takes part under a
    number that its text gives it, above all keys below 2^62, so a copy with a key stays rather than one without.
    Texts without words link with nothing; such rows whose key is null, too, all stay.
    """
    mark = "_one"
    while any(c.startswith(mark) for c in docs.columns):
        mark += "_"
    own, digest, rows_of, turn = (f"{mark}_{x}" for x in ("key", "text", "rows", "turn"))
    stand_in = F.xxhash64(text).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    rows = docs.withColumn(own, F.coalesce(F.col(key).cast("long"), F.when(F.col(text).rlike(WORD), stand_in)))
    parts = jaccard_components(rows.select(own, F.col(text).alias("text")), n, percent, own, "text")
    kept = (parts.where(F.col(own) == F.col("component_id")).groupBy(F.col(own).alias(f"{mark}_k"), F.col("text_hash").alias(f"{mark}_h"))
            .agg(F.count(F.lit(1)).alias(rows_of)))
    kept = materialize(kept, "kept")
    rows = rows.withColumn(digest, F.xxhash64(text))
    found = rows.join(kept, (F.col(own) == F.col(f"{mark}_k")) & (F.col(digest) == F.col(f"{mark}_h")), "left")
    # The join leaves equal rows together, so numbering them moves nothing.
    first = F.row_number().over(Window.partitionBy(own, digest).orderBy(rows_of)) == 1
    return (found.where(F.col(own).isNull() | F.col(rows_of).isNotNull()).withColumn(turn, first)
            .where(F.col(own).isNull() | F.col(turn)).select(*docs.columns))
