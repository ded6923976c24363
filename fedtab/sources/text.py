"""Labelled examples (#1) and tokenise-and-pad (#7).

The reference tokenises with a pretrained subword model and cuts texts; here the same
job is a Spark job over the whole corpus: words of any script, a vocabulary of all
words (ids by frequency, then word) and fixed-length chunks that together hold
every word of a text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fedtab.functions.hashing import bernoulli
from fedtab.operators.positions import range_positions
from fedtab.session import materialize

# Fixed values of the tokenised format.
MAX_SEQ_LENGTH = 128
PAD_ID = 0
UNK_ID = 1
FIRST_WORD_ID = 2
WORD_PATTERN = r"\p{L}+"
#: Words of the smallest ids that every task knows; all others are joined by shuffle.
KNOWN_WORDS = (1 << 16) - FIRST_WORD_ID  # their ids fit two bytes
#: Texts that a Python worker holds as arrays at once.
PIECE = 1024


def scan_examples(examples: DataFrame, test_fraction: float = 0.2, seed: int = 42,
                  id_col: str = "example_id") -> DataFrame:
    """#1: examples with a named split; the split is a seeded hash of the id, so a
    filter on it is a pure map-side predicate (and engine-portable)."""
    is_test = bernoulli(seed, test_fraction, id_col)
    return examples.withColumn("split", F.when(is_test, F.lit("test")).otherwise(F.lit("train")))


def words(text_col: str = "text") -> F.Column:
    """Lower-case words of a text; a null text has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(WORD_PATTERN), F.lit(0))


def build_vocabulary(examples: DataFrame, text_col: str = "text") -> DataFrame:
    """(tok, id) of every lower-case word, numbered by falling count, then word.

    Counting is a partial+final aggregation; ids are positions in sorted pieces, so
    no task holds the vocabulary.
    """
    counts = (examples.select(F.explode(words(text_col)).alias("tok")).groupBy("tok").agg(F.count(F.lit(1)).alias("cnt")))
    ranked = range_positions(counts, [], [F.col("cnt").desc(), F.col("tok")])
    return ranked.select("tok", (F.col("pos") + FIRST_WORD_ID).alias("id"))


def tokenize_pad(examples: DataFrame, vocab: DataFrame, max_len: int = MAX_SEQ_LENGTH,
                 id_col: str = "example_id", text_col: str = "text", label_col: str = "label") -> DataFrame:
    """#7: ``(example_id, labels, n_words, chunk_no, input_ids, attention_mask)``.

    Every text becomes consecutive chunks of ``max_len`` ids, the last one padded
    right with PAD_ID; a text without words is one chunk of padding. Words that the
    vocabulary lacks get UNK_ID. The ``KNOWN_WORDS`` words of the smallest ids, the
    frequent ones, get theirs where the text is read; only the other words join the
    vocabulary by shuffle, one row each. Then one shuffle gathers the ids of each chunk:
    a whole chunk's known ids are one row.
    """
    keys = ["example_id", "labels", "n_words", "chunk_no"]
    base = examples.select(F.col(id_col).alias("example_id"), F.col(label_col).alias("labels"), words(text_col).alias("_toks"))
    frequent = vocab.where(F.col("tok").isNotNull() & F.col("id").between(FIRST_WORD_ID, FIRST_WORD_ID + KNOWN_WORDS - 1))
    known = examples.sparkSession.sparkContext.broadcast({r["tok"]: r["id"] for r in frequent.select("tok", "id").collect()})
    schema = T.StructType([*base.schema.fields[:2], T.StructField("n_words", T.LongType()), T.StructField("chunk_no", T.LongType()),
                           T.StructField("ids", T.ArrayType(T.IntegerType())),
                           T.StructField("rest", T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()),
                                                                           T.StructField("tok", T.StringType())])))])
    chunks = materialize(base.mapInArrow(_chunks(known, max_len), schema), "chunks")
    rest = (chunks.select(*keys, F.explode("rest").alias("_r")).select(*keys, "_r.pos", "_r.tok").join(vocab, "tok", "left")
            .select(*keys, F.lit(None).cast("array<int>").alias("ids"),
                    F.struct("pos", F.coalesce("id", F.lit(UNK_ID).cast("long")).alias("id")).alias("_other")))
    both = chunks.select(*keys, "ids", F.lit(None).cast(rest.schema["_other"].dataType).alias("_other")).unionByName(rest)
    # dealt before they are gathered: rows are whole chunks already, there is nothing to combine before the shuffle
    seqs = both.repartition(*keys).groupBy(*keys).agg(F.collect_list("ids").alias("_known"), F.collect_list("_other").alias("_others"))
    one = lambda pos, x: F.struct(pos.cast("int").alias("pos"), x.cast("long").alias("id"))
    two = lambda x, o: F.array(one(o * 2, x.bitwiseAND(0xFFFF)), one(o * 2 + 1, F.shiftrightunsigned(x, 16)))
    at = lambda a: F.filter(F.flatten(F.transform(a, two)), lambda s: s["id"] >= FIRST_WORD_ID)
    merged = F.array_sort(F.concat(F.flatten(F.transform("_known", at)), "_others"))
    out = seqs.withColumn("_ids", F.transform(merged, lambda s: s["id"]))
    ids = F.col("_ids")
    n = F.size(ids)
    return out.select(
        "example_id", "labels", "n_words", "chunk_no",
        F.concat(ids, F.array_repeat(F.lit(PAD_ID).cast("long"), F.lit(max_len) - n)).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(max_len) - n)).alias("attention_mask"))


def _chunks(known, max_len: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts' words as chunks: ids of known words (0 for others) by place, two to a number, the first in its lower half;
    and the other words with their places."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = known.value
        for batch in batches:
            for start in range(0, batch.num_rows, PIECE):
                part = batch.slice(start, PIECE)
                toks = part.column("_toks")
                n = np.diff(toks.offsets.to_numpy()).astype(np.int64)
                flat = toks.flatten()
                found = flat.dictionary_encode()
                own = np.array([ids_of.get(w, 0) for w in found.dictionary.to_pylist()], np.int32)
                ids = own[found.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, np.int32)
                # chunks of a text, in order, so that the places of the chunks follow one another
                many = np.maximum(1, -(-n // max_len))
                text = np.repeat(np.arange(len(n)), many)
                no = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
                ends = np.concatenate([[0], np.cumsum(np.minimum(max_len, n[text] - no * max_len))])
                n_own = np.diff(ends)
                to = np.concatenate([[0], np.cumsum((n_own + 1) // 2)])
                halves = np.zeros(2 * to[-1], "<u2")
                halves[np.arange(len(ids)) + np.repeat(2 * to[:-1] - ends[:-1], n_own)] = ids
                other = ids == 0
                before = np.concatenate([[0], np.cumsum(other)])
                at = np.flatnonzero(other)
                pos = at - np.repeat(ends[:-1], np.diff(before[ends]))
                rest = pa.StructArray.from_arrays([pa.array(pos, pa.int32()), flat.take(pa.array(at))], ["pos", "tok"])
                rows = pa.array(text)
                yield pa.RecordBatch.from_arrays([
                    part.column("example_id").take(rows), part.column("labels").take(rows), pa.array(n[text]), pa.array(no, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(to, pa.int32()), pa.array(halves.view("<i4"), pa.int32())),
                    pa.ListArray.from_arrays(pa.array(before[ends], pa.int32()), rest)],
                    names=["example_id", "labels", "n_words", "chunk_no", "ids", "rest"])
    return run
