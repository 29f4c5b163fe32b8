"""Document-term counts, id sequences, dense input, folds and mini-batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.functions.draws import hash_uniform
from topicloom.operators.arrow import ragged, to_ragged
from topicloom.operators.tokens import unnest, with_runs
from topicloom.operators.vocabulary import Vocabulary
from topicloom.session import fits_broadcast, in_batches, lookup_join, parallelism, with_row_index


@dataclass(frozen=True)
class BagOfWords:
    """``df(doc_id, ids array<int>, cnts array<double>)`` over ``n_terms`` columns."""

    df: DataFrame
    n_terms: int


@dataclass(frozen=True)
class Sequences:
    """``df(doc_id, term_ids array<int>, n_unseen)`` over ``n_terms`` ids; order matters."""

    df: DataFrame
    n_terms: int


def doc_term_counts(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """(doc_id, term_id, cnt); terms outside the vocabulary are dropped.

    Counts are formed in the row; a vocabulary beyond the broadcast limit goes to blocks of documents.
    """
    return unpack_counts(bag_of_words(docs, vocab))


#: Bytes of a term in a worker's table, and how many tables an executor may hold: its workers', and one on its way.
TERM_BYTES, TABLES = 12, 4
#: Tokens of a block of documents, where the vocabulary is not broadcast.
BLOCK_TOKENS = 2_000_000

#: Packs the term ids of documents (offsets, ids; -1: unseen) into their columns.
Pack = Callable[[np.ndarray, np.ndarray], pa.Array]


def _looked_up(hashes: np.ndarray, ids: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Ids of hashes in a sorted table, -1 for those that it lacks."""
    if not len(hashes):
        return np.full(len(wanted), -1, np.int64)
    once, back = np.unique(wanted, return_inverse=True)
    at = np.minimum(np.searchsorted(hashes, once), len(hashes) - 1)
    return np.where(hashes[at] == once, ids[at], -1).astype(np.int64)[back]


def _hashed(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, keep..., _h): the tokens as 64-bit hashes, no token where a document has none."""
    terms = F.coalesce("terms", F.array().cast("array<string>"))
    return docs.select("doc_id", *keep, F.transform(terms, lambda t: F.xxhash64(t)).alias("_h"))


def _packed(docs: DataFrame, vocab: Vocabulary, pack: Pack, kind: str, keep: Sequence[str] = ()) -> DataFrame | None:
    """(doc_id, keep..., _p): what ``pack`` makes of the documents' term ids; nothing if two terms share a hash.

    Python sees hashes alone.  Within the broadcast limit a worker holds the vocabulary as two sorted arrays;
    of a larger one each block of documents gets the terms that it has.
    """
    spark = docs.sparkSession
    hashed = in_batches(_hashed(docs, keep))
    table = vocab.df.select(F.xxhash64("term").alias("_h"), "term_id")
    if fits_broadcast(spark, float(TERM_BYTES) * TABLES * vocab.n_terms):
        found = table.toArrow()
        hashes, ids = found.column("_h").to_numpy(), found.column("term_id").to_numpy()
        order = np.argsort(hashes)
        hashes, ids = hashes[order], ids[order].astype(np.int32)
        if (hashes[1:] == hashes[:-1]).any():
            return None
        shared = spark.sparkContext.broadcast((hashes, ids))

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            hashes, ids = shared.value
            for column in batches:
                offsets, flat = ragged(column)
                yield pack(offsets, _looked_up(hashes, ids, flat))

        run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
        return hashed.select("doc_id", *keep, F.arrow_udf(run, kind).asNondeterministic()("_h").alias("_p"))
    if table.groupBy("_h").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count():
        return None
    n_tokens = docs.agg(F.sum(F.size("terms").cast("long"))).first()[0] or 0
    blocks = max(parallelism(spark), -(-n_tokens // BLOCK_TOKENS))
    tagged = hashed.withColumn("_block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int"))
    tagged = tagged.repartition("_block")
    wanted = tagged.select("_block", F.explode("_h").alias("_h")).distinct()
    known = wanted.join(table, "_h").select(F.col("_block").alias("_of"), "_h", "term_id")

    def task(block: pa.Table, found: pa.Table) -> pa.Table:
        hashes, ids = found.column("_h").to_numpy(), found.column("term_id").to_numpy()
        order = np.argsort(hashes)
        names = ["doc_id", *keep]
        rows = block.select([*names, "_h"]).combine_chunks()
        if not rows.num_rows:
            return rows.select(names).append_column("_p", pack(np.zeros(1, np.int64), np.zeros(0, np.int64)))
        offsets, flat = ragged(rows.column("_h").combine_chunks())
        return rows.select(names).append_column("_p", pack(offsets, _looked_up(hashes[order], ids[order], flat)))

    schema = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in ("doc_id", *keep)) + f", _p {kind}"
    return tagged.groupBy("_block").cogroup(known.groupBy("_of")).applyInArrow(task, schema)


def _pack_bag(offsets: np.ndarray, ids: np.ndarray) -> pa.Array:
    docs = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    seen = ids >= 0
    width = np.int64(ids.max(initial=0) + 1)
    cells, counts = np.unique(docs[seen] * width + ids[seen], return_counts=True)
    cuts = np.searchsorted(cells, np.arange(len(offsets)) * width)
    return pa.StructArray.from_arrays(
        [to_ragged(cuts, cells % width, pa.int32()), to_ragged(cuts, counts.astype(float), pa.float64())], ["ids", "cnts"]
    )


def _pack_sequence(offsets: np.ndarray, ids: np.ndarray) -> pa.Array:
    seen = ids >= 0
    upto = np.concatenate(([0], np.cumsum(seen)))[offsets]
    unseen = np.diff(offsets) - np.diff(upto)
    return pa.StructArray.from_arrays(
        [to_ragged(upto, ids[seen], pa.int32()), pa.array(unseen, pa.int64())], ["term_ids", "n_unseen"]
    )


def bag_of_words(docs: DataFrame, vocab: Vocabulary) -> BagOfWords:
    """Packed counts; documents without a known term stay, with empty arrays.

    Terms are looked up by hash, or by a join if two of the vocabulary share one.
    """
    rows = _packed(docs, vocab, _pack_bag, "struct<ids: array<int>, cnts: array<double>>")
    if rows is not None:
        return BagOfWords(rows.select("doc_id", "_p.ids", "_p.cnts"), vocab.n_terms)
    runs = (
        with_runs(docs.select("doc_id", "terms"), "terms")
        .select("doc_id", F.explode_outer("runs").alias("r"))
        .select("doc_id", F.col("r.v").alias("term"), F.col("r.cnt").alias("cnt"))
    )
    known = lookup_join(
        runs, vocab.df.select("term", "term_id"), ["term"], "left", vocab.n_bytes, ["doc_id"]
    )
    return BagOfWords(_pack_counts(known), vocab.n_terms)


def pack_counts(doc_terms: DataFrame, n_terms: int) -> BagOfWords:
    """(doc_id, term_id, cnt) rows -> packed counts."""
    return BagOfWords(_pack_counts(doc_terms), n_terms)


def _pack_counts(rows: DataFrame) -> DataFrame:
    entry = F.when(
        F.col("term_id").isNotNull(),
        F.struct(F.col("term_id").cast("int").alias("t"), F.col("cnt").cast("double").alias("c")),
    )
    return (
        rows.groupBy("doc_id")
        .agg(F.array_sort(F.collect_list(entry)).alias("e"))
        .select("doc_id", F.col("e.t").alias("ids"), F.col("e.c").alias("cnts"))
    )


def unpack_counts(bow: BagOfWords) -> DataFrame:
    """Packed counts -> (doc_id, term_id, cnt)."""
    return unnest(bow.df, ["doc_id"], F.arrays_zip("ids", "cnts"), "e").select(
        "doc_id", F.col("e.ids").alias("term_id"), F.col("e.cnts").alias("cnt")
    )


def dense_to_sparse(rows: DataFrame, key: str, values: str) -> DataFrame:
    """Dense vectors -> (key, term_id, cnt) of the non-zero cells."""
    return (
        unnest(rows, [key], values, "v", "term_id")
        .filter(F.col("v") != 0)
        .select(key, "term_id", F.col("v").cast("double").alias("cnt"))
    )


def feature_sequences(docs: DataFrame, vocab: Vocabulary, keep: Sequence[str] = ()) -> Sequences:
    """Id sequences in token order, with the columns ``keep`` of the documents; unseen terms are left out and counted.

    Terms are looked up by hash, or by a join if two of the vocabulary share one.
    """
    rows = _packed(docs, vocab, _pack_sequence, "struct<term_ids: array<int>, n_unseen: bigint>", keep)
    if rows is not None:
        return Sequences(rows.select("doc_id", *keep, "_p.term_ids", "_p.n_unseen"), vocab.n_terms)
    tokens = docs.select("doc_id", F.posexplode_outer("terms").alias("pos", "term"))
    known = lookup_join(
        tokens, vocab.df.select("term", "term_id"), ["term"], "left", vocab.n_bytes, ["doc_id", "pos"]
    )
    entry = F.when(F.col("term_id").isNotNull(), F.struct("pos", F.col("term_id").alias("t")))
    packed = known.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(entry)).alias("e"),
        F.count_if(F.col("term").isNotNull() & F.col("term_id").isNull()).alias("n_unseen"),
    )
    if keep:
        packed = packed.join(docs.select("doc_id", *keep), "doc_id")
    return Sequences(packed.select("doc_id", *keep, F.col("e.t").alias("term_ids"), "n_unseen"), vocab.n_terms)


def sequence_counts(seqs: Sequences) -> BagOfWords:
    """Packed counts of id sequences, formed in the row."""
    runs = with_runs(seqs.df.select("doc_id", "term_ids"), "term_ids")
    return BagOfWords(
        runs.select(
            "doc_id",
            F.col("runs.v").alias("ids"),
            F.transform("runs", lambda e: e["cnt"].cast("double")).alias("cnts"),
        ),
        seqs.n_terms,
    )


def assign_folds(docs: DataFrame, n_folds: int, seed: int) -> DataFrame:
    """Add ``fold`` in 0..n_folds-1, a function of the document id alone."""
    return docs.withColumn("fold", F.floor(hash_uniform(seed, "fold", "doc_id") * n_folds).cast("int"))


def assign_batches(docs: DataFrame, batch_size: int) -> DataFrame:
    """(doc_id, batch_id): contiguous mini-batches in id order."""
    indexed = with_row_index(docs.select("doc_id"), ["doc_id"], "row_index")
    return indexed.select("doc_id", F.floor(F.col("row_index") / batch_size).cast("long").alias("batch_id"))
