"""Importance resampling of documents towards a target distribution, and the distributed radix sort that ranks the draw."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paywright.session import materialize

BUCKETS = 10_000
LONGEST = 3
SEED = 42
MIN_WORDS = 20
PERCENT = 5
#: Bytes of a text that are taken apart at once; a longer text goes in pieces that end between two words.
PIECE = 1 << 20
#: Bits of a digit, and rows of a block that one task sorts at once.
DIGIT_BITS = 11
BLOCK_ROWS = 1 << 15

#: Bytes of words are kept (A-Z lower-cased, all non-ASCII bytes as they are), all others part words.
_FOLD = bytes(b if b > 0x7F or chr(b).isalnum() else 0x20 for b in bytes(range(256)).lower())


def _word_lists(text: str) -> Iterator[list[bytes]]:
    """The words of a text in pieces of bounded size; every word is in one piece."""
    folded = text.encode().translate(_FOLD)
    at, size = 0, len(folded)
    while at < size:
        end = at + PIECE
        if end < size:
            gap = folded.find(b" ", end)
            end = size if gap < 0 else gap
        yield folded[at:end].split()
        at = end


def feature_buckets(text: str, buckets: int = BUCKETS) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of the features that end in them) for each piece of a text.

    A feature is a run of 1 to 3 words joined by one space; the checksum of a run goes on from that of the run without
    its last word, so no run is ever put together.
    """
    before: list[bytes] = []
    for words in _word_lists(text):
        known, run = len(before), before + words
        spaced = [b" " + w for w in run]
        one = list(map(crc32, run))
        two = list(map(crc32, spaced[1:], one))
        three = list(map(crc32, spaced[2:], two))
        # Runs that end before this piece were counted with the piece before.
        found = [one[known:], two[max(known - 1, 0):], three[max(known - 2, 0):]]
        yield len(words), np.fromiter(chain(*found), np.int64) % buckets
        before = run[1 - LONGEST:]


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket. What reaches the driver is one number for each bucket, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                if text.is_valid:
                    for _, found in feature_buckets(text.as_py(), buckets):
                        total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    counts = np.zeros(buckets, np.int64)
    for r in texts.select(F.col("text").cast("string")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[r["bucket"]] = r["n"]
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's share in the target and in the source, each smoothed by one a bucket."""
    n = float(len(source))
    all_s, all_t = float(source.sum()) + n, float(target.sum()) + n
    return np.array([math.floor(1000 * math.log((t + 1.0) * all_s / ((s + 1.0) * all_t))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def _gumbel(doc_id: int, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(docs: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row; a row without an id has no score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = []
            for doc_id, text in zip(ids, batch.column(1), strict=True):
                n_words = n_features = weight = 0
                for n, found in feature_buckets(text.as_py() or "", len(gain)):
                    n_words += n
                    n_features += len(found)
                    weight += int(gain[found].sum())
                rows.append((n_words, n_features, weight, None if doc_id is None else weight + _gumbel(doc_id, seed)))
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *columns], ["doc_id", "n_words", "n_features", "weight", "score"])

    plain = docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string"))
    return plain.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def radix_ranked(
    rows: DataFrame, keys: list[tuple[str, bool]], bits: int = DIGIT_BITS, block_rows: int = BLOCK_ROWS, name: str = "rank"
) -> DataFrame:
    """``rows`` with their place (1, 2, 3 ...) by long columns ``keys``, most significant first, True for descending.

    A least-significant-digit radix sort whose rows never meet in one place. Rows lie in blocks of at most ``block_rows``
    neighbours. A pass counts the digits of each block; prefix sums over digits, and over the blocks of a digit, tell
    where the rows of a block with a digit go, in the order in which they stand; a task sorts its block by counting and
    gives each row its next place, which names its next block. As places are exact, blocks are full whatever the keys
    are: a value that a third of all rows share changes nothing. Each pass ends in a written table.

    Keys are not null. Rows that are equal in all keys keep an arbitrary order.
    """
    spark = rows.sparkSession
    columns = rows.columns
    # Ids of a partition begin at a multiple of 2 ** 33: blocks of the first pass hold neighbours too.
    here = materialize(rows.withColumn("_at", F.monotonically_increasing_id()), f"{name}-rows")
    bounds = here.agg(*[f(c).alias(f"{f.__name__}_{c}") for c, _ in keys for f in (F.min, F.max)]).collect()[0]
    passes = []
    for c, descending in reversed(keys):
        low, high = bounds[f"min_{c}"], bounds[f"max_{c}"]
        if low is None:
            return rows.withColumn("rank", F.lit(None).cast("long"))
        passes += [(c, high if descending else low, descending, shift) for shift in range(0, (high - low).bit_length(), bits)]
    passes = passes or [(keys[0][0], low, False, 0)]  # all rows are equal: one pass numbers them
    size = 1 << bits

    def digits_of(column: np.ndarray, step: tuple[str, int, bool, int]) -> np.ndarray:
        _, origin, descending, shift = step
        # In unsigned arithmetic a difference is right even where a signed one overflows.
        from_origin = np.uint64(origin % (1 << 64)) - column.view(np.uint64) if descending else column.view(np.uint64) - np.uint64(origin % (1 << 64))
        return ((from_origin >> np.uint64(shift)) & np.uint64(size - 1)).astype(np.int64)

    def counted(step: tuple[str, int, bool, int]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                block = batch.column(0).to_numpy() // block_rows
                both, n = np.unique(np.stack([block, digits_of(batch.column(1).to_numpy(), step)]), axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1]), pa.array(n)], ["_block", "_digit", "n"])

        return run

    def moved(step: tuple[str, int, bool, int]):
        def run(block: pa.Table, offsets: pa.Table) -> pa.Table:
            # A run of places, one after another, for each digit of the block.
            start = np.zeros(size, np.int64)
            start[offsets["_digit"].to_numpy()] = offsets["start"].to_numpy()
            block = block.take(np.argsort(block["_at"].to_numpy(), kind="stable"))
            digit = digits_of(block[step[0]].to_numpy(), step)
            order = np.argsort(digit.astype(np.uint16), kind="stable")  # a counting sort for such small numbers
            n = np.bincount(digit, minlength=size)
            place = np.empty(len(digit), np.int64)
            place[order] = np.arange(len(digit)) - np.repeat(np.cumsum(n) - n, n) + start[digit[order]]
            return block.select(columns).append_column("_at", pa.array(place))

        return run

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    for step in passes:
        counts = here.select("_at", step[0]).mapInArrow(counted(step), "_block long, _digit long, n long")
        counts = materialize(counts.groupBy("_block", "_digit").agg(F.sum("n").alias("n")), f"{name}-counts")
        totals = dict(counts.groupBy("_digit").agg(F.sum("n").alias("n")).collect())  # at most 2 ** bits
        before, at = [], 0
        for digit in sorted(totals):
            before.append((digit, at))
            at += totals[digit]
        starts = spark.createDataFrame(before, "_digit long, first long")
        earlier = Window.partitionBy("_digit").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        offsets = counts.join(F.broadcast(starts), "_digit").select(
            "_block", "_digit", (F.col("first") + F.coalesce(F.sum("n").over(earlier), F.lit(0))).alias("start")
        )
        blocks = here.withColumn("_block", F.expr(f"_at div {block_rows}"))
        here = materialize(
            blocks.groupBy("_block").cogroup(offsets.groupBy("_block")).applyInArrow(moved(step), f"{kinds}, _at long"), f"{name}-pass"
        )
    return here.select(*columns, (F.col("_at") + 1).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs``: a draw of ``percent`` % that resembles ``target``.

    Words are runs of ASCII letters, digits and all non-ASCII characters, A-Z lower-cased. Features, the runs of 1 to 3
    words, are hashed into buckets; a document's weight sums the gains of the buckets, its score adds noise that its id
    fixes (Gumbel, so that the highest scores are a draw without replacement). Of the rows with at least ``min_words``
    words the highest scores are drawn, ties to the smaller id, and ranked 1, 2, 3 ...

    Null and empty texts have no features and weight 0. A row without an id has no score and is never drawn nor counted
    among those to draw from. Repeated rows are scored and drawn each by itself. An empty ``target`` still gives gains,
    an empty ``docs`` no rows. Other columns are not read.
    """
    gain = gains(bucket_counts(docs), bucket_counts(target))
    scored = materialize(scores(docs, gain, seed), "scores")
    eligible = (F.col("n_words") >= min_words) & F.col("doc_id").isNotNull()
    drawn = percent * scored.where(eligible).count() // 100
    ranked = radix_ranked(scored.where(eligible).drop("n_words"), [("score", True), ("doc_id", False)])
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.where(~eligible).drop("n_words").withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest)
