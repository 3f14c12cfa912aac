"""Hard negatives of anchor vectors by inner-product search with coordinate pruning over length buckets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paywright.session import materialize

SCALE = 256
#: Scaled components beyond this are taken as this, so that a product of 512 of them stays a 64-bit integer.
LARGEST = 1 << 27
N_POSITIVES = 5
N_NEGATIVES = 5
LOW_PERCENT = 80
#: Rows of a shard, which one task holds with its index. A small table still gets a shard for each core, of some thousands.
SHARD_ROWS = 1 << 16
FEWEST_ROWS = 1 << 12
#: Rows of a length bucket; least length in a bucket against its first.
BUCKET_ROWS = 1024
LENGTH_RATIO = 0.9
#: Coordinates of an anchor whose feasible ranges are intersected: its largest ones.
FOCUS = 6
#: Anchors that are looked up together.
ANCHORS = 256
#: Room for rounding in cosines; every survivor is scored exactly.
SLACK = 1e-9


def scaled(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, vec): integer vectors of the rows that take part, one for each id.

    Rows without an id or label, and rows whose vector is null or holds a null, NaN or infinite component, take no part.
    Of rows that share an id the one with the smallest label and vector counts.
    """
    x = lambda c: c.cast("double")
    usable = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda c: c.isNull() | F.isnan(x(c)) | (F.abs(x(c)) == float("inf")))
    bound = lambda c: F.greatest(F.least(F.floor(c), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int")
    whole = F.transform("embedding", lambda c: bound(F.greatest(F.least(x(c) * scale, F.lit(2.0 * LARGEST)), F.lit(-2.0 * LARGEST))))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable)
    rows = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), whole.alias("vec"))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("row")).select("vec_id", "row.label", "row.vec")


def sharded(rows: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``rows`` with a ``shard``, written: neighbours in label and length, about ``shard_rows`` each.

    The id is part of the order, so that a vector or label that a third of all rows share fills as many shards as its
    rows ask for.
    """
    sized = materialize(rows.withColumn("size", F.aggregate("vec", F.lit(0.0), lambda s, c: s + c.cast("double") * c)), "vectors")
    count, cores = sized.count(), rows.sparkSession.sparkContext.defaultParallelism
    n = max(1, -(-count // shard_rows), min(cores, count // FEWEST_ROWS))
    dealt = sized.repartitionByRange(n, "label", F.col("size").desc(), "vec_id")
    return materialize(dealt.withColumn("shard", F.spark_partition_id()).drop("size"), "shards")


class Bucket:
    """Vectors of like length: unit vectors by sorted coordinate lists, and the integer vectors they stand for."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, lengths: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.longest, self.shortest = float(lengths.max()), float(lengths.min())
        self.only_label = int(labels[0]) if (labels == labels[0]).all() else None
        self.units = vectors / np.where(lengths > 0, lengths, 1.0)[:, None]
        order = np.argsort(self.units, axis=0, kind="stable")
        self.lists = np.ascontiguousarray(np.take_along_axis(self.units, order, axis=0).T)
        self.order = np.ascontiguousarray(order.T.astype(np.int32))

    def least_cosine(self, length: float, least: np.ndarray | float) -> np.ndarray:
        """The cosine that a vector of this bucket needs at least for a product of ``least``; above 1 none can do."""
        reach = np.where(np.asarray(least) > 0, self.longest, self.shortest) * length
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(reach > 0, least / reach, np.where(np.asarray(least) > 0, 2.0, -1.0))


def buckets_of(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, bucket_rows: int = BUCKET_ROWS) -> list[Bucket]:
    """Buckets by label and falling length. A bucket ends when it is full, lengths fall below 0.9 of its first, or the label changes."""
    lengths = np.sqrt((vectors * vectors).sum(axis=1)) if vectors.shape[1] else np.zeros(len(ids))
    order = np.lexsort((ids, -lengths, labels))
    ids, labels, vectors, lengths = ids[order], labels[order], vectors[order], lengths[order]
    found, at = [], 0
    while at < len(ids):
        end = min(at + bucket_rows, int(np.searchsorted(labels, labels[at], "right")))
        end = at + int(np.searchsorted(-lengths[at:end], -LENGTH_RATIO * lengths[at], "right"))
        found.append(Bucket(ids[at:end], labels[at:end], vectors[at:end], lengths[at:end]))
        at = end
    return found


class Anchors:
    """A few anchors with their lengths and focus coordinates."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, dims: int):
        self.ids, self.labels = ids, labels
        self.vectors = _wide(vectors, dims)
        self.lengths = np.sqrt((self.vectors * self.vectors).sum(axis=1))
        units = self.vectors[:, :dims] / np.where(self.lengths > 0, self.lengths, 1.0)[:, None]
        self.focus = np.argsort(-np.abs(units), axis=1, kind="stable")[:, :FOCUS]
        self.angles = np.arccos(np.clip(np.take_along_axis(units, self.focus, axis=1), -1, 1))

    def ranges(self, which: np.ndarray, cosines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Feasible values of the focus coordinates of unit vectors within the given cosine of anchors ``which``.

        The angle between two unit vectors is at least the difference of their angles to any axis, so a vector within
        an angle of the anchor has each of its own angles to the axes within that of the anchor's.
        """
        spread = np.arccos(np.clip(cosines - SLACK, -1, 1))[:, None]
        angles = self.angles[which]
        return np.cos(np.minimum(angles + spread, np.pi)) - SLACK, np.cos(np.maximum(angles - spread, 0.0)) + SLACK


def _wide(vectors: np.ndarray, dims: int) -> np.ndarray:
    return vectors if vectors.shape[1] >= dims else np.pad(vectors, ((0, 0), (0, dims - vectors.shape[1])))


def products(vectors: np.ndarray, anchor: np.ndarray, lengths: float) -> np.ndarray:
    """Exact integer products; through doubles where these hold them exactly. A shorter side counts as filled up with zeros."""
    anchor = anchor[: vectors.shape[1]]
    if lengths < 2.0**53:
        return (vectors @ anchor).astype(np.int64)
    return vectors.astype(np.int64) @ anchor.astype(np.int64)


def survivors(bucket: Bucket, anchors: Anchors, which: np.ndarray, cosines: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(anchor, rows of the bucket) whose focus coordinates all lie in their feasible ranges.

    Of the candidate sets the one with the shortest range is read off its sorted list, the others are intersected with it.
    """
    low, high = anchors.ranges(which, cosines)
    focus = anchors.focus[which]
    start, end = np.empty(focus.shape, np.int64), np.empty(focus.shape, np.int64)
    for f in np.unique(focus):
        at = focus == f
        start[at] = np.searchsorted(bucket.lists[f], low[at], "left")
        end[at] = np.searchsorted(bucket.lists[f], high[at], "right")
    shortest = np.argsort(end - start, axis=1, kind="stable")
    for i, anchor in enumerate(which.tolist()):
        rows = None
        for k in shortest[i].tolist():
            f = focus[i, k]
            if rows is None:
                rows = bucket.order[f, start[i, k] : end[i, k]]
            elif end[i, k] - start[i, k] < len(bucket.ids):
                value = bucket.units[rows, f]
                rows = rows[(value >= low[i, k]) & (value <= high[i, k])]
            if not len(rows):
                break
        if rows is None:  # no coordinates at all
            rows = np.arange(len(bucket.ids))
        if len(rows):
            yield anchor, rows


NOTHING = np.iinfo(np.int64).max


def _best(ids: np.ndarray, values: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest values, ties to the smaller id."""
    if len(ids) > 4 * k:
        least = np.partition(values, len(values) - k)[len(values) - k]
        keep = values >= least
        ids, values = ids[keep], values[keep]
    order = np.lexsort((ids, -values))[:k]
    return ids[order], values[order]


class Windows:
    """For each anchor some score windows, in each the best ``k`` rows so far."""

    def __init__(self, low: list[list[int]], high: list[list[int]], k: int):
        self.low, self.high, self.k = low, high, k
        self.found = [[(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in windows] for windows in low]
        #: The least score that still counts for an anchor; NOTHING if its windows are empty.
        self.least = np.array([min((a for a, b in zip(x, y, strict=True) if a <= b), default=NOTHING) for x, y in zip(low, high, strict=True)], np.int64)

    def offer(self, anchor: int, ids: np.ndarray, values: np.ndarray) -> None:
        some = values >= self.least[anchor]
        if not some.any():
            return
        ids, values = ids[some], values[some]
        least = []
        for j, (low, high) in enumerate(zip(self.low[anchor], self.high[anchor], strict=True)):
            if low > high:
                continue
            inside = (values >= low) & (values <= high)
            if inside.any():
                old = self.found[anchor][j]
                self.found[anchor][j] = _best(np.append(old[0], ids[inside]), np.append(old[1], values[inside]), self.k)
            kept = self.found[anchor][j][1]
            # A later row with the score of the last one kept may still have the smaller id.
            least.append(int(kept[-1]) if len(kept) == self.k else low)
        self.least[anchor] = min(least)


def search(buckets: list[Bucket], anchors: Anchors, windows: Windows, same_label: bool) -> None:
    """Offer every row that may belong to a window of an anchor, with its exact score."""
    for bucket in buckets:
        open_ = windows.least < NOTHING
        if bucket.only_label is not None:
            open_ &= (anchors.labels == bucket.only_label) == same_label
        which = np.flatnonzero(open_)
        cosines = bucket.least_cosine(anchors.lengths[which], windows.least[which])
        possible = cosines <= 1 + SLACK
        which, cosines = which[possible], cosines[possible]
        if not len(which):
            continue
        for a, rows in survivors(bucket, anchors, which, cosines):
            mine = (bucket.labels[rows] == anchors.labels[a]) == same_label
            mine &= bucket.ids[rows] != anchors.ids[a]
            rows = rows[mine]
            if len(rows):
                windows.offer(a, bucket.ids[rows], products(bucket.vectors[rows], anchors.vectors[a], bucket.longest * anchors.lengths[a]))


def _matrix(column: pa.ListArray) -> np.ndarray:
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    dims = int(sizes.max()) if len(sizes) else 0
    if (sizes == dims).all():
        return flat.reshape(len(sizes), dims).astype(np.float64)
    out = np.zeros((len(sizes), dims))
    out[np.arange(dims) < sizes[:, None]] = flat
    return out


def _shards(batches: Iterator[pa.RecordBatch], bucket_rows: int) -> Iterator[tuple[list[Bucket], int, pa.RecordBatch]]:
    """(buckets, dimensions, some anchors): rows come by shard, those of the index before the anchors that ask it.

    The index of a shard is built once; anchors stream past it.
    """
    shard, held, buckets, dims = None, [], None, 0
    for batch in batches:
        shards, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = np.flatnonzero((np.diff(shards) != 0) | (np.diff(asks) != 0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(shards)], strict=True):
            if a == b:
                continue
            part = batch.slice(a, b - a)
            if shards[a] != shard:
                shard, held, buckets = shards[a], [], None
            if asks[a] == 0:
                held.append((part.column(2).to_numpy(), part.column(3).to_numpy(), _matrix(part.column(4))))
                continue
            if buckets is None:
                dims = max((v.shape[1] for *_, v in held), default=0)
                whole = [np.concatenate(x) for x in zip(*[(i, lab, _wide(v, dims)) for i, lab, v in held], strict=True)]
                buckets = buckets_of(*whole, bucket_rows) if held else []
                held = []
            for at in range(0, b - a, ANCHORS):
                yield buckets, dims, part.slice(at, ANCHORS)


def _asked(index: DataFrame, anchors: DataFrame, shards: DataFrame, own: bool) -> DataFrame:
    """Rows of the index and, behind them, the anchors that may find something in a shard, dealt by shard.

    A shard lists its labels; anchors meet by label the shards that hold their own, or all shards but those that hold
    nothing else.
    """
    none = F.array().cast("array<long>")
    rows = index.select("shard", F.lit(0).alias("ask"), "vec_id", "label", "vec", none.alias("ids"), none.alias("scores"))
    if own:
        asked = anchors.join(shards.select("label", "shard"), "label")
    else:
        n = shards.agg(F.max("shard")).collect()[0][0]
        every = anchors.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(0 if n is None else n))))
        pure = shards.groupBy("shard").agg(F.min("label").alias("label"), F.max("label").alias("top")).where("label = top").drop("top")
        asked = every.join(pure, ["shard", "label"], "left_anti")
    asked = asked.select("shard", F.lit(1).alias("ask"), "vec_id", "label", "vec", "ids", "scores")
    return rows.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "ask")


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Rows with ``place`` up to k by falling score, ties to the smaller row_id. Spark cuts groups before it shuffles them."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "row_id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = N_POSITIVES,
    negatives: int = N_NEGATIVES,
    low_percent: int = LOW_PERCENT,
    shard_rows: int = SHARD_ROWS,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for anchors among ``vectors``.

    A row's score is its integer inner product with the anchor. An anchor's positives are its first ``positives`` other
    rows of the same label; for each of them come the first ``negatives`` rows of other labels that score at most like
    the positive and at least ``low_percent`` % of it. Higher scores come first, ties by smaller id.

    ``vectors`` has vec_id, label and embedding; rows that take no part are named at ``scaled``. A missing component at
    the end counts as zero, vectors without components score 0. An anchor without positives, a negative positive score
    and an empty table give no rows. Other columns are not read.

    Rows lie in shards by label and length, each with an index that one task builds once for all anchors that stream
    past it. In a shard, buckets of like length give a bound on the cosine that a row needs; it bounds the values of the
    anchor's largest coordinates, and rows outside any of these ranges are never scored. The bound rises with the rows
    found. A task gives at most ``positives`` or ``negatives`` rows for each anchor and window.
    """
    rows = scaled(vectors)
    index = sharded(rows, shard_rows)
    shards = materialize(index.select("shard", "label").distinct(), "shard-labels")
    none = F.array().cast("array<long>")
    anchors = index.where(is_anchor).select("vec_id", "label", "vec", none.alias("ids"), none.alias("scores"))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lowest, highest = -(1 << 62), 1 << 62
        for buckets, dims, part in _shards(batches, bucket_rows):
            some = Anchors(part.column(2).to_numpy(), part.column(3).to_numpy(), _matrix(part.column(4)), dims)
            windows = Windows([[lowest]] * len(some.ids), [[highest]] * len(some.ids), positives)
            search(buckets, some, windows, same_label=True)
            found = [(int(some.ids[a]), i, s) for a, (best,) in enumerate(windows.found) for i, s in zip(*map(np.ndarray.tolist, best), strict=True)]
            yield _batch(found, ["anchor_id", "row_id", "score"])

    pairs = _asked(index, anchors, shards, own=True).mapInArrow(nearest, "anchor_id long, row_id long, score long")
    best = _first(pairs, ["anchor_id"], positives)
    grouped = best.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("place", "row_id", "score"))).alias("best"))  # at most `positives`
    asking = anchors.drop("ids", "scores").join(
        grouped.select(F.col("anchor_id").alias("vec_id"), F.col("best.row_id").alias("ids"), F.col("best.score").alias("scores")), "vec_id"
    )
    asking = materialize(asking, "anchors-with-positives")

    def windowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for buckets, dims, part in _shards(batches, bucket_rows):
            some = Anchors(part.column(2).to_numpy(), part.column(3).to_numpy(), _matrix(part.column(4)), dims)
            ids, tops = part.column(5).to_pylist(), part.column(6).to_pylist()
            # Smallest integer n with low_percent * score <= 100 * n; a window is empty for negative scores.
            windows = Windows([[-(-low_percent * s // 100) for s in top] for top in tops], tops, negatives)
            search(buckets, some, windows, same_label=False)
            found = [
                (int(some.ids[a]), ids[a][j], tops[a][j], i, s)
                for a, lists in enumerate(windows.found)
                for j, best in enumerate(lists)
                for i, s in zip(*map(np.ndarray.tolist, best), strict=True)
            ]
            yield _batch(found, ["anchor_id", "positive_id", "positive_score", "row_id", "score"])

    kinds = "anchor_id long, positive_id long, positive_score long, row_id long, score long"
    mined = _asked(index, asking, shards, own=False).mapInArrow(windowed, kinds)
    return _first(mined, ["anchor_id", "positive_id", "positive_score"], negatives).select(
        "anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("row_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"),
    )


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)
