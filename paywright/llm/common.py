"""Pieces that the training-data operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from functools import reduce
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paywright.session import materialize


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand this package to the executors, once per application, so that functions in tasks find their modules.

    Only program text goes into the driver's temporary folder; Spark's own file server brings it to the executors.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="paywright-code-")) / "paywright_code.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, str(f.relative_to(root.parent)))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_batches(spark: SparkSession, rows: int = 1000, max_bytes: int = 8 << 20) -> None:
    """Bound what one Arrow batch holds, by rows and by bytes, so that a run of long texts cannot fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(max_bytes))


@contextmanager
def dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query go as soon as it has ended, for the steps inside; the session's own setting returns."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same function over batches, giving the memory of its arrays back when a task ends.

    Workers live on for other tasks; what a heavy one has freed would else stay theirs, beside the next one's needs.
    """

    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # where the C library can
                ctypes.CDLL(None).malloc_trim(0)

    return tidied


def fold(modulus: int, held: int, key: str = "doc_id") -> Column:
    """True for the held-out rows. A missing id is in no fold, so it is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % modulus == held, F.lit(False))


def logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights of a ridge-penalised logistic regression by Newton steps; the last one is the intercept (unpenalised).

    ``y`` may hold probabilities. Features are taken as given.
    """
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    weight = np.ones(len(x)) if weight is None else weight
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = logistic(x @ w)
        grad = x.T @ (weight * (p - y)) + penalty * w
        hess = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held: Column, per_class: int, max_bytes: int) -> tuple[list[tuple[str, int]], dict[int, int]]:
    """At most ``per_class`` texts of either label from the rows that may be learned from, in an order of hashed ids, and
    how many there are of either.

    Labels that are null or say both things about one id are not used; of several texts of one id the smallest counts.
    Texts above ``max_bytes`` are left to others, so that what reaches the driver is bounded by
    ``2 * per_class * max_bytes``.
    """
    known = (
        labels.select("doc_id", F.col(label).cast("int").alias("y"))
        .where(F.col("y").isin(0, 1) & ~held)
        .groupBy("doc_id")
        .agg(F.min("y").alias("y"), F.max("y").alias("top"))
        .where("y = top")
        .drop("top")
    )
    # Ids are picked first, in one job for both labels, so that no text is shuffled or sorted; then only their texts are read.
    fit = docs.select("doc_id", "text").where(~held & F.col("text").isNotNull() & (F.octet_length("text") <= max_bytes))
    ids = fit.select("doc_id").distinct().join(known, "doc_id")
    counts = ids.groupBy("y").count().select(F.lit(None).cast(ids.schema["doc_id"].dataType).alias("doc_id"), "y", "count")
    picked = union_all([ids.where(F.col("y") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for v in (0, 1)])
    found = picked.select("doc_id", "y", F.lit(None).cast("long").alias("count")).unionByName(counts).collect()
    label_of = {r["doc_id"]: r["y"] for r in found if r["count"] is None}
    chosen = docs.sparkSession.createDataFrame([(i,) for i in label_of], docs.select("doc_id").schema)
    rows = fit.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).orderBy(F.xxhash64("doc_id"), "doc_id")
    return [(r["text"], label_of[r["doc_id"]]) for r in rows.toLocalIterator()], {0: 0, 1: 0, **{r["y"]: r["count"] for r in found if r["count"] is not None}}


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` (u, v) reaches.

    Every round takes the smallest label among a node's neighbours and then jumps to that label's own label, so the
    number of rounds grows with the logarithm of a chain's length. Labels meet edges by joins and minima only: a hub's
    edges are combined before they are shuffled and never gathered. Each round ends in a written table.
    """
    edges = materialize(
        edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct(), "edges"
    )
    labels = materialize(edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("component")), "labels")
    while True:
        near = (
            edges.join(labels.withColumnRenamed("node", "v"), "v")
            .groupBy(F.col("u").alias("node"))
            .agg(F.min("component").alias("near"))
        )
        pulled = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("next"))
        new = pulled.join(jump, "component", "left").select("node", "was", F.coalesce("next", "component").alias("component"))
        new = materialize(new, "labels")
        changed = new.where("was <> component").limit(1).count()
        labels = new.select("node", "component")
        if not changed:
            return labels


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


class Unions:
    """Disjoint sets over 0..n-1 inside one task; the root of a set is its smallest member."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


class Memo:
    """What was computed for recurring keys, in two generations: when the newer one is full, the older one goes.

    A plain table of results: what is forgotten is computed again, with the same outcome.
    """

    def __init__(self, entries: int):
        self.entries = entries
        self.new: dict = {}
        self.old: dict = {}

    def missing(self, keys: set) -> set:
        """Keys to compute; the others are in ``new`` until the next call."""
        if len(self.new) > self.entries:
            self.old, self.new = self.new, {}
        rest = keys.difference(self.new)
        if self.old:
            old = self.old
            kept = [key for key in rest if key in old]
            for key in kept:
                self.new[key] = old[key]
            rest.difference_update(kept)
        return rest


def fresh(name: str) -> str:
    """A column name that no input column clashes with."""
    return f"{name}_{uuid.uuid4().hex[:8]}"
