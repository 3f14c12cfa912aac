"""Near-duplicate embeddings by navigable small-world graphs, one per shard, with audited beams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paywright.llm.common import Unions, components
from paywright.session import materialize

COSINE = 0.98
LINKS = 12
BUILD_BEAM = 48
BATCH = 512
#: Rows of a shard at most; a label with more is dealt over several shards, each queried by all rows of the label.
SHARD_ROWS = 20_000
AUDIT = 256
RECALL = 0.99
FIRST_BEAM = 32
#: How much farther than a link nodes may be that a full beam grows over.
MARGIN = 0.05


class Graph:
    """Hierarchical navigable small-world graph over unit vectors (float32), searched for many queries at a time."""

    def __init__(self, vectors: np.ndarray, links: int = LINKS, beam: int = BUILD_BEAM, seed: int = 7):
        self.x = vectors
        n = len(vectors)
        self.links = links
        rng = np.random.default_rng(seed)
        level = np.minimum((-np.log(1 - rng.random(n)) / np.log(links)).astype(int), 8)
        # From the top level down in the order of insertion, so that every layer is entered from a denser one above.
        self.order = np.argsort(-level, kind="stable")
        self.height = int(level.max(initial=0))
        self.near = [np.full((n, 2 * links if lv == 0 else links), -1, np.int64) for lv in range(self.height + 1)]
        self.entry = int(self.order[0]) if n else -1
        done = 1
        while done < n:
            batch = self.order[done : done + min(BATCH, max(32, done))]
            self._insert(batch, level[batch], beam)
            done += len(batch)
        self._adopt()

    def _adopt(self) -> None:
        """Two more links a node, by which each node is reached from its nearest neighbour even where that one's list, cut to
        diverse ones, has not kept it: to the nearest of such nodes, and from one of them to the next."""
        near = self.near[0]
        left = np.flatnonzero(near[:, 0] >= 0)
        host = near[left, 0]
        lost = ~(near[host] == left[:, None]).any(1)
        left, host = left[lost], host[lost]
        order = np.lexsort((-np.einsum("nd,nd->n", self.x[left], self.x[host]), host))
        left, host = left[order], host[order]
        again = np.flatnonzero(np.diff(host, prepend=-1) == 0)
        first = np.setdiff1d(np.arange(len(left)), again)
        more = np.full((len(self.x), 2), -1, np.int64)
        more[host[first], 0] = left[first]
        more[left[again - 1], 1] = left[again]
        more[(near == more[:, 1:]).any(1), 1] = -1  # a list names no node twice
        self.near[0] = np.concatenate([near, more], 1)

    def _insert(self, batch: np.ndarray, level: np.ndarray, beam: int) -> None:
        entry = np.full((len(batch), 1), self.entry)
        for lv in range(self.height, -1, -1):
            at = np.flatnonzero(level >= lv)
            width = beam if len(at) else 4
            found, _ = self._beam(self.x[batch], entry, lv, width)
            entry = np.where(found[:, :4] >= 0, found[:, :4], found[:, :1])
            if not len(at):
                continue
            new = batch[at]
            # Candidates: what the search found, and the nearest of those inserted together.
            sims = self.x[new] @ self.x[new].T
            np.fill_diagonal(sims, -2)
            k = min(len(new), self.links)
            beside = np.argpartition(-sims, k - 1, axis=1)[:, :k]
            beside = np.where(np.take_along_axis(sims, beside, 1) > -2, new[beside], -1)
            chosen = self._diverse(new, np.concatenate([found[at], beside], 1), self.near[lv].shape[1] // (2 if lv == 0 else 1))
            self.near[lv][new, : chosen.shape[1]] = chosen
            self._back(new, chosen, lv)

    def _diverse(self, nodes: np.ndarray, candidates: np.ndarray, most: int) -> np.ndarray:
        """Up to ``most`` neighbours of each node: nearest first, those nearer to a chosen one than to the node last."""
        candidates = np.sort(candidates, axis=1)
        candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
        candidates[candidates == nodes[:, None]] = -1
        out = np.full((len(nodes), most), -1, np.int64)
        for lo in range(0, len(nodes), 256):
            c = candidates[lo : lo + 256]
            rows = np.arange(len(c))[:, None]
            sim = np.einsum("bd,bcd->bc", self.x[nodes[lo : lo + 256]], self.x[c])
            sim[c < 0] = -3
            top = np.argsort(-sim, axis=1)[:, : max(4 * most, 32)]
            c, sim = c[rows, top], sim[rows, top]
            among = np.einsum("bcd,bed->bce", self.x[c], self.x[c])
            taken = np.zeros(c.shape, bool)
            for k in range(c.shape[1]):
                covered = np.where(taken, among[:, k], -3).max(1)
                taken[:, k] = (c[:, k] >= 0) & (sim[:, k] > covered) & (taken.sum(1) < most)
            rank = np.argsort(np.where(c < 0, 2, ~taken), axis=1, kind="stable")[:, :most]
            kept = c[rows, rank]
            out[lo : lo + 256, : kept.shape[1]] = kept
        return out

    def _back(self, new: np.ndarray, chosen: np.ndarray, lv: int) -> None:
        """Links from the chosen neighbours back to the new nodes; full lists are chosen anew."""
        near = self.near[lv]
        target, source = chosen.ravel(), np.repeat(new, chosen.shape[1])
        order = np.argsort(target[target >= 0], kind="stable")
        target, source = target[target >= 0][order], source[target >= 0][order]
        if not len(target):
            return
        heads = np.flatnonzero(np.diff(target, prepend=-1))
        count = np.diff(np.append(heads, len(target)))
        slot = np.arange(len(target)) - np.repeat(heads, count)
        keep = slot < 64
        more = np.full((len(heads), min(64, int(count.max()))), -1, np.int64)
        more[np.repeat(np.arange(len(heads)), count)[keep], slot[keep]] = source[keep]
        nodes = target[heads]
        near[nodes] = self._diverse(nodes, np.concatenate([near[nodes], more], 1), near.shape[1])

    def _beam(self, queries: np.ndarray, entry: np.ndarray, lv: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search in one layer, all queries in step: (nodes, similarities), best first, -1 where none."""
        q = len(queries)
        seen = np.zeros((q, len(self.x) + 1), bool)
        rows = np.arange(q)[:, None]
        nodes = np.full((q, width), -1, np.int64)
        sims = np.full((q, width), -3, np.float32)
        opened = np.ones((q, width), bool)
        entry = np.sort(entry, axis=1)
        entry[:, 1:][entry[:, 1:] == entry[:, :-1]] = -1
        k = min(width, entry.shape[1])
        entry = entry[:, ::-1][:, :k]
        nodes[:, :k] = entry
        sims[:, :k] = np.where(entry >= 0, np.einsum("qd,qkd->qk", queries, self.x[entry]), -3)
        opened[:, :k] = entry < 0
        seen[rows, entry] = True
        live = np.arange(q)
        near = self.near[lv]
        while len(live):
            # The best node not yet opened of each query; a query without one is done.
            open_sims = np.where(opened[live], -9, sims[live])
            best = open_sims.argmax(1)
            going = open_sims[np.arange(len(live)), best] > -9
            live, best = live[going], best[going]
            if not len(live):
                break
            opened[live, best] = True
            step = near[nodes[live, best]]
            fresh = ~seen[live[:, None], step] & (step >= 0)
            seen[live[:, None], step] = True
            sim = np.where(fresh, np.einsum("qd,qkd->qk", queries[live], self.x[step]), -3)
            some = (sim > sims[live].min(1)[:, None]).any(1)
            at = live[some]
            if not len(at):
                continue
            all_n = np.concatenate([nodes[at], np.where(fresh[some], step[some], -1)], 1)
            all_s = np.concatenate([sims[at], sim[some]], 1)
            all_o = np.concatenate([opened[at], ~fresh[some]], 1)
            top = np.argpartition(-all_s, width - 1, axis=1)[:, :width]
            r = np.arange(len(at))[:, None]
            nodes[at], sims[at], opened[at] = all_n[r, top], all_s[r, top], all_o[r, top]
        order = np.argsort(-sims, axis=1, kind="stable")
        return nodes[rows, order], sims[rows, order]

    def search(self, queries: np.ndarray, width: int, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` nearest nodes found for each query; ``start`` may name a node near each (-1: none)."""
        entry = np.full((len(queries), 1), self.entry)
        for lv in range(self.height, 0, -1):
            found, _ = self._beam(queries, entry, lv, 4)
            entry = np.where(found >= 0, found, found[:, :1])
        if start is not None:
            entry = np.concatenate([entry, start[:, None]], 1)
        return self._beam(queries, entry, 0, width)

    def grown(self, query: np.ndarray, nodes: np.ndarray, least: float) -> np.ndarray:
        """All nodes about as near as ``least`` that links lead to from ``nodes`` over nodes hardly farther than that."""
        seen = np.zeros(len(self.x) + 1, bool)
        seen[nodes] = seen[-1] = True
        found = [nodes]
        edge = nodes
        while len(edge):
            step = np.unique(self.near[0][edge])
            step = step[~seen[step]]
            seen[step] = True
            sims = self.x[step] @ query
            found.append(step[sims >= least])
            edge = step[sims >= least - MARGIN]
        return np.concatenate(found)


def _near_ones(graph: Graph, exact: np.ndarray, queries: np.ndarray, start: np.ndarray, beam: int | None, cosine: float) -> Iterator[tuple[int, np.ndarray]]:
    """(query, nodes with a cosine of at least ``cosine``). A beam that is full of such nodes grows along them.

    Without a beam all rows are compared: for shards on which an audit has shown that the graph does not find enough.
    """
    loose = np.float32(cosine - 1e-4)
    n = len(graph.x)
    width = n if beam is None else min(beam, n)
    size = max(8, min(BATCH, (64 << 20) // (n + 1), (16 << 20) // (64 * width)))
    for lo in range(0, len(queries), size):
        some = queries[lo : lo + size].astype(np.float32)
        nodes, sims = _all(graph, some) if beam is None else graph.search(some, width, start[lo : lo + size])
        for i in range(len(some)):
            near = nodes[i][sims[i] >= loose]
            if len(near) == width < n:
                near = graph.grown(some[i], near, loose)
            # Cosines decide in double precision.
            yield lo + i, near[exact[near] @ queries[lo + i] >= cosine]


def _all(graph: Graph, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sims = queries.astype(np.float32) @ graph.x.T
    return np.broadcast_to(np.arange(len(graph.x)), sims.shape), sims


def _audited(vectors: np.ndarray, cosine: float, alone: bool = False) -> tuple[Graph, int | None]:
    """A graph and a beam with which a sample of the shard's rows finds at least ``RECALL`` of its links.

    The sample searches as queries do: where the shard is ``alone``, that is, asked by its own rows only, from its own
    place in the graph, else from the top. It is compared with all rows. While the recall is too low the beam doubles, and from 256 on the graph is
    built anew with more links. If even a beam as wide as the shard misses too many, there is none: all rows compare.
    """
    x = vectors.astype(np.float32)
    links, build, beam = LINKS, BUILD_BEAM, FIRST_BEAM
    graph = Graph(x, links, build)
    sample = np.random.default_rng(11).permutation(len(x))[:AUDIT]
    truth = vectors[sample] @ vectors.T >= cosine
    truth[np.arange(len(sample)), sample] = False
    start = sample if alone else np.full(len(sample), -1)
    while True:
        found = sum(int(truth[i, hit].sum()) for i, hit in _near_ones(graph, vectors, vectors[sample], start, beam, cosine))
        if found >= RECALL * truth.sum():
            return graph, beam
        if beam >= len(x):
            return graph, None
        beam *= 2
        if beam >= 256 and links == LINKS:
            links, build = 2 * LINKS, 3 * BUILD_BEAM
            graph = Graph(x, links, build)


class Shard:
    """A shard's graph, built once, and the sets of its rows that links found so far connect."""

    def __init__(self, ids: np.ndarray, weight: np.ndarray, exact: np.ndarray, cosine: float, alone: bool = False):
        order = np.argsort(ids)
        self.ids, self.weight, self.exact, self.cosine = ids[order], weight[order], exact[order], cosine
        self.graph, self.beam = _audited(self.exact, cosine, alone)
        self.unions = Unions(len(ids))

    def links(self, ids: np.ndarray, queries: np.ndarray) -> list[tuple[int, int, int]]:
        """(id, links, to) of some queries: how many links each has here, and edges that connect what its links do.

        Links between rows of the shard give an edge only where they join two sets; a row from elsewhere gets an edge to
        each set that it has links to. So a group of copies makes as many edges as it has rows.
        """
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        own = np.where(self.ids[at] == ids, at, -1)
        out = []
        for i, hit in _near_ones(self.graph, self.exact, queries, own, self.beam, self.cosine):
            hit = hit[hit != own[i]]
            if not len(hit):
                continue
            me, count = int(ids[i]), int(self.weight[hit].sum())
            if own[i] >= 0:
                to = [j for j in hit.tolist() if self.unions.join(int(own[i]), j)]
            else:
                to = list({self.unions.root(j): j for j in hit.tolist()}.values())
            out.append((me, count, int(self.ids[to[0]]) if to else me))
            out += [(me, 0, int(self.ids[j])) for j in to[1:]]
        return out


def _shard_links(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """Links of each shard's queries. Rows come by shard (key, which ends in the number of the label's shards), those of the
    index before the queries that stream past it."""
    key, held, shard = None, [], None
    for batch in batches:
        keys, asks, ids, weight = batch.column(0).to_pylist(), *(batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
        units = batch.column(4)
        cuts = [k for k in range(1, len(keys)) if keys[k] != keys[k - 1] or asks[k] != asks[k - 1]]
        out = []
        for a, b in zip([0, *cuts], [*cuts, len(keys)], strict=True):
            if a == b:
                continue
            if keys[a] != key:
                key, held, shard = keys[a], [], None
            part = (ids[a:b], weight[a:b], units.slice(a, b - a).flatten().to_numpy().reshape(b - a, -1))
            if not asks[a]:
                held.append(part)
                continue
            if shard is None:
                shard = Shard(*[np.concatenate(x) for x in zip(*held, strict=True)], cosine, key.endswith(":1"))
                held = []
            out += shard.links(part[0], part[2])
        columns = zip(*out, strict=True) if out else [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["id", "n", "to"])


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding, label).

    Rows link when their labels are equal and not null, their lengths are equal and their cosine in double precision is
    at least ``cosine``. Vectors that are null, empty, zero or hold null or non-finite parts link with nothing, and so
    do rows without an id. component_id is the smallest vec_id reachable (without an id: null).

    Equal vectors of a label are one row that counts as many. Each label is dealt over shards by hash; each shard's graph
    is built once, and all rows of the label stream past it, with beams that an audit against brute force has widened. Of
    a row's links only their number and edges that connect what they connect are kept, so large groups are not expanded.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("label"), F.col("embedding").cast("array<double>").alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    sound = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # Large and tiny parts are scaled first, so that squares neither overflow nor vanish.
    usable = rows.where(sound).withColumn("top", F.array_max(F.transform("v", F.abs))).where("top > 0")
    scaled = usable.withColumn("v", F.transform("v", lambda x: x / F.col("top"))).withColumn("norm", norm)
    units = scaled.select("id", "label", F.transform("v", lambda x: x / F.col("norm")).alias("unit"))
    copies = materialize(units, "unit-vectors")
    distinct = copies.groupBy("label", "unit").agg(F.min("id").alias("id"), F.count_distinct("id").alias("weight"))
    distinct = materialize(distinct, "distinct-vectors")
    width = F.size("unit").alias("width")
    counts = distinct.groupBy("label", width).agg(F.count(F.lit(1)).alias("rows"))
    dealt = distinct.withColumn("width", F.size("unit")).join(counts, ["label", "width"])
    shards = F.ceil(F.col("rows") / SHARD_ROWS)
    named = lambda shard: F.concat_ws(":", F.col("label").cast("string"), "width", shard, shards).alias("key")
    indexed = dealt.select(named(F.pmod(F.xxhash64("id"), shards)), F.lit(False).alias("asks"), "id", "weight", "unit")
    each = dealt.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), shards - 1)))
    asked = each.select(named(F.col("shard")), F.lit(True).alias("asks"), "id", "weight", "unit")
    met = indexed.unionByName(asked).repartition("key").sortWithinPartitions("key", "asks")
    found = met.mapInArrow(lambda b: _shard_links(b, cosine), "id long, n long, to long")
    found = materialize(found, "vector-links")
    linked = found.groupBy("id").agg(F.sum("n").alias("n"))
    named = components(found.select(F.col("id").alias("u"), F.col("to").alias("v")))
    of_class = (
        distinct.join(linked, "id", "left").join(named.withColumnRenamed("node", "id"), "id", "left")
        .select("label", "unit", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
    )
    by_id = copies.select("id", "label", "unit").join(of_class, ["label", "unit"]).groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component").alias("component"))
    out = rows.select("id").join(by_id, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))
