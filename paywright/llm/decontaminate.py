"""Benchmark passages in documents: latent semantic search for candidates, common subsequences and answers to confirm."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paywright.llm.common import arrow_batches, union_all

CELLS = 1 << 18
BLOCKS = 64
WINDOW = 48
STRIDE = 24
RANK = 256
ENERGY = 0.5
COSINE = 0.3
#: A passage is in a document if so much of its words stands there in order, or so much with its answer.
SHARE = 0.6
SHARE_WITH_ANSWER = 0.45
ANSWER_SHARE = 0.8
#: Benchmark items searched for in one pass over the documents.
ITEMS = 4000
GROUP_CHARS = 1 << 20
LONG = 4 << 20
OVERLAP = 32 << 10

_BASE = np.uint64(0xD6E8FEB86659FD93)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BYTE = (np.random.Generator(np.random.PCG64(17)).integers(1 << 63, size=256, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_INNER = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
SENTENCE = re.compile(r"[.!?]+\s+")


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-case words of some texts, in order, and where each text's words begin (one more at the end).

    Words are runs of letters and digits; anything beyond ASCII counts as a letter.
    """
    raw = [t.lower().encode() for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    inner = _INNER[data]
    start = np.flatnonzero(inner & np.append(True, ~inner[:-1]))
    end = np.flatnonzero(~inner & np.append(False, inner[:-1]))
    whole = np.append(np.uint64(0), np.cumsum(_BYTE[data] * np.cumprod(np.full(len(data), _BASE))))
    word = (whole[end] - whole[start]) * np.cumprod(np.full(len(data), _BACK))[start]
    word = (word ^ (word >> np.uint64(32))) * _MIX
    word ^= word >> np.uint64(29)
    sizes = np.cumsum([0] + [len(r) + 1 for r in raw])
    return word, np.searchsorted(start, sizes)


def _cell(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def _groups(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    start = held = 0
    for i, text in enumerate(texts):
        if held and held + len(text) > GROUP_CHARS:
            yield start, texts[start:i]
            start, held = i, 0
        held += len(text) + 1
    if texts[start:]:
        yield start, texts[start:]


def _summed(parts: DataFrame, width: int, dtype: str) -> dict[int, np.ndarray]:
    """Sums of vectors by key: added up in tasks that each own some keys. The number of keys is bounded by the caller."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(key, np.zeros(width, dtype))[:] += np.frombuffer(raw, dtype)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], ["key", "v"])

    return {r["key"]: np.frombuffer(r["v"], dtype) for r in parts.repartition("key").mapInArrow(add, "key int, v binary").toLocalIterator()}


def _vectors(held: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], ["key", "v"])


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """log((N + 1) / (n + 1)) of every hashed word over all documents: a fixed 2 MB whatever the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS + 1, np.int64)
        for batch in batches:
            for _, texts in _groups(batch.column(0).to_pylist()):
                words, first = words_of(texts)
                key = np.sort((np.repeat(np.arange(len(texts)), np.diff(first)).astype(np.int64) << 18) | _cell(words))
                total[:CELLS] += np.bincount(key[np.diff(key, prepend=-1) != 0] & (CELLS - 1), minlength=CELLS)
                total[CELLS] += len(texts)
        blocks = {b: v for b, v in enumerate(total[:CELLS].reshape(BLOCKS, -1)) if v.any()}
        blocks[BLOCKS] = np.append(total[CELLS:], np.zeros(CELLS // BLOCKS - 1, np.int64))
        yield _vectors(blocks)

    found = _summed(docs.select("text").mapInArrow(count, "key int, v binary"), CELLS // BLOCKS, "int64")
    n = found.pop(BLOCKS, np.zeros(1, np.int64))[0]
    df = np.zeros((BLOCKS, CELLS // BLOCKS))
    for b, v in found.items():
        df[b] = v
    return np.log((n + 1) / (df.reshape(-1) + 1)).astype(np.float32) + np.float32(0.01)


def _rows(texts: list[str], idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Unit TF-IDF rows (cells, weights) of passages; a word counts once."""
    words, first = words_of(texts)
    out = []
    for i, j in zip(first[:-1], first[1:], strict=True):
        cells = np.unique(_cell(words[i:j]))
        weight = idf[cells].astype(np.float64)
        out.append((cells, weight / max(np.linalg.norm(weight), 1e-12)))
    return out


def latent_space(passages: DataFrame, idf: np.ndarray, rank: int = RANK) -> tuple[np.ndarray, np.ndarray]:
    """(cells, V): an orthonormal basis of the leading right singular vectors of the passages' TF-IDF matrix A.

    Randomised: Y = A' W for a random W of one row per passage, one power step Y = A'(A Q), then the small Gram matrix
    of A Q. Tasks add up what their passages contribute; only the basis (cells in use times rank) and the Gram matrix
    reach the driver. The rank doubles until every passage keeps ``ENERGY`` of its length.
    """
    while True:
        noise = lambda row, k, r=rank: np.random.default_rng(row[0].astype(np.uint64)).standard_normal(r)
        basis = _basis(_products(passages, idf, noise, rank))
        for _ in range(1):
            cells, q = basis
            basis = _basis(_products(passages, idf, lambda row, k, c=cells, q=q: row[1] @ q[np.searchsorted(c, row[0])], q.shape[1]))
        cells, q = basis
        gram, least = _gram(passages, idf, cells, q)
        if least >= ENERGY or q.shape[1] < rank or q.shape[1] == len(cells):
            break
        rank *= 2
    values, vectors = np.linalg.eigh(gram)
    keep = values > 1e-9 * max(values.max(initial=0), 1e-30)
    return cells, (q @ vectors[:, keep][:, ::-1]).astype(np.float32)


def _products(passages: DataFrame, idf: np.ndarray, right: Callable, width: int) -> dict[int, np.ndarray]:
    """A' R by cell, where ``right`` gives the row of R for a passage."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in _rows(batch.column(0).to_pylist(), idf):
                r = right(row, width)
                for cell, weight in zip(row[0].tolist(), row[1].tolist(), strict=True):
                    held.setdefault(cell, np.zeros(width))[:] += weight * r
        yield _vectors(held)

    return _summed(passages.mapInArrow(part, "key int, v binary"), width, "float64")


def _basis(y: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    cells = np.array(sorted(y), np.int64)
    if not len(cells):
        return cells, np.zeros((0, 0))
    u, s, _ = np.linalg.svd(np.stack([y[c] for c in cells.tolist()]), full_matrices=False)
    return cells, u[:, s > 1e-9 * s[0]]


def _gram(passages: DataFrame, idf: np.ndarray, cells: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, float]:
    width = q.shape[1]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, least = np.zeros((width, width)), 1.0
        for batch in batches:
            for c, w in _rows(batch.column(0).to_pylist(), idf):
                if len(c):
                    b = w @ q[np.searchsorted(cells, c)]
                    total += np.outer(b, b)
                    least = min(least, float(b @ b))
        rows = dict(enumerate(total))
        yield _vectors(rows)
        # Kept as a count of passages below the bar, which can be added up like the rest.
        yield _vectors({width: np.append(float(least < ENERGY), np.zeros(width - 1))} if width else {})

    found = _summed(passages.mapInArrow(part, "key int, v binary"), width, "float64")
    below = found.pop(width, np.zeros(1))[0]
    return np.stack([found.get(i, np.zeros(width)) for i in range(width)]) if width else np.zeros((0, 0)), 0.0 if below else 1.0


def common_words(one: list[int], two: list[int]) -> int:
    """Length of the longest common subsequence, all places of ``one`` at a time in the bits of a number."""
    masks: dict[int, int] = {}
    for k, w in enumerate(one):
        masks[w] = masks.get(w, 0) | 1 << k
    full = (1 << len(one)) - 1
    row = full
    for w in two:
        hit = row & masks.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(one) - row.bit_count()


class Searcher:
    """Everything a task needs to search documents for one block of benchmark items."""

    def __init__(self, items: list[tuple[int, str]], idf: np.ndarray, cells: np.ndarray, v: np.ndarray):
        self.idf = idf
        self.row = np.full(CELLS, -1, np.int32)
        self.row[cells] = np.arange(len(cells))
        self.v = np.vstack([v, np.zeros((1, v.shape[1]), np.float32)])
        self.ids, self.words, self.answers, latent = [], [], [], []
        for item_id, text in items:
            words = words_of([text])[0].tolist()
            if not words:
                continue
            last = SENTENCE.split(text.strip())[-1]
            answer = words_of([last])[0].tolist()
            self.ids.append(item_id)
            self.words.append(words)
            self.answers.append(answer if 3 <= len(answer) < len(words) else words[-max(3, len(words) // 4) :])
            (c, w) = _rows([text], idf)[0]
            latent.append(w @ self.v[self.row[c]].astype(np.float64))
        self.latent = np.array(latent, np.float32).reshape(len(self.ids), v.shape[1])

    def windows(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, begin, end) of all windows, in words."""
        n = np.diff(first)
        count = np.where(n > 0, np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1), 0)
        text = np.repeat(np.arange(len(n)), count)
        k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        begin = first[text] + k * STRIDE
        return text, begin, np.minimum(begin + WINDOW, first[text + 1])

    def search(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, float, bool]]:
        """(text, item, words of the item, words found in order, cosine, whether the answer is there)."""
        words, first = words_of(texts)
        if not len(words) or not self.ids:
            return
        text, begin, end = self.windows(words, first)
        cells = _cell(words)
        energy = self.idf[cells] ** 2
        known = np.where(self.row[cells] >= 0, energy, 0)
        total, known = (np.append(0, np.cumsum(e, dtype=np.float64)) for e in (energy, known))
        # A window's cosine with any item is at most the share of its length that lies on known words.
        maybe = np.flatnonzero((known[end] - known[begin]) >= 0.4 * COSINE**2 * (total[end] - total[begin]))
        best: dict[tuple[int, int], tuple[int, float, bool]] = {}
        for lo in range(0, len(maybe), 512):
            w = maybe[lo : lo + 512]
            at = begin[w, None] + np.arange(WINDOW)
            inside = at < end[w, None]
            c = np.sort(np.where(inside, cells[np.minimum(at, len(cells) - 1)], CELLS), axis=1)
            once = (c < CELLS) & (np.diff(c, axis=1, prepend=-1) != 0)
            weight = np.where(once, self.idf[np.minimum(c, CELLS - 1)], 0)
            rows = np.where(once, self.row[np.minimum(c, CELLS - 1)], -1)
            latent = np.einsum("wk,wkr->wr", weight, self.v[rows])
            cosine = (latent @ self.latent.T) / np.maximum(np.linalg.norm(weight, axis=1), 1e-9)[:, None]
            for i, item in zip(*np.nonzero(cosine >= COSINE), strict=True):
                t = int(text[w[i]])
                mine = self.words[item]
                part = words[max(first[t], begin[w[i]] - len(mine)) : min(first[t + 1], end[w[i]] + len(mine))].tolist()
                found = common_words(mine, part)
                answer = self.answers[item]
                has = common_words(answer, part) >= ANSWER_SHARE * len(answer)
                if found >= SHARE * len(mine) or (has and found >= SHARE_WITH_ANSWER * len(mine)):
                    key, value = (t, int(item)), (found, round(float(cosine[i, item]), 3), bool(has))
                    if key not in best or (value[0], value[2], value[1]) > (best[key][0], best[key][2], best[key][1]):
                        best[key] = value
        for (t, item), (found, cos, has) in sorted(best.items()):
            yield t, item, len(self.words[item]), found, cos, has


def _pieces(texts: list[str]) -> Iterator[tuple[int, str]]:
    """Texts with their index; a very long one in overlapping stretches that end between words."""
    for i, text in enumerate(texts):
        if len(text) <= LONG:
            yield i, text
            continue
        at = 0
        while at < len(text):
            cut = text.find(" ", at + LONG)
            cut = len(text) if cut < 0 or at + LONG >= len(text) else cut
            stop = text.find(" ", min(cut + OVERLAP, len(text)))
            yield i, text[at : len(text) if stop < 0 else stop]
            at = cut


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, item_words, found_words, share, answer_found, cosine) of every benchmark item found in a document.

    Words are weighed by their inverse frequency over all documents. Every window of ``WINDOW`` words, at steps of half
    of that, is compared with every item in the latent space of the items. Candidates are confirmed on the words around
    the window: ``SHARE`` of the item's words in order, or ``SHARE_WITH_ANSWER`` and its answer (its last sentence, or
    its last quarter if it has one sentence). Items and documents without words match nothing. Repeated rows and rows
    without an id are searched like others.

    The items are searched for in blocks of ``ITEMS``, so what goes to the tasks is bounded; each block is a pass over
    the documents, whatever their number.
    """
    spark = docs.sparkSession
    arrow_batches(spark, rows=2000, max_bytes=4 << 20)
    bodies = docs.select("doc_id", F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    idf = inverse_frequencies(bodies)
    texts = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(benchmark["text"].cast("string"), F.lit("")).alias("text")).distinct()
    blocks = max(1, -(-texts.count() // ITEMS))
    out = []
    kind = docs.schema["doc_id"].dataType.simpleString()
    for block in range(blocks):
        part = texts.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        cells, v = latent_space(part.select("text"), idf)
        items = [(r["item_id"], r["text"]) for r in part.orderBy("item_id", "text").collect()]

        def run(batches: Iterator[pa.RecordBatch], searcher: Searcher = Searcher(items, idf, cells, v)) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                hits: dict[tuple[int, int], tuple] = {}
                pieces = list(_pieces(batch.column(1).to_pylist()))
                for start, group in _groups([p for _, p in pieces]):
                    for t, item, n, found, cos, has in searcher.search(group):
                        key = (pieces[start + t][0], item)
                        hits[key] = max(hits.get(key, (0, False, 0.0, 0)), (found, has, cos, n))
                rows = [(ids[i], searcher.ids[item], n, found, found / n, has, cos) for (i, item), (found, has, cos, n) in sorted(hits.items())]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
                types = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.float64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                    ["doc_id", "item_id", "item_words", "found_words", "share", "answer_found", "cosine"],
                )

        out.append(bodies.mapInArrow(run, f"doc_id {kind}, item_id long, item_words long, found_words long, share double, answer_found boolean, cosine double"))
    return union_all(out)
