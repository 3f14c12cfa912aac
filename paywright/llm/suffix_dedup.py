"""Removal of byte strings that stand earlier in the corpus, by suffix arrays of what recurs."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paywright.llm.common import arrow_batches, dropping_shuffles, tidy, union_all
from paywright.session import materialize

MIN_BYTES = 100
ANCHOR = 24
POSITION_BITS = 22

_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_BYTE = (np.random.Generator(np.random.PCG64(20240611)).integers(1 << 63, size=256, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def _scrambled(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * _MIX
    return h ^ (h >> np.uint64(29))


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), n, 1 << 64))


class Runs:
    """Runs of string starts that share an anchor, of some texts laid side by side.

    Every string of ``length`` bytes names the least of its ``ANCHOR``-byte parts, by hash and then from the left, as
    its anchor. Equal strings have equal anchors at equal places, so only strings of one anchor have to be compared.
    Consecutive starts with the same anchor make a run; a run's bytes reach from its first start to the end of its last
    string.
    """

    def __init__(self, texts: list[bytes], length: int = MIN_BYTES):
        # Some texts at a time: the arrays in between take more than a hundred bytes for each byte of text.
        ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        heads = np.flatnonzero(np.diff((ends - 1) // PIECE, prepend=-2)).tolist()
        found = [(i, *_runs_of(texts[i:j], length)) for i, j in itertools.pairwise([*heads, len(texts)])] or [(0, *_NO_RUNS)]
        self.doc = np.concatenate([doc + i for i, doc, *_ in found])
        self.anchor, self.context, self.first, self.last, self.at = (np.concatenate([f[k] for f in found]) for k in range(2, 7))


_NO_RUNS = tuple(np.zeros(0, kind) for kind in (np.int64, np.uint64, np.uint64, np.int64, np.int64, np.int64))


def _runs_of(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """Of each run: the text, hashes of its anchor and context, first and last start, and its anchor's place in it."""
    sizes = np.array([len(t) for t in texts], np.int64)
    base = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    n = len(data)
    if n < length:
        return _NO_RUNS
    values = _BYTE[data]
    grams = values
    width = 1
    by_width = {1: values}
    while width * 2 <= ANCHOR:
        grams = grams[:-width] + grams[width:] * _power(width)
        width *= 2
        by_width[width] = grams
    rest = ANCHOR - width
    while rest:
        part = 1 << (rest.bit_length() - 1)
        more = by_width[part][width : width + n - width - part + 1]
        grams = grams[: len(more)] + more * _power(width)
        width += part
        rest -= part
    grams = _scrambled(grams)
    low = np.uint64((1 << POSITION_BITS) - 1)
    least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    window = length - ANCHOR + 1
    span = 1
    while span * 2 <= window:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if window > span:
        shift = window - span
        least = np.minimum(least[:-shift], least[shift:])
    # Starts whose string stays inside its text.
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(least)]
    inside = np.arange(len(least)) + length <= (base + sizes)[owner]
    starts = np.flatnonzero(inside)
    if not len(starts):
        return _NO_RUNS
    at = (least[starts] & low).astype(np.int64)
    heads = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(starts, prepend=-2) != 1))
    begin, end = starts[heads], starts[np.append(heads[1:], len(starts)) - 1]
    at = at[heads]
    powers = np.cumprod(np.full(n, _BASE))
    whole = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * powers)])
    back = np.cumprod(np.full(n, np.uint64(pow(int(_BASE), -1, 1 << 64))))
    content = (whole[end + length] - whole[begin]) * back[begin]
    doc = owner[begin]
    # The place of the anchor is part of the content's identity.
    context = _scrambled(content ^ ((at - begin).astype(np.uint64) * _MIX))
    return doc, grams[at], context, begin - base[doc], end - base[doc], at - begin


def suffix_arrays(symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Suffix arrays of many strings laid side by side, by linear grouping.

    Each string ends with its only symbol 0, the least one. Returned are positions in ``symbols``, string after string,
    each string's suffixes in ascending order.

    First, suffixes are grouped by their Lyndon prefixes: groups start as first symbols and are taken in descending
    order; each member points to the nearest smaller suffix on its left (the nearest in a lower group), whose prefix
    grows by the member's. Those pointed at move behind the rest of their group, more often pointed at further.
    Second, suffixes are emitted in ascending order: whoever ends its Lyndon prefix before an emitted suffix takes
    the next place in its group. No string is renamed and nothing recurses. All strings take each step together.
    """
    n = len(symbols)
    count = len(sizes)
    offset = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    owner = np.repeat(np.arange(count), sizes)
    # One place in front stands for "nothing on the left"; every earlier string's groups are lower as well.
    key = owner * (int(symbols.max(initial=0)) + 1) + symbols
    sa = np.argsort(key, kind="stable")
    sorted_key = key[sa]
    heads = np.flatnonzero(np.diff(sorted_key, prepend=-1))
    lengths = np.diff(np.append(heads, n))
    group = np.full(n + 1, -1, np.int64)
    group[sa] = np.repeat(heads, lengths)
    size = np.zeros(n, np.int64)
    size[heads] = lengths
    place = np.empty(n, np.int64)
    place[sa] = np.arange(n)
    left = np.arange(-1, n, dtype=np.int64)
    marked = np.zeros(n, bool)
    active = np.arange(count)
    end = offset + sizes
    while len(active):
        stop = end[active]
        start = group[sa[stop - 1]]
        end[active] = start
        width = stop - start
        members = sa[np.repeat(start - np.cumsum(width) + width, width) + np.arange(width.sum())]
        level = np.repeat(start, width)
        at = members - 1
        left[members] = at
        while True:
            higher = np.flatnonzero(group[at] >= level)
            if not len(higher):
                break
            at[higher] = left[at[higher]]
            left[members] = at
        active = active[start > offset[active]]
        inside = at >= np.repeat(offset[owner[members[np.cumsum(width) - 1]]], width)
        target, times = np.unique(at[inside], return_counts=True)
        if not len(target):
            continue
        of = group[target]
        order = np.lexsort((times, of))
        target, times, of = target[order], times[order], of[order]
        first = np.flatnonzero(np.diff(of, prepend=-1))
        many = np.diff(np.append(first, len(of)))
        top = of[first] + size[of[first]]
        dest = np.repeat(top - many, many) + np.arange(len(of)) - np.repeat(first, many)
        marked[target] = True
        there = sa[dest]
        moved = there[~marked[there]]
        marked[target] = False
        was = place[target]
        vacated = was[was < np.repeat(top - many, many)]
        sa[vacated] = moved
        place[moved] = vacated
        sa[dest] = target
        place[target] = dest
        parts = np.flatnonzero((np.diff(of, prepend=-1) != 0) | (np.diff(times, prepend=-1) != 0))
        amount = np.diff(np.append(parts, len(of)))
        size[of[first]] -= many
        size[dest[parts]] = amount
        group[target] = np.repeat(dest[parts], amount)
    # Emission. The last symbol's suffix is the least of each string.
    out = np.full(n, -1, np.int64)
    out[offset] = offset + sizes - 1
    free = np.zeros(n, np.int64)
    placed = np.zeros(n + 1, bool)
    placed[out[offset]] = True
    placed[n] = True
    for step in range(int(sizes.max(initial=0))):
        running = np.flatnonzero(sizes > step)
        at = out[offset[running] + step] - 1
        low = offset[running]
        while True:
            open_ = (at >= low) & ~placed[at]
            if not open_.any():
                break
            at, low = at[open_], low[open_]
            g = group[at]
            out[g + free[g]] = at
            free[g] += 1
            placed[at] = True
            at = left[at]
    return out


def earlier_strings(parts: list[bytes], group: np.ndarray, doc: np.ndarray, at: np.ndarray, length: int = MIN_BYTES) -> list[np.ndarray]:
    """Of each part, the starts of strings that stand at an earlier place of the corpus in a part of its group.

    ``group`` is non-decreasing; a part begins at byte ``at`` of document ``doc``. One suffix array per group: strings
    that are equal in their first ``length`` bytes stand side by side in it.
    """
    sizes = np.array([len(p) for p in parts], np.int64)
    base = np.cumsum(sizes + 1) - sizes - 1
    last_of_group = np.append(np.diff(group) != 0, True)
    symbols = np.ones(int(sizes.sum()) + len(parts), np.int64)
    text = np.frombuffer(b"".join(parts), np.uint8)
    inside = np.ones(len(symbols), bool)
    inside[base + sizes] = False
    symbols[inside] = text.astype(np.int64) + 2
    symbols[(base + sizes)[last_of_group]] = 0
    bounds = np.append(-1, (base + sizes)[last_of_group])
    ranked = suffix_arrays(symbols, np.diff(bounds))
    part = np.repeat(np.arange(len(parts)), sizes + 1)
    start = np.arange(len(symbols)) - base[part]
    ranked = ranked[(start + length <= sizes[part])[ranked]]
    if not len(ranked):
        return [np.zeros(0, np.int64) for _ in parts]
    # Neighbours in the array belong together when all bytes agree.
    same = np.zeros(len(ranked), bool)
    reach = np.arange(length)
    for row in range(1, len(ranked), 1 << 15):
        here = ranked[row : row + (1 << 15)]
        before = ranked[row - 1 : row - 1 + len(here)]
        near = np.flatnonzero((group[part[here]] == group[part[before]]) & (symbols[here + length - 1] == symbols[before + length - 1]))
        same[row + near] = (symbols[here[near, None] + reach] == symbols[before[near, None] + reach]).all(1)
    family = np.cumsum(~same)
    owner, byte = doc[part[ranked]], (at[part] + start)[ranked]
    by = np.lexsort((byte, owner, family))
    heads = np.flatnonzero(np.diff(family[by], prepend=-1))
    first = np.repeat(by[heads], np.diff(np.append(heads, len(by))))
    hit = ranked[by[(owner[by] != owner[first]) | (byte[by] != byte[first])]]
    hit = np.sort(hit)
    return np.split(start[hit], np.searchsorted(part[hit], np.arange(1, len(parts))))


def merged(begin: np.ndarray, end: np.ndarray, of: np.ndarray | None = None) -> np.ndarray:
    """Indices at which a new maximal stretch starts; stretches of one ``of`` are ordered by begin."""
    if not len(begin):
        return np.zeros(0, np.int64)
    if of is None:
        reach = np.maximum.accumulate(end)
        new = np.append(True, begin[1:] > reach[:-1])
    else:
        new = np.append(True, (of[1:] != of[:-1]) | (begin[1:] > end[:-1]))
    return np.flatnonzero(new)


#: Bytes of text whose equal runs are reduced before they leave a task.
STRETCH = 2 << 20
#: Bytes of text whose runs are found at once; longer texts are taken in overlapping stretches.
PIECE = 1 << 17
#: Blocks of one core that are sorted together; the strings of cores with more are grouped by Spark.
TOGETHER = 64
HELD_BYTES = 6 << 20
SORTED_BYTES = 1 << 20
#: Starts whose strings share one core: of every context at first, and of blocks that are too many to be sorted together.
BLOCK = 32
CORE = 8
NO_ID = (1 << 63) - 1

RUNS = "h long, ctx long, did long, tag int, a int, b int, p short"
SPANS = "did long, tag int, a int, b int"


def _keyed(docs: DataFrame, *keep: str) -> DataFrame:
    """Documents with the key of their order (rows without an id come last) and a tag that tells texts of one id apart."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.select(
        F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)).alias("did"), F.hash(text).alias("tag"), text.alias("body"),
        *[docs[c].alias(f"kept_{c}") for c in keep],
    )


def _stretches(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
    """Documents in groups of at most about ``STRETCH`` bytes: did, tag, offset of the stretch, and its bytes."""
    held: list[tuple[int, int, int, bytes]] = []
    total, step = 0, min(STRETCH, PIECE)
    for batch in batches:
        for did, tag, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
            for offset in range(0, max(1, len(body) - length + 1), step):
                part = body[offset : offset + step + length - 1]
                if total and total + len(part) > STRETCH + length:
                    yield _columns(held)
                    held, total = [], 0
                if len(part) >= length:
                    held.append((did, tag, offset, part))
                    total += len(part)
    if held:
        yield _columns(held)


def _columns(held: list[tuple[int, int, int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    held = sorted(held, key=lambda r: r[:3])
    return np.array([r[0] for r in held], np.int64), np.array([r[1] for r in held], np.int32), np.array([r[2] for r in held], np.int64), [r[3] for r in held]


def _find_runs(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Runs of every document, one of each kind per group of documents; of the others only the bytes they cover."""
    for did, tag, offset, parts in _stretches(batches, length):
        runs = Runs(parts, length)
        if not len(runs.anchor):
            continue
        a = runs.first + offset[runs.doc]
        b = runs.last + offset[runs.doc] + length
        kind = runs.anchor ^ (runs.context * _MIX)
        order = np.argsort(kind, kind="stable")
        new = np.append(True, np.diff(kind[order]) != 0)
        again = np.sort(order[~new])
        keep = np.sort(order[new])
        yield _rows(runs.anchor[keep].view(np.int64), runs.context[keep].view(np.int64), did[runs.doc[keep]], tag[runs.doc[keep]], a[keep], b[keep], runs.at[keep])
        # A repeat of a repeated row is no earlier string of itself.
        again = again[_not_itself(did, tag, offset, runs, kind, order, new, again)] if len(np.unique(did)) < len(did) else again
        if len(again):
            heads = merged(a[again], b[again], runs.doc[again])
            ends = b[again][np.append(heads[1:], len(again)) - 1]
            none = pa.nulls(len(heads), pa.int64())
            of = runs.doc[again[heads]]
            yield _rows(none, none, did[of], tag[of], a[again[heads]], ends, pa.nulls(len(heads), pa.int16()))


def _not_itself(did, tag, offset, runs, kind, order, new, again) -> np.ndarray:
    first = np.empty(len(order), np.int64)
    first[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    x, y = runs.doc[again], runs.doc[first[again]]
    return (did[x] != did[y]) | (runs.first[again] + offset[x] != runs.first[first[again]] + offset[y])


def _rows(h, ctx, did, tag, a, b, p) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int16()]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip((h, ctx, did, tag, a, b, p), kinds, strict=True)], ["h", "ctx", "did", "tag", "a", "b", "p"])


BLOCKS = "core long, did long, tag int, a int, p short, part binary, same binary"
ROWS = "core long, did long, tag int, a int, strings binary"


def _blocks(part: bytes, p: int, size: int, length: int) -> Iterator[tuple[int, int, int, bytes]]:
    """Starts of a run, whose anchor is at ``p``, in blocks of up to ``size``: first and last start, number, and core.

    Starts are cut at fixed distances from the anchor. The strings of one block share the bytes between its last
    possible start and its first end, its core; equal strings stand in blocks of equal numbers and cores.
    """
    k, last = 0, len(part) - length
    while k <= last:
        block = (k - p - 1) // size
        low = p + size * (block + 1)
        stop = min(last, low)
        yield k, stop, block, part[low : low + length - size + 1]
        k = stop + 1


def _find_blocks(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Bytes of the runs' blocks of up to ``BLOCK`` starts, with hashes of their cores and of the whole."""
    for batch in batches:
        out: list[tuple] = []
        for d, t, text, runs in zip(*(batch.column(i).to_pylist() for i in (0, 1)), batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist(), strict=True):
            for run in runs:
                h, at, p = run["h"], run["a"], run["p"]
                part = text[at : run["b"]]
                for k, stop, block, core in _blocks(part, p, BLOCK, length):
                    bytes_ = part[k : stop + length]
                    out.append((_core(h, block, core), d, t, at + k, p - k, bytes_, _hash(bytes_, 16)))
        yield _batch(out, [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int16(), pa.binary(), pa.binary()], ["core", "did", "tag", "a", "p", "part", "same"])


def _take_apart(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Hashes of the strings of blocks, in rows of up to ``CORE`` starts."""
    for batch in batches:
        out: list[tuple] = []
        for h, d, t, at, p, part in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            for k, stop, block, core in _blocks(part, p, CORE, length):
                out.append((_core(h, block, core), d, t, at + k, b"".join([_hash(part[i : i + length], 16) for i in range(k, stop + 1)])))
        yield _batch(out, [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()], ["core", "did", "tag", "a", "strings"])


def _batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _core(key: int, block: int, data: bytes) -> int:
    return int.from_bytes(_hash(b"%d %d " % (key, block) + data, 8), "little", signed=True)


def _hash(data: bytes, size: int) -> bytes:
    return hashlib.blake2b(data, digest_size=size).digest()


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = batch.column(3).to_pylist()
        count = np.array([len(r) // 16 for r in raw], np.int64)
        pairs = np.frombuffer(b"".join(raw), np.int64).reshape(-1, 2)
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        did, tag, a = (np.repeat(batch.column(i).to_numpy(), count) for i in range(3))
        yield pa.RecordBatch.from_arrays(
            [pa.array(did), pa.array(tag), pa.array((a + step).astype(np.int32)), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["did", "tag", "a", "one", "two"]
        )


def _sort_groups(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Covered bytes of the blocks, which come ordered by their core. Whole groups are sorted, many at a time."""
    held: list[tuple[int, int, int, int, bytes]] = []
    size = 0
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if size > HELD_BYTES and row[0] != held[-1][0]:
                yield from _sorted_spans(held, length)
                held, size = [], 0
            held.append(row)
            size += len(row[4])
    if held:
        yield from _sorted_spans(held, length)


def _sorted_spans(held: list[tuple[int, int, int, int, bytes]], length: int) -> Iterator[pa.RecordBatch]:
    # Groups of like size go through the same number of steps, so they are sorted together.
    weight: dict[int, int] = {}
    for row in held:
        weight[row[0]] = weight.get(row[0], 0) + len(row[4])
    held.sort(key=lambda r: (weight[r[0]].bit_length(), r[0]))
    size = np.cumsum([weight[h] for h, _ in itertools.groupby(held, key=lambda r: r[0])])
    share = {h: (weight[h].bit_length(), int(size[k] - 1) // SORTED_BYTES) for k, (h, _) in enumerate(itertools.groupby(held, key=lambda r: r[0]))}
    for _, some in itertools.groupby(held, key=lambda r: share[r[0]]):
        rows = list(some)
        h, did, tag, at = (np.array([r[i] for r in rows], np.int64) for i in range(4))
        group = np.cumsum(np.append(False, h[1:] != h[:-1]))
        found = earlier_strings([r[4] for r in rows], group, did, at, length)
        of = np.repeat(np.arange(len(rows)), [len(f) for f in found])
        if len(of):
            begin = np.concatenate(found) + at[of]
            heads = merged(begin, begin + length, of)
            end = begin[np.append(heads[1:], len(begin)) - 1] + length
            yield pa.RecordBatch.from_arrays(
                [pa.array(did[of[heads]]), pa.array(tag[of[heads]], pa.int32()), pa.array(begin[heads], pa.int32()), pa.array(end, pa.int32())],
                ["did", "tag", "a", "b"],
            )


def _order_of(frame: DataFrame) -> DataFrame:
    """With ``place``, one number for a place in the corpus, for minima that are combined before a shuffle."""
    return frame.withColumn("place", F.col("did").cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(12,0)") + F.col("a"))


def repeated_spans(docs: DataFrame, length: int = MIN_BYTES) -> DataFrame:
    """(did, tag, a, b): stretches of bytes [a, b) of documents that strings of ``length`` bytes cover which stand earlier.

    A hot anchor (a line that a third of all documents share) is never gathered: equal contexts are reduced by minima
    that combine before the shuffle, and different ones, whatever their number, are cut into blocks. Blocks whose core
    nothing shares hold no repeated string and go; equal blocks are reduced by minima. Those left of one core are sorted
    together up to ``TOGETHER`` of them; of cores with more, the strings are grouped by their hashes in Spark. All ways
    find the same strings. Steps end in written tables, after which their shuffle files go.
    """
    with dropping_shuffles(docs.sparkSession):
        return _repeated_spans(docs, length)


def _repeated_spans(docs: DataFrame, length: int) -> DataFrame:
    spark = docs.sparkSession
    arrow_batches(spark, rows=2000, max_bytes=4 << 20)
    keyed = _keyed(docs)
    found = materialize(keyed.where(F.octet_length("body") >= length).mapInArrow(tidy(lambda b: _find_runs(b, length)), RUNS), "runs")
    runs = found.where(F.col("h").isNotNull())
    inside = found.where(F.col("h").isNull()).select("did", "tag", "a", "b")
    shared = runs.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("ctx").alias("lo"), F.max("ctx").alias("hi")).where("n > 1")
    again = materialize(runs.join(shared.select("h", (F.col("lo") != F.col("hi")).alias("varied")), "h"), "shared-runs")
    ordered = _order_of(again)
    first = ordered.groupBy("h", "ctx").agg(F.min("place").alias("first"))
    marked = materialize(
        ordered.join(first, ["h", "ctx"]).where("place > first or varied").select("h", "did", "tag", "a", "b", "p", (F.col("place") == F.col("first")).alias("is_first")),
        "marked-runs",
    )
    whole = marked.where(~F.col("is_first")).select("did", "tag", "a", "b")
    # Rows that repeat a row count once, so that they do not meet each other's runs.
    lists = marked.where("is_first").groupBy("did", "tag").agg(F.collect_set(F.struct("h", "a", "b", "p")).alias("runs"))
    blocks = materialize(
        keyed.join(lists, ["did", "tag"]).select("did", "tag", "body", "runs").mapInArrow(tidy(lambda b: _find_blocks(b, length)), BLOCKS),
        "blocks",
    )
    blocks = _shared(blocks, "shared-blocks")
    repeated = blocks.where(~F.col("is_first")).select("did", "tag", "a", (F.col("a") + F.octet_length("part")).alias("b"))
    blocks = blocks.where("is_first")
    counts = blocks.groupBy("core").agg(F.count(F.lit(1)).alias("n"))
    sorted_ = (
        blocks.join(counts.where(F.col("n").between(2, TOGETHER)), "core").select("core", "did", "tag", "a", "part")
        .repartition("core").sortWithinPartitions("core", "did", "a").mapInArrow(tidy(lambda b: _sort_groups(b, length)), SPANS)
    )
    many = blocks.join(counts.where(F.col("n") > TOGETHER), "core").select("core", "did", "tag", "a", "p", "part")
    packed = materialize(many.mapInArrow(tidy(lambda b: _take_apart(b, length)), ROWS), "string-rows")
    # Beside a hot passage many rows hold the same strings: of those only the earliest one is taken apart.
    packed = _shared(packed.withColumn("same", F.md5("strings")), "shared-rows")
    copies = packed.where(~F.col("is_first")).select("did", "tag", "a", (F.col("a") + F.octet_length("strings") / 16 - 1 + length).cast("int").alias("b"))
    strings = packed.where("is_first").select("did", "tag", "a", "strings").mapInArrow(tidy(_strings), "did long, tag int, a int, one long, two long")
    strings = _order_of(materialize(strings, "shared-strings"))
    earliest = strings.groupBy("one", "two").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first < last")
    grouped = strings.join(earliest, ["one", "two"]).where("place > first").select("did", "tag", "a", (F.col("a") + length).alias("b"))
    return union_all([inside, whole, repeated, sorted_, copies, grouped])


def _shared(rows: DataFrame, purpose: str) -> DataFrame:
    """Rows whose core others have as well, without ``same``; ``is_first`` marks the earliest of those that are the same."""
    ordered = _order_of(rows)
    cores = rows.groupBy("core").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("core")
    heads = ordered.groupBy("core", "same").agg(F.min("place").alias("first")).join(cores, "core")
    marked = ordered.join(heads, ["core", "same"])
    return materialize(marked.select(*[c for c in rows.columns if c != "same"], (F.col("place") == F.col("first")).alias("is_first")), purpose)


def _removals(frame: DataFrame) -> DataFrame:
    return frame.groupBy("did", "tag").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def _cut(body: bytes, spans: pa.ListScalar | None) -> tuple[bytes, int, int]:
    """What is left of a text, the bytes removed and the number of maximal removed runs."""
    if spans is None or not spans.is_valid or not len(spans.values):
        return body, 0, 0
    a = spans.values.field(0).to_numpy(zero_copy_only=False)
    b = spans.values.field(1).to_numpy(zero_copy_only=False)
    order = np.argsort(a, kind="stable")
    a, reach = a[order], np.maximum.accumulate(b[order])
    heads = merged(a, reach)
    begin, end = a[heads], reach[np.append(heads[1:], len(a)) - 1]
    left = [body[i:j] for i, j in zip(np.append(0, end).tolist(), np.append(begin, len(body)).tolist(), strict=True)]
    return b"".join(left), int((end - begin).sum()), len(heads)


def dedup_digests(docs: DataFrame, length: int = MIN_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of ``docs``; see ``dedup_texts``."""
    spans = _removals(repeated_spans(docs, length))
    joined = _keyed(docs, "doc_id").join(spans, ["did", "tag"], "left").select("kept_doc_id", "body", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = batch.column(1).cast(pa.binary()).to_pylist()
            cut = [_cut(body, batch.column(2)[i]) for i, body in enumerate(bodies)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(map(len, bodies), pa.int64()), pa.array([c[1] for c in cut], pa.int64()),
                    pa.array([c[2] for c in cut], pa.int64()), pa.array([hashlib.sha256(c[0]).hexdigest() for c in cut]),
                ],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(tidy(run), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def dedup_texts(docs: DataFrame, length: int = MIN_BYTES) -> DataFrame:
    """``docs`` with every byte taken out of ``text`` that is covered by an earlier string of ``length`` bytes.

    Earlier is a smaller id or, in one document, a smaller start; rows without an id come last, and rows that repeat an
    id and its text count as one place. Null texts stay null. A character that loses a byte goes whole. Other columns
    stay as they are.
    """
    columns = docs.columns
    spans = _removals(repeated_spans(docs, length))
    joined = _keyed(docs, *columns).join(spans, ["did", "tag"], "left").select("body", "spans", *[f"kept_{c}" for c in columns])
    text = 2 + columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = [
                None if old is None else _cut(body, batch.column(1)[i])[0].decode("utf-8", "ignore")
                for i, (body, old) in enumerate(zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(text).to_pylist(), strict=True))
            ]
            kept = [pa.array(left, pa.string()) if c == "text" else batch.column(2 + i) for i, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays(kept, columns)

    return joined.mapInArrow(tidy(run), docs.schema)
