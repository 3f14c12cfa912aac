"""Suffix-array removal, set-similarity join and embedding links against brute force."""

import hashlib
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from paywright.llm import common, embed_dedup, ngram_join, suffix_dedup


def test_suffix_arrays(rnd):
    rng = np.random.default_rng(1)
    for _ in range(150):
        strings = []
        for _ in range(rng.integers(1, 10)):
            s = rng.integers(1, 1 + rng.integers(1, 4), size=rng.integers(0, 40))
            strings.append(np.append(np.tile(s, 3) if rng.random() < 0.4 else s, 0))
        got = suffix_dedup.suffix_arrays(np.concatenate(strings), np.array([len(s) for s in strings]))
        at = 0
        for s in strings:
            assert (got[at : at + len(s)] - at).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
            at += len(s)


def removed(rows, length):
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        cover = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if b[i : i + length] in seen:
                cover[i : i + length] = b"\1" * length
            seen.add(b[i : i + length])
        runs = sum(1 for i in range(len(cover)) if cover[i] and (i == 0 or not cover[i - 1]))
        kept = bytes(x for x, c in zip(b, cover, strict=True) if not c)
        out[d] = (len(b), sum(cover), runs, hashlib.sha256(kept).hexdigest(), kept)
    return out


def corpus(rnd):
    words = ["th", "er", "ion", "ando", "é", "ß", "ing", "whand", "re", "zzz"]
    para = lambda n: " ".join("".join(rnd.choice(words) for _ in range(rnd.randint(1, 4))) for _ in range(n))
    passages, rows = [para(40) for _ in range(4)], []
    for d in range(120):
        k, t = rnd.random(), para(rnd.randint(0, 80))
        if k < 0.5:
            t += " " + rnd.choice(passages) + " " + para(rnd.randint(0, 30))
        if k < 0.1 and rows:
            t = rnd.choice(rows)[1]
        if 0.1 < k < 0.3 and rows:
            o = rnd.choice(rows)[1].split(" ")
            o[rnd.randrange(len(o))] = para(1)
            t = " ".join(o)
        if 0.3 < k < 0.36:
            t = rnd.choice(["ab" * 150, "x" * 250, para(60) * 3])
        rows.append((d * 3, t))
    return rows + [(9001, None), (9002, ""), (9003, "short")]


@pytest.mark.parametrize("together, stretch", [(64, 2 << 20), (2, 700)])
def test_repeated_bytes_go(docs_of, rnd, monkeypatch, together, stretch):
    monkeypatch.setattr(suffix_dedup, "TOGETHER", together)
    monkeypatch.setattr(suffix_dedup, "STRETCH", stretch)
    rows = corpus(rnd)
    want = removed(rows, 100)
    got = {r[0]: tuple(r)[1:] for r in suffix_dedup.dedup_digests(docs_of(rows)).collect()}
    assert got == {d: v[:4] for d, v in want.items()}
    assert sum(v[1] for v in want.values()) > 1000


@pytest.mark.parametrize("size", [900, 3 << 20])
def test_finding_runs_takes_little_memory(rnd, size):
    """Both of many short texts and of a long one; a worker's arrays once took 230 MB for 2 MB of text."""
    texts = [rnd.randbytes(size).hex() for _ in range((2 << 20) // (2 * size) + 1)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array([0] * len(texts), pa.int32()), pa.array(texts)], ["did", "tag", "body"])
    tracemalloc.start()
    rows = sum(b.num_rows for b in suffix_dedup._find_runs(iter([batch]), 100))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows > sum(map(len, texts)) / 100 and peak < 80 << 20


def test_pieces_do_not_change_runs(rnd, monkeypatch):
    texts = [t.encode() for _, t in corpus(rnd) if t is not None]
    found = []
    for piece in (1, 5000, 1 << 22):
        monkeypatch.setattr(suffix_dedup, "PIECE", piece)
        runs = suffix_dedup.Runs(texts, 100)
        found.append([getattr(runs, c).tolist() for c in ("doc", "anchor", "context", "first", "last", "at")])
    assert len(found[0][0]) > 100 and found[0] == found[1] == found[2]
    assert not len(suffix_dedup.Runs([], 100).doc) and not len(suffix_dedup.Runs([b"", b""], 100).doc)


def test_texts_in_pieces_lose_the_same_bytes(docs_of, rnd, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    rows = corpus(rnd) + [(9100, "".join(rnd.choice("abcdefgh ") for _ in range(900)) * 3)]
    got = {r[0]: tuple(r)[1:] for r in suffix_dedup.dedup_digests(docs_of(rows)).collect()}
    assert got == {d: v[:4] for d, v in removed(rows, 100).items()}


def test_common_phrases_are_compared_in_proportion_to_the_documents(docs_of, rnd, monkeypatch):
    """Short phrases that every document holds share anchors, but no string of 100 bytes: none is taken apart."""
    para = lambda n: "".join(rnd.choice("abcdefghij ") for _ in range(n))
    phrases, passage, made = [para(60) for _ in range(5)], para(200), {}
    write = suffix_dedup.materialize

    def counting(df, purpose):
        made[n][purpose] = (table := write(df, purpose)).count()
        return table

    monkeypatch.setattr(suffix_dedup, "materialize", counting)
    for n in (40, 200):
        made[n] = {}
        rows = [(d, para(150).join(["", *phrases, passage if d in (3, 30) else ""]) + para(150)) for d in range(n)]
        want = removed(rows, 100)
        got = {r[0]: tuple(r)[1:] for r in suffix_dedup.dedup_digests(docs_of(rows)).collect()}
        assert got == {d: v[:4] for d, v in want.items()} and sum(v[1] for v in want.values()) >= 200
    assert made[40]["shared-runs"] >= 40
    assert {k: v for k, v in made[200].items() if v > 6 * made[40][k]} == {}


def test_rows_that_repeat_do_not_multiply_blocks(docs_of, rnd, monkeypatch):
    made = {}
    write = suffix_dedup.materialize

    def counting(df, purpose):
        made[purpose] = (table := write(df, purpose)).count()
        return table

    monkeypatch.setattr(suffix_dedup, "materialize", counting)
    line = "".join(rnd.choice("abcdefghij ") for _ in range(150))
    rows, blocks = [(1, "one, " + line + " and more of it" * 9), (2, "the second: " + line + " but other things" * 9)], []
    for times in (1, 8):
        got = suffix_dedup.dedup_digests(docs_of(rows * times)).collect()
        assert len(got) == 2 * times
        assert {tuple(r) for r in got} == {(d, *v[:4]) for d, v in removed(rows, 100).items()}
        blocks.append(made["blocks"])
    assert 0 < blocks[0] and blocks[1] <= 8 * blocks[0]


def test_texts_are_cut_and_other_columns_stay(docs_of):
    line = " ".join(f"é{i}" for i in range(40)) + " "
    rows = [(1, line + "tail one"), (2, "head " + line), (None, line), (3, None), (3, None), (1, line + "tail one")]
    out = suffix_dedup.dedup_texts(docs_of(rows))
    assert out.columns == docs_of(rows).columns
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    # The repeated row 1 is one place, so neither of its rows is cut; the row without an id comes last.
    assert got == sorted([(1, line + "tail one"), (1, line + "tail one"), (2, "head "), (None, ""), (3, None), (3, None)], key=str)
    assert suffix_dedup.dedup_texts(docs_of(rows).limit(0)).count() == 0


def linked(rows):
    lower = {c: c + 32 for c in range(65, 91)}
    sets = {}
    for d, t in rows:
        w = [x.translate(lower) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    ids = sorted(sets)
    unions = common.Unions(len(ids))
    for i, a in enumerate(ids):
        for j in range(i):
            x, y = sets[a], sets[ids[j]]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                unions.join(i, j)
    return {d: (len(sets[d]), ids[unions.root(i)]) for i, d in enumerate(ids)}


@pytest.mark.parametrize("block", [512, 3])
def test_similar_documents_link(docs_of, rnd, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    vocabulary = [f"w{i}" for i in range(60)] + ["Été", "The"]
    para = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    hot, rows = para(30), []
    for d in range(200):
        k, t = rnd.random(), para(rnd.randint(0, 80))
        if k < 0.3:
            t += " " + hot
        if 0.3 < k < 0.7 and rows:
            o = rnd.choice(rows)[1].split(" ")
            for _ in range(rnd.randint(0, 3)):
                o[rnd.randrange(len(o))] = rnd.choice(vocabulary)
            t = ("\t" if rnd.random() < 0.2 else " ").join(o[: -rnd.randint(1, 4)] if rnd.random() < 0.3 and len(o) > 5 else o)
        if 0.7 < k < 0.75:
            t = para(rnd.randint(0, 6)).upper()
        rows.append((d * 7, t))
    rows += [(90001, None), (90002, ""), (90003, " \n ")]
    want = linked(rows)
    assert sum(v[1] != d for d, v in want.items()) > 20
    assert {r[0]: tuple(r)[1:] for r in ngram_join.similar(docs_of(rows)).collect()} == want


def test_similar_corner_cases(docs_of):
    text = "one two three four five six seven"
    rows = [(5, text), (5, text), (9, text.upper()), (None, text), (None, "alone here"), (None, None), (3, "a b"), (4, "A  b"), (6, "a b c")]
    got = sorted(map(tuple, ngram_join.similar(docs_of(rows)).collect()), key=str)
    want = [(5, 3, 5), (5, 3, 5), (9, 3, 5), (None, 3, 5), (None, 1, None), (None, 0, None), (3, 1, 3), (4, 1, 3), (6, 1, 6)]
    assert got == sorted(want, key=str)
    assert ngram_join.similar(docs_of(rows).limit(0)).count() == 0


def test_trie_agrees_with_pairs():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 12, size=rng.integers(1, 12)).astype(np.uint64)) for _ in range(150)]
    unions = common.Unions(len(sets))
    for i, x in enumerate(sets):
        for j in range(i):
            both = len(np.intersect1d(x, sets[j]))
            if 100 * both >= 80 * (len(x) + len(sets[j]) - both):
                unions.join(i, j)
    assert ngram_join.connected(sets) == [unions.root(i) for i in range(len(sets))]


def test_sets_with_only_a_passage_in_common_are_not_compared(monkeypatch):
    """Before, every set of a cell was compared with every other one that a hot passage brought there."""
    rng = np.random.default_rng(4)
    passage = rng.integers(1 << 50, size=30, dtype=np.uint64)
    sets = [np.unique(np.append(passage, rng.integers(1 << 50, size=70, dtype=np.uint64))) for _ in range(300)]
    sets += [s[:-1] for s in sets[:5]]
    compared = []
    monkeypatch.setattr(ngram_join.PrefixTree, "connect", lambda tree, tokens, member, *rest, f=ngram_join.PrefixTree.connect: (compared.append(member), f(tree, tokens, member, *rest)))
    want = [*range(300), *range(5)]
    assert ngram_join.connected(sets) == want and len(compared) == 10
    assert ngram_join.connected(sets, labels=[*range(300), *range(5)]) == want and len(compared) == 10
    assert ngram_join.connected(sets, index=300) == want and len(compared) == 15


def test_parts_keep_every_link():
    rng = np.random.default_rng(6)
    for _ in range(60):
        bases = [rng.integers(1 << 50, size=rng.integers(1, 60), dtype=np.uint64) for _ in range(4)]
        take = lambda s, p: s[rng.random(len(s)) < p]
        sets = [np.unique(np.append(take(bases[rng.integers(4)], rng.choice([1, 0.95, 0.8])), take(bases[0], rng.integers(2)))) for _ in range(25)]
        labels, index = [rng.integers(0, 15, 25).tolist(), None][rng.integers(2)], [None, 10][rng.integers(2)]
        unions, heads = common.Unions(25), {}
        for i, label in enumerate(labels or ()):
            unions.join(heads.setdefault(label, i), i)
        for i, x in enumerate(sets):
            for j in range(i):
                both = len(np.intersect1d(x, sets[j]))
                if both and 100 * both >= 80 * (len(x) + len(sets[j]) - both) and (index is None or j < index <= i):
                    unions.join(i, j)
        assert ngram_join.connected(sets, labels=labels, index=index) == [unions.root(i) for i in range(25)]


def test_sets_of_large_groups_are_joined_apart(docs_of, rnd, monkeypatch):
    """A group that a passage makes larger than a block goes to a call of its own, with all its links."""
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    calls = []
    monkeypatch.setattr(ngram_join, "_links", lambda *a, f=ngram_join._links: (calls.append(a[2]), f(*a))[1])
    para = lambda n: " ".join(f"w{rnd.randrange(5000)}" for _ in range(n))
    passage = para(30)
    rows = [(d, f"{passage} {para(4)}") for d in range(20)] + [(100 + d, para(40)) for d in range(60)]
    rows += [(200 + d, rows[d][1] + " end") for d in (0, 3, 7, 30)]
    want = linked(rows)
    assert sum(v[1] != d for d, v in want.items()) >= 4
    assert {r[0]: tuple(r)[1:] for r in ngram_join.similar(docs_of(rows)).collect()} == want
    assert len(calls) > 1 and all(2 * b < a for a, b in zip(calls, calls[1:], strict=False))


@pytest.mark.parametrize("shard", [20_000, 40])
def test_embeddings_link(spark, monkeypatch, shard):
    monkeypatch.setattr(embed_dedup, "SHARD_ROWS", shard)
    rng = np.random.default_rng(2)
    rows = []
    for i in range(250):
        v = rng.normal(size=16)
        if i % 3 == 0 and rows:
            v = np.array(rows[rng.integers(len(rows))][1]) + rng.normal(size=16) * rng.choice([0, 0.05, 0.12])
        rows.append((i * 5, v.tolist(), int(rng.integers(0, 3)) if i % 11 else None))
    one = [1.0] * 15
    rows += [(9001, None, 1), (9002, [0.0] * 16, 1), (9003, [float("nan"), *one], 1), (9004, [None, *one], 1), (9005, [1.0] * 3, 1), (9006, [2.0] * 3, 1)]
    rows += [(9007, [], 0), (9008, [float("inf"), *one], 0), (9009, [1e200] * 16, 2), (9010, [1e-200] * 16, 2)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, n string").repartition(3)
    usable = {}
    for i, v, label in rows:
        if v and label is not None and None not in v and np.isfinite(v).all() and np.any(v):
            x = np.array(v) / np.abs(v).max()
            usable[i] = (label, x / np.linalg.norm(x))
    ids, n = sorted(usable), dict.fromkeys((r[0] for r in rows), 0)
    unions = common.Unions(len(ids))
    for a in range(len(ids)):
        for b in range(a):
            (p, x), (q, y) = usable[ids[a]], usable[ids[b]]
            if p == q and len(x) == len(y) and x @ y >= 0.98:
                n[ids[a]] += 1
                n[ids[b]] += 1
                unions.join(a, b)
    root = {i: ids[unions.root(k)] for k, i in enumerate(ids)}
    got = {r[0]: tuple(r)[1:] for r in embed_dedup.near_duplicates(frame).collect()}
    assert sum(n.values()) > 40
    assert got == {i: (n[i], root.get(i, i), root.get(i, i) == i) for i in n}
    none = embed_dedup.near_duplicates(spark.createDataFrame([(None, [1.0, 2.0], 1)], "vec_id long, embedding array<double>, label int"))
    assert [tuple(r) for r in none.collect()] == [(None, 0, None, None)]


def test_graph_recall():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 24))
    x[1500:] = x[:1500] + rng.normal(size=(1500, 24)) * 0.08
    x /= np.linalg.norm(x, axis=1)[:, None]
    truth = x @ x.T >= 0.98
    graph, beam = embed_dedup._audited(x, 0.98)
    found = sum(len(hit) for _, hit in embed_dedup._near_ones(graph, x, x, np.full(len(x), -1), beam, 0.98))
    assert found >= 0.98 * truth.sum()


@pytest.mark.parametrize("alone", [False, True])
def test_small_shards_search_their_graph(monkeypatch, alone):
    """All rows compare only where an audit has failed, at any size."""
    def never(*_):
        raise AssertionError("compared all rows")

    rng = np.random.default_rng(5)
    for n in (1, 2, 20, 60, 200, 1000):
        x = rng.normal(size=(n, 24))
        x[n // 2 :] = x[: n - n // 2] + rng.normal(size=(n - n // 2, 24)) * 0.08
        x /= np.linalg.norm(x, axis=1)[:, None]
        with monkeypatch.context() as patched:
            patched.setattr(embed_dedup, "_all", never)
            shard = embed_dedup.Shard(np.arange(n) * 3, np.ones(n, int), x, 0.98, alone)
            got = {i: c for i, c, _ in shard.links(np.arange(n) * 3, x)[::-1] if c}
        want = (x @ x.T >= 0.98).sum(1) - 1
        assert got == {3 * i: int(c) for i, c in enumerate(want) if c}


def test_a_failed_audit_compares_all_rows(monkeypatch):
    monkeypatch.setattr(embed_dedup.Graph, "search", lambda self, q, width, start=None: (np.full((len(q), width), -1), np.full((len(q), width), -3.0)))
    x = np.repeat(np.eye(4), 10, 0) + np.random.default_rng(1).normal(size=(40, 4)) * 0.01
    x /= np.linalg.norm(x, axis=1)[:, None]
    graph, beam = embed_dedup._audited(x, 0.98)
    assert beam is None
    assert sum(len(hit) for _, hit in embed_dedup._near_ones(graph, x, x, np.full(40, -1), beam, 0.98)) == (x @ x.T >= 0.98).sum()


def test_recall_over_two_shards(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(20_000, 16))
    x[10_000:] = x[:10_000] + rng.normal(size=(10_000, 16)) * rng.choice([0.03, 0.06, 0.09], size=(10_000, 1))
    halves = [np.flatnonzero(rng.random(20_000) < 0.5)]
    halves.append(np.setdiff1d(np.arange(20_000), halves[0]))
    x /= np.linalg.norm(x, axis=1)[:, None]
    found = want = 0
    for half in halves:
        shard = embed_dedup.Shard(half, np.ones(len(half), int), x[half], 0.98)
        got = {i: c for i, c, _ in shard.links(np.arange(20_000), x)[::-1] if c}
        found += sum(got.values())
        want += sum(int((x[lo : lo + 1000] @ x[half].T >= 0.98).sum()) for lo in range(0, 20_000, 1000)) - len(half)
    assert found >= 0.95 * want


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = dict(map(tuple, common.components(spark.createDataFrame(chain, "u long, v long")).collect()))
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}
