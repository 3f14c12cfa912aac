"""Hard negatives, chat formatting and importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from paywright.llm import chat_format, hard_negatives, resample

VECTORS = "vec_id long, embedding array<double>, label int, shard int, score string, place int"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, lab, 7, "x", 1) for i, v, lab in rows], VECTORS).repartition(3)


def mined(df, **options):
    return sorted(tuple(r) for r in hard_negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, **options).collect())


def mined_plainly(rows, positives=5, negatives=5, low=80, anchor=lambda i: i % 10 == 0):
    kept = {}
    for i, v, lab in rows:
        if i is None or lab is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = (lab, [math.floor(256 * x) for x in v])
        kept[i] = min(kept.get(i, row), row)
    out = []
    for a, (lab, v) in kept.items():
        if not anchor(a):
            continue
        scores = sorted((-sum(x * y for x, y in zip(v, w)), i, other == lab) for i, (other, w) in kept.items() if i != a)
        for s, p, _ in [x for x in scores if x[2]][:positives]:
            found = [(i, -n) for n, i, same in scores if not same and low * -s <= 100 * -n <= 100 * -s]
            out += [(a, p, k + 1, i, -s, n) for k, (i, n) in enumerate(found[:negatives])]
    return sorted(out)


def random_vectors(rnd, n, dims=8, centres=6, spread=0.3):
    middle = [[rnd.gauss(0, 1) for _ in range(dims)] for _ in range(centres)]
    rows = []
    for i in range(n):
        c = rnd.choice(middle)
        size = rnd.choice([1, 1, 0.2, 5])
        rows.append((i, [size * (x + rnd.gauss(0, spread)) / dims for x in c], rnd.choice([0, 0, 1, 2, -3])))
    return rows


@pytest.mark.parametrize("shard_rows,bucket_rows", [(10_000, 1024), (40, 7)])
def test_negatives_equal_brute_force(spark, rnd, shard_rows, bucket_rows):
    rows = random_vectors(rnd, 300)
    rows += [(i, [0.5] * 8, i % 3) for i in range(300, 340)]  # a common vector under all labels
    rows += [(i, [0.0] * 8, i % 2) for i in range(340, 352)]
    rows += [(400, None, 1), (410, [0.1] * 8, None), (420, [0.1, None], 1), (430, [math.nan] * 8, 1), (440, [math.inf] * 8, 1)]
    rows += [(None, [0.1] * 8, 1), (450, [], 1), (460, [0.9], 1), (470, [0.2] * 11, 0), rows[10], rows[11], (20, [0.3] * 8, 2)]
    got = mined(vectors_of(spark, rows), shard_rows=shard_rows, bucket_rows=bucket_rows)
    assert got == mined_plainly(rows)
    assert got == mined(vectors_of(spark, rows[::-1]), shard_rows=shard_rows, bucket_rows=bucket_rows)


def test_large_components_stay_exact(spark, rnd):
    rows = [(i, [float(rnd.randint(-400_000, 400_000)) for _ in range(4)], i % 2) for i in range(60)]
    assert mined(vectors_of(spark, rows)) == mined_plainly(rows)


def test_no_vectors_no_negatives(spark):
    assert mined(vectors_of(spark, [])) == []
    assert mined(vectors_of(spark, [(0, [1.0], 1), (1, [1.0], 2)])) == []
    assert mined(vectors_of(spark, [(0, [1.0], 1), (1, [-1.0], 1), (2, [-1.0], 2)])) == []


def test_ranges_leave_most_rows_unscored():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    rows = np.floor(256 * (centres[rng.integers(0, 40, 4000)] + rng.normal(scale=0.1, size=(4000, 16))))
    buckets = hard_negatives.buckets_of(np.arange(4000), np.zeros(4000, np.int64), rows)
    some = hard_negatives.Anchors(np.arange(50), np.zeros(50, np.int64), rows[:50], 16)
    scored = everything = 0
    for bucket in buckets:
        which = np.arange(50)
        cosines = np.full(50, 0.95)
        seen = dict(hard_negatives.survivors(bucket, some, which, cosines))
        for a in which.tolist():
            real = np.flatnonzero(bucket.units @ (some.vectors[a] / some.lengths[a]) >= 0.95)
            assert set(real.tolist()) <= set(seen.get(a, np.empty(0, int)).tolist())
        scored += sum(map(len, seen.values()))
        everything += 50 * len(bucket.ids)
    assert scored < 0.1 * everything


CONTROL = ["<turn>", "</turn>", "<say>", "<\\turn>", "<\\\\/turn>", "<image:0>", "<image:12>", "<audio:", "\\", "<", ">", "\n", "tu", "rn>", "ok", "é", "", "</turn"]


def odd_text(rnd):
    return "".join(rnd.choice(CONTROL) for _ in range(rnd.randint(0, 9)))


def test_any_text_comes_back(rnd):
    for _ in range(3000):
        text = odd_text(rnd)
        assert chat_format.unescape(chat_format.escape(text)) == text
        assert not chat_format._CONTROL.search(chat_format.escape(text))
        writer = chat_format.Flattener(chat_format.Expansion(), ("assistant",))
        turns = [(rnd.choice(["user", "assistant", odd_text(rnd)]), [odd_text(rnd) if rnd.random() < 0.7 else None for _ in range(rnd.randint(0, 4))]) for _ in range(3)]
        blank = {"text": None, "ref": "r", "width": 30, "height": 28, "seconds": None, "pages": None}
        for role, parts in turns:
            writer.turn(role, [{**blank, "type": "image"} if p is None else {**blank, "type": "text", "text": p} for p in parts])
        whole, count, want = "".join(writer.out), iter(range(99)), []
        for role, parts in turns:
            merged = []
            for p in parts:
                if p is None:
                    merged.append(("image", str(next(count))))
                elif p and merged and merged[-1][0] == "text":
                    merged[-1] = ("text", merged[-1][1] + p)
                elif p:
                    merged.append(("text", p))
            want.append((role, merged))
        assert list(chat_format.read_back(whole)) == want
        learnt = "".join(chat_format.unescape(whole[a:b]) for a, b in writer.spans)
        assert learnt == "".join(p or "" for role, parts in turns for p in parts if role == "assistant")
        assert [a[3] for a in writer.attachments] == [2] * next(count)


def digests_plainly(rows):
    convs = {}
    first = lambda x: (x is not None, x)
    for conv, turn, role, text in sorted(rows, key=lambda r: (*map(first, r[:2]), r[2] or "")):
        convs.setdefault(conv, []).append((role or "", text or ""))
    out = {}
    for conv, turns in convs.items():
        said, learnt = "".join(f"{r}\n{t}\n" for r, t in turns), "".join(t for r, t in turns if r == "assistant")
        chars = sum(len(chat_format.escape(r)) + len(chat_format.escape(t)) + 19 for r, t in turns)
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), chars)
    return out


@pytest.mark.parametrize("piece_chars", [1 << 20, 40])
def test_conversations_come_back(spark, rnd, piece_chars):
    rows = [(rnd.randint(0, 20), k, rnd.choice(["user", "assistant", "system", None]), rnd.choice([odd_text(rnd), None, "x" * 500])) for k in range(200)]
    rows += [(99, k, "assistant" if k % 2 else "user", odd_text(rnd)) for k in range(400)]  # most rows are of one conversation
    rows += [(None, 1, "user", "a"), (None, 2, "assistant", "b"), (5, None, "user", "first"), (98, 1, "user", "twice"), (98, 1, "user", "twice")]
    rows += [(97, 1, "assistant", "long " * 300_000)]
    rnd.shuffle(rows)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, piece int, parts string").repartition(4)
    pieces = chat_format.format_conversations(df, chat_format.text_parts(df["text"]), piece_chars=piece_chars)
    got = {r[0]: tuple(r[1:]) for r in chat_format.digests(pieces).collect()}
    assert got == digests_plainly(rows)
    assert piece_chars > 40 or pieces.where("conv_id = 99").count() > 20
    assert chat_format.digests(chat_format.format_conversations(df.limit(0), chat_format.text_parts(df["text"]))).count() == 0


def test_attachments_are_recorded_in_order(spark):
    part = lambda kind, **more: {"type": kind, "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None, **more}
    parts = [part("text", text="see "), part("image", ref="a.png", width=57, height=28), part("text", text="<image:0>"), None, part("audio", ref="b.wav", seconds=1.5),
             part("document", ref="c.pdf", pages=3), part("image"), part("odd", text=" end"), part("odd")]
    df = spark.createDataFrame([(1, 0, "assistant", parts), (1, 1, "user", None)], f"conv_id long, turn long, role string, parts array<{chat_format.PART}>")
    (row,) = chat_format.format_conversations(df, df["parts"]).collect()
    assert row["formatted"] == "<turn>assistant<say>see <image:0><\\image:0><audio:1><document:2><image:3> end</turn>\n<turn>user<say></turn>\n"
    assert [tuple(a) for a in row["attachments"]] == [(0, "image", "a.png", 3), (1, "audio", "b.wav", 38), (2, "document", "c.pdf", 1536), (3, "image", None, 1)]
    assert [row["formatted"][a:b] for a, b in row["loss_spans"]] == ["see ", "<\\image:0>", " end"]


def features_plainly(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def resampled_plainly(docs, target):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = [0] * 10_000, [0] * 10_000
    for texts, into in ((docs, s), (target, t)):
        for _, text in texts:
            for f in features_plainly(text)[1]:
                into[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10_000) / ((a + 1) * (sum(t) + 10_000)))) for a, b in zip(s, t)]
    out, eligible = [], []
    for doc_id, text in docs:
        words, features = features_plainly(text)
        weight = sum(gain[bucket(f)] for f in features)
        score = None
        if doc_id is not None:
            h = int(hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
            if len(words) >= 20:
                eligible.append((-score, doc_id, len(out)))
        out.append([doc_id, len(features), weight, score, None])
    for rank, (_, _, at) in enumerate(sorted(eligible)[: 5 * len(eligible) // 100]):
        out[at][4] = rank + 1
    return sorted(map(repr, out))


def test_resampling_equals_brute_force(spark, rnd, docs_of, monkeypatch):
    words = ["Alpha", "beta", "x1", "Ünï", "日本", "--", "a_b", "I'll", "\x7f", "٣", "K"]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    docs = [(i, text(rnd.choice([3, 19, 20, 21, 60]))) for i in range(300)]
    docs += [(300, None), (301, ""), (302, "..."), (None, text(30)), (303, text(4000)), (-5, text(25)), (1 << 62, text(25)), (-(1 << 62), text(25))]
    docs += [(i, docs[3][1]) for i in range(400, 500)] + [docs[1], docs[2]]
    target = [(1, text(80)), (2, None), (3, "beta beta beta")]
    benchmark = spark.createDataFrame(target, "item_id long, text string")
    for piece in (1 << 20, 30):
        monkeypatch.setattr(resample, "PIECE", piece)
        got = resample.resample(docs_of(docs), benchmark)
        assert sorted(repr(list(r)) for r in got.collect()) == resampled_plainly(docs, target)
    assert resample.resample(docs_of(docs).limit(0), benchmark).count() == 0
    nothing = resample.resample(docs_of(docs), benchmark.limit(0))
    assert sorted(repr(list(r)) for r in nothing.collect()) == resampled_plainly(docs, [])


@pytest.mark.parametrize("bits,block_rows", [(2, 16), (11, 64), (5, 1 << 15)])
def test_radix_ranks_equal_a_sort(spark, bits, block_rows):
    rnd = random.Random(bits)
    ends = [-(1 << 63), (1 << 63) - 1, 0, -1]
    rows = [(rnd.choice([7] * 5 + [rnd.randint(-500, 500)]), i) for i in rnd.sample(range(-2000, 2000), 700)]
    rows += [(3, e) for e in ends] if bits > 2 else []
    df = spark.createDataFrame(rows, "a long, b long").repartition(5)
    got = [(r["a"], r["b"]) for r in resample.radix_ranked(df, [("a", True), ("b", False)], bits, block_rows).orderBy("rank").collect()]
    assert got == sorted(rows, key=lambda r: (-r[0], r[1]))
    same = resample.radix_ranked(spark.createDataFrame([(1, 1)] * 50, "a long, b long").repartition(3), [("a", True), ("b", False)], bits, block_rows)
    assert sorted(r["rank"] for r in same.collect()) == list(range(1, 51))
