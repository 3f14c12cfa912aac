"""Language identification by rank-order n-gram profiles and their out-of-place distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paywright.llm.common import arrow_batches, fold

KEYS = 1 << 18
PROFILE = 400
TOP = 300
UNKNOWN = "und"
#: Characters of texts handled at a time.
GROUP_CHARS = 1 << 20


def letter_table() -> np.ndarray:
    """Code point to itself for letters, to 0 (a word border) for everything else."""
    return np.array([c if chr(c).isalpha() else 0 for c in range(0x110000)], np.uint32)


_LETTERS: list[np.ndarray] = []


def letters(text: str) -> np.ndarray:
    """Code points of the lower-case text, everything but letters as 0, with a border at both ends."""
    if not _LETTERS:
        _LETTERS.append(letter_table())
    points = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "replace"), np.uint32)
    return _LETTERS[0][points]


def ngram_keys(a: np.ndarray) -> np.ndarray:
    """Hashed letters, pairs and triples of a letter array. A border may stand at either end, not inside."""
    a = a.astype(np.uint64)
    one = a[a > 0]
    two = (a[:-1] << np.uint64(21)) | a[1:]
    two = two[(a[:-1] > 0) | (a[1:] > 0)] | np.uint64(1 << 62)
    three = (((a[:-2] << np.uint64(21)) | a[1:-1]) << np.uint64(21)) | a[2:]
    three = three[a[1:-1] > 0]
    mixed = np.concatenate([one, two, three]) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(46)).astype(np.uint32)


def counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, count) of all n-grams, ordered by row, count downwards and key: the ranks of each row's n-grams."""
    parts = [ngram_keys(letters(t)) for t in texts]
    rows = np.repeat(np.arange(len(parts), dtype=np.uint64), [len(p) for p in parts])
    both = np.sort((rows << np.uint64(18)) | np.concatenate([*parts, np.zeros(0, np.uint32)]))
    first = np.flatnonzero(np.diff(both, prepend=np.uint64(1 << 63)))
    counts = np.diff(np.append(first, len(both)))
    both = both[first]
    row, key = both >> np.uint64(18), both & np.uint64(KEYS - 1)
    order = np.argsort((row << np.uint64(42)) | (np.uint64((1 << 24) - 1) - np.minimum(counts, (1 << 24) - 1).astype(np.uint64)) << np.uint64(18) | key)
    return row[order].astype(np.int64), key[order].astype(np.int64), counts[order]


def _groups(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    run: list[str] = []
    start = held = 0
    for i, text in enumerate(texts):
        if run and held + len(text) > GROUP_CHARS:
            yield start, run
            run, start, held = [], i, 0
        run.append(text)
        held += len(text)
    if run:
        yield start, run


def profiles(docs: DataFrame, size: int = PROFILE) -> dict[str, list[int]]:
    """The ``size`` most frequent n-grams of each language over every document of the learning folds, in rank order.

    A task adds up what it has seen per language before anything is shuffled; what is shuffled is bounded by the number
    of languages and keys, not by the corpus.
    """
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                total = held.setdefault(lang, np.zeros(KEYS, np.int64))
                for _, group in _groups(texts.tolist()):
                    total += np.bincount(np.concatenate([ngram_keys(letters(t)) for t in group]), minlength=KEYS)
            if len(held) > 32:
                yield from _totals(held)
                held = {}
        yield from _totals(held)

    learn = docs.select(docs["lang"].cast("string").alias("lang"), docs["text"].cast("string").alias("text"), "doc_id")
    learn = learn.where(~fold(4, 2) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    counts = learn.mapInPandas(run, "lang string, key int, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "key"))).where(F.col("rank") <= size)
    out: dict[str, list[int]] = {}
    for r in ranked.orderBy("lang", "rank").collect():
        out.setdefault(r["lang"], []).append(r["key"])
    return out


def _totals(held: dict[str, np.ndarray]) -> Iterator[pd.DataFrame]:
    for lang, total in held.items():
        key = np.flatnonzero(total)
        yield pd.DataFrame({"lang": lang, "key": key.astype("int32"), "n": total[key]})


class RankModel:
    def __init__(self, found: dict[str, list[int]], top: int = TOP):
        self.langs = sorted(found)
        self.top = top
        #: Rank of every key in each language; absent keys are as far out of place as can be.
        self.far = max([top, *map(len, found.values())])
        self.ranks = np.full((len(self.langs), KEYS), self.far, np.int32)
        for i, lang in enumerate(self.langs):
            self.ranks[i, found[lang]] = np.arange(len(found[lang]))

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of every text: the score is the softmax of the distances' closeness."""
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.langs:
            return names, scores
        for start, group in _groups(texts):
            row, key, _ = counted(group)
            if not len(row):
                continue
            heads = np.flatnonzero(np.diff(row, prepend=-1))
            rank = np.arange(len(row)) - np.repeat(heads, np.diff(np.append(heads, len(row))))
            keep = rank < self.top
            row, key, rank = row[keep], key[keep], rank[keep]
            heads = np.flatnonzero(np.diff(row, prepend=-1))
            n = np.diff(np.append(heads, len(row)))
            away = np.stack([np.add.reduceat(np.minimum(np.abs(r[key] - rank), self.far), heads) for r in self.ranks]) / (n * self.far)
            best = away.argmin(0)
            close = np.exp(-20 * (away - away.min(0)))
            for i, b, p in zip(row[heads], best, 1 / close.sum(0), strict=True):
                names[start + i], scores[start + i] = self.langs[b], p
        return names, scores


def identify(docs: DataFrame, profile: int = PROFILE, top: int = TOP) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of ``docs``.

    Profiles come from every row outside the held-out fold with a language and a text. A null text or one without
    letters is ``und`` with score 0, and so is every text if there is nothing to learn from. Of languages equally near,
    the first by name is taken; n-grams of equal count rank by key. Repeated rows and null ids stay.
    """
    model = RankModel(profiles(docs, profile), top)
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names, scores = model.predict(batch.pop("text").fillna("").tolist())
            yield batch.assign(lang_pred=names, score=scores)

    kind = docs.schema["doc_id"].dataType.simpleString()
    chosen = docs.select("doc_id", fold(4, 2).alias("held_out"), docs["text"].cast("string"))
    return chosen.mapInPandas(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
