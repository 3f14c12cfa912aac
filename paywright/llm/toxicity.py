"""Toxicity by weak supervision: voters, a generative model of their votes, a linear classifier on its posterior."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from paywright.llm.common import Unions, arrow_batches, fit_logistic, fold, labelled_sample, logistic

PER_CLASS = 3000
MAX_TRAIN_BYTES = 32 << 10
MINED = 160
CHANCE = 3.0
THRESHOLD = 0.3
WORD = re.compile(r"[^\W\d_]+")
STEMS = (4, 5, 6)

#: Seed lexicon: words of abuse.
ABUSE = ("idiot", "moron", "stupid", "loser", "scum", "trash", "clown", "pathetic", "disgusting", "worthless", "dumb", "fool", "garbage", "hate", "ugly", "shut")

#: Pattern voters, over whole texts. All are linear in the text.
PATTERNS = (
    re.compile(r"\byou(?:'re| are)? (?:an? |all |such )?(?:" + "|".join(ABUSE) + r")", re.I),
    re.compile(r"\b[A-Za-z][*#@$]{2,}[A-Za-z]{0,8}\b"),
    re.compile(r"!{3,}"),
    re.compile(r"\b(?:kill|hurt|destroy) (?:you|them|him|her|yourself)\b", re.I),
    re.compile(r"\bgo to hell\b|\bshut up\b", re.I),
)


def keys(text: str) -> Counter:
    """Lower-case words and word beginnings of a text with their numbers; a beginning is written with a star."""
    words = Counter(WORD.findall(text.lower()))
    out = Counter(words)
    for word, n in words.items():
        for k in STEMS:
            if len(word) > k:
                out[word[:k] + "*"] += n
    return out


def mine(rows: list[tuple[str, int]], most: int = MINED) -> list[str]:
    """Words and word beginnings that mark toxic texts of the training rows, each covering texts the others miss.

    A key qualifies when its share among toxic texts is ten times that among the others and chance would not bring any
    key that far: the bound on its probability at the base rate, times the number of keys tried, is below e^-3. Keys are taken by how many toxic texts with fewer than two hits they add, ties by key.
    """
    toxic = [t for t, y in rows if y == 1]
    seen = Counter(k for t in toxic for k in set(keys(t)))
    often = {k for k, n in seen.items() if n >= 3}
    clean = Counter(k for t, y in rows if y == 0 for k in often.intersection(keys(t)))
    n_clean = max(1, len(rows) - len(toxic))
    bar = np.log(max(2, len(often))) + CHANCE
    base = min(max(len(toxic) / max(1, len(rows)), 1e-6), 1 - 1e-6)
    good = {k for k in often if seen[k] / len(toxic) >= 10 * clean[k] / n_clean and _surprise(seen[k], seen[k] + clean[k], base) >= bar}
    holders: dict[str, list[int]] = {}
    for i, text in enumerate(toxic):
        for k in good.intersection(keys(text)):
            holders.setdefault(k, []).append(i)
    hits = np.zeros(len(toxic), int)
    picked: list[str] = []
    while holders and len(picked) < most:
        gain = {k: int((hits[v] < 2).sum()) for k, v in holders.items()}
        best = min(gain, key=lambda k: (-gain[k], k))
        if gain[best] == 0:
            break
        hits[holders.pop(best)] += 1
        picked.append(best)
    return picked


def _surprise(hits: int, of: int, rate: float) -> float:
    """Bound on -log of the chance of so many hits among ``of`` at a base rate (Chernoff)."""
    share = hits / of
    if share <= rate:
        return 0.0
    rest = (1 - share) * np.log((1 - share) / (1 - rate)) if share < 1 else 0.0
    return of * (share * np.log(share / rate) + rest)


class LabelModel:
    """Generative model of binary votes: how often voters fire on texts of either kind, and what they have in common.

    Toxic texts are of several kinds that share no voters (languages, say). Voters that fire together beyond chance form a
    group, and each group is a mixture of two classes of its own: texts of its kind of toxicity, and all others.
    ``fire[c, j]`` is how often voter j fires in class c of its group (its accuracy in either direction); rates and the
    share of the class come from expectation maximisation, started with texts that several voters of the group agree on.
    A voter that agrees with none says nothing: both its rates are its overall one.

    Correlations are what votes of a group share beyond the classes: those of the residuals that exceed their sampling
    error. The log odds of correlated voters count by the share that is left to each when all are used together (the
    solution of the correlation matrix), so that two voters that say the same count once.

    A text is toxic unless it is in no group's class. ``prior`` is the posterior of all texts if there are no groups.
    """

    def __init__(self, votes: np.ndarray, prior: float, weight: np.ndarray | None = None, rounds: int = 25):
        n, m = votes.shape
        self.prior = float(np.clip(prior, 1e-3, 1 - 1e-3))
        weight = np.ones(n) if weight is None else weight
        weight = weight * (n / weight.sum())
        mean = np.clip(weight @ votes / n, 1e-4, 1 - 1e-4)
        self.fire = np.stack([mean, mean])
        self.discount, self.correlations = np.ones(m), np.zeros((m, m))
        self.shares: list[float] = []
        self.groups = _agreeing(votes)
        for group in self.groups:
            self._fit(votes[:, group], weight, group, rounds)

    def _fit(self, votes: np.ndarray, weight: np.ndarray, group: np.ndarray, rounds: int) -> None:
        n = len(votes)
        mean = weight @ votes / n
        post = np.array([0.01, 0.3, 0.95])[np.minimum(votes.sum(1), 2).astype(int)]
        self.shares.append(0.0)
        for _ in range(rounds):
            mass = np.array([weight @ (1 - post), weight @ post])
            self.shares[-1] = float(np.clip(mass[1] / n, 1e-4, 0.5))
            # Each rate keeps a little of the voter's overall one, so that none rests on nothing.
            fire = np.stack([(weight * (1 - post)) @ votes, (weight * post) @ votes]) + 2 * mean
            self.fire[:, group] = np.clip(fire / (mass[:, None] + 2), 1e-4, 1 - 1e-4)
            self._correlate(votes, post, weight, group)
            post = self._of_group(votes, group, self.shares[-1])

    def _correlate(self, votes: np.ndarray, post: np.ndarray, weight: np.ndarray, group: np.ndarray) -> None:
        n, m = votes.shape
        fire = self.fire[:, group]
        rest = (votes - (post[:, None] * fire[1] + (1 - post[:, None]) * fire[0])) * np.sqrt(weight)[:, None]
        sd = np.sqrt((rest**2).mean(0)) + 1e-6
        corr = rest.T @ rest / n / np.outer(sd, sd)
        np.fill_diagonal(corr, 0)
        corr = np.where(np.abs(corr) > max(0.05, 4 / np.sqrt(n)), np.clip(corr, -0.95, 0.95), 0.0)
        gain = (fire[1] - fire[0]) / sd
        left = np.linalg.lstsq(corr + np.eye(m) * 1.05, gain, rcond=None)[0] * 1.05
        self.correlations[np.ix_(group, group)] = corr
        self.discount[group] = np.clip(np.where(np.abs(gain) > 1e-9, left / np.where(np.abs(gain) > 1e-9, gain, 1.0), 1.0), 0.0, 1.0)

    def _of_group(self, votes: np.ndarray, group: np.ndarray, share: float) -> np.ndarray:
        fire, discount = self.fire[:, group], self.discount[group]
        on = np.log(fire[1] / fire[0]) * discount
        off = np.log((1 - fire[1]) / (1 - fire[0])) * discount
        return logistic(votes @ on + (1 - votes) @ off + np.log(share / (1 - share)))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        if not self.groups:
            return np.full(len(votes), self.prior)
        clean = np.ones(len(votes))
        for group, share in zip(self.groups, self.shares, strict=True):
            clean *= 1 - self._of_group(votes[:, group], group, share)
        return 1 - clean


def _agreeing(votes: np.ndarray) -> list[np.ndarray]:
    """Groups of voters that fire together more often than chance: connected by correlations beyond their sampling error."""
    n, m = votes.shape
    sure = votes.sum(0) >= 3
    rest = (votes - votes.mean(0)) / (votes.std(0) + 1e-9)
    linked = (rest.T @ rest / n > max(0.05, 4 / np.sqrt(n))) & np.outer(sure, sure)
    unions = Unions(m)
    for i, j in np.argwhere(np.triu(linked, 1)).tolist():
        unions.join(i, j)
    roots = np.array([unions.root(i) for i in range(m)])
    groups = [np.flatnonzero(roots == r) for r in np.unique(roots)]
    return [g for g in groups if len(g) > 1]


class ToxicModel:
    """``counts`` are the learnable labels of either kind, of which ``rows`` may be a sample: the model takes the share of
    the toxic class from them, and texts weigh what they stand for, so that a larger table moves no score."""

    def __init__(self, rows: list[tuple[str, int]], counts: dict[int, int] | None = None):
        lexicon = list(dict.fromkeys([*ABUSE, *mine(rows)]))
        self.index = {k: j for j, k in enumerate(lexicon)}
        self.width = len(lexicon) + len(PATTERNS)
        self.weights = None
        y = np.array([label for _, label in rows], int)
        drawn = np.bincount(y, minlength=2)
        counts = {v: int(drawn[v]) for v in (0, 1)} if counts is None else counts
        self.constant = counts[1] / max(1, counts[0] + counts[1])
        if len(rows) < 8 or y.min() == y.max():
            return
        weight = np.array([counts[v] / drawn[v] for v in (0, 1)])[y]
        weight /= weight.mean()
        found = [self.votes(t) for t, _ in rows]
        votes = np.stack([v for v, _ in found])
        words = np.array([n for _, n in found])
        self.labels = LabelModel((votes > 0).astype(float), self.constant, weight)
        posterior = self.labels.posterior((votes > 0).astype(float))
        self.weights = fit_logistic(self._features(votes, words), posterior, weight, ridge=0.5)
        # Posterior labels set the direction; the training labels only place the scale (two numbers).
        self.scale = fit_logistic(self._margin(votes, words)[:, None], y.astype(float), weight, ridge=1e-2)

    def votes(self, text: str) -> tuple[np.ndarray, int]:
        """Hits of every voter, and the number of words."""
        out = np.zeros(self.width)
        words = Counter(WORD.findall(text.lower()))
        index = self.index
        for word, n in words.items():
            if word in index:
                out[index[word]] += n
            if len(word) > 4:
                for k in STEMS:
                    if len(word) > k and word[:k] + "*" in index:
                        out[index[word[:k] + "*"]] += n
        for j, pattern in enumerate(PATTERNS, len(index)):
            out[j] = pattern.search(text) is not None
        return out, sum(words.values())

    def _features(self, votes: np.ndarray, words: np.ndarray) -> np.ndarray:
        hits = votes.sum(1)
        return np.column_stack([votes > 0, np.log1p(hits), hits > 0, 20 * hits / (words + 20)])

    def _margin(self, votes: np.ndarray, words: np.ndarray) -> np.ndarray:
        x = self._features(votes, words)
        return np.clip(np.column_stack([x, np.ones(len(x))]) @ self.weights, -15, 15)

    def score(self, texts: list[str]) -> np.ndarray:
        if self.weights is None or not texts:
            return np.full(len(texts), self.constant)
        found = [self.votes(t) for t in texts]
        margin = self._margin(np.stack([v for v, _ in found]), np.array([n for _, n in found]))
        return logistic(margin * self.scale[0] + self.scale[1])


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> ToxicModel:
    """Learns from at most ``per_class`` texts of each label, none of them from the held-out fold or above 32 KiB (longer
    ones are scored like all others)."""
    return ToxicModel(*labelled_sample(docs, labels, "toxic", fold(4, 2), per_class, MAX_TRAIN_BYTES))


def score(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    Whole texts are read. Null and empty texts get the score of a text without votes. With fewer than eight labelled
    rows, or labels of one kind only, every score is the share of toxic labels. Repeated rows and null ids stay.
    """
    model = train(docs, labels, per_class)
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            p = model.score(batch.pop("text").fillna("").tolist())
            yield batch.assign(score=p, predicted=(p >= THRESHOLD).astype("int32"))

    kind = docs.schema["doc_id"].dataType.simpleString()
    chosen = docs.select("doc_id", fold(4, 2).alias("held_out"), docs["text"].cast("string"))
    return chosen.mapInPandas(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
