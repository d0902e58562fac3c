"""Toxicity by weak supervision.

Many voters say of a document that it is toxic, or abstain: words of a fixed lexicon, fixed
patterns of a word's spelling, and word beginnings mined from labelled rows of the training fold.
A generative label model (two classes, a rate of firing for each voter and class) is fitted to their
votes by expectation maximisation, the annotator's label being one voter more. What is left of the
covariance of two voters within a class gives their correlation; a voter counts for its share among
those that it goes with. The posteriors of that model are the labels on which a linear classifier of
the voters' hits is trained, together with one virtual text for each voter, which carries the label
model's estimate of that voter. It scores every whole text.

All fitting is on a bounded sample of labelled rows: TRAIN_ROWS or so of each label and at most three
times as many in all, of at most TRAIN_BYTES bytes, which makes up to 150 MB on the driver. Held-out
rows are never read for it.

Defined results: null counts as the empty text, which has no hit and gets the score of a text
without hits. Without labels the lexicon and the patterns vote alone. Rows of equal texts get equal
scores. Several or contradicting labels of one doc_id count as its largest. An empty table gives an
empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import carried, text_or_empty

TRAIN_ROWS = 3000
TRAIN_BYTES = 16_384
MINED = 192
#: A mined word beginning must occur in that many different toxic texts, and be that pure.
LEAST_TEXTS, LEAST_PURITY = 3, 0.9
BEGINNINGS = (3, 4, 5, 6)
CACHE_ROWS = 200_000
RIDGE = 0.01
#: The value of the one feature of a virtual text: two hits of one voter.
VIRTUAL_HITS = float(np.log2(3))

LEXICON = tuple(
    "idiot moron stupid dumb loser clown scum trash garbage filth vermin pathetic worthless disgusting imbecile jerk bastard "
    "bitch asshole crap retard freak creep coward liar pig hateful "
    "dumm trottel abschaum arschloch dreckig wertlos versager schwein "
    "imbécile débile connard salaud ordure minable dégueulasse crétin "
    "idiota estúpido imbécil escoria payaso asqueroso cabrón inútil".split()
)
#: name: spelling of a word that it votes on
PATTERNS = {
    "masked": re.compile(r"[^\W\d_]+[*@$#!]{1,4}[^\W\d_]{2,}"),
    "stretched": re.compile(r".*([^\W\d_])\1\1\1.*"),
    "shouted": re.compile(r"[^\w]*[A-ZÀ-Þ]{3,}!{2,}"),
}
_LETTERS = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    """Voters and the classifier. voters: kind and value of each."""

    voters: list[tuple[str, str]]
    weights: np.ndarray
    bias: float
    accuracy: np.ndarray  # of each voter: P(toxic | it fires), by the label model

    def lookup(self) -> tuple[dict[str, int], dict[int, dict[str, int]], list[tuple[int, re.Pattern]]]:
        words = {v: i for i, (k, v) in enumerate(self.voters) if k == "word"}
        starts: dict[int, dict[str, int]] = {}
        for i, (k, v) in enumerate(self.voters):
            if k == "start":
                starts.setdefault(len(v), {})[v] = i
        return words, starts, [(i, PATTERNS[v]) for i, (k, v) in enumerate(self.voters) if k == "pattern"]


class Voter(dict):
    """token: the voters that it makes fire; kept for at most CACHE_ROWS tokens."""

    def __init__(self, model: Model):
        super().__init__()
        self.words, self.starts, self.patterns = model.lookup()

    def __missing__(self, token: str) -> tuple[int, ...]:
        hits = [i for i, p in self.patterns if p.fullmatch(token)]
        for word in _LETTERS.findall(token.lower()):
            if word in self.words:
                hits.append(self.words[word])
            for n, held in self.starts.items():
                i = held.get(word[:n])
                if i is not None:
                    hits.append(i)
        if len(self) > CACHE_ROWS:
            self.clear()
        if len(token) <= 64:
            self[token] = tuple(hits)
        return tuple(hits)

    def hits(self, text: str) -> Counter:
        found: Counter = Counter()
        for h in filter(None, map(self.__getitem__, text.split())):
            found.update(h)
        return found


def features(hits: Counter, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(voters that fire, values): the more often the higher, up to a point."""
    at = np.fromiter(hits.keys(), np.int64, len(hits))
    return at, np.minimum(np.log2(1 + np.fromiter(hits.values(), float, len(hits))), 2.0)


def fold(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 5


def sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> list:
    """At most rows of each label, of the training fold, by a hash of doc_id: text and label."""
    own = labels.where("toxic in (0, 1) and doc_id is not null").where(fold(F.col("doc_id")) != 0)
    own = own.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_toxic"))
    sizes = {r._toxic: r["count"] for r in own.groupBy("_toxic").count().collect()}
    draw = F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1 << 30))
    share = [int(min(1.0, rows / max(1, sizes.get(k, 0))) * (1 << 30)) for k in (0, 1)]
    drawn = own.where(draw < F.when(F.col("_toxic") == 1, share[1]).otherwise(share[0])).orderBy(draw, "doc_id").limit(3 * rows)
    texts = docs.where(F.octet_length(text_or_empty()) <= TRAIN_BYTES).select("doc_id", text_or_empty().alias("text"))
    # at most 3 * TRAIN_ROWS pairs of numbers
    return texts.join(F.broadcast(drawn.withColumnRenamed("doc_id", "_id")), F.expr("doc_id = _id")).orderBy("doc_id", "text").select("text", "_toxic").limit(3 * rows).collect()


def _one_of_each(texts: list[str]) -> list[str]:
    """One text of each family of near copies, told by the least hash of its word triples."""
    out: dict[object, str] = {}
    for t in texts:
        words = t.lower().split()
        triples = {" ".join(words[i : i + 3]) for i in range(len(words) - 2)}
        out.setdefault(min((zlib.crc32(x.encode()) for x in triples), default=t), t)
    return list(out.values())


def mine(toxic: list[str], clean: list[str], most: int = MINED) -> list[str]:
    """Beginnings of words that mark toxic texts: a cover of those, three deep where it can be.

    A beginning must be pure, and too often in toxic texts for chance among all that were tried.
    """

    def marks(text: str) -> set[str]:
        words = set(_LETTERS.findall(text.lower()))
        return {w[:n] for w in words for n in BEGINNINGS if len(w) >= n}

    toxic, clean = _one_of_each(toxic), _one_of_each(clean)
    if not toxic or not clean:
        return []
    seen = Counter(m for t in toxic for m in marks(t))
    tried = math.log(len(seen) + 1) + 1
    seen = {m: n for m, n in seen.items() if n >= LEAST_TEXTS}
    against = Counter(m for t in clean for m in marks(t) if m in seen)
    base = len(toxic) / (len(toxic) + len(clean))

    def good(n: int, c: int) -> bool:
        p = n / (n + c)
        gain = n * math.log(p / base) + (c * math.log((1 - p) / (1 - base)) if c else 0)
        return p >= LEAST_PURITY and gain >= tried

    kept = {m for m, n in seen.items() if good(n, against[m])}
    where: dict[str, list[int]] = {}
    for k, t in enumerate(toxic):
        for m in marks(t) & kept:
            where.setdefault(m, []).append(k)
    need, chosen = [3] * len(toxic), []
    gain = {m: len(ks) for m, ks in where.items()}
    while gain and len(chosen) < most:
        m = max(gain, key=lambda x: (gain[x], -against[x], -len(x), x))
        gain[m], before = sum(need[k] > 0 for k in where[m]), gain[m]
        if gain[m] < before:
            continue
        if before < LEAST_TEXTS:
            break
        chosen.append(m)
        for k in where[m]:
            need[k] -= 1
        del gain[m]
    return chosen


def label_model(votes: np.ndarray, gold: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of each row, P(toxic | fires) of each voter, share of each voter in its correlated group).

    votes: rows by voters, 1 where it fires; a voter that abstains says nothing. gold: the
    annotator's vote, 1 or 0, or -1 where there is none.
    """
    v = votes.astype(float)
    shares = np.ones(v.shape[1])
    posterior = np.where(gold >= 0, 0.05 + 0.9 * gold, np.clip(0.05 + 0.3 * v.sum(1), 0, 0.95))
    for turn in range(2):
        for _ in range(rounds):
            prior = np.clip(posterior.mean(), 1e-3, 1 - 1e-3)
            rate = [(w @ v + 0.2 * v.mean(0) + 1e-4) / (w.sum() + 0.2 + 2e-4) for w in (1 - posterior, posterior)]
            said = [(w[gold >= 0] @ (gold[gold >= 0] == k) + 1) / (w[gold >= 0].sum() + 2) for k, w in ((0, 1 - posterior), (1, posterior))]
            said = [max(0.95, min(0.99, x)) for x in said]  # the annotator errs now and then
            odds = np.log(prior / (1 - prior)) + v @ (shares * np.clip(np.log(rate[1] / rate[0]), -4, 4))
            odds += np.where(gold == 1, np.log(said[1] / (1 - said[0])), np.where(gold == 0, np.log((1 - said[1]) / said[0]), 0))
            new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
            moved, posterior = np.abs(new - posterior).max(), new
            if moved < 1e-4:
                break
        if turn == 0:
            # covariance that the class does not explain, as a correlation
            total = np.zeros((v.shape[1],) * 2)
            for k, w in ((0, 1 - posterior), (1, posterior)):
                centred = (v - rate[k]) * np.sqrt(w)[:, None]
                total += centred.T @ centred
            deviation = np.sqrt(np.maximum(np.diag(total), 1e-9))
            correlation = total / deviation[:, None] / deviation[None, :]
            shares = 1 / np.maximum(1.0, np.where(correlation > 0.3, correlation, 0).sum(1))
    fires = prior * rate[1] / (prior * rate[1] + (1 - prior) * rate[0])
    return posterior, fires, shares


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = RIDGE, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Weights and bias by Newton's method; y may lie between 0 and 1. No weight is below zero: a
    voter that would speak for clean texts is left out."""
    use = np.flatnonzero(x.any(0))
    weight = weight / weight.mean()
    while True:
        a = np.concatenate([x[:, use], np.ones((len(x), 1))], 1)
        penalty = np.diag([ridge] * len(use) + [1e-6])
        w = np.zeros(a.shape[1])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            curve = (a * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ a + penalty
            step = np.linalg.solve(curve, a.T @ (weight * (y - p)) - penalty @ w)
            w += step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
            if np.abs(step).max() < 1e-6:
                break
        if not len(use) or w[:-1].min() >= 0:
            out = np.zeros(x.shape[1])
            out[use] = w[:-1]
            return out, float(w[-1])
        use = use[w[:-1] > 0]


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    taken = sample(docs, labels, rows)
    toxic, clean = ([r.text for r in taken if r._toxic == k] for k in (1, 0))
    voters = [("word", w) for w in LEXICON] + [("pattern", p) for p in PATTERNS] + [("start", m) for m in mine(toxic, clean) if m not in LEXICON]
    model = Model(voters, np.zeros(len(voters)), 0.0, np.zeros(len(voters)))
    unique = list({t: k for k, held in ((0, clean), (1, toxic)) for t in held}.items())
    if not toxic:  # nothing learned: a text needs two hits
        model.weights, model.bias = np.full(len(voters), 2.0), -3.0
        return model
    voter = Voter(model)
    x, gold = np.zeros((len(unique), len(voters))), np.array([k for _, k in unique])
    for i, (text, _) in enumerate(unique):
        at, value = features(voter.hits(text), len(text))
        x[i, at] = value
    posterior, model.accuracy, shares = label_model(x > 0, gold)
    # a virtual text for each voter, which it alone fires for, with the label model's word on it: a
    # voter that the sample hardly knows keeps the weight that its estimated accuracy gives it
    alone = np.eye(len(voters)) * VIRTUAL_HITS
    w, model.bias = logistic(np.concatenate([x, alone]) * shares, np.concatenate([posterior, model.accuracy]), np.ones(len(unique) + len(voters)))
    model.weights = w * shares
    return model


_voters: dict[int, Voter] = {}


def with_score(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """docs with the probability that each whole text is toxic."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # some hundred voters

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        m = sent.value
        key = hash((tuple(m.voters), m.weights.tobytes()))
        if key not in _voters:
            _voters.clear()
            _voters[key] = Voter(m)
        voter, odds = _voters[key], []
        for text in texts:
            text = text.as_py()
            at, value = features(voter.hits(text), len(text))
            odds.append(m.bias + float(m.weights[at] @ value))
        return pa.array(1 / (1 + np.exp(-np.clip(odds, -30, 30))), pa.float64())

    return docs.withColumn(out, scored(text_or_empty()))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted."""
    out = with_score(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that are not predicted toxic, with all their columns."""
    return with_score(carried(docs, "text"), fit(docs, labels)).where("score < 0.5").select("_all.*")
