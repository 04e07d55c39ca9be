"""Toxicity classifier with a counterfactual penalty.

A logistic model over the presence of words and parts of words. Every labelled text that names an
identity group is also seen with the group exchanged in its sentences, and every text of a part of
the sample with a neutral mention of a group added; the loss adds the squared change of the score.
Group names thus can't carry a label by themselves, whatever texts they happen to stand in.

The model is fitted on a bounded sample (``sample_rows`` and ``n_features``); scoring is a map over
whole documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of groups that are exchanged for each other, by kind.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"), ("woman", "man", "girl", "boy"), ("female", "male"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab"), ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("immigrants", "refugees", "natives", "foreigners"), ("old", "young", "disabled", "blind", "deaf"),
    ("frauen", "männer"), ("femmes", "hommes"), ("mujeres", "hombres"),
)
_PEERS = {term: tuple(t for t in group if t != term) for group in IDENTITY_TERMS for term in group}
_WORD, _SENTENCE = re.compile(r"\w+"), re.compile(r"(?<=[.!?\n])")
#: Raw tokens whose features a worker remembers before it starts anew.
REMEMBERED = 300_000
LONGEST_REMEMBERED = 100
#: Parts of words have these lengths; a word's own start and end count as characters.
PARTS = (4, 5)


def word_features(word: str) -> set[str]:
    """The word, marked off, and its parts."""
    marked = f"^{word}$"
    return {marked} | {marked[i : i + n] for n in PARTS for i in range(len(marked) - n + 1)}


def _raw_features(token: str) -> set[str]:
    out: set[str] = set()
    for word in _WORD.findall(token.lower()):
        out |= word_features(word)
    return out


def text_features(text: str | None) -> set[str]:
    """Features present in a whole text; none for null."""
    out: set[str] = set()
    for token in set((text or "").split()):
        out |= _raw_features(token)
    return out


def counterfactual(text: str, turn: int = 0) -> str:
    """The text with every identity term of its sentences exchanged for another of its kind."""

    def swapped(m: re.Match) -> str:
        peers = _PEERS.get(m[0].lower())
        return peers[turn % len(peers)] if peers else m[0]

    return "".join(_WORD.sub(swapped, s) for s in _SENTENCE.split(text))


@dataclass
class ToxicityModel:
    """Weights by feature; plain data, of at most ``n_features`` and the identity terms."""

    bias: float
    weights: dict[str, float]
    index: dict[str, int] = field(init=False)
    known: dict[str, tuple[str, ...]] = field(init=False, default_factory=dict)

    def __post_init__(self) -> None:
        self.index = {f: i for i, f in enumerate(self.weights)}

    def present(self, text: str | None) -> set[str]:
        out: set[str] = set()
        known = self.known
        for token in set((text or "").split()):
            got = known.get(token)
            if got is None:
                got = tuple(f for f in _raw_features(token) if f in self.weights)
                if len(token) <= LONGEST_REMEMBERED:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[token] = got
            if got:
                out.update(got)
        return out

    def score(self, text: str | None) -> float:
        logit = self.bias + sum(self.weights[f] for f in sorted(self.present(text)))
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, logit))))


def _sample(docs: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """At most ``sample_rows`` labelled texts, those of least hash; equal texts count once."""
    judged = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.avg("toxic") > 0.5).cast("int").alias("label"))
    picked = judged.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "label").dropDuplicates(["text"])


def _select_features(sample: DataFrame, n_features: int, least_texts: int) -> tuple[list[str], float]:
    """Features whose presence tells most about the label, and the share of label 1."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            all_texts, toxic = Counter(), Counter()
            for text, label in zip(batch["text"], batch["label"], strict=True):
                present = text_features(text)
                all_texts.update(present)
                if label:
                    toxic.update(present)
            if all_texts:  # texts without words have no features
                yield pd.DataFrame({"feature": list(all_texts), "n": list(all_texts.values()), "n_toxic": [toxic[f] for f in all_texts]})

    totals = sample.agg(F.count("*").alias("n"), F.sum("label").alias("toxic")).first()
    n, toxic = totals["n"], totals["toxic"] or 0
    if not n:
        return [], 0.0
    share = toxic / n
    counts = sample.repartition(16).mapInPandas(counted, "feature string, n bigint, n_toxic bigint").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic"))
    # Departure from the mean share in standard deviations.
    z = F.abs(F.col("n_toxic") - F.col("n") * share) / F.sqrt(F.col("n") * max(share * (1 - share), 1e-9))
    best = counts.where(F.col("n") >= least_texts).select("feature", z.alias("z")).orderBy(F.desc("z"), "feature").limit(n_features)
    return [r["feature"] for r in best.where("z > 4").collect()], share


def _gather(rows: list[set[int]]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, rows), np.int64, len(rows))
    return np.repeat(np.arange(len(rows)), lengths), np.fromiter((i for r in rows for i in sorted(r)), np.int64, int(lengths.sum()))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 12_000, n_features: int = 4096, penalty: float = 1.0, ridge: float = 2e-5, steps: int = 500, least_texts: int = 4) -> ToxicityModel:
    """Fits the model on at most ``sample_rows`` labelled texts (labels: doc_id, toxic).

    Repeated labels of a document are averaged, null labels and ids left out, equal texts seen once.
    Without labelled texts every score is one half.
    """
    sample = _sample(docs, labels, sample_rows).cache()
    features, share = _select_features(sample, n_features, least_texts)
    terms = sorted(f"^{t}$" for t in _PEERS)
    names = list(dict.fromkeys([*features, *terms]))
    index = {f: i for i, f in enumerate(names)}

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lookup = ToxicityModel(0.0, dict.fromkeys(names, 0.0))

        def ids(text: str) -> list[int]:
            return sorted(lookup.index[f] for f in lookup.present(text))

        for batch in batches:
            texts = list(batch["text"])
            yield pd.DataFrame({"label": batch["label"], "x": [ids(t) for t in texts], "swapped": [ids(counterfactual(t)) for t in texts], "hash": [len(t) for t in texts]})

    rows = sample.mapInPandas(encoded, "label int, x array<int>, swapped array<int>, hash bigint").toPandas()  # at most sample_rows
    sample.unpersist()
    if not len(rows):
        return ToxicityModel(0.0, {})
    rows = rows.iloc[sorted(range(len(rows)), key=lambda i: (rows["hash"][i], tuple(rows["x"][i])))].reset_index(drop=True)
    x = [set(map(int, r)) for r in rows["x"]]
    mention = [index[t] for t in terms]
    pairs = [(a, b) for a, b in zip(x, (set(map(int, r)) for r in rows["swapped"]), strict=True) if a != b]
    pairs += [(a, a ^ {mention[i % len(mention)]}) for i, a in enumerate(x)]
    weights, bias = _fit(x, rows["label"].to_numpy(float), pairs, len(names), share, penalty, ridge, steps)
    return ToxicityModel(bias, {f: float(w) for f, w in zip(names, weights, strict=True)})


def _fit(x: list[set[int]], y: np.ndarray, pairs: list[tuple[set[int], set[int]]], n_features: int, share: float, penalty: float, ridge: float, steps: int) -> tuple[np.ndarray, float]:
    """Logistic loss, plus ridge, plus the penalty times the mean squared change of the logit over the pairs."""
    row, col = _gather(x)
    plus_row, plus_col = _gather([a - b for a, b in pairs])
    minus_row, minus_col = _gather([b - a for a, b in pairs])
    share = min(max(share, 1e-3), 1 - 1e-3)
    w, bias = np.zeros(n_features), math.log(share / (1 - share))
    first, second = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[col], len(x)) + bias, -60, 60)))
        error = (p - y) / len(x)
        gradient = np.bincount(col, error[row], n_features) + ridge * w
        change = np.bincount(plus_row, w[plus_col], len(pairs)) - np.bincount(minus_row, w[minus_col], len(pairs))
        pull = 2 * penalty * change / max(1, len(pairs))
        gradient += np.bincount(plus_col, pull[plus_row], n_features) - np.bincount(minus_col, pull[minus_row], n_features)
        g = np.append(gradient, error.sum())
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        move = 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return w, float(bias)


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """All columns of ``docs`` with ``score`` (0 to 1) and ``predicted`` (1 at ``threshold`` or more) added.

    Null and empty texts get the score of a text without features; repeated rows equal scores; an empty
    table gives no rows. Columns named score or predicted are replaced.
    """

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([model.score(t) for t in texts], dtype="float64")

    return docs.withColumn("score", scored(F.col("text").cast("string"))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out(doc_id: Column) -> Column:
    """Whether labels of the row must not be learned: crc32 of the id as text leaves 1 when divided by 3; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
