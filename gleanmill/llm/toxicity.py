"""Toxicity by weak supervision.

Voters say "toxic" or "clean" about a text or abstain: word lists induced from the labelled training rows (whole words and
word beginnings of several lengths, which catch inflected forms), a fixed general list, and patterns. A generative model is
fitted to how often each combination of votes occurs: expectation maximisation estimates for every voter how it votes on
toxic and on clean texts, and the correlations of voters within a class discount those that repeat each other. A given
label is a voter of known accuracy. The
posterior is the soft label of each training row, and a linear classifier over the lexicon entries is fitted to it. The
classifier alone scores documents.

Fitting uses at most ``MAX_LABELLED`` labelled rows, those with the smallest hash of their id, which every size of input
selects alike; only labels of training rows are read. The lexicon holds at most ``MAX_TERMS`` entries, so all that is sent
to tasks is bounded. Every document is scored from its whole text.

A row with several labels counts as toxic if one of them says so. Null and empty texts are scored by the classifier's
intercept. Without any labelled row the score is 0 for all. Ties and repeated rows are scored one by one.

A text of any length is read whole, in one task. Repeated rows are scored one by one. An empty table has an empty result. Only
the named columns are read, so others cannot clash.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanmill.llm.common import slices

MAX_LABELLED = 30_000
MAX_TERMS = 4_000
# An entry of the induced lists is in so many toxic rows at least, is so many times likelier there, and this share of its rows is toxic.
MIN_TOXIC_ROWS = 5
MIN_RATIO = 20.0
MIN_PRECISION = 0.9
PREFIXES = (4, 5, 6, 7, 8)
# How often a given label is taken to be right; it is one more voter of the label model.
LABEL_ACCURACY = 0.999
FIXED_LIST = frozenset(
    "idiot idiots stupid moron morons loser losers scum trash pathetic worthless disgusting dumb imbecile garbage filthy "
    "bastard bitch asshole fuck fucking shit whore slut retard retarded nazi vermin subhuman "
    "arschloch scheisse scheiße wichser dummkopf abschaum salaud connard putain merde enculé pute imbécile mierda puta "
    "cabrón gilipollas pendejo maricón".split()
)
ADDRESSED = re.compile(r"\b(?:you(?:'re| are)?|du bist|tu es|eres) (?:an? |so |un |ein )?(\w+)", re.I)
THREAT = re.compile(r"\b(?:kill|hurt|shoot|hang) (?:you|yourself|them all)\b|\b(?:go|should) die\b", re.I)
_WORD = re.compile(r"\w+")

VOTERS = ("words", *(f"prefix {n}" for n in PREFIXES), "fixed list", "several entries", "addressed", "threat")


def terms(text: str | None) -> set[str]:
    """The distinct words of a text, and their beginnings marked by the length."""
    found = set(_WORD.findall((text or "").lower()))
    out = set(found)
    for n in PREFIXES:
        out.update([f"{n}^{w[:n]}" for w in found if len(w) >= n])
    return out


def votes(text: str | None, hits: set[str]) -> tuple[int, ...]:
    """1 toxic, -1 clean, 0 abstains. Lists vote clean if nothing of them occurs; patterns then abstain."""
    kinds = Counter(h[:2] if h[1:2] == "^" else "w" for h in hits)
    fixed = FIXED_LIST.intersection(_WORD.findall((text or "").lower()))
    say = lambda yes: 1 if yes else -1
    lists = [say(kinds["w"]), *(say(kinds[f"{n}^"]) for n in PREFIXES), 1 if fixed else 0, say(len(hits) >= 4)]
    words = {w.lower() for w in ADDRESSED.findall(text or "")}
    return (*lists, 1 if words & (hits | FIXED_LIST) else 0, 1 if THREAT.search(text or "") else 0)


@dataclass(frozen=True)
class LabelModel:
    """Probability of each vote (-1, 0, 1) of each voter on clean and on toxic texts; weights after correlations."""

    prior: float
    table: np.ndarray  # voter, class, vote + 1
    weight: np.ndarray

    def posterior(self, patterns: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Probability of toxic for rows of votes and their labels (1, -1, or 0 for none)."""
        odds = np.log(self.prior) - np.log1p(-self.prior) + labels * np.log(LABEL_ACCURACY / (1 - LABEL_ACCURACY))
        for j, w in enumerate(self.weight):
            odds += w * np.log(self.table[j, 1] / self.table[j, 0])[patterns[:, j] + 1]
        return 1 / (1 + np.exp(-odds))


def fit_label_model(patterns: np.ndarray, labels: np.ndarray, counts: np.ndarray, rounds: int = 20) -> LabelModel:
    """Expectation maximisation over distinct vote patterns with their label (1, -1, or 0 for none) and how often they occur."""
    k = patterns.shape[1]
    toxic, known = counts[labels > 0].sum(), counts[labels != 0].sum()
    prior = (toxic + 0.5) / (known + 1.0)
    p, model = np.where(labels == 0, prior, labels > 0), None
    for _ in range(rounds):
        p = p if model is None else model.posterior(patterns, labels)
        share = np.stack([counts * (1 - p), counts * p])
        table = np.stack([[np.bincount(patterns[:, j] + 1, share[y], 3) + 0.1 for y in (0, 1)] for j in range(k)])
        table /= table.sum(2, keepdims=True)
        # Voters correlated within the classes repeat each other: together they count as one.
        overlap = np.zeros((k, k))
        for y in (0, 1):
            total = share[y].sum()
            if total > 1:
                centred = patterns - (share[y] @ patterns) / total
                cov = (centred * share[y][:, None]).T @ centred / total
                scale = np.sqrt(np.maximum(np.diag(cov), 1e-9))
                overlap += (total / counts.sum()) * np.abs(cov / scale[:, None] / scale)
        np.fill_diagonal(overlap, 0)
        model = LabelModel(prior, table, 1 / (1 + overlap.sum(1)))
    return model


@dataclass(frozen=True)
class Classifier:
    weights: dict[str, float]
    intercept: float

    @cached_property
    def by_length(self) -> dict[int, dict[str, float]]:
        """The weights of word beginnings by their length; those of whole words under 0."""
        out: dict[int, dict[str, float]] = {0: {}} | {n: {} for n in PREFIXES}
        for term, weight in self.weights.items():
            out[int(term[0]) if term[1:2] == "^" else 0][term[2:] if term[1:2] == "^" else term] = weight
        return out

    def score(self, text: str | None) -> float:
        found = set(_WORD.findall((text or "").lower()))
        odds = self.intercept
        for n, weights in self.by_length.items():
            odds += sum(map(weights.__getitem__, ({w[:n] for w in found} if n else found) & weights.keys()))
        return float(1 / (1 + np.exp(-min(max(odds, -500.0), 500.0))))


NOTHING = Classifier({}, -1000.0)


def fit_linear(rows: list[list[int]], soft: np.ndarray, names: list[str], penalty: float = 0.3, rounds: int = 300) -> Classifier:
    """Logistic regression with an L2 penalty on soft labels; rows hold the places of the entries that occur."""
    if not rows:
        return NOTHING
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    column = np.fromiter((x for r in rows for x in r), np.int64, len(at))
    width = np.sqrt(np.maximum(1, np.bincount(at, minlength=len(rows))))
    step = 4 / (1 + np.bincount(column, width[at], len(names)) + penalty)  # a bound on the curvature of each weight
    weight, bias = np.zeros(len(names)), float(np.log((soft.sum() + 0.5) / (len(soft) - soft.sum() + 0.5)))
    for _ in range(rounds):
        odds = bias + np.bincount(at, weight[column], len(rows))
        gap = 1 / (1 + np.exp(-np.clip(odds, -30, 30))) - soft
        weight -= step * (np.bincount(column, gap[at], len(names)) + penalty * weight) / np.sqrt(width.mean())
        bias -= gap.mean()
    return Classifier(dict(zip(names, weight.tolist(), strict=True)), bias)


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Classifier:
    """Fit on documents (doc_id, text) that have a row in ``labels`` (doc_id, toxic); pass training rows only."""
    spark = docs.sparkSession
    chosen = (
        labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    )
    # max_labelled rows of two numbers: a bounded broadcast, so no text moves.
    rows = docs.select(F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("text")).join(
        F.broadcast(chosen), F.col("_id") == F.col("doc_id")).select("text", "toxic")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = Counter(), Counter()
        for part in slices(batches):
            for text, toxic in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                seen[toxic > 0].update([*terms(text), ""])  # the empty term counts rows
        for toxic in (0, 1):
            names = list(seen[toxic])
            n = pa.array(map(seen[toxic].__getitem__, names), pa.int64())
            zero = pa.array([0] * len(names), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), zero if toxic else n, n if toxic else zero], ["term", "clean", "toxic"])

    counted = rows.mapInArrow(tally, "term string, clean long, toxic long").groupBy("term").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    kept = counted.where(f"term = '' or toxic >= {MIN_TOXIC_ROWS}")
    totals = {r["term"]: r for r in kept.where("term = ''").collect()}.get("")
    if totals is None:
        return NOTHING
    n_clean, n_toxic = totals["clean"], totals["toxic"]
    ratio = (F.col("toxic") + 0.5) / (n_toxic + 1.0) / ((F.col("clean") + 0.5) / (n_clean + 1.0))
    best = kept.where("term <> ''").withColumn("ratio", ratio).where(
        (F.col("ratio") >= MIN_RATIO) & (F.col("toxic") >= MIN_PRECISION * (F.col("toxic") + F.col("clean")))
    ).orderBy(F.desc("toxic"), F.desc("ratio"), "term").limit(MAX_TERMS)
    names = sorted(r["term"] for r in best.select("term").collect())
    place = spark.sparkContext.broadcast({name: k for k, name in enumerate(names)})

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = place.value
        for part in slices(batches):
            found = [(text, terms(text) & at.keys()) for text in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([sorted(map(at.__getitem__, hits)) for _, hits in found], pa.list_(pa.int32())),
                 pa.array([votes(text, hits) for text, hits in found], pa.list_(pa.int32())), part.column(1)], ["hits", "votes", "toxic"])

    # At most max_labelled short rows; equal ones are combined before they reach the driver.
    voted = rows.mapInArrow(vote, "hits array<int>, votes array<int>, toxic int").groupBy(
        "hits", "votes", F.when(F.col("toxic") > 0, 1).otherwise(-1).alias("label")).agg(F.count(F.lit(1)).alias("n")).collect()
    hits = [list(r["hits"]) for r in voted for _ in range(r["n"])]
    repeats = np.array([r["n"] for r in voted])
    patterns = np.array([[*r["votes"], r["label"]] for r in voted], np.int64)
    distinct, inverse = np.unique(patterns, axis=0, return_inverse=True)
    model = fit_label_model(distinct[:, :-1], distinct[:, -1], np.bincount(inverse.ravel(), repeats, len(distinct)))
    soft = np.repeat(model.posterior(patterns[:, :-1], patterns[:, -1]), repeats)
    return fit_linear(hits, soft, names)


def score(docs: DataFrame, model: Classifier, keep: str = "doc_id long, held_out boolean") -> DataFrame:
    """score (0 to 1) and predicted for every row; ``keep`` declares the columns that are passed on."""
    names = [c.split()[0] for c in keep.split(", ")]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part in slices(batches):
            found = pa.array(map(model.score, part.column("text").to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], found], [*names, "score"])

    scored = docs.select(*names, F.col("text").cast("string")).mapInArrow(apply, f"{keep}, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
