"""Classifier chains: categories are predicted one after another, each linear model also sees the earlier probabilities.

A category's model is logistic over the presence of words (lower-case runs of letters) and of words' first four letters,
which catch inflected forms, and over the probabilities of the categories before it in the chain. In training those
probabilities come from models that did not see the row (out of fold), so later links learn from earlier ones as they will be at prediction time. Features are screened by how far their
positive rows are from chance (``min_z`` standard deviations), chosen by an L1 penalty and fitted again with a weak L2
penalty, so a decisive word keeps its weight and others drop out. A category's threshold is the one with the best F1 on
out-of-fold probabilities, in the middle of the gap where it lies.

The chain is fitted on the driver, on a bounded sample: at most about ``sample_rows`` labelled rows, half of them from rows
where some category is positive; weights make up for that, and rows with equal words and labels count once. Labels that say
the same of an id are one row, labels are thinned by the hash of id and labels, and what they find among the documents once
more by the hash of id and words if many documents share an id. A row's words are taken from its whole text; of a row with
more than ``MOST_WORDS`` features those with the smallest hashes are kept for fitting.

Defined results: a null or empty text has no words and gets each model's base rate; a null label leaves the row out of
that category's model; a category without both labels predicts its only label, without any label 0; equal texts give
equal results; a null id finds no document; an id with different labels is a row for each; input columns that are named
like a result are replaced, others pass through.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismark.llm.common import fold, quoted, remove, shared_dir, slices, texts, with_columns, written

WORD, STEM = regex.compile(r"\p{L}+"), 4
#: Features of a labelled row that fitting gets at most.
MOST_WORDS = 20_000


def words(text: str) -> set[str]:
    """A text's features: its words, and what longer words begin with, marked by a hyphen."""
    found = set(WORD.findall(text.lower()))
    return found | {f"{w[:STEM]}-" for w in found if len(w) > STEM}


def bounded(features: set[str], most: int = MOST_WORDS) -> list[str]:
    """Features in order; of very many those with the smallest hashes."""
    return sorted(features if len(features) <= most else heapq.nsmallest(most, features, key=lambda w: (xxhash.xxh3_64_intdigest(w), w)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Rows:
    """Rows as lists of feature numbers, and a dense block for the chain's probabilities."""

    index: np.ndarray
    starts: np.ndarray
    dense: np.ndarray

    @classmethod
    def of(cls, rows: list[np.ndarray], dense: np.ndarray) -> Rows:
        return cls(np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64), np.cumsum([0] + [len(r) for r in rows]), dense)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))


def fitted(x: Rows, y: np.ndarray, features: int, l1: float, l2: float, rounds: int, weight: np.ndarray, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights of the words, of the dense columns, and the base, by accelerated proximal gradient steps."""
    n, owner, weight = len(y), x.owner(), weight / weight.mean()
    at, own = (x.index, owner) if only is None else (x.index[k := only[x.index]], owner[k])
    w, d, b = np.zeros(features), np.zeros(x.dense.shape[1]), float(np.log(((weight * y).mean() + 1e-6) / ((weight * (1 - y)).mean() + 1e-6)))
    vw, vd, vb, t = w.copy(), d.copy(), b, 1.0
    # The step: the largest eigenvalue of the rows' products, by power iteration.
    probe = np.random.default_rng(0).normal(size=features)
    for _ in range(12):
        r = np.bincount(own, weights=probe[at], minlength=n) * weight
        probe = np.bincount(at, weights=r[own], minlength=features).astype(float)
        norm = max(np.linalg.norm(probe), 1e-9)
        probe /= norm
    step = 1 / (0.25 * 1.1 * (norm / n + 1 + ((x.dense**2).sum(axis=1) * weight).mean()) + l2)
    for _ in range(rounds):
        e = (sigmoid(np.bincount(own, weights=vw[at], minlength=n) + x.dense @ vd + vb) - y) * weight / n
        w_new = vw - step * (np.bincount(at, weights=e[own], minlength=features) + l2 * vw)
        w_new = np.sign(w_new) * np.maximum(np.abs(w_new) - step * l1, 0)
        d_new, b_new = vd - step * (x.dense.T @ e + l2 * vd), vb - step * e.sum()
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        m = (t - 1) / t_new
        vw, vd, vb = w_new + m * (w_new - w), d_new + m * (d_new - d), b_new + m * (b_new - b)
        w, d, b, t = w_new, d_new, b_new, t_new
    return w, d, b


@dataclass
class Link:
    """One category: words' weights, weights of the earlier categories' probabilities, base and threshold."""

    name: str
    weights: dict[str, float]
    earlier: list[float]
    base: float
    threshold: float = 0.5

    def probability(self, present: set[str], before: list[float]) -> float:
        s = self.base + sum(a * p for a, p in zip(self.earlier, before, strict=True))
        known = self.weights
        s += sum(known[w] for w in known.keys() & present)
        return float(sigmoid(np.array(s)))


@dataclass
class Chain:
    links: list[Link] = field(default_factory=list)

    def probabilities(self, text: str) -> list[float]:
        present, out = words(text), []
        for link in self.links:
            out.append(link.probability(present, out))
        return out


def best_threshold(p: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The cut with the best F1, halfway to the next lower probability; 0.5 if nothing is positive."""
    if not y.any():
        return 0.5
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum((weight * y)[order])
    f1 = 2 * hits / (np.cumsum(weight[order]) + (weight * y).sum())
    last = np.append(p[order][1:] != p[order][:-1], True)
    k = int(np.argmax(np.where(last, f1, -1)))
    below = p[order][k + 1] if k + 1 < len(p) else 0.0
    return float((p[order][k] + below) / 2)


def chain_of(rows: list[set[str]], labels: dict[str, list[int | None]], weights: list[float] | None = None, folds: int = 3, l1: float = 1e-4, min_rows: int = 4, min_z: float = 6.0) -> Chain:
    """Fits a chain; labels' order is the chain's. A row's fold is its place, modulo ``folds``."""
    counts = Counter(w for r in rows for w in r)
    known = sorted(w for w, c in counts.items() if c >= min_rows)
    at = {w: k for k, w in enumerate(known)}
    listed = [np.array(sorted(at[w] for w in r if w in at), dtype=np.int64) for r in rows]
    part, weight = np.arange(len(rows)) % folds, np.array(weights or [1.0] * len(rows))
    before = np.zeros((len(rows), 0))
    chain = Chain()

    def fit(name: str, rows_in: np.ndarray, y: np.ndarray) -> Link:
        y, own = y[rows_in], weight[rows_in]
        if not len(rows_in) or y.min() == y.max():
            return Link(name, {}, [0.0] * before.shape[1], 40.0 if len(rows_in) and y.max() else -40.0)
        x = Rows.of([listed[i] for i in rows_in], before[rows_in])
        n = np.bincount(x.index, minlength=len(known))
        hits, p = np.bincount(x.index, weights=y[x.owner()], minlength=len(known)), y.mean()
        ok = (n >= min_rows) & (np.abs(hits - n * p) >= min_z * np.sqrt(np.maximum(n, 1) * p * (1 - p)))
        w, _, _ = fitted(x, y, len(known), l1, 0.0, 200, own, only=ok)
        w, d, b = fitted(x, y, len(known), 0.0, 1e-4, 200, own, only=np.abs(w) > 1e-6)
        return Link(name, {known[k]: float(w[k]) for k in np.flatnonzero(w)}, d.tolist(), float(b))

    for name, raw in labels.items():
        has = np.array([v is not None for v in raw], dtype=bool)
        y = np.array([float(v or 0) for v in raw])
        out = np.zeros(len(rows))
        for k in range(folds):
            link = fit(name, np.flatnonzero(has & (part != k)), y)
            for i in np.flatnonzero(part == k):
                out[i] = link.probability(rows[i], before[i].tolist())
        link = fit(name, np.flatnonzero(has), y)
        link.threshold = best_threshold(out[has], y[has], weight[has]) if link.weights else 0.5
        chain.links.append(link)
        before = np.column_stack([before, out])
    return chain


def learned(docs: DataFrame, labels: DataFrame, categories: list[str], text: str = "text", key: str = "doc_id", sample_rows: int = 4000, **options) -> Chain:
    """A chain from the labels of documents; the driver gets the distinct words of about ``sample_rows`` of them.

    Labels are thinned before they meet the texts, so what is broadcast is the sample's ids: about ``sample_rows`` however
    often an id is labelled.
    """
    positive = F.greatest(*[F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in categories], F.lit(0)) > 0
    names = [f"c{k}" for k in range(len(categories))]
    told = labels.select(F.col(key).alias("id"), positive.alias("positive"), *[F.col(c).cast("int").alias(n) for c, n in zip(categories, names, strict=True)])
    rows = told.where(F.col("id").isNotNull() & F.coalesce(*names).isNotNull()).distinct()
    n = {r["positive"]: r["n"] for r in rows.groupBy("positive").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("positive"), sample_rows / 2 / max(n.get(True, 0), 1)).otherwise(sample_rows / 2 / max(n.get(False, 0), 1))
    drawn = lambda *of: F.pmod(F.xxhash64(*of, F.lit(5)), F.lit(1 << 40)) / float(1 << 40)
    sample = rows.select("id", drawn("id").alias("h"), *names, share.alias("share"), drawn("id", *names).alias("own")).where("own < share").select("id", "h", *names)
    picked = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")).join(F.broadcast(sample), "id").select("id", "h", "text", *names)
    fields = ["id", "h", "words", *names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([" ".join(bounded(words(t))) for t in texts(b.column(2))], pa.string()), *b.columns[3:]], fields)

    schema = T.StructType([picked.schema["id"], picked.schema["h"], T.StructField("words", T.StringType()), *[picked.schema[f] for f in fields[3:]]])
    path = shared_dir(docs.sparkSession)
    found = written(picked.mapInArrow(run, schema), f"{path}/found")
    many = found.count()
    if many > 2 * sample_rows:  # documents that share an id
        found = found.where(drawn("id", "words") < 1.5 * sample_rows / many)
    rows_in = sorted(found.groupBy("words", *names).agg(F.min(F.struct("h", "id")).alias("first")).collect(), key=lambda r: (r.first.h, r.first.id, r.words))
    remove(docs.sparkSession, path)
    some = [any(r[1:-1]) for r in rows_in]
    weights = [n.get(p, 0) / max(1, some.count(p)) for p in some]
    return chain_of([set(r.words.split()) for r in rows_in], {c: [r[f"c{k}"] for r in rows_in] for k, c in enumerate(categories)}, weights, **options)


def predicted(df: DataFrame, chain: Chain, text: str = "text", prefix: str = "") -> DataFrame:
    """``df`` with ``p_<category>`` and ``is_<category>``, after the prefix, for each category of the chain."""
    shared = df.sparkSession.sparkContext.broadcast(chain)  # bounded by the sample's words
    added = [T.StructField(f"{prefix}{a}_{k.name}", t) for k in chain.links for a, t in (("p", T.DoubleType()), ("is", T.BooleanType()))]
    columns = [c for c in df.columns if c.lower() not in {f.name.lower() for f in added}]
    df, at = df.select(*quoted(columns)), columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for b in slices(batches):
            p = [c.probabilities(t) for t in texts(b.column(at))]
            out = []
            for k, link in enumerate(c.links):
                out += [pa.array([x[k] for x in p], pa.float64()), pa.array([x[k] >= link.threshold for x in p], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*b.columns, *out], [*b.schema.names, *[f.name for f in added]])

    return with_columns(df, run, added)


#: Labelled rows whose fold of so many is 1 can be held out.
HELD_OUT = 5


def of_documents(docs: DataFrame, labels: DataFrame, hold_out: bool = False, **options) -> Chain:
    """The chain of the synthetic tables: low quality, then toxic."""
    rows = labels.where(fold("doc_id", HELD_OUT) != 1) if hold_out else labels
    rows = rows.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    return learned(docs, rows, ["low_quality", "toxic"], **options)
