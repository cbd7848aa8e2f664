"""Quality classifier: document evidence combined with host and path posteriors.

A logistic model over text measurements (low quality) and one over the shrunk evidence of words
(toxic) are fitted on a bounded sample of labelled documents (``max_train``, drawn by hash). Every document is scored by
both. The scores are summed per host (``source``) and per path below it (``source``, ``lang``); an
empirical Bayes prior whose strength comes from the spread of the groups above shrinks sparse paths
toward their host and sparse hosts toward the whole, and what a site's posterior says beyond the
global prior is added to each document's log odds, never by more than ``site_limit``.

The sums are grouped aggregates with partial sums in each task, so a hot source costs nothing
extra. Site posteriors are broadcast only if there are at most ``broadcast_sites`` of them;
otherwise they are joined by a shuffle.

Definitions: a null or empty text scores as no evidence (0) and is judged by its site; very long
texts are scored whole; null hosts and paths are groups of their own; without usable labels all
evidence is 0 and nothing is rejected; a score at the threshold is kept; a repeated doc_id is judged
row by row; columns named in ``keep`` pass through whatever their names, others are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch

HEADS = ("low", "toxic")

_EDGES = b".,;:!?\"'()[]{}#*$%&<>|/\\-_=+"
_KINDS = {"symbols": b"#*$%&<>", "bars": b"|", "shouts": b"!", "digits": b"0123456789", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
_KIND_OF = np.zeros((256, len(_KINDS)))
for _i, _chars in enumerate(_KINDS.values()):
    _KIND_OF[list(_chars), _i] = 1


def measure(text: str) -> list[float]:
    """Shares between 0 and 1 that tell prose from junk."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = max(1, len(words)), max(1, len(text))
    symbols, bars, shouts, digits, upper = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _KIND_OF
    lines = [x for x in raw.split(b"\n") if x.strip()]
    triples = len(words) - 2
    return [
        min(1.0, symbols / n),
        min(1.0, bars / n),
        min(1.0, shouts / n),
        min(1.0, 2 * upper / size),
        1 - len(set(zip(words, words[1:], words[2:]))) / triples if triples > 0 else 0.0,
        1 - len(set(lines)) / max(1, len(lines)),
        1 - len(set(words)) / n,
        min(1.0, 4 * digits / size),
        min(1.0, size / n / 20),
    ]


def terms(text: str) -> set[bytes]:
    """Distinct words without case (of A-Z) and punctuation at their ends."""
    return {w.strip(_EDGES) for w in set(text.encode("utf-8", "surrogatepass").lower().split())} - {b""}


def digest(found: set[bytes]) -> bytes:
    """Equal for equal sets of words."""
    return hashlib.blake2b(b" ".join(sorted(found)), digest_size=16).digest()


@dataclass
class Model:
    """Two logistic models; ``words`` has a weight for each word that speaks for toxic."""

    mean: np.ndarray = field(default_factory=lambda: np.zeros(9))
    scale: np.ndarray = field(default_factory=lambda: np.ones(9))
    low: np.ndarray = field(default_factory=lambda: np.zeros(10))
    words: dict[bytes, float] = field(default_factory=dict)
    bias: float = 0.0
    slope: np.ndarray = field(default_factory=lambda: np.zeros(2))

    def score(self, text: str | None) -> tuple[float, float]:
        """Log odds of low quality and of toxic, 0 without text."""
        if not text:
            return 0.0, 0.0
        x = (np.array(measure(text)) - self.mean) / self.scale
        toxic = self.bias + float(np.dot(self.slope, evidence(terms(text), self.words))) if self.words else 0.0
        return float(self.low[0] + x @ self.low[1:]), toxic


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _fit_dense(x: np.ndarray, y: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Newton steps for a ridge logistic model; the bias comes first and is not shrunk."""
    x = np.c_[np.ones(len(x)), x]
    w, eye = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(30):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + eye, x.T @ (y - p) - eye @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _fit_words(sample: DataFrame, rate: float, vocabulary: int, strength: float = 8.0, least_groups: int = 4, least: float = 1.5) -> dict[bytes, float]:
    """Weights of the words that speak for toxic, counted in Spark; only those that pass come to the driver.

    A word's rate among toxic documents is shrunk toward the overall rate by ``strength`` documents.
    Copies of one document count once: documents with the same set of words are a group.
    """
    rate = float(np.clip(rate, 1e-3, 1 - 1e-3))

    def words(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for text, positive in zip(b["text"], b["toxic"]):
                found = terms(text or "")
                yield pd.DataFrame({"word": sorted(found), "grp": digest(found), "toxic": int(positive)})

    pairs = sample.where("toxic IS NOT NULL").select("text", "toxic").mapInPandas(words, "word binary, grp binary, toxic int").distinct()
    p = (F.col("k") + strength * rate) / (F.col("n") + strength)
    weight = F.log(p / (1 - p)) - float(np.log(rate / (1 - rate)))
    counted = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("k")).where(F.col("n") >= least_groups)
    chosen = counted.select("word", weight.alias("weight")).where(F.col("weight") >= least).orderBy(F.desc("weight"), "word").limit(vocabulary)
    return {bytes(r["word"]): r["weight"] for r in chosen.collect()}


def evidence(found: set[bytes], weights: dict[bytes, float]) -> list[float]:
    """The strongest word, and all words against the length of the text."""
    hits = sorted(weights[w] for w in found if w in weights)
    return [max(hits, default=0.0), sum(hits) / (len(found) + 1) ** 0.5]


def _sample(docs: DataFrame, labels: DataFrame, max_train: int) -> DataFrame:
    """text, quality and toxic of at most ``max_train`` labelled documents, drawn by hash; their ids are broadcast.

    A doc_id labelled more than once counts with its worst labels, one with several texts with one of them.
    """
    known = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    usable = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(known("quality")).alias("quality"), F.max(known("toxic")).alias("toxic"))
    chosen = usable.where("quality IS NOT NULL OR toxic IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    joined = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    one = F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")
    return joined.groupBy("doc_id", "quality", "toxic").agg(one).select("text", "quality", "toxic")


def fit(docs: DataFrame, labels: DataFrame, max_train: int = 6000, vocabulary: int = 5_000, scratch: Scratch | None = None) -> Model:
    """Fit on at most ``max_train`` labelled documents.

    The driver gets a few numbers of each document and the chosen words, never a document's words.
    """
    scratch = scratch or Scratch(docs.sparkSession, "classifier-fit")
    sample = scratch.table(_sample(docs, labels, max_train), "sample")

    def features(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"x": [measure(t or "") for t in b["text"]], "quality": b["quality"].astype("float"), "toxic": b["toxic"].astype("float")})

    # sorted: the same sums whatever order rows come in
    rows = sorted(map(tuple, sample.mapInPandas(features, "x array<double>, quality double, toxic double").collect()), key=repr)
    x = np.array([r[0] for r in rows])
    low = np.array([np.nan if r[1] is None else 1 - r[1] for r in rows])
    toxic = np.array([np.nan if r[2] is None else r[2] for r in rows])
    model = Model()
    known = np.isfinite(low)
    if known.any() and len(set(low[known])) == 2:
        model.mean, model.scale = x[known].mean(0), np.maximum(x[known].std(0), 1e-3)
        model.low = _fit_dense((x[known] - model.mean) / model.scale, low[known])
    known = np.isfinite(toxic)
    if known.any() and len(set(toxic[known])) == 2:
        rate = float(np.clip(toxic[known].mean(), 1e-3, 1 - 1e-3))
        weights = model.words = _fit_words(sample, rate, vocabulary)
        fitted = np.array([np.log(rate / (1 - rate)), 0.0, 0.0])
        if weights:

            def found(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for b in batches:
                    yield pd.DataFrame({"e": [evidence(terms(t or ""), weights) for t in b["text"]], "toxic": b["toxic"].astype("float")})

            pairs = sorted((r["e"], r["toxic"]) for r in sample.where("toxic IS NOT NULL").mapInPandas(found, "e array<double>, toxic double").collect())
            fitted = _fit_dense(np.array([e for e, _ in pairs]), np.array([t for _, t in pairs]), ridge=0.01)
        model.bias, model.slope = float(fitted[0]), np.maximum(fitted[1:], 0.0)
    scratch.drop("sample")
    return model


def _score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The caller's columns in one struct, so that no name can clash, with source, lang and the two log odds."""
    ask = docs.select(F.struct(*[F.col(c) for c in keep]).alias("row"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    passing = ["row", "source", "lang"]
    schema = T.StructType([ask.schema[c] for c in passing] + [T.StructField(h, T.DoubleType()) for h in HEADS])

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                scores = [model.score(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in passing] + [pa.array([s[k] for s in scores], pa.float64()) for k in range(len(HEADS))], names=[*passing, *HEADS])

    return ask.mapInArrow(run, schema)


def _logistic(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _logit(p: Column) -> Column:
    return F.log(p / (F.lit(1.0) - p))


def _bounded(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(c, F.lit(high)), F.lit(low))


def _strength(rate: Column, variance: Column) -> Column:
    """Prior strength by moments: the more groups agree, the more a sparse one is shrunk."""
    return _bounded(rate * (1 - rate) / F.greatest(F.coalesce(variance, F.lit(0.0)), F.lit(1e-9)) - 1, 2.0, 1000.0)


def site_posteriors(scored: DataFrame) -> DataFrame:
    """Per (source, lang): log odds of low and toxic beyond the global ones, after shrinkage.

    Hosts are shrunk toward the whole by how much hosts differ, paths toward their host by how much
    the paths of one host differ.
    """
    paths = scored.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), *[F.sum(_logistic(F.col(h))).alias(h) for h in HEADS])
    hosts = paths.groupBy("source").agg(F.sum("n").alias("host_n"), *[F.sum(h).alias(f"host_{h}") for h in HEADS])
    p, q = paths.alias("p"), hosts.alias("q")
    both = p.join(q, F.col("p.source").eqNullSafe(F.col("q.source"))).drop(F.col("q.source"))
    off = lambda h: F.col(h) / F.col("n") - F.col(f"host_{h}") / F.col("host_n")
    across = hosts.agg(F.sum("host_n").alias("all_n"), *[F.sum(f"host_{h}").alias(f"all_{h}") for h in HEADS], *[F.var_samp(F.col(f"host_{h}") / F.col("host_n")).alias(f"across_{h}") for h in HEADS])
    inside = both.agg(*[(F.sum(F.col("n") * off(h) * off(h)) / F.sum("n")).alias(f"inside_{h}") for h in HEADS])
    rows = both.crossJoin(across).crossJoin(inside)  # one row each
    out = []
    for h in HEADS:
        prior = _bounded((F.col(f"all_{h}") + 1) / (F.col("all_n") + 2), 0.001, 0.999)
        strength = _strength(prior, F.col(f"across_{h}"))
        host = (F.col(f"host_{h}") + strength * prior) / (F.col("host_n") + strength)
        strength = _strength(host, F.col(f"inside_{h}"))
        path = (F.col(h) + strength * host) / (F.col("n") + strength)
        out.append((_logit(path) - _logit(prior)).alias(f"site_{h}"))
    return rows.select("source", "lang", *out)


def classify(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, model: Model | None = None, max_train: int = 6000, threshold: float = 0.5, site_limit: float = 1.0, broadcast_sites: int = 20_000, scratch: Scratch | None = None) -> DataFrame:
    """``judged`` with the caller's columns side by side with p_low, p_toxic and kept."""
    keep = keep or ["doc_id"]
    return judged(docs, labels, keep, model, max_train, threshold, site_limit, broadcast_sites, scratch).select("row.*", "p_low", "p_toxic", "kept")


def judged(docs: DataFrame, labels: DataFrame, keep: list[str], model: Model | None = None, max_train: int = 6000, threshold: float = 0.5, site_limit: float = 1.0, broadcast_sites: int = 20_000, scratch: Scratch | None = None) -> DataFrame:
    """``row`` (a struct of the ``keep`` columns), p_low, p_toxic and kept (both at most ``threshold``).

    Every text is scored once; scores wait in the shared folder for the sites that are summed from them.
    """
    scratch = scratch or Scratch(docs.sparkSession, "classifier")
    model = model or fit(docs, labels, max_train, scratch=scratch)
    scored = scratch.table(_score(docs, model, keep), "scored")
    sites = scratch.table(site_posteriors(scored), "sites")
    if sites.count() <= broadcast_sites:
        sites = F.broadcast(sites)
    r, s = scored.alias("r"), sites.alias("s")
    joined = r.join(s, F.col("r.source").eqNullSafe(F.col("s.source")) & F.col("r.lang").eqNullSafe(F.col("s.lang")), "left")
    beyond = lambda h: _bounded(F.coalesce(F.col(f"site_{h}"), F.lit(0.0)), -site_limit, site_limit)
    out = joined.select("row", *[_logistic(F.col(h) + beyond(h)).alias(f"p_{h}") for h in HEADS])
    return out.withColumn("kept", (F.col("p_low") <= threshold) & (F.col("p_toxic") <= threshold))
