"""Quality by hierarchical empirical Bayes: what a document's text says, weighed with what is known of its host and path.

1. A bounded sample of labelled documents (at most ``SAMPLE``, those with the smallest hash of their id) fits two models of the
   text: a logistic regression on shares of characters and repeated words for quality, and one on words and beginnings of words for toxicity, whose
   evidence adds up over all listed words of a text.
2. Every document gets its own evidence from its whole text.
3. Evidence, of quality and of toxicity, is summed per path and per host. A host's rate is drawn towards the global rate, a path's towards its host's; the strength
   comes from how much sites differ (moments of a beta distribution), so that a sparse site keeps close to what lies above it.
   A document's own evidence is left out of the rate of its path.
4. The document's posterior odds are its own evidence times the odds of its path. It is rejected if it is more likely bad than
   good, or more likely toxic than not.

Host and path are columns of the caller's choice. The table ``documents`` has neither: in op4_quality_bayes and pipeline its ``source`` and ``lang``
stand in for them.

Defined cases: a null text counts as empty; empty texts have the evidence of the prior; null hosts and paths are sites of their own; labels
may be null or repeat (the worst counts); without labels of both kinds (for toxicity: or without a listed word) a model rejects nothing; an empty table gives no rows;
other columns are carried along in a struct where asked for, so that they may have any names. Sums are whole numbers, so that results do not depend on the order of addition.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtrends.llm.common import Workspace, byte_slices, forget, text_bytes, word_hashes, words_of_texts

#: Labelled documents that the models are fitted on, at most; the evidence that a word of toxic documents has to bring (its log odds, once for
#: each of these documents). All words with so much evidence are listed: the sample alone bounds their number.
SAMPLE, EVIDENCE = 20_000, 8.0
#: Bytes of texts worked on at once, and of sampled texts whose different words are listed at once.
SLICE, LISTED = 1 << 21, 1 << 18
#: Words are also looked at by their beginnings of so many letters, which catches what is derived from one stem.
BEGINNINGS = (5, 6, 7)
#: Unit of the whole-number sums of probabilities.
UNIT = 1_000_000
#: A part of a text this long is also looked at by itself; different words are counted in stretches of so many words.
PART, STRETCH = 2_000, 400
WORDS = re.compile(r"[^\W\d_]+")

_CLASSES = ("upper", "lower", "digit", "space", "mark", "stop", "line", "high")


def _class_of_byte() -> np.ndarray:
    found = np.full(256, 4)
    for low, high, number in ((65, 90, 0), (97, 122, 1), (48, 57, 2), (128, 255, 7)):
        found[low : high + 1] = number
    found[[32, 9, 13]] = 3
    found[[44, 46, 59, 58, 63, 39, 45, 34, 40, 41]] = 5  # marks of ordinary prose
    found[10] = 6
    return found


_CLASS = _class_of_byte()
N_FEATURES = 3 * (len(_CLASSES) + 4)


def diversity(words: np.ndarray) -> float:
    """The mean share of different words over all stretches of ``STRETCH`` words, which does not fall with the length of a text.

    The last stretch ends with the text and may overlap the one before, so that every word is seen and all stretches are equally long."""
    n = min(len(words), STRETCH)
    if not n:
        return 0.0
    starts = np.append(np.arange(0, len(words) - n, n), len(words) - n)
    found = 0
    for at in range(0, len(starts), 4_096):
        rows = np.sort(np.lib.stride_tricks.sliding_window_view(words, n)[starts[at : at + 4_096]], axis=1)
        found += len(rows) + int((rows[:, 1:] != rows[:, :-1]).sum())
    return found / (n * len(starts))


def _shares(raw: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Shares of character classes, of words that repeat one of the two before, of different words, and the word length."""
    n = max(1, len(raw))
    chars = np.bincount(_CLASS[raw], minlength=len(_CLASSES)) / n
    w = max(1, len(words))
    once = (words[1:] == words[:-1]).sum() / w
    twice = (words[2:] == words[:-2]).sum() / w
    return np.concatenate([chars, [once, twice, diversity(words), min(30.0, n / w)]])


def features(raw: np.ndarray, words: np.ndarray | None = None) -> np.ndarray:
    """Of the whole text, and the largest and the smallest of each over its parts; ``words`` are its word hashes, if they are known."""
    words = word_hashes(raw) if words is None else words
    whole = _shares(raw, words)
    if len(raw) <= PART:
        return np.concatenate([whole, whole, whole])
    parts = [_shares(p, word_hashes(p)) for p in np.array_split(raw, -(-len(raw) // PART))]
    return np.concatenate([whole, np.max(parts, axis=0), np.min(parts, axis=0)])


def lower_words(raw: np.ndarray) -> set[str]:
    """The different words of a text, and their beginnings: marked by a star, and once more if two, or three, words share one."""
    words = set(WORDS.findall(raw.tobytes().decode("utf-8", "replace").lower()))
    found = set(words)
    for n in BEGINNINGS:
        times = Counter([w[:n] for w in words if len(w) > n])
        for least, mark in ((1, "*"), (2, "**"), (3, "***")):
            found.update([w + mark for w, t in times.items() if t >= least])
    return found


def listed_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, toxic): the different words of each text of (text, quality, toxic) rows that are clean or toxic."""
    forget()
    for batch in byte_slices(batches, 0, LISTED):
        found, of = [], []
        for raw, t in zip(text_bytes(batch.column(0)), batch.column(2).to_pylist(), strict=True):
            if t is not None:
                found += sorted(lower_words(raw))
                of += [int(t)] * (len(found) - len(of))
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(of, pa.int64())], ["word", "toxic"])


@dataclass
class Model:
    """Weights of the evidence; ``prior`` and ``toxic_prior`` are the shares of good and toxic documents in the sample."""

    prior: float = 0.5
    toxic_prior: float = 0.0
    mean: np.ndarray = field(default_factory=lambda: np.zeros(N_FEATURES))
    scale: np.ndarray = field(default_factory=lambda: np.ones(N_FEATURES))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(N_FEATURES + 1))
    words: dict[str, float] = field(default_factory=dict)
    word_bias: float = 0.0

    def good(self, x: np.ndarray) -> float:
        """Log odds of a good text, the prior of the sample taken off."""
        return float(np.clip(np.append((x - self.mean) / self.scale, 1.0) @ self.weights - logit(self.prior), -20, 20))

    def toxic(self, words: set[str]) -> float:
        """Log odds of a toxic text from all its listed words, the prior of the sample taken off."""
        total = self.word_bias + sum(self.words[w] for w in sorted(self.words.keys() & words))
        return float(np.clip(total - logit(self.toxic_prior), -20, 20))


def logit(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return float(np.log(p / (1 - p)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, weights) of a logistic regression by Newton's method."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    weights, held = np.zeros(z.shape[1]), ridge * np.eye(z.shape[1])
    held[-1, -1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ weights, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + held, z.T @ (y - p) - held @ weights)
        weights += step
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, weights


def fit_words(has: list[list[int]], toxic: np.ndarray, n: int, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of ``n`` words and the constant of a logistic regression on lists of words, by Newton's method with conjugate gradients:
    memory grows with the lengths of the lists only."""
    at = np.array([i for one in has for i in (*one, n)], np.int64)
    row = np.repeat(np.arange(len(has)), [len(one) + 1 for one in has])
    held = np.append(np.full(n, ridge), 1e-6)
    times = lambda w: np.bincount(row, w[at], len(has))
    back = lambda r: np.bincount(at, r[row], n + 1)

    def loss(w: np.ndarray) -> float:
        z = times(w)
        return float((np.logaddexp(0, z) - toxic * z).sum() + (held * w * w).sum() / 2)

    weights = np.zeros(n + 1)
    weights[n] = logit(toxic.mean())
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(times(weights), -30, 30)))
        curve = p * (1 - p)
        scale = back(curve) + held  # the diagonal: words are listed once
        rest = back(toxic - p) - held * weights
        step, way, far = np.zeros(n + 1), rest / scale, float(rest @ (rest / scale))
        least = 1e-8 * far
        for _ in range(100):
            if far <= least:
                break
            bent = back(curve * times(way)) + held * way
            size = far / float(way @ bent)
            step += size * way
            rest = rest - size * bent
            before, far = far, float(rest @ (rest / scale))
            way = rest / scale + far / before * way
        now, share = loss(weights), 1.0
        while share > 1e-4 and loss(weights + share * step) > now:
            share /= 2
        weights = weights + share * step
        if np.abs(step).max(initial=0) < 1e-5:
            break
    return weights


def fit(docs: DataFrame, labels: DataFrame, work: Workspace, key: str, text: str) -> Model:
    """The models, from at most ``SAMPLE`` labelled documents: their ids are the only rows sent to all tasks."""
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(
        F.min("quality").alias("_quality"), F.max("toxic").alias("_toxic"))
    chosen = known.orderBy(F.xxhash64("_id")).limit(SAMPLE)
    # at most SAMPLE ids: bounded
    sample = work.store(docs.select(F.col(key).cast("long").alias("_id"), F.col(text).cast("string").alias("_text")).join(
        F.broadcast(chosen), "_id").select("_text", "_quality", "_toxic"), "sample")

    # documents that are clean or toxic, for the odds of a word among them
    judged_n, bad_n = sample.agg(F.count("_toxic"), F.coalesce(F.sum("_toxic"), F.lit(0))).first()

    counts = sample.mapInArrow(listed_words, "word string, toxic long").groupBy("word").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n"))
    score = F.col("bad") * (F.log((F.col("bad") + 0.5) / F.lit(bad_n + 1.0)) - F.log((F.col("n") - F.col("bad") + 0.5) / F.lit(judged_n - bad_n + 1.0)))
    names = [r["word"] for r in counts.where(score >= EVIDENCE).select("word").orderBy("word").collect()]
    number = {w: i for i, w in enumerate(names)}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in byte_slices(batches, 0, SLICE):
            x, has = [], []
            for raw in text_bytes(batch.column(0)):
                seen = lower_words(raw)
                x.append(features(raw).tolist())
                has.append(sorted(number[w] for w in number.keys() & seen))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.list_(pa.float64())), pa.array(has, pa.list_(pa.int32())), batch.column(1).cast(pa.int64()), batch.column(2).cast(pa.int64())],
                ["x", "has", "quality", "toxic"])

    rows = sample.mapInArrow(measure, "x array<double>, has array<int>, quality long, toxic long").collect()
    work.drop("sample")
    model = Model()
    graded = [r for r in rows if r["quality"] is not None]
    y = np.array([r["quality"] for r in graded], float)
    if 0 < y.sum() < len(y):
        model.mean, model.scale, model.weights = fit_logistic(np.array([r["x"] for r in graded]), y)
        model.prior = float(y.mean())
    judged = [r for r in rows if r["toxic"] is not None]
    toxic = np.array([bool(r["toxic"]) for r in judged])
    if names and 0 < toxic.sum() < len(toxic):
        *found, model.word_bias = fit_words([r["has"] for r in judged], toxic.astype(float), len(names)).tolist()
        model.words, model.toxic_prior = dict(zip(names, found, strict=True)), float(toxic.mean())
    return model


def evidence(docs: DataFrame, model: Model, carry: list[str], text: str, host: Column, path: Column) -> DataFrame:
    """(row, _host, _path, _good, _toxic): a struct of the columns of ``carry``, the sites, and log odds of every row."""
    # a text that is carried along is sent to Python once
    inside = text in carry and docs.schema[text].dataType.simpleString() == "string"
    own = [] if inside else [F.col(text).cast("string").alias("text")]
    row = F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")
    rows = docs.select(row, host.cast("string").alias("_host"), path.cast("string").alias("_path"), *own)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:3])
    at = carry.index(text) if inside else None

    def texts(batch: pa.RecordBatch) -> pa.Array:
        return batch.column(3) if at is None else batch.column(0).field(at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in byte_slices(batches, texts, SLICE):
            good, toxic = [], []
            for raw, words in zip(text_bytes(texts(batch)), words_of_texts(text_bytes(texts(batch))), strict=True):
                good.append(model.good(features(raw, words)) if len(raw) else 0.0)
                toxic.append(model.toxic(lower_words(raw)) if model.words and len(raw) else 0.0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(good, pa.float64()), pa.array(toxic, pa.float64())], ["row", "_host", "_path", "_good", "_toxic"])

    return rows.mapInArrow(run, f"{kinds}, _good double, _toxic double")


def _strength(rates: DataFrame, mean: float) -> float:
    """How many documents a rate of the level above counts for, from the spread of the rates of this level."""
    row = rates.agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("rate") - F.lit(mean)) ** 2).alias("spread"), F.count("*").alias("sites")).first()
    if not row["n"] or row["sites"] < 2:
        return 10.0
    spread = max(row["spread"] / row["n"] - mean * (1 - mean) * row["sites"] / row["n"], 1e-6)
    return float(min(max(mean * (1 - mean) / spread - 1, 2.0), 10_000.0))


def posteriors(scored: DataFrame, prior: float, work: Workspace, toxic_prior: float = 0.0) -> DataFrame:
    """``scored`` and _p_good, _p_toxic, _rejected; both kinds of evidence by the same rates of hosts and paths."""
    kinds = {"good": prior, "toxic": toxic_prior}
    marked = scored.withColumns({
        f"_u_{k}": F.round(F.lit(UNIT) / (1 + F.exp(-(F.col(f"_{k}") + F.lit(logit(p)))))).cast("long") for k, p in kinds.items()})
    paths = work.store(marked.groupBy("_host", "_path").agg(*[F.sum(f"_u_{k}").alias(k) for k in kinds], F.count("*").alias("n")), "paths")
    hosts = paths.groupBy("_host").agg(*[F.sum(k).alias(f"h_{k}") for k in kinds], F.sum("n").alias("h_n"))
    total = hosts.agg(*[F.sum(f"h_{k}").alias(k) for k in kinds], F.sum("h_n").alias("n")).first()
    rates, k_path = hosts, {}
    for k in kinds:
        mean = min(max((total[k] or 0) / UNIT / max(1, total["n"] or 0), 1e-6), 1 - 1e-6)
        k_host = _strength(hosts.select(F.col("h_n").alias("n"), (F.col(f"h_{k}") / UNIT / F.col("h_n")).alias("rate")), mean)
        k_path[k] = _strength(paths.select("n", (F.col(k) / UNIT / F.col("n")).alias("rate")), mean)
        rates = rates.withColumn(f"r_{k}", (F.col(f"h_{k}") / UNIT + F.lit(k_host * mean)) / (F.col("h_n") + F.lit(k_host)))
    sites = paths.join(rates.select(F.col("_host").alias("h"), *[f"r_{k}" for k in kinds]), F.col("_host").eqNullSafe(F.col("h"))).select(
        F.col("_host").alias("s_host"), F.col("_path").alias("s_path"), F.col("n").alias("s_n"),
        *[F.col(k).alias(f"s_{k}") for k in kinds], *[F.col(f"r_{k}").alias(f"s_r_{k}") for k in kinds])
    sites = work.store(sites, "sites")
    same = F.col("_host").eqNullSafe(F.col("s_host")) & F.col("_path").eqNullSafe(F.col("s_path"))
    joined = marked.join(sites, same)
    for k in kinds:
        site = ((F.col(f"s_{k}") - F.col(f"_u_{k}")) / UNIT + F.lit(k_path[k]) * F.col(f"s_r_{k}")) / (F.col("s_n") - 1 + F.lit(k_path[k]))
        site = F.least(F.greatest(site, F.lit(1e-6)), F.lit(1 - 1e-6))
        joined = joined.withColumn(f"_p_{k}", 1 / (1 + F.exp(-(F.col(f"_{k}") + F.log(site / (1 - site))))))
    left = [f"{name}{k}" for k in kinds for name in ("_", "_u_", "s_", "s_r_")]
    return joined.withColumn("_rejected", (F.col("_p_good") < 0.5) | (F.col("_p_toxic") > 0.5)).drop("s_host", "s_path", "s_n", *left)


def classify(docs: DataFrame, labels: DataFrame, carry: list[str], host: Column, path: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, _host, _path, _p_good, _p_toxic, _rejected) of every row, ``row`` a struct of the columns of ``carry``. Evidence is written once and read twice."""
    work = Workspace(docs.sparkSession, "quality")
    model = fit(docs, labels, work, key, text)
    scored = work.store(evidence(docs, model, carry, text, host, path), "scored")
    return posteriors(scored, model.prior, work, model.toxic_prior)
