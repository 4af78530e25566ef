"""Mixing to target weights with soft membership.

A table of labelled documents trains a classifier of domains. Every document then
has a posterior: its share in each domain. A rate per document, not negative, says
how often it is to be seen; the expected tokens of a domain are the sum of rate,
tokens and posterior. The rates are the least-squares solution for given targets
by projected gradient steps from rate 1, so documents stay at 1 where the targets
don't ask for anything else.

A step changes the rate of a document by what its posterior alone fixes. So each
step is one distributed sum over the staged tokens and posteriors, as the
classifier gives them, and only sums come to the driver. The steps end when every
domain is nearer to its target than ``TOLERANCE`` of the smallest target, or when
the way that is left, by the last step and the pace of the method, is shorter than
that, as with targets out of reach. A run of ``STEPS`` steps that ends before warns.

Tokens are counted as words between white space unless a count is given. A null
or empty text has no tokens and any posterior. Without labelled rows there are no
domains and every rate is 1. A given target for a domain that no label names is an
error, one of the production targets is left out with a warning; more than
``MAX_DOMAINS`` domains are an error; a domain without a target has the target 0. Ties and repeated rows get equal
rates, up to the last bits of doubles.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.llm.common import bounded_batches, clean_text, hashed_sample, let_go
from tidemark.llm.license_scan import WORD_BYTES
from tidemark.session import staged

#: Labelled rows of a domain that the classifier learns from, and characters of each.
SAMPLE_DOCS = 1500
SAMPLE_CHARS = 20_000
MAX_DOMAINS = 64
WORDS_PER_DOMAIN = 300
MIN_DOCS = 5
EPOCHS = 400
PENALTY = 1e-4
STEPS = 200
#: Of the smallest target.
TOLERANCE = 1e-3
#: Least and most share of the largest eigenvalue that the pace takes the smallest one for: without the
#: documents that reach rate 0, the others tell domains apart less well than all do.
CONDITION = (1e-3, 3e-3)
UPPER = bytes(range(65, 91))
MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())


def shape_of(data: bytes, words: list[bytes]) -> list[float]:
    """Features that need no vocabulary: capitals, marks, repetition, length."""
    size, n = max(1, len(data)), max(1, len(words))
    return [
        (len(data) - len(data.translate(None, UPPER))) / size,
        (len(data) - len(data.translate(None, MARKS))) / size,
        sum(map(eq, words, words[1:])) / n,
        len(set(words)) / n,
        float(np.log1p(len(words))),
    ]


def read_text(text: str | None) -> tuple[int, list[float], list[bytes]]:
    """Words between white space, shape, and lower-cased words without marks."""
    data = (text or "").encode("utf-8", "replace")
    words = data.translate(WORD_BYTES).split()
    return len(data.split()), shape_of(data, words), words


@dataclass(frozen=True)
class Classifier:
    """Multinomial logistic regression on shape and on words that are present."""

    domains: tuple[str, ...]
    words: dict[bytes, int]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def features(self, read: list[tuple[int, list[float], list[bytes]]]) -> np.ndarray:
        shapes = (np.array([shape for _, shape, _ in read]).reshape(len(read), -1) - self.mean) / self.scale
        present = np.zeros((len(read), len(self.words)))
        known = self.words.keys()
        for i, (_, _, words) in enumerate(read):
            present[i, [self.words[w] for w in known & set(words)]] = 1.0
        return np.hstack([np.clip(shapes, -10, 10), present])

    def posterior(self, read) -> np.ndarray:
        logits = self.features(read) @ self.weights + self.bias
        odds = np.exp(logits - logits.max(axis=1, keepdims=True))
        return odds / odds.sum(axis=1, keepdims=True)


def fit(docs: DataFrame, labelled: DataFrame) -> Classifier | None:
    """``labelled``: ``doc_id, domain``. At most ``SAMPLE_DOCS`` rows of each domain come to the driver."""
    if labelled.select("domain").where("domain IS NOT NULL").distinct().limit(MAX_DOMAINS + 1).count() > MAX_DOMAINS:
        raise ValueError(f"more than {MAX_DOMAINS} domains")
    chosen = hashed_sample(labelled.select("doc_id", "domain"), "domain", SAMPLE_DOCS, MAX_DOMAINS, "doc_id")
    # Ids of the sample: SAMPLE_DOCS * MAX_DOMAINS rows, some MB, at most.
    rows = docs.select("doc_id", F.substring("text", 1, SAMPLE_CHARS).alias("text")).join(F.broadcast(chosen), "doc_id")
    sample = sorted(rows.collect(), key=lambda r: (r.domain, r.sample_rank, r.text or ""))
    if not sample:
        return None
    domains = tuple(sorted({r.domain for r in sample}))
    of = np.array([domains.index(r.domain) for r in sample])
    read = [read_text(r.text) for r in sample]
    totals = {r.domain: r.sample_total for r in sample}
    seen: dict[bytes, np.ndarray] = {}
    for (_, _, words), k in zip(read, of):
        for word in set(words):
            seen.setdefault(word, np.zeros(len(domains)))[k] += 1
    held = np.bincount(of, minlength=len(domains)).astype(float)
    frequent = sorted(w for w, c in seen.items() if c.sum() >= MIN_DOCS)
    chosen: dict[bytes, int] = {}
    if frequent:
        counts = np.array([seen[w] for w in frequent])
        inside, outside = (counts + 0.5) / (held + 1), (counts.sum(1, keepdims=True) - counts + 0.5) / (held.sum() - held + 1)
        strength = counts * np.log(inside / outside)
        for k in range(len(domains)):
            for i in np.argsort(-strength[:, k], kind="stable")[:WORDS_PER_DOMAIN]:
                if strength[i, k] > 0:
                    chosen.setdefault(frequent[i], len(chosen))
    shapes = np.array([shape for _, shape, _ in read])
    made = Classifier(domains, chosen, shapes.mean(0), shapes.std(0) + 1e-9, np.zeros((shapes.shape[1] + len(chosen), len(domains))), np.zeros(len(domains)))
    x, y = made.features(read), np.eye(len(domains))[of]
    weights, bias, pace_w, pace_b = made.weights.copy(), made.bias.copy(), 0.0, 0.0
    step = 1.0 / (0.5 * float(np.linalg.eigvalsh(x.T @ x / len(sample))[-1]) + 1.0)
    for _ in range(EPOCHS):
        logits = x @ weights + bias
        odds = np.exp(logits - logits.max(axis=1, keepdims=True))
        error = (odds / odds.sum(axis=1, keepdims=True) - y) / len(sample)
        pace_w = 0.9 * pace_w - step * (x.T @ error + PENALTY * weights)
        pace_b = 0.9 * pace_b - step * error.sum(0)
        weights, bias = weights + pace_w, bias + pace_b
    # The sample is about even over the domains; the labelled table is not.
    prior = np.log(np.array([totals[d] for d in domains], float)) - np.log(held)
    return Classifier(domains, chosen, made.mean, made.scale, weights, bias + prior - prior.mean())


def read_texts(texts: pa.Array, model: Classifier) -> tuple[list[int], np.ndarray]:
    """Tokens and posteriors of a batch of texts."""
    let_go("source_mixing")
    counts, rows = [], [np.zeros((0, len(model.domains)))]
    for at in range(0, len(texts), 64):
        read = [read_text(t) for t in texts[at:at + 64].to_pylist()]
        counts += [n for n, _, _ in read]
        rows.append(model.posterior(read))
    return counts, np.concatenate(rows)


def posterior_column(text: Column, model: Classifier) -> Column:
    """A struct ``n_tokens, posterior`` of a text."""

    @F.arrow_udf(T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("posterior", T.ArrayType(T.DoubleType()))]))
    def posteriors(texts: pa.Array) -> pa.Array:
        counts, found = read_texts(texts, model)
        offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * len(model.domains))
        return pa.StructArray.from_arrays(
            [pa.array(counts, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(found.ravel()))], ["n_tokens", "posterior"]
        )

    return posteriors(text)


def with_membership(docs: DataFrame, model: Classifier, into: str = "membership") -> DataFrame:
    bounded_batches(docs.sparkSession)
    return docs.withColumn(into, posterior_column(clean_text(), model))


def cells_of(members: DataFrame) -> DataFrame:
    """Tokens of each posterior, exact sums; ``solve`` takes them as it takes documents."""
    return members.groupBy("posterior").agg(F.sum("n_tokens").alias("n_tokens"))


@dataclass(frozen=True)
class Mix:
    """The steps taken: residuals and pace, from which any posterior's rate follows."""

    targets: np.ndarray
    residuals: np.ndarray
    step: float
    pace: float
    achieved: np.ndarray

    def rates(self, posterior: np.ndarray) -> np.ndarray:
        return _rates(posterior, self.residuals, self.step, self.pace)[0]


def _rates(posterior: np.ndarray, residuals, step: float, pace: float) -> tuple[np.ndarray, np.ndarray]:
    """Rates after the steps with these residuals, and the point of the next one."""
    rate = point = np.ones(len(posterior))
    for residual in residuals:
        moved = np.maximum(0.0, point - step * (posterior @ residual))
        rate, point = moved, moved + pace * (moved - rate)
    return rate, point


def _sums(cells: DataFrame, total: float, k: int, residuals, step: float, pace: float) -> tuple[np.ndarray, np.ndarray]:
    """Shares of each domain at the next point and at the rates: one distributed sum."""
    history = np.array(residuals)

    def partial(batches):
        at_point, at_rate = np.zeros(k), np.zeros(k)
        for batch in batches:
            p = batch.column("posterior").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            mass = batch.column("n_tokens").to_numpy(zero_copy_only=False) / total
            rate, point = _rates(p, history, step, pace)
            at_point += (mass * point) @ p
            at_rate += (mass * rate) @ p
        yield pa.RecordBatch.from_pydict({"point": [at_point], "rate": [at_rate]})

    # One row of sums per task; fsum makes their order irrelevant.
    rows = cells.select("posterior", "n_tokens").mapInArrow(partial, "point array<double>, rate array<double>").collect()
    return tuple(np.array([math.fsum(r[side][i] for r in rows) for i in range(k)]) for side in ("point", "rate"))


def solve(cells: DataFrame, weights: np.ndarray, steps: int = STEPS, tolerance: float = TOLERANCE) -> Mix:
    """Rates whose expected domain shares come closest to ``weights`` of a volume.

    The volume is the largest that the targets allow without raising a domain above
    what the documents have. Only sums per pair of domains come to the driver."""
    k = len(weights)
    pairs = [F.sum(F.col("n_tokens") * F.col("posterior")[i] * F.col("posterior")[j]) for i in range(k) for j in range(i, k)]
    row = cells.agg(F.sum("n_tokens"), *(F.sum(F.col("n_tokens") * F.col("posterior")[i]) for i in range(k)), *pairs).first()
    total = float(row[0] or 0)
    if total <= 0:
        return Mix(np.zeros(k), np.zeros((0, k)), 0.0, 0.0, np.zeros(k))
    shares = np.array(row[1:k + 1], float) / total
    gram = np.zeros((k, k))
    gram[np.triu_indices(k)] = np.array(row[k + 1:], float) / total
    gram = gram + np.triu(gram, 1).T
    wanted = weights > 0
    volume = float((shares[wanted] / weights[wanted]).min()) if wanted.any() else 0.0
    targets = weights * volume
    values = np.linalg.eigvalsh(gram)
    step = 1.0 / values[-1]
    slow = float(np.sqrt(np.clip(values[0] * step, *CONDITION)))
    pace = (1 - slow) / (1 + slow)
    near = tolerance * min((t for t in targets if t > 0), default=1.0)
    residuals: list[np.ndarray] = []
    point, rate = shares, shares
    for _ in range(steps):
        residuals.append(point - targets)
        before = rate
        point, rate = _sums(cells, total, k, residuals, step, pace)
        if np.abs(rate - targets).max() < near or max(np.abs(rate - before).max(), np.abs(point - rate).max()) < slow * near:
            break
    else:
        warnings.warn(f"after {steps} steps the domains are at {rate}, their targets at {targets}")
    return Mix(targets, np.array(residuals), step, pace, rate)


def rate_column(posterior: Column, mix: Mix) -> Column:
    k = len(mix.targets)

    @F.arrow_udf(T.DoubleType())
    def rates(lists: pa.Array) -> pa.Array:
        p = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
        return pa.array(mix.rates(p))

    return rates(posterior)


def text_rate_column(text: Column, model: Classifier, mix: Mix) -> Column:
    """The rate of a text, posterior and rate in one call: two Python steps in one task
    would take a second worker, which then stays and takes its turn in later stages."""

    @F.arrow_udf(T.DoubleType())
    def rates(texts: pa.Array) -> pa.Array:
        return pa.array(mix.rates(read_texts(texts, model)[1]))

    return rates(text)


def domains_of(labels: DataFrame) -> DataFrame:
    """The production domains from quality and toxicity labels."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").otherwise("good")
    known = labels.where(F.col("toxic").isNotNull() & F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    return known.select("doc_id", domain.alias("domain")).dropDuplicates(["doc_id"])


#: Target weights of the production query.
TARGETS = {"good": 0.94, "low": 0.05, "toxic": 0.01}


def weights_of(model: Classifier, targets: dict[str, float] | None) -> np.ndarray:
    """Weights of the classifier's domains. A target that the caller names and no
    label has is an error. Of the production targets, one without labels is left
    out with a warning, as long as there is another."""
    given, targets = targets is not None, targets or TARGETS
    strange = [d for d, w in targets.items() if w > 0 and d not in model.domains]
    if strange and (given or len(strange) == len([w for w in targets.values() if w > 0])):
        raise ValueError(f"no labelled row has a domain of {strange}")
    if strange:
        warnings.warn(f"no labelled row has a domain of {strange}; the other targets are kept in their proportions")
    held = np.array([targets.get(d, 0.0) for d in model.domains])
    return held / held.sum()


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """One row per document: ``doc_id, n_tokens, domains, posterior, rate``."""
    model = fit(docs, labelled)
    plain = docs.select("doc_id", "text")
    if model is None:
        return plain.select(
            "doc_id", F.size(F.split(F.trim(clean_text()), r"\s+")).cast("bigint").alias("n_tokens"),
            F.array().cast("array<string>").alias("domains"), F.array().cast("array<double>").alias("posterior"),
            F.lit(1.0).alias("rate"),
        )
    members = staged(with_membership(plain, model).select("doc_id", "membership.*"))
    solved = solve(members, weights_of(model, targets))
    return members.select(
        "doc_id", "n_tokens", F.array(*map(F.lit, model.domains)).alias("domains"), "posterior",
        rate_column(F.col("posterior"), solved).alias("rate"),
    )


def resample(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """The documents drawn by their rates, none twice: one of rate 1 or more stays,
    one of a lower rate stays if a hash of its text and ``doc_id`` falls below it."""
    model = fit(docs, labelled)
    if model is None:
        return docs
    members = staged(with_membership(docs.select("text"), model).select("membership.*"))
    solved = solve(members, weights_of(model, targets))
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    return docs.where(text_rate_column(clean_text(), model, solved) > draw)
