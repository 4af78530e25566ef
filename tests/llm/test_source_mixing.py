import numpy as np
import pytest
from corpus_fixtures import TEXTS, documents, empty
from pyspark.sql import functions as F
from tidemark.llm import source_mixing as mixing
from tidemark.llm.common import table


def labelled(spark, held):
    return spark.createDataFrame(held, "doc_id bigint, domain string")


def world(spark, n=600):
    """Three domains with words of their own; a tenth of the documents has words of two."""
    rnd = np.random.default_rng(3)
    words = {"good": "tree river stone bird", "low": "spam click buy win", "toxic": "fool idiot liar swine"}
    names, texts, labels = sorted(words), [], []
    for i in range(n):
        domain = names[i % 10 > 6] if i % 10 < 9 else names[2]
        pool = words[domain].split() + (words[names[i % 3]].split() if i % 10 == 5 else []) + ["and", "the", "of"]
        texts.append((i, " ".join(rnd.choice(pool, size=int(rnd.integers(20, 60))))))
        if i % 2:
            labels.append((i, domain))
    return documents(spark, texts), labelled(spark, labels)


def test_targets_are_met(spark):
    docs, labels = world(spark)
    targets = {"good": 0.6, "low": 0.3, "toxic": 0.1}
    got = mixing.mix(docs, labels, targets).collect()
    p, t, r = (np.array([x[k] for x in got], float) for k in ("posterior", "n_tokens", "rate"))
    assert got[0].domains == ["good", "low", "toxic"] and (r >= 0).all() and len(got) == 600
    reached = (r * t) @ p
    assert np.abs(reached / reached.sum() - np.array([0.6, 0.3, 0.1])).max() < 0.01


def brute(p, mass, targets, step, pace, steps):
    """The same steps on every document by itself."""
    rate = point = np.ones(len(p))
    for _ in range(steps):
        moved = np.maximum(0, point - step * (p @ (p.T @ (mass * point) - targets)))
        rate, point = moved, moved + pace * (moved - rate)
    return rate


def test_sums_by_posterior_change_nothing(spark):
    rnd = np.random.default_rng(8)
    p = np.round(rnd.dirichlet([0.5, 0.5, 0.5], 300), 2)
    tokens = rnd.integers(0, 100, 300)
    members = spark.createDataFrame([(x.tolist(), int(n)) for x, n in zip(p, tokens)], "posterior array<double>, n_tokens bigint")
    weights = np.array([0.5, 0.3, 0.2])
    solved = mixing.solve(mixing.cells_of(members), weights)
    want = brute(p, tokens / tokens.sum(), solved.targets, solved.step, solved.pace, len(solved.residuals))
    assert np.allclose(solved.rates(p), want, atol=1e-9)
    assert np.abs(solved.achieved - solved.targets).max() < 1e-3


def test_small_shares_count(spark):
    """Half of a small target lies in shares below 0.005, as documents hold them; it is met nevertheless."""
    rnd = np.random.default_rng(11)
    small = rnd.uniform(0.0005, 0.0049, 900)
    p = np.vstack([np.column_stack([0.99 - small, np.full(900, 0.01), small]), rnd.dirichlet([0.3, 1.0, 0.5], 100)])
    tokens = rnd.integers(1, 100, 1000)
    members = spark.createDataFrame([(x.tolist(), int(n)) for x, n in zip(p, tokens)], "posterior array<double>, n_tokens bigint")
    solved = mixing.solve(members, np.array([0.94, 0.05, 0.01]))
    mass = tokens / tokens.sum()
    want = brute(p, mass, solved.targets, solved.step, solved.pace, len(solved.residuals))
    assert np.allclose(solved.rates(p), want, atol=1e-9)
    assert np.abs(p.T @ (mass * want) - solved.targets).max() < 1e-3 * solved.targets.min()


def test_posteriors_are_whole(spark):
    docs, labels = world(spark)
    targets = {"good": 0.94, "low": 0.05, "toxic": 0.01}
    got = mixing.mix(docs, labels, targets).collect()
    p, t, r = (np.array([x[k] for x in got], float) for k in ("posterior", "n_tokens", "rate"))
    assert np.abs(p.sum(axis=1) - 1).max() < 1e-12 and (p > 0).all()
    reached = (r * t) @ p
    assert np.abs(reached / reached.sum() - np.array([0.94, 0.05, 0.01])).max() < 0.01 * 0.01


def test_steps_reach_the_least_squares_solution(spark):
    """Targets out of reach: no small move of any rate lowers the error."""
    p = np.array([[1.0, 0.0], [0.5, 0.5], [0.2, 0.8]])
    tokens = np.array([10, 20, 30])
    members = spark.createDataFrame([(x.tolist(), int(n)) for x, n in zip(p, tokens)], "posterior array<double>, n_tokens bigint")
    solved = mixing.solve(members, np.array([0.0, 1.0]), steps=2000, tolerance=1e-9)
    mass, rate = tokens / tokens.sum(), solved.rates(p)
    error = lambda r: ((p.T @ (mass * r) - solved.targets) ** 2).sum()
    for k in range(3):
        for move in (-1e-3, 1e-3):
            other = rate.copy()
            other[k] = max(0.0, other[k] + move)
            assert error(other) >= error(rate) - 1e-9


def test_cases(spark):
    docs = documents(spark)
    got = mixing.mix(docs, labelled(spark, [(1, "good"), (3, "good"), (8, "toxic"), (None, "low"), (99, "low")]))
    assert got.count() == len(TEXTS) and got.where("rate < 0 OR rate IS NULL").count() == 0
    assert got.where("n_tokens = 0").count() == sum(not (t or "").split() and not (t or "").strip(" \n") for _, t in TEXTS)


def test_without_labels(spark):
    docs, none = documents(spark), labelled(spark, [])
    assert {r.rate for r in mixing.mix(docs, none).collect()} == {1.0}
    assert mixing.resample(docs, none).count() == docs.count()
    assert mixing.mix(empty(spark), none).count() == 0


def test_empty_documents(spark):
    assert mixing.mix(empty(spark), labelled(spark, [(1, "good")])).count() == 0


def test_unknown_target(spark):
    docs, labels = world(spark, 60)
    with pytest.raises(ValueError):
        mixing.mix(docs, labels, {"lunar": 1.0})
    with pytest.raises(ValueError, match="lunar"):
        mixing.mix(docs, labels, {"good": 0.9, "lunar": 0.1})


def test_too_many_domains(spark, monkeypatch):
    docs, labels = world(spark, 60)
    monkeypatch.setattr(mixing, "MAX_DOMAINS", 2)
    with pytest.raises(ValueError, match="domains"):
        mixing.mix(docs, labels)


def test_clashing_column_names(spark):
    docs, labels = world(spark, 60)
    odd = docs.withColumns({"__membership": F.lit(1), "__rate": F.lit(1), "a.b": F.lit(2)})
    assert mixing.resample(odd, labels, {"good": 1.0}).columns == odd.columns


def test_resample(spark):
    docs, labels = world(spark)
    drawn = mixing.resample(docs, labels, {"good": 0.95, "low": 0.04, "toxic": 0.01})
    assert drawn.columns == docs.columns
    left = {r.doc_id for r in drawn.collect()}
    share = lambda keep: np.mean([i in left for i in range(600) if keep(i % 10)])
    assert share(lambda k: k < 5) > 0.97 and share(lambda k: k in (7, 8)) < 0.4 and share(lambda k: k == 9) < 0.3


def test_held_out_accuracy(spark):
    """Trained on the labels of even documents, measured on those of odd ones."""
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), mixing.domains_of(table(spark, "/root/testdata/sf0.1", "labels"))
    model = mixing.fit(docs, labels.where("doc_id % 2 = 0"))
    best = F.element_at(F.array(*map(F.lit, model.domains)), F.expr("array_position(m.posterior, array_max(m.posterior))").cast("int"))
    found = mixing.with_membership(docs.select("doc_id", "text"), model, "m").join(labels.where("doc_id % 2 = 1"), "doc_id")
    assert found.agg(F.avg((best == F.col("domain")).cast("int"))).first()[0] > 0.85


def test_drawing_takes_one_python_step(spark):
    """A second Python step in a task takes a second worker, which stays beside the first in later stages."""
    docs, labels = world(spark)
    targets = {"good": 0.95, "low": 0.04, "toxic": 0.01}
    drawn = mixing.resample(docs, labels, targets)
    assert drawn._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    told = mixing.mix(docs, labels, targets).select("doc_id", "rate").join(docs, "doc_id").where(F.col("rate") > place)
    assert {r.doc_id for r in drawn.collect()} == {r.doc_id for r in told.collect()}
