import random

import numpy as np
import pytest
from corpus_fixtures import TEXTS, documents, empty, rows
from tidemark.llm import ngram_join as join


def shingles(text):
    words = [w for w in (text or "").translate({i: i + 32 for i in range(65, 91)}).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return set()
    return {tuple(words)} if len(words) < 5 else {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def brute(texts):
    sets = [shingles(t) for _, t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(texts):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, len(sets[k]), least.get(find(k))) for k, (i, _) in enumerate(texts)), key=lambda r: tuple((v is not None, str(type(v)), v) for v in r))


def edited(rnd, words, n):
    words = list(words)
    for _ in range(n):
        words[rnd.randrange(len(words))] = f"new{rnd.randrange(10**6)}"
    return " ".join(words)


def corpus(seed, n):
    """Copies, near copies around the threshold, a passage that many share, and loose texts."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    bases = [[rnd.choice(vocabulary) for _ in range(rnd.choice([3, 5, 8, 30, 60, 120]))] for _ in range(8)]
    passage = " ".join(rnd.choice(vocabulary) for _ in range(55))
    texts = []
    for i in range(n):
        kind = rnd.random()
        base = rnd.choice(bases)
        if kind < 0.2:
            texts.append(" ".join(base))
        elif kind < 0.6:
            texts.append(edited(rnd, base, rnd.randrange(0, 4)))
        elif kind < 0.75:
            texts.append(passage + " " + " ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(5, 40))))
        else:
            texts.append(" ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(0, 50))))
    return list(enumerate(texts, 1))


def test_cases(spark):
    assert rows(join.members(documents(spark))) == brute(TEXTS)


@pytest.mark.parametrize("seed", [1, 2])
def test_corpus(spark, seed):
    texts = corpus(seed, 250)
    assert rows(join.members(documents(spark, texts))) == brute(texts)


def test_near_copies_without_a_number(spark):
    """Two numbered documents are linked only through rows without a number, two pairs of which have no other link."""
    words = [f"n{i}" for i in range(60)]
    middle, first, last = " ".join(words), " ".join(["x"] * 6 + words[6:]), " ".join(words[:-6] + ["y"] * 6)
    other = [f"m{i}" for i in range(40)]
    texts = [(2, first), (None, middle), (1, last), (None, middle), (None, " ".join(other)), (None, " ".join(other[1:])), (7, "some words that no other text has")]
    want = brute(texts)
    assert sorted(str(c) for i, _, c in want if i is None) == ["1", "1", "None", "None"]
    assert rows(join.members(documents(spark, texts))) == want
    assert sorted(str(r.doc_id) for r in join.keep_first(documents(spark, texts)).collect()) == ["1", "7", "None", "None", "None", "None"]


def test_blocks_and_hot_shingles(spark, monkeypatch):
    """Lists cut into small blocks, and shingles dealt over tasks, lose no link."""
    monkeypatch.setattr(join, "BLOCK", 5)
    monkeypatch.setattr(join, "HOT", -10**9)
    texts = corpus(3, 150)
    assert rows(join.members(documents(spark, texts))) == brute(texts)


def test_groups_of_equal_prefix(spark):
    """Sets that differ only in common shingles have one prefix and still all meet."""
    rnd = random.Random(4)
    common = [" ".join(f"c{k}x{j}" for j in range(12)) for k in range(6)]
    rare = " ".join(f"r{j}" for j in range(60))
    texts = [(i, " ".join([rare, rnd.choice(common)])) for i in range(1, 30)] + [(100 + i, f"{rnd.choice(common)} {i}") for i in range(200)]
    assert rows(join.members(documents(spark, texts))) == brute(texts)


def test_a_third_of_all_rows_are_one_text(spark):
    texts = [(i, "one and the same text of some eight words" if i % 3 == 0 else f"text {i} with words {i * 7} and {i * 11} more of {i}") for i in range(1, 600)]
    assert rows(join.members(documents(spark, texts))) == brute(texts)


def test_prefix_of_linked_sets_meet():
    rnd = np.random.default_rng(7)
    common = rnd.integers(0, 50, 1 << join.BUCKET_BITS)
    for _ in range(300):
        n = int(rnd.integers(1, 60))
        a = np.unique(rnd.integers(0, 2**64, n, dtype=np.uint64))
        b = np.unique(np.append(a[rnd.random(len(a)) < 0.9], rnd.integers(0, 2**64, int(rnd.integers(0, 8)), dtype=np.uint64)))
        both = len(np.intersect1d(a, b))
        if len(b) and join.linked(np.array(both), len(a), len(b)):
            assert len(np.intersect1d(join.prefix(a, common), join.prefix(b, common)))
            bits = np.bitwise_count(np.frombuffer(join.bitmap(a), np.uint64) ^ np.frombuffer(join.bitmap(b), np.uint64)).sum()
            assert join.linked((len(a) + len(b) - int(bits)) // 2, len(a), len(b))


def test_documents_that_stay(spark):
    docs = documents(spark)
    kept = join.keep_first(docs)
    assert kept.columns == docs.columns
    going = {i for i, _, c in brute(TEXTS) if i is not None and i != c}
    want = [(i, t) for i, t in TEXTS if i not in going]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)


def test_empty(spark):
    assert join.members(empty(spark)).count() == 0 == join.keep_first(empty(spark)).count()
    assert rows(join.members(documents(spark, [(1, None), (2, "")]))) == [(1, 0, 1), (2, 0, 2)]


def test_clashing_column_names(spark):
    docs = documents(spark).selectExpr("*", *(f"doc_id AS `{n}`" for n in ("__hit", "__block", "__words", "x.y")))
    kept = join.keep_first(docs)
    assert kept.columns == docs.columns and all(r["__hit"] == r["doc_id"] for r in kept.collect())
    assert rows(kept.select("doc_id")) == rows(join.keep_first(documents(spark)).select("doc_id"))



def test_sets_that_link_share_an_early_shingle_of_the_smaller():
    """By which late rows of a list meet none that is as large or larger."""
    rnd = np.random.default_rng(7)
    common = np.zeros(1 << join.BUCKET_BITS, np.int64)
    linked = 0
    for _ in range(3000):
        n = int(rnd.integers(1, 60))
        base = np.unique(rnd.integers(0, 1 << 63, n, dtype=np.uint64))
        other = np.unique(np.append(base[rnd.random(len(base)) > rnd.choice([0, 0.05, 0.13])], rnd.integers(0, 1 << 63, int(rnd.integers(0, 2 + n // 5)), dtype=np.uint64)))
        small, large = sorted((base, other), key=len)
        if len(small) and join.linked(len(np.intersect1d(small, large)), len(small), len(large)):
            linked += 1
            own, theirs = join.prefix(small, common), join.prefix(large, common)
            assert len(np.intersect1d(own[:join.early(len(small))], theirs))
    assert linked > 1000


def test_copies_in_different_tasks_make_no_list(spark):
    """A list is for shingles that two groups share; copies are one group wherever they are read."""
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    alone = [" ".join(rnd.sample(words, 60)) for _ in range(5)]
    near = [" ".join([*words[:50], f"x{i}"]) for i in range(2)]
    texts = [(i, t) for i, t in enumerate((alone + near) * 4)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(8)
    common = spark.sparkContext.broadcast(join.bucket_counts(join.sketches(docs)))
    got = join.lists_of(docs, common).collect()
    listed = [(r.token, r.gid) for r in got if r.key is None]
    named = [(r.gid, r.key) for r in got if r.key is not None]
    assert len(named) == len(set(named)) == 7 and len(listed) == len(set(listed)) > 0
    of = {}
    for token, gid in listed:
        of.setdefault(token, set()).add(gid)
    assert all(len(gids) == 2 for gids in of.values())
