import hashlib
import re
from collections import Counter, defaultdict

from corpus_fixtures import TEXTS, documents, empty, rows
from tidemark.llm import exact_dedup


def digest(text):
    return hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", text or "").encode()).hexdigest()


def brute(texts):
    groups = defaultdict(list)
    for i, t in texts:
        groups[digest(t)].append(i)
    out = []
    for i, t in texts:
        ids = [x for x in groups[digest(t)] if x is not None]
        keep = min(ids) if ids else None
        out.append((i, keep, len(groups[digest(t)]), i == keep, digest(t)))
    return out


def ordered(found):
    return sorted(found, key=lambda r: tuple((v is not None, v) for v in r))


def test_groups(spark):
    assert ordered(map(tuple, exact_dedup.exact_groups(documents(spark)).collect())) == ordered(brute(TEXTS))


def test_a_third_of_all_rows_are_one_text(spark):
    texts = [(i, "hot" if i % 3 == 0 else "warm" if i % 7 == 0 else f"t{i // 2}") for i in range(3000)]
    assert ordered(map(tuple, exact_dedup.exact_groups(documents(spark, texts)).collect())) == ordered(brute(texts))


def test_the_summary_only_proposes(spark):
    """With too few counters for the data, groups are the same."""
    texts = [(i, f"t{i % 400}") for i in range(4000)]
    digests = documents(spark, texts).select("doc_id", exact_dedup.digest_of().alias("digest"))
    for row in exact_dedup.frequent(digests, counters=16, winners=4).collect():
        assert row.group_size == 10 and row.keep_id < 400


def test_documents_that_stay(spark):
    docs = documents(spark)
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    assert max(got.values()) == 1
    want = {}
    for i, t in TEXTS:
        held = want.setdefault(digest(t), (i, t))
        if i is not None and (held[0] is None or i < held[0]):
            want[digest(t)] = (i, t)
    assert set(got) == set(want.values())


def test_empty(spark):
    assert exact_dedup.exact_groups(empty(spark)).count() == 0 == exact_dedup.exact_dedup(empty(spark)).count()


def test_main_path_is_native_and_winners_are_broadcast(spark):
    found = exact_dedup.exact_groups(documents(spark))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan
    assert rows(found)


def test_clashing_column_names(spark):
    names = ["__digest", "__first", "__hit", "__heavy", "__block", "__w0", "__words", "__group", "a.b", "c`d", "__HIT_"]
    docs = documents(spark).selectExpr("*", *(f"doc_id AS `{n.replace('`', '``')}`" for n in names))
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns
    assert rows(kept.select("doc_id", "text")) == rows(exact_dedup.exact_dedup(documents(spark)).select("doc_id", "text"))
    assert all(r["__hit"] == r["doc_id"] for r in kept.collect())

