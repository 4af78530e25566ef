import numpy as np
import public_tokenizers
import pytest
from corpus_fixtures import TEXTS, documents, empty, rows
from pyspark.sql import functions as F
from tidemark.llm import token_counts as counts

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def spans(text):
    """Character span of each token, byte by byte."""
    encoding, _ = counts._encoding(PATH, PATTERN)
    owner = [i for i, c in enumerate(text) for _ in c.encode("utf-8")]
    at, out = 0, []
    for token in encoding.encode_ordinary(text):
        size = len(encoding.decode_single_token_bytes(token))
        out.append((owner[at], owner[at + size - 1] + 1))
        at += size
    return out


def brute(text, starts, rule):
    bounds = [*starts, len(text)]
    held = np.zeros(len(starts))
    crossing = np.zeros(len(starts), int)
    for a, b in spans(text):
        share = [max(0, min(b, bounds[k + 1]) - max(a, bounds[k])) for k in range(len(starts))]
        touched = [k for k, s in enumerate(share) if s]
        if len(touched) > 1:
            crossing[touched] += 1
        if rule == "share":
            held += np.array(share) / sum(share)
        else:
            held[{"first": touched[0], "last": touched[-1], "most": max(touched, key=lambda k: (share[k], -k))}[rule]] += 1
    return held.tolist(), crossing.tolist()


@pytest.mark.parametrize("rule", counts.RULES)
@pytest.mark.parametrize("text, starts", [
    ("hello world of tokens", [0, 3, 8, 13, 14]), ("déjà vu 😀😀 中文字 test", [0, 2, 8, 9, 11, 13]),
    ("internationalization unbelievable", [0, 1, 2, 5, 10, 20, 30]), ("abc", [0]), ("\n\n\n  x", [0, 1, 3, 4]),
])
def test_rules(text, starts, rule):
    got = counts.allocate(*counts.token_spans(text, PATH, PATTERN), np.array(starts), len(text), rule)
    held, crossing = brute(text, starts, rule)
    assert np.allclose(got[0], held) and got[1].tolist() == crossing
    assert got[0].sum() == pytest.approx(len(spans(text)))


def test_lines(spark):
    got = rows(counts.by_section(documents(spark), PATH, PATTERN).where("doc_id IS NOT NULL AND doc_id < 14"))
    want = []
    for i, text in TEXTS:
        if i is None or i >= 14:
            continue
        text = text or ""
        starts = counts.line_starts(text)
        held, crossing = brute(text, starts, "most") if text else ([0.0], [0])
        want += [(i, k, a, b, held[k], crossing[k]) for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(text)]))]
    assert got == sorted(want)
    assert counts.by_section(empty(spark), PATH, PATTERN).count() == 0


def test_sums_are_token_counts(spark):
    encoding, _ = counts._encoding(PATH, PATTERN)
    for rule in counts.RULES:
        got = counts.by_section(documents(spark, [(i, t) for i, t in TEXTS if i and i < 14]), PATH, PATTERN, rule).groupBy("doc_id").agg(F.sum("n_tokens")).collect()
        want = {i: len(encoding.encode_ordinary(t or "")) for i, t in TEXTS if i and i < 14}
        assert {r[0]: round(r[1], 6) for r in got} == want


def test_given_sections(spark):
    docs = spark.createDataFrame([(1, "hello world", [3, 8, 99, -4, None, 3]), (2, None, [5]), (3, "abc", None)], "doc_id bigint, text string, starts array<int>")
    got = rows(counts.by_section(docs, PATH, PATTERN, "first", "starts").select("doc_id", "start", "end", "n_tokens"))
    assert got == [(1, 0, 3, 1.0), (1, 3, 8, 1.0), (1, 8, 11, 0.0), (1, 11, 11, 0.0), (2, 0, 0, 0.0), (3, 0, 3, 1.0)]


def test_fields(spark):
    data = spark.createDataFrame([(1, "user", "hello world", None), (2, None, None, "x"), (3, None, None, None)], "id bigint, role string, body string, note string")
    got = rows(counts.by_field(data, "id", ["role", "body", "note"], PATH, PATTERN))
    whole = len(counts._encoding(PATH, PATTERN)[0].encode_ordinary("user\nhello world\n"))
    assert sum(r[2] for r in got if r[0] == 1) == whole and {r[1] for r in got if r[0] == 2} == {"role", "body", "note"}


def test_unknown_rule(spark):
    with pytest.raises(ValueError):
        counts.by_section(documents(spark), PATH, PATTERN, "lunar")
