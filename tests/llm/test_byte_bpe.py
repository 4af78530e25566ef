import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from corpus_fixtures import TEXTS, documents, empty
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tidemark.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
RANKS = byte_bpe.load_ranks(PATH)
ENCODING = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    assert byte_bpe.encode_text(text, PATH, PATTERN).tolist() == ENCODING.encode_ordinary(text)


def test_characters_of_another_unicode_version():
    """Letters and numbers that are too new for the public library are neither to it."""
    young = [chr(c) for c in sorted(byte_bpe._stand_ins())]
    rnd = random.Random(5)
    texts = ["\U0003e964\ub000", "\U0003e964\ub000 \U00011de0\u0660's"]
    texts += ["".join(rnd.choice([rnd.choice(young), *"a1 \ub000\u0660\U00020000'"]) for _ in range(12)) for _ in range(3000)]
    for text in texts:
        assert byte_bpe.encode_text(text, PATH, PATTERN).tolist() == ENCODING.encode_ordinary(text)


@pytest.fixture(scope="module")
def transducer():
    return byte_bpe.Transducer(RANKS)


def test_any_bytes(transducer):
    rnd = random.Random(3)
    for _ in range(500):
        data = bytes(rnd.randrange(256) for _ in range(rnd.randint(1, 40)))
        assert list(transducer.encode(data)) == ENCODING._encode_single_piece(data)


def test_long_repeats(transducer):
    for unit in ("a", "ab", "the", "é", "aab"):
        data = (unit * 3000).encode()
        assert list(transducer.encode(data)) == ENCODING._encode_single_piece(data)


def test_tables_are_bounded():
    small = byte_bpe.Transducer(RANKS, states=20, pairs=50)
    rnd = random.Random(4)
    for _ in range(200):
        data = "".join(rnd.choice(["th", "e", "an", "q", "é", "ing"]) for _ in range(12)).encode()
        assert list(small.encode(data)) == ENCODING._encode_single_piece(data)
    assert len(small.sets) <= 20 and small.known_pairs <= 53
    pieces = byte_bpe._Pieces(small.encode, limit=5)
    for text in "a b c d e f g h a b c " .split() * 3:
        assert list(pieces[text]) == ENCODING.encode_ordinary(text)
        assert len(pieces) <= 5 and len(pieces.old) <= 5


def test_merges_are_carried_out_once_a_token():
    """Whether a token may follow another is seen from their halves, not by merging each pair anew."""
    reader, merges = byte_bpe.Transducer(RANKS, states=2), []
    plain = reader.merged
    reader.merged = lambda data, parts=1: merges.append(data) or plain(data, parts)
    rnd = random.Random(6)
    for _ in range(3000):
        data = "".join(rnd.choice(["th", "e", "an", "q", "er", "ing", "ou", "s", "é", "\u0660"]) for _ in range(rnd.randint(1, 9))).encode()
        assert list(reader.encode(data)) == ENCODING._encode_single_piece(data)
    assert len(merges) <= 2 * len(reader.halves) and reader.known_pairs > 2 * len(merges)


def test_ranks_out_of_order():
    """Tokens whose parts come later than they do: order of ranks isn't order of merges."""
    rnd = random.Random(7)
    for _ in range(60):
        words = {bytes(rnd.choice(b"abc") for _ in range(rnd.randint(2, 5))) for _ in range(rnd.randint(3, 25))}
        tokens = [bytes([i]) for i in range(256)] + sorted(words)
        numbers = rnd.sample(range(len(tokens)), len(tokens))
        ranks = dict(zip(tokens, numbers))
        own = tiktoken.Encoding("odd", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        readers = [byte_bpe.Transducer(ranks, states=n) for n in (2, 20_000)]
        for _ in range(40):
            data = bytes(rnd.choice(b"abc") for _ in range(rnd.randint(1, 14)))
            for reader in readers:
                assert list(reader.encode(data)) == own._encode_single_piece(data)


def test_output_comes_before_the_end(transducer):
    """Lookahead is bounded: after a long piece few tokens are still pending."""
    state, emitted = 0, 0
    for byte in b"internationalization" * 20:
        out, state = transducer.steps.get(state << 8 | byte) or transducer._step(state, byte)
        emitted += len(out)
    assert emitted > 50 and max(len(p) for p, _, _ in transducer.sets[state]) < 12


def test_round_trip(spark):
    got = byte_bpe.round_trip(documents(spark), PATH, PATTERN).collect()
    found = sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256, r.whole_text) for r in got)
    want = []
    for _, text in TEXTS:
        ids = ENCODING.encode_ordinary(text or "")
        sha = [hashlib.sha256(x).hexdigest() for x in (",".join(map(str, ids)).encode(), (text or "").encode())]
        want.append((len(ids), *sha, True))
    assert found == sorted(want)
    assert byte_bpe.round_trip(empty(spark), PATH, PATTERN).count() == 0


def test_columns_pass(spark):
    docs = documents(spark)
    got = byte_bpe.encode(docs, PATH, PATTERN)
    assert got.columns == [*docs.columns] and dict(got.dtypes)["ids"] == "array<int>"  # ids is replaced
    decoded = byte_bpe.decode(got.withColumn("ids", F.when(F.col("doc_id") > 8, F.col("ids"))), PATH)
    assert all(r.decoded.bytes == (r.text or "").encode() if r.doc_id and r.doc_id > 8 else r.decoded.bytes == b"" for r in decoded.collect())


def test_streaming_decode():
    machine = byte_bpe.machine_of(PATH)
    text = "naïve – 😀😀 中文 ß" * 5
    ids = ENCODING.encode_ordinary(text)
    for size in (1, 2, 3, 7):
        decoder = byte_bpe.StreamDecoder(machine)
        parts = [decoder.feed(ids[i:i + size]) for i in range(0, len(ids), size)]
        assert "".join(parts) + decoder.finish() == text and "\ufffd" not in "".join(parts)
    decoder = byte_bpe.StreamDecoder(machine)
    first = RANKS[b"\xf0"]
    assert decoder.feed([first]) == "" and decoder.finish() == "\ufffd"
    assert machine.run(0, np.array([first])) > 0 and machine.run(0, np.array([RANKS[b"\xff"]])) == machine.BROKEN


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=30), st.integers(1, 5))
def test_feeds_of_any_bytes(data, size):
    """Whatever the feeds, the bytes are those of all ids, and the state is that of all bytes."""
    machine = byte_bpe.machine_of(PATH)
    ids = [RANKS[bytes([b])] for b in data] + ENCODING.encode_ordinary("é und 中")
    decoder = byte_bpe.StreamDecoder(machine)
    parts = [decoder.feed_bytes(ids[i:i + size]) for i in range(0, len(ids), size)]
    whole = data + "é und 中".encode()
    assert b"".join(parts) + decoder.rest() == whole
    assert decoder.state == machine.over_bytes(0, whole) == machine.run(0, np.array(ids))


def test_documents_are_decoded_in_feeds(spark):
    texts = ["naïve – 😀😀 中文 ß" * 300, "", "plain words " * 9000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = byte_bpe.decode(byte_bpe.encode(docs, PATH, PATTERN), PATH).collect()
    assert all(r.decoded.bytes == r.text.encode() and r.decoded.text for r in got)
    assert max(len(r.ids) for r in got) > byte_bpe.FEED
    broken = docs.limit(1).select(F.array(F.lit(RANKS[b"\xff"]), F.lit(RANKS[b"a"])).alias("ids"))
    assert byte_bpe.decode(broken, PATH).first().decoded == (b"\xffa", False)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=12))
def test_machine_agrees_with_the_codec(data):
    try:
        data.decode("utf-8")
        good = True
    except UnicodeDecodeError:
        good = False
    assert (byte_bpe.machine_of(PATH).over_bytes(0, data) == 0) is good
