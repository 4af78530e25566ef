import os
import zlib

import numpy as np
import public_tokenizers
import pytest
from corpus_fixtures import TEXTS, documents, empty
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tidemark.llm import token_files as files
from tidemark.session import staged, work_dir
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)
TOKENIZER.encode_special_tokens = True


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    assert files.encode_texts([text], PATH)[0].tolist() == ids_of(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aAbZz '.,-(_^`~<|>!0é\x7f"), max_size=60))
def test_letters_and_signs(text):
    assert files.encode_texts([text], PATH)[0].tolist() == ids_of(text)


def test_plain_chunks_go_by_word(monkeypatch):
    """Chunks of ASCII letters and signs aren't put into a text for the whole tokenizer, at four times the cost."""
    made, *rest = files._made_tokenizer(PATH, False)

    class Counting:
        whole = []

        def encode_batch_fast(self, texts, **options):
            self.whole += texts
            return made.encode_batch_fast(texts, **options)

    monkeypatch.setattr(files, "_tokenizer", lambda path, added: (Counting(), *rest))
    texts = ["Plain words, (and) signs -- here! x_y", "don't a0", "-" * 50_000 + "é"]
    assert [x.tolist() for x in files.encode_texts(texts[:1], PATH)] == [ids_of(texts[0])]
    assert Counting.whole == ["x_y"]
    assert [x.tolist() for x in files.encode_texts(texts, PATH)] == [ids_of(t) for t in texts]


def test_odd_texts():
    texts = ["0 a 0", "a0b", "x\x1cy", "ΑΣ ΑΣ", "İ", "e\u0301 \u0301", "<|endoftext|>", "a" * 500, "\x85 \u2003", "it's 'S", "𝟘 ٠ 0"] * 2
    assert [x.tolist() for x in files.encode_texts(texts, PATH)] == [ids_of(t) for t in texts]


def test_added_tokens_are_recognised(spark):
    """By the file as given, without any switch."""
    given = Tokenizer.from_file(PATH)
    texts = [
        "a <|endoftext|> b", "<|startoftext|>0 A<|endoftext|>", "a  <|ENDOFTEXT|> 0 b", "x\x1cy <|endoftext|>", "<|endoftext|", "plain 0 Text",
        "É <|startoftext|>\n\n<|endoftext|> é", "<|endoftext|>" * 3, "<| endoftext |>",
    ]
    want = [given.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] != ids_of(texts[0])
    assert [x.tolist() for x in files.encode_texts(texts * 2, PATH, added=True)] == want * 2
    folder = work_dir(spark, "tokens")
    index = files.with_starts(staged(files.write(documents(spark, list(enumerate(texts))), folder, PATH)))
    got = files.read(index, folder, files.ids_of, "ids array<bigint>").collect()
    assert {r.doc_id: r.ids for r in got} == {i: ids + [1] for i, ids in enumerate(want)}


def expected(texts):
    found, start = [], 0
    for i, text in sorted(texts, key=lambda r: (r[0] is not None, r[0])):
        ids = ids_of(text) + [1]
        found.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return found


def test_round_trip(spark):
    texts = [(i, t) for i, t in TEXTS if i is not None]
    got = files.write_and_check(spark, documents(spark, texts), work_dir(spark, "tokens"), PATH)
    assert sorted(map(tuple, got.collect())) == expected(texts)


def test_null_numbers_come_first(spark):
    got = files.write_and_check(spark, documents(spark), work_dir(spark, "tokens"), PATH).collect()
    without = [r for r in got if r.doc_id is None]
    assert len(got) == len(TEXTS) and {r.start for r in without} == {0, min(r.n_tokens for r in without)} | {0} or len(without) == 2
    assert max(r.start for r in without) < min(r.start for r in got if r.doc_id is not None)


def test_empty(spark):
    assert files.write_and_check(spark, empty(spark), work_dir(spark, "tokens"), PATH).count() == 0


def test_only_asked_frames_are_read(spark):
    folder = work_dir(spark, "tokens")
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("n "), F.repeat(F.lit("some words here "), 60), "id").alias("text"))
    index = files.with_starts(staged(files.write(docs.coalesce(1), folder, PATH)))
    asked = files.read(index.where("doc_id IN (0, 299)"), folder, files.ids_of, "ids array<bigint>")
    texts = {r.doc_id: r.text for r in docs.where("doc_id IN (0, 299)").collect()}
    assert {r.doc_id: r.ids for r in asked.collect()} == {i: ids_of(t) + [1] for i, t in texts.items()}


def shard(folder, arrays):
    path = os.path.join(folder, "one.ids")
    with open(path, "wb") as sink:
        writer = files.ShardWriter(sink)
        for ids in arrays:
            writer.append(np.array(ids, np.uint32))
        writer.close()
    return path


class Source:
    def __init__(self, path):
        self.file = open(path, "rb")
        self.seek, self.read, self.close = self.file.seek, self.file.read, self.file.close
        self.size = lambda: os.path.getsize(path)


def test_a_document_over_many_frames(tmp_path):
    ids = np.arange(5 * files.FRAME_IDS + 17)
    reader = files.ShardReader(Source(shard(tmp_path, [[1, 2, 3], ids, [9]])))
    assert np.concatenate(list(reader.parts(3, len(ids)))).tolist() == ids.tolist()
    before = reader.frames_read
    assert np.concatenate(list(reader.parts(3 + len(ids), 1))).tolist() == [9] and reader.frames_read == before
    assert len(reader.entries) == 6


def test_frames_are_plain_zstandard(tmp_path):
    """The seek table is a skippable frame, so any decoder reads the whole file."""
    import io

    import zstandard

    path = shard(tmp_path, [range(40_000)])
    with open(path, "rb") as file:
        plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(file.read()), read_across_frames=True).read()
    assert np.frombuffer(plain, "<u4").tolist() == list(range(40_000))


def test_damage_is_found(tmp_path):
    path = shard(tmp_path, [range(1000)])
    with open(path, "r+b") as file:
        file.seek(-files.FOOTER.size - 4, os.SEEK_END)
        file.write(b"\0\0\0\0")
    with pytest.raises(ValueError, match="damaged"):
        list(files.ShardReader(Source(path)).parts(0, 10))
    with open(path, "r+b") as file:
        file.truncate(20)
    with pytest.raises((ValueError, OSError)):
        files.ShardReader(Source(path))
