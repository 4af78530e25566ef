import zlib

import pytest
import zstandard

from corpus_fixtures import TEXTS, documents, empty, rows
from pyspark.sql import functions as F
from tidemark.llm import language_id as lang
from tidemark.llm.common import hashed_sample, table

MODEL = {"en": lang.letters_of("the cat and the dog were in the house with the others " * 5), "de": lang.letters_of("der hund und die katze waren in dem haus mit den anderen " * 5)}


def test_held_out(spark):
    got = spark.range(200).select("id", lang.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in got)


def test_cases(spark):
    got = lang.predict(documents(spark), MODEL)
    assert got.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"] and got.count() == len(TEXTS)
    for r, text in zip(got.collect(), [t for _, t in TEXTS]):
        letters = any(c.isalpha() for c in text or "")
        assert (r.lang_pred == "und") is not letters and 0 <= r.score <= 1
    assert rows(lang.predict(documents(spark, [(1, "the dog and the house"), (2, "der hund und das haus")]), MODEL).select("doc_id", "lang_pred")) == [(1, "en"), (2, "de")]


def test_only_text_decides(spark):
    docs = documents(spark, [(1, "the dog and the house with the cat")])
    other = docs.withColumn("lang", F.lit("de")).withColumn("source", F.lit("de")).withColumn("doc_id", F.lit(99).cast("bigint"))
    assert lang.predict(docs, MODEL).first()[2:] == lang.predict(other, MODEL).first()[2:]


def test_without_labels(spark):
    model = lang.fit(lang.learnable(documents(spark).withColumn("lang", F.lit(None).cast("string"))))
    assert model == {} and {r.lang_pred for r in lang.predict(documents(spark), model).collect()} == {"und"}
    assert lang.keep_known(documents(spark), model).count() == 0
    assert lang.predict(empty(spark), MODEL).count() == 0 and lang.fit(empty(spark)) == {}


def test_one_language(spark):
    assert lang.classify("x y", (("en", b"abc"),)) == ("en", 1.0)


def test_rejection(spark):
    docs = documents(spark, [(1, "the dog and the cat were in the house"), (2, "123"), (3, None), (4, "zzz")])
    kept = lang.keep_known(docs, MODEL)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {1} and not {r.doc_id for r in kept.collect()} & {2, 3, 4}


def test_sample_is_bounded_and_repeatable(spark):
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text"), F.when(F.col("id") % 10 == 0, "de").otherwise("en").alias("lang"))
    one, two = (hashed_sample(many.repartition(n), "lang", 50, 10, "doc_id").select("doc_id", "lang", "sample_total").collect() for n in (2, 7))
    assert sorted(one) == sorted(two) and len(one) == 100 and {r.sample_total for r in one} == {2000, 18000}


def test_held_out_accuracy(spark):
    """Measured on rows that the model didn't see."""
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    found = lang.predict(docs, lang.fit(lang.learnable(docs)))
    truth = docs.select("doc_id", "lang")
    right = found.where("held_out").join(truth.where("lang IS NOT NULL"), "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.avg(F.col("rejected").cast("int"))).first()
    assert right[0] > 0.95 and right[1] < 0.03


def test_against_a_plain_loop(spark):
    """Every piece of every text with every dictionary; also marks that are no letters."""
    texts = TEXTS + [(40, "½ ²"), (41, "①② ٣"), (42, "ª"), (43, "the cat " * 3000), (44, "der hund und the cat"), (45, "_ 12 _")]
    want = []
    for doc_id, text in texts:
        data = lang.letters_of(text)
        if not any(c.isalpha() for c in text or ""):
            want.append((doc_id, "und", 0.0))
            continue
        sizes = []
        for name, words in sorted(MODEL.items()):
            dictionary = zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(level=lang.LEVEL)
            packer = zstandard.ZstdCompressor(level=lang.LEVEL, dict_data=dictionary, write_content_size=False)
            sizes.append((sum(len(packer.compress(data[i:i + lang.PIECE])) for i in range(0, len(data), lang.PIECE)), name))
        sizes.sort()
        want.append((doc_id, sizes[0][1], 1 - sizes[0][0] / sizes[1][0]))
    got = lang.predict(documents(spark, texts), MODEL).select("doc_id", "lang_pred", "score")
    assert rows(got) == sorted(want, key=lambda r: tuple((v is not None, str(type(v)), v) for v in r))


def test_the_whole_sample_is_used(spark):
    """Runs from anywhere in a text, and no byte of them is thrown away."""
    docs = documents(spark, [(i, f"{'anfang ' * 400}{'mitte ' * 400}{'ende ' * 400}{i}") for i in range(300)])
    model = lang.fit(docs.withColumn("lang", F.lit("de")))
    assert len(model["de"]) > 150_000 and all(w in model["de"] for w in (b"anfang", b"mitte", b"ende"))


def test_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(lang, "MAX_LANGUAGES", 1)
    two = documents(spark, [(1, "a b"), (2, "c d")]).withColumn("lang", F.col("doc_id").cast("string"))
    with pytest.raises(ValueError, match="languages"):
        lang.fit(two)


def test_clashing_column_names(spark):
    docs = documents(spark).withColumns({"__language": F.lit(1), "a.b": F.lit(2)})
    assert lang.keep_known(docs, MODEL).columns == docs.columns
