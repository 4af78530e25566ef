"""Language identification by compression.

A model is one text per language, used as a zstandard raw-content dictionary. A
text is cut into pieces; each piece is compressed with each dictionary, and the
language with the smallest sum wins. The score is the share of bytes that the
best dictionary saves against the second best; where it is narrow the prediction
is rejected.

Dictionaries come from a bounded sample of labelled rows: ``SAMPLE_DOCS``
documents of each language, chosen by a hash of ``doc_id``, of each a run of
``SAMPLE_CHARS`` characters from a place that the hash names. All of the sample is
used. More than ``MAX_LANGUAGES`` languages are an error. Prediction reads whole
texts and nothing but texts. A letter is what Unicode calls one (category L).

A null text or one without a letter is ``und``, score 0, rejected. Without any
labelled row every text is ``und``. With one language only, it is predicted with
score 1. Ties go to the first language by name. Repeated rows are predicted alike.
"""

from __future__ import annotations

import re

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.llm.common import bounded_batches, free_name, hashed_sample, tool

SAMPLE_DOCS = 300
SAMPLE_CHARS = 1200
MAX_LANGUAGES = 256
PIECE = 4096
LEVEL = 3
#: Scores below are rejected.
NARROW = 0.01
UNKNOWN = "und"
NO_LETTER = re.compile(r"[\W\d_]+")


def held_out(doc_id: Column) -> Column:
    """Rows that a model must not learn from."""
    return F.crc32(doc_id.cast("string")) % 4 == 2


def letters_of(text: str | None) -> bytes:
    """Lower-case letters, with one space for anything else."""
    return NO_LETTER.sub(" ", (text or "").lower()).strip().encode("utf-8")


def fit(labelled: DataFrame, docs: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> dict[str, bytes]:
    """Dictionaries from rows with ``doc_id, text, lang``. At most ``MAX_LANGUAGES``
    languages and ``docs`` rows of each come to the driver."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select(
        "doc_id", "lang", F.expr(f"substring(text, int(1 + pmod(xxhash64(doc_id, 'place'), greatest(1, length(text) - {chars} + 1))), {chars})").alias("text")
    )
    if rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    sample = hashed_sample(rows, "lang", docs, MAX_LANGUAGES, "doc_id", "text")
    found: dict[str, list[bytes]] = {}
    for row in sorted(sample.collect(), key=lambda r: (r.lang, r.sample_rank)):
        found.setdefault(row.lang, []).append(letters_of(row.text))
    return {lang: b" ".join(dict.fromkeys(texts)) for lang, texts in sorted(found.items())}


def _compressors(model: tuple[tuple[str, bytes], ...]):
    return tool("language_id", model, lambda: _packers(model))


def _packers(model: tuple[tuple[str, bytes], ...]):
    made = []
    for lang, data in model:
        raw = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        raw.precompute_compress(level=LEVEL)
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=raw, write_content_size=False, write_checksum=False)
        made.append((lang, packer.compress))
    return made


def classify(text: str | None, model: tuple[tuple[str, bytes], ...]) -> tuple[str, float]:
    data = letters_of(text)
    if not model or not any(map(str.isalpha, data.decode("utf-8"))):
        return UNKNOWN, 0.0
    pieces = [data[i:i + PIECE] for i in range(0, len(data), PIECE)]
    sizes = sorted((sum(len(pack(p)) for p in pieces), lang) for lang, pack in _compressors(model))
    if len(sizes) == 1:
        return sizes[0][1], 1.0
    return sizes[0][1], 1.0 - sizes[0][0] / sizes[1][0]


def predict_column(text: str | Column, model: dict[str, bytes]) -> Column:
    """A struct ``lang, score``."""
    known = tuple(sorted(model.items()))

    @F.arrow_udf(T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())]))
    def predict(texts: pa.Array) -> pa.Array:
        found = [classify(t, known) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays(
            [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["lang", "score"]
        )

    return predict(F.col(text) if isinstance(text, str) else text)


def predict(docs: DataFrame, model: dict[str, bytes]) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected`` of each document."""
    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", predict_column("text", model).alias("p")).select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"),
        ((F.col("p.lang") == UNKNOWN) | (F.col("p.score") < NARROW)).alias("rejected"),
    )


def keep_known(docs: DataFrame, model: dict[str, bytes], narrow: float = NARROW) -> DataFrame:
    """The documents that are not rejected, with all their columns."""
    bounded_batches(docs.sparkSession)
    name = free_name(docs, "language")
    found = F.col(name)
    return docs.withColumn(name, predict_column("text", model)).where((found["lang"] != UNKNOWN) & (found["score"] >= narrow)).drop(name)


def learnable(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
