"""Language identification by compression.

Each language has a zstandard raw-content dictionary made of sample texts. The whole of a lower-cased text is compressed
block by block with each dictionary; the language whose dictionary gives the smallest total is the prediction. It is
rejected where the runner-up needs hardly more bytes.

Training takes a bounded sample: SAMPLE_DOCS labelled documents a language (those with the smallest hash of the id), of each
up to 2 * DICT_BYTES / SAMPLE_DOCS bytes (more where a language has fewer documents), and DICT_BYTES in all. The sample is found by
a ranked window over ids, which Spark limits within each map task before shuffling. Dictionaries are broadcast in groups of
GROUP languages, 16 MB each at most, and the two smallest sizes of the groups are merged, so every language counts however
many there are. Everything else covers every row, in tasks that see one batch of texts at a time and no shuffle.

Defined results: null text, or a text without a letter, is ``und`` with score 0 and rejected; so is every text where no
language was learnt. Ties go to the first language by code point. Rows with a null language are not learnt from; a null
id is neither held out nor learnt from; of rows that repeat language and id one is, the one with the least text. An empty table gives an empty result; extra columns are kept by ``identify`` and
ignored by op6.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cragline.llm.text import let

SAMPLE_DOCS = 160
SAMPLE_CHARS = 4096
DICT_BYTES = 128 * 1024
GROUP = 128
BLOCK_CHARS = 4096
#: Rejected: the runner-up is not larger by this share of the smallest size.
NARROW = 0.005
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")


def held_out(id_col: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Dictionaries by language, from a bounded sample of the rows of docs that have a language and an id."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    keyed = labelled.select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.xxhash64(F.col(id_col)).alias("key"))
    first = Window.partitionBy("lang").orderBy("key", "id")
    picked = keyed.withColumn("place", F.row_number().over(first)).where(F.col("place") <= SAMPLE_DOCS)
    sample = labelled.select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.substring(text_col, 1, SAMPLE_CHARS).alias("text"))
    sample = sample.join(F.broadcast(picked.select("lang", "id")), ["lang", "id"], "left_semi")  # SAMPLE_DOCS a language
    sample = sample.groupBy("lang", "id").agg(F.min("text").alias("text"))
    texts: dict[str, list[tuple[int, str]]] = {}
    for row in sample.select("lang", F.xxhash64("id").alias("key"), "text").toLocalIterator():
        texts.setdefault(row["lang"], []).append((row["key"], row["text"]))
    return {lang: _dictionary([t for _, t in sorted(texts[lang])]) for lang in sorted(texts)}


def _dictionary(texts: list[str]) -> bytes:
    """Distinct parts of the texts in turn, so that a long one doesn't fill the dictionary alone."""
    share = max(512, 2 * DICT_BYTES // max(1, len(texts)))
    parts = [t.lower().encode()[:share].decode("utf-8", "ignore") for t in texts]
    return " ".join(dict.fromkeys(p for p in parts if p)).encode()[:DICT_BYTES]


def _sizes(spark: SparkSession, dictionaries: dict[str, bytes], text: Column) -> Column:
    """Array of the two smallest (size, language) of a text, compressed with each dictionary; empty for a text without letters."""
    shared = spark.sparkContext.broadcast(dictionaries)

    @F.pandas_udf("array<struct<size:long,lang:string>>")
    def compress(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import zstandard

        how = zstandard.ZstdCompressionParameters(
            strategy=zstandard.STRATEGY_LAZY, min_match=4, window_log=18, hash_log=17, chain_log=17, search_log=4, target_length=32,
            write_content_size=False, write_checksum=False, write_dict_id=False,
        )
        coders = []
        for name, content in shared.value.items():
            made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            made.precompute_compress(compression_params=how)
            coders.append((name, zstandard.ZstdCompressor(dict_data=made, compression_params=how)))
        for batch in batches:
            rows = []
            for text in batch:
                text = text.lower() if text is not None else ""
                if not _LETTER.search(text):
                    rows.append([])
                    continue
                blocks = [text[i : i + BLOCK_CHARS].encode() for i in range(0, len(text), BLOCK_CHARS)]
                sizes = sorted((sum(len(c.compress(b)) for b in blocks), n) for n, c in coders)
                rows.append([{"size": size, "lang": lang} for size, lang in sizes[:2]])
            yield pd.Series(rows)

    return compress(text)


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", out: str = "lang_pred") -> DataFrame:
    """docs with a struct column (pred, score, rejected) named out.

    score: 1 - smallest size / second smallest, scaled by SCORE_SPAN into 0..1.
    """
    names = sorted(dictionaries)
    groups = [{n: dictionaries[n] for n in names[i : i + GROUP]} for i in range(0, len(names), GROUP)]
    sizes = [_sizes(docs.sparkSession, group, F.col(text_col)) for group in groups] or [F.array().cast("array<struct<size:long,lang:string>>")]

    def verdict(best: Column) -> Column:
        margin = F.when(F.size(best) > 1, 1 - best[0]["size"] / best[1]["size"]).otherwise(1.0)
        known = F.struct(
            best[0]["lang"].alias("pred"), F.least(F.lit(1.0), margin * SCORE_SPAN).alias("score"),
            ((F.size(best) > 1) & (margin < NARROW)).alias("rejected"),
        )
        return F.when(F.size(best) > 0, known).otherwise(F.struct(F.lit(UNKNOWN).alias("pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected")))

    return docs.withColumn(out, let(F.slice(F.array_sort(F.concat(*sizes)), 1, 2), verdict))


#: A margin of 1 / SCORE_SPAN or more has score 1.
SCORE_SPAN = 4.0


def op6(docs: DataFrame) -> DataFrame:
    base = docs.select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    dictionaries = learn(base.where(~F.col("held_out")))
    found = identify(base.drop("lang"), dictionaries, out="found")
    return found.select(
        "doc_id", "held_out", F.col("found.pred").alias("lang_pred"), F.col("found.score").alias("score"), F.col("found.rejected").alias("rejected")
    )
