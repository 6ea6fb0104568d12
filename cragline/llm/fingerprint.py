"""Document fingerprints by consistent weighted sampling.

A document is its words, each weighted by how often it occurs. For each of SAMPLES samples a term of weight s has, from
hashes of the term alone, r and c (Gamma(2, 1) each) and b (uniform): t = floor(ln s / r + b), and the sample is the term and
t of least ln a = ln c - r * (t - b + 1). Two documents have the same sample with a probability equal to their
generalised Jaccard similarity, sum of least weights over sum of greatest weights. As ln a differs for any two (term, t), the
least ln a stands for the sample: the signature holds 31 bits of each, and likeness is the share of equal positions.

Everything is SQL. A text's words become sorted hashes, runs of them the terms and weights; terms are exploded and the
least ln a of each sample is an aggregation by document in the same stage, so no term is shuffled.

Scale: texts are shuffled once, by id. The next document of each (by descending id) comes from a sorted walk over
ids alone, dealt into slices by ranges of the id, with the first id of each slice carried over; of a next document only the
part that an edit takes is sent. Nothing grows with a group but the sort of a slice.

Defined results: null text is empty, and two empty documents have likeness 1; null ids come last; rows that repeat an id
and text are one document, and each gets its result; documents of equal id are ordered by their hash; after the last document
comes the first, which may be the document itself; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cragline.llm.text import SPACE, let
from cragline.session import written

SAMPLES = 32
#: Ids in a slice of the sorted walk, about; at most MAX_SLICES slices.
SLICE_IDS = 20_000
MAX_SLICES = 10_000

BLANK = " \t\n\x0b\x0c\r"
_BITS = 2.0**-32


def weighted_terms(text: Column) -> Column:
    """Array of (term, weight): the hash of each distinct word, and how often it occurs."""
    trimmed = F.btrim(text, F.lit(BLANK))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACE}]+", -1))

    def runs(s: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: F.coalesce(s[i] != F.get(s, i + 1), F.lit(True)))
        return let(ends, lambda e: F.transform(e, lambda at, i: F.struct(s[at].alias("term"), (at - F.coalesce(F.get(e, i - 1), F.lit(-1))).cast("double").alias("weight"))))

    hashed = F.sort_array(F.transform(words, lambda w: F.xxhash64(w)))
    return let(hashed, lambda s: F.when(F.size(s) > 0, runs(s)).otherwise(F.array().cast("array<struct<term:bigint,weight:double>>")))


def _uniform(bits: Column) -> Column:
    """A number in (0, 1) from the lower 32 bits."""
    return (bits.bitwiseAND(F.lit(0xFFFFFFFF)).cast("double") + 0.5) * _BITS


def least_log_a(term: Column, log_weight: Column, sample: int) -> Column:
    """Aggregate: the least ln a of a sample over terms."""
    first, second, third = (F.xxhash64(term, F.lit(3 * sample + i)) for i in range(3))
    r = -F.log(_uniform(first) * _uniform(F.shiftrightunsigned(first, 32)))
    log_c = F.log(-F.log(_uniform(second) * _uniform(F.shiftrightunsigned(second, 32))))
    b = _uniform(third)
    t = F.floor(log_weight / r + b)
    return F.min(log_c - r * (t - b + 1))


def signatures(docs: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """keys and ``samples``, SAMPLES numbers of 31 bits (all alike for a text without words). A key has one row."""
    terms = docs.select(*keys, F.explode_outer(weighted_terms(F.col(text_col))).alias("x"))
    terms = terms.select(*keys, F.col("x.term").alias("term"), F.log("x.weight").alias("log_weight"))
    least = [least_log_a(F.col("term"), F.col("log_weight"), i).alias(f"s{i}") for i in range(SAMPLES)]
    found = terms.groupBy(*keys).agg(*least)
    return found.select(*keys, F.array(*[F.xxhash64(f"s{i}").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int") for i in range(SAMPLES)]).alias("samples"))


def printed(samples: Column) -> Column:
    """The fingerprint: eight hex digits a sample."""
    return F.lower(F.array_join(F.transform(samples, lambda s: F.lpad(F.hex(s.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda acc, x: acc + x) / SAMPLES


def next_documents(keys: DataFrame) -> DataFrame:
    """(key, next_key) of distinct rows (key, id): the document after each by descending id, around the end.

    Rows are dealt by ranges of (id, key), whatever the type of the id, so equal ids lie in several slices where they are many.
    """
    slices = max(1, min(MAX_SLICES, keys.count() // SLICE_IDS))
    order = [F.col("id").desc_nulls_last(), F.col("key").asc()]
    placed = written(keys.repartitionByRange(slices, *order).select("key", "id", F.spark_partition_id().alias("slice")), "walk-slices")
    down = Window.partitionBy("slice").orderBy(*order)
    walked = placed.select("key", "slice", F.lead("key").over(down).alias("next"), F.row_number().over(down).alias("place"))
    walked = written(walked, "walk")
    firsts = walked.where("place = 1").select("slice", F.col("key").alias("first"))  # a row a slice
    around = Window.orderBy("slice")
    whole = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.select("slice", F.coalesce(F.lead("first").over(around), F.first("first").over(whole)).alias("after"))
    joined = walked.join(F.broadcast(firsts), "slice")
    return joined.select("key", F.coalesce("next", "after").alias("next_key"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs; see the columns of op7."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    identity = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(":"), text)
    base = docs.select(F.unhex(F.sha2(identity.cast("binary"), 256)).alias("key"), F.col(id_col).alias("id"), text.alias("text"))
    sizes = base.select("key", "id", F.length("text").cast("long").alias("n")).groupBy("key", "id", "n").agg(F.count(F.lit(1)).alias("rows"))
    sizes = written(sizes, "sizes")
    walk = written(next_documents(sizes.select("key", "id")), "walk-next")

    # each document's text goes to its own key, and what the document before takes of it to that one's
    before = walk.join(sizes.select("key", F.floor(F.col("n") / 3).cast("int").alias("cut")), "key")
    before = before.select(F.col("next_key").alias("key"), F.col("key").alias("to"), "cut")
    texts = base.select("key", "text").groupBy("key").agg(F.first("text").alias("text"))
    given = texts.join(before, "key").select(F.col("to").alias("key"), F.substring(F.col("text"), F.lit(1), F.col("cut")).alias("given"))
    n = F.length("text")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - F.floor(n / 3).cast("int")), F.col("given"))
    both = texts.join(given, "key").select("key", "text", edited.alias("edited")).select(
        "key", F.unhex(F.sha2(F.col("edited").cast("binary"), 256)).alias("edited_sha"),
        F.explode(F.array(F.struct(F.lit(False).alias("is_edited"), F.col("text").alias("body")), F.struct(F.lit(True).alias("is_edited"), F.col("edited").alias("body")))).alias("v"),
    )
    signed = signatures(both.select("key", "edited_sha", "v.is_edited", "v.body"), ["key", "edited_sha", "is_edited"], "body")
    own = [F.max(F.when(F.col("is_edited") == e, F.col("samples"))).alias(name) for e, name in ((False, "samples"), (True, "edited_samples"))]
    signed = written(signed.groupBy("key", "edited_sha").agg(*own), "signatures")

    after = walk.join(signed.select(F.col("key").alias("next_key"), F.col("samples").alias("after")), "next_key").select("key", "after")
    paired = sizes.join(signed, "key").join(after, "key")
    paired = paired.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return paired.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_chars"), F.lower(F.hex("edited_sha")).alias("edited_sha256"),
        printed(F.col("samples")).alias("fingerprint"), printed(F.col("edited_samples")).alias("edited_fingerprint"),
        likeness(F.col("samples"), F.col("edited_samples")).alias("near_edited"), likeness(F.col("samples"), F.col("after")).alias("near_next"),
    )


def op7(docs: DataFrame) -> DataFrame:
    return fingerprints(docs)
