"""Pipeline stages: each takes documents and returns documents (all columns of its input), but for the last, which encodes.

Columns that a stage adds on its way have names that its input doesn't use, so no column of the input is lost or mistaken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cragline.llm import bpe, language, mixing, neardup, secrets
from cragline.llm.text import text_or_empty, word_count
from cragline.session import scratch_path


#: Characters that the last stage encodes at once: its tasks share executors whose heaps the stages before have filled.
SLICE_CHARS = 750_000


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to be new to docs, whatever the case."""
    taken = {c.lower() for c in docs.columns}
    depth = 1
    while any("_" * depth + n in taken for n in names):
        depth += 1
    return ["_" * depth + n for n in names]


def keep_known_language(docs: DataFrame) -> DataFrame:
    """Documents whose language identification doesn't reject; dictionaries are learnt from the documents' own languages.

    Null text, text without letters and narrow margins go; a null id or language stays if its text is known; repeated rows are
    judged alike and all stay; an empty table stays empty.
    """
    (found,) = fresh(docs, "language")
    return language.identify(docs, language.learn(docs), out=found).where(~F.col(f"{found}.rejected")).select(*docs.columns)


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each group of near duplicates: of those with the smallest id the one whose text has the least hash.

    Null ids come after all others, and are grouped like others; a repeated row stays once; documents without words are in no group
    and all stay; an empty table stays empty.
    """
    own, place, digest, blank = fresh(docs, "own", "place", "digest", "blank")
    hashed = neardup.text_digest(F.col("text"))
    found = neardup.groups(docs).where("component IS NOT NULL")
    best = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "own")).alias("first"))
    best = best.select(F.col("first.doc_id").alias(place), F.col("first.own").alias(digest))
    marked = docs.withColumns({own: hashed, blank: word_count(F.col("text")) == 0})
    kept = marked.where(~F.col(blank)).join(best, F.col("doc_id").eqNullSafe(F.col(place)) & (F.col(own) == F.col(digest)), "left_semi")
    return kept.dropDuplicates(["doc_id", own]).select(*docs.columns).unionByName(marked.where(blank).select(*docs.columns))


def redact_secrets(docs: DataFrame) -> DataFrame:
    """Documents with secrets replaced by a mark, and n_chars (if there is such a column) after that; all documents stay.

    Null text stays null; repeated rows are redacted alike; an empty table stays empty.
    """
    blob, spans = fresh(docs, "blob", "spans")
    ledger = scratch_path(docs.sparkSession, "ledger")
    secrets.scan_versions(docs.select(F.col("doc_id").alias("path"), "text"), ledger)
    known = secrets.findings(docs.sparkSession, ledger).select(F.col("blob").alias(blob), F.col("found").alias(spans))
    joined = docs.withColumn(blob, secrets.blob_id(text_or_empty(F.col("text")))).join(known, blob, "left")
    hit = F.col(spans).isNotNull()
    out = joined.withColumn("text", F.when(hit, secrets.redact(F.col("text"), F.col(spans))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(hit, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def mix(docs: DataFrame) -> DataFrame:
    """Each document as often as the mix takes it.

    Null text has no words and is left out; a null id or source is a value like others; rows alike in id, source and size share
    what the mix takes of them, as evenly as it goes; an empty table stays empty.
    """
    key, origin, size, rows, copies, count, before, copy = fresh(docs, "key", "origin", "size", "rows", "copies", "count", "before", "copy")
    taken = mixing.entries(docs).where("n > 0").select(
        _text(F.col("id")).alias(key), _text(F.col("source")).alias(origin), F.col("size").alias(size), F.col("n").alias(rows),
        (F.col("whole") * F.col("n") + F.col("extra")).alias(copies),
    ).where(F.col(copies) > 0)
    keyed = docs.select("*", _text(F.col("doc_id")).alias(key), _text(F.col("source")).alias(origin), word_count(F.col("text")).alias(size))
    joined = keyed.join(taken, [key, origin, size])
    single = joined.where(F.col(rows) == 1).select(*docs.columns, F.col(copies).alias(copy))
    alike = joined.where(F.col(rows) > 1).groupBy(*docs.columns, key, origin, size, rows, copies).agg(F.count(F.lit(1)).alias(count))
    order = Window.partitionBy(key, origin, size).orderBy(F.xxhash64(*docs.columns)).rowsBetween(Window.unboundedPreceding, -1)
    alike = alike.withColumn(before, F.coalesce(F.sum(count).over(order), F.lit(0)))
    more = F.greatest(F.lit(0), F.least(F.col(count), F.col(copies) % F.col(rows) - F.col(before)))
    alike = alike.select(*docs.columns, (F.col(count) * F.floor(F.col(copies) / F.col(rows)) + more).alias(copy))
    every = single.unionByName(alike).where(F.col(copy) > 0)
    return every.select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copy).cast("long"))).alias(copy)).select(*docs.columns)


def _text(value: Column) -> Column:
    """A value as a join key; null is one."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def encode(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids); the digests are those of the returned ids and of what they decode to.

    Null text has no ids; repeated rows give repeated rows; an empty table stays empty.
    """
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode(docs, ranks, public_tokenizers.PATTERN, keep=True, slice_chars=SLICE_CHARS)
    written_ids = F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")
    return encoded.select(F.col("id").alias("doc_id"), "n_tokens", F.sha2(written_ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "ids")
