"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text, held to quantiles by language.

Tokens are characters, all of them, and two boundaries before a text. (Words would not do here: most of a web corpus' distinct
words are met once.) Documents labelled 1 are trusted. One in HELD_OUT of them, by a hash of the id, is kept from the model and sets
its language's threshold; trigrams of the others are counted by language. (In a language where either part is empty, the other
does both.) Discounts come from counts of counts;
lower orders use continuation counts; the lowest order leaves its rest evenly to the language's alphabet, of its trusted
characters or CLASSES if these are fewer. A document's perplexity is that of its whole text under its language's model. Its level
is the logarithm of that in 1/LEVELS; it is kept up to the level that QUANTILE of the held-out trusted documents don't exceed. With
n documents, fewer than 1 / (1 - QUANTILE), that level lies beyond all of theirs: the distance from their median to the greatest is
then stretched as an exponential tail would be, by ln(0.5 / (1 - QUANTILE)) / ln(n / 2). Below 3 documents the trained ones serve, not stretched if
they are below 3 too.

Scale: texts are dealt once into buckets of about BUCKET_BYTES by id, with the labels. Each bucket gives its distinct trigrams with
their trusted counts; the model is joins and sums over these sharded tables, and grows with the input; the cost of a trigram
goes back to the buckets that have it, where documents are scored. No process holds a model; a task holds one bucket with
the trigrams that occur in it. Windows run by context, so they have at most a row for each character. The texts' and the trigrams' exchanges are
each written once and read by several branches of one plan, so columns are not pruned below them: hence ``v``, which
packs bucket and count.

Defined results: null or empty text has no characters, no perplexity, and is not kept; documents whose language (null is one)
has no trusted text have no perplexity and are kept; a document with several labels is trusted if all are 1; repeated rows count each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from cragline.session import written

#: The least size of an alphabet.
CLASSES = 96
QUANTILE = 0.995
HELD_OUT, LEVELS = 5, 1000
TAIL = math.log(0.5 / (1 - QUANTILE))
BUCKET_BYTES = 8 << 20
#: The boundary, and the bits of a character in a packed trigram.
EDGE, BITS = 0x110000, 21
#: For alphabets cut to CLASSES, as the plain version in the tests numbers its characters: other characters and the boundary.
OTHER, BOUNDARY = CLASSES - 2, CLASSES - 1


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def classes_of(text: str, alphabet: np.ndarray) -> np.ndarray:
    """Class of each character, two boundaries first. alphabet: class by code point, up to the highest known one."""
    points = code_points(text)
    known = np.where(points < len(alphabet), points, 0)
    return np.concatenate([[BOUNDARY, BOUNDARY], np.where(points < len(alphabet), alphabet[known], OTHER)]).astype(np.int64)


def trigrams(classes: np.ndarray) -> np.ndarray:
    return (classes[:-2] * CLASSES + classes[1:-1]) * CLASSES + classes[2:]


def packed(text: str) -> np.ndarray:
    """The trigrams of a text, BITS for each code point."""
    points = np.concatenate([[EDGE, EDGE], code_points(text)]).astype(np.int64)
    return points[:-2] << 2 * BITS | points[1:-1] << BITS | points[2:]


def parts(docs: DataFrame, good: DataFrame) -> DataFrame:
    """(doc_id, label) of the trusted ids (labelled) that docs have: 2 if held out, else 1. Only ids and languages are joined."""
    kind = docs.schema["doc_id"].dataType
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % HELD_OUT == 0
    known = docs.select("doc_id", "lang").join(good.select(F.col("labelled").try_cast(kind).alias("doc_id")), "doc_id").withColumn("held", held)
    trained = known.where("NOT held").groupBy(F.col("lang").alias("_lang")).agg(F.lit(True).alias("trained"))  # a row a language
    joined = known.join(F.broadcast(trained), F.col("lang").eqNullSafe(F.col("_lang")), "left")
    return joined.groupBy("doc_id").agg(F.min(F.when(F.col("held") & F.col("trained"), 2).otherwise(1)).alias("label"))


def deal(docs: DataFrame, good: DataFrame) -> DataFrame:
    """(bucket, doc_id, lang, text, label): documents (label 0), and the rows of parts() in the buckets of their documents."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    buckets = -(-total // BUCKET_BYTES) + 1
    place = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.col("text"))), F.lit(buckets)).cast("int")
    none = F.lit(None).cast("string")
    ids = parts(docs, good).select("doc_id", none.alias("lang"), none.alias("text"), "label")
    rows = docs.select("doc_id", "lang", "text", F.lit(0).alias("label")).unionByName(ids)
    dealt = rows.select(place.alias("bucket"), "doc_id", "lang", "text", "label")
    return dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "bucket")


def texts_of(table: pa.Table) -> Iterator[tuple[object, str | None, str, int]]:
    """(doc_id, lang, text, label) of a bucket's documents, label 0 where not trusted; null text is empty."""
    ids, langs, texts, label = (table.column(c).to_pylist() for c in ("doc_id", "lang", "text", "label"))
    good = {i: own for i, own in zip(ids, label, strict=True) if own and i is not None}
    for i, lang, text, own in zip(ids, langs, texts, label, strict=True):
        if not own:
            yield i, lang, text or "", good.get(i, 0)


def key_of(lang: str | None) -> str:
    """A language as a join key; null is one."""
    return "" if lang is None else "=" + lang


def count_trigrams(dealt: DataFrame) -> DataFrame:
    """(lang key, tri, v) of each bucket: its distinct trigrams; v has the bucket above 32 bits of their count in trusted texts."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        seen: dict[str, list[np.ndarray]] = {}
        trusted: dict[str, list[np.ndarray]] = {}
        for _, lang, text, label in texts_of(table):
            if text:
                found = packed(text)
                seen.setdefault(key_of(lang), []).append(found)
                if label == 1:
                    trusted.setdefault(key_of(lang), []).append(found)
        keys, cells, values = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for key, found in seen.items():
            distinct = np.unique(np.concatenate(found))
            n = np.zeros(len(distinct), np.int64)
            if key in trusted:
                which, times = np.unique(np.concatenate(trusted[key]), return_counts=True)
                n[np.searchsorted(distinct, which)] = times
            keys += [key] * len(distinct)
            cells.append(distinct)
            values.append((bucket << 32) + n)
        return pa.table({"key": pa.array(keys, pa.string()), "tri": np.concatenate(cells), "v": np.concatenate(values)})

    found = dealt.groupBy("bucket").applyInArrow(run, "key string, tri long, v long")
    return found.repartition(int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key", "tri")


def discounted(counts: DataFrame, context: Column | None) -> DataFrame:
    """counts with alpha, the discounted share of a count in its context, and gamma, what the discounts leave to the lower order;
    total is 0 in a context without counts.

    The three discounts of a language come from how many counts are 1, 2, 3 and 4; where one of these is missing, they are 0.5, 1 and 1.5.
    """
    n = [F.count_if(F.col("c") == i).cast("double") for i in (1, 2, 3, 4)]
    seen = counts.groupBy(F.col("key").alias("_key")).agg(*[v.alias(f"n{i}") for i, v in enumerate(n, 1)])
    share = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    known = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0) & (F.col("n4") > 0)

    def discount(i: int, default: float) -> Column:
        value = i - (i + 1) * share * F.col(f"n{i + 1}") / F.col(f"n{i}")
        return F.when(known, F.greatest(F.lit(0.0), F.least(F.lit(float(i)), value))).otherwise(default).alias(f"d{i}")

    rates = F.broadcast(seen.select("_key", *[discount(i, 0.5 * i) for i in (1, 2, 3)]))  # a row a language
    joined = counts.join(rates, F.col("key") == F.col("_key")).drop("_key")
    taken = F.when(F.col("c") == 0, 0.0).when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
    whole = Window.partitionBy("key", *([] if context is None else [context]))
    sums = joined.withColumn("_d", taken).withColumns({"total": F.sum("c").over(whole), "_left": F.sum("_d").over(whole)})
    share_of = lambda value: F.when(F.col("total") > 0, value / F.col("total"))
    alpha, gamma = share_of(F.col("c") - F.col("_d")), share_of(F.col("_left"))
    return sums.withColumns({"alpha": alpha, "gamma": gamma}).drop("_d", "_left", "d1", "d2", "d3")


def costs(found: DataFrame) -> DataFrame:
    """(key, tri, cost): -ln P(z | x, y) of every trigram that occurs; languages without trusted text have no rows."""
    low = lambda column, n: F.col(column).bitwiseAND(F.lit((1 << n * BITS) - 1))
    above = lambda column: F.shiftright(column, BITS)
    three = found.groupBy("key", "tri").agg(F.sum(F.col("v").bitwiseAND(F.lit((1 << 32) - 1))).alias("c"))
    two = three.groupBy("key", low("tri", 2).alias("pair")).agg(F.count_if(F.col("c") > 0).alias("c"))
    one = two.groupBy("key", low("pair", 1).alias("z")).agg(F.count_if(F.col("c") > 0).alias("c"))
    size = F.greatest(F.lit(CLASSES), F.count_if(F.col("c") > 0).over(Window.partitionBy("key")) + 2)
    p1 = discounted(one, None).where("total > 0").select("key", "z", (F.col("alpha") + F.col("gamma") / size).alias("p1"))
    mixed = lambda lower: F.coalesce(F.col("alpha") + F.col("gamma") * F.col(lower), F.col(lower))
    p2 = discounted(two, above("pair")).withColumn("z", low("pair", 1)).join(p1, ["key", "z"]).select("key", "pair", mixed("p1").alias("p2"))
    p3 = discounted(three, above("tri")).withColumn("pair", low("tri", 2)).join(p2, ["key", "pair"])
    return p3.select("key", "tri", (-F.ln(mixed("p2"))).alias("cost"))


def score(dealt: DataFrame) -> DataFrame:
    """(doc_id, lang, n_chars, perplexity, label) of a dealt table's documents."""
    found = count_trigrams(dealt)
    asked = found.select("key", "tri", F.shiftright("v", 32).cast("int").alias("bucket"))
    answers = asked.join(costs(found), ["key", "tri"]).select("bucket", "key", "tri", "cost")
    schema = f"doc_id {dealt.schema['doc_id'].dataType.simpleString()}, lang string, n_chars long, perplexity double, label int"
    kind = dealt.schema["doc_id"].dataType

    def run(table: pa.Table, known: pa.Table) -> pa.Table:
        known = known.sort_by([("key", "ascending"), ("tri", "ascending")])
        tri, cost = known.column("tri").to_numpy(), known.column("cost").to_numpy()
        names = known.column("key").to_numpy()
        ends = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1), len(names)]
        models = {names[i]: (tri[i:j], cost[i:j]) for i, j in zip(ends, ends[1:], strict=False) if i < j}
        ids, langs, sizes, values, labels = [], [], [], [], []
        for i, lang, text, label in texts_of(table):
            value = None
            if text and key_of(lang) in models:
                cells, prices = models[key_of(lang)]
                value = float(np.exp(prices[np.searchsorted(cells, packed(text))].mean(dtype=np.float64)))
            for column, x in zip((ids, langs, sizes, values, labels), (i, lang, len(text), value, label), strict=True):
                column.append(x)
        types = [to_arrow_type(kind), pa.string(), pa.int64(), pa.float64(), pa.int32()]
        columns = [pa.array(c, t) for c, t in zip((ids, langs, sizes, values, labels), types, strict=True)]
        return pa.Table.from_arrays(columns, ["doc_id", "lang", "n_chars", "perplexity", "label"])

    return dealt.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, lang, n_chars, perplexity, threshold, kept) of every row of docs."""
    good = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("labelled"))
    good = good.agg(F.min("quality").alias("quality")).where("quality = 1").select("labelled")
    base = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    scored = written(score(deal(base, good)), "scored")
    scored = scored.withColumn("level", F.floor(F.ln("perplexity") * LEVELS))
    counts = scored.where("level IS NOT NULL AND label > 0").groupBy(F.col("lang").alias("_lang"), "label", "level").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("_lang", "label")  # a row for each level, of which there are ln(0x110000) * LEVELS or somewhat more
    upto = F.sum("n").over(whole.orderBy("level").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = counts.withColumns({"upto": upto, "total": F.sum("n").over(whole)})
    reached = lambda share: F.min(F.when(F.col("upto") >= share * F.col("total"), F.col("level")))
    limits = placed.groupBy("_lang", "label").agg(reached(0.5).alias("middle"), reached(QUANTILE).alias("top"), F.max("total").alias("total"))
    stretch = F.when(F.col("total") > 2, F.greatest(F.lit(1.0), TAIL / F.ln(F.col("total") / 2))).otherwise(1.0)
    limit = F.col("middle") + (F.col("top") - F.col("middle")) * stretch
    choice = F.when((F.col("label") == 2) & (F.col("total") <= 2), 0).otherwise(F.col("label"))
    limits = limits.groupBy("_lang").agg(F.max_by(limit, choice).alias("limit"))
    joined = scored.drop("label").join(F.broadcast(limits), F.col("lang").eqNullSafe(F.col("_lang")), "left").drop("_lang")  # a row a language
    kept = (F.col("n_chars") > 0) & F.coalesce(F.col("level") <= F.col("limit"), F.lit(True))
    return joined.withColumns({"threshold": F.exp(F.col("limit") / LEVELS), "kept": kept}).drop("level", "limit")


def op2(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return classify(docs, labels).withColumns({c: F.round(c, 3) for c in ("perplexity", "threshold")})


def _oracle() -> str:
    """DuckDB SQL: the same model from the trigrams of each document."""

    def level(name: str, counts: str, context: str) -> str:
        rest = ", ".join(f"CASE WHEN n1 > 0 AND n2 > 0 AND n3 > 0 AND n4 > 0 THEN greatest(0, least({i}, {i} - {i + 1} * (n1 / (n1 + 2 * n2)) * n{i + 1} / n{i})) ELSE {0.5 * i}::DOUBLE END AS d{i}" for i in (1, 2, 3))
        ones = ", ".join(f"count(*) FILTER (WHERE c = {i})::DOUBLE AS n{i}" for i in (1, 2, 3, 4))
        return f"""{name}_d AS (SELECT lang, {rest} FROM (SELECT lang, {ones} FROM {counts} GROUP BY lang)),
{name} AS (SELECT *, (c - d) / nullif(total, 0) AS alpha, sum(d) OVER w / nullif(total, 0) AS gamma FROM (
  SELECT t.*, sum(c) OVER w AS total, CASE WHEN c = 0 THEN 0 WHEN c = 1 THEN d1 WHEN c = 2 THEN d2 ELSE d3 END AS d
  FROM {counts} t JOIN {name}_d r ON r.lang = t.lang WINDOW w AS (PARTITION BY t.lang{context})) WINDOW w AS (PARTITION BY lang{context}))"""

    return f"""
WITH good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
texts AS (SELECT d.doc_id, d.lang AS named, coalesce('=' || d.lang, '') AS lang, coalesce(text, '') AS text,
  CASE WHEN g.doc_id IS NULL THEN 0 WHEN crc % {HELD_OUT} = 0 AND max(g.doc_id IS NOT NULL AND crc % {HELD_OUT} <> 0) OVER (PARTITION BY lang) THEN 2 ELSE 1 END AS label
  FROM (SELECT *, CRC AS crc FROM documents) d LEFT JOIN good g ON g.doc_id = d.doc_id),
chars AS (SELECT doc_id, lang, label, list_concat(['', ''], regexp_extract_all(text, '(?s).')) AS l FROM texts WHERE text <> ''),
grams AS (SELECT doc_id, lang, label, unnest(list_transform(range(1, len(l) - 1), lambda i: struct_pack(x := l[i], y := l[i + 1], z := l[i + 2]))) AS g FROM chars),
own AS MATERIALIZED (SELECT doc_id, lang, label, g.x AS x, g.y AS y, g.z AS z, count(*) AS n FROM grams GROUP BY ALL),
three AS MATERIALIZED (SELECT lang, x, y, z, coalesce(sum(n) FILTER (WHERE label = 1), 0)::BIGINT AS c FROM own GROUP BY ALL),
two AS MATERIALIZED (SELECT lang, y, z, count(*) FILTER (WHERE c > 0) AS c FROM three GROUP BY ALL),
one AS MATERIALIZED (SELECT lang, z, count(*) FILTER (WHERE c > 0) AS c FROM two GROUP BY ALL),
sizes AS (SELECT lang, greatest({CLASSES}, count(*) FILTER (WHERE c > 0) + 2) AS size FROM one GROUP BY lang),
{level('l1', 'one', '')}, {level('l2', 'two', ', y')}, {level('l3', 'three', ', x, y')},
p1 AS (SELECT l1.lang, z, alpha + gamma / size AS p1 FROM l1 JOIN sizes s ON s.lang = l1.lang WHERE total > 0),
p2 AS (SELECT l2.lang, y, l2.z, coalesce(alpha + gamma * p1, p1) AS p2 FROM l2 JOIN p1 ON p1.lang = l2.lang AND p1.z = l2.z),
p3 AS (SELECT l3.lang, x, l3.y, l3.z, -ln(coalesce(alpha + gamma * p2, p2)) AS cost FROM l3 JOIN p2 ON p2.lang = l3.lang AND p2.y = l3.y AND p2.z = l3.z),
means AS (SELECT doc_id, sum(n * cost) / sum(n) AS mean FROM own o JOIN p3 ON p3.lang = o.lang AND p3.x = o.x AND p3.y = o.y AND p3.z = o.z GROUP BY doc_id),
scored AS (SELECT t.doc_id, t.named AS lang, length(text)::BIGINT AS n_chars, exp(mean) AS perplexity, floor(ln(exp(mean)) * {LEVELS})::BIGINT AS level, label FROM texts t LEFT JOIN means m ON m.doc_id = t.doc_id),
counts AS (SELECT lang, label, level, count(*) AS n FROM scored WHERE level IS NOT NULL AND label > 0 GROUP BY ALL),
placed AS (SELECT *, sum(n) OVER (PARTITION BY lang, label ORDER BY level) AS upto, sum(n) OVER (PARTITION BY lang, label) AS total FROM counts),
ends AS (SELECT lang, label, min(level) FILTER (WHERE upto >= 0.5 * total) AS middle, min(level) FILTER (WHERE upto >= {QUANTILE}::DOUBLE * total) AS top, max(total) AS total FROM placed GROUP BY ALL),
limits AS (SELECT lang, arg_max(middle + (top - middle) * CASE WHEN total > 2 THEN greatest(1, {TAIL}::DOUBLE / ln(total / 2.0::DOUBLE)) ELSE 1 END, CASE WHEN label = 2 AND total <= 2 THEN 0 ELSE label END) AS lim FROM ends GROUP BY lang)
SELECT doc_id, s.lang, n_chars, round(perplexity, 3) AS perplexity, round(exp(lim / {LEVELS}::DOUBLE), 3) AS threshold, n_chars > 0 AND coalesce(level <= lim, true) AS kept
FROM scored s LEFT JOIN limits l ON l.lang IS NOT DISTINCT FROM s.lang
""".replace("CRC", CRC)


#: In DuckDB: CRC-32 of the id as text, a bit at a time.
CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [1, 1, 1, 1, 1, 1, 1, 1]::BIGINT[]), lambda v, _: xor(v >> 1, CASE WHEN v % 2 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"""

ORACLE = _oracle()
