"""Mixing sources to target weights by Pareto order sampling.

Each source's target is its weighted share of the mix, held at ``max_copies`` times the source's size; what is cut off
goes to the other sources by weight until none is above (a water level). A document's expected copies are in proportion to its
inclusion weight, the square root of its size unless given: short documents, which hold little context, come in less often.
They are held at ``max_copies`` and scaled to the target, again by a water level, over a source's distinct weights. The whole
part of the expected copies is taken for certain; for the fraction L, documents are ranked by (U / (1 - U)) / (L / (1 - L)), U
being a hash of the id, and the first documents whose words fit the remaining target are taken. At most CLOSING documents that
best fill what is left are added, one after another.

Scale: texts are read once, down to (id, source, size, U, weight) with a count of equal rows, which is written to the shared
folder. Ranks are cut by sums over RANK_BUCKETS slices of the rank score, so only the slice that holds the cut is ever sorted, and a
source with a third of all rows is never gathered in a task; nor are equal rows, however many. Tables with a row for each source
are small: one row a source.

Defined results: null text has size 0 and is taken 0 times its words; null sources form one source, the last; a null
id hashes like the string 'null'; rows alike in id, source, size and weight share one rank and are taken one by one; a weight
that is null or not above 0 counts as 0, and such a document is left out; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cragline.llm.text import word_count
from cragline.session import written

RANK_BUCKETS = 4096
#: Up to so many sources, the table of sources is broadcast (about 100 bytes each).
BROADCAST_SOURCES = 100_000
#: Documents that fill what the ranks leave of a source's target.
CLOSING = 6


def uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1) from the md5 of a key, the same in every run."""
    digits = F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(seed)).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(16**13)


def source_targets(sized: DataFrame, weights: tuple[int, ...], share: float, max_copies: int) -> DataFrame:
    """(source, source_size, target) from rows (source, size)."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int")))
    per = per.withColumn("most", F.col("source_size") * float(max_copies))
    by_room = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    upto = by_room.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total_w = F.sum("w").over(whole)
    level = (share * F.sum("source_size").over(whole) - (F.sum("most").over(upto) - F.col("most"))) / (
        total_w - (F.sum("w").over(upto) - F.col("w"))
    )
    per = per.withColumn("level", level)
    first = F.min(F.when(F.col("level") <= F.col("most") / F.col("w"), F.struct(F.col("most") / F.col("w"), "level"))).over(whole)
    target = F.least(F.col("w") * first["level"], F.col("most"))
    return per.select("source", "source_size", F.coalesce(target, F.col("most")).alias("target"))


def expected_copies(sized: DataFrame, targets: DataFrame, max_copies: int, small: bool) -> DataFrame:
    """(source, scale, source_size, target): a document's expected copies are the least of max_copies and scale times its weight."""
    per = sized.where("size > 0 AND g > 0").groupBy("source", "g").agg(F.sum(F.col("size") * F.col("n")).cast("double").alias("words"))
    down = Window.partitionBy("source").orderBy(F.desc("g"))  # a row for each distinct weight of a source
    whole = Window.partitionBy("source").orderBy("g").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weighed = F.sum(F.col("g") * F.col("words")).over(Window.partitionBy("source").orderBy("g").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    at = _join(per.select("source", "g", before.alias("before"), weighed.alias("weighed")), targets, "source", small)
    scale = (F.col("target") - max_copies * F.col("before")) / F.col("weighed")  # if the weights above are held at max_copies
    at = at.withColumn("scale", scale).where(F.col("scale") * F.col("g") <= max_copies)
    found = at.groupBy("source").agg(F.max_by("scale", "g").alias("scale"))
    return _join(targets, found, "source", small)


def entries(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    max_copies: int = 2,
    seed: str = "mix-1",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    inclusion_col: str | None = None,
) -> DataFrame:
    """(id, source, size, n, source_size, target, whole, extra) for each n rows of docs alike in id, source, size and weight: each is
    taken whole times, and extra of them once more.

    share: of all sizes, what the mix holds. inclusion_col: relative inclusion weights.
    """
    size = word_count(F.col(text_col))
    weight = F.greatest(F.coalesce(F.col(inclusion_col).cast("double"), F.lit(0.0)), F.lit(0.0)) if inclusion_col else F.sqrt(size)
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), weight.alias("g"))
    sized = sized.groupBy("id", "source", "size", "g").agg(F.count(F.lit(1)).alias("n")).withColumn("u", uniform(F.col("id"), seed))
    sized = written(sized.withColumn("entry", F.monotonically_increasing_id()), "mix-sized")
    targets = source_targets(sized.select("source", (F.col("size") * F.col("n")).alias("size")), weights, share, max_copies)
    small = targets.count() <= BROADCAST_SOURCES
    targets = written(expected_copies(sized, written(targets, "mix-targets"), max_copies, small), "mix-sources")

    # no scale: every weight is held at max_copies
    expected = F.when(F.col("g") > 0, F.least(F.lit(float(max_copies)), F.coalesce(F.col("scale") * F.col("g"), F.lit(float(max_copies))))).otherwise(0.0)
    docs_at = _join(sized, targets, "source", small).withColumn("expected", expected)
    docs_at = docs_at.withColumn("whole", F.floor("expected")).withColumn("part", F.col("expected") - F.col("whole"))
    # Q / (1 + Q) orders as Q, the random odds over the inclusion odds, does, and lies in 0..1
    score = F.col("u") * (1 - F.col("part")) / (F.col("u") * (1 - F.col("part")) + (1 - F.col("u")) * F.col("part"))
    docs_at = docs_at.withColumn("score", score).withColumn(
        "slice", F.when(F.col("part") > 0, F.least(F.floor(F.col("score") * RANK_BUCKETS), F.lit(RANK_BUCKETS - 1)))
    )

    words = F.col("size") * F.col("n")
    rest = docs_at.groupBy("source").agg((F.max("target") - F.sum(F.col("whole") * words)).alias("rest"))
    sums = docs_at.where("slice IS NOT NULL").groupBy("source", "slice").agg(F.sum(words).alias("words"))
    upto = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = _join(sums.withColumn("upto", F.sum("words").over(upto)), rest, "source", small)
    cut = sums.groupBy("source").agg(
        F.min(F.when(F.col("upto") > F.col("rest"), F.col("slice"))).alias("cut"),
        F.coalesce(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("upto"))), F.lit(0)).alias("before"),
        F.max("rest").alias("rest"),
    )
    cut = written(cut, "mix-cuts")

    ranked = _join(docs_at, cut, "source", small)
    below = F.col("cut").isNull() | (F.col("slice") < F.col("cut"))
    order = Window.partitionBy("source").orderBy("score", "id", "size", "entry").rowsBetween(Window.unboundedPreceding, -1)
    edge = ranked.where(F.col("slice") == F.col("cut")).withColumn("running", F.col("before") + F.coalesce(F.sum(words).over(order), F.lit(0)))
    fit = F.least(F.col("n"), F.greatest(F.lit(0), F.floor((F.col("rest") - F.col("running")) / F.col("size"))))
    edge = edge.withColumn("extra", fit.cast("long"))
    other = ranked.where(~F.coalesce(F.col("slice") == F.col("cut"), F.lit(False)))
    other = other.withColumn("running", F.lit(None).cast("long")).withColumn("extra", F.when(F.col("slice").isNotNull() & below, F.col("n")).otherwise(0))
    columns = ("entry", "id", "source", "size", "n", "source_size", "target", "whole", "slice", "score", "extra", "rest")
    drawn = written(other.unionByName(edge).select(*columns), "mix-drawn")

    used = drawn.where("slice IS NOT NULL").groupBy("source").agg((F.max("rest") - F.sum(F.col("extra") * F.col("size"))).alias("gap"))
    gap = written(used, "mix-gap")
    closing = None
    for _ in range(CLOSING):
        left = _join(drawn.where("slice IS NOT NULL AND extra < n"), gap, "source", small).where(F.abs(F.col("gap") - F.col("size")) < F.col("gap"))
        left = left if closing is None else left.join(F.broadcast(closing) if small else closing, "entry", "left_anti")
        best = left.groupBy("source").agg(F.min(F.struct(F.abs(F.col("gap") - F.col("size")).alias("off"), "score", "id", "size", "entry")).alias("best"))
        picked = written(_join(gap, best, "source", small).where("best IS NOT NULL"), "mix-closing")
        if picked.isEmpty():
            break
        chosen = picked.select(F.col("best.entry").alias("entry"))
        closing = chosen if closing is None else closing.unionByName(chosen)
        gap = picked.select("source", (F.col("gap") - F.col("best.size")).alias("gap"))
    done = drawn
    if closing is not None:
        more = closing.select("entry", F.lit(1).alias("more"))
        done = drawn.join(F.broadcast(more) if small else more, "entry", "left").withColumn("extra", F.col("extra") + F.coalesce("more", F.lit(0)))
    return done.select("id", "source", "size", "n", "source_size", "target", "whole", "extra")


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken) for every row of docs; options are those of entries."""
    done = entries(docs, **options).withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    copies = (F.col("whole") + (F.col("row") <= F.col("extra")).cast("int")).cast("long")
    return done.select("id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def _join(left: DataFrame, right: DataFrame, key: str, small: bool = True) -> DataFrame:
    """Left join on a key that may be null; right has a row for each source at most, broadcast if these are few."""
    keyed = right.withColumnRenamed(key, "_key")
    keyed = F.broadcast(keyed) if small else keyed
    return left.join(keyed, left[key].eqNullSafe(keyed["_key"]), "left").drop("_key")


def op9(docs: DataFrame) -> DataFrame:
    return mix_sources(docs).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "copies", "source")


def _oracle() -> str:
    """DuckDB SQL: the same levels, ranks and closing documents, one round of these after another."""
    rounds = ""
    for k in range(CLOSING):
        gone = "" if k == 0 else " AND r.id NOT IN (" + " UNION ALL ".join(f"SELECT id FROM closing{j}" for j in range(k)) + ")"
        rounds += f""", closing{k} AS (
  SELECT r.source, arg_min(r.id, struct_pack(off := abs(gap - size), score := score, id := r.id)) AS id, arg_min(gap - size, struct_pack(off := abs(gap - size), score := score, id := r.id)) AS gap
  FROM ranked r JOIN {f'closing{k - 1}' if k else 'gaps'} g ON r.source IS NOT DISTINCT FROM g.source
  WHERE running > rest AND abs(gap - size) < gap{gone} GROUP BY r.source
)"""
    picked = " UNION ALL ".join(f"SELECT id FROM closing{k}" for k in range(CLOSING))
    return rf"""
WITH sized AS MATERIALIZED (
  SELECT doc_id AS id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || 'mix-1'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w, source_size * 2.0::DOUBLE AS most FROM per
), leveled AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE - (sum(most) OVER o - most)) / (sum(w) OVER () - (sum(w) OVER o - w)) AS level
  FROM weighed WINDOW o AS (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), targets AS MATERIALIZED (
  SELECT source, source_size, least(w * (SELECT arg_min(level, most / w) FROM leveled WHERE level <= most / w), most) AS target FROM leveled
), sizes AS (
  SELECT source, sqrt(size) AS g, sum(size)::DOUBLE AS words FROM sized WHERE size > 0 GROUP BY 1, 2
), scales AS MATERIALIZED (
  SELECT source, arg_max(scale, g) AS scale FROM (
    SELECT s.source, g, (target - 2 * coalesce(sum(words) OVER (PARTITION BY s.source ORDER BY g DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(g * words) OVER (PARTITION BY s.source ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS scale
    FROM sizes s JOIN targets t ON t.source IS NOT DISTINCT FROM s.source) WHERE scale * g <= 2 GROUP BY source
), docs_at AS (
  SELECT s.*, t.source_size, t.target, CASE WHEN size > 0 THEN least(2.0::DOUBLE, coalesce(c.scale * sqrt(size), 2)) ELSE 0.0::DOUBLE END AS expected
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source LEFT JOIN scales c ON s.source IS NOT DISTINCT FROM c.source
), scored AS MATERIALIZED (
  SELECT *, floor(expected) AS whole, u * (1 - (expected - floor(expected))) / (u * (1 - (expected - floor(expected))) + (1 - u) * (expected - floor(expected))) AS score
  FROM docs_at
), rests AS (
  SELECT source, max(target) - sum(whole * size) AS rest FROM scored GROUP BY source
), ranked AS MATERIALIZED (
  SELECT c.*, r.rest, sum(size) OVER (PARTITION BY c.source ORDER BY score, id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running
  FROM scored c JOIN rests r ON c.source IS NOT DISTINCT FROM r.source WHERE expected > whole
), gaps AS (
  SELECT source, max(rest) - coalesce(max(running) FILTER (WHERE running <= rest), 0) AS gap FROM ranked GROUP BY source
){rounds}, picked AS ({picked})
SELECT s.id AS doc_id, s.size, s.source_size, s.target,
       (s.whole + coalesce((r.running <= r.rest)::INT, 0) + (s.id IN (SELECT id FROM picked WHERE id IS NOT NULL))::INT)::BIGINT * s.size AS taken,
       (s.whole + coalesce((r.running <= r.rest)::INT, 0) + (s.id IN (SELECT id FROM picked WHERE id IS NOT NULL))::INT)::BIGINT AS copies, s.source
FROM scored s LEFT JOIN ranked r ON r.id = s.id
"""


ORACLE = _oracle()
