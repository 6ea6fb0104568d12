"""Quality rules with risk-controlled thresholds.

Every text gets features from its words and lines, in SQL, within its row. Two base rules reject outright. The other rules reject
where a feature is high. Which high values matter is learnt apart from the holdout: the lift of a rule's upper tail is its share
of the documents labelled bad over its share (and SMOOTH) of the background, which is the documents without a label and, by a hash of
the id, one in BACKGROUND of those labelled good. A document's score is the greatest lift
of the tails it lies in, over all rules; scores below LEAST_LIFT count as 0.

The other documents labelled good are the holdout. In each stratum (language) one sequence of cutoffs on the score is tested from the
most lenient on: with n good documents of which k score above the cutoff, it stands if P(Binomial(n, RISK) <= k) is at most ERROR
over the number of tests. That is the exact binomial bound, corrected by Bonferroni over tests; within a test the sequence
is fixed before the holdout is seen, so rules and cutoffs cost nothing more. Each stratum is a test of its own; those whose holdout
couldn't pass even with k = 0 (fewer than ln(ERROR / (strata + 1)) / ln(1 - RISK) good documents, 228 for four strata) are tested together
as one. With probability 1 - ERROR, no stratum with a test of its own, nor the mixture of the others, loses more than RISK of its good
documents to all rules together. That of the mixture is no promise to any one stratum in it, whose own loss may be greater. Where a test
doesn't pass, nothing is rejected beyond the base rules.

Scale: texts are read once and not shuffled; features (about 60 bytes a row) go to the shared folder. Calibration joins
them with the labels by id and counts BUCKETS buckets a rule, and scores a stratum, pre-aggregated. The lifts are one row, of BUCKETS
numbers a rule; cutoffs are one row a stratum.

Defined results: null text has no words and fails; a null language is a stratum; a document with several labels is good if
all are 1; labels of unknown documents and null labels count for nothing; repeated rows count each; an empty table gives an empty
result; extra columns are ignored. Without a bad or a background document there is no lift and no further rejection.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cragline.llm.text import SPACE, let
from cragline.session import written

RISK = 0.02
ERROR = 0.05
BUCKETS = 256
#: Lift is a share of bad documents over a share of the background plus SMOOTH; scores are lifts in hundredths.
SMOOTH, LEAST_LIFT, BACKGROUND = 0.01, 200, 10
#: Rule, feature (higher is worse) in terms of the counts, and the feature's value at the last bucket.
RULES = (
    ("symbols", "n_symbols / greatest(n_words, 1)", 2.0),
    ("dup_lines", "n_dup_lines / greatest(n_lines, 1)", 1.0),
    ("repeats", "n_repeat_words / greatest(n_words, 1)", 1.0),
    ("long_words", "word_chars / greatest(n_words, 1)", 32.0),
    ("short_words", "greatest(16 - word_chars / greatest(n_words, 1), 0)", 16.0),
)
#: Up to so many strata, cutoffs are broadcast.
BROADCAST_STRATA = 100_000

BLANK = " \t\n\x0b\x0c\r"
POS_BITS = 22
_POS = 2**POS_BITS - 1


def _neighbour_runs(keys: Column, same) -> Column:
    """Elements of a sorted array that equal the one before or after them."""
    def repeats(x: Column, i: Column) -> Column:
        before, after = F.get(keys, i - 1), F.get(keys, i + 1)
        return F.coalesce(same(x, before), F.lit(False)) | F.coalesce(same(x, after), F.lit(False))

    return F.filter(keys, repeats)


def _covered(places: Column) -> Column:
    """How many words three-word windows at these (sorted, non-empty) places cover."""
    return F.aggregate(
        F.slice(places, 2, F.size(places)),
        F.struct(places[0].alias("last"), F.lit(3).cast("long").alias("n")),
        lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(p - acc["last"], F.lit(3))).alias("n")),
        lambda acc: acc["n"],
    )


def _exact_repeats(w: Column) -> Column:
    """Words in repeated windows, by sorting the windows themselves."""
    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(w[i].alias("a"), w[i + 1].alias("b"), w[i + 2].alias("c"), i.cast("long").alias("i")))

    def same(x: Column, y: Column) -> Column:
        return (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])

    found = let(F.array_sort(windows), lambda k: _neighbour_runs(k, same))
    places = let(found, lambda d: F.array_sort(F.transform(d, lambda x: x["i"])))
    return let(places, lambda p: F.when(F.size(p) == 0, F.lit(0).cast("long")).otherwise(_covered(p)))


def repeat_words(w: Column) -> Column:
    """Words in three-word windows that occur twice or more, of an array of words.

    Windows are sorted as numbers, a hash above the position; runs of equal hashes are checked word by word, and
    should one hold different windows, or the array be too long for the position bits, the windows themselves are sorted.
    """
    def key(i: Column) -> Column:
        return F.xxhash64(w[i], w[i + 1], w[i + 2]).bitwiseAND(F.lit(~_POS)).bitwiseOR(i.cast("long"))

    def same_hash(x: Column, y: Column) -> Column:
        return F.shiftright(x, POS_BITS) == F.shiftright(y, POS_BITS)

    def differs(d: Column) -> Column:
        def at(i: Column) -> Column:
            a, b = d[i - 1].bitwiseAND(F.lit(_POS)).cast("int"), d[i].bitwiseAND(F.lit(_POS)).cast("int")
            return same_hash(d[i - 1], d[i]) & ~((w[a] == w[b]) & (w[a + 1] == w[b + 1]) & (w[a + 2] == w[b + 2]))

        return F.exists(F.sequence(F.lit(1), F.size(d) - 1), at)

    def count(d: Column) -> Column:
        places = F.sort_array(F.transform(d, lambda x: x.bitwiseAND(F.lit(_POS))))
        return F.when(F.size(d) == 0, F.lit(0).cast("long")).when(differs(d), _exact_repeats(w)).otherwise(let(places, _covered))

    keys = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), key))
    fast = let(keys, lambda k: let(_neighbour_runs(k, same_hash), count))
    return F.when(F.size(w) < 3, F.lit(0).cast("long")).when(F.size(w) > _POS, _exact_repeats(w)).otherwise(fast)


def features(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """keep columns, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of every text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    trimmed = F.btrim(text, F.lit(BLANK))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACE}]+", -1))
    by_words = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeat_words(w).alias("n_repeat_words"),
        ),
    )
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.btrim(line, F.lit(BLANK)) != "")
    by_lines = let(
        lines,
        lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")
        ),
    )
    symbols = F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols")
    found = docs.select(*keep, by_words.alias("w"), by_lines.alias("l"), symbols)
    return found.select(*keep, "w.n_words", "w.word_chars", "n_symbols", "l.n_lines", "l.n_dup_lines", "w.n_repeat_words")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def bucket(rule: tuple[str, str, float]) -> Column:
    return F.least(F.floor(F.expr(rule[1]) * BUCKETS / rule[2]), F.lit(BUCKETS - 1)).cast("int")


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1: Stirling's series at x + 8."""
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5)) - 1 / (1680 * F.pow(y, 7))
    steps = reduce(lambda acc, i: acc + F.log(x + i), range(1, 8), F.log(x))
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + series - steps


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k) where k < n * p, else 1: the last term, times the sum of terms relative to it."""
    n, k = n.cast("double"), k.cast("double")
    last = log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    terms = F.least(k, F.ceil(60 * F.sqrt(n * p)) + 60).cast("int")

    def step(acc: Column, j: Column) -> Column:
        term = acc["term"] * (k - j + 1) * (1 - p) / ((n - k + j) * p)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    begin = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    more = F.when(terms > 0, F.sequence(F.lit(1), terms)).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(more, begin, step, lambda acc: acc["sum"])
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.exp(last) * total)


def quality_of(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(labelled, role): bad, holdout or background of each labelled id; of several labels the least counts."""
    known = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(id_col).alias("labelled"))
    part = F.conv(F.substring(F.md5(F.col("labelled").cast("string").cast("binary")), 1, 4), 16, 10).cast("int") % BACKGROUND
    role = F.when(F.min("quality") != 1, "bad").when(part == 0, "background").otherwise("holdout")
    return known.agg(role.alias("role"))


def lifts(judged: DataFrame) -> DataFrame:
    """One row with an array of BUCKETS scores for each rule, from documents with their role (null where not labelled)."""
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("rule"), bucket(rule).alias("bucket")) for i, rule in enumerate(RULES)])).alias("cell")
    known = judged.select((F.col("role") == "bad").alias("is_bad"), (F.col("role") == "holdout").alias("held"), cells)
    known = known.where(~F.coalesce("held", F.lit(False))).groupBy("cell.rule", "cell.bucket")
    counts = known.agg(F.count_if("is_bad").alias("bad"), F.count_if(~F.coalesce("is_bad", F.lit(False))).alias("other"))
    whole = Window.partitionBy("rule")  # BUCKETS rows at most
    tail = whole.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    share = {c: F.sum(c).over(tail) / F.nullif(F.sum(c).over(whole), F.lit(0)) for c in ("bad", "other")}
    scored = counts.select("rule", "bucket", F.floor(100 * (share["bad"] / (share["other"] + SMOOTH))).cast("int").alias("lift"))
    every = scored.agg(F.collect_list(F.struct("rule", "bucket", "lift")).alias("all"))

    def dense(rule: int) -> Column:
        own = F.filter("all", lambda x: (x["rule"] == rule) & (x["lift"] >= LEAST_LIFT))
        at = lambda b: F.coalesce(F.array_max(F.transform(F.filter(own, lambda x: x["bucket"] <= b), lambda x: x["lift"])), F.lit(0))
        return F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), at)

    return every.select(*[dense(i).alias(f"lift_{rule[0]}") for i, rule in enumerate(RULES)])


def scored(rows: DataFrame, lift: DataFrame) -> DataFrame:
    """rows with score, the greatest lift over the rules."""
    every = F.greatest(*[F.get(F.col(f"lift_{rule[0]}"), bucket(rule)) for rule in RULES])
    return rows.crossJoin(F.broadcast(lift)).withColumn("score", every).drop(*[f"lift_{rule[0]}" for rule in RULES])  # one row


def cutoffs(holdout: DataFrame) -> DataFrame:
    """(stratum, alone, cutoff) of the good documents' (stratum, score): the least cutoff that stands, for strata that are not alone that of
    all of them together; strata without one are left out."""
    sizes = holdout.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    strata = sizes.agg(F.count(F.lit(1)).alias("strata"))
    grouped = sizes.crossJoin(F.broadcast(strata)).withColumn("alone", F.pow(F.lit(1 - RISK), F.col("n")) <= ERROR / (F.col("strata") + 1))
    groups = written(grouped.select("stratum", "alone", F.struct("alone", F.when(F.col("alone"), F.col("stratum")).alias("name")).alias("group")), "quality-strata")
    level = groups.agg((ERROR / F.count_distinct("group")).alias("level"))  # one row
    counts = holdout.groupBy("stratum", "score").agg(F.count(F.lit(1)).alias("n"))
    named = counts.join(groups.withColumnRenamed("stratum", "_stratum"), F.col("stratum").eqNullSafe(F.col("_stratum")))
    counts = named.groupBy("group", "score").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy("group")  # a row for each score, of which there are 100 * 100 at most
    above = whole.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    tested = counts.withColumns({"above": F.coalesce(F.sum("n").over(above), F.lit(0)), "total": F.sum("n").over(whole)})
    passed = tested.crossJoin(F.broadcast(level)).where(binomial_cdf(F.col("above"), F.col("total"), RISK) <= F.col("level"))
    return groups.join(passed.groupBy("group").agg(F.min("score").alias("cutoff")), "group").select("stratum", "alone", "cutoff")


def certified(holdout: DataFrame) -> DataFrame:
    """(stratum, cutoff) of the strata that stand by their own holdout."""
    return cutoffs(holdout).where("alone").select("stratum", "cutoff")


def judge(measured: DataFrame, labels: DataFrame, stratum: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """measured with base_failed and kept."""
    quality = quality_of(labels)
    judged = measured.where(~base_failed()).join(quality, F.col(id_col) == F.col("labelled"), "left")
    lift = written(lifts(judged), "quality-lifts")
    good = measured.where(~base_failed()).join(quality.where("role = 'holdout'"), F.col(id_col) == F.col("labelled"), "left_semi")
    limits = written(cutoffs(scored(good, lift).select(F.col(stratum).alias("stratum"), "score")).drop("alone"), "quality-limits")
    limits = F.broadcast(limits) if limits.count() <= BROADCAST_STRATA else limits
    joined = scored(measured, lift).join(limits, F.col(stratum).eqNullSafe(F.col("stratum")), "left")
    fine = F.coalesce(F.col("score") <= F.col("cutoff"), F.lit(True))
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & fine).drop("stratum", "cutoff")


def op4(docs: DataFrame, labels: DataFrame) -> DataFrame:
    measured = written(features(docs), "quality-features")
    return judge(measured, labels).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _oracle() -> str:
    """DuckDB SQL of the same rules."""
    buckets = ", ".join(f"least(floor(({feature.replace(' / ', '::DOUBLE / ')}) * {BUCKETS} / {most}::DOUBLE), {BUCKETS - 1})::INT AS b{i}" for i, (_, feature, most) in enumerate(RULES))
    cells = " UNION ALL ".join(f"SELECT role, {i} AS rule, b{i} AS bucket FROM judged WHERE role <> 'holdout'" for i in range(len(RULES)))
    score = ", ".join(f"coalesce((SELECT max(lift) FROM lifts l WHERE l.rule = {i} AND l.bucket <= m.b{i}), 0)" for i in range(len(RULES)))
    p = f"{RISK}::DOUBLE"
    return rf"""
WITH texts AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents),
split AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM texts
), windows AS (
  SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: struct_pack(i := i, x := w[i:i + 2]))) AS k FROM split
), repeated AS (
  SELECT doc_id, k.i AS i, count(*) OVER (PARTITION BY doc_id, k.x) AS n FROM windows
), covered AS (
  SELECT doc_id, count(DISTINCT j)::BIGINT AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM repeated WHERE n > 1) GROUP BY doc_id
), counted AS (
  SELECT s.doc_id, lang, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM split s LEFT JOIN covered c ON c.doc_id = s.doc_id
), measured AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {buckets} FROM counted
), known AS (SELECT doc_id, CASE WHEN min(quality) <> 1 THEN 'bad' WHEN ('0x' || substr(md5(doc_id::VARCHAR), 1, 4))::INT % {BACKGROUND} = 0 THEN 'background' ELSE 'holdout' END AS role
  FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
judged AS (SELECT m.*, coalesce(role, 'background') AS role FROM measured m LEFT JOIN known k ON k.doc_id = m.doc_id WHERE NOT base_failed),
cells AS (SELECT rule, bucket, count(*) FILTER (WHERE role = 'bad') AS bad, count(*) FILTER (WHERE role = 'background') AS other FROM ({cells}) GROUP BY ALL),
tails AS (
  SELECT rule, bucket, sum(bad) OVER t / nullif(sum(bad) OVER w, 0)::DOUBLE AS bad, sum(other) OVER t / nullif(sum(other) OVER w, 0)::DOUBLE AS other FROM cells
  WINDOW w AS (PARTITION BY rule), t AS (PARTITION BY rule ORDER BY bucket DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), lifts AS (SELECT * FROM (SELECT rule, bucket, floor(100 * (bad / (other + {SMOOTH}::DOUBLE)))::INT AS lift FROM tails) WHERE lift >= {LEAST_LIFT}),
marked AS (SELECT m.*, greatest({score}) AS score FROM measured m),
holdout AS (SELECT lang AS stratum, score FROM marked m JOIN known k ON k.doc_id = m.doc_id WHERE NOT base_failed AND role = 'holdout'),
strata AS (SELECT stratum, pow(1 - {p}, count(*)) <= {ERROR}::DOUBLE / ((SELECT count(*) FROM (SELECT DISTINCT stratum FROM holdout)) + 1) AS alone FROM holdout GROUP BY stratum),
groups AS (SELECT stratum, struct_pack(a := alone, n := CASE WHEN alone THEN stratum END) AS g FROM strata),
counts AS (SELECT g, score, count(*) AS n FROM holdout h JOIN groups s ON s.stratum IS NOT DISTINCT FROM h.stratum GROUP BY ALL),
tested AS (
  SELECT *, coalesce(sum(n) OVER (PARTITION BY g ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS k,
         sum(n) OVER (PARTITION BY g)::BIGINT AS total FROM counts
), passed AS (
  SELECT * FROM tested WHERE CASE WHEN k >= total * {p} THEN 1.0::DOUBLE ELSE list_sum(list_transform(range(0, k + 1), lambda i:
    exp(lgamma(total + 1.0::DOUBLE) - lgamma(i + 1.0::DOUBLE) - lgamma(total - i + 1.0::DOUBLE) + i * ln({p}) + (total - i) * ln(1 - {p})))) END
    <= {ERROR}::DOUBLE / (SELECT count(DISTINCT g) FROM groups)
), limits AS (SELECT stratum, cutoff FROM groups JOIN (SELECT g, min(score) AS cutoff FROM passed GROUP BY g) USING (g))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(score <= cutoff, true) AS kept
FROM marked m LEFT JOIN limits l ON l.stratum IS NOT DISTINCT FROM m.lang
"""


ORACLE = _oracle()
