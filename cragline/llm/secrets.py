"""Secret scans over an incremental blob ledger.

A blob is a text by its SHA-256. The ledger is a Parquet table (blob, rule_version, found) that holds every scanned pair,
also those without a finding. A scan takes the (path, text) versions, reduces them to distinct blobs, leaves out the pairs
that the ledger has, scans the rest, appends them, and joins the findings back to all paths that hold the blob.

Everything is SQL. A rule's matches are found by splitting the text at the rule and by extracting the rule's matches: the
lengths of both lists in turn give the positions, in code points. Only texts in which a rule matches at all are split.

Scale: texts are shuffled once, by blob, after duplicates within a map task are gone; a blob that a third of all paths
share is therefore scanned once and meets as one row a task. Findings go to the ledger, so that joining them back
shuffles hashes and paths only, between two plain exchanges that adaptive execution may split where one blob is hot.

Defined results: null text is empty; null paths are kept; rows that repeat are answered each; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cragline.llm.text import let
from cragline.session import scratch_path

#: Kind, pattern, groups and their least lengths, and text without which nothing can match. Base kinds come first.
#: A greedy run of one class that must reach a length is written with that length; it then matches just where the run does.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
RULES = (
    ("assign", ASSIGN, 2, 8, ()),
    ("access", r"(AKIA[A-Z0-9]{12,})", 1, 16, ("AKIA",)),
    ("hex", r"([0-9a-f]{32,})", 1, 32, ()),
    ("github", r"(gh[pousr]_[A-Za-z0-9]{36,})", 1, 40, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    ("jwt", r"(eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+)", 1, 20, ("eyJ",)),
    ("pem", r"(-----BEGIN [A-Z ]*PRIVATE KEY-----)", 1, 27, ("-----BEGIN ",)),
    ("url", r"([a-z]{2,12}://[A-Za-z0-9._~%-]+:[A-Za-z0-9._~%+-]+@)", 1, 8, ("://",)),
)
BASE_KINDS = 3
RULE_VERSION = "2024-1"

FOUND = "array<struct<start:int,kind:int,end:int>>"
PART = 256


def blob_id(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _spans(text: Column, kind: int) -> Column:
    """Spans of a rule as (start, kind, end), matches too short in their group left out."""
    _, pattern, group, least, needs = RULES[kind]

    def located(matches: Column) -> Column:
        def with_gaps(gaps: Column) -> Column:
            def step(acc: Column, i: Column) -> Column:
                start = acc["at"] + F.length(gaps[i])
                end = start + F.length(matches[i])
                return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))).alias("out"))

            def run(acc: Column, first: Column) -> Column:
                """PART matches: an array that grows by one is copied each time, so long lists grow by parts."""
                begin = F.struct(acc["at"].alias("at"), F.array().cast(FOUND).alias("out"))
                own = F.sequence(first, F.least(first + PART, F.size(matches)) - 1)
                return F.aggregate(own, begin, step, lambda x: F.struct(x["at"].alias("at"), F.array_append(acc["out"], x["out"]).alias("out")))

            begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{FOUND}>").alias("out"))
            return F.aggregate(F.sequence(F.lit(0), F.size(matches) - 1, F.lit(PART)), begin, run, lambda acc: F.flatten(acc["out"]))

        return let(F.split(text, pattern, -1), with_gaps)

    every = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), located)
    if group > 1:  # the pattern doesn't hold the least length, so values that are too short are left out here
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        every = let(values, lambda v: F.filter(every, lambda _, i: F.length(v[i]) >= least))
    hit = text.rlike(pattern)
    if needs:
        present = F.lit(False)
        for need in needs:
            present = present | F.contains(text, F.lit(need))
        hit = present & hit
    return F.when(hit, every).otherwise(F.array().cast(FOUND))


def found_in(text: Column) -> Column:
    """All spans of a text by start, then kind as listed, then end."""
    return F.array_sort(F.flatten(F.array(*[_spans(text, kind) for kind in range(len(RULES))])))


def scan_blobs(blobs: DataFrame) -> DataFrame:
    """(blob, rule_version, found) of rows (blob, text)."""
    return blobs.select("blob", F.lit(RULE_VERSION).alias("rule_version"), found_in(F.col("text")).alias("found"))


def scan_versions(versions: DataFrame, ledger: str, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """Scans what the ledger (a folder, made if absent) hasn't seen; returns (path, blob, found) for every row of versions."""
    spark = versions.sparkSession
    given = versions.select(F.col(path_col).alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    given = given.withColumn("blob", blob_id(F.col("text")))
    blobs = given.groupBy("blob").agg(F.first("text").alias("text"))
    if (seen := read_ledger(spark, ledger)) is not None:
        blobs = blobs.join(seen.where(F.col("rule_version") == RULE_VERSION).select("blob"), "blob", "left_anti")
    scan_blobs(blobs).write.mode("append").parquet(ledger)
    return given.select("path", "blob").join(findings(spark, ledger), "blob", "left").select(
        "path", "blob", F.coalesce("found", F.array().cast(FOUND)).alias("found")
    )


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame | None:
    """The ledger's rows, or None where there is none yet."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(f"blob binary, rule_version string, found {FOUND}").parquet(ledger)


def findings(spark: SparkSession, ledger: str) -> DataFrame:
    """(blob, found) of the blobs in which this version of the rules found anything, once each even if two scans noted a blob."""
    known = read_ledger(spark, ledger).where((F.col("rule_version") == RULE_VERSION) & (F.size("found") > 0))
    return known.select("blob", "found").dropDuplicates(["blob"])


def _listed(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(rule[0]) for rule in RULES])
    return F.array_join(
        F.transform(found, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def redact(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """The text with every found span (in order of start) replaced; spans that overlap become one mark."""

    def step(acc: Column, s: Column) -> Column:
        kept = F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), kept.otherwise(acc["out"]).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    rest = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(found) > 0, F.aggregate(found, begin, step, rest)).otherwise(text)


def _count(found: Column, kind: int) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")


def op1(docs: DataFrame) -> DataFrame:
    ledger = scratch_path(docs.sparkSession, "ledger")
    found = scan_versions(docs.select(F.col("doc_id").alias("path"), "text"), ledger)
    counts = [_count(F.col("found"), kind).alias(f"n_{RULES[kind][0]}") for kind in range(BASE_KINDS)]
    base = _listed(F.filter("found", lambda s: s["kind"] < BASE_KINDS))
    return found.select(
        F.col("path").alias("doc_id"), *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans")
    )


def _oracle() -> str:
    """DuckDB SQL from the same table of rules: split, extract, and add up lengths."""
    fold = ASSIGN.replace("(?i:(password|passwd|secret|token|api_?key))", "(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])").replace("'", "''")
    parts = []
    for kind, (name, pattern, _, least, _) in enumerate(RULES):
        regex = fold if kind == 0 else pattern
        keep = f"length(regexp_extract(m[i], '{regex}', 1)) >= {least}" if kind == 0 else "true"
        parts.append(
            f"""SELECT doc_id, {kind} AS kind, '{name}' AS name, unnest(list_filter(list_transform(range(1, len(m) + 1), lambda i: struct_pack(
  ok := {keep}, s := list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0), n := length(m[i]))), lambda x: x.ok)) AS x
  FROM (SELECT doc_id, string_split_regex(text, '{regex}') AS g, regexp_extract_all(text, '{regex}') AS m FROM texts)"""
        )
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
found AS ({' UNION ALL '.join(parts)}),
listed AS (SELECT doc_id, kind, x.s::BIGINT AS s, name || ':' || x.s::BIGINT || ':' || (x.s + x.n)::BIGINT AS span FROM found)
SELECT t.doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
       sha256(coalesce(string_agg(span, ',' ORDER BY s, kind) FILTER (WHERE kind < {BASE_KINDS}), '')) AS base_sha256,
       coalesce(string_agg(span, ',' ORDER BY s, kind), '') AS spans
FROM texts t LEFT JOIN listed l ON l.doc_id = t.doc_id GROUP BY t.doc_id
"""


ORACLE = _oracle()
