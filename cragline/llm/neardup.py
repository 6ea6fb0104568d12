"""Near duplicates: fast similarity sketches, banding, exact verification, connected components.

A document is its set of three-word shingles (64-bit hashes of lower-cased words). A sketch has COORDINATES bins: in round i
every shingle is hashed to a bin and a value, bins still empty take their least value, and rounds go on until all
bins are filled; from round COORDINATES on, each round fills one bin for certain. Coordinates agree with the probability
of the Jaccard similarity. BAND_ROWS coordinates make a band; documents that agree in a band are candidates.

Documents with equal sets are one class, so copies are never paired. Within a band's bucket classes are linked to a
pivot, the class with the smallest share of shingles that no other candidate has; what stays in different components
after that is paired once more, exhaustively: no cap on buckets or partners. Pairs are first held to an exact bound from their
sizes and from the shingles that no other candidate has (a common part of at most m, so a similarity of at most
m / (a + b - m)), in the exhaustive pairing also from histograms of the sets, and those within it are verified on whole sets. A link of similarity 0.85 fails to meet in any
of the 20 bands with a probability of 4e-7.

Scale: texts are read once for sketches and shuffled once for the sets of candidates. Components come from rounds of
hooking nodes to neighbours of least priority and contracting the links, on tables written to the shared folder; no table of
all documents reaches the driver or one task. Joins on hot keys are plain joins between exchanges, which adaptive
execution splits; the exhaustive pairing joins on bucket and size class, so a large group meets only partners whose size
the bound allows.

Defined results: null or blank text has an empty set and links with nothing; a null id is never the smallest unless its
component has no other; rows that repeat an id and text have equal results; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cragline.llm.text import give_back_memory, text_or_empty
from cragline.operators import graph
from cragline.session import written

COORDINATES = 80
BAND_ROWS = 4
#: Cells of a set's histogram, by which the exhaustive pairing bounds common parts.
HISTOGRAM = 256
#: A link: 100 * intersection >= THRESHOLD * union.
THRESHOLD = 85

_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the three-word shingles."""
    import xxhash

    words = (text or "").encode().lower().split()  # of bytes: A-Z only, and exactly the blanks meant
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(h) == 0:
        return h
    if len(h) < 3:
        return mix(np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(h))], np.uint64))
    return np.unique(mix(h[:-2] * _C1 + h[1:-1] * _C2 + h[2:] * _C3))


def sketch(shingles: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """The t coordinates of a non-empty set."""
    out = np.zeros(t, np.uint64)
    empty = np.ones(t, bool)
    for i in range(2 * t):
        h = mix(shingles + np.uint64(i + 1) * _C2)
        if i >= t:
            if empty[i - t]:
                out[i - t], empty[i - t] = mix(h.min() + np.uint64(i) * _C1), False
        else:
            bins = ((h >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32)
            order = np.argsort(h)  # by bin, then value: bins grow with the upper bits
            first = order[np.flatnonzero(np.diff(bins[order], prepend=np.uint64(t)))]
            fresh = first[empty[bins[first].astype(np.int64)]]
            at = bins[fresh].astype(np.int64)
            out[at], empty[at] = mix(h[fresh] + np.uint64(i) * _C1), False
        if not empty.any():
            break
    return out


def band_keys(coordinates: np.ndarray, rows: int = BAND_ROWS) -> np.ndarray:
    """One 64-bit key for each band of so many coordinates."""
    grid = coordinates.reshape(-1, rows)
    key = np.arange(1, len(grid) + 1, dtype=np.uint64) * _C3
    for i in range(rows):
        key = mix(key * _C1 + grid[:, i])
    return key.view(np.int64)


def set_id(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers."""
    import xxhash

    high, low = np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), np.int64)
    return int(high), int(low)


def _sketched(docs: DataFrame) -> DataFrame:
    """(doc_id, own, n, high, low, bands) of rows (doc_id, text, own)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "own", "n", "high", "low", "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for whole in batches:
                for start in range(0, whole.num_rows, 512):
                    batch = whole.slice(start, 512)
                    n, high, low, bands = [], [], [], []
                    for text in batch.column(1):
                        own = shingle_set(text.as_py())
                        pair = set_id(own)
                        n.append(len(own))
                        high.append(pair[0])
                        low.append(pair[1])
                        bands.append(band_keys(sketch(own)) if len(own) else [])
                    columns = [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays(columns, names)
        give_back_memory()

    return docs.mapInArrow(run, f"doc_id {kind}, own binary, n long, high long, low long, bands array<long>")


def _sets(rows: DataFrame) -> DataFrame:
    """(node, shingles, histogram) of rows (node, high, low, text); a row whose text has another set is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for whole in batches:
                for start in range(0, whole.num_rows, 256):
                    nodes, sets, counts = [], [], []
                    for row in whole.slice(start, 256).to_pylist():
                        own = shingle_set(row["text"])
                        if set_id(own) == (row["high"], row["low"]):
                            nodes.append(row["node"])
                            sets.append(own.view(np.int64))
                            counts.append(np.bincount((own % np.uint64(HISTOGRAM)).astype(np.int64), minlength=HISTOGRAM))
                    columns = [pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int32()))]
                    yield pa.RecordBatch.from_arrays(columns, ["node", "shingles", "histogram"])
        give_back_memory()

    return rows.select("node", "high", "low", "text").mapInArrow(run, "node long, shingles array<long>, histogram array<int>")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are links, by their whole sets."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            linked = []
            for i in range(batch.num_rows):
                p, q = (np.asarray(c[i].values.to_numpy(), np.int64).view(np.uint64) for c in (x, y))
                both = len(np.intersect1d(p, q, assume_unique=True))
                linked.append(100 * both >= THRESHOLD * (len(p) + len(q) - both))
            yield batch.select([0, 1]).filter(pa.array(linked, pa.bool_()))

    joined = pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y")
    return joined.mapInArrow(run, "a long, b long").distinct()


def _may_link(a: str, b: str) -> Column:
    """An upper bound of the similarity of two classes reaches the threshold: the common part is at most n - u of either."""
    most = F.least(F.col(f"{a}.n") - F.col(f"{a}.u"), F.col(f"{b}.n") - F.col(f"{b}.u"))
    return (100 + THRESHOLD) * most >= THRESHOLD * (F.col(f"{a}.n") + F.col(f"{b}.n"))


def _common_bound(a: str, b: str) -> Column:
    """At least the size of the common part: what two histograms share, cell by cell."""
    shared = F.zip_with(f"{a}.histogram", f"{b}.histogram", lambda x, y: F.least(x, y))
    return F.aggregate(shared, F.lit(0), lambda acc, x: acc + x)


def components(links: DataFrame) -> DataFrame:
    """(node, label) of rows (a, b): label is the least node of the component. Nodes without links have no row."""
    return written(graph.components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnRenamed("id", "node"), "labels")


#: Size classes of the exhaustive pairing grow by this factor.
SIZE_STEP = 1.02


def _size_class(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / math.log(SIZE_STEP)).cast("int")


def text_digest(text: Column) -> Column:
    """What a text is known by, whatever its row's id: null is as empty."""
    return F.unhex(F.sha2(text_or_empty(text).cast("binary"), 256))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, own, n, component, component_id) for every row of docs: own is its text's digest, component one number for each
    component, null for a document without words, and component_id its least id.

    Classes come back to a text of theirs by its digest, not by an id, which many rows may share or lack; copies of a text fall together in
    partial aggregates before they are shuffled."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), text_digest(F.col(text_col)).alias("own"))
    rows = written(_sketched(base), "sketches")
    classes = rows.where("n > 0").groupBy("high", "low").agg(F.min("doc_id").alias("rep"), F.min("own").alias("own"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    members = classes.select(F.explode("bands").alias("key"), "node")
    shared = members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("key")
    members = written(members.join(shared, "key"), "members")
    candidates = classes.join(members.select("node").distinct(), "node", "left_semi").select("node", "own", "high", "low")
    sets = written(_sets(base.groupBy("own").agg(F.first("text").alias("text")).join(candidates, "own")), "sets")

    owned = sets.select("node", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.min("node").alias("node"), F.max("node").alias("other"))
    owned = owned.where("node = other").groupBy("node").agg(F.count(F.lit(1)).alias("u"))
    nodes = sets.select("node", F.size("shingles").cast("long").alias("n")).distinct().join(owned, "node", "left")
    nodes = nodes.select("node", "n", F.coalesce("u", F.lit(0)).alias("u")).where(f"100 * (n - u) >= {THRESHOLD} * n")
    members = written(members.join(nodes, "node"), "bounded")

    pivots = members.groupBy("key").agg(F.min(F.struct((F.col("u") / F.col("n")).alias("share"), "node", "n", "u")).alias("p"), F.count(F.lit(1)).alias("size"))
    pivots = pivots.where("size > 1").select("key", "p.node", "p.n", "p.u")
    starred = pivots.alias("p").join(members.alias("m"), "key").where(F.col("p.node") != F.col("m.node")).where(_may_link("p", "m"))
    starred = written(starred.select(F.col("p.node").alias("a"), F.col("m.node").alias("b")).distinct(), "star-pairs")
    links = written(_verified(starred, sets), "star-links")

    labels = components(links)
    placed = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    spread = placed.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most").select("key")
    placed = placed.join(spread, "key")
    keys = placed.groupBy("node").agg(F.collect_list("key").alias("keys"))  # a key a band at most
    placed = written(placed.join(keys, "node").join(sets.select("node", "histogram").dropDuplicates(["node"]), "node"), "placed")
    # the largest component of a bucket needs no row on the left: its members are all linked already
    main = placed.groupBy("key", "label").agg(F.count(F.lit(1)).alias("size")).groupBy("key").agg(F.max(F.struct("size", "label")).alias("main"))
    left = placed.join(main.select("key", F.col("main.label").alias("main")), "key").where("label <> main").drop("main")
    low, high = _size_class(F.ceil(F.col("n") * THRESHOLD / 100)), _size_class(F.floor((100 + THRESHOLD) * (F.col("n") - F.col("u")) / THRESHOLD - F.col("n")))
    left = left.where(F.floor((100 + THRESHOLD) * (F.col("n") - F.col("u")) / THRESHOLD - F.col("n")) >= 1)
    left = left.withColumn("low", low).withColumn("high", high).where("low <= high").withColumn("class", F.explode(F.sequence("low", "high")))
    right = placed.withColumn("class", _size_class(F.col("n")))
    # a pair is made once, in the least bucket that both are in
    once = F.array_min(F.array_intersect("l.keys", "r.keys")) == F.col("l.key")
    similar = (100 + THRESHOLD) * _common_bound("l", "r") >= THRESHOLD * (F.col("l.n") + F.col("r.n"))
    both = (F.col("l.key") == F.col("r.key")) & (F.col("l.class") == F.col("r.class")) & (F.col("l.label") != F.col("r.label"))
    rest = left.alias("l").join(right.alias("r"), both & _may_link("l", "r") & once & similar)
    rest = rest.select(F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b")).distinct()
    tried = starred.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = written(rest.join(tried, ["a", "b"], "left_anti"), "rest-pairs")
    if not rest.isEmpty():
        more = written(_verified(rest, sets), "rest-links")
        if not more.isEmpty():
            labels = components(links.union(more))

    named = labels.join(classes.select("node", "rep"), "node")
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = written(labels.join(least, "label").select("node", "label", "component_id"), "components")
    place = classes.join(named, "node", "left")
    place = place.select("high", "low", F.coalesce("label", "node").alias("component"), F.coalesce("component_id", "rep").alias("component_id"))
    full = rows.where("n > 0").select("doc_id", "own", "n", "high", "low").join(written(place, "places"), ["high", "low"])
    empty = rows.where("n = 0").select("doc_id", "own", "n", F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id"))
    return full.select(*empty.columns).unionByName(empty)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs."""
    out = groups(docs, id_col, text_col)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


#: In DuckDB: all pairs that share a shingle, and their transitive closure.
ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words
), items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach(id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.id, p.b FROM reach r JOIN pairs p ON p.a = r.other
), least AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, l.component_id, l.component_id = s.doc_id AS kept FROM sets s JOIN least l ON l.id = s.doc_id
"""


def op10(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs)
