"""Near duplicates by SimHash: fingerprints, pigeonring filtering of candidates, components.

A text's shingles (three lower-cased words, repeats included) are hashed by XXH64; a bit of its fingerprint is 1 if it is set in over
half of the hashes. Documents with equal fingerprints are one class; classes link where at most DISTANCE bits differ.

Pigeonring: cut 64 bits into a ring of SEGMENTS segments. If two fingerprints differ in at most DISTANCE bits, then from some segment
on each chain of l segments in a row differs in at most l * DISTANCE / SEGMENTS bits. With 8 segments and 2 bits the first three
segments of such a chain are equal, the first seven differ in one bit at most, all eight in two. So a class is filed under the three
segments that follow each of the eight starts, and a pair that meets there goes through the longer chains, the last of which is the full
check.

Buckets of more than CROWD classes (near copies by the thousand) are not paired: two fingerprints differ in at most two bits if and only if
both are within one bit of a third number, so each crowded class is filed under the 65 numbers within one bit of it, and a number's
classes, 65 at most, are linked to the least of them. That is exact, and linear in the classes.

Scale: texts are read once and never shuffled; a class has eight rows of twelve bytes. Copies fall together in partial aggregates.
Joins on hot fingerprints and crowded buckets are plain joins between exchanges, which adaptive execution splits.

Defined results: null or blank text has the fingerprint zero and links like any other; a null id is never the least unless its
component has no other (then the component has null); repeated rows have equal results; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cragline.llm.text import give_back_memory
from cragline.operators import graph
from cragline.session import written

SHINGLE = 3
SEED = 42
DISTANCE = 2
SEGMENTS = 8
#: Buckets up to this size are paired: as many partners as a class has numbers within one bit.
CROWD = 64

WIDTH = 64 // SEGMENTS
#: Segments at a chain's start in which no bit may differ, since l * DISTANCE / SEGMENTS is below one.
EQUAL = (SEGMENTS - 1) // DISTANCE


def fingerprint(text: str | None) -> int:
    """The 64 bits of a text."""
    import xxhash

    words = (text or "").encode().lower().split()  # of bytes: A-Z only, and exactly the blanks meant
    if not words:
        return 0
    many = max(1, len(words) - SHINGLE + 1)
    digest = partial(xxhash.xxh64_intdigest, seed=SEED)
    votes = np.zeros(64, np.int64)
    for start in range(0, many, 1 << 14):  # bounded memory for very long texts
        part = words[start : min(many, start + (1 << 14)) + SHINGLE - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(SHINGLE)), strict=False)) if len(words) >= SHINGLE else [b" ".join(words)]
        hashes = np.fromiter(map(digest, shingles), "<u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > many, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, print) for every row of docs; print holds the 64 bits as a signed number."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                found = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "print"])
        give_back_memory()

    return base.mapInArrow(run, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, print long")


def _turned(value: Column, bits: int) -> Column:
    """The 64 bits, turned to the left."""
    return F.shiftleft(value, bits).bitwiseOR(F.shiftrightunsigned(value, 64 - bits)) if bits else value


def ring_members(classes: DataFrame) -> DataFrame:
    """(key, print, turned) of classes (print): a row for each start on the ring; key holds the start and the segments that must be equal."""
    starts = []
    for i in range(SEGMENTS):
        turned = _turned(F.col("print"), WIDTH * i)
        head = F.shiftrightunsigned(turned, 64 - WIDTH * EQUAL)
        starts.append(F.struct((head + F.lit(i << (WIDTH * EQUAL))).alias("key"), turned.alias("turned")))
    return classes.select("print", F.explode(F.array(*starts)).alias("x")).select("x.key", "print", "x.turned")


def _chains_hold(x: Column) -> Column:
    """x: the differing bits of two fingerprints, turned so that the chain begins at the top. All chains stay within their budgets."""
    held = [F.bit_count(F.shiftrightunsigned(x, 64 - WIDTH * n) if n < SEGMENTS else x) <= n * DISTANCE // SEGMENTS for n in range(1, SEGMENTS + 1)]
    # a chain's budget is a whole number, so only the longest chain of each budget says anything
    longest = [h for n, h in enumerate(held, 1) if n == SEGMENTS or n * DISTANCE // SEGMENTS < (n + 1) * DISTANCE // SEGMENTS]
    out = longest[0]
    for h in longest[1:]:
        out = out & h
    return out


def _crowd_links(crowded: DataFrame) -> DataFrame:
    """(u, v): links that give crowded classes (print) the same components as all pairs within two bits."""
    near = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.col("print").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), b)))
    spread = crowded.select("print", F.explode(F.concat(F.array("print"), near)).alias("middle"))
    met = spread.groupBy("middle").agg(F.collect_list("print").alias("prints")).where(F.size("prints") > 1)  # 65 at most
    return met.select(F.array_min("prints").alias("u"), F.explode("prints").alias("v")).where("u <> v")


def links(classes: DataFrame) -> DataFrame:
    """(u, v) of distinct classes (print): the same components as all pairs that differ in at most DISTANCE bits."""
    members = ring_members(classes)
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    placed = written(members.join(sizes, "key"), "ring")
    small = placed.where(f"size <= {CROWD}")
    a, b = (small.select("key", F.col("print").alias(p), F.col("turned").alias(t)) for p, t in (("u", "x"), ("v", "y")))
    paired = a.join(b, "key").where("u < v").where(_chains_hold(F.col("x").bitwiseXOR(F.col("y")))).select("u", "v")
    return paired.union(_crowd_links(placed.where(f"size > {CROWD}").select("print").distinct())).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, print, component_id) for every row of docs."""
    rows = written(fingerprints(docs, id_col, text_col), "prints")
    classes = written(rows.groupBy("print").agg(F.min("doc_id").alias("rep")), "print-classes")
    labels = written(graph.components(written(links(classes.select("print")), "print-links")), "print-labels")
    least = labels.join(classes, labels["id"] == classes["print"]).groupBy("label").agg(F.min("rep").alias("least"))
    named = labels.join(least, "label").select(F.col("id").alias("print"), "least", F.lit(True).alias("linked"))
    place = classes.join(named, "print", "left").select("print", F.when(F.col("linked"), F.col("least")).otherwise(F.col("rep")).alias("component_id"))
    return rows.join(written(place, "print-places"), "print").select("doc_id", "print", "component_id")


def op13(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
