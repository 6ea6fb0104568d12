"""Runs: stretches of words that repeat with a period, found by minimizers at several scales.

A run is a stretch of at least max(LEAST, COPIES * period) words whose words one period apart are identical, that no neighbouring word
extends, named by its smallest period. Periods below SHORT are found by direct scans at each lag. Longer ones go by scales: scale w
is for periods from w to 4/3 w. Its minimizers are the words whose hash is least in some window of w/3 words: inside a run they repeat at
the period's distance. Two of them are equal if the 8/3 w words that follow are, and neighbours among equals w to 4/3 w words apart seed
a run of that lag, which is then extended both ways, word by word.

No run is missed: of COPIES = 4 periods there is room for a first window, a period and the words compared, and these are two
periods long, so equals within a run can't be nearer than its smallest period (Fine and Wilf); the next equal is one period away.
Equality of long stretches is exact: ranks of stretches of 1, 2, 4, ... words, each from pairs of the rank before. They end where all are
distinct, which in running text is after a few words, so scales cost nothing where nothing repeats.

Scale: one pass, a document a step, nothing is shuffled; time and memory are n log n in the words of a text.

Defined results: null or blank text has no words and no runs, and collapses to an empty text; ties go to the smaller start, then
period; repeated rows have equal results; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cragline.llm.text import WORD, give_back_memory, let, text_or_empty

#: A run has this many words at least, and this many periods.
LEAST = 6
COPIES = 4
#: Periods below are found by scans at their lag.
SHORT = 12


def _true_runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the stretches of true flags."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return edges[::2], edges[1::2] - edges[::2]


def _sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """The least (or greatest) value of each window, by running ones over blocks."""
    op, fill = (np.minimum, np.iinfo(values.dtype).max) if least else (np.maximum, 0)
    n = len(values)
    blocks = np.full(-(-n // width) * width, fill, values.dtype)
    blocks[:n] = values
    blocks = blocks.reshape(-1, width)
    ahead = op.accumulate(blocks, 1).ravel()[:n]
    back = op.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()[:n]
    return op(back[: n - width + 1], ahead[width - 1 :])


def minimizers(values: np.ndarray, width: int) -> np.ndarray:
    """Positions that have the least value of some whole window, all of equals."""
    lows = _sliding(values, width, True)
    # a position is the least of a window if the greatest of its windows' least values is its own
    padded = np.concatenate((np.zeros(width - 1, values.dtype), lows, np.zeros(width - 1, values.dtype)))
    return np.flatnonzero(_sliding(padded, width, False) == values)


def _spread(x: np.ndarray) -> np.ndarray:
    """An order of small numbers that doesn't follow theirs; never zero."""
    x = (x + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) | np.uint64(1)


class _Ranks:
    """Ranks of stretches: equal ranks for equal stretches of 1, 2, 4, ... words, as far as any repeats."""

    def __init__(self, ids: np.ndarray) -> None:
        self.levels = [ids]

    def of(self, size: int) -> np.ndarray | None:
        """Keys of the stretches of this size at all places, equal only for equal ones; None if it is known that none repeats."""
        k = size.bit_length() - 1
        while len(self.levels) <= k:
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            pairs = last[:-half].astype(np.int64) * (int(last.max()) + 1) + last[half:]
            distinct, ranks = np.unique(pairs, return_inverse=True)
            if len(distinct) == len(pairs):
                return None
            self.levels.append(ranks)
        level, rest = self.levels[k], size - (1 << k)
        n = len(self.levels[0]) - size + 1
        return level[:n] * np.int64(level.max() + 1) + level[rest : rest + n]


def _extended(ids: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """Start and end of the stretch around a place whose words a lag apart are identical."""
    end, step = at, 64
    while end + lag < len(ids):
        a, b = ids[end : end + step], ids[end + lag : end + lag + step]
        unequal = np.flatnonzero(a[: len(b)] != b)
        if len(unequal):
            end += int(unequal[0])
            break
        end, step = end + len(b), step * 2
    start, step = at, 64
    while start > 0:
        least = max(0, start - step)
        unequal = np.flatnonzero(ids[least:start] != ids[least + lag : start + lag])
        if len(unequal):
            start = least + int(unequal[-1]) + 1
            break
        start, step = least, step * 2
    return start, end + lag


def runs_of(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of the word numbers ids, by start, then period."""
    n, found = len(ids), {}
    for lag in range(1, min(SHORT, n // COPIES + 1)):
        starts, lengths = _true_runs(ids[lag:] == ids[:-lag])
        lengths = lengths + lag
        for i in np.flatnonzero(lengths >= max(LEAST, COPIES * lag)):
            found.setdefault((int(starts[i]), int(lengths[i])), lag)  # smaller lags come first
    ranks, order, w = _Ranks(ids), None, SHORT
    while COPIES * w <= n:
        most = 4 * w // 3
        keys = ranks.of(2 * most)
        if keys is None:
            break  # nor do longer stretches repeat
        order = _spread(ids) if order is None else order
        places = minimizers(order, max(1, w // 3))
        places = places[places < len(keys)]
        chained = places[np.argsort(keys[places], kind="stable")]
        gap = np.diff(chained)
        seeds = np.flatnonzero((np.diff(keys[chained]) == 0) & (gap >= w) & (gap <= most))
        reached: dict[int, int] = {}
        for at, lag in sorted(zip(chained[seeds].tolist(), gap[seeds].tolist(), strict=True)):
            if at < reached.get(lag, 0):
                continue  # in a stretch of this lag that was seen
            start, end = _extended(ids, at, lag)
            reached[lag] = end - lag
            if end - start >= max(LEAST, COPIES * lag):
                known = found.get((start, end - start), lag)
                found[(start, end - start)] = min(known, lag)
        w = most + 1
    return sorted((start, length, period) for (start, length), period in found.items())


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run contains after its first period, joined by spaces."""
    if not runs:
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return b" ".join(words[i] for i in np.flatnonzero(np.cumsum(depth)[:-1] == 0))


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for every row of docs; runs holds (start, length, period) by start, then period."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 512):
                batch = whole.slice(first, 512)
                counts, runs, texts = [], [], []
                for text in batch.column(1):
                    words = (text.as_py() or "").encode().split()  # of bytes: exactly the blanks meant
                    numbers: dict[bytes, int] = {}
                    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
                    own = runs_of(ids) if len(words) >= LEAST else []
                    counts.append(len(words))
                    runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in own])
                    texts.append(collapsed(words, own).decode())
                columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(runs, pa.list_(run_type)), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])
        give_back_memory()

    kind = base.schema["doc_id"].dataType.simpleString()
    return base.mapInArrow(run, f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in one document of ten, by crc32 of its id, the words from some place on repeat those that follow it."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))

    def planted(words: Column) -> Column:
        n, g = F.size(words), F.floor(F.col("h") / 10)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, place(i))), " ")).otherwise("")

    changed = let(F.regexp_extract_all(text_or_empty(F.col("text")), F.lit(WORD), F.lit(0)), planted)
    return docs.select("doc_id", "text", h.alias("h")).select("doc_id", F.when(F.col("h") % 10 == 0, changed).otherwise(F.col("text")).alias("text"))


def op12(docs: DataFrame) -> DataFrame:
    found = find_runs(with_planted_runs(docs))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"), F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


#: In DuckDB: four words in a row at multiples of a lag, and words between, name the lags to scan; all stretches of these lags.
ORACLE = r"""
WITH raw AS (
  SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    xor(4294967295, list_reduce(flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
      lambda acc, x: CASE WHEN x >= 0 THEN xor(acc, x) WHEN acc & 1 = 1 THEN xor(acc >> 1, 3988292384) ELSE acc >> 1 END, 4294967295::BIGINT)) AS h
  FROM documents
), places AS (
  SELECT *, len(w) AS n, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a, (h // 10) % 8 AS m FROM raw
), docs AS MATERIALIZED (
  SELECT id, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
    THEN list_transform(range(0, n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + m)) END]) ELSE w END AS w
  FROM places
), tried AS (
  SELECT id, n, w, q, unnest(range(0, n // q - 2)) * q AS i FROM (SELECT id, n, w, unnest(range(1, n // 4 + 1)) AS q FROM docs)
), lags AS MATERIALIZED (
  SELECT DISTINCT id, q FROM tried WHERE w[i + 1] = w[i + q + 1] AND w[i + 1] = w[i + 2 * q + 1] AND w[i + 1] = w[i + 3 * q + 1]
    AND w[i + q // 2 + 1] = w[i + q // 2 + q + 1] AND w[i + q // 3 + 1] = w[i + q // 3 + q + 1] AND w[i + 2 * q // 3 + 1] = w[i + 2 * q // 3 + q + 1]
    AND w[i + q // 2 + 1] = w[i + q // 2 + 2 * q + 1]
), cuts AS (
  SELECT id, q, list_concat([-1], list_filter(range(0, n - q), lambda i: w[i + 1] <> w[i + q + 1]), [n - q]) AS c FROM lags JOIN docs USING (id)
), stretches AS (
  SELECT id, q, c[i] + 1 AS s, c[i + 1] - c[i] - 1 + q AS l FROM (SELECT id, q, c, unnest(range(1, len(c))) AS i FROM cuts)
), runs AS MATERIALIZED (
  SELECT id, s, l, min(q) AS q FROM stretches WHERE l >= greatest(6, 4 * q) GROUP BY id, s, l
), lists AS (
  SELECT id, count(*) AS n_runs, min((-l, s, q)) AS best, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines,
    list((s + q, s + l)) AS gone FROM runs GROUP BY id
)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, best[2] AS start, -best[1] AS length, best[3] AS period, -1000 * best[1] // best[3] AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(range(0, n), lambda i: len(list_filter(gone, lambda r: i >= r[1] AND i < r[2])) = 0), lambda i: w[i + 1]) END, ' ')) AS collapsed_sha256
FROM docs d LEFT JOIN lists USING (id)
"""
