"""Centroid clusters, periodic runs and SimHash groups against brute force, on nulls, blanks, repeats, ties, long texts and clashing columns."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cragline.llm import clusters, periods, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, rows):
    clashing = ("key", "print", "turned", "size", "u", "v", "id", "label", "least", "runs", "h", "best", "start", "collapsed", "component_id")
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in clashing})


# --- centroid clusters


def plain_kmeans(rows, k=8, rounds=10):
    kept = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    centroids = [v for _, v in order[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((far(v, c), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for _, v in kept:
            groups[near(v)[1]].append(v)
        centroids = [[sum(c) // len(groups[n]) for c in zip(*groups[n], strict=True)] if n in groups else old for n, old in enumerate(centroids)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = collections.Counter()
    for _, c, d in found:
        inertia[c] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, c, d, inertia[c], sum(inertia.values()), digest[c]) for i, c, d in found]


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("x") for c in ("v", "h", "cluster", "distance", "pivots", "n")})


def odd_vectors():
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=64) + 3 * (i % 5)).tolist()) for i in range(60)]
    rows += [(None, rows[0][1]), (None, rows[1][1]), (7, rows[7][1]), (7, rows[7][1]), (100, [0.0] * 64), (101, [0.0] * 64), (102, [-0.0005] * 64)]
    rows += [(200, None), (201, []), (202, [1.0] * 63), (203, [float("nan")] + [1.0] * 63), (204, [float("inf")] + [1.0] * 63), (205, [None] + [1.0] * 63), (206, [1.0] * 65)]
    return rows


@pytest.mark.parametrize("rows", [odd_vectors(), odd_vectors()[:5], [(1, [1.0] * 64)] * 9, odd_vectors()[-7:], []])
def test_clusters_equal_brute_force(spark, rows):
    found = [tuple(r) for r in clusters.op11(vectors(spark, rows)).collect()]
    assert sorted(found, key=repr) == sorted(plain_kmeans(rows), key=repr)


def test_clusters_refuse_components_whose_squares_do_not_fit(spark):
    with pytest.raises(PySparkException, match="a component exceeds"):
        clusters.op11(vectors(spark, [(1, [1e9] * 64)])).collect()


@settings(deadline=None, max_examples=60)
@given(st.integers(0, 2**32), st.integers(1, 9), st.sampled_from([1, 3, 1000, 2**26]))
def test_ptolemaic_bounds_hold_and_pruning_changes_nothing(seed, k, size):
    rng = np.random.default_rng(seed)
    v, pivots = rng.integers(-size, size + 1, (40, 64)), rng.integers(-size, size + 1, (k, 64))
    v[:k] = pivots[: len(v[:k])]
    centroids = np.concatenate((pivots[: k // 2], rng.integers(-size, size + 1, (k - k // 2, 64))))
    exact = ((v[:, None] - centroids[None]) ** 2).sum(2)
    low = clusters.bounds(clusters.roots(v, pivots), pivots, centroids)
    assert (low <= exact).all()
    cluster, distance, _ = clusters.nearest(v, clusters.roots(v, pivots), pivots, centroids)
    assert (cluster == exact.argmin(1)).all() and (distance == exact.min(1)).all()


def test_bounds_spare_most_distances_of_clustered_vectors(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 64)) * 4
    rows = [(i, (centres[i % 8] + rng.normal(size=64) * 0.2).tolist()) for i in range(400)]
    found, _ = clusters.kmeans(vectors(spark, rows))
    assert found.agg(F.avg("measured")).first()[0] < 4


# --- periodic runs


def plain_runs(words):
    found = {}
    for q in range(1, len(words) // 4 + 1):
        start = 0
        for i in range(len(words) - q + 1):
            if i == len(words) - q or words[i] != words[i + q]:
                if i - start + q >= max(6, 4 * q):
                    found.setdefault((start, i - start + q), q)
                start = i + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def numbered(words):
    known = {}
    return np.array([known.setdefault(w, len(known)) for w in words], np.int64)


@settings(deadline=None, max_examples=300)
@given(st.lists(st.integers(0, 2), max_size=120))
def test_short_runs_equal_brute_force(words):
    assert periods.runs_of(numbered(words)) == plain_runs(words)


@settings(deadline=None, max_examples=300)
@given(st.integers(0, 2**32), st.integers(1, 4), st.integers(1, 90), st.integers(2, 6))
def test_runs_of_runs_equal_brute_force(seed, letters, period, copies):
    """Blocks that hold runs themselves, repeated, broken in places, with other runs around."""
    rng = random.Random(seed)
    words = []
    for _ in range(3):
        block = []
        while len(block) < period:
            block += [rng.randrange(letters) for _ in range(rng.randint(1, 4))] * rng.choice([1, 1, 5, 20])
        words += block[:period] * copies + block[: rng.randint(0, period)]
        words += [rng.randrange(letters) for _ in range(rng.randint(0, 3))]
    for _ in range(rng.choice([0, 0, 1, 3])):
        words[rng.randrange(len(words))] = rng.randrange(letters)
    assert periods.runs_of(numbered(words)) == plain_runs(words)


def test_long_periods_and_long_texts():
    rng = random.Random(1)
    block = [rng.randrange(50) for _ in range(3_000)]
    words = [60] * 9 + block * 5 + block[:17] + [61] + ["a", "b"] * 30_000
    found = periods.runs_of(numbered(words))
    assert (9, 15_017, 3_000) in found and (15_027, 60_000, 2) in found and (0, 9, 1) in found
    assert all(n >= max(6, 4 * q) for _, n, q in found)
    fibonacci = "ab"
    for _ in range(20):
        fibonacci = fibonacci.replace("b", "c").replace("a", "ab").replace("c", "a")
    assert len(periods.runs_of(numbered(fibonacci))) == 0  # no Fibonacci word has a fourth power
    cubes = list(fibonacci[:400]) * 4
    assert periods.runs_of(numbered(cubes)) == plain_runs(cubes)


def test_minimizers_are_the_least_of_some_window():
    rng = np.random.default_rng(2)
    for width in (1, 2, 5, 9):
        values = rng.integers(1, 6, 60).astype(np.uint64)
        wanted = {j for i in range(60 - width + 1) for j in range(i, i + width) if values[j] == values[i : i + width].min()}
        assert set(periods.minimizers(values, width).tolist()) == wanted


def test_runs_of_odd_documents(spark):
    rng = random.Random(4)
    rows = [(i, " \n".join(rng.choice(["a", "B", "тест", "x" * 40]) for _ in range(rng.randint(1, 200)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " \t\x0b "), (None, "w " * 7), (203, "w " * 5), (204, "one"), (205, "ß ß " * 6), (3, rows[3][1]), (206, "a b c " * 40_000)]
    found = {}
    for r in periods.op12(documents(spark, rows)).collect():
        found.setdefault(r["doc_id"], []).append(r)
    texts = collections.defaultdict(list)
    for i, t in rows:
        texts[i].append(t)
    assert sum(map(len, found.values())) == len(rows)
    import zlib

    for i, (text, *_) in texts.items():
        words = WORD.findall(text or "")
        h = None if i is None else zlib.crc32(str(i).encode())
        if h is not None and h % 10 == 0 and words:
            a, n = h // 10 % len(words), len(words)
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        runs = plain_runs(words) if len(words) < 1000 else [(0, 120_000, 3)]
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        wanted = (len(runs), *best, best[0] is not None and 1000 * best[1] // best[2] or None)
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        for r in found[i]:
            assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) == wanted
            assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
            assert r["collapsed_sha256"] == hashlib.sha256(kept.encode()).hexdigest()
    assert periods.op12(documents(spark, [])).count() == 0


# --- SimHash


def plain_print(text):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """{print: least of its component's prints' names} of {print: name}."""
    at = {p: p for p in prints}

    def root(p):
        while at[p] != p:
            p = at[p]
        return p

    for p, q in itertools.combinations(prints, 2):
        if (p ^ q).bit_count() <= 2:
            at[root(p)] = root(q)
    least = {}
    for p, name in prints.items():
        if name is not None:
            least[root(p)] = min(name, least.get(root(p), name))
    return {p: least.get(root(p)) for p in prints}


def check_simhash(spark, rows):
    found = simhash.op13(documents(spark, rows)).collect()
    own = [(i, plain_print(t)) for i, t in rows]
    names = {}
    for i, p in own:
        names[p] = min((x for x in (i, names.get(p)) if x is not None), default=None)
    component = plain_components(names)
    assert sorted(map(repr, map(tuple, found))) == sorted(repr((i, f"{p:016x}", component[p])) for i, p in own)


def test_simhash_groups_equal_brute_force(spark):
    rng = random.Random(8)
    vocabulary = ["alpha", "Beta", "gamma", "тест", "É", "#", "x" * 50]
    base = [rng.choice(vocabulary) + str(rng.randrange(30)) for _ in range(400)]
    rows = [(i, " ".join(w if rng.random() > 0.002 * (i % 4) else "other" for w in base)) for i in range(120)]
    rows += [(200 + i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 9)))) for i in range(60)]
    rows += [(None, rows[0][1]), (None, "only null ids"), (None, "only null ids"), (300, None), (301, ""), (302, " \n"), (None, None), (5, rows[5][1]), (5, "other text of five"), (303, "ONE two"), (304, "one TWO")]
    rows += [(305, " ".join(rng.choice(vocabulary) for _ in range(40_000)))]
    check_simhash(spark, rows)
    check_simhash(spark, [])


def test_crowded_and_small_buckets_link_like_all_pairs(spark, monkeypatch):
    """Prints around few centres, so that buckets are crowded: with and without pairing the components are those of all pairs."""
    rng = random.Random(6)
    prints = {}
    for _ in range(5):
        centre = rng.getrandbits(64)
        for _ in range(150):
            flips = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))
            prints[centre ^ flips] = 0
    prints = {p: n for n, p in enumerate(prints)}
    signed = {p - (1 << 64) if p >> 63 else p: p for p in prints}
    classes = spark.createDataFrame([(s,) for s in signed], "print long")
    for crowd in (64, 1, 10**6):
        monkeypatch.setattr(simhash, "CROWD", crowd)
        links = [(signed[r["u"]], signed[r["v"]]) for r in simhash.links(classes).collect()]
        group = {p: {p} for p in prints}
        for u, v in links:
            if group[u] is not group[v]:
                group[u] |= group[v]
                for x in group[v]:
                    group[x] = group[u]
        assert {p: min(prints[x] for x in group[p]) for p in prints} == plain_components(prints)
        if crowd == 10**6:
            assert all((u ^ v).bit_count() <= 2 for u, v in links)


def test_every_close_pair_has_a_chain_within_its_budgets():
    for a, b in itertools.combinations(range(64), 2):
        x = 1 << a | 1 << b
        turned = [(x << 8 * i | x >> (64 - 8 * i)) & (1 << 64) - 1 for i in range(8)]
        assert any(t >> 40 == 0 and all((t >> (64 - 8 * n)).bit_count() <= n * 2 // 8 for n in range(1, 9)) for t in turned)


# --- near duplicates whose ids say nothing


def test_near_duplicates_with_null_and_shared_ids_in_number(spark):
    """A third of the rows without an id and 5,000 texts of one id are grouped as if each had its own."""
    from cragline.llm import neardup

    rng = random.Random(12)
    texts = []
    for i in range(3750):
        words = [f"w{rng.randrange(900)}" for _ in range(40)]
        texts += [" ".join(words), " ".join([*words[:-1], "end"]) if i % 3 else " ".join(words)]
    named = spark.createDataFrame([(None if i % 3 == 0 else 7, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    plain = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    sizes = lambda df: sorted(r["n"] for r in neardup.groups(df).groupBy("component").agg(F.count(F.lit(1)).alias("n")).collect())
    found = sizes(named)
    assert found == sizes(plain) == [2] * 3750


# --- byte-level BPE of long words


def test_shifted_runs_are_encoded_from_left_to_right():
    """Words of runs whose phase isn't that of their chunks, and the time of a long one."""
    import time

    import public_tokenizers
    import tiktoken

    from cragline.llm import bpe

    known = bpe.vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known[0], special_tokens={})
    tables = bpe.Tables(known)
    rng = random.Random(5)
    units = [b"o", b"ha", b"-", b"no", b"x", b"the", "é".encode()]
    words = [b"".join(rng.choice(units) * rng.randint(1, 700) + bytes(rng.choices(b"abNx", k=rng.randint(0, 3))) for _ in range(rng.randint(1, 5))) for _ in range(80)]
    for word, ids in zip(words, tables.encode(words).split(), strict=True):
        assert ids.tolist() == library._core_bpe.encode_single_piece(word)
    began = time.time()
    long = b"N" + b"o" * 400_000
    assert tables.encode([long]).flat.tolist() == library._core_bpe.encode_single_piece(long) and time.time() - began < 30
