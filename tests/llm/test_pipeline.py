"""The whole pipeline against plain Python and SQL on a small table."""

import collections
import hashlib
import random

import duckdb
import pytest
import zstandard

from cragline.llm import language, mixing
from tests.llm.test_operators import SCHEMA, reachable, spans_of, tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def make_rows():
    random.seed(21)
    syllables = {"en": "the and ing tion er re of in", "de": "sch ung ein ich keit der die zu", "fr": "eau oui ment aux que le des ré"}
    rows = []
    for i in range(150):
        lang = random.choice(list(syllables))
        parts = syllables[lang].split()
        text = " ".join("".join(random.choice(parts) for _ in range(random.randint(1, 3))) for _ in range(random.randint(5, 120)))
        if i % 9 == 0:
            text += " token=" + "a1b2c3d4" * 5
        rows.append((i, text, lang, f"s{i % 4}"))
    rows += [(200 + i, rows[i][1] + (" end" if i % 2 else ""), rows[i][2], "s0") for i in range(0, 40, 2)]
    rows += [(400, None, "en", "s1"), (401, "", "en", None), (402, "12 34", "de", "s1"), (None, rows[0][1] + " and more of it", "en", None), (3, rows[3][1], rows[3][2], rows[3][3])]
    return rows


def known_language(rows, dictionaries):
    how = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_LAZY, min_match=4, window_log=18, hash_log=17, chain_log=17, search_log=4, target_length=32, write_content_size=False, write_checksum=False, write_dict_id=False)
    coders = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how) for d in dictionaries.values()]
    kept = []
    for row in rows:
        text = (row[1] or "").lower()
        if any(c.isalpha() for c in text):
            sizes = sorted(sum(len(c.compress(text[i : i + language.BLOCK_CHARS].encode())) for i in range(0, len(text), language.BLOCK_CHARS)) for c in coders)
            if 1 - sizes[0] / sizes[1] >= language.NARROW:
                kept.append(row)
    return kept


def test_run_equals_plain_version(spark, tmp_path):
    public, library = tokenizer()
    rows = make_rows()
    path = tmp_path / "documents.parquet"
    full = [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]
    docs = spark.createDataFrame(full, SCHEMA)
    docs.coalesce(1).write.parquet(str(path))
    left = known_language(rows, language.learn(docs))
    assert 100 < len(left) < len(rows)

    component = reachable(left)
    left = list(dict.fromkeys(row for row, (i, _, least) in zip(left, component, strict=True) if i == least))  # null ids come last
    cleaned = []
    for i, text, lang, source in left:
        out, at = "", 0
        for a, _, b in spans_of(text):
            if a >= at:
                out += text[at:a] + "[SECRET]"
            at = max(at, b)
        cleaned.append((i, out + text[at:], lang, source))

    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", cleaned)
    copies = dict(db.execute(f"SELECT doc_id, copies FROM ({mixing.ORACLE}) WHERE doc_id IS NOT NULL").fetchall())
    wanted = collections.Counter()
    for i, text, *_ in cleaned:
        ids = " ".join(map(str, library.encode_ordinary(text)))
        wanted[(i, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())] += copies.get(i, 0)
    found = collections.Counter((r["doc_id"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert {k: n for k, n in found.items() if k[0] is not None} == {k: n for k, n in wanted.items() if n and k[0] is not None}
    assert "[SECRET]" in " ".join(t for _, t, *_ in cleaned)


CLASHING = ("_language", "_blob", "_found", "_key", "_size", "_copies", "_copy", "__own", "_spans", "_origin", "size", "found", "component", "own", "entry")


def clashing(spark, rows):
    """Documents with a column of every name that a stage might use on its way, each with a value of its own."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], SCHEMA)
    return docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in CLASHING})


def test_one_of_each_group_stays(spark):
    """Null ids are grouped too, a repeated id may have two texts, and documents without words all stay."""
    from cragline.llm import stages

    words = [f"w{i}" for i in range(100)]
    text = lambda start, k=0: " ".join(f"{start}{w}" for w in words[: 100 - k])
    rows = [(5, text("a"), "s"), (3, text("a", 1), "s"), (None, text("a", 2), "s"), (None, text("n"), "s"), (None, text("n", 1), "s"), (None, text("n"), "s")]
    rows += [(7, text("b"), "s"), (7, text("c"), "s"), (8, text("d"), "s"), (8, text("d", 1), "s"), (9, "", "s"), (9, "", "s"), (None, None, "s"), (10, text("e"), "s"), (10, text("e"), "s")]
    docs = clashing(spark, rows)
    out = stages.keep_one_of_each(docs)
    assert out.columns == docs.columns
    found = sorted(((r["doc_id"], (r["text"] or "")[:1]) for r in out.collect()), key=str)
    assert found == sorted([(3, "a"), (None, "n"), (7, "b"), (7, "c"), (8, "d"), (9, ""), (9, ""), (None, ""), (10, "e")], key=str)
    assert all(r[c] is None or r[c] == f"{c}{r['doc_id']}" for r in out.collect() for c in CLASHING)


def test_stages_keep_clashing_columns(spark):
    from cragline.llm import stages

    rows = [(i, f"some words token=abcdefgh{i} of text {i}", "ab"[i % 2]) for i in range(20)] + [(30, None, None), (None, "lone text", None), (40, "same " * 30, "a"), (40, "same " * 30, "a")]
    docs = clashing(spark, rows)
    clean = stages.redact_secrets(docs)
    assert clean.columns == docs.columns and clean.count() == len(rows)
    assert all("token=" not in (r["text"] or "") and r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in clean.collect())
    assert all(r[c] is None or r[c] == f"{c}{r['doc_id']}" for stage in (clean, stages.mix(docs)) for r in stage.collect() for c in CLASHING)
    taken = collections.Counter()
    for r in stages.mix(docs).collect():
        taken[r["doc_id"], r["source"]] += len(r["text"].split())
    own = collections.Counter()
    for r in mixing.op9(docs).collect():
        own[r["doc_id"], r["source"]] += r["taken"]
    assert taken == +own


def test_stages_keep_columns_and_take_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA + ", blob string, size int")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "blob", "size"]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == 0


def test_last_stage_returns_the_token_ids(spark):
    _, library = tokenizer()
    texts = ["plain words, and  more", "ünï 12345\n\n", "", None]
    docs = spark.createDataFrame([(i, t, "en", "a", None) for i, t in enumerate(texts)], SCHEMA)
    found = {r["doc_id"]: r for r in corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()}
    for i, text in enumerate(texts):
        ids = library.encode_ordinary(text or "")
        assert found[i]["ids"] == ids and found[i]["n_tokens"] == len(ids)
        assert found[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert found[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
