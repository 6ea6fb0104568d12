"""Byte-level BPE encoding and decoding with DuckDB inside Spark tasks.

The vocabulary is a fixed file of ranks; its path is a parameter. Each task opens an in-memory DuckDB with two tables:
``merges`` (left, right, rank), every way to cut a token in two tokens, and ``vocab`` (id, bytes). Texts are cut into
pieces between which no token can lie, pieces into words by the split pattern. New words of a slice of texts go to
DuckDB in recursive queries: their token-position rows join ``merges``, and each word's leftmost pair of least rank is
contracted, until no pair can be. Decoding joins the ids of whole documents to ``vocab`` and concatenates their bytes by an
ordered aggregation.

The query starts with bytes, or with two bytes as a token where the bytes around settle that they will be one: no token that ends with
the byte before and the first, or begins with the second and the byte after, has a lesser or equal rank, and no longer token that begins
or ends with the two has a lesser rank than theirs. Then nothing takes either byte before their own merge, and nothing takes their token
before that merge's turn, so its being early changes no later one. Two such pairs never overlap.

The query's rows grow with the square of a word's length, so words over CHUNK_BYTES are contracted in chunks. Where two
chunks meet, the two ids there must be what their joint bytes contract to; if not, the ids around are contracted
together, further out each time. Ids all of whose neighbours pass that test are those of the whole word: the first merge
across a border between two of them would also happen when these two are contracted alone.

Scale: no shuffle. Words and pieces that a task has met are kept until there are CACHE_PIECES of them. The vocabulary (50,256
entries) and its merges are broadcast; their size is that of the file.

Defined results: null text is empty, has no tokens and decodes to nothing; repeated rows give repeated rows; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cragline.llm.text import give_back_memory

#: Bytes of words in one recursive query, and of a chunk; bits of a position in a word; a reach in tokens.
BATCH_BYTES = 150_000
CHUNK_BYTES = 64
POS_BITS = 22
SHIFTING = 16
#: Characters of texts in a slice (fewer take less memory, more learn fewer words anew), pieces that a task keeps, and tokens that are
#: decoded at once.
SLICE_CHARS = 2_000_000
CACHE_PIECES = 250_000
DECODE_TOKENS = 200_000

#: A space that lies between two pieces only seemingly: white space before it, and none but white space after it.
_UNCUT = re.compile(r"\s \s|\s \Z")

#: Pieces that are split together, a line each, ended by LINE: white space in them is a space in front and single line feeds between
#: other characters. At LINE no word goes on, and LINE is a word.
LINE = "\r"
_DARK = r"[^\x00-\x20\x7f-\xa0\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}\x{3000}\x{feff}]+"
_PLAIN = rf"^ ?{_DARK}(\n{_DARK})*$"

_POS = 2**POS_BITS - 1
_NEVER = 2**62

#: Rows (cell, id): cell is word << POS_BITS | position. A word's best pair is rank, position and the position that goes,
#: packed in that order, so the least number is the leftmost pair of least rank. A word without a pair is done.
CONTRACT = f"""
WITH RECURSIVE step(cell, id, done) AS (
    SELECT cell, id, false FROM start
  UNION ALL (
    WITH pairs AS (
      SELECT cell, id, lead(id) OVER w AS next_id, lead(cell) OVER w AS next_at FROM step WHERE NOT done WINDOW w AS (ORDER BY cell)
    ), best AS (
      SELECT cell >> {POS_BITS} AS word, min((m.rank << {2 * POS_BITS}) | ((cell & {_POS}) << {POS_BITS}) | (next_at & {_POS})) AS pair
      FROM pairs p JOIN merges m ON m.pair = (p.id << 32) | p.next_id WHERE next_at >> {POS_BITS} = cell >> {POS_BITS} GROUP BY 1
    )
    SELECT s.cell, CASE WHEN s.cell & {_POS} = (b.pair >> {POS_BITS}) & {_POS} THEN b.pair >> {2 * POS_BITS} ELSE s.id END, b.pair IS NULL
    FROM step s LEFT JOIN best b ON b.word = s.cell >> {POS_BITS}
    WHERE NOT s.done AND (b.pair IS NULL OR s.cell & {_POS} <> b.pair & {_POS})
  )
)
SELECT cell >> {POS_BITS} AS word, id FROM step WHERE done ORDER BY cell
"""

#: The bytes of each sequence of rows (seq, pos, id), as Latin-1 text.
DECODE = "SELECT t.seq, string_agg(v.latin, '' ORDER BY t.pos) AS latin FROM tokens t JOIN vocab v ON v.id = t.id GROUP BY t.seq ORDER BY t.seq"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


Vocabulary = tuple[dict[bytes, int], np.ndarray, np.ndarray]


def vocabulary(path: str) -> Vocabulary:
    """Ranks, and of every way to cut a token in two: the packed pair, and the token's rank."""
    ranks = read_ranks(path)
    cuts = [(ranks[t[:i]] << 32 | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    pairs, made = (np.array(column, np.int64) for column in zip(*cuts, strict=True))
    return ranks, pairs, made


class Lists:
    """Lists of numbers, end to end: ``flat``, and the size and start of each."""

    def __init__(self, flat: np.ndarray, size: np.ndarray) -> None:
        self.flat, self.size = flat, size
        self.start = np.cumsum(size) - size

    def __add__(self, other: Lists) -> Lists:
        return Lists(np.concatenate([self.flat, other.flat]), np.concatenate([self.size, other.size]))

    def joined(self, which: np.ndarray, groups: np.ndarray) -> Lists:
        """The lists numbered by which, end to end in groups of so many."""
        size = self.size[which]
        flat = self.flat[np.repeat(self.start[which] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(groups)])]
        return Lists(flat, np.diff(ends))

    def split(self) -> list[np.ndarray]:
        return [self.flat[a : a + n] for a, n in zip(self.start.tolist(), self.size.tolist(), strict=True)]


NONE = np.zeros(0, np.int64)


class Tables:
    """A task's DuckDB, with the merge and vocabulary tables."""

    def __init__(self, known: Vocabulary) -> None:
        import duckdb

        ranks, pairs, made = known
        self.token = {rank: token for token, rank in ranks.items()}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        several = [(t, r) for t, r in ranks.items() if len(t) > 1]
        rank = np.fromiter((r for _, r in several), np.int64, len(several))
        head, tail = (np.fromiter((int.from_bytes(t[at], "big") for t, _ in several), np.int64, len(several)) for at in (slice(2), slice(-2, None)))
        two = np.fromiter((len(t) == 2 for t, _ in several), bool, len(several))
        self.early, self.begins, self.ends, over = (np.full(2**16, _NEVER, np.int64) for _ in range(4))
        np.minimum.at(self.begins, head, rank)
        np.minimum.at(self.ends, tail, rank)
        np.minimum.at(over, np.concatenate([head[~two], tail[~two]]), np.tile(rank[~two], 2))
        self.early[head[two]] = np.where(over[head[two]] > rank[two], rank[two], _NEVER)
        self.fits: dict[tuple[int, int], bool] = {}
        self.chunks: dict[bytes, list[int]] = {}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "250MB", "temp_directory": ""})
        self._table("merges", {"pair": pairs, "rank": made})
        self.decimal = pa.array(map(str, range(max(ranks.values()) + 1)), pa.large_string())
        latin = pa.array([t.decode("latin-1") for t in ranks])
        self._table("vocab", {"id": pa.array(ranks.values(), pa.int64()), "latin": latin})

    def _table(self, name: str, columns: dict) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def contract(self, words: list[bytes] | pa.Array) -> Lists:
        """The ids of each word (not empty), by the recursive query."""
        words = pa.array(words, pa.large_binary()) if isinstance(words, list) else words
        sizes = pc.binary_length(words).to_numpy()
        ends = np.cumsum(sizes)
        out, counts, at, before = [NONE], [NONE], 0, 0
        while at < len(words):
            upto = int(np.searchsorted(ends, min(before + BATCH_BYTES, ends[-1]))) + 1
            size, total = sizes[at:upto], int(ends[upto - 1]) - before
            pos = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, upto - at], pa.int32()), words[at:upto]), pa.scalar(b"", pa.large_binary()))
            raw = np.frombuffer(joined[0].as_buffer(), np.uint8)
            cell, ids = self._settled(np.repeat(np.arange(upto - at), size) << POS_BITS | pos, raw, pos > 0)
            self._table("start", {"cell": cell, "id": ids})
            found = self.db.sql(CONTRACT).to_arrow_table()
            out.append(found.column("id").to_numpy())
            counts.append(np.bincount(found.column("word").to_numpy(), minlength=upto - at))
            at, before = upto, int(ends[upto - 1])
        return Lists(np.concatenate(out), np.concatenate(counts))

    def _settled(self, cell: np.ndarray, raw: np.ndarray, goes_on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells and ids with which the query starts: bytes, or two as a token where their neighbours settle it (see the module).
        goes_on: this byte isn't a word's first."""
        pair = raw[:-1].astype(np.int64) << 8 | raw[1:]
        rank, left, right = (np.where(goes_on[1:], by[pair], _NEVER) for by in (self.early, self.ends, self.begins))
        least = np.minimum(np.append(_NEVER, left)[:-1], np.append(right, _NEVER)[1:])
        settled = np.flatnonzero(rank < least)
        ids, stays = self.single[raw], np.ones(len(raw), bool)
        ids[settled] = rank[settled]
        stays[settled + 1] = False
        return cell[stays], ids[stays]

    def encode(self, words: list[bytes] | pa.Array) -> Lists:
        """The ids of each word (not empty): long ones in chunks, mended where chunks meet."""
        words = pa.array(words, pa.large_binary()) if isinstance(words, list) else words
        long = pc.greater(pc.binary_length(words), CHUNK_BYTES)
        short, place = self.contract(words.filter(pc.invert(long))), np.argsort(np.argsort(long.to_numpy(zero_copy_only=False), kind="stable"))
        if len(short.size) == len(words):
            return short
        return (short + self._chunked(words.filter(long).to_pylist())).joined(place, np.ones(len(place), np.int64))

    def _chunked(self, words: list[bytes]) -> Lists:
        cut = [[w[a : a + CHUNK_BYTES] for a in range(0, len(w), CHUNK_BYTES)] for w in words]
        parts = dict.fromkeys(chain.from_iterable(cut))
        which = {part: i for i, part in enumerate(parts)}
        groups = np.fromiter(map(len, cut), np.int64, len(cut))
        found = self.contract(list(parts))
        whole = found.joined(np.fromiter((which[p] for p in chain.from_iterable(cut)), np.int64), groups)
        seams = {i: np.cumsum([found.size[which[p]] for p in own[:-1]]).tolist() for i, own in enumerate(cut)}
        mended = self._mended({i: own.tolist() for i, own in enumerate(whole.split())}, seams)
        ids = [np.array(mended[i], np.int64) for i in range(len(words))]
        return Lists(np.concatenate(ids), np.fromiter(map(len, ids), np.int64, len(ids)))

    def _mended(self, ids: dict[int, list[int]], seams: dict[int, list[int]]) -> dict[int, list[int]]:
        """ids, right at the seams (places in ids) too. What isn't after SHIFTING tokens of reach is a run whose phase is another than
        where its chunks begin; it is contracted from left to right."""
        reach = 2
        while seams:
            self._try([(ids[i][s - 1], ids[i][s]) for i in seams for s in seams[i]])
            wrong = {i: own for i in seams if (own := [s for s in seams[i] if not self.fits[ids[i][s - 1], ids[i][s]]])}
            if reach > SHIFTING:
                return ids | {i: self._onward(ids[i], own) for i, own in wrong.items()}
            spans: dict[int, list[list[int]]] = {}
            for i in wrong:
                own = spans.setdefault(i, [])
                for s in wrong[i]:
                    low, high = max(0, s - reach), min(len(ids[i]), s + reach)
                    if own and low <= own[-1][1]:
                        own[-1][1] = high
                    else:
                        own.append([low, high])
            again = iter(self.contract([b"".join(self.token[t] for t in ids[i][low:high]) for i in spans for low, high in spans[i]]).split())
            seams = {}
            for i, own in spans.items():
                old, new, at, edges = ids[i], [], 0, []
                for low, high in own:
                    new += old[at:low]
                    edges += [len(new)] * (low > 0)
                    new += next(again).tolist()
                    edges += [len(new)] * (high < len(old))
                    at = high
                ids[i] = new + old[at:]
                if edges:
                    seams[i] = edges
            reach += 2
        return ids

    def _onward(self, old: list[int], wrong: list[int]) -> list[int]:
        """A word's ids, old but for some wrong seams: from the first on, each chunk begins where the ids before it are settled, all
        but the last of its own are taken, and old ids come back where they meet a border of the new ones. In a run all chunks are
        alike, and are contracted once. Where a chunk doesn't fit to what is before it, it begins further back and is longer."""
        ends = np.cumsum([len(self.token[t]) for t in old])
        text = b"".join(self.token[t] for t in old)
        border = {int(e): k for k, e in enumerate(ends.tolist(), 1)}  # where old ids end: how many there are before
        left = sorted(wrong, reverse=True)
        out = old[: left[-1] - 1]
        at = int(ends[left[-1] - 2]) if left[-1] > 1 else 0
        size, back, adopted = CHUNK_BYTES, 1, 0
        while at < len(text):
            own = self._chunk(text[at : at + size])
            last = at + size >= len(text)
            if len(own) == 1 and not last:
                size *= 2
                continue
            if out and not self._fits(out[-1], own[0]):
                for token in out[-back:]:
                    at -= len(self.token[token])
                    size += len(self.token[token])
                del out[-back:]
                back *= 2
                continue
            size, back = CHUNK_BYTES, 1
            for token in own if last else own[:-1]:
                out.append(token)
                at += len(self.token[token])
                k = border.get(at)
                while left and k is not None and left[-1] < k:
                    left.pop()
                upto = left[-1] - 1 if left else len(old)  # old ids are right so far
                if k is not None and k < upto and adopted < upto and self._fits(token, old[k]):
                    out += old[k:upto]
                    at, adopted = int(ends[upto - 1]), upto
                    break
        return out

    def _chunk(self, part: bytes) -> list[int]:
        if part not in self.chunks:
            if len(self.chunks) > CACHE_PIECES // 64:
                self.chunks = {}
            self.chunks[part] = self.contract([part]).flat.tolist()
        return self.chunks[part]

    def _fits(self, a: int, b: int) -> bool:
        if (a, b) not in self.fits:
            self._try([(a, b)])
        return self.fits[a, b]

    def _try(self, pairs: list[tuple[int, int]]) -> None:
        """Notes for each two ids whether their joint bytes contract to just these."""
        new = [p for p in dict.fromkeys(pairs) if p not in self.fits]
        found = self.contract([self.token[a] + self.token[b] for a, b in new]).split()
        if len(self.fits) > CACHE_PIECES:
            self.fits = {p: self.fits[p] for p in pairs if p in self.fits}
        self.fits.update((p, own.tolist() == list(p)) for p, own in zip(new, found, strict=True))

    def written(self, ids: Lists) -> pa.Array:
        """Each sequence of ids as text, joined by a space."""
        ends = pa.array(np.append(0, np.cumsum(ids.size)), pa.int32())
        return pc.binary_join(pa.ListArray.from_arrays(ends, self.decimal.take(pa.array(ids.flat))), pa.scalar(" ", pa.large_string()))

    def decode(self, ids: Lists) -> list[bytes]:
        """The bytes of each sequence of ids, some DECODE_TOKENS ids at a time."""
        out = [b""] * len(ids.size)
        seq = np.repeat(np.arange(len(out)), ids.size)
        for at in range(0, len(seq), DECODE_TOKENS):
            end = min(at + DECODE_TOKENS, len(seq))
            self._table("tokens", {"seq": seq[at:end], "pos": np.arange(at, end), "id": ids.flat[at:end]})
            found = self.db.sql(DECODE).to_arrow_table()
            for i, latin in zip(found.column("seq").to_pylist(), found.column("latin").to_pylist(), strict=True):
                out[i] += latin.encode("latin-1")
        return out


class Coder:
    """Encodes texts slice by slice; pieces and words that were met before are looked up."""

    def __init__(self, known: Vocabulary, pattern: str) -> None:
        import regex

        self.tables, self.split = Tables(known), regex.compile(pattern).findall
        self.names = pa.array([], pa.large_string())
        self.ids = Lists(NONE.astype(np.int32), NONE)

    def _places(self, names: pa.Array) -> np.ndarray:
        """Where the ids of these pieces or words are; -1 if they weren't met."""
        return pc.index_in(names, value_set=self.names).fill_null(-1).to_numpy().astype(np.int64)

    def _keep(self, names: pa.Array, ids: Lists) -> None:
        self.names = pa.concat_arrays([self.names, names])
        self.ids += Lists(ids.flat.astype(np.int32), ids.size)

    def _keep_latest(self, used: np.ndarray) -> None:
        """Forgets what isn't at one of these places."""
        self.names = self.names.take(pa.array(used))
        self.ids = self.ids.joined(used, np.ones(len(used), np.int64))

    def _words(self, pieces: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The words of all pieces, end to end, and how many each piece has. Plain pieces are split together, a line each."""
        plain = pc.match_substring_regex(pieces, _PLAIN)
        odd = [self.split(piece) for piece in pieces.filter(pc.invert(plain)).to_pylist()]
        found = pa.array(self.split(LINE.join(pieces.filter(plain).to_pylist())), pa.large_string())
        ends = pc.equal(found, LINE)
        at = np.flatnonzero(ends.to_numpy(zero_copy_only=False))
        plain = plain.to_numpy(zero_copy_only=False)
        counts = np.empty(len(pieces), np.int64)
        counts[plain] = np.diff(np.concatenate([[-1], at, [len(found)]]))[: plain.sum()] - 1
        counts[~plain] = [len(own) for own in odd]
        words = pa.concat_arrays([found.filter(pc.invert(ends)), pa.array(chain.from_iterable(odd), pa.large_string())])
        order = np.argsort(~plain, kind="stable")  # the order of words: plain pieces, then odd ones
        lists = Lists(np.arange(len(words)), counts[order])
        back = np.argsort(order, kind="stable")
        return words.take(pa.array(lists.joined(back, np.ones(len(back), np.int64)).flat)), counts

    def _learn(self, pieces: pa.Array) -> np.ndarray:
        """Finds the ids of new pieces, those of their words, end to end; where they are."""
        words, counts = self._words(pieces)
        coded = words.dictionary_encode()
        places = self._places(coded.dictionary)
        new = np.flatnonzero(places < 0)
        places[new] = len(self.names) + np.arange(len(new))
        words = coded.dictionary.take(pa.array(new))
        self._keep(words, self.tables.encode(words.cast(pa.large_binary())))
        places = places[coded.indices.to_numpy()]
        several = counts > 1
        at = np.empty(len(pieces), np.int64)
        at[~several] = places[np.repeat(~several, counts)]
        at[several] = len(self.names) + np.arange(several.sum())
        self._keep(pieces.filter(pa.array(several)), self.ids.joined(places[np.repeat(several, counts)], counts[several]))
        return at

    def ids_of(self, texts: list[str]) -> Lists:
        """The ids of each text. A text is cut before single spaces, where no token can lie across, unless white space runs around
        them; such a text is one piece."""
        whole = [i for i, text in enumerate(texts) if _UNCUT.search(text)]
        given = list(texts)
        for i in whole:
            given[i] = ""
        cut = pc.split_pattern(pa.array(given, pa.large_string()), " ")
        coded = cut.values.dictionary_encode()
        code, begin = coded.indices.to_numpy().astype(np.int64), cut.offsets.to_numpy()[:-1]
        firsts = coded.dictionary.take(pa.array(code[begin])).to_pylist()  # the first of a text has no space before it
        for i in whole:
            firsts[i] = texts[i]
        n = len(coded.dictionary)
        space, none = (pa.scalar(x, pa.large_string()) for x in (" ", ""))
        names = pa.concat_arrays([pc.binary_join_element_wise(space, coded.dictionary, none), pa.array(firsts, pa.large_string())])
        code[begin] = np.arange(n, n + len(firsts))
        kept = np.ones(len(code), bool)
        kept[begin] = [text != "" for text in firsts]
        place = self._places(names)
        if len(self.names) > CACHE_PIECES:
            used, met = np.unique(place[place >= 0], return_inverse=True)
            place[place >= 0] = met
            self._keep_latest(used)
        missing = (place < 0) & pc.not_equal(names, none).to_numpy(zero_copy_only=False)
        new = names.filter(pa.array(missing)).dictionary_encode()
        if len(new):
            place[missing] = self._learn(new.dictionary)[new.indices.to_numpy()]
        counts = np.diff(np.append(begin, len(code))) - ~kept[begin]
        return self.ids.joined(place[code[kept]], counts)

    def rows(self, texts: list[str]) -> tuple[Lists, pa.Array, list[bytes]]:
        """Of each text the ids, the ids joined by a space, and the bytes that the ids decode to."""
        ids = self.ids_of(texts)
        return ids, self.tables.written(ids), self.tables.decode(ids)


def _slices(batch: pa.RecordBatch, chars: int) -> Iterator[tuple[pa.Array, list[str]]]:
    """Keys and texts of a batch, about so many characters at a time."""
    texts, begin, size = [], 0, 0
    for at, text in enumerate(batch.column(1), 1):
        texts.append(text.as_py() or "")
        size += len(texts[-1])
        if size >= chars or at == batch.num_rows:
            yield batch.column(0).slice(begin, at - begin), texts
            texts, begin, size = [], at, 0


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = True, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256), with keep also (ids, decoded), for every row of docs."""
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary(ranks_path))
    kind = docs.schema[id_col].dataType.simpleString()

    def digests(values: list) -> pa.Array:
        return pa.array([hashlib.sha256(v).hexdigest() for v in values], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for batch in batches:
            coder = coder or Coder(shared.value, pattern)
            for keys, texts in _slices(batch, slice_chars):
                ids, written, decoded = coder.rows(texts)
                columns = [keys, pa.array(ids.size, pa.int64()), digests([w.as_buffer() for w in written]), digests(decoded)]
                if keep:
                    ends = np.concatenate([[0], np.cumsum(ids.size)]).astype(np.int32)
                    columns += [pa.ListArray.from_arrays(ends, pa.array(ids.flat, pa.int32())), pa.array(decoded, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names)
                del ids, written, decoded, columns
                give_back_memory()
        if coder:
            coder.tables.db.close()
        give_back_memory()

    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"] + (["ids", "decoded"] if keep else [])
    ddl = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded binary" if keep else "")
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, ddl)


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded) of any rows of id arrays; a null array decodes to nothing."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary(ranks_path))
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = None
        for batch in batches:
            tables = tables or Tables(shared.value)
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                own = [np.array(ids or [], np.int64) for ids in part.column(1).to_pylist()]
                raw = tables.decode(Lists(np.concatenate(own), np.fromiter(map(len, own), np.int64, len(own))))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(raw, pa.binary())], ["id", "decoded"])

    return encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, decoded binary")


def op8(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return encode(docs, ranks, public_tokenizers.PATTERN, keep=False).withColumnRenamed("id", "doc_id")
