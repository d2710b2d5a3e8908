"""Byte-level BPE by recursive SQL, one DuckDB instance per Python worker.

Encoding: a text is cut into pieces by the tokenizer's pattern; a piece that is in the
vocabulary is one token. The bytes of every other piece become token-position rows. A recursive
query joins neighbouring rows with the merge table, finds each word's pair of least rank and
contracts it, leftmost first, until no pair of any word merges. It keeps each row's neighbour and
pair, and touches only the rows about the contraction.

A piece of over ``STRETCH`` bytes is contracted in overlapping stretches, so that neither the passes nor the
memory of a query grow with it. Two stretches that have a token in common (the same bytes at the same place) are joined there.
That is exact: merges never cross what ends up as a boundary, so the tokens between two boundaries of an
encoding are the encoding of their own bytes, and a row of tokens whose neighbours are each
encoded so in some stretch is the encoding of the whole. Where two have no token in common, a stretch from one of the last boundaries
on bridges them, twice as long each time that this fails too.

Decoding: rows (doc, pos, id) join the vocabulary, and an ordered aggregation joins the bytes, in runs of
at most ``CHUNK_TOKENS`` tokens, within one document too.

Defined results: a null text counts as empty, has no ids and decodes to no bytes. A very long text goes through in
runs of pieces; what a worker holds beyond its texts, their ids and bytes is bounded. Rows may
repeat; doc_id is passed through, null included; other columns are ignored. An empty table gives an empty one. Only ids that the vocabulary has can be decoded.
"""

from __future__ import annotations

import base64
import bisect
import itertools
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from larder.llm.common import bound_batches, release_memory

#: Characters (encoding) and tokens (decoding) taken at once, bytes of pieces in one query, bytes of pieces remembered by a worker.
CHUNK_CHARS, CHUNK_TOKENS, QUERY_BYTES, CACHE_BYTES = 2_000_000, 200_000, 1_000_000, 32_000_000
#: Pieces of a very long text taken at once, and about what an entry of the cache takes beside its bytes.
CHUNK_PIECES, ENTRY_BYTES = 200_000, 200
#: Bytes of the longest word that a query contracts whole; longer pieces go in stretches of that many, each half over the next.
STRETCH = 64
DUCKDB_MEMORY = "160MB"

_state: dict[str, Codec] = {}

_CONTRACT = """
WITH RECURSIVE step AS (
  SELECT word, idx, tok, nxt, m.id, false AS done FROM start LEFT JOIN merges m ON m.pair = (tok::BIGINT << 32) | nxt
  UNION ALL (
    WITH now AS MATERIALIZED (SELECT word, idx, tok, nxt, id FROM step WHERE NOT done),
    least AS (SELECT word, min((id::BIGINT << 32) | idx) AS best FROM now WHERE id IS NOT NULL GROUP BY word),
    hits AS MATERIALIZED (
      SELECT n.word, (best >> 32)::INT AS made, (best & 4294967295)::INT AS spot, n.nxt AS after
      FROM now n JOIN least ON n.word = least.word AND n.idx = (best & 4294967295) + 1
    )
    SELECT word, idx, tok, nxt, CASE WHEN touched THEN m.id ELSE n.id END, done
    FROM (
      SELECT c.word, CASE WHEN c.idx > spot THEN c.idx - 1 ELSE c.idx END AS idx, CASE WHEN c.idx = spot THEN made ELSE c.tok END AS tok,
        CASE WHEN c.idx = spot THEN after WHEN c.idx = spot - 1 THEN made ELSE c.nxt END AS nxt,
        c.id, coalesce(c.idx = spot OR c.idx = spot - 1, false) AS touched, made IS NULL AS done
      FROM now c LEFT JOIN hits USING (word) WHERE spot IS NULL OR c.idx <> spot + 1
    ) n LEFT JOIN merges m ON m.pair = CASE WHEN touched THEN (tok::BIGINT << 32) | nxt END
  )
)
SELECT word, tok FROM step WHERE done ORDER BY word, idx
"""

_DECODE = "SELECT doc, string_agg(v.piece, '' ORDER BY pos) AS piece FROM ids JOIN vocabulary v ON v.id = ids.id GROUP BY doc"


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a file of base64 tokens and ranks."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


def _latin(pattern: str) -> str:
    """The same pattern with its classes spelled out for texts of code points below 256; the standard module matches it faster."""
    chars = [chr(i) for i in range(256)]
    letters, numbers = ("".join(c for c in chars if unicodedata.category(c)[0] == kind) for kind in "LN")
    space = "".join(f"\\x{ord(c):02x}" for c in chars if c.isspace() and not "\x1c" <= c <= "\x1f")
    pattern = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letters}{numbers}]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]")
    return pattern.replace(r"\S", f"[^{space}]").replace(r"\s", f"[{space}]")


class Codec:
    """Vocabulary, merge table and piece cache of one worker."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex

        self.ranks = ranks = read_ranks(path)
        self.find, self.find_latin = regex.compile(pattern), re.compile(_latin(pattern))
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0
        left, right, made = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    made.append(rank)
        merges = pa.table({"pair": (np.array(left, np.int64) << 32) | np.array(right, np.int64), "id": np.array(made, np.int32)})
        vocabulary = pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "piece": [token.decode("latin-1") for token in ranks]})
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.width = np.zeros(max(ranks.values()) + 1, np.int64)
        self.width[list(ranks.values())] = [len(token) for token in ranks]
        self.tables = {"merges": merges, "vocabulary": vocabulary}
        self._db = None

    @property
    def db(self):  # noqa: ANN202
        """The task's database, made when it is first asked for."""
        import duckdb

        if self._db is None:
            self._db = duckdb.connect(config={"threads": 1, "memory_limit": DUCKDB_MEMORY, "temp_directory": "", "preserve_insertion_order": False})
            for name, rows in self.tables.items():
                self._db.register("rows", rows)
                self._db.execute(f"CREATE TABLE {name} AS SELECT * FROM rows")
                self._db.unregister("rows")
        return self._db

    @classmethod
    def of(cls, path: str, pattern: str) -> Codec:
        key = f"{path}\0{pattern}"
        if key not in _state:
            for old in _state.values():
                old.rest()
            _state.clear()
            _state[key] = cls(path, pattern)
        return _state[key]

    def rest(self) -> None:
        """Forget all pieces and close the database at the end of a task, however it ends: its worker may serve other stages."""
        self.cache, self.older, self.held = {}, {}, 0
        if self._db is not None:
            self._db.close()
            self._db = None
        release_memory()

    def contract(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word; none is empty."""
        out: list[np.ndarray] = []
        at = 0
        while at < len(words):
            start, size = at, 0
            while at < len(words) and (at == start or size + len(words[at]) <= QUERY_BYTES):
                size += len(words[at])
                at += 1
            out += self._query(words[start:at])
        return out

    def _query(self, words: list[bytes]) -> list[np.ndarray]:
        sizes = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(sizes)
        total = int(ends[-1])
        tok = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        last = np.zeros(total, bool)
        last[ends - 1] = True
        idx = np.arange(total, dtype=np.int64) - np.repeat(ends - sizes, sizes)
        self.db.register("start", pa.table({"word": np.repeat(np.arange(len(words), dtype=np.int32), sizes), "idx": idx.astype(np.int32), "tok": tok, "nxt": pa.array(np.append(tok[1:], tok[:1]), mask=last)}))
        out = self.db.execute(_CONTRACT).fetchnumpy()
        self.db.unregister("start")
        return np.split(np.asarray(out["tok"]).astype("<u4"), np.searchsorted(np.asarray(out["word"]), np.arange(1, len(words))))

    def long_piece(self, raw: bytes) -> bytes:
        """The ids of a piece of more than ``STRETCH`` bytes."""
        half, memo = STRETCH // 2, _Stretches(self)
        done = _Joined(self.width)
        for first in range(0, len(raw), QUERY_BYTES // 2):
            places = range(first, min(first + QUERY_BYTES // 2, len(raw)), half)
            memo.add({raw[p : p + STRETCH] for p in places})
            for p in places:
                stop = min(p + STRETCH, len(raw))
                while done.end < stop and not done.joined(p, memo[raw[p:stop]]):
                    size = STRETCH
                    while not ((b := done.boundary(size // 2)) < done.end and done.joined(b, memo[raw[b : b + size]])):
                        size *= 2
        return np.array(done.ids, "<u4").tobytes()

    def learn(self, pieces: set[str]) -> None:
        """Put the ids of pieces that the cache lacks into it."""
        words: list[tuple[str, bytes]] = []
        for piece in pieces:
            raw = piece.encode("utf-8", "replace")
            rank = self.ranks.get(raw)
            if (ids := self.older.get(piece)) is not None:
                self._keep(piece, ids)
            elif rank is not None:
                self._keep(piece, rank.to_bytes(4, "little"))
            elif len(raw) > STRETCH:
                self._keep(piece, self.long_piece(raw))
            else:
                words.append((piece, raw))
        for (piece, _), ids in zip(words, self.contract([raw for _, raw in words]), strict=True):
            self._keep(piece, ids.tobytes())

    def _keep(self, piece: str, ids: bytes) -> None:
        self.cache[piece] = ids
        self.held += ENTRY_BYTES + len(piece) + len(ids)

    def _ids(self, cut: list[list[str]]) -> list[bytes]:
        """The ids of each list of pieces."""
        if self.held > CACHE_BYTES // 2:
            self.older, self.cache, self.held = self.cache, {}, 0
        new: set[str] = set()
        for pieces in cut:
            new.update(pieces)
        new.difference_update(self.cache)
        if new:
            self.learn(new)
        known = self.cache.__getitem__
        return [b"".join(map(known, pieces)) for pieces in cut]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out: dict[int, bytes] = {}
        cut: list[list[str]] = []
        for i, t in enumerate(texts):
            find = self.find_latin if t.isascii() or t and max(t) < "\u0100" else self.find
            if len(t) <= CHUNK_CHARS:
                cut.append(find.findall(t))
                continue
            found, parts = (m[0] for m in find.finditer(t)), []
            while pieces := list(itertools.islice(found, CHUNK_PIECES)):
                parts += self._ids([pieces])
            out[i] = b"".join(parts)
        short = iter(self._ids(cut))
        pa.default_memory_pool().release_unused()
        return [out[i] if i in out else next(short) for i in range(len(texts))]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes that each row of ids stands for."""
        ends = np.cumsum([len(x) // 4 for x in ids])
        tokens, doc = np.frombuffer(b"".join(ids), "<u4").astype(np.int32), np.repeat(np.arange(len(ids), dtype=np.int32), np.diff(ends, prepend=0))
        out: list[list[bytes]] = [[] for _ in ids]
        for s in range(0, len(tokens), CHUNK_TOKENS):
            part = tokens[s : s + CHUNK_TOKENS]
            self.db.register("ids", pa.table({"doc": doc[s : s + CHUNK_TOKENS], "pos": np.arange(len(part), dtype=np.int32), "id": part}))
            for i, piece in self.db.execute(_DECODE).fetchall():
                out[i].append(piece.encode("latin-1"))
            self.db.unregister("ids")
        return [b"".join(x) for x in out]


class _Stretches(dict):
    """Ids of stretches, contracted when they are first asked for; forgets all rather than outgrow its bound."""

    def __init__(self, codec: Codec) -> None:
        super().__init__()
        self.codec = codec

    def __missing__(self, raw: bytes) -> list[int]:
        self.add({raw})
        return self[raw]

    def add(self, words: set[bytes]) -> None:
        if len(self) > QUERY_BYTES // STRETCH:
            self.clear()
        new = sorted(words - self.keys())
        for raw, ids in zip(new, self.codec.contract(new), strict=True):
            self[raw] = ids.tolist()


class _Joined:
    """Tokens of a piece from its start on, and where each ends."""

    def __init__(self, width: np.ndarray) -> None:
        self.width, self.ids, self.ends = width.tolist(), [], [0]

    @property
    def end(self) -> int:
        return self.ends[-1]

    def boundary(self, back: int) -> int:
        """The first boundary of the last ``back`` bytes; the end itself where a token is longer than that."""
        return self.ends[bisect.bisect_left(self.ends, self.ends[-1] - back)]

    def joined(self, start: int, ids: list[int]) -> bool:
        """Whether the tokens of the stretch at ``start`` have been joined at a token that both have."""
        ends, at = [], start
        for i in ids:
            at += self.width[i]
            ends.append(at)
        if not start:
            self.ids, self.ends = list(ids), [0, *ends]
            return True
        there = {e: j for j, e in enumerate(ends)}
        k = len(self.ids)
        while k and self.ends[k - 1] >= start:
            j = there.get(self.ends[k])
            if j is not None and self.ids[k - 1] == ids[j]:
                self.ids[k:], self.ends[k + 1 :] = ids[j + 1 :], ends[j + 1 :]
                return True
            k -= 1
        return False


def _gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[tuple]]:
    """Rows of the batches in runs of about ``most`` characters or bytes in the second column."""
    rows: list[tuple] = []
    size = 0
    for batch in batches:
        for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows.append((key, value))
            size += len(value or "")
            if size >= most:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


def _encoded(path: str, pattern: str, key: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path, pattern)
        try:
            for rows in _gathered(batches, CHUNK_CHARS):
                ids = codec.encode([text or "" for _, text in rows])
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], key), pa.array(ids, pa.binary())], names=["doc_id", "ids"])
        finally:
            codec.rest()

    return run


def _decoded(path: str, pattern: str, key: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path, pattern)
        for rows in _gathered(batches, CHUNK_TOKENS * 4):
            ids = [x or b"" for _, x in rows]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], key), pa.array(codec.decode(ids), pa.binary()), pa.array(ids, pa.binary())], names=["doc_id", "decoded", "ids"])

    return run


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) for every row of ``docs`` (doc_id, text); ids is little-endian uint32."""
    bound_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    key = docs.schema["doc_id"].dataType
    return docs.mapInArrow(_encoded(path, pattern, to_arrow_type(key)), f"doc_id {key.simpleString()}, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, decoded, ids) for every row of ``encoded`` (doc_id, ids)."""
    bound_batches(encoded.sparkSession)
    encoded = encoded.select("doc_id", "ids")
    key = encoded.schema["doc_id"].dataType
    return encoded.mapInArrow(_decoded(path, pattern, to_arrow_type(key)), f"doc_id {key.simpleString()}, decoded binary, ids binary")


def _both(path: str, pattern: str, key: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One worker does both turns, so that an executor holds one codec for each of its tasks.
        encoded = _encoded(path, pattern, key)(batches)
        for batch in encoded:
            rows = batch.to_struct_array().flatten()
            for part in _chunks(batch.column(1), CHUNK_TOKENS * 4):
                yield from _decoded(path, pattern, key)(iter([pa.RecordBatch.from_arrays([r.slice(*part) for r in rows], names=["doc_id", "ids"])]))

    return run


def _chunks(column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """(offset, length) of runs of a binary column of about ``most`` bytes."""
    start = size = 0
    for i, value in enumerate(column):
        size += len(value.as_buffer()) if value.is_valid else 0
        if size >= most:
            yield start, i + 1 - start
            start, size = i + 1, 0
    if start < len(column):
        yield start, len(column) - start


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode and decode every text: doc_id, n_tokens and digests of the ids and of the decoded bytes."""
    bound_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    key = docs.schema["doc_id"].dataType
    both = docs.mapInArrow(_both(path, pattern, to_arrow_type(key)), f"doc_id {key.simpleString()}, decoded binary, ids binary")
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
