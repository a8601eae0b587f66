"""Byte-level BPE encoding and decoding by recursive DuckDB queries.

Each Python worker holds an in-memory DuckDB database with the vocabulary and a
merge table (left id, right id, merged id).  Words, the matches of the pattern,
become token-position rows that name the row after them.  One recursive query
contracts them, whatever their length: in each round every word's leftmost pair
of least rank, and where that pair has more places in the word those too, from the
left and without overlap, until no word has a pair left.  A round
of a word gives what one contraction at a time would, because every pair that a
contraction makes ranks above it: each token of a vocabulary is reached by merges
of lower rank than its own (``sound`` tests that).  Words whose pair has one place,
nearly all, need one join a round.  The query keeps the present row of each
position only, so its memory doesn't grow with its rounds.

Decoding joins the ids of each document to their bytes and aggregates them in
order.

Texts are cut at places that the pattern never crosses (see ``tokens``); each
distinct piece is encoded once per worker, in a table of bounded size.
"""

from __future__ import annotations

import base64
import os
import tempfile
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.tokens import PieceTable, spread
from quire.llm.wordhash import slices

BATCH_BYTES = 450_000
DECODE_TOKENS = 1 << 20
SLICE_BYTES = 1 << 23
_LOADED: dict[tuple[str, str], "Bpe"] = {}

ENCODE = """
WITH RECURSIVE step(place, word, token, next, next_token, merged) USING KEY (place) AS (
    SELECT s.place, s.word, s.token, s.place + 1, s.next_token, m.merged
    FROM start s LEFT JOIN merges m ON m.pair = (s.token::BIGINT << 32) | s.next_token
    UNION
    (WITH live AS MATERIALIZED (
        SELECT place, word, token, next, next_token, merged FROM recurring.step WHERE token >= 0
    ), least AS MATERIALIZED (
        SELECT word, (first >> 32)::INTEGER AS merged, (first & 4294967295)::INTEGER AS place, gone, first = xor(last, 4294967295) AS single
        FROM (
            SELECT word, min((merged::BIGINT << 32) | place) AS first, min((merged::BIGINT << 32) | xor(place, 4294967295)) AS last, arg_min(next, (merged::BIGINT << 32) | place) AS gone
            FROM live WHERE merged IS NOT NULL GROUP BY word
        )
    ), many AS MATERIALIZED (
        SELECT t.place, t.word, t.token, t.next, t.next_token, t.merged, l.merged AS best
        FROM live t JOIN least l ON l.word = t.word AND NOT l.single
    ), runs AS (
        SELECT *, count(*) FILTER (NOT follows) OVER (ORDER BY place) AS run
        FROM (SELECT place, next, merged, coalesce(place = lag(next) OVER (ORDER BY place), false) AS follows FROM many WHERE merged = best)
    ), hits AS MATERIALIZED (
        SELECT place, next AS gone, merged FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY place) AS nth FROM runs) WHERE nth % 2 = 1
    ), changed AS (
        SELECT CASE WHEN t.place = l.gone THEN l.place ELSE t.place END AS place, t.word, CASE WHEN t.place = l.gone THEN l.merged ELSE t.token END AS token,
            t.next, CASE WHEN t.place = l.gone THEN t.next_token ELSE l.merged END AS next_token
        FROM live t JOIN least l ON l.word = t.word AND l.single WHERE t.place = l.gone OR t.next = l.place
        UNION ALL
        SELECT h.place, g.word, h.merged, g.next, coalesce(f.merged, g.next_token)
        FROM hits h JOIN many g ON h.gone = g.place LEFT JOIN hits f ON f.place = g.next
        UNION ALL
        SELECT t.place, t.word, t.token, t.next, h.merged
        FROM many t JOIN hits h ON h.place = t.next ANTI JOIN hits e ON e.gone = t.place
    )
    SELECT c.place, c.word, c.token, c.next, c.next_token, m.merged
    FROM changed c LEFT JOIN merges m ON m.pair = (c.token::BIGINT << 32) | c.next_token
    UNION ALL
    SELECT gone, NULL, -1, NULL, NULL, NULL FROM hits
    UNION ALL
    SELECT gone, NULL, -1, NULL, NULL, NULL FROM least WHERE single
    )
)
SELECT word, token FROM step WHERE token >= 0 ORDER BY place
"""

DECODE = "SELECT i.item, list(v.bytes ORDER BY i.pos) AS bytes FROM ids i JOIN vocabulary v ON v.id = i.token GROUP BY i.item ORDER BY i.item"


class Bpe(PieceTable):
    """Encoder and decoder of one rank file."""

    #: Recursive queries cost the more the fewer words they take.
    room = 2

    def __init__(self, ranks_path: str, pattern: str):
        import duckdb
        import regex

        super().__init__()
        with open(ranks_path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.byte_id = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        spill = os.path.join(tempfile.gettempdir(), f"quire-duckdb-{os.getpid()}")
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "600MB", "temp_directory": spill})
        rows = [(self.ranks[t[:k]] << 32 | self.ranks[t[k:]], r) for t, r in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        pair, merged = zip(*rows)
        self._load("merges", pa.table({"pair": pa.array(pair, pa.int64()), "merged": pa.array(merged, pa.int32())}))
        self._load("vocabulary", pa.table({"id": pa.array(list(self.ranks.values()), pa.int32()), "bytes": pa.array(list(self.ranks), pa.binary())}))

    def _load(self, name: str, table: pa.Table) -> None:
        self.db.register("arriving", table)
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM arriving")
        self.db.unregister("arriving")

    def contracted(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, end to end, and their number in each, by the recursive query."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words), dtype=np.int32), size)
        place = np.arange(len(word), dtype=np.int32) + word  # one place between words stays free
        token = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        after = np.append(token[1:], np.int32(-1))
        after[np.cumsum(size) - 1] = -1
        self._load("start", pa.table({"place": place, "word": word, "token": token, "next_token": after}))
        got = self.db.execute(ENCODE).fetchnumpy()
        return np.asarray(got["token"]).astype(np.uint32), np.bincount(np.asarray(got["word"]), minlength=len(words))

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, end to end, and their number in each; a word that is a token itself is that token."""
        raw = [w.encode() for w in words]
        token = np.fromiter(map(self.ranks.get, raw, repeat(-1)), np.int64, len(raw))
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        rest = np.flatnonzero(token < 0)
        rest = rest[np.argsort(length[rest], kind="stable")]  # words of one batch take about as many rounds
        edge = np.cumsum(length[rest])
        size, flat, at = np.ones(len(raw), np.int64), [token[token >= 0].astype(np.uint32)], 0
        batch = -(-edge[-1] // -(-edge[-1] // BATCH_BYTES)) if len(rest) else 0  # no small batch at the end
        while at < len(rest):
            before = edge[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(edge, before + batch, "right")))
            ids, size[rest[at:to]] = self.contracted([raw[i] for i in rest[at:to].tolist()])
            flat.append(ids)
            at = to
        order = np.concatenate([np.flatnonzero(token >= 0), rest])
        start = np.empty(len(raw), np.int64)
        start[order] = np.cumsum(size[order]) - size[order]
        return np.concatenate(flat)[spread(start, size)], size

    def _learn(self, new: list[str], first: np.ndarray, last: np.ndarray, own: np.ndarray) -> None:
        split = [self.pattern.findall(p) for p in new]
        number = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(split)))}
        ids, size = self.merge(list(number))
        many = np.fromiter(map(len, split), np.int64, len(split))
        word = np.fromiter(map(number.__getitem__, chain.from_iterable(split)), np.int64, int(many.sum()))
        upto = np.concatenate([[0], np.cumsum(size[word])])
        self._add(new, ids[spread((np.cumsum(size) - size)[word], size[word])], np.diff(upto[np.concatenate([[0], np.cumsum(many)])]))

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
        """The bytes of each document from its ids, by ordered aggregation over id rows."""
        item = np.repeat(np.arange(len(sizes)), sizes)
        length, body = np.zeros(len(sizes) + 1, np.int64), []
        for a in range(0, len(ids), DECODE_TOKENS):
            own = item[a : a + DECODE_TOKENS]
            self._load("ids", pa.table({"item": own, "pos": np.arange(len(own), dtype=np.int32), "token": ids[a : a + DECODE_TOKENS].astype(np.int32)}))
            got = self.db.sql(DECODE).to_arrow_table().combine_chunks()
            lists = got.column("bytes").chunk(0)
            data, edge = _bytes(lists.flatten())
            at = edge[np.asarray(lists.offsets) - lists.offsets[0].as_py()]
            length[1 + np.asarray(got.column("item"))] += np.diff(at)
            body.append(data)
        offs = np.cumsum(length)
        flat = np.concatenate(body) if body else np.zeros(0, np.uint8)
        return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offs), pa.py_buffer(flat)])


def sound(ranks: dict[bytes, int]) -> bool:
    """Whether every token comes out of its own bytes by merges that rank no higher than it.

    Then no contraction makes a pair of lower rank than its own: where a token t
    could be made of parts that stand side by side, the merges within t rank no
    higher than t and would have come before.  So a round may take all places of
    the least rank.
    """
    for token, own in ranks.items():
        parts = [token[k : k + 1] for k in range(len(token))]
        while len(parts) > 1:
            r, k = min(((ranks.get(parts[k] + parts[k + 1], 1 << 40), k) for k in range(len(parts) - 1)))
            if r > own:
                return False
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return True


def _bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Data and offsets (from 0) of a binary array without nulls."""
    kind = np.int64 if pa.types.is_large_binary(values.type) else np.int32
    offs = np.frombuffer(values.buffers()[1], kind)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    return np.frombuffer(values.buffers()[2], np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def worker(ranks_path: str, pattern: str) -> Bpe:
    """This worker's encoder of a rank file."""
    if (ranks_path, pattern) not in _LOADED:
        _LOADED[ranks_path, pattern] = Bpe(ranks_path, pattern)
    return _LOADED[ranks_path, pattern]


def encoded(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, ids (little-endian unsigned 32-bit), decoded (bytes of those ids).

    A null or empty text has no ids.  Every row gives a row, repeated ones too;
    other columns are ignored; an empty table gives an empty result.  No special
    tokens: their strings are ordinary text.
    """

    def run(batches):
        bpe = worker(ranks_path, pattern)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                ids, sizes = bpe.encode(part.column(1))
                offs = 4 * np.concatenate([[0], np.cumsum(sizes)])
                coded = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offs), pa.py_buffer(ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([part.column(0), coded.cast(pa.binary()), bpe.decode(ids, sizes).cast(pa.binary())], names=["doc_id", "ids", "decoded"])

    lean = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return lean.mapInArrow(run, "doc_id long, ids binary, decoded binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: every whole text, encoded and decoded."""
    import public_tokenizers as P

    got = encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    return got.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
