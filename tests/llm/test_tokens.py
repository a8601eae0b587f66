"""Token operators against the libraries, byte for byte."""

import base64
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from quire.llm import bpe, packing, token_store, tokens

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")
ODD = list("aB z9'.-!\n\t ") + ["\r", "\x0b", "\x0c", "\x1c", "\x85", "\xa0", "\u1680", "\u2003", "\u2028", "\u3000", "\u200b", "é", "日", "😀", "٣", "\u0301", "'s", "'ll", "  ", "\n\n", " \n", "\n ", "<|endoftext|>", "<|endof"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def ranks():
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}


def odd_texts(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ODD) for _ in range(rnd.randint(0, 30))) for _ in range(n)]


def test_pieces_encode_as_whole_texts_do():
    lib, enc = Tokenizer.from_file(JSON), tokens.PieceEncoder(JSON)
    for seed in range(4):
        texts = odd_texts(1500, seed)
        ids, sizes = enc.encode(pa.array(texts))
        got = [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
        assert got == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]


def test_piece_table_ages_and_forgets(monkeypatch):
    monkeypatch.setattr(tokens, "_MOST_PIECES", 300)
    lib, enc = Tokenizer.from_file(JSON), tokens.PieceEncoder(JSON)
    for k in range(30):
        texts = [f"w{k}x{i} common words y{i % 7}" for i in range(20 + 10 * (k % 3))] + ["z" * 100]
        ids, sizes = enc.encode(pa.array(texts))
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [lib.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(enc.known) <= 300 and enc.n_flat <= len(enc.flat)


def test_pieces_that_share_a_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(tokens, "strings", lambda data, offs: np.zeros(len(offs) - 1, np.uint64))
    monkeypatch.setattr(tokens, "_EQUAL_BYTES", 10)
    lib, enc = Tokenizer.from_file(JSON), tokens.PieceEncoder(JSON)
    for seed in range(3):
        texts = odd_texts(30, seed) + ["ab cd ef", "ba dc fe"]
        ids, sizes = enc.encode(pa.array(texts))
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]


def test_piece_table_is_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(tokens, "_MOST_BYTES", 5000)
    lib, enc = Tokenizer.from_file(JSON), tokens.PieceEncoder(JSON)
    for k in range(20):
        texts = ["日本" * 200 + str(k), f"a few common words {k}", "z" * 300 + str(k)]
        ids, sizes = enc.encode(pa.array(texts))
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [lib.encode(t, add_special_tokens=False).ids for t in texts]
        assert enc.known.n_data <= 5000


def test_a_known_piece_is_not_encoded_again():
    enc = tokens.PieceEncoder(JSON)
    texts = pa.array([" ".join(f"w{i}" for i in range(a, a + 1000)) for a in range(0, 400_000, 1000)])
    first = enc.encode(texts)
    enc._learn = None
    again = enc.encode(texts)
    assert (first[0] == again[0]).all() and (first[1] == again[1]).all()


def test_end_ids_follow_each_text():
    enc = tokens.PieceEncoder(JSON)
    ids, sizes = enc.closed(pa.array(["a b", None, "", "c"]), 7)
    assert sizes.tolist()[1:3] == [1, 1] and (ids[np.cumsum(sizes) - 1] == 7).all() and len(ids) == sizes.sum()
    assert enc.closed(pa.array([], pa.string()), 0)[0].tolist() == []


def test_recursive_bpe_equals_the_library_on_odd_and_long_words():
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks(), special_tokens={})
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(400)) for _ in range(60)]
    texts = odd_texts(1500, 9) + words + ["a" * 40_001, "=" * 3000, "ab" * 5000, "日本" * 700, "".join(words[:20])]
    own = bpe.Bpe(RANKS, P.PATTERN)
    ids, sizes = own.encode(pa.array(texts))
    got = [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
    assert got == [lib.encode_ordinary(t) for t in texts]
    assert own.decode(ids, sizes).to_pylist() == [t.encode() for t in texts]


def test_decoding_reads_the_ids_of_each_document(monkeypatch):
    own = bpe.Bpe(RANKS, P.PATTERN)
    monkeypatch.setattr(bpe, "DECODE_TOKENS", 5)
    ids, sizes = own.encode(pa.array(["one two three four", "", "five six seven eight nine ten eleven"]))
    assert [x.decode() for x in own.decode(ids, sizes).to_pylist()] == ["one two three four", "", "five six seven eight nine ten eleven"]
    swapped = ids.copy()
    swapped[:2] = ids[1::-1]
    assert own.decode(swapped, sizes).to_pylist()[0] == b" twoone three four"


def test_rounds_of_least_rank_are_sound():
    assert bpe.sound(ranks())
    # " ab" ranks below "ab" and is not reached by its own parts.
    assert not bpe.sound({b"a": 0, b"b": 1, b"c": 2, b"bc": 3, b"abc": 4, b"ab": 5, b"aab": 1})


def test_pieces_of_documents_by_brute_force():
    for capacity in (1, 4, 7):
        doc, piece, start, length = packing.cut(np.arange(1, 40), capacity)
        want = []
        for d, n in enumerate(range(1, 40)):
            head = n if n <= capacity else n % capacity or capacity
            want += [(d, 0, 0, head)] + [(d, k + 1, s, capacity) for k, s in enumerate(range(head, n, capacity))]
        assert list(zip(doc.tolist(), piece.tolist(), start.tolist(), length.tolist())) == want
    assert packing.occurrence(np.array([3, 1, 3, 3, 1])).tolist() == [0, 0, 1, 2, 1]


def test_packed_sequences_hold_every_id_once(spark):
    lib = Tokenizer.from_file(JSON)
    rnd = random.Random(7)
    texts = [" ".join(rnd.choice(["ab", "c", "déf", "longer", "x\ny"]) for _ in range(rnd.choice([0, 1, 5, 40, 300, 1500]))) for _ in range(150)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(None, "no id", None, None, None), (900, None, None, None, None), (0, texts[0], "en", "s", 0)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    placed = packing.pack(df, JSON, 256)
    got = placed.collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 256
    for i, t, *_ in rows:
        want = lib.encode(t or "", add_special_tokens=False).ids + [0]
        parts = sorted(by_doc[i], key=lambda r: r["piece"])
        copies = 2 if i == 0 else 1
        flat = [np.frombuffer(r["ids"], "<u4").tolist() for r in parts]
        assert sum(map(len, flat)) == copies * len(want)
        assert sum((x for x in flat[::copies]), []) == want
        assert all(r["length"] == 256 for r in parts if r["piece"]) and all(r["length"] == len(x) for r, x in zip(parts, flat))
    seqs = {r["sequence_id"]: r["ids"] for r in packing.sequences(placed).collect()}
    assert {k: b"".join(bytes(r["ids"]) for r in sorted(v, key=lambda r: r["offset"])) for k, v in by_seq.items()} == {k: bytes(v) for k, v in seqs.items()}
    total = sum(r["length"] for r in got)
    assert -(-total // 256) <= len(by_seq) <= -(-total // 256) + 2


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice(["ab", "c", "dé", "x\ny", "<|endoftext|>"]) for _ in range(rnd.randint(0, 30))) for _ in range(40)] + [None, "", "w " * 6000]
    rows = [(3 * i, t, "en", "s", 0) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    return str(folder), {i: t or "" for i, t, *_ in rows}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op2_query(spark, tables):
    folder, texts = tables
    lib, at = Tokenizer.from_file(JSON), 0
    got = {r["doc_id"]: r for r in token_store.query(spark, folder).collect()}
    assert len(got) == len(texts)
    for i, t in sorted(texts.items()):
        ids = lib.encode(t, add_special_tokens=False).ids + [0]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), crc(ids))
        at += len(ids)


def test_op6_query(spark, tables):
    import hashlib

    folder, texts = tables
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks(), special_tokens={})
    got = {r["doc_id"]: r for r in bpe.query(spark, folder).collect()}
    for i, t in texts.items():
        ids = lib.encode_ordinary(t)
        want = len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == want
    assert len(got) == len(texts)


def test_op10_query(spark, tables):
    folder, texts = tables
    lib, fill = Tokenizer.from_file(JSON), {}
    got = packing.query(spark, folder).collect()
    for r in got:
        ids = (lib.encode(texts[r["doc_id"]], add_special_tokens=False).ids + [0])[r["start"] : r["start"] + r["length"]]
        assert len(ids) == r["length"] and crc(ids) == r["ids_crc32"]
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in fill.values():
        assert [o for o, _ in sorted(parts)] == list(np.cumsum([0] + [n for _, n in sorted(parts)])[:-1])
        assert sum(n for _, n in parts) <= 2048
    total = sum(r["length"] for r in got)
    assert total == sum(len(lib.encode(t, add_special_tokens=False).ids) + 1 for t in texts.values())
    assert len(fill) <= -(-total // 2048) + 1
