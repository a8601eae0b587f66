"""The training-data operators against brute force, round trips and edge cases."""

import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quire.llm import bpe, fingerprints, jaccard, neardup, packing, quality, sharding, store, substring, token_store, tokens, warc
from quire.llm.wordhash import shingle_set, words

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
JSON = P.path("byte_bpe_50k.json")


def corpus(n=60, seed=3):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6))) for _ in range(80)]
    sent = lambda k: " ".join(rnd.choice(vocab) for _ in range(k))
    shared = sent(35)
    out = []
    for i in range(n):
        t = sent(rnd.randint(1, 90))
        if i % 4 == 1 and out:
            t = out[-1]
        if i % 4 == 2 and out:
            w = out[-1].split(" ")
            w[rnd.randrange(len(w))] = "zzz"
            t = " ".join(w)
        if i % 5 == 0:
            t = t + "\n" + shared + " " + sent(5)
        out.append(t)
    return out + ["", "   ", "one", "a  b\n\n c \t d", "x" * 900]


def frame(spark, texts, extra=True):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    if extra:
        rows += [(len(texts), None, None, None, None), (None, "null id here", "en", "s", 1), (0, texts[0], "en", "s", 0)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def test_word_hashes_follow_the_words():
    texts = ["a b\tA", "", None, "  ab ", "é x y"]
    w = words(pa.array(texts), lower=True)
    n = [len(WORD.findall((t or "").encode())) for t in texts]
    assert np.diff(w.rows).tolist() == n
    assert w.hashes[0] == w.hashes[2] and len(set(w.hashes.tolist())) == len(w.hashes) - 1
    assert len(shingle_set(w.hashes[:2], 4)) == 1 and len(shingle_set(w.hashes[:0], 4)) == 0


def test_dac_random_access_and_round_trip():
    ids = np.random.default_rng(0).choice([0, 5, 255, 256, 50256, 65536, 1 << 24, (1 << 32) - 1], 3000).astype(np.uint32)
    codes = token_store.Dac.from_bytes(token_store.Dac.of(ids).to_bytes())
    assert (codes.decode() == ids).all()
    assert all(codes[i] == ids[i] for i in range(0, 3000, 7)) and codes[2999] == ids[2999]
    with pytest.raises(IndexError):
        codes[3000]


def test_token_store(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    texts = corpus(20)
    manifest = token_store.encode(frame(spark, texts), JSON)
    rows = token_store.read(manifest).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None, 0, 0, *range(1, len(texts) + 1)]
    at = 0
    for r in rows:
        text = "null id here" if r["doc_id"] is None else (texts + [None])[r["doc_id"]]
        want = t.encode(text or "", add_special_tokens=False).ids + [0]
        assert r["start"] == at and np.frombuffer(r["ids"], "<u4").tolist() == want
        at += len(want)
    flat = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in rows])
    got = token_store.lookup(manifest, spark.createDataFrame([(0,), (17,), (at - 1,), (at + 5,)], "position long")).collect()
    assert {r["position"]: r["id"] for r in got} == {p: int(flat[p]) for p in (0, 17, at - 1)}


def test_added_tokens_are_one_id_as_in_the_library():
    lib, enc = Tokenizer.from_file(JSON), tokens.PieceEncoder(JSON)
    for text in ("<|endoftext|>", "a  <|endoftext|>  b c", "x<|endoftext|><|endoftext|> y\n \n", "<|endof text|> <|endoftext| >", " \n <|endoftext|>\n  z  "):
        want = lib.encode(text, add_special_tokens=False).ids
        assert enc.encode(pa.array([text]))[0].tolist() == want
    assert 50256 in lib.encode("a<|endoftext|>b", add_special_tokens=False).ids


def test_packing_plan_places_every_piece():
    rnd = random.Random(1)
    for capacity in (7, 64):
        hist = {length: rnd.randint(1, 30) for length in rnd.sample(range(1, capacity + 1), min(capacity, 20))}
        p = packing.plan(hist, capacity)
        fill = {}
        for length, n in hist.items():
            s, o = packing.place(p, np.full(n, length), np.arange(n))
            for a, b in zip(s.tolist(), o.tolist()):
                fill.setdefault(a, []).append((b, length))
        assert len(fill) == p.sequences
        for parts in fill.values():
            at = 0
            for o, length in sorted(parts):
                assert o == at
                at += length
            assert at <= capacity


def test_packing_fills_sequences_with_short_pieces():
    rnd = random.Random(5)
    short = {length: rnd.randint(0, 50) for length in range(1, 512)}
    for hist, capacity, most in (
        ({100: 10_000}, 2048, 500),
        ({1000: 10_000, 10: 10_000}, 2048, 5000),
        (short, 2048, -(-sum(s * n for s, n in short.items()) // 2048)),
    ):
        assert packing.plan(hist, capacity).sequences == most


def test_packing(spark):
    texts = corpus(30) + ["word " * 5000]
    placed = packing.pack(frame(spark, texts), JSON, 256)
    rows = placed.collect()
    total = sum(r["length"] for r in rows)
    assert len(packing.sequences(placed).collect()) <= -(-total // 256) + 2
    long_ = sorted((r["piece"], r["start"], r["length"]) for r in rows if r["doc_id"] == len(texts) - 1)
    assert all(n == 256 for _, _, n in long_[1:]) and long_[0][2] <= 256
    assert [s for _, s, _ in long_] == list(itertools.accumulate([0] + [n for *_, n in long_[:-1]]))


def test_shards_are_even_and_slots_gapless(spark):
    texts = corpus(40) + ["hot copy"] * 60
    out = sharding.shard(frame(spark, texts), 8).collect()
    size = {s: sum(r["size"] for r in out if r["shard"] == s) for s in range(8)}
    biggest = max(r["size"] for r in out)
    assert len(out) == len(texts) + 3 and max(size.values()) - min(size.values()) <= 2 * biggest
    for s in range(8):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))


def test_near_duplicate_vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((40, 16))
    rows = [(i, [float(x) for x in base[i % 40] + 0.05 * (i >= 40) * rng.standard_normal(16)], i % 40 % 3) for i in range(200)]
    rows += [(200, None, 1), (201, [0.0] * 16, 1), (202, [float("nan")] + [1.0] * 15, 1), (203, rows[0][1], None), (204, rows[1][1], 1), (205, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("vector", F.lit("clash"))
    got = {r["vec_id"]: r for r in neardup.near_duplicates(df).collect()}
    v = np.array([np.float32(r[1]) for r in rows[:200]] + [np.float32(rows[1][1])], float)
    lab = np.array([r[2] for r in rows[:200]] + [1])
    ids = [*range(200), 204]
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    link = (u @ u.T >= 0.93) & (lab[:, None] == lab[None])
    np.fill_diagonal(link, False)
    found = sum(got[i]["n_links"] for i in ids)
    assert 0.9 * link.sum() <= found <= link.sum() and link.sum() > 300
    for i in (200, 201, 202, 203, 205):
        assert got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"]


def brute_groups(texts, size, percent):
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = []
    for t in texts:
        w = WORD.findall((t or "").encode().translate(low))
        k = min(size, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in range(len(texts))}


def test_jaccard_groups(spark, monkeypatch):
    texts = corpus(60)
    w = [f"w{i}" for i in range(120)]
    for k in range(70):  # a group of near copies larger than a long list
        texts.append(" ".join(w[:k] + [f"q{k}"] + w[k + 1 :]))
    want = brute_groups(texts, 4, 85)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(frame(spark, texts), 4, 85).collect()}
    assert got.pop(None)[0] == 1 and got.pop(len(texts)) == (0, len(texts))
    assert got == want


def test_forest_of_two_blocks():
    a, b, c = (np.arange(s, s + 20, dtype=np.uint64) for s in (0, 1, 100))
    rule = jaccard.Rule(4, 85)
    assert jaccard.forest([a, c], [b], rule) == [(0, 2)]
    assert jaccard.forest([a, b, c], None, rule) == [(0, 1)]
    assert jaccard.forest([a, b, c], None, rule, np.array([7, 7, 3])) == []


def test_answers_are_derived_from_similar_sets():
    rnd = random.Random(8)
    base = rnd.sample(range(10_000), 200)
    sets = [set(base) ^ set(rnd.sample(range(10_000), 6)) for _ in range(30)] + [set(rnd.sample(range(20_000, 30_000), 50)) for _ in range(5)]
    sets = [np.array(sorted(s), np.uint64) for s in sets]
    got = {i: (both, base) for i, both, base in jaccard.answers(sets, 33)}
    assert sorted(got) == list(range(33))
    for i, (both, _) in got.items():
        assert both.tolist() == [len(np.intersect1d(sets[i], s)) for s in sets]
    assert sum(b >= 0 for _, b in got.values()) == 29  # all similar ones but the first; the others from nothing


def test_blocks_of_index_lists_are_skipped_by_position():
    rnd, rule = random.Random(9), jaccard.Rule(4, 85)
    rows = sorted((t, n, rnd.randrange(rule.prefix(n)), d) for d, (t, n) in enumerate((rnd.randrange(3), rnd.randint(20, 60)) for _ in range(400)))
    run, n, pos, doc = (np.array(c) for c in zip(*rows))
    want = set()
    for x, y in itertools.combinations(range(len(rows)), 2):
        need = -(-85 * (n[x] + n[y]) // 185)
        if run[x] == run[y] and 85 * n[y] <= 100 * n[x] and min(n[x] - pos[x], n[y] - pos[y]) >= need:
            want.add((min(doc[x], doc[y]), max(doc[x], doc[y])))
    got = [p for a, b in jaccard.list_pairs(doc, n, pos, run, rule) for p in zip(a.tolist(), b.tolist())]
    assert len(got) == len(set(got)) and set(got) == want
    _, left, right, skipped = jaccard.list_blocks(n, pos, run, rule)
    blocks = sorted(set(zip(run.tolist(), n.tolist(), pos.tolist())))
    reach = [(a, b) for i, a in enumerate(blocks) for b in blocks[i:] if a[0] == b[0] and 85 * b[1] <= 100 * a[1] and a[1] - a[2] >= -(-85 * (a[1] + b[1]) // 185)]
    assert skipped == len(reach) - len(left) > 400  # of 1,805 meetings, each of them whole


def test_pair_bounds_and_overlaps():
    rnd = random.Random(10)
    sets = [np.unique(np.array([rnd.getrandbits(63) if rnd.random() < 0.3 else k * 7919 << 24 for k in range(rnd.randint(1, 200))], np.uint64)) for _ in range(60)]
    a, b = sets[::2], sets[1::2]
    true = [len(np.intersect1d(x, y)) for x, y in zip(a, b)]
    assert jaccard.overlap([x.tobytes() for x in a], [y.tobytes() for y in b]).tolist() == true
    far = jaccard.apart([jaccard.parity(x).tobytes() for x in a], [jaccard.parity(y).tobytes() for y in b])
    assert all(f <= len(x) + len(y) - 2 * t for f, x, y, t in zip(far, a, b, true)) and far.sum() > 0


def test_jaccard_groups_in_lanes_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "LONG_LIST", 5)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 7)
    monkeypatch.setattr(jaccard, "LANE_SETS", 10)
    rnd = random.Random(11)
    texts = []
    for g in range(3):  # chains and stars of near copies of one template
        w = [f"t{i}" for i in range(60)] + [f"g{g}x{i}" for i in range(40)]
        for k in range(40):
            w = list(w) if k % 2 else w
            v = list(w)
            for _ in range(rnd.randint(0, 3)):
                v[rnd.randrange(100)] = f"q{rnd.randrange(30)}"
            texts.append(" ".join(v))
            if k % 8 == 7:
                w = v
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(frame(spark, texts, extra=False), 4, 85).collect()}
    assert got == brute_groups(texts, 4, 85) and len({c for _, c in got.values()}) < len(texts) / 2


def test_jaccard_of_repeated_and_missing_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(None, a), (None, b), (None, c), (None, c), (5, a), (5, b + " x"), (6, c), (6, c), (7, None), (None, ""), (8, b)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).repartition(3)
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jaccard.join(docs, 4, 85).collect())
    assert got == sorted((str(i), (38 if t and t.endswith(" x") else 37 if t else 0), "7" if i == 7 else "None") for i, t in rows)


def test_bpe_matches_the_library(spark):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = corpus(20) + ["a" * 1500, "ab" * 400 + " é" * 50, "\x1c \x1d x \x85 y", "<|endoftext|>", " \t y"]
    got = bpe.encoded(frame(spark, texts), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert len(got) == len(texts) + 3
    for r in got:
        text = "null id here" if r["doc_id"] is None else (texts + [""])[r["doc_id"]]
        assert np.frombuffer(r["ids"], "<u4").tolist() == lib.encode_ordinary(text) and bytes(r["decoded"]).decode() == text


def test_fingerprints(spark):
    texts = ["a\nb\nc", "a\nb\nd", "\n".join(map(str, range(300))), "\n".join(map(str, range(150, 450))), "", "a\nb\nc", "\n\n"]
    rows = {r["doc_id"]: r for r in fingerprints.compared(frame(spark, texts, extra=False)).collect()}
    sets = [{p for p in t.split("\n") if p} for t in texts]
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for i, t in enumerate(texts):
        nxt = texts[i - 1]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert rows[i]["edited"] == edited and rows[i]["n_chars"] == len(t)
        assert rows[i]["near_next"] == pytest.approx(like(sets[i], sets[i - 1]))
        assert rows[i]["near_edited"] == pytest.approx(like(sets[i], {p for p in edited.split("\n") if p}))
        assert len(rows[i]["gaps"]) == len(sets[i] ^ sets[i - 1])
    assert rows[0]["fingerprint"] == rows[5]["fingerprint"] != rows[1]["fingerprint"]
    assert fingerprints.compared(frame(spark, texts).limit(0)).count() == 0
    assert fingerprints.compared(frame(spark, texts)).count() == len(texts) + 3


def test_fingerprints_alone_give_the_difference(spark):
    a, b = [f"p{i}" for i in range(40)], [f"p{i}" for i in range(37)] + ["new", "newer"]
    df = spark.createDataFrame([("\n".join(a), "\n".join(b))], "a string, b string")
    sides = [fingerprints.code(fingerprints.sketch(fingerprints.paragraphs(F.col(c)))).alias(c) for c in "ab"]
    cells = df.select(*sides, *[F.col(c).alias(f"text_{c}") for c in "ab"]).select("*", *[fingerprints.decoded(F.col(c)).alias(f"cells_{c}") for c in "ab"])
    r = cells.select("text_a", "text_b", fingerprints.peel(fingerprints.subtract(F.col("cells_a"), F.col("cells_b"))).alias("p"), fingerprints.paragraphs(F.col("text_a")).alias("da"), fingerprints.paragraphs(F.col("text_b")).alias("db")).first()
    assert r["p"]["ok"]
    assert {(f["x"], f["c"]) for f in r["p"]["found"]} == {(x, 1) for x in set(r["da"]) - set(r["db"])} | {(x, -1) for x in set(r["db"]) - set(r["da"])}
    assert len(r["p"]["found"]) == 5


def test_fingerprints_of_many_paragraphs_and_repeated_ids(spark):
    many = ["\n".join(f"{x}{i}" for i in range(4000)) for x in "ab"]
    rows = [(1, many[0]), (2, many[1]), (3, "x"), (3, "x"), (3, "y"), (None, "n"), (None, None), (4, "\n".join(["same"] * 70_000))]
    got = sorted((r["doc_id"] or 0, r["text"], r["edited"], round(r["near_next"], 6)) for r in fingerprints.compared(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    order = sorted((i or 0, t or "") for i, t in rows)  # a null id comes before all others here
    want = []
    for k, (i, t) in enumerate(order):
        nxt = order[k - 1][1]
        half = len(t) // 2
        p, q = ({x for x in s.split("\n") if x} for s in (t, nxt))
        want.append((i, t, t[: len(t) - half] + nxt[:half], round(len(p & q) / len(p | q), 6) if p | q else 1.0))
    assert got == sorted(want)


def test_substring_dedup(spark):
    texts = corpus(50)
    seen, want = set(), {}
    for i, t in enumerate(texts):
        w = WORD.findall(t.encode())
        gone = [False] * len(w)
        for p in range(len(w) - 19):
            key = tuple(w[p : p + 20])
            if key in seen:
                gone[p : p + 20] = [True] * 20
            seen.add(key)
        want[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode())
    df = frame(spark, texts, extra=False).withColumn("key", F.lit("clash")).withColumn("h", F.lit("clash"))
    out = substring.deduplicated(df, texts=True).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in out} == want
    assert sum(v[1] > 0 for v in want.values()) > 5
    assert all(r["text"] == texts[r["doc_id"]] for r in out if not r["n_removed"])
    assert all(r["text"].split() == r["kept"].split() for r in out)
    assert substring.deduplicated(frame(spark, texts)).count() == len(texts) + 3


def test_windows_that_share_one_hash_differ_in_the_other():
    with np.errstate(over="ignore"):
        a = np.array([5, 9], np.uint64)
        b = a + np.array([1, -0x9E3779B97F4A7C15 % (1 << 64)], np.uint64)
    (one, check), (same, other) = substring.both(a, 2), substring.both(b, 2)
    assert one == same and check != other


def test_warc_round_trip(spark):
    html = ["", "a", "é" * 5000, "x" * 40000, "a", None, "", "y\r\n0\r\n\r\n"]
    rows = [(i, "http://h/\r\nx" if i else None, t) for i, t in enumerate(html)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    back = warc.read(warc.write(pages, segment=1000, chunk=300))
    for r in back.collect():
        text = (html[r["page_id"]] or "").encode()
        first = min(i for i, t in enumerate(html) if (t or "").encode() == text)
        assert r["digest"] == warc.digest(text)
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first == r["page_id"] else ("revisit", first))
        assert r["payload"] is None if first != r["page_id"] else bytes(r["payload"]) == text
    got = {r["page_id"]: r["payload_bytes"] for r in warc.digests(back).collect()}
    assert got == {i: len((t or "").encode()) for i, t in enumerate(html)}
    parts = warc.read_records(warc.write(pages, segment=1000, chunk=300))
    broken = parts.filter("segment is null or segment <> 2")
    with pytest.raises(Exception, match="segments are missing"):
        warc.reassembled(broken).collect()


def test_warc_keeps_pages_without_an_id_and_repeated_rows(spark):
    rows = [(None, "u", "a" * 5000), (None, "u", "b" * 7000), (None, None, "a" * 5000), (3, "u", "c" * 5000), (3, "u", "c" * 5000), (3, "v", "d" * 5000), (4, "u", "c" * 5000), (None, "u", "s"), (None, "u", "s")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    back = warc.read(warc.write(pages, segment=1000, chunk=300)).collect()
    got = sorted((str(r["page_id"]), "" if r["payload"] is None else bytes(r["payload"]).decode(), str(r["refers_to"])) for r in back)
    assert got == sorted((str(i), "" if i == 4 else t, "3" if i == 4 else "None") for i, _, t in rows)
    ids = [r["record_id"] for r in warc.read_records(warc.write(pages, segment=1000, chunk=300)).collect()]
    assert len(ids) == len(set(ids))


def test_quality_learns_and_scores(spark):
    rnd = random.Random(2)
    good = lambda: " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8))) for _ in range(60)) + "."
    bad = lambda: " | ".join(w.upper() + "!!" for w in good().split())
    rows = [(i, good() if i % 3 else bad(), "en", "s", 0) for i in range(600)] + [(600, None, None, None, None), (601, "", "en", "s", 0), (None, "x", "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(600)] + [(5, None, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.trained(docs, labels)
    out = quality.scored(docs, model).withColumn("held", quality.held_out()).collect()
    assert len(out) == 603 and all(0 <= r["score"] <= 1 for r in out)
    test = [r for r in out if r["held"] and r["doc_id"] is not None and r["doc_id"] < 600]
    assert {r["doc_id"] for r in test} == {i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum((r["score"] >= 0.5) == (r["doc_id"] % 3 > 0) for r in test) / len(test) > 0.95
    assert quality.trained(docs, labels.limit(0)).score(np.zeros((1, len(quality.FEATURES))))[0] == pytest.approx(0.5)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    texts = corpus(40)
    frame(spark, texts, extra=False).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = corpus_pipeline.distinct(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    groups = brute_groups(texts, 5, 80)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, (n, c) in groups.items() if c == i}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_pipeline_keeps_documents_that_share_an_id_or_have_none(spark, tmp_path):
    import corpus_pipeline

    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcde")
    texts = [(None, a), (None, b), (None, b + " more"), (5, a), (6, c), (6, d), (6, d), (7, d), (8, e), (None, None), (9, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts], DOCS)
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.distinct(spark, docs, str(tmp_path)).collect()]
    assert len(kept) == 7
    assert {(5, a), (6, c), (6, d), (8, e), (None, None), (9, None)} < set(kept)
    assert (None, b) in kept or (None, b + " more") in kept


def test_empty_tables(spark):
    docs = frame(spark, ["a"]).limit(0)
    assert token_store.read(token_store.encode(docs, JSON)).count() == 0
    assert packing.pack(docs, JSON).count() == 0
    assert sharding.shard(docs, 8).count() == 0
    assert jaccard.join(docs, 4, 85).count() == 0
    assert substring.deduplicated(docs).count() == 0
    assert bpe.encoded(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0
    assert neardup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    assert warc.read(warc.write(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


def test_a_tidy_write_leaves_no_shuffle_files(spark):
    held = lambda: {f for f in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if f.endswith(".data")}
    df = lambda: spark.range(5000).groupBy((F.col("id") % 50).alias("k")).count()
    before, setting = held(), spark.conf.get(store._TIDY, None)
    tidy = store.written(df(), "tidy", tidy=True)
    assert not held() - before and spark.conf.get(store._TIDY, None) == setting
    assert tidy.count() == 50


def test_a_batch_gives_back_the_memory_that_its_slices_needed():
    import re

    from quire.llm.wordhash import slices

    def held():
        return int(re.search(r"RssAnon:\s+(\d+)", open("/proc/self/status").read())[1]) / 1024

    batch = pa.RecordBatch.from_pydict({"text": ["a b"] * 10})
    before, pins = held(), []
    for _ in slices(batch, "text"):
        some = [bytes(1000) for _ in range(200_000)]
        pins.append(bytes(1000))  # above the rest, so the heap does not shrink by itself
        peak = held()
        del some
    assert peak - before > 150 and held() - before < 60
