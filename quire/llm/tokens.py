"""Token ids of whole texts by a byte-level BPE file of the tokenizers library.

The pre-tokeniser's pattern has places that no match ever crosses: before a space
that a non-space follows, around a lone line feed between non-spaces, and where a
run of ASCII letters or digits ends.  Texts are cut at such places (leaving out a
cut is always right, so only bytes that are certain are looked at).  Pieces
repeat, so each Python worker keeps a bounded table of pieces it has encoded, in
flat arrays: a piece is found by a hash and held against the bytes of the table.
New pieces reach the library joined to longer texts at places of the same kind,
and the ids are dealt back by the byte lengths of their tokens.

The library's added tokens, such as ``<|endoftext|>``, are taken out of a text
before that and give their one id.
"""

from __future__ import annotations

import os
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quire.llm.wordhash import buffers, strings

_MOST_PIECES = 700_000
_MOST_BYTES = 1 << 24
_LONG_PIECE = 64
_BLOCK_PIECES = 1 << 18
_EQUAL_BYTES = 1 << 19
_JOIN = 400
_LETTER, _DIGIT, _PUNCT, _OTHER, _SPACE, _FEED, _DOUBT = range(7)
_LOADED: dict[str, "PieceEncoder"] = {}


def _kinds() -> np.ndarray:
    """What is certain of a character from its first byte alone."""
    kind = np.full(256, _DOUBT, np.uint8)
    kind[0x21:0x7F] = _PUNCT
    kind[0x30:0x3A] = _DIGIT
    kind[0x41:0x5B] = kind[0x61:0x7B] = _LETTER
    kind[0xC3:0xF5] = _OTHER  # a character of several bytes, but no white space:
    kind[0xE1:0xE4] = _DOUBT  # lead bytes that white space has too
    kind[0x20], kind[0x0A] = _SPACE, _FEED
    return kind


_KIND = _kinds()


def cuts(data: np.ndarray) -> np.ndarray:
    """Whether the pattern certainly has a boundary before each byte of a text (the first: True)."""
    k = _KIND[data]
    ink = k <= _OTHER
    cut = np.zeros(len(k), bool)
    cut[:1] = True
    if len(k) < 2:
        return cut
    before, here = k[:-1], k[1:]
    cut[1:-1] = (here[:-1] == _SPACE) & ink[2:]
    cut[1:] |= (before <= _DIGIT) & (here <= _PUNCT) & (before != here)
    # A lone line feed between inked ASCII characters: cut before and after it.
    ascii_ink = k <= _PUNCT
    lone = (here[:-1] == _FEED) & ascii_ink[:-2] & ascii_ink[2:]
    cut[1:-1] |= lone
    cut[2:] |= lone
    return cut


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions of runs, end to end."""
    return np.repeat(start - (np.cumsum(size, dtype=np.int64) - size), size) + np.arange(int(size.sum()))


def _grown(x: np.ndarray, n: int) -> np.ndarray:
    """The array, or a longer one that has room for ``n`` entries."""
    if n <= len(x):
        return x
    out = np.zeros(1 << (n - 1).bit_length(), x.dtype)
    out[: len(x)] = x
    return out


class PieceIndex:
    """Numbers byte strings in the order of their arrival, by open addressing.

    The 64-bit hash only leads to a place: a string is found when its bytes are
    equal, so strings that share a hash are told apart.
    """

    def __init__(self):
        self.slot = np.full(1 << 15, -1, np.int32)
        self.hash = np.zeros(1 << 14, np.uint64)
        self.begin = np.zeros(1 << 14, np.int64)
        self.own = np.zeros(1 << 14, np.int32)
        self.data = np.zeros(1 << 17, np.uint8)
        self.n = self.n_data = 0

    def __len__(self) -> int:
        return self.n

    def find(self, data: np.ndarray, begin: np.ndarray, own: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The numbers of strings that begin there and have so many bytes; -1 for those that are new."""
        found = np.full(len(begin), -1, np.int64)
        last = len(self.slot) - 1
        place = (hashes & np.uint64(last)).astype(np.int64)
        todo = np.arange(len(begin))
        while len(todo):
            entry = self.slot[place]
            alive = entry >= 0
            todo, place, entry = todo[alive], place[alive], entry[alive]
            same = np.flatnonzero((self.hash[entry] == hashes[todo]) & (self.own[entry] == own[todo]))
            same = same[self._equal(entry[same], data, begin[todo[same]])]
            found[todo[same]] = entry[same]
            alive = np.ones(len(todo), bool)
            alive[same] = False
            todo, place = todo[alive], (place[alive] + 1) & last
        return found

    def _equal(self, entry: np.ndarray, data: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Whether the bytes from each place on are those of the entry."""
        out = np.zeros(len(entry), bool)
        edge, a = np.cumsum(self.own[entry], dtype=np.int64), 0
        while a < len(entry):
            upto = edge[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(edge, upto + _EQUAL_BYTES, "right")))
            size = self.own[entry[a:b]]
            equal = self.data[spread(self.begin[entry[a:b]], size)] == data[spread(begin[a:b], size)]
            out[a:b] = np.logical_and.reduceat(equal, edge[a:b] - size - upto)
            a = b
        return out

    def add(self, data: np.ndarray, offs: np.ndarray) -> None:
        """Number strings that are new and differ, end to end with these offsets."""
        n, m = self.n, len(offs) - 1
        self.hash, self.begin, self.own = (_grown(x, n + m) for x in (self.hash, self.begin, self.own))
        self.data = _grown(self.data, self.n_data + len(data))
        self.data[self.n_data : self.n_data + len(data)] = data
        self.hash[n : n + m] = strings(data, offs)
        self.begin[n : n + m] = self.n_data + offs[:-1]
        self.own[n : n + m] = np.diff(offs)
        self.n, self.n_data = n + m, self.n_data + len(data)
        if 2 * self.n > len(self.slot):
            self.slot = np.full(1 << (2 * self.n - 1).bit_length(), -1, np.int32)
            n = 0
        self._place(np.arange(n, self.n, dtype=np.int32))

    def _place(self, todo: np.ndarray) -> None:
        last = len(self.slot) - 1
        place = (self.hash[todo] & np.uint64(last)).astype(np.int64)
        while len(todo):
            free = self.slot[place] < 0
            self.slot[place[free]] = todo[free]
            lost = self.slot[place] != todo  # taken before, or by another of these
            todo, place = todo[lost], (place[lost] + 1) & last

    def keep(self, at: np.ndarray) -> None:
        """Keep these entries alone and number them anew, in their order."""
        own = self.own[at]
        data = self.data[spread(self.begin[at], own)]
        self.n, self.n_data = len(at), len(data)
        self.hash[: self.n], self.own[: self.n] = self.hash[at], own
        self.begin[: self.n] = np.cumsum(own, dtype=np.int64) - own
        self.data[: self.n_data] = data
        self.slot[:] = -1
        self._place(np.arange(self.n, dtype=np.int32))


class PieceTable:
    """Texts to unsigned 32-bit ids by a table of pieces; ``_learn`` encodes what it lacks."""

    #: How many times the pieces of a table and of a block are kept.
    room = 1

    def __init__(self):
        self._forget()

    def _forget(self) -> None:
        self.known = PieceIndex()
        self.flat = np.zeros(1 << 16, np.uint32)
        self.start = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int32)
        self.used = np.zeros(1 << 14, np.int32)
        self.n_flat = self.now = 0

    def _add(self, some: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Put pieces and their ids, end to end, into the table."""
        n, m = len(self.known), len(some)
        self.start, self.size, self.used = (_grown(x, n + m) for x in (self.start, self.size, self.used))
        self.flat = _grown(self.flat, self.n_flat + len(ids))
        self.flat[self.n_flat : self.n_flat + len(ids)] = ids
        self.start[n : n + m] = self.n_flat + np.cumsum(sizes) - sizes
        self.size[n : n + m] = sizes
        self.known.add(*buffers(pa.array(some, pa.large_string())))
        self.n_flat += len(ids)

    def _learn(self, new: list[str], first: np.ndarray, last: np.ndarray, own: np.ndarray) -> None:
        """Add new pieces, given their first two bytes' and last byte's kinds and their lengths in bytes."""
        raise NotImplementedError

    def _age(self) -> None:
        """Keep the half of the table that was used last."""
        n = len(self.known)
        at = np.flatnonzero(self.used[:n] > np.median(self.used[:n])) if n else np.arange(0)
        flat = self._gather(at)
        size = self.size[at]
        self.known.keep(at)
        self.used[: len(at)] = self.used[at]
        self.size[: len(at)], self.start[: len(at)] = size, np.cumsum(size, dtype=np.int64) - size
        self.flat[: len(flat)], self.n_flat = flat, len(flat)

    def _gather(self, at: np.ndarray) -> np.ndarray:
        """The ids of table entries, end to end."""
        return self.flat[spread(self.start[at], self.size[at])]

    def _full(self, more: int, data: int) -> bool:
        return len(self.known) + more > self.room * _MOST_PIECES or self.known.n_data + data > self.room * _MOST_BYTES

    def _block(self, values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, end to end, and the number of ids of each piece."""
        coded = values.dictionary_encode()
        names = coded.dictionary
        data, offs = buffers(names)
        begin, own, hashes = offs[:-1], np.diff(offs), strings(data, offs)
        if self._full(len(own), len(data)):
            self._age()
        entry = self.known.find(data, begin, own, hashes)
        if self._full((entry < 0).sum(), own[entry < 0].sum()):
            self._forget()
            entry[:] = -1
        new = np.flatnonzero(entry < 0)
        if len(new):
            kind = np.append(_KIND[data], np.uint8(_DOUBT))
            first, last = begin[new], offs[1:][new]
            self._learn(names.take(pa.array(new)).to_pylist(), np.stack([kind[first], np.where(last - first > 1, kind[first + 1], _DOUBT)], 1), kind[last - 1], own[new])
            entry[new] = self.known.find(data, first, own[new], hashes[new])
        self.now += 1
        self.used[entry] = self.now
        at = entry[np.asarray(coded.indices)]
        out = self._gather(at), self.size[at]
        # Long pieces hardly ever come again: they are the first to age.
        self.used[entry[own > _LONG_PIECE]] = 0
        return out

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a column of texts, end to end, and their number in each; a null text is empty."""
        data, offs = buffers(column)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(column), np.int64)
        cut = cuts(data)
        cut[offs[:-1][offs[:-1] < len(data)]] = True
        edge = np.append(np.flatnonzero(cut), len(data))
        del cut
        ids, sizes = [], []
        step = self.room * _BLOCK_PIECES
        for a in range(0, len(edge) - 1, step):
            some = edge[a : a + step + 1]
            body = pa.py_buffer(data[some[0] : some[-1]])
            values = pa.Array.from_buffers(pa.large_string(), len(some) - 1, [None, pa.py_buffer((some - some[0]).astype(np.int64)), body])
            i, n = self._block(values)
            ids.append(i)
            sizes.append(n)
        total = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        row = total[np.searchsorted(edge, offs)]
        return np.concatenate(ids), np.diff(row)

    def closed(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, with the end id after each text."""
        ids, sizes = self.encode(column)
        out = np.empty(len(ids) + len(sizes), "<u4")
        stop = np.cumsum(sizes + 1) - 1
        own = np.ones(len(out), bool)
        own[stop] = False
        out[own], out[stop] = ids, end_id
        return out, sizes + 1


class PieceEncoder(PieceTable):
    """Encodes by a file of the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.library = Tokenizer.from_file(path)
        added = sorted((t.content for t in self.library.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        vocabulary = self.library.get_vocab()
        self.bytes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, i in vocabulary.items():
            self.bytes[i] = len(token)

    def _learn(self, new: list[str], first: np.ndarray, last: np.ndarray, own: np.ndarray) -> None:
        """Pieces of a space and a non-space go to the library in one text, those between
        non-spaces with line feeds between them, all others alone."""
        spaced = (first[:, 0] == _SPACE) & (first[:, 1] <= _OTHER)
        inked = (first[:, 0] <= _OTHER) & (last <= _PUNCT)
        for which, between in ((spaced, ""), (inked & ~spaced, "\n")):
            at = np.flatnonzero(which)
            for a in range(0, len(at), 50 * _JOIN):
                some = at[a : a + 50 * _JOIN]
                self._joined([new[i] for i in some.tolist()], own[some], between)
        if alone := [new[i] for i in np.flatnonzero(~(spaced | inked)).tolist()]:
            got = [e.ids for e in self.library.encode_batch_fast(alone, add_special_tokens=False)]
            sizes = np.fromiter(map(len, got), np.int64, len(got))
            self._add(alone, np.fromiter((i for g in got for i in g), np.uint32, int(sizes.sum())), sizes)

    def _joined(self, some: list[str], own: np.ndarray, between: str) -> None:
        texts = [between.join(some[a : a + _JOIN]) for a in range(0, len(some), _JOIN)]
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)])
        gap = np.full(len(some), len(between))
        gap[_JOIN - 1 :: _JOIN] = 0
        gap[-1] = 0
        end = np.cumsum(self.bytes[ids])
        stop = np.cumsum(own + gap)
        low, high = np.searchsorted(end, stop - gap - own, "right"), np.searchsorted(end, stop - gap, "right")
        if end[-1] != stop[-1] or (end[high - 1] != stop - gap).any():
            raise ValueError("a token crosses the boundary of a piece")
        if between:
            inside = np.zeros(len(ids) + 1, np.int64)
            np.add.at(inside, low, 1)
            np.add.at(inside, high, -1)
            ids = ids[np.cumsum(inside[:-1]) > 0]
        self._add(some, ids, high - low)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As in the table, but added tokens give their one id."""
        column = column.fill_null("")
        if self.added is None or not pc.any(pc.match_substring_regex(column, self.added.pattern)).as_py():
            return super().encode(column)
        # Rows with added tokens: their parts and the tokens are rows of their own for a while.
        parts, owner, token = [], [], []
        for row, text in enumerate(column.to_pylist()):
            at = 0
            for found in self.added.finditer(text):
                parts += [text[at : found.start()], ""]
                owner += [row, row]
                token += [-1, self.library.token_to_id(found.group())]
                at = found.end()
            parts.append(text[at:])
            owner.append(row)
            token.append(-1)
        ids, sizes = super().encode(pa.array(parts, pa.large_string()))
        fixed = np.array(token)
        put = np.flatnonzero(fixed >= 0)
        ids = np.insert(ids, (np.cumsum(sizes) - sizes)[put], fixed[put].astype(np.uint32))
        sizes[put] = 1
        return ids, np.bincount(np.array(owner), sizes, len(column)).astype(np.int64)


def encoder(path: str) -> PieceEncoder:
    """This worker's encoder of a tokenizer file."""
    if path not in _LOADED:
        _LOADED[path] = PieceEncoder(path)
    return _LOADED[path]
