"""Tokenizing with the public tokenizer files, with a bounded cache of pieces of text.

Tokenizing a word costs some microseconds and a corpus repeats its words, so a text is cut at places
where the tokenizer never joins what stands on both sides, and ids of the pieces are kept in a bounded
cache.  Texts for which the cut isn't proven to be exact are encoded whole.  So are texts that hold the
content of a token added to the file, such as ``<|endoftext|>``: the library gives it the token's own id.
"""

from __future__ import annotations

import os
import re
import string
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces of text that the cache holds, for each Python worker, before it starts anew.
CACHE_PIECES = 1_000_000
#: Bytes of UTF-8 of the longest piece that is found by numbers; longer ones are kept by their texts.
KEY_BYTES = 23
#: New pieces that are encoded in one text.
TOGETHER = 512
#: Characters that may mark the ends of pieces.
_MARKS = "¤¦§¶¬±†‡•®©"
#: Other white space than the six ASCII characters: tokenizers differ on it, such texts are not cut.
_OTHER = r"\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _bytes(chars: str) -> np.ndarray:
    """For each byte, whether it is one of the ASCII characters."""
    found = np.zeros(256, bool)
    found[[*chars.encode("ascii")]] = True
    return found


_SPACE, _LETTER = _bytes(" \t\n\v\f\r"), _bytes(string.ascii_letters)
#: Marks that are never in one token with a letter before them.  An apostrophe isn't among them, for it may start a
#: token with letters.
_MARK = _bytes(".,;:!?*&%#$|()[]")
#: Second bytes of the letters from U+00C0 to U+00FF, whose first byte is 0xC3.
_LATIN = np.zeros(256, bool)
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False  # the signs of multiplication and division
#: The lowest bytes of a number.
_LOWEST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _grown(a: np.ndarray, n: int) -> np.ndarray:
    """The array with room for n elements, doubled if need be."""
    return a if n <= len(a) else np.concatenate([a, np.zeros((max(n, 2 * len(a)) - len(a), *a.shape[1:]), a.dtype)])


def _buffers(column: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the texts, from 0 on, and their bytes."""
    offsets = np.frombuffer(column.buffers()[1] or bytes(4), np.int32)[column.offset :][: len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return offsets - offsets[0], data


def _keys(pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Three numbers that hold a piece's bytes and their number, for pieces up to ``KEY_BYTES``; which ones are longer."""
    offsets, data = _buffers(pieces)
    begin, size = offsets[:-1, None], np.diff(offsets)
    at_each = np.ndarray(len(data) + 17, "<u8", np.concatenate([data, np.zeros(24, np.uint8)]), strides=(1,))
    first = np.array([0, 8, 16])
    keys = at_each[begin + first] & _LOWEST[np.clip(size[:, None] - first, 0, 8)]
    keys[:, 2] = keys[:, 2] & _LOWEST[7] | size.astype(np.uint64) << np.uint64(56)
    return keys, size > KEY_BYTES


def _hashes(keys: np.ndarray) -> np.ndarray:
    h = keys[:, 0] * np.uint64(0x9E3779B97F4A7C15)
    for k in (1, 2):
        h = (h ^ h >> np.uint64(29)) + keys[:, k]
        h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


class CachedTokenizer:
    """Ids of texts by the tokenizer in a file of the ``tokenizers`` library, no special tokens added.

    New pieces are encoded many at a time.  Where the tokenizer keeps white space, words with one space
    before them stand one after another, and the tokens that start with a space tell them apart.  Others
    have a mark between them: a character that has one id of its own there.  Pieces that hold the mark,
    or that could touch it, are encoded alone.

    Most pieces are short enough to be numbers.  They are found by a sorted array of hashes, and what is found is
    compared; of two pieces with one hash, the second is encoded anew each time.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Contents of added tokens, and those in other case, which a piece may turn into the former.
        self.added = "|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
        self.whole = f"[{_OTHER}]|(?i:{self.added})" if self.added else f"[{_OTHER}]"
        #: The tokenizer normalizes white space and upper case away: pieces hold no white space, and no
        #: upper case in ASCII, which meets the same normal forms.
        self.drops_space = self.tokenizer.normalizer is not None
        self.mark, self.mark_id = next((c, ids[0]) for c in _MARKS if len(ids := self._ids([f" {c}"])[0]) == 1)
        #: Ids of tokens that start with a space, which the byte-level alphabet writes as this letter.
        size = self.tokenizer.get_vocab_size()
        self.opens = np.fromiter(((self.tokenizer.id_to_token(i) or "").startswith("Ġ") for i in range(size)), bool, size)
        self._reset()

    def _reset(self) -> None:
        self.count = self.used = 0
        self.pool = np.zeros(1 << 16, np.uint32)
        self.begin, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.keys = np.zeros((1 << 16, 3), np.uint64)
        #: Hashes in order, and the places of the pieces.
        self.hashes, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        #: Places of longer pieces.
        self.long: dict[str, int] = {}

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the pieces in an order of their own, that order, and the number of ids of each piece."""
        no = pa.array(np.zeros(len(pieces), bool))
        added = pc.match_substring_regex(pieces, self.added) if self.added else no
        apart = pc.invert(pc.or_(added, pc.match_substring(pieces, self.mark)))
        if self.drops_space:
            spaced, joined = no, apart
        else:
            spaced = pc.and_not(pc.match_substring_regex(pieces, rf"^ [^ \t-\r{_OTHER}]+$"), added)
            opened = pc.match_substring_regex(pieces, rf"(?s)^(\pL|[ \t-\r].*[^ \t-\r{_OTHER}])")
            joined = pc.and_(pc.and_not(apart, spaced), opened)
        alone = [np.flatnonzero(pc.invert(pc.or_(spaced, joined)).to_numpy(zero_copy_only=False))]
        order, parts, sizes = [], [], []
        between = f" {self.mark} " if self.drops_space else f" {self.mark}"
        for group, mark in ((spaced, ""), (joined, between)):
            which = np.flatnonzero(group.to_numpy(zero_copy_only=False))
            begins = np.append(np.arange(0, len(which), TOGETHER), len(which))
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pieces.take(pa.array(which))), mark)
            for k, text in zip(begins.tolist(), texts.to_pylist(), strict=False):
                some = which[k : k + TOGETHER]
                ids = np.array(self._ids([text])[0], dtype=np.uint32)
                if mark:
                    cut = np.flatnonzero(ids == self.mark_id)
                    size = np.diff(np.concatenate([[-1], cut, [len(ids)]])) - 1
                    ids = ids[ids != self.mark_id]
                else:
                    size = np.diff(np.append(np.flatnonzero(self.opens[ids]), len(ids)))
                if len(size) != len(some) or size.sum() != len(ids):
                    alone.append(some)
                    continue
                order.append(some)
                parts.append(ids)
                sizes.append(size)
        rest = np.concatenate(alone)
        for ids in self._ids(pieces.take(pa.array(rest)).to_pylist()) if len(rest) else []:
            parts.append(np.array(ids, dtype=np.uint32))
            sizes.append(np.array([len(ids)]))
        return np.concatenate(parts), np.concatenate([*order, rest]), np.concatenate(sizes)

    def _learn(self, pieces: pa.StringArray, keys: np.ndarray, long: np.ndarray) -> np.ndarray:
        """Puts pieces that aren't in the cache into it: their places."""
        ids, order, size = self._encode(pieces)
        n, total = len(pieces), self.count + len(pieces)
        self.pool = _grown(self.pool, self.used + len(ids))
        self.begin, self.size, self.keys = _grown(self.begin, total), _grown(self.size, total), _grown(self.keys, total)
        self.pool[self.used : self.used + len(ids)] = ids
        places = np.empty(n, np.int64)
        places[order] = np.arange(self.count, total)
        self.size[self.count : total] = size
        self.begin[self.count : total] = self.used + np.cumsum(size) - size
        self.keys[places] = keys
        self.count, self.used = total, self.used + len(ids)
        self.long.update(zip(pieces.filter(pa.array(long)).to_pylist(), places[long].tolist(), strict=True))
        hashes, short = _hashes(keys[~long]), places[~long]
        by_hash = np.argsort(hashes)
        to = np.searchsorted(self.hashes, hashes[by_hash])
        self.hashes, self.at = np.insert(self.hashes, to, hashes[by_hash]), np.insert(self.at, to, short[by_hash])
        return places

    def _gather(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces one after another, and where each piece's end."""
        n = self.size[places]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return self.pool[np.arange(total) + np.repeat(self.begin[places] - (ends - n), n)], ends

    def _places(self, pieces: pa.StringArray) -> np.ndarray:
        """Places of pieces in the cache, new ones learnt."""
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary
        keys, long = _keys(distinct)
        found = np.full(len(distinct), -1)
        if len(self.hashes):
            hashes = _hashes(keys)
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            place = self.at[at]
            found = np.where((self.hashes[at] == hashes) & (self.keys[place] == keys).all(axis=1), place, -1)
        if long.any():
            found[long] = [self.long.get(p, -1) for p in distinct.filter(pa.array(long)).to_pylist()]
        if len(new := np.flatnonzero(found < 0)):
            found[new] = self._learn(distinct.take(pa.array(new)), keys[new], long[new])
        return found[coded.indices.to_numpy()]

    def pieces(self, texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
        """The texts cut where tokens never cross, and the number of pieces up to each text's end.

        A piece is a word, with the white space before it unless the tokenizer drops that, or marks behind a letter
        and what follows them.
        """
        whole = pc.match_substring_regex(texts, self.whole)
        if self.drops_space:
            texts = pc.if_else(whole, texts, pc.ascii_lower(texts))
        offsets, data = _buffers(texts)
        space = _SPACE[data]
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        marks = np.flatnonzero(_MARK[data])
        marks = marks[marks > 1]
        begins[marks] = _LETTER[data[marks - 1]] | (data[marks - 2] == 0xC3) & _LATIN[data[marks - 1]]
        if pc.any(whole).as_py():
            inside = np.repeat(whole.to_numpy(zero_copy_only=False), np.diff(offsets))
            space &= ~inside
            begins &= ~inside
        begins[offsets[:-1][offsets[:-1] < len(data)]] = True
        at = np.flatnonzero(begins)
        ends = np.searchsorted(at, offsets[1:])
        at = np.append(at, len(data))
        if self.drops_space:
            sizes = np.diff(at) - np.add.reduceat(space, at[:-1], dtype=np.int64)
            at, data = np.append(0, np.cumsum(sizes)), data[~space]
        return pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)), ends

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and the number of ids of each text."""
        if self.count > CACHE_PIECES or self.used > 8 * CACHE_PIECES:
            self._reset()
        cut, text_ends = self.pieces(pa.array(texts, pa.string()))
        ids, ends = self._gather(self._places(cut))
        return ids, np.diff(np.append(0, ends)[text_ends], prepend=0)


@lru_cache(maxsize=4)
def tokenizer(path: str) -> CachedTokenizer:
    """One tokenizer for each Python worker and file."""
    return CachedTokenizer(path)


def text_batches(texts: list[str], chars: int = 2_000_000):
    """Slices of a list of texts with about so many characters each, one text at least."""
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > chars:
            yield slice(begin, i)
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield slice(begin, len(texts))
