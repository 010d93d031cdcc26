"""Token ids of whole texts, made by the tokenizers library from the distinct words of a batch.

Both vocabularies here cut a text at white space before any pair of bytes is
merged, so a text's ids are those of its words in order. Words repeat far more
often than texts: each distinct one is encoded once per worker, and ids are put
together by array look-ups. Texts with white space that the cut does not
foresee are encoded as one piece.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of texts handled at a time, and distinct words that a worker remembers (a bound on its memory, not on the words).
BLOCK_BYTES, REMEMBERED = 2 << 20, 500_000

#: Where a word ends before ASCII punctuation the vocabularies cut too, so words and what is stuck to them are remembered apart.
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK[33:48] = _MARK[58:65] = _MARK[91:97] = _MARK[123:127] = True

#: White space beyond space and line feed, as UTF-8: a text that holds any is encoded whole by the byte-level vocabulary.
_ODD_SPACE = re.compile(rb"[\t\x0b-\r\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|[ \n][ \n]|^[ \n]|[ \n]\Z")

#: Pieces that white space or special tokens keep from being glued to others.
_ALONE = re.compile(r"^[^\S \n]|.\s|<\||^\s?$", re.S)


def string_blocks(texts: pa.Array, block_bytes: int = BLOCK_BYTES, block_rows: int = 1 << 30):
    """(first row, texts) in blocks of about ``block_bytes`` and at most ``block_rows`` rows; nulls become empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, min(lo + block_rows, int(np.searchsorted(ends, ends[lo] + block_bytes, "right")) - 1))
        yield lo, texts.slice(lo, hi - lo)
        lo = hi


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a large_string array without nulls, and each text's start (with the end as last)."""
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.empty(0, np.uint8)
    return data[ends[0]:ends[-1]], ends - ends[0]


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """flat[starts[0]:starts[0]+lengths[0]], then the next, … in one array."""
    out_starts = np.cumsum(lengths) - lengths
    total = int(lengths.sum())
    return flat[np.repeat(starts - out_starts, lengths) + np.arange(total)] if total else flat[:0]


class WordEncoder:
    """ids of texts, with ``end`` put after each. ``byte_level``: the vocabulary keeps white space, as part of the word behind it."""

    def __init__(self, path: str, end: int, byte_level: bool, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end, self.byte_level, self.remembered = Tokenizer.from_file(path), end, byte_level, remembered
        self.feed = self._ids(["\n"])[0] if byte_level else self._ids(["\x01"])[0]
        self._forget()

    def _forget(self) -> None:
        self.places: dict[str, int] = {}
        self.flat, self.used = np.empty(1 << 20, np.uint32), 0
        self.starts, self.lengths, self.blocks = np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int64), np.zeros(1 << 16, np.int32)

    def _thin(self) -> None:
        """Leave words that came in more than one block since the last time; all go where these are too many."""
        n = len(self.places)
        kept = np.flatnonzero(self.blocks[:n] > 1)
        if len(kept) > self.remembered * 3 // 4:
            self._forget()
            return
        words = np.array(list(self.places), object)[kept].tolist()
        ids, lengths = gather(self.flat, self.starts[kept], self.lengths[kept]), self.lengths[kept]
        self._forget()
        self._keep(words, ids, lengths)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _keep(self, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.flat[self.used:self.used + len(ids)] = ids
        have = len(self.places)
        while have + len(words) > len(self.starts):
            self.starts, self.lengths = np.concatenate([self.starts, np.empty_like(self.starts)]), np.concatenate([self.lengths, np.empty_like(self.lengths)])
            self.blocks = np.concatenate([self.blocks, np.zeros_like(self.blocks)])
        self.starts[have:have + len(words)] = self.used + np.cumsum(lengths) - lengths
        self.lengths[have:have + len(words)] = lengths
        self.places.update(zip(words, range(have, have + len(words)), strict=True))
        self.used += len(ids)

    def _learn(self, words: list[str]) -> None:
        """Many words in one call, put apart by a separator whose id none of them can hold."""
        if self.byte_level:
            alone = [w for w in words if len(w) > 500 or _ALONE.search(w)]
        else:
            alone = [w for w in words if len(w) > 500 or "\x01" in w or "<|" in w]
        if alone:
            ids = self._ids(alone)
            self._keep(alone, np.concatenate(ids), np.array([len(x) for x in ids]))
            odd = set(alone)
            words = [w for w in words if w not in odd]
        if self.byte_level:
            lines = [w for w in words if w[:1] == "\n"]
            groups = (lines, [w for w in words if w[:1] != "\n"]) if lines else ((), words)
        else:
            groups = ((), words)
        for group, led in zip(groups, (True, False), strict=True):
            for lo in range(0, len(group), 8192):
                part = group[lo:lo + 8192]
                # A word that brings its own line feed keeps it as its first id.
                ids = self._ids(["".join(part) if led else ("\n" if self.byte_level else " \x01 ").join(part)])[0]
                cut = ids == self.feed[0]
                at = np.flatnonzero(cut)
                bounds = np.append(at, len(ids)) if led else np.concatenate([[-1], at, [len(ids)]])
                if len(bounds) != len(part) + 1:
                    raise ValueError("separators were lost in encoding")
                lengths = np.diff(bounds)
                self._keep(part, ids, lengths) if led else self._keep(part, ids[~cut], lengths - 1)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a large_string array without nulls (see ``string_blocks``), and the number of ids of each text."""
        data, starts = raw(texts)
        n = len(starts) - 1
        space = (data == 32) | (data == 10) if self.byte_level else (data == 32) | ((data >= 9) & (data <= 13))
        first = np.zeros(len(data) + 1, bool)
        first[starts] = True
        # A piece begins at a text's start and at each white space; runs of white space go with the word behind them.
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        after = _LETTER[data[:-1]]
        # Letters of two bytes from C3 on, but for the signs for times and divided by.
        after[1:] |= (data[:-2] == 0xC3) & (data[1:-1] != 0x97) & (data[1:-1] != 0xB7)
        begins[1:] |= _MARK[data[1:]] & after
        begins |= first[:-1]
        # Special tokens are found across words, and odd white space only in context: such texts are one piece.
        special = (data[:-1] == 60) & (data[1:] == 124)
        whole = {int(k) for k in np.searchsorted(starts, np.flatnonzero(special), "right") - 1}
        if self.byte_level:
            whole |= {int(k) for k in self._suspects(data, starts) if _ODD_SPACE.search(data[starts[k]:starts[k + 1]].tobytes())}
        for k in whole:
            begins[starts[k] + 1:starts[k + 1]] = False
        pieces = np.append(np.flatnonzero(begins), len(data))
        words = pa.Array.from_buffers(pa.large_string(), len(pieces) - 1, [None, pa.py_buffer(pieces.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.places) > self.remembered:
            self._thin()
        fresh = [w for w in distinct if w not in self.places]
        self._learn(fresh)
        places = np.fromiter((self.places[w] for w in distinct), np.int64, len(distinct))
        self.blocks[places] += 1
        starts_of, lengths_of = self.starts[places], self.lengths[places]
        index = coded.indices.to_numpy(zero_copy_only=False)
        lengths = lengths_of[index]
        # The end id goes behind each text: room for it is made by one more piece per text.
        piece_doc = np.searchsorted(pieces[:-1], starts[1:], "left")
        flat = np.append(self.flat[:self.used], np.uint32(self.end))
        all_starts = np.insert(starts_of[index], piece_doc, self.used)
        all_lengths = np.insert(lengths, piece_doc, 1)
        before = np.concatenate([[0], np.cumsum(lengths)])
        counts = before[piece_doc] - before[np.concatenate([[0], piece_doc[:-1]])] + 1 if n else np.empty(0, np.int64)
        return gather(flat, all_starts, all_lengths), counts

    @staticmethod
    def _suspects(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Texts that may hold white space other than single spaces and line feeds between words."""
        space = (data == 32) | (data == 10)
        odd = (data >= 0x1C) & (data <= 0x1F) | (data == 9) | ((data >= 11) & (data <= 13)) | (data == 0xC2) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3)
        odd[1:] |= space[1:] & space[:-1]
        full = starts[:-1] < starts[1:]
        odd[starts[:-1][full]] |= space[starts[:-1][full]]
        odd[starts[1:][full] - 1] |= space[starts[1:][full] - 1]
        return np.unique(np.searchsorted(starts, np.flatnonzero(odd), "right") - 1)


@lru_cache(maxsize=1)
def worker_encoder(path: str, end: int, byte_level: bool, remembered: int = REMEMBERED) -> WordEncoder:
    """The encoder of this worker process: tasks that it runs one after the other share what was learned."""
    return WordEncoder(path, end, byte_level, remembered)
