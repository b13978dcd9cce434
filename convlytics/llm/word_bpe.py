"""Token ids of a word-level BPE vocabulary, remembered per blank-separated chunk.

The vocabulary's pre-tokenizer never joins characters across white space and splits letters
from the punctuation behind them, so the ids of a text are the ids of its chunks in turn, and
those of ``word...`` are the ids of the word and of the dots.  Plain words that are new in a
batch are merged in one call: the vocabulary's ids are the ranks of its merges, so a byte pair
encoder over the same ranks, with a zero byte for the end of a word, gives the same ids.
"""

from __future__ import annotations

import re

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: Bytes of chunks and ids that a Python worker remembers, in two generations; an entry takes some 200 bytes besides.
MOST_BYTES, _ENTRY_BYTES = 48 << 20, 200
_END_OF_WORD = "</w>"
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Up to U+024F the letters are the same in every version of Unicode; only U+0130 has a longer lower case.
_PLAIN_WORD = re.compile("[A-Za-zª-įı-ɏ]{1,64}")


def _bytes_of_characters() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the rest from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    return {**{chr(b): b for b in shown}, **{chr(256 + i): b for i, b in enumerate(hidden)}}


_loaded: dict[tuple[str, bool], ChunkIds] = {}


class ChunkIds:
    """Chunks and their ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, added_tokens: bool = False):
        self.known: dict[str, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        # Without added tokens, their strings in a text are ordinary text; with them, one id as by default.
        self.tokenizer.encode_special_tokens = not added_tokens
        byte_of = _bytes_of_characters()
        ranks = {}
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            end = token.endswith(_END_OF_WORD)
            ranks[bytes(byte_of[c] for c in (token.removesuffix(_END_OF_WORD) if end else token)) + b"\0" * end] = i
        self.ends = np.zeros(max(ranks.values()) + 1, bool)
        self.ends[[i for token, i in ranks.items() if token.endswith(b"\0") and len(token) > 1]] = True
        self.merger = tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})
        # The encoder takes a whole word that has a rank at once; where merges lead elsewhere, they count.
        plain = [t[:-1].decode() for t in ranks if t.endswith(b"\0") and _PLAIN_WORD.fullmatch(t[:-1].decode(errors="replace"))]
        plain = [w for w in plain if w.isalpha()]
        for word, ids in zip(plain, self._split(self._ids(" ".join(plain)), len(plain)), strict=True):
            if len(ids) > 4:
                self.known[word] = ids
        self.fixed, self.old, self.bytes = dict(self.known), {}, 0

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _split(self, ids: np.ndarray, words: int) -> list[bytes]:
        """The ids of several words, cut behind the last token of each."""
        cuts = [0, *((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()]
        if len(cuts) != words + 1:
            raise ValueError("the vocabulary doesn't mark the last token of each word")
        data = ids.tobytes()
        return [data[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]

    def _learn(self, chunks: set[str]) -> None:
        known, words, parts = self.known, set(), []
        for chunk in chunks:
            word = chunk.rstrip(_MARKS)
            if _PLAIN_WORD.fullmatch(word) and word.isalpha():
                marks = chunk[len(word) :]
                if word not in known:
                    words.add(word)
                if marks:
                    parts.append((chunk, word, marks))
                    if marks not in known:
                        known[marks] = self._ids(marks).tobytes()
            else:
                known[chunk] = self._ids(chunk).tobytes()
        if words:
            ids = np.array(self.merger.encode_ordinary("\0".join(words).lower() + "\0"), "<u4")
            known.update(zip(words, self._split(ids, len(words)), strict=True))
        for chunk, word, marks in parts:
            known[chunk] = known[word] + known[marks]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; NULL and empty texts have none."""
        chunks = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") if t else [] for t in texts]
        needed = set().union(*chunks)
        if self.bytes > MOST_BYTES // 2:  # what comes again before the next change of generation stays
            self.old, self.known, self.bytes = self.known, dict(self.fixed), 0
        missing = needed.difference(self.known)
        again = missing.intersection(self.old)
        self.known.update(zip(again, map(self.old.__getitem__, again), strict=True))
        self._learn(missing - again)
        self.bytes += sum(map(len, missing)) * 2 + len(missing) * _ENTRY_BYTES
        return [b"".join(map(self.known.__getitem__, some)) for some in chunks]


def chunk_ids(path: str, added_tokens: bool = False) -> ChunkIds:
    """The vocabulary of this worker, loaded once."""
    key = path, added_tokens
    if key not in _loaded:
        _loaded[key] = ChunkIds(path, added_tokens)
    return _loaded[key]
