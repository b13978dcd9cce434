"""Byte-level BPE as a lazily determinised transducer, and streaming UTF-8 decoding.

A sequence of tokens is the BPE encoding of its bytes exactly if each token encodes to itself
and each pair of neighbours does.  So after every byte there is one last token, found among the
tokens that end there by asking whether it follows the last token at its start.  A state of the
transducer holds only what later bytes can still use: the starts of tokens that are not
complete (never further back than the longest token), each with the tokens since the last ones
on which all starts agree.  Those that all agree on are emitted.  States and transitions come
into being when a text first needs them, and the table starts afresh when it is full.
"""

from __future__ import annotations

import array
import base64
import gc
import hashlib
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlytics.llm.common import in_pieces, map_arrow

#: States, remembered pairs and remembered pieces of one Python worker.
MOST_STATES, MOST_PAIRS, MOST_PIECES = 150_000, 400_000, 600_000
_PIECE_BYTES = 4 << 20
_NEVER = 1 << 60


class _State:
    __slots__ = ("end", "live", "next", "suffix")

    def __init__(self, suffix: bytes, live: tuple):
        #: Bytes from the earliest live start; (node of the bytes since, last token, pending tokens) of each start.
        self.suffix, self.live = suffix, live
        self.end = live[-1][2]  # what is emitted if the piece ends here
        self.next: dict[int, tuple[_State, tuple[int, ...]]] = {}


class Transducer:
    """Encodes pieces of bytes by the ranks of a vocabulary."""

    def __init__(self, ranks: dict[bytes, int], most_states: int = MOST_STATES):
        self.ranks, self.most_states = ranks, most_states
        self.bytes_of = {r: b for b, r in ranks.items()}
        #: The trie of the tokens: the node that follows a node (high bits) on a byte (low 8 bits).
        self.child: dict[int, int] = {}
        self.token_at, self.depth, self.grows = array.array("q", [-1]), array.array("l", [0]), bytearray(1)
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                edge = node << 8 | byte
                if edge not in self.child:
                    self.child[edge] = len(self.depth)
                    self.token_at.append(-1)
                    self.depth.append(self.depth[node] + 1)
                    self.grows[node] = 1
                    self.grows.append(0)
                node = self.child[edge]
            self.token_at[node] = rank
        self.pairs: dict[int, bool] = {}
        self.traces: dict[int, tuple | None] = {}
        self.states: dict[tuple, _State] = {}
        self._afresh()

    def _afresh(self) -> None:
        for state in self.states.values():  # states refer to each other: so they go at once
            state.next.clear()
        self.states = {}
        self.start = self._state(b"", ((0, -1, ()),))

    def _state(self, suffix: bytes, live: tuple) -> _State:
        found = self.states.get(live)  # the node of the earliest start says what the suffix is
        if found is None:
            found = self.states[live] = _State(suffix, live)
        return found

    def _trace(self, token: int) -> tuple:
        """How plain BPE merges the token's bytes: (rank of the next merge, first part, last part) over time.

        The list ends with a rank that nothing reaches; None if the merges don't end in the token.
        """
        if token not in self.traces:
            data, trace = self.bytes_of[token], []
            parts = [data[i : i + 1] for i in range(len(data))]
            while len(parts) > 1:
                rank, at = min((self.ranks.get(parts[i] + parts[i + 1], _NEVER), i) for i in range(len(parts) - 1))
                if rank == _NEVER:
                    break
                trace.append((rank, parts[0], parts[-1]))
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.traces[token] = (*trace, (_NEVER, data, data)) if parts == [data] else None
        return self.traces[token]

    def _follows(self, last: int, token: int) -> bool:
        """Whether the token encodes to itself and no merge would cross the border between the two: their
        merges run side by side, by rank and then from the left, and at each moment the pair at the border
        must come later."""
        right = self._trace(token)
        if last < 0 or right is None:
            return right is not None
        left, i, j = self._trace(last), 0, 0
        while True:
            (a, _, end), (b, first, _) = left[i], right[j]
            across = self.ranks.get(end + first, _NEVER)
            if across < a and across <= b:
                return False
            if a == b == _NEVER:
                return True
            if a <= b:
                i += 1
            else:
                j += 1

    def step(self, state: _State, byte: int) -> tuple[_State, tuple[int, ...]]:
        """The transition on ``byte``: made once, then looked up in ``state.next``."""
        child, pairs, live, ended = self.child, self.pairs, [], None
        for node, last, pending in state.live:
            node = child.get(node << 8 | byte)
            if node is None:
                continue
            if ended is None:
                token = self.token_at[node]
                if token >= 0:
                    pair = last << 32 | token
                    follows = pairs.get(pair)
                    if follows is None:
                        if len(pairs) >= MOST_PAIRS:
                            pairs.clear()
                        follows = pairs[pair] = self._follows(last, token)
                    if follows:
                        ended = (0, token, (*pending, token))
            if self.grows[node]:
                live.append((node, last, pending))
        live.append(ended)
        emitted = live[0][2]
        if emitted:
            for _, _, pending in live:
                while emitted and pending[: len(emitted)] != emitted:
                    emitted = emitted[:-1]
                if not emitted:
                    break
            else:
                live = [(node, last, pending[len(emitted) :]) for node, last, pending in live]
        if len(self.states) >= self.most_states:
            self._afresh()
        back = self.depth[live[0][0]]
        made = self._state((state.suffix + bytes((byte,)))[-back:] if back else b"", tuple(live))
        state.next[byte] = made, emitted
        return made, emitted

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        state, out = self.start, []
        for byte in piece:
            state, emitted = state.next.get(byte) or self.step(state, byte)
            out += emitted
        out += state.end
        return out


class Utf8Machine:
    """Incremental UTF-8: a state is (bytes still to come, least and largest next byte, bytes so far)."""

    START = (0, 0, 0, b"")

    @staticmethod
    def step(state: tuple, byte: int) -> tuple[tuple, str]:
        left, low, high, held = state
        if left:
            if low <= byte <= high:
                held += bytes((byte,))
                if left == 1:
                    return Utf8Machine.START, held.decode()
                return (left - 1, 0x80, 0xBF, held), ""
            after, text = Utf8Machine.step(Utf8Machine.START, byte)
            return after, "�" + text
        if byte < 0x80:
            return state, chr(byte)
        lead = bytes((byte,))
        if 0xC2 <= byte <= 0xDF:
            return (1, 0x80, 0xBF, lead), ""
        if 0xE0 <= byte <= 0xEF:
            return (2, 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF, lead), ""
        if 0xF0 <= byte <= 0xF4:
            return (3, 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF, lead), ""
        return state, "�"


class StreamDecoder:
    """Tokens to text as they come; transitions on whole tokens are remembered."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of = bytes_of
        self.table: dict[tuple, dict[int, tuple[tuple, str]]] = {}
        self.state = Utf8Machine.START

    def feed(self, tokens) -> str:
        state, out = self.state, []
        moves = self.table.setdefault(state, {})
        for token in tokens:
            found = moves.get(token)
            if found is None:
                after, text = state, ""
                for byte in self.bytes_of[token]:
                    after, said = Utf8Machine.step(after, byte)
                    text += said
                found = moves[token] = (after, text)
            out.append(found[1])
            if found[0] is not state:
                state = found[0]
                moves = self.table.setdefault(state, {})
        self.state = state
        return "".join(out)

    def finish(self) -> str:
        """What an unfinished character at the end becomes."""
        left, self.state = self.state[0], Utf8Machine.START
        return "�" if left else ""


class Codec(dict):
    """Pieces of text to their ids (little-endian unsigned 32-bit), by the transducer."""

    def __init__(self, path: str, pattern: str):
        super().__init__()
        self.old: dict[str, bytes] = {}
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.transducer = Transducer(ranks)
        self.decoder = StreamDecoder(self.transducer.bytes_of)
        # Blanks are those of Unicode's White_Space property.
        self.pieces = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        plain = pattern.replace(r"[^\s\p{L}\p{N}]", r"[^ \t-\rA-Za-z0-9]").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]")
        plain = plain.replace(r"\s", r"[ \t-\r]").replace(r"\S", r"[^ \t-\r]")
        #: The same pattern over ASCII, where the standard matcher is quicker.
        self.plain_pieces = self.pieces if r"\p" in plain else re.compile(plain)

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= MOST_PIECES // 2:  # what comes again before the next change of generation stays
            self.old = dict(self)
            self.clear()
        packed = self.old.get(piece)
        if packed is None:
            ids = array.array("I", self.transducer.encode(piece.encode()))
            if sys.byteorder == "big":
                ids.byteswap()
            packed = ids.tobytes()
        if len(piece) <= 64:
            self[piece] = packed
        return packed

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, (self.plain_pieces if text.isascii() else self.pieces).findall(text)))

    def decode(self, packed: bytes) -> str:
        ids = array.array("I")
        ids.frombytes(packed)
        if sys.byteorder == "big":
            ids.byteswap()
        return self.decoder.feed(ids) + self.decoder.finish()


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The codec of this worker, loaded once."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def _mapped(rows: DataFrame, column: str, fn, schema: str) -> DataFrame:
    """``fn`` on each value of ``column`` gives the row's further columns."""
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    types = [kinds[f.split()[1]] for f in schema.split(", ")[1:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Nothing here leaves cycles behind, and looking for them among the states takes a third of the time.
        gc.disable()
        try:
            for piece in in_pieces(batches, column, _PIECE_BYTES):
                found = zip(*(fn(v) for v in piece.column(column).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *(pa.array(c, t) for c, t in zip(found, types, strict=True))], names=names)
        finally:
            gc.enable()

    return map_arrow(rows, run, schema)


def encode_texts(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` (packed) of every whole text; NULL is encoded like an empty text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return _mapped(rows, "text", lambda text: (codec(path, pattern).encode(text or ""),), "doc_id long, ids binary")


def decode_ids(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, text`` of packed ids; bytes that are no UTF-8 become U+FFFD."""
    return _mapped(encoded.select("doc_id", "ids"), "ids", lambda ids: (codec(path, pattern).decode(ids or b""),), "doc_id long, text string")


def round_trips(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every whole text.

    NULL and empty texts have no tokens; the length of a text is not bounded; repeated rows get
    equal results; an empty table gives an empty one; other columns are not read.
    """

    def digests(text: str | None) -> tuple[int, str, str]:
        both = codec(path, pattern)
        ids = both.encode(text or "")
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(both.decode(ids).encode()).hexdigest()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return _mapped(rows, "text", digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
