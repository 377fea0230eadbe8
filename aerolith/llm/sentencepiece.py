"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives one
left-to-right Viterbi pass.

At each character the automaton moves to the state of the longest piece suffix read so far; its
output links list every piece that ends there, longest first, and each relaxes the best score of
the position.  The result is the segmentation with the highest sum of piece scores (the unigram
reading of the model file; for a BPE model file this is not the merge order's segmentation).
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.llm.common import without

SPACE = "▁"
# Fixed values of the model file's format: field numbers and piece types.
PIECES, NORMALIZER = 1, 3
TEXT, SCORE, TYPE = 1, 2, 3
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
CHARSMAP, DUMMY_PREFIX, REMOVE_EXTRA, ESCAPE = 2, 3, 4, 5
#: What an unknown character costs below the lowest piece score.
UNKNOWN_PENALTY = 10.0
#: Chunks up to this length are remembered (at most MEMO of them a task).
MEMO_CHARS, MEMO = 40, 250_000


def _fields(buf: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol-buffer message."""
    def number(i):
        value = shift = 0
        while True:
            byte = buf[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value, i
    i = 0
    while i < len(buf):
        key, i = number(i)
        kind = key & 7
        if kind == 0:
            value, i = number(i)
        else:
            n, i = number(i) if kind == 2 else ({5: 4, 1: 8}[kind], i)
            value, i = buf[i:i + n], i + n
        yield key >> 3, value


def _chunk_pattern(pieces: list[str]) -> re.Pattern | None:
    """Pattern of the chunks that a best path always divides a text into, None if there are none.

    A path divides wherever no piece joins the two characters: before white space that follows
    something else, and behind a run of letters that no piece has before anything but letters.
    """
    if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces):
        return None
    pairs = {(a, b) for p in pieces for a, b in zip(p, p[1:])}
    letters = {c for p in pieces for c in p if c.isalpha()}
    while joined := {a for a, b in pairs if a in letters and b not in letters}:
        letters -= joined
    if not letters:
        return re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
    own = "".join(sorted(letters))
    return re.compile(f"{SPACE}*[^{SPACE}{own}]*[{own}]+|{SPACE}*[^{SPACE}{own}]+|{SPACE}+")


class PieceModel:
    """Pieces, scores and the automaton of one model file."""

    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        self.dummy_prefix, remove_extra, escape, charsmap = True, True, True, b""
        for field, value in _fields(model):
            if field == PIECES:
                d = dict(_fields(value))
                self.pieces.append(d[TEXT].decode())
                self.scores.append(struct.unpack("<f", d[SCORE])[0] if SCORE in d else 0.0)
                self.types.append(d.get(TYPE, NORMAL))
            elif field == NORMALIZER:
                d = dict(_fields(value))
                charsmap = d.get(CHARSMAP, b"")
                self.dummy_prefix, remove_extra, escape = (bool(d.get(k, 1)) for k in (DUMMY_PREFIX, REMOVE_EXTRA, ESCAPE))
        if charsmap or remove_extra or not escape:
            raise ValueError("only models without a normalisation table that keep and escape white space can be decoded exactly")
        self.unknown = self.types.index(UNKNOWN)
        self.bytes = {int(p[1:-1], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t == BYTE}
        if len(self.bytes) != 256:
            raise ValueError("a model without byte pieces cannot be decoded exactly")
        usable = [i for i, t in enumerate(self.types) if t in (NORMAL, USER_DEFINED, UNUSED) and self.pieces[i]]
        normal = [self.scores[i] for i in usable]
        self.unknown_score = min(normal) - UNKNOWN_PENALTY
        self.usable, self.go = usable, None  # decoding needs no automaton
        self.chunks = _chunk_pattern([self.pieces[i] for i in usable])
        self.memo: dict[str, tuple[int, ...]] = {}
        self.spelled: list[bytes] | None = None

    def _build(self, usable: list[int]) -> None:
        go: list[dict[str, int]] = [{}]
        ends: list[int] = [-1]  # the piece that ends at a state
        for i in usable:
            state = 0
            for ch in self.pieces[i]:
                nxt = go[state].get(ch)
                if nxt is None:
                    nxt = len(go)
                    go[state][ch] = nxt
                    go.append({})
                    ends.append(-1)
                state = nxt
            ends[state] = i
        fail, out = [0] * len(go), [0] * len(go)  # out: the nearest state by failure links that ends a piece
        queue = list(go[0].values())
        for state in queue:  # breadth first: a state's failure state is shallower, so it is done
            for ch, nxt in go[state].items():
                f = fail[state]
                while f and ch not in go[f]:
                    f = fail[f]
                fail[nxt] = go[f].get(ch, 0)
                out[nxt] = fail[nxt] if ends[fail[nxt]] >= 0 else out[fail[nxt]]
                queue.append(nxt)
        # what the output links of a state lead to, longest piece first: (length, score, piece)
        links: list[tuple] = [()] * len(go)
        for state in queue:
            own = ((len(self.pieces[ends[state]]), self.scores[ends[state]], ends[state]),) if ends[state] >= 0 else ()
            links[state] = own + links[out[state]]
        self.go, self.fail, self.links = go, fail, links

    def best_path(self, text: str) -> list[int]:
        """Ids of the best segmentation of an escaped text; ties go to the longer last piece."""
        go, fail, links, low = self.go, self.fail, self.links, float("-inf")
        pieces, unknown = self.pieces, self.unknown
        n = len(text)
        best = [0.0] * (n + 1)
        came = [unknown] * (n + 1)  # the piece that ends here
        state, pos = 0, 0
        for ch in text:
            pos += 1
            nxt = go[state].get(ch)
            while nxt is None and state:
                state = fail[state]
                nxt = go[state].get(ch)
            state = nxt or 0
            top, by, size = low, unknown, 0
            for size, score, piece in links[state]:
                score += best[pos - size]
                if score > top:
                    top, by = score, piece
            if size != 1:  # the shortest piece is longer than the character, which then is unknown
                score = best[pos - 1] + self.unknown_score
                if score > top:
                    top, by = score, unknown
            best[pos], came[pos] = top, by
        ids: list[int] = []
        pos = n
        while pos:
            piece = came[pos]
            if piece == unknown:
                ids.extend(self.bytes[b] for b in reversed(text[pos - 1].encode("utf-8", "surrogatepass")))
                pos -= 1
            else:
                ids.append(piece)
                pos -= len(pieces[piece])
        ids.reverse()
        return ids

    def encode(self, text: str) -> list[int]:
        """Ids of a text; an empty text has none."""
        if not text:
            return []
        escaped = (SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE)
        if self.go is None:
            self._build(self.usable)
        if self.chunks is None:
            return self.best_path(escaped)
        memo, chunks = self.memo, self.chunks.findall(escaped)
        known = list(map(memo.get, chunks))
        if None in known:
            for k, ids in enumerate(known):
                if ids is None:
                    chunk = chunks[k]
                    known[k] = ids = tuple(self.best_path(chunk))
                    if len(chunk) <= MEMO_CHARS and len(memo) < MEMO:
                        memo[chunk] = ids
        return list(chain.from_iterable(known))

    def decode(self, ids: list[int]) -> str:
        if self.spelled is None:
            self.spelled = [bytes([int(p[1:-1], 16)]) if t == BYTE else b"" if t in (CONTROL, UNKNOWN) else p.encode()
                            for p, t in zip(self.pieces, self.types)]
        text = b"".join(map(self.spelled.__getitem__, ids)).decode("utf-8", "surrogatepass").replace(SPACE, " ")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


_MODELS: dict[bytes, PieceModel] = {}


def load(model: bytes) -> PieceModel:
    """The automaton of a model file, built once a Python worker."""
    key = hashlib.sha256(model).digest()
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = PieceModel(model)
    return _MODELS[key]


def forget() -> None:
    """Called when a task ends: an idle worker keeps the automaton, not what it has remembered."""
    for model in _MODELS.values():
        model.memo.clear()


def encode_documents(docs: DataFrame, model_path: str, text_col: str = "text", ids: str = "token_ids") -> DataFrame:
    """Add an array of piece ids to every row; all other columns stay.

    The whole text is encoded.  A null text gets null, an empty one an empty array.  Characters
    outside the vocabulary become byte pieces, so decoding gives the text back; only U+2581 itself
    is not kept apart from a space (the file format's own escape).  A column of the added name is
    replaced.  The model file is read on the driver and broadcast (a vocabulary, checked to be
    below 64 MB).
    """
    shared = _broadcast_model(docs, model_path)

    return _with_arrow_column(docs, text_col, ids, "array<int>", lambda t: _encode_column(t, load(shared.value)))


def decode_documents(docs: DataFrame, model_path: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """Add the text that an array of piece ids stands for (null for null); all other columns stay."""
    shared = _broadcast_model(docs, model_path)
    return _with_arrow_column(docs, ids, text, "string", lambda t: _decode_column(t, load(shared.value)))


def _encode_column(column: pa.Array, model: PieceModel) -> pa.Array:
    """Lists of ids as one flat buffer: no Python list outlives its text."""
    values, ends, null = array("i"), np.zeros(len(column) + 1, np.int32), np.zeros(len(column), bool)
    for k, text in enumerate(column):
        t = text.as_py()
        null[k] = t is None
        if t:
            values.extend(model.encode(t))
        ends[k + 1] = len(values)
    flat = pa.array(np.frombuffer(values, np.int32) if values else np.zeros(0, np.int32))
    return pa.ListArray.from_arrays(pa.array(ends), flat, mask=pa.array(null))


def _decode_column(column: pa.Array, model: PieceModel) -> pa.Array:
    return pa.array([model.decode(v.values.to_numpy(zero_copy_only=False).tolist()) if v.is_valid else None for v in column], pa.string())


def _with_arrow_column(docs: DataFrame, source: str, target: str, kind: str, make) -> DataFrame:
    @F.arrow_udf(kind)
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield make(column)
        forget()

    keep = without(docs, target)
    return docs.select(*keep, run(F.col(source)).alias(target))


def _broadcast_model(docs: DataFrame, model_path: str):
    with open(model_path, "rb") as f:
        model = f.read((64 << 20) + 1)
    if len(model) > 64 << 20:
        raise ValueError("the model file is above 64 MB")
    return docs.sparkSession.sparkContext.broadcast(model)
