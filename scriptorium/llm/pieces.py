"""SentencePiece encoding and decoding by Aho-Corasick and Viterbi.

An automaton of all pieces reads the text once. At each position it gives the
pieces that end there, longest first along its output links, and each relaxes the
best score of its end (a single-pass Viterbi search). A character that no piece
covers costs UNKNOWN less than the worst piece and becomes its UTF-8 bytes. Of equal
scores the longer last piece stays.

No piece goes on over the start of a word, so words are encoded by themselves and
frequent ones remembered; the result is that of the whole text. The model file's
path is a parameter: the driver reads its pieces and scores and broadcasts them
(32,000 entries; at most ``max_pieces``).

A null text is empty; an empty text has no ids. A literal U+2581 in a text is
written as bytes, so decoding is exact for every text.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._spark import append, column

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNKNOWN = 10.0
_REMEMBER, _LONG = 150_000, 64


def vocabulary(path: str = MODEL, max_pieces: int = 1_000_000) -> dict:
    """Pieces with ids and scores, and the ids of bytes, of a SentencePiece model."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    if sp.get_piece_size() > max_pieces:
        raise ValueError("the vocabulary is larger than what may be broadcast")
    plain, byte = [], [0] * 256
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte[int(piece[3:5], 16)] = i
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            plain.append((piece, i, sp.get_score(i)))
    return {"pieces": plain, "bytes": byte, "size": sp.get_piece_size(), "key": hashlib.sha256(repr((plain, byte)).encode()).hexdigest()}


class Codec:
    def __init__(self, vocabulary: dict):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, i, score in vocabulary["pieces"]:
            self.automaton.add_word(piece, (i, len(piece), score))
        self.automaton.make_automaton()
        self.byte = vocabulary["bytes"]
        self.unknown = min((s for *_, s in vocabulary["pieces"]), default=0.0) - UNKNOWN
        over = any(SPACE in piece.lstrip(SPACE) for piece, *_ in vocabulary["pieces"])
        self.chunks = re.compile("(?s).+" if over else f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        self.raw = [b""] * vocabulary["size"]
        for piece, i, _ in vocabulary["pieces"]:
            self.raw[i] = piece.replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte):
            self.raw[i] = bytes([b])
        self.known: dict[str, bytes] = {}

    def viterbi(self, chunk: str) -> list[int]:
        n, at, unknown = len(chunk), 0, self.unknown
        best, back = [0.0] * (n + 1), [None] * (n + 1)
        for end, (i, length, score) in self.automaton.iter(chunk):
            while at <= end:
                best[at + 1] = best[at] + unknown
                at += 1
            s = best[end + 1 - length] + score
            if s > best[end + 1]:
                best[end + 1] = s
                back[end + 1] = (i, length)
        out, at = [], n
        while at:
            if back[at] is None:
                out.extend(self.byte[b] for b in reversed(chunk[at - 1].encode("utf-8", "surrogatepass")))
                at -= 1
            else:
                out.append(back[at][0])
                at -= back[at][1]
        out.reverse()
        return out

    def _chunk(self, chunk: str) -> bytes:
        out = np.array(self.viterbi(chunk), np.int32).tobytes()
        if len(chunk) <= _LONG:
            if len(self.known) >= _REMEMBER:
                self.known.clear()
            self.known[chunk] = out
        return out

    def _plain(self, text: str) -> bytes:
        known, new = self.known.get, self._chunk
        return b"".join([known(c) or new(c) for c in self.chunks(text.replace(" ", SPACE))])

    def encode(self, text: str) -> bytes:
        """ids as little-endian 32-bit numbers; a space is put before the text."""
        if not text:
            return b""
        if SPACE not in text:
            return self._plain(" " + text)
        mark = np.array([self.byte[b] for b in SPACE.encode()], np.int32).tobytes()
        parts = (" " + text).split(SPACE)
        return mark.join(self._plain(p) if p else b"" for p in parts)

    def decode(self, ids) -> str:
        raw = self.raw
        return b"".join([raw[i] for i in ids]).decode("utf-8", "surrogatepass")[1:]


_codecs: dict[str, Codec] = {}


def _codec(vocabulary: dict) -> Codec:
    """The worker's codec of a vocabulary, the last one only; its memory of words outlives a task."""
    key = vocabulary["key"]
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(vocabulary)
    return _codecs[key]


def encode(docs: DataFrame, vocabulary: dict, *, text: str = "text") -> DataFrame:
    """docs with token_ids array<int>, n_tokens, and decoded_ok: decoding gives the text again."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def compute(batch):
        codec = _codec(shared.value)
        texts = [t or "" for t in column(batch, text).to_pylist()]
        packed = [codec.encode(t) for t in texts]
        ids = np.frombuffer(b"".join(packed), np.int32)
        offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype(np.int32)
        ok = [codec.decode(ids[a:b].tolist()) == t for t, a, b in zip(texts, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)).cast(pa.list_(pa.int32())), np.diff(offsets).astype(np.int64), ok

    return append(docs, compute, "token_ids array<int>, n_tokens long, decoded_ok boolean", text)


def decode(docs: DataFrame, vocabulary: dict, *, ids: str = "token_ids") -> DataFrame:
    """docs with decoded, the text of their ids (null ids: null)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def compute(batch):
        codec = _codec(shared.value)
        return [[None if x is None else codec.decode(x) for x in column(batch, ids).to_pylist()]]

    return append(docs, compute, "decoded string")
