"""SentencePiece encoding and decoding with the source byte span of every piece.

The text is normalised by longest-prefix matches in the model's compiled character map, which records for every
normalised byte the source byte that it came from. Each piece's place in the normalised text is then carried back to a
span of bytes in the source.

Defined results: a null text counts as empty and gives no ids; null and repeated document ids pass through; an empty
table gives an empty result; columns other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

SPACE = "▁"


class CharacterMap:
    """The compiled map: a 32-bit size, a double-array trie of that many bytes, then replacements that end in a zero byte."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.texts = blob[4 + size :]
        #: Whether a key begins with the byte.
        self.begins = np.array([self._begins(b) for b in range(256)], dtype=bool)

    def _begins(self, byte: int) -> bool:
        node = self._child(0, self.units[0]) ^ byte if self.units else -1
        return 0 <= node < len(self.units) and self.units[node] & 0x800000FF == byte

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key that is a prefix of text[at:], and its replacement."""
        units, found = self.units, None
        if not units:
            return None
        node = self._child(0, units[0])
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != text[i]:
                break
            node = self._child(node, unit)
            if unit >> 8 & 1:
                value = units[node] & 0x7FFFFFFF
                found = i + 1 - at, self.texts[value : self.texts.index(b"\0", value)]
        return found

    @staticmethod
    def _child(node: int, unit: int) -> int:
        return node ^ (unit >> 10 << ((unit & 0x200) >> 6))


def aligned(text: bytes, chars: CharacterMap) -> tuple[bytes, np.ndarray]:
    """Text after replacements and, for each of its bytes, the source byte that it came from: its own, or the first of the key replaced."""
    parts, source, done = [], [], 0
    for at in np.flatnonzero(chars.begins[np.frombuffer(text, np.uint8)]).tolist():
        hit = chars.longest(text, at) if at >= done else None
        if hit is not None:
            parts += [text[done:at], hit[1]]
            source += [np.arange(done, at), np.full(len(hit[1]), at)]
            done = at + hit[0]
    return b"".join([*parts, text[done:]]), np.concatenate([*source, np.arange(done, len(text))]).astype(np.int64)


def normalise(text: bytes, chars: CharacterMap, *, prefix: bool, squeeze: bool) -> tuple[bytes, np.ndarray]:
    """Normalised bytes (white space as U+2581) and, for each of them and for the end, its source byte offset."""
    if not squeeze:
        plain, source = aligned(text, chars)
        source = np.repeat(source, np.where(np.frombuffer(plain, np.uint8) == 0x20, 3, 1))
        first = [source[:1].repeat(3)] if prefix and len(source) else []
        return SPACE.encode() * len(first) + plain.replace(b" ", SPACE.encode()), np.concatenate([*first, source, [len(text)]])
    mark, out, source, at = SPACE.encode(), bytearray(), [], 0
    pieces = []
    while at < len(text):
        hit = chars.longest(text, at)
        if hit is None:
            lead = text[at]
            n = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            hit = n, text[at : at + n]
        pieces.append((at, hit[1]))
        at += hit[0]
    blank = lambda p: p[1].strip(b" ") == b""
    while pieces and blank(pieces[0]):
        pieces.pop(0)
    if prefix and pieces:
        out += mark
        source += [pieces[0][0]] * 3
    after_space = True
    for origin, piece in pieces:
        if after_space:
            piece = piece.lstrip(b" ")
        if not piece:
            continue
        after_space = piece.endswith(b" ")
        piece = piece.replace(b" ", mark)
        out += piece
        source += [origin] * len(piece)
    end = at
    while out.endswith(mark):
        end = source[len(out) - 3]
        del out[-3:], source[-3:]
    return bytes(out), np.array([*source, end], dtype=np.int64)


class PieceEncoder:
    """Encoder of one model file in this Python worker."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as f:
            blob = f.read()
        self.model = sentencepiece.SentencePieceProcessor(model_proto=blob)
        spec = sentencepiece_model_pb2.ModelProto.FromString(blob)
        norm = spec.normalizer_spec
        self.chars, self.prefix, self.squeeze = CharacterMap(norm.precompiled_charsmap), norm.add_dummy_prefix, norm.remove_extra_whitespaces
        self.bytes_of = np.array([1 if p.type == 6 else len(p.piece.encode()) for p in spec.pieces], dtype=np.int64)
        self.unknown = self.model.unk_id()
        self.decimals = [str(i) for i in range(len(spec.pieces))]

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text)

    def decimal(self, ids: list[int]) -> str:
        """Decimal ids joined by commas."""
        names = self.decimals
        return ",".join([names[i] for i in ids])

    def spans(self, text: str, ids: list[int]) -> np.ndarray:
        """Edges of the pieces' spans in the source bytes: piece i covers edges[i] to edges[i + 1]."""
        at = np.array(ids, dtype=np.int64)
        norm, source = normalise(text.encode("utf-8", "replace"), self.chars, prefix=self.prefix, squeeze=self.squeeze)
        sizes = self.bytes_of[at]
        if self.unknown in ids:
            sizes = self._unknown_sizes(norm, ids, sizes)
        edges = np.concatenate([[0], np.cumsum(sizes)])
        if edges[-1] != len(norm):
            raise ValueError(f"pieces cover {edges[-1]} of {len(norm)} normalised bytes")
        return source[edges]

    def _unknown_sizes(self, norm: bytes, ids: list[int], sizes: np.ndarray) -> np.ndarray:
        """An unknown piece reaches to where the next known piece is found."""
        out, at = sizes.copy(), 0
        for k, i in enumerate(ids):
            if i == self.unknown:
                known = next((self.model.id_to_piece(j).encode() for j in ids[k + 1 :] if j != self.unknown), None)
                out[k] = (norm.index(known, at + 1) if known else len(norm)) - at
            at += int(out[k])
        return out


_encoders: dict[str, PieceEncoder] = {}


def piece_encoder(path: str) -> PieceEncoder:
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def encode_pieces(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids, starts, ends, decoded) of every (doc_id, text): ids with their spans of source bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = piece_encoder(model)
        for batch in batches:
            texts = ["" if t is None else t for t in batch["text"]]
            ids = [enc.encode(t) for t in texts]
            edges = [enc.spans(t, i) for t, i in zip(texts, ids, strict=True)]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": ids, "starts": [e[:-1] for e in edges], "ends": [e[1:] for e in edges], "decoded": [enc.model.decode(i) for i in ids]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInPandas(run, "doc_id long, ids array<int>, starts array<long>, ends array<long>, decoded string")


def piece_digests(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, spans_sha256, spans_cover) of every document.

    spans_cover: the spans follow each other from the first source byte to the last."""
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = piece_encoder(model)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                text = "" if text is None else text
                ids = enc.encode(text)
                edges = enc.spans(text, ids)
                rows.append((len(ids), sha(enc.decimal(ids).encode()), sha(enc.model.decode(ids).encode()), sha(edges.astype("<i8").tobytes()), bool(edges[-1] == len(text.encode()))))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256", "spans_cover"])
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string, spans_cover boolean")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(documents(spark, sf_dir), default_model())
