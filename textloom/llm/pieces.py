"""SentencePiece encoding with byte offsets, and decoding.

The text is normalised here, not by the library: at each place the longest
rule of the model's compiled character map that is a prefix of the rest is
applied, and for every byte written the place of its source in the original
text is recorded. The library's segmentation then runs on the normalised text
with its own normaliser switched off, and each piece is projected through the
record to the bytes of the original text that it stands for.

The compiled map is a double-array trie of 32-bit units followed by the
replacements, as the model file stores it.

Edge cases: a null or empty text gives no ids and decodes to the empty text.
Repeated rows get a row each. Only the two named columns are read, so other
columns cannot clash. An empty table gives an empty result. Texts are encoded
whole, however long.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textloom.llm import textbytes as tb

MODEL = "piece_bpe_32k.model"
SPACE = "▁".encode()


class CharsMap:
    """The compiled character map: longest rule that is a prefix of bytes at a place."""

    def __init__(self, blob: bytes):
        self.units: list[int] = []
        self.text = b""
        if blob:
            size = struct.unpack_from("<I", blob)[0]
            self.units = list(struct.unpack_from(f"<{size // 4}I", blob, 4))
            self.text = blob[4 + size :]
        self.begins = np.zeros(256, bool)
        for b in range(256):
            if self.units:
                at = self._offset(self.units[0]) ^ b
                self.begins[b] = at < len(self.units) and self._label(self.units[at]) == b

    @staticmethod
    def _label(unit: int) -> int:
        return unit & (0x80000000 | 0xFF)

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes matched, replacement) of the longest rule at a place, or None."""
        if not self.units:
            return None
        node, found, i = self._offset(self.units[0]), None, at
        while i < len(data):
            node ^= data[i]
            if node >= len(self.units) or self._label(unit := self.units[node]) != data[i]:
                break
            i += 1
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                start = self.units[node] & 0x7FFFFFFF
                found = i - at, self.text[start : self.text.index(0, start)]
        return found


class Encoder:
    """Encodes whole texts to ids and to the spans of original bytes that the pieces stand for."""

    def __init__(self, model_file: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(model_file, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        self.map, self.prefix, self.squeeze, self.escape = CharsMap(spec.precompiled_charsmap), spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        if proto.trainer_spec.treat_whitespace_as_suffix or any(p.type == 4 for p in proto.pieces):
            raise ValueError("models with user-defined pieces or with white space as suffix are not supported")
        self.library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        spec.name, spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces = "identity", b"", False, False, False
        self.segmenter = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.unk = self.library.unk_id()
        self.width = np.array([1 if p.type == 6 else 0 if p.type in (2, 3) else len(p.piece.encode()) for p in proto.pieces], np.int64)
        self.names = [str(i) for i in range(len(proto.pieces))]

    def normalize(self, text: str) -> tuple[bytes, np.ndarray]:
        """(normalised bytes, place): byte i of them comes from original bytes from place[i] on; the last place is the end."""
        data = text.encode()
        if not self.map.units and not self.squeeze and self.escape:
            return self._identity(data)
        return self._general(data)

    def _identity(self, data: bytes) -> tuple[bytes, np.ndarray]:
        raw = np.frombuffer(data, np.uint8)
        if not len(raw):
            return b"", np.zeros(1, np.int64)
        lead = len(SPACE) if self.prefix else 0
        place = np.repeat(np.arange(len(raw)), np.where(raw == 32, 3, 1))
        return (SPACE if self.prefix else b"") + data.replace(b" ", SPACE), np.concatenate([np.zeros(lead, np.int64), place, [len(raw)]])

    def _general(self, data: bytes) -> tuple[bytes, np.ndarray]:
        parts: list[tuple[int, int, bytes]] = []
        i = 0
        while i < len(data):
            hit = self.map.longest(data, i) if self.map.begins[data[i]] else None
            if hit is None:
                n = 1
                while i + n < len(data) and data[i + n] & 0xC0 == 0x80:
                    n += 1
                hit = n, data[i : i + n]
            parts.append((i, i + hit[0], hit[1]))
            i += hit[0]
        if self.squeeze:
            while parts and parts[0][2] in (b" ", b""):
                parts.pop(0)
        if not parts:
            return b"", np.array([len(data)])
        gap = SPACE if self.escape else b" "
        out, place = bytearray(), []
        if self.prefix:
            out += gap
            place += [parts[0][0]] * len(gap)
        after_space = self.squeeze
        for start, _, new in parts:
            if self.squeeze and after_space:
                new = new.lstrip(b" ")
            if new:
                for c in new:
                    piece = gap if c == 32 and self.escape else bytes([c])
                    out += piece
                    place += [start] * len(piece)
                after_space = self.squeeze and new.endswith(b" ")
        end = parts[-1][1]
        if self.squeeze:
            while out.endswith(gap):
                end = place[-len(gap)]
                del out[-len(gap) :], place[-len(gap) :]
        return bytes(out), np.array([*place, end])

    def encode(self, texts: list[str]) -> list[tuple[list[int], np.ndarray]]:
        """(ids, bounds) for each text: piece i stands for original bytes bounds[i] to bounds[i + 1]."""
        norm = [self.normalize(t) for t in texts]
        ids = self.segmenter.encode([n.decode() for n, _ in norm], num_threads=1)
        out = []
        for (data, place), own in zip(norm, ids, strict=True):
            at = np.concatenate([[0], np.cumsum(self.width[own])]) if own else np.zeros(1, np.int64)
            if at[-1] != len(data):
                at = self._unknown(data, own)
            out.append((own, place[at]))
        return out

    def _unknown(self, data: bytes, ids: list[int]) -> np.ndarray:
        """Bounds where a model without byte pieces has met unknown characters: their length is found in the library's own pieces."""
        pieces = self.segmenter.encode(data.decode(), out_type=str)
        return np.cumsum([0, *(len(p.encode()) if i == self.unk else self.width[i] for p, i in zip(pieces, ids, strict=True))])

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


_encoders: dict[str, Encoder] = {}


def encoder(model_file: str) -> Encoder:
    """The encoder of a model file, loaded once in each process."""
    if model_file not in _encoders:
        _encoders[model_file] = Encoder(model_file)
    return _encoders[model_file]


def public_model(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_texts(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, with_bounds: bool = False, batch: int = 64) -> DataFrame:
    """Per row: the id, n_tokens, digests of the ids, of the decoded text and of the pieces' byte bounds, the
    number of original bytes that the pieces cover, and on demand the ids and the bounds themselves."""
    tb.bound_batches(docs.sparkSession)

    def run(batches):
        enc = encoder(model_file)
        for b in batches:
            for i in range(0, b.num_rows, batch):
                texts = [t or "" for t in b.column(1).slice(i, batch).to_pylist()]
                got = enc.encode(texts)
                ids = [x for x, _ in got]
                sha = lambda x: hashlib.sha256(x).hexdigest()
                cols = [
                    b.column(0).slice(i, batch),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([sha(",".join([enc.names[y] for y in x]).encode()) for x in ids]),
                    pa.array([sha(enc.decode(x).encode()) for x in ids]),
                    pa.array([sha(e.astype("<i8").tobytes()) for _, e in got]),
                    pa.array([int(e[-1] - e[0]) for _, e in got], pa.int64()),
                ]
                if with_ids:
                    cols.append(pa.array(ids, pa.list_(pa.int32())))
                if with_bounds:
                    cols.append(pa.array([e for _, e in got], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "bounds_sha256", "n_bytes"] + ["ids"] * with_ids + ["bounds"] * with_bounds
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, bounds_sha256 string, n_bytes long" + ", ids array<int>" * with_ids + ", bounds array<long>" * with_bounds
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def op7_sentencepiece(spark, sf_dir: str, model_file: str | None = None) -> DataFrame:
    return encode_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), model_file or public_model())
