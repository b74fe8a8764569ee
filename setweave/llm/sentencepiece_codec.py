"""SentencePiece encoding and decoding with source offsets (operator 9).

The normaliser is this module's own: at each position it takes the longest prefix that the
model's compiled character map knows, and records for every normalised byte the source bytes it
came from.  The library's segmentation of the text is then projected through that record, so each
piece gets the span of original UTF-8 bytes that it stands for.
"""

from __future__ import annotations

import functools
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import shared

SPACE = "▁".encode()
#: Characters of text that one call of the library gets; bounds a worker's memory.
CHUNK_CHARS = 2_000_000
SCHEMA = "doc_id long, ids array<int>, starts array<int>, ends array<int>, decoded string"


class CharacterMap:
    """The compiled map of a model: a double-array trie over UTF-8 keys, and NUL-ended replacements."""

    def __init__(self, blob: bytes):
        self.units: tuple[int, ...] = ()
        self.replacements = b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.replacements = blob[4 + size :]

    def longest_prefix(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes read, replacement) of the longest key that starts at ``at``."""
        if not self.units:
            return None
        found = None
        node = self._offset(self.units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                start = self.units[node] & 0x7FFFFFFF
                found = i + 1 - at, self.replacements[start : self.replacements.index(b"\0", start)]
        return found

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 0x200) >> 6)


class OffsetNormalizer:
    """Normalised bytes of a text, and for each of them (and the end) the source offset."""

    def __init__(self, spec):
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix = spec.add_dummy_prefix
        self.squeeze = spec.remove_extra_whitespaces
        self.space = SPACE if spec.escape_whitespaces else b" "

    def __call__(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """(normalised, source): ``source[i]`` is where normalised byte i starts in ``data``."""
        if not data:
            return b"", np.zeros(1, np.int64)
        if not self.map.units and not self.squeeze:
            return self._identity(data)
        out, source, at = bytearray(), [], 0
        while at < len(data):
            hit = self.map.longest_prefix(data, at)
            step = 0
            if hit is None:  # a character that stays has a source for each of its bytes
                n, step = 1, 1
                while at + n < len(data) and data[at + n] & 0xC0 == 0x80:
                    n += 1
                hit = n, data[at : at + n]
            for k, byte in enumerate(hit[1]):
                if self.squeeze and byte == 32 and (not out or out[-1] == 32):
                    continue
                out.append(byte)
                source.append(at + k * step)
            at += hit[0]
        while self.squeeze and out and out[-1] == 32:
            out.pop()
            source.pop()
        if not out and (self.squeeze or not self.prefix):
            return b"", np.array([len(data)])
        if self.prefix:  # also where the map leaves nothing of the text
            out[:0], source[:0] = b" ", [source[0] if source else 0]
        return self._escape(np.frombuffer(bytes(out), np.uint8), np.array([*source, len(data)]))

    def _identity(self, data: bytes) -> tuple[bytes, np.ndarray]:
        raw = np.frombuffer((b" " if self.prefix else b"") + data, np.uint8)
        source = np.arange(len(raw) + 1) - self.prefix
        source[0] = 0
        return self._escape(raw, source)

    def _escape(self, raw: np.ndarray, source: np.ndarray) -> tuple[bytes, np.ndarray]:
        width = np.where(raw == 32, len(self.space), 1)
        return raw.tobytes().replace(b" ", self.space), np.append(np.repeat(source[:-1], width), source[-1])


class Codec:
    def __init__(self, model_path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.lib = sentencepiece.SentencePieceProcessor(model_file=model_path)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(self.lib.serialized_model_proto())
        self.normalize = OffsetNormalizer(proto.normalizer_spec)
        kind = proto.SentencePiece
        self.width = np.array([{kind.BYTE: 1, kind.CONTROL: 0}.get(p.type, len(p.piece.encode())) for p in proto.pieces])
        self.may_be_unknown = self.lib.unk_id()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.lib.encode(texts, add_bos=True, add_eos=True, num_threads=1)

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.lib.decode(ids) if ids else []

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end byte of every id in the UTF-8 source; begin and end ids are empty spans."""
        data = text.encode()
        normal, source = self.normalize(data)
        ends = np.cumsum(self.width[ids])
        if ends[-1] != len(normal):
            if self.may_be_unknown not in ids:
                raise ValueError("pieces don't tile the normalised text")
            return self._spans_of_pieces(text, ids)
        starts = source[np.append(0, ends[:-1])]
        stops = source[ends]
        starts[-1] = stops[-1] = len(data)
        return starts, stops

    def _spans_of_pieces(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For models with unknown pieces, whose width is only in the segmentation itself."""
        normal, source = self.normalize(text.encode())
        pieces = [p.encode() for p in self.lib.encode(text, out_type=str)]
        ends = np.cumsum([0, *map(len, pieces), 0])
        stops = source[np.minimum(ends, len(normal))]
        return np.append(0, stops[:-1]), stops


@functools.cache
def codec(model_path: str) -> Codec:
    return Codec(model_path)


def _chunks(rows: list[tuple[int, str]]) -> Iterator[list[tuple[int, str]]]:
    part, size = [], 0
    for row in rows:
        part.append(row)
        size += len(row[1])
        if size >= CHUNK_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def _documents(batch: pa.RecordBatch) -> list[tuple[int, str]]:
    return list(zip(batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()], strict=True))


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids, starts, ends, decoded of every row.

    ``model_path`` must name the same file on every executor.  A null text counts as empty (begin
    and end id only); repeated rows give repeated results; a null doc_id stays null; an empty table
    gives an empty one; other columns of ``docs`` aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for batch in batches:
            for part in _chunks(_documents(batch)):
                ids = own.encode([t for _, t in part])
                spans = [own.spans(t, np.array(i)) for (_, t), i in zip(part, ids, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([d for d, _ in part], pa.int64()),
                        pa.array(ids, pa.list_(pa.int32())),
                        pa.array([s.astype(np.int32) for s, _ in spans], pa.list_(pa.int32())),
                        pa.array([e.astype(np.int32) for _, e in spans], pa.list_(pa.int32())),
                        pa.array(own.decode(ids), pa.string()),
                    ],
                    names=["doc_id", "ids", "starts", "ends", "decoded"],
                )

    return shared.project(docs, "doc_id", "text").mapInArrow(run, SCHEMA)


def encode_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, spans_sha256 (of little-endian start, end pairs), same rules.

    The digests are made where the ids are, so that neither ids nor spans pass back to the JVM.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            for part in _chunks(_documents(batch)):
                ids = own.encode([t for _, t in part])
                rows = []
                for (doc, text), i, back in zip(part, ids, own.decode(ids), strict=True):
                    a = np.array(i, np.uint32)
                    spans = np.stack(own.spans(text, a), 1).astype("<u4")
                    rows.append((doc, len(i), sha(a.astype("<u4").tobytes()), sha(back.encode()), sha(spans.tobytes())))
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"]
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return shared.project(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string")


def round_trip(docs: DataFrame, model_path: str) -> DataFrame:
    """``docs`` with each text replaced by what its ids decode to; every other column stays."""
    from pyspark.sql import functions as F

    @F.pandas_udf("string")
    def back(texts):
        own = codec(model_path)
        return texts.map(lambda t: own.decode(own.encode([t]))[0], na_action="ignore")

    return docs.withColumn("text", back(F.col("text")))


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(shared.read_table(spark, sf_dir, "documents"), default_model())


SQL = None  # a trained model's merges have no SQL form; tests compare with the library itself
