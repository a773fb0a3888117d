"""SentencePiece encoding that keeps byte offsets, and decoding.

Encoding has three steps.

1. Normalisation: from left to right, the longest prefix found in the model's
   compiled character map is replaced; other characters stay. For every byte of
   the normalised text the source byte it stems from is recorded. White space is
   then escaped, trimmed and prefixed as the model asks, and the alignment with it.
2. Segmentation by the library's own model, with its normaliser switched off, as
   the text is normalised already. A piece never spans the boundary before a run of
   escaped spaces unless the vocabulary has such a piece; without one, long texts
   are cut there into parts, so that no merge queue grows with the text.
3. Projection: the ends of the pieces in the normalised text, taken through the
   alignment, give every piece its span of bytes in the source text.

Decoding is the library's. The model's bytes travel with the tasks, so no file
needs to exist on executors.

Defined results: null counts as empty; empty texts have no tokens. Rows are
independent, so repeated rows give repeated results. Other columns are untouched.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as model_pb

from caseflow.llm.common import with_result

SPACE = "▁"
SPACE_BYTES = SPACE.encode()
#: Long texts are segmented in parts of at least this many characters.
PART_CHARS = 500
PART = re.compile(f".{{{PART_CHARS}}}{SPACE}*[^{SPACE}]*|.+", re.DOTALL)


class CharacterMap:
    """The compiled map: a double-array trie over UTF-8, and the replacement texts."""

    def __init__(self, blob: bytes):
        self.units = np.zeros(0, np.uint32)
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = np.frombuffer(blob[4 : 4 + size], "<u4")
            self.texts = blob[4 + size :]

    def longest_prefix(self, data: bytes, start: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest key that begins at ``start``."""
        units, found = self.units, None
        if not len(units):
            return None
        unit = int(units[0])
        node = (unit >> 10) << ((unit & (1 << 9)) >> 6)
        for i in range(start, len(data)):
            node ^= data[i]
            if node >= len(units):
                break
            unit = int(units[node])
            if unit & ((1 << 31) | 0xFF) != data[i]:
                break
            node ^= (unit >> 10) << ((unit & (1 << 9)) >> 6)
            if (unit >> 8) & 1:
                at = int(units[node]) & 0x7FFFFFFF
                found = i - start + 1, self.texts[at : self.texts.index(b"\0", at)]
        return found


def _width(first: int) -> int:
    return 1 if first < 0xC0 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4


class Codec:
    """One model: normaliser with alignment, segmenter and decoder."""

    def __init__(self, model: bytes):
        proto = model_pb.ModelProto.FromString(model)
        spec = proto.normalizer_spec
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix, self.trim, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        if proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("models that put the space behind words are not supported")
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        spec.name, spec.precompiled_charsmap = "identity", b""
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = spec.escape_whitespaces = False
        self.segmenter = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.sizes = np.array([1 if p.type == p.BYTE else len(p.piece.encode()) for p in proto.pieces], np.int64)
        self.unknown = proto.trainer_spec.unk_id
        self.separable = self.escape and not any(SPACE in p.piece.lstrip(SPACE) for p in proto.pieces)
        self.shown_ids = [str(i) for i in range(len(proto.pieces))]

    # --- normalisation ---

    def _mapped(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """Replaced text, and the source byte of each of its bytes and of its end."""
        if not len(self.map.units):
            return data, np.arange(len(data) + 1)
        out, source, i = [], [], 0
        while i < len(data):
            width, new = self.map.longest_prefix(data, i) or (0, b"")
            if not width:
                width = _width(data[i])
                new = data[i : i + width]
                source.extend(range(i, i + len(new)))
            else:
                source.extend([i] * len(new))
            out.append(new)
            i += width
        return b"".join(out), np.array([*source, len(data)])

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """Normalised text; the source byte of each of its bytes and of its end."""
        data = text.encode()
        new, source = self._mapped(data)
        codes = np.frombuffer(new, np.uint8)
        keep = np.ones(len(codes), bool)
        if self.trim:
            is_space = codes == 32
            keep = ~(is_space & np.concatenate(([True], is_space[:-1])))
            last = np.flatnonzero(~is_space)
            keep[last[-1] + 1 if len(last) else 0 :] = False
        codes, ends = codes[keep], source[-1:]
        if self.trim and len(codes) < len(new) and len(codes):
            ends = source[1:][keep][-1:]
        source = source[:-1][keep]
        if not len(codes) and (self.trim or not data or not self.prefix):
            return "", ends
        shown = codes.tobytes().decode()
        if self.escape:
            shown = shown.replace(" ", SPACE)
            source = np.repeat(source, np.where(codes == 32, len(SPACE_BYTES), 1))
        if self.prefix:
            mark = SPACE if self.escape else " "
            shown = mark + shown
            first = source[:1] if len(source) else [0]
            source = np.concatenate((np.repeat(first, len(mark.encode())), source))
        return shown, np.concatenate((source, ends))

    # --- encoding ---

    def encode(self, text: str) -> tuple[list[int], np.ndarray]:
        """Ids and piece spans (begin and end in bytes of the source)."""
        shown, source = self.normalise(text)
        parts = PART.findall(shown) if self.separable else [shown] if shown else []
        ids = [i for part in self.segmenter.encode(parts, num_threads=1) for i in part]
        return ids, self._project(shown, source, ids)

    def joined(self, ids: list[int]) -> str:
        return ",".join(map(self.shown_ids.__getitem__, ids))

    def _project(self, shown: str, source: np.ndarray, ids: list[int]) -> np.ndarray:
        if not ids:
            return np.zeros((0, 2), np.int64)
        lengths = self.sizes[ids]
        if self.unknown in ids:
            pieces = self.segmenter.encode(shown, out_type=str)
            lengths = np.array([self.sizes[i] if i != self.unknown else len(p.encode()) for i, p in zip(ids, pieces)])
        ends = np.cumsum(lengths)
        if ends[-1] != len(source) - 1:
            raise ValueError("pieces don't cover the normalised text")
        return np.stack((source[ends - lengths], source[ends]), axis=1)

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids) if ids else ""


@lru_cache(maxsize=2)
def codec(model: bytes) -> Codec:
    """One codec per model and Python worker."""
    return Codec(model)


def read_model(path: str) -> bytes:
    """The model file, read once on the driver."""
    with open(path, "rb") as file:
        return file.read()


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def encode(df: DataFrame, model: bytes, text_col: str = "text") -> DataFrame:
    """``df`` with a struct column ``encoded``: ids, begins, ends (source bytes of each piece).

    A column of that name is kept as ``encoded_given``.
    """

    @F.pandas_udf("ids array<int>, begins array<long>, ends array<long>")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = codec(model)
        for texts in batches:
            rows = [(ids, spans[:, 0], spans[:, 1]) for ids, spans in map(own.encode, texts.fillna(""))]
            yield pd.DataFrame(rows, columns=["ids", "begins", "ends"])

    return with_result(df, "encoded", encoded(F.col(text_col)))


def decode(df: DataFrame, model: bytes, ids_col: str) -> DataFrame:
    """``df`` with the text ``decoded`` from an array of ids; null decodes to an empty text.

    A column of that name is kept as ``decoded_given``.
    """

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(model)
        for ids in batches:
            yield pd.Series(["" if i is None else own.decode([int(x) for x in i]) for i in ids])

    return with_result(df, "decoded", decoded(F.col(ids_col)))


def digests(df: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, ids_sha256, decoded_sha256, bytes_covered.

    Encodes and decodes in one pass; only the digests leave the task.
    ``bytes_covered`` is the number of source bytes inside piece spans.
    """

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string, bytes_covered long")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = codec(model)
        for texts in batches:
            rows = []
            for ids, spans in map(own.encode, texts.fillna("")):
                covered = int((spans[:, 1] - spans[:, 0]).sum())
                rows.append((len(ids), _sha(own.joined(ids)), _sha(own.decode(ids)), covered))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", "bytes_covered"])

    result = df.select(F.col(id_col).alias(id_col), digest(F.col(text_col)).alias("digest"))
    return result.select(id_col, "digest.*")
