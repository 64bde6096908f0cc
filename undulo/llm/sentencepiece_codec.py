"""SentencePiece encoding that keeps the byte span of every piece, and decoding.

Every text is normalised here: the model's compiled character map (a double-array trie) is walked by longest prefix, user-defined symbols stay as they
are, spaces are squeezed, put in front and marked as the model's options say, and for every normalised byte the offset of the original character that it
came from is recorded. Stretches without a byte that begins a key of the map or a symbol are copied in numpy. The normalised text is encoded
by the library, with a copy of the model that leaves texts as they are, and the running sum of the pieces' lengths, sent through the record, projects every piece to its span in the
original bytes, as the library gives it: spans join up without gaps; leading and trailing spaces that the model strips are in none.

Encoding is cut at spaces: where no piece of the vocabulary goes on with a space after another character
(checked at load), no merge crosses such a place, and the parts of a normalised text can be encoded on their own
and kept in a bounded cache. A model that doesn't meet this is given whole texts.

Null and empty texts have no pieces and decode to the empty string. Texts, very long ones too, are never cut short. Rows,
their order, repeats and other columns stay as they are; a column named pieces is replaced.
"""

from __future__ import annotations

import hashlib
import re
import struct
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undulo.llm.common import give_back, small_batches, stored, without_gc

SPACE = "▁"
MARK = SPACE.encode()
#: Distinct parts of texts that a Python worker keeps, and texts that it encodes at once.
CACHE_PARTS, TEXTS = 100_000, 64

_ODD = b"\0"
_CUT = re.compile(f"(?<=[^{SPACE}])(?={SPACE})")


def _cut(text: bytes) -> list[bytes]:
    """The parts of a normalised text without the mark before each; parts that would be mistaken are written out behind a NUL."""
    if text[:3] == MARK and MARK + MARK not in text and text[-3:] != MARK and _ODD not in text:
        return text[3:].split(MARK)
    return [_ODD + p.encode() for p in _CUT.split(text.decode())] if text else []


def _varint(data: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (data[i] & 127) << shift
        shift, i = shift + 7, i + 1
        if data[i - 1] < 128:
            return value, i


def _fields(data: bytes):
    """Field numbers and values of a serialised protocol buffer message."""
    i = 0
    while i < len(data):
        key, i = _varint(data, i)
        if key & 7 == 0:
            value, i = _varint(data, i)
        else:
            n, i = (8, i) if key & 7 == 1 else (4, i) if key & 7 == 5 else _varint(data, i)
            value, i = data[i : i + n], i + n
        yield key >> 3, value


def _field(number: int, value: bytes | int) -> bytes:
    """A field of a serialised message."""

    def varint(n: int) -> bytes:
        return bytes([n & 127 | 128]) + varint(n >> 7) if n > 127 else bytes([n])

    return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


def with_normalizer(model: bytes, **options: bytes | int) -> bytes:
    """A serialised model with another normaliser."""
    numbers = {"charsmap": 2, "dummy_prefix": 3, "squeeze": 4, "escape": 5}
    spec = b"".join(_field(numbers[k], v) for k, v in options.items())
    out, i = [], 0
    while i < len(model):
        key, after = _varint(model, i)
        n, after = _varint(model, after)  # all fields of a model are messages
        if key >> 3 != 3:
            out.append(model[i : after + n])
        i = after + n
    return b"".join(out) + _field(3, spec)


class CharMap:
    """A compiled character map: a trie from byte sequences to their replacements."""

    def __init__(self, blob: bytes):
        self.units, self.texts = np.empty(0, np.uint32), b""
        if blob:
            (n,) = struct.unpack_from("<I", blob)
            self.units, self.texts = np.frombuffer(blob[4 : 4 + n], "<u4"), blob[4 + n :]

    def __bool__(self) -> bool:
        return len(self.units) > 0

    def begins(self, byte: int) -> bool:
        """Whether keys begin with a byte."""
        unit = int(self.units[0])
        node = (unit >> 10) << ((unit & 512) >> 6) ^ byte
        return node < len(self.units) and int(self.units[node]) & 0x800000FF == byte

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest key that ``data`` has at ``at``."""
        found, unit = None, int(self.units[0])
        node = (unit >> 10) << ((unit & 512) >> 6)
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(self.units):
                break
            unit = int(self.units[node])
            if unit & 0x800000FF != data[k]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                start = int(self.units[node]) & 0x7FFFFFFF
                found = k + 1 - at, self.texts[start : self.texts.index(b"\0", start)]
        return found


class Normalizer:
    """The model's normalisation with its alignment."""

    def __init__(self, blob: bytes = b"", dummy_prefix: bool = True, squeeze: bool = True, escape: bool = True, suffix: bool = False, symbols: tuple[bytes, ...] = ()):
        self.map, self.dummy_prefix, self.squeeze, self.suffix = CharMap(blob), dummy_prefix, squeeze, suffix
        self.space = MARK if escape else b" "
        self.symbols = re.compile(b"|".join(map(re.escape, sorted(symbols, key=len, reverse=True)))) if symbols else None
        #: Whether a byte may begin a key of the map or a symbol.
        self.first = np.zeros(256, bool)
        self.first[[x[0] for x in symbols]] = True
        if self.map:
            self.first |= [self.map.begins(k) for k in range(256)]

    def _replaced(self, data: bytes, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The text after the map, the original character of each byte, and whether a space stands only behind spaces of its replacement."""
        origin = np.arange(len(raw))
        start = (raw & 0xC0) != 0x80
        if raw.max() > 127:
            origin = np.maximum.accumulate(np.where(start, origin, 0))
        special = np.flatnonzero(self.first[raw] & start) if self.first.any() else []
        if not len(special):
            return raw, origin, np.ones(len(raw), bool) if self.squeeze else start
        parts, at = [], 0
        for k in special.tolist():
            if k < at:
                continue
            symbol = self.symbols.match(data, k) if self.symbols else None
            found = (len(symbol[0]), symbol[0]) if symbol else self.map.longest(data, k) if self.map else None
            if found:
                own, lead = np.frombuffer(found[1], np.uint8), len(found[1]) - len(found[1].lstrip(b" "))
                parts.append((raw[at:k], origin[at:k], np.ones(k - at, bool)))
                parts.append((own, np.full(len(own), k), np.arange(len(own)) < lead))
                at = k + found[0]
        parts.append((raw[at:], origin[at:], np.ones(len(raw) - at, bool)))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def __call__(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each of them and the end the original offset."""
        if not data:
            return b"", np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8)
        out, origin, lead = self._replaced(data, raw)
        blank = out == 0x20
        if out is raw and not self.squeeze and not self.suffix:  # every byte stands for itself, and a space for its mark
            lead = len(self.space) if self.dummy_prefix else 0
            times = blank * np.int8(len(self.space) - 1) + np.int8(1)
            return self.space[:lead] + data.replace(b" ", self.space), np.concatenate([np.zeros(lead, np.int64), np.repeat(origin, times), [len(data)]])
        end = len(data)
        if self.squeeze:
            kept = ~(blank & lead & np.r_[True, blank[:-1]])
            out, origin, blank = out[kept], origin[kept], blank[kept]
            if not len(out):
                return b"", np.full(1, end)
        begin = int(origin[0]) if len(origin) else 0
        if len(self.space) > 1:
            times = np.where(blank, len(self.space), 1)
            out, origin, blank = np.repeat(out, times), np.repeat(origin, times), np.repeat(blank, times)
            out[blank] = np.tile(np.frombuffer(self.space, np.uint8), int(blank.sum()) // len(self.space))
        text = out.tobytes()
        if self.dummy_prefix and not self.suffix:
            text, origin = self.space + text, np.r_[np.full(len(self.space), begin), origin]
        if self.squeeze:
            while text.endswith(self.space):
                text = text[: -len(self.space)]
                end = int(origin[len(text)])
            origin = origin[: len(text)]
        if self.dummy_prefix and self.suffix:
            text, origin = text + self.space, np.r_[origin, np.full(len(self.space), end)]
        return text, np.r_[origin, end]


class Codec:
    """A loaded model."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        #: Encodes what is normalised.
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=with_normalizer(model, dummy_prefix=0, squeeze=0, escape=0))
        options, training, symbols = {3: 1, 4: 1, 5: 1}, {}, []
        for number, value in _fields(model):
            if number == 1 and (piece := dict(_fields(value))).get(3) == 4:
                symbols.append(piece[1])
            elif number == 2:
                training = dict(_fields(value))
            elif number == 3:
                options |= dict(_fields(value))
        flags = [bool(options[k]) for k in (3, 4, 5)]
        self.normalize = Normalizer(options.get(2, b""), *flags, bool(training.get(24, 0)), tuple(symbols))
        size = self.lib.get_piece_size()
        pieces = [self.lib.id_to_piece(k) for k in range(size)]
        #: Bytes of the normalised text that a piece covers.
        self.width = np.array([1 if self.lib.is_byte(k) else len(p.encode()) for k, p in enumerate(pieces)])
        self.unknown = self.lib.unk_id()
        self.by_part = self.lib.piece_to_id(SPACE) != self.unknown and not any(re.search(rf"[^{SPACE}]{SPACE}", p) for p in pieces)
        self.decimal = [str(k) for k in range(size)]
        self.parts: dict[bytes, list[int]] = {}

    def _encode(self, texts: list[bytes]) -> list[list[int]]:
        """The ids of normalised texts."""
        if not self.by_part:
            return self.plain.encode([t.decode() for t in texts], num_threads=1)
        cut = [_cut(t) for t in texts]
        every = set(chain.from_iterable(cut))
        missing = [p for p in every if p not in self.parts]
        if len(self.parts) + len(missing) > CACHE_PARTS:
            self.parts.clear()
            missing = list(every)
        whole = [(p[1:] if p[:1] == _ODD else MARK + p).decode() for p in missing]
        self.parts.update(zip(missing, self.plain.encode(whole, num_threads=1), strict=True))
        return [list(chain.from_iterable(map(self.parts.__getitem__, parts))) for parts in cut]

    def encode(self, texts: list[str]) -> list[tuple[list[int], np.ndarray]]:
        """The ids of each text, and the offsets in its bytes at which their spans begin, with that at which the last one ends."""
        found = [self.normalize(t.encode()) for t in texts]
        return [(ids, self._bounds(ids, *own)) for ids, own in zip(self._encode([t for t, _ in found]), found, strict=True)]

    def _bounds(self, ids: list[int], text: bytes, origin: np.ndarray) -> np.ndarray:
        ends = np.zeros(len(ids) + 1, np.int64)
        if self.unknown in ids:  # the library alone knows how long they are
            own = self.plain.encode(text.decode(), return_type="proto").pieces
            np.cumsum([len(p.piece.encode()) if p.id == self.unknown else self.width[p.id] for p in own], out=ends[1:])
        elif ids:
            np.cumsum(self.width[np.fromiter(ids, np.int32, len(ids))], out=ends[1:])
        return origin[ends]

    def joined(self, ids: list[int]) -> str:
        return ",".join(map(self.decimal.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.lib.decode(ids) if ids else ""


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        with open(path, "rb") as f:
            _codecs[path] = Codec(f.read())
    return _codecs[path]


def with_pieces(df: DataFrame, path: str, text: str = "text", digests_only: bool = False) -> DataFrame:
    """Adds ``pieces``: ids, bounds (where the pieces' spans begin, and where the last one ends), the decoded text and digests.

    digests_only leaves the arrays and the decoded text out of what is sent back: n_tokens, ids_sha256,
    decoded_sha256, and span_bytes, the end of the last span.
    """
    kind = "n_tokens long, ids_sha256 string, decoded_sha256 string, span_bytes long"
    kind = f"struct<{', '.join(x.replace(' ', ':') for x in kind.split(', '))}"
    kind += ">" if digests_only else ",ids:array<int>,bounds:array<int>,decoded:string>"

    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.DataFrame:
        model, rows = codec(path), []
        for k in range(0, len(texts), TEXTS):
            with without_gc():
                encoded = model.encode([t or "" for t in texts.iloc[k : k + TEXTS]])
            for ids, bounds in encoded:
                decoded = model.decode(ids)
                row = (len(ids), hashlib.sha256(model.joined(ids).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), int(bounds[-1]))
                rows.append(row if digests_only else (*row, ids, bounds, decoded))
        give_back()
        names = ["n_tokens", "ids_sha256", "decoded_sha256", "span_bytes"]
        return pd.DataFrame(rows, columns=names + ([] if digests_only else ["ids", "bounds", "decoded"]))

    return df.withColumn("pieces", run(F.col(text)))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    pieces = with_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"), digests_only=True).select("doc_id", "pieces.*")
    with small_batches(spark):
        return stored(pieces, "pieces")
