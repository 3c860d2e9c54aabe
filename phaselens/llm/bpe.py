"""Byte-level BPE encoding and decoding through a sentencepiece model.

The rank file is serialised straight into a sentencepiece BPE model (the
protobuf wire format is written by hand; nothing is trained): every
vocabulary entry becomes a piece whose bytes are written with the printable
byte alphabet of byte-level BPE, scored by its negative rank, under identity
normalisation. Sentencepiece then merges by best score, leftmost first,
which is the rank order. Texts are cut by the split pattern; each distinct
pre-token is encoded once per cache life; a pre-token that is itself a
vocabulary entry is that entry, as the rank-file convention says. Decoding
is the inverse mapping id -> bytes.

Input cases: a null text is the empty text (no ids, hash of nothing); a
very long text is handled one pre-token at a time; null ids, repeated rows
and extra columns pass through; an empty table gives an empty result."""

from __future__ import annotations

import base64
import hashlib
import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from phaselens.llm.textops import small_batches, text_buffers

DEFAULT_VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Distinct pre-tokens in one cache generation of a Python worker; two generations
#: are kept, so its memory is bounded. Results do not depend on it.
CACHE_ENTRIES = 100_000
#: Texts split at a time: as many as hold about this many code points.
BATCH_CHARS = 2_000_000


def byte_alphabet() -> list[str]:
    """One printable character per byte: printable Latin-1 bytes stand for
    themselves, the others take the code points from 256 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in own}
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + len(table) - len(own))
    return [table[b] for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Vocabulary bytes by rank from a ``base64 rank`` file."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


def _varint(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def _flag(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def sentencepiece_model(vocabulary: list[bytes]) -> bytes:
    """A serialised sentencepiece ``ModelProto`` whose piece i is rank i; the
    unknown piece follows the vocabulary and is never produced, as all 256
    bytes are pieces."""
    alphabet = byte_alphabet()
    parts = []
    for rank, token in enumerate(vocabulary):
        piece = "".join(alphabet[b] for b in token).encode()
        parts.append(_field(1, _field(1, piece) + b"\x15" + struct.pack("<f", -float(rank))))
    unk = len(vocabulary)
    parts.append(_field(1, _field(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _flag(3, 2)))
    # trainer spec: model type BPE, vocabulary size, unk id, no bos / eos / pad
    minus = (1 << 64) - 1
    trainer = (_flag(3, 2) + _flag(4, unk + 1) + _flag(40, unk) + _flag(41, minus) + _flag(42, minus)
               + _flag(43, minus))
    # normaliser: identity, no dummy prefix, white space kept and not escaped
    normalizer = _field(1, b"identity") + _flag(3, 0) + _flag(4, 0) + _flag(5, 0)
    return b"".join(parts) + _field(2, trainer) + _field(3, normalizer)


class ByteBPE:
    """Encoder and decoder for one vocabulary and split pattern."""

    def __init__(self, vocabulary: list[bytes], pattern: str, cache_entries: int = CACHE_ENTRIES):
        import regex
        import sentencepiece

        self.vocabulary = vocabulary
        # \s as a Unicode property: the separators U+001C to U+001F are not white space here
        self.find = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(
            r"\S", r"\P{White_Space}")).findall
        self.by_bytes = {t: i for i, t in enumerate(vocabulary)}
        self.table = str.maketrans({chr(b): c for b, c in enumerate(byte_alphabet())})
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(vocabulary))
        # pre-token -> its ids as int32 bytes: flat values, nothing for the garbage collector
        self.ids: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # decimal digits of each id and a comma, padded with zero bytes
        width = len(str(len(vocabulary))) + 1
        self.digits = np.array([f"{i}," for i in range(len(vocabulary))], dtype=f"S{width}")
        self.digits = self.digits.view(np.uint8).reshape(len(vocabulary), width)
        self.cache_entries = cache_entries

    def _learn(self, tokens: list[str]) -> None:
        """Encode pre-tokens that no cache generation holds."""
        ids, rest, mapped = self.ids, [], []
        for t in tokens:
            raw = t.encode()
            if (i := self.by_bytes.get(raw)) is not None:
                ids[t] = i.to_bytes(4, "little")
            else:
                rest.append(t)
                mapped.append(raw.decode("latin-1").translate(self.table))
        for t, found in zip(rest, self.sp.encode(mapped, num_threads=1)):
            ids[t] = struct.pack(f"<{len(found)}i", *found)

    def encode_batch(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, str]]:
        """For each text its ids, and SHA-256 of their decimal forms joined by
        commas. Pre-tokens new to the worker are encoded in one call."""
        split = [self.find(t) if t else [] for t in texts]
        missing = set().union(*split).difference(self.ids)
        if len(self.ids) + len(missing) > self.cache_entries:
            self.older, self.ids = self.ids, {}
            missing = set().union(*split)
        for t in missing.intersection(self.older):
            self.ids[t] = self.older[t]
            missing.discard(t)
        if missing:
            self._learn(list(missing))
        for tokens in split:
            ids = np.frombuffer(b"".join(map(self.ids.__getitem__, tokens)), dtype="<i4")
            yield ids, hashlib.sha256(self.decimal(ids)).hexdigest()

    def decimal(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by commas."""
        flat = self.digits[ids].ravel()
        return flat[flat != 0][:-1].tobytes()

    def forget(self) -> None:
        """Empty the caches."""
        self.ids, self.older = {}, {}

    def encode(self, text: str | None) -> list[int]:
        return next(iter(self.encode_batch([text])))[0].tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def slices(batch: pa.RecordBatch, text_at: int = 1) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``BATCH_CHARS`` bytes of text."""
    offsets = text_buffers(batch.column(text_at))[1]
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[at] + BATCH_CHARS, side="right")) - 1
        end = min(max(end, at + 1), batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


_LOADED: dict[tuple[str, str], ByteBPE] = {}


def tokenizer(path: str, pattern: str) -> ByteBPE:
    """One tokenizer per Python worker and vocabulary."""
    key = (os.path.abspath(path), pattern)
    if key not in _LOADED:
        _LOADED[key] = ByteBPE(read_ranks(path), pattern)
    return _LOADED[key]


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                     vocabulary: str | None = None, pattern: str | None = None,
                     with_ids: bool = True) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_tokens``, ``ids_sha256``,
    ``decoded_sha256`` and, with ``with_ids``, ``ids`` (array<int>).

    A narrow map over the scan: no shuffle, and only two columns are read.
    ``vocabulary`` is the path of a rank file that every executor can read
    (default: the installed public vocabulary)."""
    import public_tokenizers

    pattern = pattern or public_tokenizers.PATTERN
    id_type = docs.schema[id_col].dataType
    fields = [T.StructField("doc_id", id_type), T.StructField("n_tokens", T.LongType()),
              T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(vocabulary or vocabulary_path(), pattern)
        for batch in batches:
            for part in slices(batch):
                n, sha, back, kept = [], [], [], []
                for ids, digest in bpe.encode_batch(part.column(1).to_pylist()):
                    n.append(len(ids))
                    sha.append(digest)
                    back.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                    if with_ids:
                        kept.append(pa.array(ids))
                cols = [part.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())]
                if with_ids:
                    ends = np.cumsum([0, *n])
                    cols.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(kept)))
                yield pa.RecordBatch.from_arrays(cols, [f.name for f in fields])
        bpe.forget()  # the worker lives on for other tasks

    return small_batches(docs).select(id_col, text_col).mapInArrow(run, T.StructType(fields))
