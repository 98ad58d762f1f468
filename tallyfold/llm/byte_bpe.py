"""Byte-level BPE encoding and decoding.

The tokenizers library is given the ranks of a tiktoken file: every rank is a
merge, for each way to cut its bytes into two ranked parts. Texts reach it in
Arrow batches, one distinct pattern run at a time; runs are remembered per worker.
A run here is non-space characters with at most one space before them, or white
space: the split pattern never matches across such a border, so encoding run by
run gives the ids of the whole text.

Byte-level ids lose nothing: decoding reverses the byte table. A token may end
inside a character; decoding joins bytes first and only then reads characters.
Offsets are byte ranges, mapped to the characters that they touch, so the parts of
a split character all report that character.

Defined cases: null and empty texts give no ids; any id (null, repeated) is carried along.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm.common import columns, documents, small_batches, texts_of
from tallyfold.llm.runs import WHITE_SPACE, RunEncoder

#: Runs, and letter cores, that a worker remembers before it starts afresh.
CACHE_RUNS, CACHE_CORES = 250_000, 200_000
RANK_FILE = "byte_bpe_multi_50k.tiktoken"
_RUNS = re.compile(f" ?[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+(?![^{WHITE_SPACE}])|[{WHITE_SPACE}]+")


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself if printable, else one from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in set(printable) else chr(next(others)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class ByteBpe(RunEncoder):
    """Encoder and decoder over one rank file."""

    def __init__(self, rank_path: str):
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks = read_ranks(rank_path)
        char = byte_alphabet()
        name = {b: "".join(char[x] for x in b) for b in ranks}
        merges = [
            (name[b[:i]], name[b[i:]])
            for b, _ in sorted(ranks.items(), key=lambda x: x[1])
            for i in range(1, len(b))
            if b[:i] in ranks and b[i:] in ranks
        ]
        tokenizer = Tokenizer(models.BPE({name[b]: r for b, r in ranks.items()}, merges, ignore_merges=True))
        tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
            [
                pre_tokenizers.Split(Regex(public_tokenizers.PATTERN), "isolated"),
                pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
            ]
        )
        self.bytes_of = {r: b for b, r in ranks.items()}
        super().__init__(tokenizer, cache_runs=CACHE_RUNS, cache_cores=CACHE_CORES)

    def encode(self, text: str) -> np.ndarray:
        return self.encode_runs(_RUNS.findall(text))

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> str:
        """Text of any id range; a character cut at either end becomes U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", errors="replace")

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) characters touched by each id, end exclusive."""
        raw = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
        char_at = np.cumsum((raw & 0xC0) != 0x80) - 1
        ends = np.cumsum([len(self.bytes_of[i]) for i in ids.tolist()], dtype=np.int64)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
        return char_at[starts], (char_at[ends - 1] + 1 if len(ends) else ends)


_LOADED: dict[str, ByteBpe] = {}


def byte_bpe(rank_path: str) -> ByteBpe:
    if rank_path not in _LOADED:
        _LOADED[rank_path] = ByteBpe(rank_path)
    return _LOADED[rank_path]


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rank_path: str | None = None, with_offsets: bool = False) -> DataFrame:
    """One row per document: ``doc_id, ids`` and, if asked for, ``starts, ends`` in characters."""
    path = rank_path or public_tokenizers.path(RANK_FILE)
    schema = "doc_id long, ids array<int>" + (", starts array<int>, ends array<int>" if with_offsets else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, kind = byte_bpe(path), pa.list_(pa.int32())
        for b in small_batches(batches):
            texts = texts_of(b.column(1))
            ids = [bpe.encode(t) for t in texts]
            out = [b.column(0), pa.array([x.astype(np.int32) for x in ids], kind)]
            if with_offsets:
                both = [bpe.offsets(t, x) for t, x in zip(texts, ids, strict=True)]
                out += [pa.array([o[k].astype(np.int32) for o in both], kind) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "ids", "starts", "ends"][: len(out)])
        bpe.forget()

    return columns(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, schema)


def decode(encoded: DataFrame, *, rank_path: str | None = None) -> DataFrame:
    """``doc_id, ids`` back to ``doc_id, text``; the inverse of :func:`encode`."""
    path = rank_path or public_tokenizers.path(RANK_FILE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        for b in batches:
            texts = [None if x is None else bpe.decode(np.array(x, dtype="<u4")) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rank_path: str | None = None) -> DataFrame:
    """Encode, decode the ids again, and digest both: no ids leave the worker."""
    path = rank_path or public_tokenizers.path(RANK_FILE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        for b in small_batches(batches):
            n, ids_sha, text_sha = [], [], []
            for text in texts_of(b.column(1)):
                ids = bpe.encode(text)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        bpe.forget()

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return columns(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, schema)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE of every whole text, and back."""
    return digests(documents(spark, sf_dir))
