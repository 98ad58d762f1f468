"""Token-id files of directly addressable codes (DAC).

A token id is cut into chunks of ``CHUNK_BITS`` bits. Level 0 holds the lowest
chunk of every token; level k + 1 holds the next chunk of those tokens whose
continuation bit is set on level k. A rank directory over every continuation
bitmap turns a position on one level into the position on the next one, so
token i is read with a few small reads and no block is ever decoded.

File: header, document ids, null marks, document starts, then per level the
chunks, the bitmap and the rank directory. Files are written inside Spark tasks
in ascending document order, each under an attempt-unique name that is moved in
place, so a repeated task replaces its own file with the same bytes.

Defined cases: a null text is the empty text (only the end id is written); a null
id sorts first and stays null; repeated rows are written once each; equal ids are
ordered by a hash of the text, then by the text; an empty table writes no file.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyfold.llm.common import columns, documents, open_fs, staged, texts_of
from tallyfold.llm.runs import WHITE_SPACE, RunEncoder
from tallyfold.session import scratch_path

MAGIC = b"TLYDAC01"
CHUNK_BITS = 8
RANK_BLOCK = 512  # bits per rank directory entry
END_ID = 2
#: A file is closed once it holds this many tokens; one document is never split.
FILE_TOKENS = 8_000_000
#: Words, and letter cores, that a worker remembers before it starts afresh.
CACHE_RUNS, CACHE_CORES = 1_000_000, 700_000
WORD_VOCAB = "word_bpe_49k.json"


# White space as the vocabulary's normaliser means it (Unicode White_Space).
_WORDS = re.compile(f"[^{WHITE_SPACE}]+")
_PYTHON_ONLY_SPACE = "\x1c\x1d\x1e\x1f"
#: Words of letters that the library gets as one text.
_JOINED = 64


class WordEncoder(RunEncoder):
    """Whole texts through the tokenizers library, one distinct word at a time.

    The vocabulary's normaliser and splitter never look across white space, and
    white space itself gives no id, so a text's ids are its words' ids joined. The
    vocabulary is of lower case. As the library does it, a special token that a text spells out, letter
    by letter, becomes its id, and what stands before and after it is encoded apart; in other case it is ordinary text.
    """

    def __init__(self, vocab_path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocab_path)
        self._special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items() if t.special}
        self._spelled = re.compile("(" + "|".join(map(re.escape, sorted(self._special, key=len, reverse=True))) + ")") if self._special else None
        # They are cut out before; a run that spells one only in lower case is none.
        tokenizer.encode_special_tokens = True
        self._with_places = tokenizer.encode_batch
        super().__init__(tokenizer, cache_runs=CACHE_RUNS, cache_cores=CACHE_CORES)

    def core_key(self, core: str) -> str:
        low = core.lower()
        if core.isascii():
            return low
        return low if "\u03a3" not in core and low.isalpha() and unicodedata.is_normalized("NFC", core) else core

    def encode_each(self, pieces: list[str]) -> list[bytes]:
        """Words of letters go to the library many at a time, with spaces between; each is one word of its splitter's."""
        words = [p for p in pieces if p.isalpha()]
        groups = [words[at : at + _JOINED] for at in range(0, len(words), _JOINED)]
        ids: dict[str, bytes] = {}
        for group, e in zip(groups, self._with_places([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            word = e.word_ids
            if word and word[-1] == len(group) - 1:  # else the splitter cuts one of them
                cuts = (4 * np.searchsorted(word, np.arange(len(group) + 1))).tolist()
                data = array("I", e.ids).tobytes()
                ids.update(zip(group, [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], strict=True))
        others = [p for p in pieces if p not in ids]
        ids.update(zip(others, super().encode_each(others), strict=True))
        return [ids[p] for p in pieces]

    def encode(self, text: str) -> np.ndarray:
        if self._spelled is None or not self._spelled.search(text):
            return self._plain(text)
        parts = self._spelled.split(text)
        return np.concatenate([np.array([self._special[p]], dtype="<u4") if i % 2 else self._plain(p) for i, p in enumerate(parts)])

    def _plain(self, text: str) -> np.ndarray:
        if text.isascii():
            text = text.lower()
        return self.encode_runs(_WORDS.findall(text) if any(c in text for c in _PYTHON_ONLY_SPACE) else text.split())


_ENCODERS: dict[str, WordEncoder] = {}


def word_encoder(vocab_path: str) -> WordEncoder:
    if vocab_path not in _ENCODERS:
        _ENCODERS[vocab_path] = WordEncoder(vocab_path)
    return _ENCODERS[vocab_path]


def dac_levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunks, packed continuation bitmap, rank directory) per level; at least one level."""
    rest, out = np.ascontiguousarray(ids, dtype=np.uint32), []
    while True:
        more = rest >> CHUNK_BITS
        goes_on = more > 0
        starts = np.arange(0, len(rest), RANK_BLOCK)
        counts = np.add.reduceat(goes_on, starts, dtype=np.uint64) if len(rest) else np.zeros(0, np.uint64)
        ranks = np.concatenate([np.zeros(1, np.uint64), np.cumsum(counts, dtype=np.uint64)])
        out.append(((rest & ((1 << CHUNK_BITS) - 1)).astype(np.uint8), np.packbits(goes_on, bitorder="little"), ranks))
        rest = more[goes_on]
        if not len(rest):
            return out


def dac_bytes(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """One whole file."""
    levels = dac_levels(ids)
    starts = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]).astype("<i8")
    sections = [
        np.array([0 if d is None else d for d in doc_ids], dtype="<i8").tobytes(),
        np.array([d is None for d in doc_ids], dtype=np.uint8).tobytes(),
        starts.tobytes(),
    ]
    for chunks, bits, ranks in levels:
        sections += [chunks.tobytes(), bits.tobytes(), ranks.astype("<u8").tobytes()]
    head_size = len(MAGIC) + 4 * 3 + 8 * 2 + 16 * len(sections)
    table, at = b"", head_size
    for s in sections:
        table += struct.pack("<QQ", at, len(s))
        at += len(s)
    head = MAGIC + struct.pack("<IIIQQ", CHUNK_BITS, RANK_BLOCK, len(levels), len(doc_ids), len(ids)) + table
    return b"".join([head, *sections])


class DacFile:
    """Random access to one file; only the header and the bytes asked for are read."""

    def __init__(self, path: str):
        fs, p = open_fs(path)
        self._file = fs.open_input_file(p)
        fixed = self._file.read_at(len(MAGIC) + 28, 0)
        if fixed[: len(MAGIC)] != MAGIC:
            raise ValueError(f"not a token file: {path}")
        bits, self._block, self.n_levels, self.n_docs, self.n_tokens = struct.unpack("<IIIQQ", fixed[len(MAGIC) :])
        if bits != CHUNK_BITS:
            raise ValueError(f"chunks of {bits} bits are not supported")
        n = 3 + 3 * self.n_levels
        raw = self._file.read_at(16 * n, len(MAGIC) + 28)
        self._at = [struct.unpack_from("<QQ", raw, 16 * i) for i in range(n)]

    def _read(self, section: int, first: int, n: int) -> bytes:
        off, size = self._at[section]
        return self._file.read_at(max(0, min(n, size - first)), off + first)

    def doc_ids(self) -> list[int | None]:
        ids = np.frombuffer(self._read(0, 0, self._at[0][1]), dtype="<i8")
        null = np.frombuffer(self._read(1, 0, self._at[1][1]), dtype=np.uint8)
        return [None if z else int(d) for d, z in zip(ids, null, strict=True)]

    def starts(self) -> np.ndarray:
        return np.frombuffer(self._read(2, 0, self._at[2][1]), dtype="<i8")

    def _rank(self, level: int, i: int) -> int:
        """Continuation bits set before position i."""
        block = i // self._block
        before = struct.unpack("<Q", self._read(5 + 3 * level, 8 * block, 8))[0]
        first = block * self._block // 8
        bits = np.unpackbits(np.frombuffer(self._read(4 + 3 * level, first, i // 8 - first + 1), dtype=np.uint8), bitorder="little")
        return before + int(bits[: i - block * self._block].sum())

    def get(self, i: int) -> int:
        """Token i: one chunk, one bit and one rank per level."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = 0
        for level in range(self.n_levels):
            value |= self._read(3 + 3 * level, i, 1)[0] << (CHUNK_BITS * level)
            if not self._read(4 + 3 * level, i // 8, 1)[0] >> (i % 8) & 1:
                break
            i = self._rank(level, i)
        return value

    def slice(self, i: int, j: int) -> np.ndarray:
        """Tokens i to j: a range on one level is a range on the next."""
        out = np.zeros(max(0, j - i), dtype="<u4")
        where = np.arange(len(out))
        for level in range(self.n_levels):
            if j <= i:
                break
            out[where] |= np.frombuffer(self._read(3 + 3 * level, i, j - i), dtype=np.uint8).astype("<u4") << np.uint32(CHUNK_BITS * level)
            raw = np.frombuffer(self._read(4 + 3 * level, i // 8, (j - 1) // 8 - i // 8 + 1), dtype=np.uint8)
            goes_on = np.unpackbits(raw, bitorder="little")[i % 8 : i % 8 + j - i].astype(bool)
            where = where[goes_on]
            i = self._rank(level, i)
            j = i + len(where)
        return out

    def close(self) -> None:
        self._file.close()


_MANIFEST = "part int, seq int, path string, n_docs long, n_tokens long"


def write_token_files(
    docs: DataFrame, root: str, *, id_col: str = "doc_id", text_col: str = "text", vocab_path: str | None = None, end_id: int = END_ID
) -> DataFrame:
    """Encode and write all documents in ascending id order; returns the manifest.

    One range shuffle of the texts; every task encodes its range in order and closes
    a file whenever it holds FILE_TOKENS, so memory does not follow the input.
    Manifest: ``path, n_docs, n_tokens, start`` (tokens of all files before it).
    """
    vocab = vocab_path or public_tokenizers.path(WORD_VOCAB)
    h = F.xxhash64("text")
    ordered = columns(docs, id=id_col, text=text_col).select(F.col("id").cast("bigint").alias("id"), "text")
    ordered = ordered.repartitionByRange(F.col("id").asc_nulls_first(), h).sortWithinPartitions(F.col("id").asc_nulls_first(), h, "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = word_encoder(vocab), TaskContext.get().partitionId()
        fs, base = open_fs(root)
        fs.create_dir(base, recursive=True)
        end = np.array([end_id], dtype="<u4")
        state: dict = {"ids": [], "docs": [], "lens": [], "n": 0, "seq": 0}

        def close() -> pa.RecordBatch:
            name = f"part-{part:06d}-{state['seq']:05d}.dac"
            temp = f"{base}/.{name}-{uuid.uuid4().hex}"
            with fs.open_output_stream(temp) as f:
                f.write(dac_bytes(state["docs"], state["lens"], np.concatenate(state["ids"])))
            fs.move(temp, f"{base}/{name}")
            row = [part, state["seq"], f"{root}/{name}", len(state["docs"]), state["n"]]
            state.update(ids=[], docs=[], lens=[], n=0, seq=state["seq"] + 1)
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)],
                ["part", "seq", "path", "n_docs", "n_tokens"],
            )

        for b in batches:
            for d, text in zip(b.column(0).to_pylist(), texts_of(b.column(1)), strict=True):
                ids = encoder.encode(text)
                state["ids"] += [ids, end]
                state["docs"].append(d)
                state["lens"].append(len(ids) + 1)
                state["n"] += len(ids) + 1
                if state["n"] >= FILE_TOKENS:
                    yield close()
        if state["docs"]:
            yield close()

    files = staged(ordered.mapInArrow(write, _MANIFEST), "token-manifest")
    # One row per file: the only ordered sum is over file totals, not documents.
    upto = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return files.select("path", "n_docs", "n_tokens", F.coalesce(F.sum("n_tokens").over(upto), F.lit(0)).alias("start"))


def read_token_files(manifest: DataFrame, *, block_tokens: int = 1_000_000) -> DataFrame:
    """Per document, read from the files: doc_id, start, n_tokens, ids_crc32 and the file."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, path string"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                f = DacFile(path)
                doc_ids, starts, d = f.doc_ids(), f.starts(), 0
                while d < f.n_docs:
                    e = max(d + 1, int(np.searchsorted(starts, starts[d] + block_tokens, side="right")) - 1)
                    ids = f.slice(int(starts[d]), int(starts[e]))
                    cuts = starts[d : e + 1] - starts[d]
                    crcs = [zlib.crc32(ids[x:y].tobytes()) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(doc_ids[d:e], pa.int64()),
                            pa.array(starts[d:e] + first, pa.int64()),
                            pa.array(np.diff(cuts), pa.int64()),
                            pa.array(crcs, pa.int64()),
                            pa.array([path] * (e - d), pa.string()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids_crc32", "path"],
                    )
                    d = e
                f.close()

    spread = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path", "start").repartition(spread, "path").mapInArrow(read, schema)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directly addressable token files of ``documents``, read back per document."""
    root = scratch_path(spark, "token-files")
    manifest = write_token_files(documents(spark, sf_dir), root)
    return read_token_files(manifest).select("doc_id", "start", "n_tokens", "ids_crc32")
