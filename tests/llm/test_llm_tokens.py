import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from helpers_llm import by_id, documents, words
from tokenizers import Tokenizer

from tallyfold.llm import byte_bpe, token_files
from tallyfold.llm.byte_bpe import ByteBpe, read_ranks
from tallyfold.llm.token_files import DacFile, dac_bytes, read_token_files, write_token_files
from tallyfold.session import scratch_path

HARD = [
    "", " ", "  a  b\n\n\nc \t d", "don't we'll I'M x's 'tis", "é à İstanbul ΑΣ ΣΑΣ", "J̌ é ́ ab̈,", "😀👩‍👩‍👧 日本語テキスト",
    "a\x1cb\x1f c\x85d e　f​g", "1234567 12,345.67 ½²Ⅷ", "<|endoftext|> <|startoftext|>x", "A<|endoftext|>B <|ENDOFTEXT|> don<|startoftext|>'t word's<|endoftext|>'s <|endoftext", "é<|startoftext|>\u0301a Σ<|endoftext|><|endoftext|>",
    "word,word;word!! (word) *** $$$%%%", "\r\n\r\n x\r", "_a_b_ ªº", "\x00\x01 ",
]


def texts(n=60):
    rng = random.Random(3)
    out = list(HARD)
    for k in range(n):
        out.append(" ".join(rng.choice(HARD + words(5, k)) for _ in range(rng.randint(0, 30))))
    return out


def test_word_ids_match_the_library_on_whole_texts():
    own = token_files.word_encoder(public_tokenizers.path("word_bpe_49k.json"))
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for t in texts():
        assert own.encode(t).tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)


def test_byte_ids_match_tiktoken_and_decode():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    own = ByteBpe(path)
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})
    for t in texts():
        ids = own.encode(t)
        assert ids.tolist() == other.encode_ordinary(t), repr(t)
        assert own.decode(ids) == t
        starts, ends = own.offsets(t, ids)
        for i, s, e in zip(ids.tolist(), starts.tolist(), ends.tolist(), strict=True):
            assert own.bytes_of[i] in t[s:e].encode()


def test_split_characters_decode_in_parts():
    own = ByteBpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    ids = own.encode("𓀀")
    assert len(ids) > 1 and own.decode(ids) == "𓀀" and "�" in own.decode(ids[:1])


def test_cache_limits_change_nothing(monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE_RUNS", 20)
    monkeypatch.setattr(byte_bpe, "CACHE_CORES", 10)
    test_byte_ids_match_tiktoken_and_decode()


@pytest.mark.parametrize("n", [0, 1, 7, 511, 512, 513, 5000])
def test_dac_random_access(tmp_path, n):
    rng = np.random.default_rng(n)
    ids = rng.choice(np.array([0, 1, 255, 256, 65535, 65536, 49407, 2**24, 2**32 - 1], dtype=np.uint32), n)
    (tmp_path / "x.dac").write_bytes(dac_bytes([5, None], [n // 2, n - n // 2], ids))
    f = DacFile(str(tmp_path / "x.dac"))
    assert f.doc_ids() == [5, None] and f.starts().tolist() == [0, n // 2, n]
    assert [f.get(i) for i in range(0, n, max(1, n // 50))] == ids[:: max(1, n // 50)].tolist()
    for _ in range(20):
        i, j = sorted(rng.integers(0, n + 1, 2).tolist())
        assert f.slice(i, j).tolist() == ids[i:j].tolist()
    with pytest.raises(IndexError):
        f.get(n)


def test_files_are_in_id_order_and_read_back(spark, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_TOKENS", 200)
    rows = [(i * 7 % 83, t) for i, t in enumerate(texts(60))] + [(None, "null id"), (1000, None), (1000, None)]
    docs = documents(spark, rows, extra=["start", "path", "id"])
    manifest = write_token_files(docs, scratch_path(spark, "t"))
    got = read_token_files(manifest, block_tokens=100).orderBy("start").collect()
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start = 0
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d))
    by = {r[0]: r[1] for r in rows}
    for r in got:
        ids = whole.encode(by[r.doc_id] or "", add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)
    assert manifest.count() > 3


def test_empty_tables_and_long_texts(spark):
    empty = documents(spark, [])
    assert read_token_files(write_token_files(empty, scratch_path(spark, "t"))).count() == 0
    assert byte_bpe.digests(empty).count() == 0
    long = "x" * 3000 + " " + " ".join(words(100_000, 1))
    r = by_id(byte_bpe.digests(documents(spark, [(1, long), (2, None), (None, "a")])))
    assert r[1]["decoded_sha256"] == hashlib.sha256(long.encode()).hexdigest()
    assert r[2]["n_tokens"] == 0 and r[None]["n_tokens"] == 1


def test_encode_decode_tables(spark):
    docs = documents(spark, [(i, t) for i, t in enumerate(HARD)])
    enc = byte_bpe.encode(docs, with_offsets=True)
    assert {r.doc_id: r.text for r in byte_bpe.decode(enc).collect()} == dict(enumerate(HARD))


def test_words_of_letters_go_to_the_library_many_at_a_time():
    from array import array

    path = public_tokenizers.path(token_files.WORD_VOCAB)
    library, encoder = Tokenizer.from_file(path), token_files.WordEncoder(path)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)] + ["straße", "İx", "한글", "한", "ét", "don't", "3a", "²", "㐀二", "a" * 3000]
    asked = []
    encoder._batch = lambda texts, f=encoder._batch, **k: (asked.extend(texts), f(texts, **k))[1]
    encoder._with_places = lambda texts, f=encoder._with_places, **k: (asked.extend(texts), f(texts, **k))[1]
    text = " ".join(words)
    assert encoder.encode(text).tobytes() == array("I", library.encode(text, add_special_tokens=False).ids).tobytes()
    # One of them is cut by the splitter once it is in lower case, so its group is asked for word by word.
    assert len(asked) < 100 < len(words)
