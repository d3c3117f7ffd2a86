"""Token ids, token files and packing against the tokenizers library and hand-made rows."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from umbral.llm.packing import LENGTH, pack, shortest_pack_first
from umbral.llm.tokenfile import decode_ends, elias_fano, select, token_file_digest
from umbral.llm.tokens import WordEncoder

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")

ODD = [
    "", None, " ", "  ", "a  b", "a   b", " a", "a ", "a \n b", "a\n\nb", "a\tb", "x  y", "it's we'll 'S 'tis", "Áb é ́x",
    "İstanbul ΣΣ ß", "1234 56a", "?!'s !!'ll", "a\x1cb \x1c c", "a\x85 b", "\0 a \0b", "x <|endoftext|> y", "<|endoftext|>",
    "z" * 3000, "no　break   wide", "中文 日本", "\U0001f600 \U0001f600\U0001f600", "a.\nB c.\n D\r\n", "​zero", "ẛ̣ x",
]


def rows(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "x", 7) for i, t in zip(ids, texts)], "doc_id long, text string, shard string, start int")


def texts_of(n, seed):
    rng = random.Random(seed)
    alphabet = ["a", "Be", " ", " ", "\n", "'s", "1", "!", ".", "é", " ", "ß", "  ", "word", "Σ", "\t", "́", "中"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(n)]


def plain(path, texts):
    t = Tokenizer.from_file(path)
    return [[*t.encode(x or "", add_special_tokens=False).ids, 1] for x in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("path", [BYTE, WORD])
@pytest.mark.parametrize("cache", [3, 400_000])
def test_words_give_the_ids_of_the_whole_text(path, cache):
    texts = ODD + texts_of(1500, 1)
    encoder = WordEncoder(path, cache)
    got = [np.frombuffer(x, "<u2").tolist() + [1] for at in range(0, len(texts), 100) for x in encoder.encode(texts[at : at + 100])]
    assert got == plain(path, texts)


def test_given_documents(spark):
    for path in (BYTE, WORD):
        texts = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
        assert [np.frombuffer(x, "<u2").tolist() + [1] for x in WordEncoder(path).encode(texts)] == plain(path, texts)


@pytest.mark.parametrize("sizes", [[1], [1] * 500, [1, 70_000, 1, 1, 3], list(range(1, 400)), [1 << 33, 5, 9]])
def test_elias_fano_round_trip(sizes):
    ends = np.cumsum(np.array(sizes, np.int64))
    if len(sizes) > 3 and max(sizes) < 1 << 20:
        low, lows, highs, samples = elias_fano(ends)
        bits = 8 * (len(lows) + len(highs))
        assert bits <= len(sizes) * (3 + np.log2(ends[-1] / len(sizes))) + 16
    low, lows, highs, samples = elias_fano(ends)
    assert decode_ends(len(ends), low, lows, highs).tolist() == ends.tolist()
    assert [select(low, lows, highs, samples, i) for i in range(len(ends))] == ends.tolist()


def test_token_file(spark):
    texts = ODD + texts_of(300, 2)
    ids = list(range(len(texts)))
    random.Random(3).shuffle(ids)
    got = sorted(map(tuple, token_file_digest(rows(spark, texts, ids), WORD).collect()))
    start, want = 0, []
    for doc, own in sorted(zip(ids, plain(WORD, texts))):
        want.append((doc, start, len(own), crc(own)))
        start += len(own)
    assert got == want


def test_token_file_edge_rows(spark):
    assert token_file_digest(rows(spark, []), WORD).collect() == []
    got = token_file_digest(rows(spark, ["b", "a", "a", None], [5, None, 5, 5]), WORD).collect()
    assert sorted(r["start"] for r in got) == [0, 2, 4, 6] or len(got) == 4
    first = next(r for r in got if r["doc_id"] is None)
    assert first["start"] == 0 and sum(r["n_tokens"] for r in got) == max(r["start"] + r["n_tokens"] for r in got)


def test_patterns_hold_every_piece():
    rng = random.Random(5)
    for histogram in ({}, {7: 1000}, {2048: 3}, {2047: 2, 1: 1}, {1025: 5, 1023: 9}, {k: rng.randrange(1, 300) for k in range(1, 2049, 3)}):
        found: dict = {}
        patterns = shortest_pack_first(histogram, 2048)
        for count, pattern in patterns:
            assert count > 0 and sum(pattern) <= 2048
            for length in pattern:
                found[length] = found.get(length, 0) + count
        assert found == histogram
        assert len(patterns) <= 3 * 2048
        total, n = sum(k * v for k, v in histogram.items()), sum(c for c, _ in patterns)
        assert (n - 1) * 2048 <= total * 1.02 + 2048 or 1025 in histogram


def test_pack(spark):
    texts = ODD + texts_of(400, 4) + ["lorem ipsum dolor " * 4000, "x y " * 2000]
    got = pack(rows(spark, texts), BYTE).collect()
    want = plain(BYTE, texts)
    per_doc: dict = {}
    for r in got:
        ids = want[r["doc_id"]]
        assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == crc(ids[r["start"] : r["start"] + r["length"]])
        per_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    for doc, ids in enumerate(want):
        at = 0
        for start, length in sorted(per_doc[doc]):
            assert start == at
            at += length
        assert at == len(ids)
    sequences: dict = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= LENGTH
    assert len(sequences) * LENGTH <= sum(map(len, want)) * 1.05 + LENGTH
    assert pack(rows(spark, []), BYTE).collect() == []


def test_chunks_cut_without_a_search():
    """Letters, a mark behind them and two lines give the library's ids; chunks of two lines are not kept."""
    texts = [
        "Das Öl, the end.\nNext line; ÀÉÎ? stop: Ünder!", "a\n\nb c\n d", "x.\ny\nz it's 'll\n's ok", "\nlead trail\n", "ªº µm ß. ẞ, Ÿa İx ǅ.",
        "é\nf café.\ńx a \nb a\n b", "don't.\nStop 12.\n3a word.. a,b", "Σας ΑΣ\nΑΣ. 字\n字, x\t\ny", " . , \n ", "the.\n<|x Nor",
    ]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = public_tokenizers.path(name)
        encoder, library = WordEncoder(path), Tokenizer.from_file(path)
        for _ in range(2):
            for text, found in zip(texts, encoder.encode(texts)):
                assert np.frombuffer(found, "<u2").tolist() == library.encode(text, add_special_tokens=False).ids, (name, text)
        assert encoder.chunks and not any("\n" in c for c in encoder.chunks)
