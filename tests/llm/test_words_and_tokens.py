import random
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest
from helpers import corpus, prose, table, words

from splitwarden.llm.text import grams, slices, words_of
from splitwarden.llm.tokenfile import FRAME_IDS, Reader, Writer, read_token_files, write_token_files
from splitwarden.llm.tokens import END_ID, Encoder, tokenizer_path
from splitwarden.operators.scale import scratch_path


def odd_texts(n=1500):
    rnd = random.Random(3)
    alphabet = "ab 12 '\n\t  é漢 .,!'s　\x1f\x85|<>endoftext Z"
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(50))) for _ in range(n)] + [
        "", None, " ", "a ", " a", "<|endoftext|> <|endoftext|>", "It's  we'll\n\n x"
    ]


@lru_cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def whole(text):
    return library().encode(text or "", add_special_tokens=False).ids + [END_ID]


def test_words_equal_the_pattern():
    texts = odd_texts() + [prose(1, 5000)]
    column = pa.array(texts)
    found = words_of(column)
    assert [found.joined(i, 1).decode() for i in range(len(found.key))] == [w for t in texts for w in words(t)]
    assert found.counts().tolist() == [len(words(t)) for t in texts]
    # A slice of a column reads its own rows only.
    assert words_of(column[3:9]).counts().tolist() == [len(words(t)) for t in texts[3:9]]


def test_equal_words_have_equal_keys_wherever_they_stand():
    found = words_of(pa.array(["alpha beta gamma alpha beta", "BETA gamma", None, "x" * 3_000_000 + " beta"]))
    key = {}
    for i, k in enumerate(found.key.tolist()):
        assert key.setdefault(found.joined(i, 1), k) == k
    runs = grams(found.key, 2)
    assert runs[0] == runs[3] and runs[1] == runs[5]


def test_slices_keep_all_rows():
    batch = pa.RecordBatch.from_pydict({"text": pa.array(["a" * 50, None, "b" * 500, "", "c"] * 20)})
    parts = list(slices(batch, "text", 100))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))


def test_ids_equal_the_library_on_whole_texts():
    texts = odd_texts() + [prose(2, 3000)]
    encoder = Encoder()
    for _ in range(2):  # from the library, then from memory
        assert [x.tolist() for x in encoder.encode(pa.array(texts))] == [whole(t) for t in texts]


def test_special_tokens_follow_the_library():
    texts = ["a <|endoftext|> b", "a  <|endoftext|>  b", "<|endoftext|>", "x<|endoftext|>y z", "plain  text", None]
    assert [x.tolist() for x in Encoder().encode(pa.array(texts))] == [whole(t) for t in texts]
    assert whole(texts[0])[:-1] == [64, 220, 50256, 275]


def test_pieces_that_share_a_polynomial_are_told_apart():
    bits = [bin(i).count("1") & 1 for i in range(2048)]
    word, other = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    texts = [f"{word} {other}", f"x {other} {word} {word[:900]} {other[:900]}", f"{word[:1024]} {other[:1024]}"]
    assert [x.tolist() for x in Encoder().encode(pa.array(texts))] == [whole(t) for t in texts]
    found = words_of(pa.array(texts))
    keys = {found.joined(i, 1): k for i, k in enumerate(found.key.tolist())}
    assert len(set(keys.values())) == len(keys)


def test_files_give_every_document_back(tmp_path):
    rnd = np.random.default_rng(1)
    documents = [(i if i % 7 else None, rnd.integers(0, 50_257, n).astype(np.uint32)) for i, n in
                 enumerate([1, 5, FRAME_IDS, 3, 2 * FRAME_IDS + 9, 1, 70_000])]
    path = str(tmp_path / "x.zst")
    with open(path, "wb") as out:
        writer = Writer(out)
        for doc, ids in documents:
            writer.add(doc, ids)
        writer.close()
    reader = Reader(path)
    opened = []
    plain = reader.frame
    reader.frame = lambda n: opened.append(n) or plain(n)
    assert np.array_equal(reader.document(3), documents[3][1]) and len(opened) == 1
    assert all(np.array_equal(reader.document(i), ids) for i, (_, ids) in enumerate(documents))
    import zlib

    assert list(reader.checksums()) == [zlib.crc32(ids.astype("<u4").tobytes()) for _, ids in documents]
    damaged = bytearray(open(path, "rb").read())
    damaged[20] ^= 1
    open(path, "wb").write(damaged)
    with pytest.raises(Exception):
        list(Reader(path).checksums())


def test_token_files_of_a_table(spark):
    import zlib

    rows = corpus()
    folder = scratch_path(spark, "test-tokens")
    found = read_token_files(spark, folder, write_token_files(table(spark, rows).repartition(5), folder)).collect()
    expected, start = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = whole(text)
        expected.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, found), key=lambda r: r[1]) == expected


def test_token_files_of_no_rows(spark):
    folder = scratch_path(spark, "test-tokens")
    assert read_token_files(spark, folder, write_token_files(table(spark, []), folder)).count() == 0
