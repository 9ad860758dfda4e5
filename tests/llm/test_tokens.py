"""Token files with repeated ids, and tokenizers of another kind."""

import zlib

import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from tillbook.llm import registry, tokens

SCHEMA = "doc_id bigint, text string"


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def plain(path, rows):
    coder = Tokenizer.from_file(path)
    return [[*coder.encode(t or "", add_special_tokens=False).ids, 1] for _, t in rows]


def found(spark, rows, path):
    return [tuple(r) for r in tokens.token_files(spark.createDataFrame(rows, SCHEMA), path).collect()]


def test_repeated_ids_have_one_order(spark):
    rows = [(n % 7, f"text {n % 9} here\n\tand\u3000there") for n in range(60)] + [(3, None), (None, "x y"), (None, None)]
    rows += [(5, "long " * 50_000)]
    path = registry.tokenizer_path()
    runs = [found(spark.createDataFrame(r, SCHEMA).sparkSession, r, path) for r in (rows, rows[::-1])]
    assert sorted(runs[0], key=str) == sorted(runs[1], key=str)
    sizes = sorted((i is not None, i or 0, len(ids), crc(ids)) for (i, _), ids in zip(rows, plain(path, rows)))
    assert sizes == sorted((r[0] is not None, r[0] or 0, r[2], r[3]) for r in runs[0])
    at = 0
    for doc_id, start, size, _ in sorted(runs[0], key=lambda r: r[1]):
        assert start == at
        at += size
    ids = [r[0] for r in sorted(runs[0], key=lambda r: r[1])]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))


def test_a_tokenizer_that_keeps_blanks_gets_whole_texts(spark, tmp_path):
    vocabulary = {c: n for n, c in enumerate(sorted(pre_tokenizers.ByteLevel.alphabet()))}
    other = Tokenizer(models.BPE(vocab=vocabulary, merges=[]))
    other.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    path = str(tmp_path / "bytes.json")
    other.save(path)
    assert not tokens.word_ids(path, 1).by_word
    rows = [(1, "two  words"), (2, "é\n"), (3, None)]
    got = {r[0]: r[2:] for r in found(spark, rows, path)}
    assert got == {i: (len(ids), crc(ids)) for (i, _), ids in zip(rows, plain(path, rows))}


def test_the_given_vocabulary_is_read_word_by_word():
    assert tokens.word_ids(registry.tokenizer_path(), 1).by_word


@pytest.mark.parametrize("rows", [[], [(None, None)], [(1, "")]])
def test_next_to_nothing(spark, rows):
    assert [(r[0], *r[2:]) for r in found(spark, rows, registry.tokenizer_path())] == [
        (i, 1, crc([1])) for i, _ in rows
    ]


def test_words_in_small_letters_give_the_ids_of_whole_texts():
    import random

    import numpy as np

    path = registry.tokenizer_path()
    coder, plain_coder = tokens.WordIds(path, 1), Tokenizer.from_file(path)
    assert not coder.by_case
    draw = random.Random(4)
    alphabet = "aAbBzZ ÉéİıΣσςßẞǅ　\n\t\x0b ́'ls.!*12٣中😀﻿"
    texts = ["".join(draw.choice(alphabet) for _ in range(draw.randrange(60))) for _ in range(3000)]
    ids, sizes = coder.encode([t.encode() for t in texts])
    for text, part in zip(texts, np.split(ids, np.cumsum(sizes)[:-1])):
        assert part.tolist() == [*plain_coder.encode(text, add_special_tokens=False).ids, 1], repr(text)


def test_words_beyond_those_remembered_are_encoded_where_they_occur(monkeypatch):
    monkeypatch.setattr(tokens, "MOST_WORDS", 20)
    coder = tokens.WordIds(registry.tokenizer_path(), 1)
    texts = [f"word{n} and Word{n} other{n % 3}".encode() for n in range(50)]
    few = [coder.encode(texts[n : n + 5]) for n in range(0, 50, 5)]
    whole = tokens.word_ids(registry.tokenizer_path(), 1).encode(texts)
    assert [x for ids, _ in few for x in ids.tolist()] == whole[0].tolist()
    assert [x for _, sizes in few for x in sizes.tolist()] == whole[1].tolist()
    assert coder.count <= 20


def test_case_is_told_apart_where_the_tokenizer_minds_it():
    import numpy as np
    from tokenizers import pre_tokenizers as parts

    words = Tokenizer(models.WordLevel({"a": 5, "A": 6, "aa": 7, "aA": 8, "Aa": 9, "?": 0}, unk_token="?"))
    words.pre_tokenizer = parts.WhitespaceSplit()
    coder = tokens.WordIds.__new__(tokens.WordIds)
    coder.tokenizer, coder.end_id = words, 1
    # This one gives unknown words one id, which the trial of blanks takes as well.
    coder.by_word, coder.by_case = True, coder.minds_case()
    assert coder.by_case
    coder.forget()
    ids, sizes = coder.encode([b"a A aa aA", b"", b"Aa aA b A", b"a"])
    assert ids.tolist() == [5, 6, 7, 8, 1, 1, 9, 8, 0, 6, 1, 5, 1] and sizes.tolist() == [5, 1, 5, 2]
    assert np.array_equal(coder.encode([b"A a"])[0], [6, 5, 1])


def test_words_keep_their_numbers():
    import numpy as np

    draw = np.random.default_rng(2)
    hashes = np.unique(draw.integers(0, 2**63, 900).astype(np.uint64))
    # Many that begin at the same place.
    hashes[:300] = (np.arange(300, dtype=np.uint64) << np.uint64(20)) + np.uint64(7)
    places = tokens.Places(1000)
    places.add(hashes[:400], 0)
    places.add(hashes[400:], 400)
    assert places.find(hashes).tolist() == list(range(len(hashes)))
    assert (places.find(hashes + np.uint64(1 << 63)) == -1).all()
