import functools
import zlib
from collections import defaultdict

import numpy as np
import pytest

from sievelake.llm.packing import Packer, WordEncoder, encoder, pack_documents
from sievelake.llm.registry import tokenizer_path

ODD = ["", None, "a", "It's a\ttest of  the\n\nthing's <|endoftext|>x", "é" * 30, "ÀÉ ﬁ Σ ΑΣ é ́", "12 3.4!? " * 3000, "same", "same", "don't 'Twas 's''t x<|y <|z A1b2 É.È,ß÷× ª º µ"]


@functools.cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def whole(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids + [2]


def test_words_give_the_ids_of_whole_texts():
    for text in ODD:
        got = encoder(tokenizer_path()).encode([text or ""])[0]
        assert np.frombuffer(got, "<u4").tolist() + [2] == whole(text)


@pytest.mark.parametrize("window", [64, 4096])
def test_every_id_in_one_piece(spark, window):
    rows = [(i, t, "x") for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    got = pack_documents(docs, tokenizer_path(), window=window, with_ids=True).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for i, t in enumerate(ODD):
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        assert np.frombuffer(b"".join(bytes(p.ids) for p in pieces), "<u4").tolist() == whole(t)
        assert all(p.doc_tokens == len(whole(t)) for p in pieces)
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda r: r.offset):
            assert p.offset == at
            at += p.length
        assert at <= window


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).count() == 0


def test_level_is_the_least_sum_of_squares():
    rng, p = np.random.default_rng(1), Packer(16)
    for i in range(300):
        size = int(rng.integers(1, 16))
        options = []
        for level in range(0, 17 - size):
            if level and not p.count[level]:
                continue
            c = p.count.copy()
            if level:
                c[level] -= 1
            c[level + size] += 1
            c[16] = 0
            options.append(((c**2).sum(), -level))
        p.place((i, 0, size, size, b"0000" * size))
        c = p.count.copy()
        assert (c**2).sum() == min(options)[0]


@pytest.mark.parametrize("words, parts, portion", [(3, 2, 4), (1, 1, 1), (10, 5, 100)])
def test_full_tables_change_no_ids(words, parts, portion):
    small = WordEncoder(tokenizer_path(), words, parts, longest=6)
    texts = [t or "" for t in ODD] + ["a b c d e f g h the the The a b", "the " * 50 + "abcdefghijkl 12 ü"]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() + [2] for x in small.encode(texts, portion)] == [whole(t) for t in texts]
    assert all(len(w) <= 6 for w in small.words)


def test_very_many_different_words(spark):
    text = "the " + " ".join(f"w{i}x" for i in range(400_000)) + " the"
    got = pack_documents(spark.createDataFrame([(1, text), (2, text[:2_000_000])], "doc_id long, text string"), tokenizer_path(), with_ids=True).collect()
    ids = b"".join(bytes(r.ids) for r in sorted((r for r in got if r.doc_id == 1), key=lambda r: r.start))
    assert np.frombuffer(ids, "<u4").tolist() == whole(text)


def test_placement_fills_the_windows():
    rng, p, full, sizes = np.random.default_rng(5), Packer(512), [], []
    for i in range(4000):
        sizes.append(int(rng.integers(1, 700)))
        full += p.add(i, b"0000" * sizes[-1])
    rest = list(p.finish())
    used = [sum(x[2] for x in row) for row in full + rest]
    assert used[:-1] == [512] * (len(used) - 1) and sum(used) == sum(sizes)
    assert p.topped == len(rest) < 0.2 * p.placed
    seen = [set() for _ in sizes]
    for row in full + rest:
        for doc, start, length, total, ids in row:
            assert total == sizes[doc] and len(ids) == 4 * length and not seen[doc] & set(range(start, start + length))
            seen[doc] |= set(range(start, start + length))
    assert [len(s) for s in seen] == sizes
