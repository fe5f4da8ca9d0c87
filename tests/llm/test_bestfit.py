import functools
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sievelake.llm.bestfit import configurations, grouped, pack_best_fit, plan
from sievelake.llm.bytebpe import ByteEncoder, byte_encoder
from sievelake.llm.registry import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")
ODD = [
    "", None, " ", "\n", "a", " a", "a ", "  a  b   c \n d\n\ne\t f \t\tg \r\n h  ", "It's we'll  they've<|endoftext|>  x <|endoftext|>\n\n<|endoftext|>", "one\ntwo three\nfour",
    "é è  x　　y", "\x00 a\x1c \x1d b\x85c", "漢字かな" * 50, "!!! ... ??? 12 345 6a7b", "tab\tand  space " * 100, "same", "same", "x" * 300, "y1" * 3000 + " z" * 9, " " * 3000 + "a" + "\n" * 3000,
]


@functools.cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def whole(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids


def test_words_give_the_ids_of_whole_texts():
    for block in (1 << 18, 7):
        words = ByteEncoder(PATH, block=block)
        for text in ODD:
            assert np.frombuffer(words.encode(text or ""), "<u4").tolist() == whole(text), (text, block)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \n\t\r\x00\x1d 　ab'sé1.<|", max_size=24))
def test_any_text(text):
    assert np.frombuffer(byte_encoder(PATH).encode(text), "<u4").tolist() == whole(text)


def bins_of(counts, rows):
    """Places every piece by the plan, one after another; {bin: [(offset, length)]}."""
    bins = defaultdict(list)
    for size, n in counts.items():
        own = rows[rows[:, 0] == size]
        for rank in range(n):
            _, first, number, offset, copies = own[np.searchsorted(own[:, 1], rank, "right") - 1]
            bins[number + (rank - first) // copies].append((offset + (rank - first) % copies * size, size))
    return bins


def check(counts, window, **settings):
    bins = bins_of(counts, plan(counts, window, **settings))
    for held in bins.values():
        at = 0
        for offset, size in sorted(held):
            assert offset == at
            at += size
        assert at <= window
    assert sorted(bins) == list(range(len(bins)))
    return len(bins)


def fewest(sizes, window):
    """The least number of bins, by trying all placements."""
    best, sizes = [len(sizes)], sorted(sizes, reverse=True)

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for j in {room: j for j, room in enumerate(bins) if room >= sizes[i]}.values():
            go(i + 1, [*bins[:j], bins[j] - sizes[i], *bins[j + 1 :]])
        go(i + 1, [*bins, window - sizes[i]])

    go(0, [])
    return best[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 24), min_size=1, max_size=9))
def test_small_cases_against_all_placements(sizes):
    assert fewest(sizes, 24) <= check(Counter(sizes), 24) <= fewest(sizes, 24) + 1


@pytest.mark.parametrize("seed", range(4))
def test_few_bins_more_than_tokens_need(seed):
    rng = np.random.default_rng(seed)
    sizes = np.concatenate((rng.integers(1, 2049, 3000), rng.integers(1, 200, 3000 * (seed % 2)), np.full(1500, 700), [2048] * 5))
    counts = Counter(sizes.tolist())
    n, least = check(counts, 2048), -(-int(sizes.sum()) // 2048)
    plain = check(counts, 2048, large=(1.0,))  # nothing is large: best fit in descending order alone
    assert least <= n <= 1.01 * plain + 1, (n, plain, least)


def test_sizes_that_only_configurations_pack_well():
    counts = {1034: 600, 532: 600, 522: 600, 492: 1200}  # 1034 + 522 + 492 and 2 * 532 + 2 * 492 are full; descending order joins 1034 + 532 first
    assert check(counts, 2048) == 900 and check(counts, 2048, large=(1.0,)) == 1100


def test_configurations_meet_the_known_optimum():
    sizes = np.array([1026, 519, 503])
    found = configurations(sizes, np.array([600.0, 600.0, 600.0]), 2048)
    assert sum(n for _, n in found) == 600 and all(c @ sizes <= 2048 for c, _ in found)
    assert sum(n for _, n in configurations(np.array([5, 4, 3]), np.array([200.0, 300.0, 400.0]), 10)) == 350  # 100 of 5 + 5, 200 of 4 + 3 + 3, 50 of 4 + 4


def test_groups_have_equal_cardinality():
    assert grouped({100: 5, 90: 7, 80: 12, 10: 99}, 50, 2) == [(100, [(100, 5), (90, 7)]), (80, [(80, 12)])]
    assert [n for _, held in grouped({s: 10 for s in range(60, 100)}, 50, 8) for _, n in held] == [10] * 40
    assert grouped({90: 1, 80: 30, 70: 1}, 50, 2) == [(90, [(90, 1), (80, 15)]), (80, [(80, 15), (70, 1)])]
    assert grouped({90: 1, 80: 30}, 50, 2) == [(90, [(90, 1)]), (80, [(80, 30)])]  # no more lengths than groups


def test_plan_does_not_grow_with_documents():
    rng = np.random.default_rng(3)
    shape = Counter(rng.integers(1, 2049, 20_000).tolist())
    small, large = (len(plan({s: n * k for s, n in shape.items()})) for k in (1, 100_000))
    assert large < 2 * small and large * 40 < 32 << 20


@pytest.mark.parametrize("window", [16, 2048])
def test_every_id_in_one_piece(spark, window):
    texts = [*ODD, "word " * 5000, "hot"] + ["hot"] * 200
    rows = [(None if i == 4 else i % 150, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset string").repartition(5)
    got = pack_best_fit(docs, PATH, window=window, with_ids=True).collect()
    want = Counter()
    for doc, text, _ in rows:
        ids = [*whole(text), 0]
        cut = [0, *range(len(ids) % window or window, len(ids) + 1, window)]
        want.update((doc, i, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())) for i, (a, b) in enumerate(zip(cut, cut[1:], strict=False)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by_seq = defaultdict(list)
    for r in got:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32
        by_seq[r.sequence_id].append(r)
    for held in by_seq.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    tokens = sum(r.length for r in got)
    assert len(by_seq) <= 1.05 * tokens / window + 2


def test_empty_table(spark):
    assert pack_best_fit(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
