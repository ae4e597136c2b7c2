import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from gristmill.llm.packing import Seen, pack, pack_group, sum_of_squares
from gristmill.llm.tokens import UnitTokenizer
from pyspark.sql import functions as F
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_tokens_equal_the_tokenizer():
    rng = random.Random(1)
    parts = list("abcABZ  \n\t'\"sdlt019.,-_#é Éß½Ωσς́ İıǅ漢字ᄀ\xa0\x1c\x85 <|>²ͅªº­") + ["'s", "'re", "<|endoftext|>", "<|startoftext|>", "\U0001f600", "\r\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    own, t = UnitTokenizer(PATH), Tokenizer.from_file(PATH)
    for _ in range(2):
        ids, first = own.encode(texts)
        assert all(ids[first[k] : first[k + 1]].tolist() == t.encode(x, add_special_tokens=False).ids for k, x in enumerate(texts))


def brute_place(count, s, capacity):
    """Least sum of squares over all choices: (cost, gap)."""
    best = []
    for gap in [g for g in range(s, capacity) if count[g]] + [capacity]:
        c = dict(count)
        if gap < capacity:
            c[gap] -= 1
        if gap > s:
            c[gap - s] = c.get(gap - s, 0) + 1
        best.append(sum(v * v for v in c.values()))
    return min(best)


def test_sum_of_squares_takes_the_least():
    rng = random.Random(2)
    lengths = [rng.randint(1, 20) for _ in range(300)]
    bins, offsets = sum_of_squares(lengths, 20)
    fill, count = defaultdict(int), defaultdict(int)
    for s, b, o in zip(lengths, bins, offsets, strict=True):
        assert fill[b] == o and o + s <= 20
        least = brute_place(count, s, 20)
        if fill[b]:
            count[20 - fill[b]] -= 1
        fill[b] += s
        if fill[b] < 20:
            count[20 - fill[b]] += 1
        assert sum(v * v for v in count.values()) == least


def test_sparing_opens_a_bin_only_where_none_fits():
    rng = random.Random(3)
    lengths = [rng.randint(1, 20) for _ in range(300)]
    bins, offsets = sum_of_squares(lengths, 20, sparing=True)
    fill, count = defaultdict(int), defaultdict(int)
    for s, b, o in zip(lengths, bins, offsets, strict=True):
        assert fill[b] == o and o + s <= 20
        gaps = [g for g in range(s, 20) if count[g]]
        squares = lambda c: sum(v * v for v in c.values())
        least = min((squares({**count, g: count[g] - 1, **({g - s: count[g - s] + 1} if g > s else {})}) for g in gaps), default=None)
        assert bool(fill[b]) == bool(gaps)
        if fill[b]:
            count[20 - fill[b]] -= 1
        fill[b] += s
        if fill[b] < 20:
            count[20 - fill[b]] += 1
        assert least is None or squares(count) == least


def test_as_few_as_sorted_best_fit():
    """Lengths like those of documents: as few bins as best-fit decreasing needs, or fewer."""
    rng = np.random.default_rng(9)
    for n in (300, 1200):
        lengths = np.minimum(rng.lognormal(6.3, 0.9, n).astype(np.int64) + 1, 2048)
        gaps: list[int] = []
        for s in sorted(lengths.tolist(), reverse=True):
            fit = min((g for g in gaps if g >= s), default=None)
            gaps.append((gaps.pop(gaps.index(fit)) if fit is not None else 2048) - s)
        assert int(pack_group(lengths, 2048)[0].max()) + 1 <= len(gaps)


def test_groups_follow_the_pieces_of_long_documents(spark):
    """2,000 documents of some 12 pieces each: a group has about as many pieces as asked for."""
    docs = spark.range(2000).selectExpr("id AS doc_id", "repeat('a b c ', 100 + CAST(id AS int) % 300) AS text")
    rows = pack(docs, PATH, capacity=64, group=3000).selectExpr("sequence_id >> 32 AS g").groupBy("g").count().collect()
    assert sum(r["count"] for r in rows) > 20_000 and max(r["count"] for r in rows) < 4000


def test_pack_round_trip(docs, corpus):
    t = Tokenizer.from_file(PATH)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in pack(docs, PATH, capacity=128, with_ids=True, group=70).collect():
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32
    total = 0
    for d, text in corpus:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        total += len(ids)
        got = sorted(by_doc[d], key=lambda r: r.piece)
        assert np.concatenate([np.frombuffer(bytes(r.ids), "<u4") for r in got]).tolist() == ids
        assert [r.piece for r in got] == list(range(len(got))) and [r.start for r in got] == list(range(0, len(ids), 128))
    for s in map(sorted, by_seq.values()):
        assert s[0][0] == 0 and s[-1][0] + s[-1][1] <= 128 and all(a[0] + a[1] == b[0] for a, b in zip(s, s[1:], strict=False))
    assert len(by_seq) <= -(-total // 128) * 1.05 + 3


def test_groups_are_packed_close_to_the_least():
    rng = np.random.default_rng(5)
    for n, capacity in ((2000, 2048), (300, 512), (1, 10)):
        lengths = np.concatenate([np.minimum(rng.lognormal(5, 1.2, n).astype(np.int64) + 1, capacity), np.full(n // 5, capacity)])
        bin_of, offset = pack_group(lengths, capacity)
        bins = int(bin_of.max()) + 1
        assert sorted(set(bin_of.tolist())) == list(range(bins)) and bins <= -(-lengths.sum() // capacity) * 1.001 + 2
        for b in range(bins):
            own = np.flatnonzero(bin_of == b)
            own = own[np.argsort(offset[own])]
            assert (offset[own] == np.cumsum(lengths[own]) - lengths[own]).all() and lengths[own].sum() <= capacity


def test_equal_pieces_are_told_apart_in_any_order():
    h = np.array([5, 3, 5, 5, 9, 3], np.uint64)
    for order in (np.arange(6), np.array([5, 4, 3, 2, 1, 0])):
        for size in (1, 2, 6):
            seen, out = Seen(), []
            for lo in range(0, 6, size):
                part = h[order][lo : lo + size]
                out += list(zip(part.tolist(), seen.before(part).tolist(), strict=True))
            assert sorted(out) == [(3, 0), (3, 1), (5, 0), (5, 1), (5, 2), (9, 0)]


def test_odd_rows(spark, empty):
    assert pack(empty, PATH).count() == 0
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], "doc_id long, text string").withColumn("group", F.lit("x"))
    got = pack(rows, PATH).collect()
    assert sorted(r.length for r in got) == [1, 2, 2] and len({(r.sequence_id, r.offset) for r in got}) == 3
