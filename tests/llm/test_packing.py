import random
from itertools import product

import pytest

from carillon.llm.packing import _Pool, best_fit, complete, dominated, fill_report, fillings, lower_bound, pack
from carillon.llm.tokens import encoder, VOCABULARY, with_tokens


def _fewest(sizes, cap):
    best = len(sizes)
    for split in product(range(len(sizes)), repeat=len(sizes)):
        bins = {}
        for s, b in zip(sizes, split):
            bins[b] = bins.get(b, 0) + s
        if max(bins.values()) <= cap:
            best = min(best, len(bins))
    return best


def test_small_cases_are_best():
    random.seed(1)
    for _ in range(25):
        sizes = [random.randint(1, 20) for _ in range(6)]
        got = complete(sizes, 20)
        assert sorted(s for b in got for s in b) == sorted(sizes) and all(sum(b) <= 20 for b in got)
        assert len(got) == _fewest(sizes, 20)


def test_the_exact_search_is_best_where_the_bounded_one_may_not_be():
    random.seed(4)
    for _ in range(15):
        sizes = [random.randint(1, 30) for _ in range(6)]
        assert len(complete(sizes, 30, None, None)) == _fewest(sizes, 30)


def test_packings_without_any_room_left_are_found():
    found = []
    for seed in range(6):
        rng = random.Random(seed)
        sizes = [x for _ in range(20) for a in [rng.randint(50, 600)] for b in [rng.randint(50, 950 - a)] for x in (a, b, 1000 - a - b)]
        got = complete(sizes, 1000)
        assert sorted(s for p in got for s in p) == sorted(sizes) and max(map(sum, got)) <= 1000
        found.append((len(got), len(best_fit(sizes, 1000))))
    assert sum(a for a, _ in found) <= 122 and sum(a for a, _ in found) < sum(b for _, b in found)


def test_bounds_and_dominance():
    assert lower_bound([], 10) == 0 and lower_bound([6, 6, 6], 10) == 3 and lower_bound([7, 7, 4, 4], 10) == 3 and lower_bound([5, 5, 5], 10) == 2
    pool = _Pool([5, 3, 2, 2])
    assert dominated(pool, [(3, 1), (2, 1)], 0) and not dominated(pool, [(5, 1)], 0)  # 5 takes the place of 3 + 2
    assert dominated(pool, [(3, 1)], 2) and not dominated(pool, [(2, 2)], 0)
    got, _ = fillings(pool, 7, 7, None, None)
    assert got == [(0, [(5, 1), (2, 1)])]  # 3 + 2 + 2 is dominated


def test_very_many_tiny_items_in_a_large_pack():
    assert len(complete([1] * 9000 + [2] * 500, 8192)) == 2


@pytest.mark.parametrize("cap, choices", [(2048, [130, 190, 260, 300, 333, 410]), (512, list(range(1, 500))), (100, [34, 35, 33, 67])])
def test_no_worse_than_best_fit(cap, choices):
    random.seed(2)
    sizes = [random.choice(choices) for _ in range(3000)]
    got = complete(sizes, cap)
    assert lower_bound(sizes, cap) <= len(got) <= len(best_fit(sizes, cap)) and sorted(s for b in got for s in b) == sorted(sizes) and max(map(sum, got)) <= cap


def test_every_token_is_placed_once(spark):
    rows = [(k, (k * 37) % 700) for k in range(400)] + [(900, 5000), (901, 1024), (None, 10), (902, 0)]
    sized = spark.createDataFrame(rows, "doc_id bigint, n_tokens int")
    packs = spark.createDataFrame([("a", 512), ("b", 64), ("none", None), ("zero", 0)], "pack_name string, capacity_tokens int")
    got = pack(sized, packs, shard=100).collect()
    for name, cap in (("a", 512), ("b", 64)):
        mine = [r for r in got if r.pack_name == name]
        fills, per = {}, {}
        for r in mine:
            fills.setdefault(r.pack_id, [r.fill_tokens, 0])[1] += r.n_tokens
            per.setdefault(r.doc_id, []).append((r.piece, r.first_token, r.n_tokens))
        assert all(a == b <= cap for a, b in fills.values())
        for doc, n in rows:
            if n:
                at = 0
                for k, (piece, first, size) in enumerate(sorted(per[doc]), 1):
                    assert (piece, first) == (k, at) and (size == cap or at + size == n)
                    at += size
                assert at == n and (n > cap or len(per[doc]) == 1)
    assert {r.pack_name for r in got} == {"a", "b"}
    assert {r.pack_name: r.n_pieces for r in fill_report(pack(sized, packs), packs).collect()}["none"] == 0
    assert pack(sized.limit(0), packs).count() == pack(sized, packs.limit(0)).count() == 0


def test_tokens(spark):
    text = "Nächte ohne Schlüssel <|endoftext|> " * 500
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, text, 5), (4, "a" * 20_000, 5)], "doc_id bigint, text string, size int")
    got = {r.doc_id: r.n_tokens for r in with_tokens(df).collect()}
    assert got[1] == got[2] == 0 and got[3] == len(encoder(VOCABULARY).encode_ordinary(text)) and encoder(VOCABULARY).decode(encoder(VOCABULARY).encode_ordinary(text)) == text
