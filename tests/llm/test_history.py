import base64
import hashlib
import random

from carillon.llm.history import HistoryIndex, cuts, digest, first_of_package, probe_starts
from pyspark.sql import functions as F

SCHEMA = "vector_id bigint, batch_no int, manifest_sha256 string, fingerprint string, group_key string, release_key string"


def _h(x):
    return hashlib.sha256(str(x).encode()).hexdigest()


def _found(spark, rows, **kw):
    return sorted(tuple(r) for r in first_of_package(spark.createDataFrame(rows, SCHEMA), **kw).collect())


def test_writings_of_a_digest(spark):
    h = _h(1)
    raw = base64.b64encode(bytes.fromhex(h)).decode()
    same = [h, h.upper(), f" {h}\n", f"sha256:{h}", f"SHA-256:{h}", f"sha256={h}", f"0x{h}", ":".join(h[i : i + 2] for i in range(0, 64, 2)), " ".join(h[i : i + 16] for i in range(0, 64, 16)), raw, f"sha256-{raw}", f"\xa0{h}\xa0"]
    none = [None, "", "unknown", "n/a", "0" * 64, hashlib.sha256(b"").hexdigest(), "e3b0c44298fc1c14…", "zz" * 32, "0x", h[:8]]
    short = [h[:14] + "…", h[:16] + "...", h[:20]]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(same + none + short)], "k int, v string")
    got = [r.d for r in df.select("k", digest(F.col("v")).alias("d")).orderBy("k").collect()]
    assert got == [h] * len(same) + [None] * len(none) + [h[:14], h[:16], h[:20]]


def test_packages(spark):
    mb = "mb:352ce899-ee6b-5070-d538-5cb129356d9a"
    rows = [
        (1, 0, _h(1), _h("a"), "h:" + _h("g"), "h:" + _h("r")),
        (2, 0, _h(1).upper(), None, None, None),  # the same digest inside batch 0
        (3, 1, None, _h("a")[:16] + "…", None, None),  # a shortened fingerprint
        (4, 1, "0" * 64, "", "h:" + _h("g2"), "h:" + _h("r")),  # the release key of another group
        (5, 2, None, None, "H: " + _h("g"), "h:sha256:" + _h("r")),
        (6, 2, _h(6), None, None, mb),
        (7, 3, None, None, None, "mb:{352CE899-ee6b-5070-d538-5cb129356d9a}"),
        (8, 3, _h(6), _h(1), None, None),  # joins through a rejected row; digests of different fields don't meet
        (9, 4, _h(9), None, None, "h:" + _h("r")),  # no group
        (10, 4, None, None, None, None),
        (10, 4, None, None, None, None),
        (None, 4, _h(1), None, None, None),
        (11, 5, _h(1)[:9] + ("0" if _h(1)[9] != "0" else "1") + _h(1)[10:], None, None, None),  # one digit mistyped
    ]
    assert _found(spark, rows) == [(1, 2), (1, 3), (1, 5), (1, 11), (6, 7), (6, 8)]
    assert (1, 11) not in _found(spark, rows, max_edits=0)
    assert _found(spark, []) == []


def test_a_later_row_joins_two_packages_and_order_is_by_batch(spark):
    rows = [(5, 1, _h(1), None, None, None), (6, 0, _h(2), None, None, None), (7, 2, _h(1), _h(3), None, None), (8, 3, _h(2), _h(3), None, None)]
    assert _found(spark, rows) == [(6, 5), (6, 7), (6, 8)]


def test_a_shortened_digest_of_two_wholes_denotes_neither(spark):
    a = _h(1)
    b = a[:14] + _h(2)[14:]
    assert _found(spark, [(1, 0, a, None, None, None), (2, 0, b, None, None, None), (3, 1, a[:14], None, None, None)]) == []


def test_heavy_value(spark):
    rows = [(k, k % 4, _h("hot") if k % 3 == 0 else _h(k), None, None, None) for k in range(600)]
    got = _found(spark, rows)
    assert len(got) == 199 and {g[0] for g in got} == {0}


def test_pieces_find_all_within_two_edits():
    random.seed(5)
    for _ in range(300):
        a = "".join(random.choice("0123456789abcdef") for _ in range(64))
        b = list(a)
        for _ in range(2):
            kind = random.choice("sid")
            at = random.randrange(len(b))
            if kind == "s":
                b[at] = random.choice("0123456789abcdef")
            elif kind == "i":
                b.insert(at, "0")
            else:
                b.pop(at)
        b = "".join(b)
        pieces = {(k, a[s : s + n]) for k, (s, n) in enumerate(cuts(64, 2))}
        if abs(len(b) - 64) <= 2:
            assert any((k, b[s : s + n]) in pieces for k, s, n in probe_starts(len(b), 64, 2))


def test_accepting_a_batch_again_changes_nothing(spark):
    index = HistoryIndex(spark)
    one = spark.createDataFrame([(1, 0, _h(1), None, None, None), (2, 0, _h(1), None, None, None)], SCHEMA)
    for _ in range(2):
        index.accept(one, "b0")
    assert [tuple(r) for r in index.packages().collect()] == [(1, 2)]


def test_edits_of_every_kind_link_and_only_within_the_bound(spark):
    h = _h("edits")
    other = "0" if h[30] != "0" else "1"
    kinds = [h[:30] + other + h[31:], h[:30] + h[31:], h[:30] + "a" + h[30:], h[:5] + h[7:], "b" + h + "c", h[:20] + h[21] + h[20] + h[22:]]
    rows = [(0, 0, h, None, None, None)] + [(k, k, v, None, None, None) for k, v in enumerate(kinds, 1)]
    assert [r[1] for r in _found(spark, rows)] == [1, 2, 3, 4, 5, 6] and {r[0] for r in _found(spark, rows)} == {0}
    assert _found(spark, rows, max_edits=0) == []
    assert [r[1] for r in _found(spark, rows, max_edits=1)] == [1, 2, 3]
    far = h[:10] + "".join("0" if c != "0" else "1" for c in h[10:13]) + h[13:]
    assert _found(spark, [(0, 0, h, None, None, None), (1, 1, far, None, None, None)]) == []


def test_an_index_outlives_its_object_and_old_batches_are_not_read(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    mistyped = _h(2)[:40] + ("0" if _h(2)[40] != "0" else "1") + _h(2)[41:]
    batches = {
        "a": [(1, 0, _h(1), None, None, None), (2, 0, _h(2), None, None, None), (3, 0, _h(1), None, None, None)],
        "b": [(4, 1, _h(1), _h(4), None, None), (5, 1, mistyped, _h(5), None, None)],
        "c": [(6, 2, None, _h(4), None, None), (7, 2, _h(2), _h(4), None, None)],  # joins both packages
        "d": [(8, 3, None, _h(5), None, None), (9, 3, None, None, None, None)],
    }
    for name, rows in batches.items():
        index = HistoryIndex(spark, path)
        index.accept(spark.createDataFrame(rows, SCHEMA), name)
        for part in ("records", "segments"):  # one folder a batch, and the former ones as they were
            assert {p.name for p in (tmp_path / "index" / part).iterdir()} == index.batches
    low = (1 << 42) - 1
    got = sorted((a & low, b & low) for a, b in HistoryIndex(spark, path).packages().collect())
    assert got == [(1, k) for k in (2, 3, 4, 5, 6, 7, 8)]
    assert got == _found(spark, [r for rows in batches.values() for r in rows])
    values = spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/segments").select("value").distinct().count()
    assert values == 5  # each value once, whatever it recurs


def test_whole_index_against_brute_force(spark):
    random.seed(9)
    wholes = [_h(k) for k in range(12)]
    rows: list[tuple] = []
    for k in range(90):
        m, f = random.choice(wholes), random.choice([None, _h(random.randrange(300) + 100)])
        if k % 7 == 0:
            at = random.randrange(64)
            m = m[:at] + "f" + m[at + 1 :]
        rows.append((k, k // 15, m, f, None, None))
    root = list(range(90))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    near = lambda a, b: a and b and sum(x != y for x, y in zip(a, b)) <= 2
    for a in range(90):
        for b in range(a):
            if near(rows[a][2], rows[b][2]) or near(rows[a][3], rows[b][3]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert _found(spark, rows) == sorted((find(k), k) for k in range(90) if find(k) != k)


def test_only_results_stay_in_the_shared_folder(spark, tmp_path, monkeypatch):
    from carillon import session

    monkeypatch.setattr(session, "checkpoint_dir", lambda spark: f"file://{tmp_path}")
    _found(spark, [(1, 0, _h(1), None, None, None), (2, 1, _h(1), None, None, None)])
    left = session.list_path(spark, f"file://{tmp_path}/carillon")
    assert len(left) == 1 and left[0].endswith("p1-packages")
