import pytest

from carillon.llm.names import align_ensemble, align_person, deletions, edits, forms, read, same, same_entity_pairs

SAME = [
    ("Samuel Wurbaklor", "Wurbaklor, Samuel"), ("Samuel Wurbaklor", "Samul Wurbaklor"), ("Elizabeth O'Hastatrur", "O'Hastatrur, Liz"), ("Anthony Brenben", "Tony Brenbne"),
    ("Nathaniel Norforrur & Lawrence van Kastenkin", "Lawrence Kastenkin and Nathaniel Norforrur"), ("G. Rolijin & Y. Melmaden", "Giuseppe Rolijin and Yusuf Melmaden"), ("Ana Surbran y Yago Mel", "Yago Mel & Ana Surbran"), ("L. Tindrel & O. Surbran", "Leonard Tindrel + Oksana Surbran"),
    ("The Vivorta El. Soc.", "Electric Society of Vivorta"), ("Vivorta ES", "Vivorta Electric Society"), ("Panklurtri YC", "The Panklurtri Yth. Csrt"), ("Jorbrawel Str 4tet", "Jorbrawel String Quartet"),
    ("Рriya Hengoko", "Hengoko, Priya"), ("Rasmus_Drurpellor", "Rasmus Drurpellor"), ("Umberto Brosturka Jr.", "Brosturka, Umberto Junior"), ('William "Billy" Hipalen', "William Hipalen"),
]
DIFFERENT = [
    ("Katherine Norforrur", "Nathaniel Norforrur"), ("Umberto Brosturka", "Umberto Brosturka Jr."), ("Jelbran Jazz Collective", "Jelbran Street Singers"), ("Ottilie Ran & Soren Gran", "Ottilie Ran"),
    ("Josephine Klel & Kwame Ror", "Josephine Klel & Vera Ror"), ("Lawrence Ran", "Leonard Ran"), ("Ximena Vanvitrin", "Ximena Vantakrin"),
]


@pytest.mark.parametrize("a, b", SAME)
def test_variants_meet(a, b):
    assert same(forms(a, None), forms(b, None)) == 2


@pytest.mark.parametrize("a, b", DIFFERENT)
def test_others_do_not(a, b):
    assert same(forms(a, None), forms(b, None)) == 0


def test_reading():
    assert read("Various Artists")[0] == "p" and read("Gorha BB")[0] == "e" and read("A B & C D")[0] == "d" and read("...") is None and read(None) is None
    assert align_person((["s", "wurbak"], ""), (["samuel", "h", "wurbak"], ""))[0] == 1
    assert align_person((["b", "e", "kinjor"], ""), (["estelle", "kinjor"], ""))[0] == 0 and align_person((["b", "e", "kinjor"], ""), (["bjorn", "kinjor"], ""))[0] == 1
    assert align_ensemble(["vivorta", "es"], ["vivorta", "electric", "society"])
    assert edits("abcd", "abdc", 2) == 1 and edits("abc", "xyz", 2) == 3
    assert deletions("abc", 1) == {"abc", "ab", "ac", "bc"}


def _pairs(spark, rows, **kw):
    return sorted(tuple(r) for r in same_entity_pairs(spark.createDataFrame(rows, "id bigint, name string, sort_name string, musicbrainz_id string")).collect())


def test_pairs(spark):
    rows = [
        (1, "Samuel Wurbaklor", None, "m1"), (2, "S. Wurbaklor", None, None), (3, "Wurbaklor, Sam", "", None), (4, "Samuel Wurbaklro", None, "m2"),
        (5, "S. Horlifan", None, None), (6, "Samuel Horlifan", None, None), (7, "Susannah Horlifan", None, None), (8, "X Horlifan", "Horlifan, Susannah", None),
        (9, None, None, None), (10, "", " ", None), (11, "—", None, None), (12, "M. Wakloto", None, None), (13, "Wakloto, M", None, None), (14, "x" * 5000, None, None), (14, "x" * 5000, None, None),
    ]
    got = _pairs(spark, rows)
    assert (1, 2) in got and (1, 3) in got and (2, 3) in got and (12, 13) in got
    assert (1, 4) not in got  # both carry an id of their own
    assert not any(5 in p for p in got)  # may be either
    assert not any(p[0] == p[1] for p in got) and len(got) == len(set(got))
    assert _pairs(spark, []) == []


def test_names_of_common_tokens_only(spark):
    from carillon.llm.names import link_names

    rows = [(k, f"{g} Smith{' Jr' if k % 2 else ''}", None, None) for k, g in enumerate(["Anna", "Bernd", "Clara", "Doris"] * 10)]
    df = spark.createDataFrame(rows, "id bigint, name string, sort_name string, musicbrainz_id string")
    few = {r.id: r.entity for r in link_names(df, hot=0).collect()}
    assert few == {r.id: r.entity for r in link_names(df).collect()} and len(set(few.values())) == 4


def test_variants_of_names_of_common_tokens_meet(spark):
    from carillon.llm.names import link_names

    names = ["Robert Smith", "Robert Smyth", "Robetr Smith", "Bob Smith", "Smith, Robbie", "R. Smith", "Anna Maria Jones", "Annamaria Jones", "Robert Jones & Anna Smith", "Bob Jones and A. Smith", "Berlin Jazz Band", "Berlin Jz. Band", "Berlin JB", "Brlin Jazz Band", "Berlin String Quartet"]
    names += [f"{g} {s}" for g in ("Thomas", "Michael", "Veronica", "Penelope") for s in ("Smith", "Jones")] + ["Robert Smith Jr"]
    df = spark.createDataFrame([(k, n, None, None) for k, n in enumerate(names)], "id bigint, name string, sort_name string, musicbrainz_id string")
    for hot in (0, 2):
        got = {r.id: r.entity for r in link_names(df, hot=hot).collect()}
        assert got == {k: 0 if k < 6 else 6 if k < 8 else 8 if k < 10 else 10 if k < 14 else k for k in range(len(names))}, hot


def test_assignment_against_all_ways():
    import random
    from itertools import permutations

    from carillon.llm.names import assign

    rng = random.Random(6)
    for _ in range(300):
        n = rng.randint(1, 4)
        m = rng.randint(n, 5)
        cost = [[None if rng.random() < 0.3 else rng.randint(-5, 9) for _ in range(m)] for _ in range(n)]
        ways = [sum(cost[i][j] for i, j in enumerate(p)) for p in permutations(range(m), n) if all(cost[i][j] is not None for i, j in enumerate(p))]
        got = assign(cost)
        assert (got is None) == (not ways) and (got is None or sum(cost[i][j] for i, j in enumerate(got)) == min(ways) and len(set(got)) == n)


def test_names_of_many_tokens_and_common_familiar_forms():
    for a, b in [
        ("Northern Valley River Mountain Forest Lakeside Chamber Orchestra", "Northern Valley River Mountan Forest Lakeside Chamber Orchestra"), ("Johan Peter Maria Anton Karl Friedrich Wilhelm Wurbaklor", "Wurbaklor, Johan Peter Maria Antn Karl Friedrich Wilhelm"),
        ("Patricia Wurbaklor", "Pat Wurbaklor"), ("Rebecca Wurbaklor", "Becky Wurbaklor"), ("Frederick Wurbaklor", "Fred Wurbaklor"), ("Walter Wurbaklor", "Wally Wurbaklor"),
    ]:
        assert same(forms(a, None), forms(b, None)) == 2


def test_familiar_forms_are_learned_from_the_rows(spark):
    rows = [(k, f"Zibbo Sur{chr(97 + k) * 3}", f"Sur{chr(97 + k) * 3}, Zacharias", None) for k in range(4)] + [(10, "Zacharias Wurbaklor", None, None), (11, "Zibbo Wurbaklor", None, None), (12, "Zacharias Melmaden", None, None), (13, "Quirin Melmaden", None, None)]
    assert _pairs(spark, rows) == [(10, 11)]
    assert _pairs(spark, [r for r in rows if r[0] > 2]) == []


def test_only_entities_stay_in_the_shared_folder(spark, tmp_path, monkeypatch):
    from carillon import session
    from carillon.llm.names import link_names

    monkeypatch.setattr(session, "checkpoint_dir", lambda spark: f"file://{tmp_path}")
    link_names(spark.createDataFrame([(1, "Anna Wurbaklor", None, None), (2, "A. Wurbaklor", None, None)], "id bigint, name string, sort_name string, musicbrainz_id string"))
    left = session.list_path(spark, f"file://{tmp_path}/carillon")
    assert len(left) == 1 and left[0].endswith("p2-entities")
