import pytest

from carillon.llm.privacy import find, name_spans, replace, typed

CASES = [
    ("Contact: marta08{at}mail[dot]example[dot]org\nX", [("email", "marta08{at}mail[dot]example[dot]org")]),
    ("at klas_soren@\nmusic.co.example, not", [("email", "klas_soren@\nmusic.co.example")]),
    ("Write to nowin at post dot invalid if", [("email", "nowin at post dot invalid")]),
    ("Reach me at rasmus dot grin at mail dot example", [("email", "rasmus dot grin at mail dot example")]),
    ("See mix@39kHz and lead@night in. handle @tenfork posted", []),
    ("(+1 (202) 555-0148) ((808) 555 0145) (312 555\n0117)", [("phone", "+1 (202) 555-0148"), ("phone", "(808) 555 0145"), ("phone", "312 555\n0117")]),
    ("Cat. no. 801-368-5874 on, Session 2020-05-22 8139/9557, GTIN 0-54022-34815-9", []),
    ("tel:+49 (0)30 23125-250 or 030/23125 138 or 0044 1632 960 984 or 01.99.00.50.05", [("phone", "+49 (0)30 23125-250"), ("phone", "030/23125 138"), ("phone", "0044 1632 960 984"), ("phone", "01.99.00.50.05")]),
    ("Call six one seven, five five five, zero one one three after", [("phone", "six one seven, five five five, zero one one three")]),
    ("SSN is 970405017. order 914458793. disc id 977908806", [("id_number", "970405017")]),
    ("Social security no. 927334831\nand catalogue no. 927334831", [("id_number", "927334831")]),
    ("Passport X 1960810 was; qq 17 80 50 C is; NIE es Y-1029309-F.", [("id_number", "X 1960810"), ("id_number", "qq 17 80 50 C"), ("id_number", "Y-1029309-F")]),
    ("Platte an Am Tranbra 138. Envoyez le colis au 66 bis, impasse Turmi.", [("address", "Am Tranbra 138"), ("address", "66 bis, impasse Turmi")]),
    ("I moved to 135A Lowijo Ave #15, Vorgrin 93364 last May", [("address", "135A Lowijo Ave #15, Vorgrin 93364")]),
    ("", []),
]


@pytest.mark.parametrize("text, want", CASES)
def test_typed(text, want):
    assert [(k, text[a:b]) for k, a, b in typed(text)] == want


def test_name_spans():
    g = frozenset({"susannah", "estelle", "richard", "soren"})
    for text, want in [("by Susannah H. Klintrel owns", ["Susannah H. Klintrel"]), ("this is estelle drant from", ["estelle drant"]), ("Mikur, Richard, Bratsche", ["Mikur, Richard"]), ("SØREN STITID From", ["SØREN STITID"]), ("Y. van Drelst played", ["Y. van Drelst"]), ("Estelle laughed", [])]:
        assert [text[a:b] for a, b, _, _ in name_spans(text, g, frozenset(), [])] == want


ARTISTS = [(k, f"{g} {s}") for k, (g, s) in enumerate((g, s) for g in ("Estelle", "Richard", "Søren", "Vera") for s in ("Drantro", "Klinsta", "Morvin", "Pelgor"))]


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, kind string"), spark.createDataFrame(ARTISTS, "id bigint, name string")


def test_corpus_tells_surnames_from_other_words(spark):
    rows = [(k, f"Thanks, {g}\nEngineered by {g} {s}.", "x") for k, (g, s) in enumerate((a.split()[0], f"Sur{chr(97 + i)}{chr(101 + i)}n") for i, (_, a) in enumerate(ARTISTS))]
    rows += [(100, None, "x"), (101, "", None), (102, "  ", "x"), (103, "word " * 50_000 + "to Vera Sander.", "x"), (104, "Vera Klinsta", "x"), (104, "Vera Klinsta", "x")]
    docs, artists = _docs(spark, rows)
    got = {(r.doc_id, r.kind, r.start_at) for r in find(docs, artists).collect()}
    want = {(k, "name", rows[k][1].index("by ") + 3) for k in range(16)} | {(103, "name", 250_003), (104, "name", 0)}
    assert got == want


def test_replaced(spark):
    docs, artists = _docs(spark, [(1, "mail a@b.example or Vera Klinsta now", "x"), (2, None, "x"), (3, "nothing", "x")])
    got = {r.doc_id: (r.text, r.n_findings) for r in replace(docs, find(docs, artists)).collect()}
    assert got == {1: ("mail [EMAIL] or [NAME] now", 2), 2: (None, 0), 3: ("nothing", 0)}


def test_empty(spark):
    docs, artists = _docs(spark, [])
    assert find(docs, artists).count() == 0
    assert find(docs, artists.limit(0)).count() == 0


def test_a_surname_that_many_bear_is_found(spark):
    given = ["Anton", "Berta", "Clara", "Doris", "Estelle", "Frieda", "Gustav", "Helene", "Ingrid", "Jakob", "Klara", "Ludwig"]
    persons = [(k, f"{g} {s}") for k, (g, s) in enumerate((g, s) for g in given for s in ("Klinsta", "Morvin", "Pelgor", "Drantro"))]
    artists = spark.createDataFrame(persons, "id bigint, name string")
    rows = [(k, f"Engineered by {g} {s} here.") for k, (g, s) in enumerate((g, s) for g in given for s in ("Klinsta", "Vastrel", f"Sur{chr(97 + given.index(g))}n"))]
    rows += [(100 + k, f"klinsta and vastrel {g.lower()} laughed, they laughed") for k, g in enumerate(given)] + [(200, "Vera Sander sang. Sander left, Sander came, Sander sat, Sander slept.")]
    got = {(r.doc_id, r.start_at) for r in find(spark.createDataFrame(rows, "doc_id bigint, text string"), artists.union(spark.createDataFrame([(900 + k, f"Vera Num{chr(97 + k)}r") for k in range(3)], artists.schema))).collect()}
    assert got == {(k, 14) for k in range(36)} | {(200, 0)}


def test_rare_given_names_are_found(spark):
    frequent = [(k, f"{g} Surn{chr(97 + k % 20)}m") for k, g in enumerate(["Estelle", "Richard", "Vera"] * 2500)]
    artists = spark.createDataFrame(frequent + [(9000 + k, f"Ottokar Num{chr(97 + k)}r") for k in range(3)] + [(9100, "Quirin Bolstat")], "id bigint, name string")
    docs = spark.createDataFrame([(1, "by Ottokar Velsin here"), (2, "by Quirin B. Tarmin and Vera Klinsta"), (3, "Palgor, Ottokar, Bratsche"), (4, "Vera Quirin"), (5, "Ottokar laughed"), (6, "Nobody Known")], "doc_id bigint, text string")
    got = {(r.doc_id, r.start_at, r.end_at) for r in find(docs, artists).collect()}
    assert got == {(1, 3, 17), (2, 3, 19), (2, 24, 36), (3, 0, 15), (4, 0, 11)}


def test_more_writings_of_numbers_streets_and_mail():
    for text, want in [
        ("call 07911 123456 now", "07911 123456"), ("Tel 0176 12345678.", "0176 12345678"), ("bei +49 30 123456 bitte", "+49 30 123456"), ("a +39 06 1234567", "+39 06 1234567"), ("at +81 3-1234-5678", "+81 3-1234-5678"),
        ("mail müller@exämple.de ok", "müller@exämple.de"), ("in Via Roma 12, adesso", "Via Roma 12"),
    ]:
        assert [text[a:b] for _, a, b in typed(text)] == [want]
    assert typed("order 0176 12345678") == [] and typed("+1 2") == []
    far = "x " * 5000
    assert [k for k, _, _ in typed(f"{far}a@b.example {far} c@d.example {far}")] == ["email", "email"]


def test_capitals_beside_small_letters_and_short_surnames():
    g = frozenset({"william", "fiona"})
    for text, want in [("by William GALLAGHER on", ["William GALLAGHER"]), ("by Fiona Li on", ["Fiona Li"]), ("Fiona is here", [])]:
        assert [text[a:b] for a, b, _, _ in name_spans(text, g, frozenset(), [])] == want


def test_words_with_any_accents_are_counted_with_their_plain_forms(spark):
    rows = [(k, f"Played by Vera Kovčík{chr(97 + k)}.", "x") for k in range(4)] + [(10 + 9 * k + j, f"ein {w}{chr(97 + k)} liegt", "x") for k in range(4) for j, w in enumerate(["kovčík", "kovcik", "kovčík"] * 3)]
    docs, artists = _docs(spark, rows)  # one in ten mentions stands beside a name
    assert find(docs, artists).where("kind = 'name'").count() == 0


def test_texts_without_findings_are_not_shuffled(spark):
    docs, artists = _docs(spark, [(k, "nothing here", "x") for k in range(50)] + [(60, "mail a@b.example", "x")])
    out = replace(docs, find(docs, artists))
    assert {r.n_findings: r["count"] for r in out.groupBy("n_findings").count().collect()} == {0: 50, 1: 1}
