import unicodedata

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from carillon.llm.textforms import mapping, one_form, with_forms

LOOK_SAME = [
    ("Рriya Hengoko", "Priya Hengoko"), ("Ｅｌｉｚａｂｅｔｈ", "Elizabeth"), ("Jane\xa0Doe", "Jane Doe"), ("Ja​ne D­oe", "Jane Doe"), ("Café", "Café"),
    ("ﬁn", "fin"), ("Part Ⅲ", "Part III"), ("x‑y", "x-y"), ("Koda", "Koda"), ("Пoезд", "Поезд"), ("\u30ab\u3099ラス", "\u30acラス"),
    ("Νаоkо", "Naoko"), ("Ѕ. Kur", "S. Kur"), ("a​́", "á"), ("Tab\there", "Tab here"),
]


@pytest.mark.parametrize("odd, plain", LOOK_SAME)
def test_equal_looking_texts_meet(odd, plain):
    assert one_form(odd)[0] == one_form(plain)[0] == plain
    assert one_form(odd)[1] and not one_form(plain)[1]


@pytest.mark.parametrize("text", ["Søren Łukasz Çelik", "Новый Вечер", "Тихий Город (Live)", "Φως", "静かな港", "מכתב ישן", "Ass'n", "don’t", "", "  ", "¿Qué?"])
def test_usual_texts_are_no_cases(text):
    assert one_form(text)[1] == ()


@given(st.text(max_size=40))
def test_a_form_is_its_own_form(s):
    form, _ = one_form(s)
    assert one_form(form)[0] == form
    assert not any(unicodedata.category(c) == "Cf" for c in form)


def test_table_has_no_conflicts():
    assert len(mapping()) > 3000


def test_in_spark(spark):
    df = spark.createDataFrame([(1, None, "f"), (2, "", "f"), (3, "Ａ" * 60_000, "f"), (4, "plain", None), (4, "plain", None)], "id int, t string, other string")
    got = {r.id: (r.form, r.kinds) for r in with_forms(df, "t").collect()}
    assert got == {1: (None, None), 2: ("", []), 3: ("A" * 60_000, ["width"]), 4: ("plain", [])}
    assert with_forms(df, "t").count() == 5
    assert with_forms(df.limit(0), "t").count() == 0
    assert with_forms(df.where(F.lit(False)), "t").columns == ["id", "t", "other", "form", "kinds"]


def test_clashing_columns_are_replaced(spark):
    df = spark.createDataFrame([("Ａ", "old", "x"), ("b", "old", "y")], "t string, form string, kinds string")
    assert sorted(tuple(r) for r in with_forms(df, "t").select("t", "form").collect()) == [("b", "b"), ("Ａ", "A")]


def test_look_alikes_of_more_scripts_and_accented_ones():
    for odd, plain in [("Ꭺnna", "Anna"), ("ꓮnna", "Anna"), ("Ꮲeter", "Peter"), ("Zoё", "Zoë"), ("e​́", "é"), ("\U0001d756̓", "Ἀ")]:
        assert one_form(odd)[0] == plain and one_form(odd)[1]
    for usual in ("Ёлка", "Чоё", "Άλφα"):
        assert one_form(usual) == (usual, ())


CHARS = st.sampled_from("аеоρΆαё̣̀̈́̓̓​‍️\xa0ﬁＡ\U0001d756가각eaoAꓮᎪ'’- 1")


@given(st.text(CHARS, max_size=8))
def test_forms_settle_whatever_meets(s):
    form, _ = one_form(s)
    assert one_form(form)[0] == form
    assert one_form(unicodedata.normalize("NFD", s))[0] == form
