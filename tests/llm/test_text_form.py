import unicodedata

import pytest

from lodestone.llm import text_form as T

CASES = {
    "plain": ("plain", []), "ａｂｃ１": ("abc1", ["compatibility"]), "𝐛𝐨𝐥𝐝": ("bold", ["compatibility"]), "ﬁle": ("file", ["compatibility"]), "a\xa0b c d": ("a b c d", ["compatibility"]),
    "café": ("caf\xe9", ["apart"]), "が": ("が", ["apart"]), "x̄": ("x̄", []), "co\xadop": ("coop", ["invisible"]), "a​b‌⁠﻿": ("ab", ["invisible"]),
    "👨‍🔧 👩🏽‍💻": ("👨‍🔧 👩🏽‍💻", []), "a‍b": ("ab", ["invisible"]), "tеаm": ("team", ["lookalike"]), "οwner": ("owner", ["lookalike"]), "Слово λόγος": ("Слово λόγος", []),
    "“x” – ’y’": ("“x” – ’y’", []), "API-шлюз": ("API-шлюз", []), "e‍́": ("\xe9", ["apart", "invisible"]), "ñ ü": ("ñ ü", []), "한국어": ("한국어", []), "": ("", []), "е́x": ("\xe9x", ["lookalike"]), "pαypal": ("paypal", ["lookalike"]), "kγoto": ("kyoto", ["lookalike"]), "sүstem": ("system", ["lookalike"]), "nаїve": ("na\xefve", ["lookalike"]),
    "σigma": ("oigma", ["lookalike"]), "\u212b": ("\xc5", ["compatibility"]), "λόγος αβγ": ("λόγος αβγ", []),
}


@pytest.mark.parametrize("text", CASES)
def test_cases(text):
    form, traits = CASES[text]
    assert T.canonical(text) == form
    assert T.traits(text) == traits
    assert T.canonical(form) == form and not T.traits(form)


def test_segments_equal_whole_normalization(spark):
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null").collect():
        whole = unicodedata.normalize("NFKC", T._HIDDEN.sub("", r.text))
        assert T.canonical_marks(r.text) == whole
        assert (T.canonical(r.text) != r.text) == bool(T.traits(r.text))


def test_tables(spark):
    rows = [(1, None), (2, ""), (3, "x"), (4, "ｘ"), (4, "ｘ"), (5, "é" * 50_000 + "​"), (None, "ｘ")]
    df = spark.createDataFrame([(k, t, "f") for k, t in rows], "doc_id long, text string, form string")
    forms = T.text_forms(df)
    assert forms.count() == 7
    assert {(r.doc_id, r.changed) for r in forms.collect()} == {(1, False), (2, False), (3, False), (4, True), (5, True), (None, True)}
    assert sorted((r.doc_id for r in T.variant_documents(df).collect()), key=str) == [4, 5, None]


def test_one_pass_equals_the_functions(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    for r in T.text_forms(df).collect():
        text = texts[r.doc_id]
        assert (r.form, r.traits) == ((None, []) if text is None else T.examined(text)) and r.changed == (r.form != text)
