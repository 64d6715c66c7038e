import pickle
import random

import pytest

from lodestone.llm import leakage as L


def brute(texts, items, window):
    out = set()
    for number, words in texts:
        for key, item in items:
            size = min(window, len(item))
            if size and any(words[i : i + size] == item[j : j + size] for i in range(len(words) - size + 1) for j in range(len(item) - size + 1)):
                out.add((number, key))
    return out


@pytest.mark.parametrize("window", [1, 3, 13])
def test_automaton_equals_brute_force(window):
    rng = random.Random(window)
    letters = "abcd"
    items = [(i, rng.choices(letters, k=rng.randint(0, 20))) for i in range(25)] + [(99, []), (100, list("abab")), (101, list("abab"))]
    texts = [(n, rng.choices(letters + "xyz", k=rng.randint(0, 40))) for n in range(120)]
    texts += [(200 + k, ["x", *item, "y"]) for k, item in items]
    machine = L.ItemAutomaton([(k, w, len(w)) for k, w in items], window)
    found = machine.found([w for _, w in texts])
    assert {(texts[n][0], machine.keys[i]) for n, i in found} == brute(texts, items, window)
    for (n, i), spans in found.items():
        item = dict(items)[machine.keys[i]]
        for b, e in spans:
            assert any(texts[n][1][b:e] == item[j : j + e - b] for j in range(len(item)))


ITEM = "Explain why the quiet ledger of gadone keeps `AlphaService` open after the second rollout has passed its checks."


@pytest.fixture
def tables(spark):
    words = ITEM.split()
    rows = [
        (1, "Intro.\n" + ITEM + "\nEnd."), (2, " -- ".join(words[2:15])), (3, " ".join(words[2:14])), (4, None), (5, ""), (6, "ｅxplain " + " ".join(words[1:14]).upper()),
        (7, "before who owns the missing gap after"), (8, "who owns missing the gap"), (9, ITEM), (9, ITEM),
    ]
    documents = spark.createDataFrame([(k, t, 0) for k, t in rows], "doc_id long, text string, item_id int").repartition(4)
    items = [(10, ITEM), (11, "Who owns the missing gap?"), (12, None), (13, " ... "), (14, ITEM.lower())]
    return documents, spark.createDataFrame([(k, t, "x") for k, t in items], "item_id long, text string, doc_id string")


EXPECTED = {(d, i) for d in (1, 2, 6, 9) for i in (10, 14)} | {(7, 11)}


@pytest.mark.parametrize("block_words", [5, 1_000_000])
def test_leaks(spark, tables, block_words):
    got = L.leaks(*tables, block_words=block_words).collect()
    assert {(r.doc_id, r.item_id) for r in got} == EXPECTED and len(got) == len(EXPECTED)
    assert {r.doc_id: r.longest for r in got if r.item_id == 10} == {1: 18, 2: 13, 6: 14, 9: 18}


def test_cleaned(tables):
    rows = {r.doc_id: r for r in L.cleaned(*tables).collect()}
    assert rows[1].form == "Intro.\n.\nEnd." and rows[1].removed == 18
    assert rows[7].form == "before  after" and rows[3].removed == 0 and rows[4].form is None and rows[5].form == ""
    again = L.leaks(tables[0].sparkSession.createDataFrame([(r.doc_id, r.form) for r in rows.values()], "doc_id long, text string"), tables[1])
    assert again.count() == 0


@pytest.mark.parametrize("block_words", [5, 20, 40])
def test_cleaned_by_many_blocks(tables, block_words):
    one, many = L.cleaned(*tables).collect(), L.cleaned(*tables, block_words=block_words).collect()
    assert sorted(map(repr, one)) == sorted(map(repr, many))


def test_blocks_are_bounded_and_keep_all_windows(spark, monkeypatch):
    words = [f"w{i}" for i in range(1000)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, "a b"), (3, None), (4, "")], "item_id long, text string")
    blocks = list(L.item_blocks(df, "item_id", "text", 50, part_words=50))
    assert all(sum(len(w) for _, w, _ in b) <= 50 for b in blocks)
    parts = [w for b in blocks for k, w, size in b if k == 1]
    windows = {tuple(w[i : i + L.WINDOW]) for w in parts for i in range(len(w) - L.WINDOW + 1)}
    assert windows == {tuple(words[i : i + L.WINDOW]) for i in range(1000 - L.WINDOW + 1)}
    monkeypatch.setattr(L.item_blocks, "__defaults__", (L.WINDOW, 50, True))
    long = spark.createDataFrame([(9, " ".join(words[500:520]))], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in L.leaks(long, df, block_words=50).collect()] == [(9, 1)]


def test_packed_size_of_a_block():
    rng = random.Random(3)
    items = [(i, [f"w{int(rng.paretovariate(0.6)) % 30000}" for _ in range(100)], 100) for i in range(200)]
    packed = len(pickle.dumps(L.ItemAutomaton(items)))
    assert packed < 90 * sum(len(w) for _, w, _ in items)
