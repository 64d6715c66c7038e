import time

import pytest
from pyspark.sql import functions as F

from lodestone.llm.splitting import named_chunks, rejoined, running_sums, snippet_pieces, split_oversized

TEXTS = {
    "paragraphs": "\n\n".join(f"Paragraph {i} " + "word " * 60 for i in range(40)),
    "crlf": "\r\n".join("line " * 12 + str(i) for i in range(200)),
    "japanese": "これは長い文です。" * 900,
    "emoji": "👨‍🔧👩‍💻" * 900,
    "cyrillic": "Слово за словом идёт рассказ. " * 300,
    "no-space": "x" * 9000,
    "space": " " * 5000,
    "mixed": ("a" * 3000 + " б" * 500 + "\n") * 3,
    "early": "short.\n\n" + "y" * 6000,
    "exact": "z" * 2048,
    "above": "z" * 2049,
}


@pytest.fixture(scope="module")
def pieces(spark):
    rows = [(k, t, "H", 1) for k, t in TEXTS.items()] + [("null", None, None, 1), ("empty", "", "H", 1)]
    df = spark.createDataFrame(rows, "chunk_id string, text string, heading string, _parts int")
    out = {}
    for r in split_oversized(df, "chunk_id", "text", ["heading"]).orderBy("chunk_id", "piece_no").collect():
        out.setdefault(r.chunk_id, []).append(r)
    return out


def test_only_oversized(pieces):
    assert set(pieces) == set(TEXTS) - {"exact"}


@pytest.mark.parametrize("name", sorted(set(TEXTS) - {"exact"}))
def test_limits_overlap_and_round_trip(pieces, name):
    rows, text = pieces[name], TEXTS[name]
    assert "".join(r.piece[r.overlap :] for r in rows) == text
    assert all(len(r.piece.encode()) <= 2048 and r.piece for r in rows)
    assert all(r.overlap <= 200 and text[r.begins :].startswith(r.piece) for r in rows)
    assert rows[0].overlap == 0 and all(b.piece[: b.overlap] == a.piece[-b.overlap :] and b.overlap > 0 for a, b in zip(rows, rows[1:], strict=False))


def test_boundaries(pieces):
    assert all(r.piece.endswith("\n\n") for r in pieces["paragraphs"][:-1])
    assert all(r.piece.endswith("\r\n") for r in pieces["crlf"][:-1])
    assert all(r.piece.endswith("。") for r in pieces["japanese"][:-1])
    assert all(r.piece.endswith((". ", " ")) for r in pieces["cyrillic"][:-1])
    assert pieces["early"][0].piece == "short.\n\n"


def test_named_chunks_and_snippets(spark):
    hits = spark.createDataFrame([("d", ["d#0", None, "gone#1"], "x  y..."), ("d", ["d#0"], None), ("e", None, " "), ("d", [], "x y...")], "doc_id string, top_chunk_ids array<string>, snippet string")
    chunks = spark.createDataFrame([("d#0", "d", None, "x\ny" + " z" * 2000), ("d#0", "d", None, "x\ny" + " z" * 2000), ("e#0", "e", "h", "q" * 3000), ("d#1", "d", "h", None)], "chunk_id string, doc_id string, heading string, text string")
    named = named_chunks(hits, chunks)
    assert [r.chunk_id for r in named.collect()] == ["d#0"]
    got = snippet_pieces(hits, split_oversized(named, "chunk_id", "text", ["doc_id"])).collect()
    assert [tuple(r) for r in got] == [("d", "d#0", 0)]


@pytest.mark.parametrize("n", [1, 511, 512, 513, 1500])
def test_running_sums(spark, n):
    sizes = [(i * 7) % 13 for i in range(n)]
    got = spark.createDataFrame([(sizes,)], "s array<int>").select(running_sums(F.col("s"))).first()[0]
    assert got == [sum(sizes[:i]) for i in range(n)]


def test_long_texts_take_linear_time(spark):
    texts = spark.createDataFrame([(n, "Some words of a long text. " * (n * 40_000)) for n in (1, 3)], "k int, text string")
    seconds = []
    for n in (1, 3):
        began = time.time()
        row = rejoined(split_oversized(texts.where(F.col("k") == n), "k", "text", []), "k").first()
        seconds.append(time.time() - began)
        assert row.text == "Some words of a long text. " * (n * 40_000) and row.largest <= 2048 and row.most_overlap <= 200
    assert seconds[1] < 10
