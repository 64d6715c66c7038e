import random

import numpy as np
import pytest

from lodestone.llm import source_origin as S


def code(seed, lines=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("bdfgklmnprst", k=1) + rng.choices("aeiou", k=1) + rng.choices("bdfgklmnprst", k=1) + rng.choices("aeiou", k=1))
    return "\n".join(f"    {word()}.{word()}({word()}, {rng.randint(1, 99)});" for _ in range(lines))


OWN = {
    "// Code generated by foo-gen 1.2. DO NOT EDIT.\npackage a\n" + code(1): "generated",
    "# Fichier généré par foo - ne pas modifier\n" + code(2): "generated",
    "// Builds the header that says DO NOT EDIT in files of foo.\n" + code(3): None,
    "// Reads reports generated by foo and sorts them.\n" + code(4): None,
    "// Hand-written; the old foo generator is gone.\n" + code(5): None,
    "# Copyright notice of team foo. All rights reserved.\n" + code(6): None,
    "/*! foo v1.2.3 | (c) the foo contributors | Permissive License */\n" + code(7): "vendored",
    "class A {\n" + "\n".join(f"  String getField{i:03}() {{ return field{i:03}; }}" for i in range(80)) + "\n}": "generated",
    "!function(t,e){" + "".join(f"const a{i}=await open(b{i},{i});" for i in range(60)) + "}(this);": "minified",
    code(8) + "\n// " + "a long remark with words in it " * 40: None,
    "DATA = [" + ", ".join(str(i * 7919) for i in range(400)) + "]\n": "data",
    "const BLOB = \"" + "Ab9+" * 400 + "\"\n": "data",
    code(9): None, "": None, "  \n": None, "x": None,
}


@pytest.mark.parametrize(("text", "reason"), OWN.items(), ids=range(len(OWN)))
def test_own_reason(text, reason):
    assert S.own_reason(text) == reason


PREAMBLE = "".join(f"// remark {i} of the team\n" for i in range(30))
DEEP = {
    PREAMBLE + "// @generated by foo\n" + code(30): "generated",
    PREAMBLE + "// (c) the foo contributors\n" + code(31): "vendored",
    code(32) + "\n// Automatisch erzeugt durch foo, bitte nicht ändern": "generated",
    code(33) + "\n# Machine written: foo 1.2\n" + code(34): "generated",
    code(35) + "\n// Reads reports generated by foo and sorts them.": None,
    PREAMBLE + code(36): None,
}


@pytest.mark.parametrize(("text", "reason"), DEEP.items(), ids=range(len(DEEP)))
def test_marks_anywhere(text, reason):
    assert S.own_reason(text) == reason


def test_fingerprints_survive_edits_and_do_not_cross_texts():
    a, b = code(10, 200), code(11, 200)
    edited = a.replace(a.split("\n")[50], "    changed.line(0);\n    another(1);")
    owner, prints = S.fingerprints([a, "", edited, b, "x y", a])
    sets = [set(prints[owner == i].tolist()) for i in range(6)]
    assert sets[0] == sets[5] and not sets[1] and not sets[4]
    assert len(sets[0] & sets[2]) > 0.8 * len(sets[0]) and not sets[0] & sets[3]
    alone, single = S.fingerprints([b])
    assert set(single.tolist()) == sets[3] and np.all(np.diff(owner) >= 0) and len(alone)


def test_copies(spark):
    library, own = code(20, 120), code(21, 120)
    edited = "\n".join(library.split("\n")[:100] + ["    local.edit();"])
    rows = [
        ("r1", "vendor/lib/a.java", library), ("r2", "src/util/a.java", edited), ("r3", "src/x/b.java", library), ("r3", "src/x/b.java", library),
        ("r1", "src/own.java", own), ("r2", "src/own.java", own), ("r4", "src/own.java", own),
        ("r1", "node_modules/lone/x.js", code(22)), ("r5", "gen/x/a.ts", None), ("r5", "src/y.ts", None), ("r5", "static/a.min.js", ""), ("r5", "src/vendors/a.ts", code(23)), ("r5", "src/generators/a.ts", code(24)),
        (None, "src/z/b.java", library), ("r6", None, library),
    ]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "repo string, path string, text string, reason string, prints int").repartition(4)
    got = {(r.repo, r.path): r.reason for r in S.not_hand_written(df).collect()}
    assert got == {
        ("r1", "vendor/lib/a.java"): "vendored", ("r2", "src/util/a.java"): "vendored", ("r3", "src/x/b.java"): "vendored", (None, "src/z/b.java"): "vendored",
        ("r1", "node_modules/lone/x.js"): "vendored", ("r5", "gen/x/a.ts"): "generated", ("r5", "static/a.min.js"): "minified",
    }


def workspace(spark, rows, repos=100):
    """``rows`` beside two own files in each of many repositories."""
    own = [(f"own{i}", f"src/f{j}.java", code(1000 + 2 * i + j)) for i in range(repos) for j in range(2)]
    return spark.createDataFrame(own + rows, "repo string, path string, text string").repartition(5)


def found(df):
    return {(r.repo, r.path): r.like for r in S.judged_files(df).collect()}


SHARED = code(50, 120)


def test_unmarked_code_in_many_unrelated_repositories(spark):
    rows = [(f"own{i}", "src/a.java", SHARED if i % 3 else SHARED + "\n    local.edit();") for i in range(40)]
    assert found(workspace(spark, rows)) == {(r, p): "wide" for r, p, _ in rows}


def test_own_code_that_one_repository_vendors(spark):
    rows = [(f"own{i}", "src/a.java", SHARED) for i in range(9)]
    assert found(workspace(spark, [*rows, ("own50", "vendor/x/a.java", SHARED)])) == {("own50", "vendor/x/a.java"): None}


def test_forks_count_once(spark):
    rows = [(f"fork{i}", f"src/{j}.java", code(60 + j, 120)) for i in range(40) for j in range(3)] + [(f"fork{i}", "src/own.java", code(70 + i)) for i in range(40)]
    assert found(workspace(spark, [*rows, ("own50", "vendor/x/a.java", code(60, 120))])) == {("own50", "vendor/x/a.java"): None}


def test_minified_copies_keep_their_library(spark):
    script = "!function(t,e){" + "".join(f"const {code(90 + i, 1)[4:8]}{i}=await open(b{i},{i});" for i in range(60)) + "}(this);"
    rows = [("own1", "node_modules/x/a.js", script), ("own2", "src/x.js", script), ("own3", "src/y.js", script)]
    got = {(r.repo, r.path): r.reason for r in S.not_hand_written(workspace(spark, rows)).collect()}
    assert got == {(r, p): "vendored" for r, p, _ in rows}


def test_redelivered_files_count_once(spark):
    half = SHARED.split("\n")
    mixed = "\n".join(half[:40]) + "\n" + code(80, 80)
    rows = [("own1", "vendor/x/a.java", SHARED), ("own2", "src/b.java", SHARED)] + [("own3", "src/mixed.java", mixed)] * 3
    assert set(found(workspace(spark, rows))) == {("own1", "vendor/x/a.java"), ("own2", "src/b.java")}


def test_little_text_bears_little(spark):
    assert S.lower_bound(3, 3) < 0.5 < S.lower_bound(30, 30) and S.lower_bound(0, 0) == 0.0
    rows = [(f"own{i}", "src/tiny.java", "class A { int x; int y; int z; }") for i in range(60)]
    assert found(workspace(spark, rows)) == {}


def test_decisions(spark):
    found = spark.createDataFrame([("r", "gen/a.ts", "generated")], "repo string, path string, reason string")
    rows = [(1, "r", ".\\gen\\A.ts", True), (2, "r", "/gen//a.ts", False), (3, None, "gen/a.ts", True), (4, "r", "src/a.ts", True), (1, "r", ".\\gen\\A.ts", True), (5, "r", None, True)]
    got = S.decisions_on_foreign(spark.createDataFrame(rows, "decision_id long, repo string, path string, allowed boolean"), found).collect()
    assert sorted(r.decision_id for r in got) == [1, 2]
