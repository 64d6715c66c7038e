import random
import re
from itertools import combinations

import pytest

from lodestone.llm import near_duplicates as N


def pairs_of(text):
    words = [w.lower() for w in re.findall(r"[^\W_]+", text)]
    return set(zip(words, words[1:], strict=False))


def expected(rows, threshold):
    sets = {k: pairs_of(t) for k, t in rows if k is not None and t is not None}
    out = set()
    for a, b in combinations(sorted(k for k, s in sets.items() if s), 2):
        common = len(sets[a] & sets[b])
        if common >= threshold * (len(sets[a]) + len(sets[b]) - common):
            out.add((a, b))
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["the", "of"] * 20
    rows = [(None, "a b c"), ("null", None), ("one", "single"), ("empty", ""), ("blank", " . "), ("two", "a b"), ("two2", "A  b!"), ("long", " ".join(f"t{i}" for i in range(3000))), ("long2", " ".join(f"t{i}" for i in range(100, 3100)))]
    for i in range(60):
        words = rng.choices(vocabulary, k=rng.randint(2, 45))
        for j in range(rng.randint(1, 4)):
            edited = list(words)
            for _ in range(rng.randint(0, 5)):
                edited.insert(rng.randrange(len(edited) + 1), rng.choice(vocabulary)) if rng.random() < 0.5 or len(edited) < 3 else edited.pop(rng.randrange(len(edited)))
            rows.append((f"r{i}-{j}", " ".join(edited)))
    return rows + rows[20:30]


@pytest.mark.parametrize("threshold", [0.6, 0.8])
@pytest.mark.parametrize("bucket", [0, 3, 200])
def test_equals_brute_force(spark, threshold, bucket):
    rows = corpus(bucket + int(threshold * 10))
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id string, snippet string, elements int, sig string").repartition(3)
    got = [(r.doc_id_a, r.doc_id_b) for r in N.similar_records(df, threshold=threshold, bucket=bucket).collect()]
    assert len(got) == len(set(got))
    assert set(got) == expected(rows, threshold)
    assert got


def test_groups_of_records(spark):
    rows = corpus(9) + [(f"copy{i}", "all these words are the same in every copy") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id string, snippet string")
    links, parent = {}, {}

    def root(n):
        while parent.setdefault(n, n) != n:
            n = parent[n]
        return n

    for a, b in expected(rows, 0.6):
        links[a], links[b] = links.get(a, 0) + 1, links.get(b, 0) + 1
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.doc_id: (r.group_id, r.links) for r in N.similar_groups(df).collect()}
    assert got == {k: (root(k), n) for k, n in links.items()}


def test_bands_cover_all_sums_and_leave_a_common_group():
    scheme = N.bands(0.6, 500)
    assert all(a[1] + 1 == b[0] for a, b in zip(scheme, scheme[1:], strict=False)) and scheme[-1][1] >= 1000
    assert all(2 * groups > int(0.25 * high) for _, high, groups in scheme)


def test_groups_equal_union_find(spark):
    rng = random.Random(4)
    nodes = [f"n{i:03}" for i in range(300)]
    edges = [tuple(rng.sample(nodes, 2)) for _ in range(200)] + [(nodes[i], nodes[i + 1]) for i in range(0, 80)] + [("n010", "n010")]
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    touched = {n for e in edges for n in e if e[0] != e[1]}
    got = {r.member: r.group_id for r in N.groups(spark.createDataFrame(edges, "a string, b string"), "a", "b").collect()}
    assert got == {n: root(n) for n in touched}


def test_heavy_signatures_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(N, "HEAVY", 1e-9)
    rows = corpus(5)
    df = spark.createDataFrame(rows, "doc_id string, snippet string").repartition(3)
    assert {(r.doc_id_a, r.doc_id_b) for r in N.similar_records(df, bucket=2).collect()} == expected(rows, 0.6)
