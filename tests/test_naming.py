"""Name look-ups against a large corpus, as joins, against brute force."""

import random

import pytest

from cargolens.operators import naming


def osa(a, b):
    prev2, prev = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(prev[j] + 1, row[j - 1] + 1, prev[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, prev2[j - 2] + (x != y))
            row.append(best)
        prev2, prev = prev, row
    return prev[-1]


def edited(rng, s, n):
    for _ in range(n):
        i = rng.randrange(len(s) + 1)
        kind = rng.randrange(4)
        if kind == 0:
            s = s[:i] + rng.choice("abcd") + s[i:]
        elif kind == 1:
            s = s[:i] + s[i + 1 :]
        elif kind == 2:
            s = s[:i] + rng.choice("abcd") + s[i + 1 :]
        else:
            s = s[: max(0, i - 1)] + s[i : i + 1] + s[max(0, i - 1) : i] + s[i + 1 :]
    return s


@pytest.mark.parametrize("cap", [1, 2])
def test_candidates_hold_all_near_pairs(spark, cap):
    """Names of 0 to 60 characters, edited with swaps: nothing within the cap is lost, and few pairs beyond it are met."""
    rng = random.Random(cap)
    known = sorted({"".join(rng.choice("abcd") for _ in range(rng.choice([1, 3, 5, 8, 12, 19, 20, 21, 22, 23, 30, 45, 60]))) for _ in range(300)})
    names = sorted({edited(rng, rng.choice(known), rng.randrange(cap + 2)) for _ in range(900)} | {""})
    a = spark.createDataFrame([(n,) for n in names], "key string")
    b = spark.createDataFrame([(k, k) for k in known], "known_key string, name string")
    want = {(n, k) for n in names for k in known if abs(len(n) - len(k)) <= cap and osa(n, k) <= cap}
    for deleted in (20, 4):
        got = {(r.key, r.known_key) for r in naming.candidate_pairs(a, b, cap, deleted).collect()}
        assert want <= got
    long = {(n, k) for n, k in {(r.key, r.known_key) for r in naming.candidate_pairs(a, b, cap).collect()} if len(k) > 20}
    assert len(long) < 20 * len({(n, k) for n, k in want if len(k) > 20})
    best = {}
    for n, k in want:
        best[n] = min(best.get(n, (9, "")), (osa(n, k), k))
    assert {r.key: (r.distance, r.name) for r in naming.nearest_joined(a, b, cap).collect()} == best


def test_embedded_names_are_those_contained(spark):
    rng = random.Random(7)
    known = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(1, 12))) for _ in range(400)})
    names = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(0, 40))) for _ in range(500)} | {rng.choice(known) + "xofficial" + rng.choice(known) for _ in range(100)})
    a, b = spark.createDataFrame([(n,) for n in names], "key string"), spark.createDataFrame([(k, k.upper()) for k in known], "known_key string, name string")
    got = sorted(map(tuple, naming.embedded(a, b).collect()))
    assert got == sorted((n, k.upper()) for n in names for k in known if len(k) >= 5 and k in n) and got


def test_large_and_small_corpus_agree(spark):
    rng = random.Random(1)
    orgs = ["".join(rng.choice("abcde-") for _ in range(rng.randrange(3, 30))) for _ in range(200)]
    corpus = spark.createDataFrame([("org", o) for o in orgs] + [("model", o + "-7b") for o in orgs], "kind string, name string")
    ids = [f"{edited(rng, rng.choice(orgs), rng.randrange(4))}{rng.choice(['', '', '-official'])}/{edited(rng, rng.choice(orgs) + '-7b', rng.randrange(3))}" for _ in range(300)]
    rows = spark.createDataFrame([(str(k), i) for k, i in enumerate(ids)], "target_id string, repo_id string")
    one, two = (sorted(map(str, naming.findings(rows, corpus, broadcast_names=n).collect())) for n in (10**6, 0))
    assert one == two and len(one) > 200


def test_names_are_folded_once(spark):
    """Each Python fold has workers of its own, so it is done in two tables that are kept and can be let go."""
    ids = spark.createDataFrame([("t", "opnai/own"), ("u", "meta_llama/phi-2")], "target_id string, repo_id string")
    kept = []
    found = naming.findings(ids, naming.seed_corpus(spark), kept=kept)
    assert len(kept) == 2 and all(df.storageLevel.useDisk for df in kept)
    assert {(r.target_id, r.rule_id) for r in found.collect()} == {("t", "SQT-002"), ("u", "SQT-008")}
    for df in kept:
        df.unpersist()
