"""Phrases, BPE by words, and the Merkle manifest, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from cargolens.llm import bpe_words, collocations, merkle, wordblocks
from cargolens.llm.common import numbered, small_batches
from cargolens.llm.perfect_hash import PerfectHash
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, word string, ids string, pos int, n int, tree string, block int"


def table(spark, rows):
    small_batches(spark)
    return spark.createDataFrame([(i, t, g, "s", len(t or ""), "x", "y", "z", 1, 2, "t", 3) for i, t, g in rows], DOCS)


# --- perfect hash ----------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_perfect_hash_is_minimal_and_verified(n):
    rng = np.random.default_rng(n)
    both = np.unique(rng.integers(0, 1 << 32, (2 * n + 2, 4), dtype=np.uint32), axis=0)
    keys, others = both[:n], both[n:]
    h = PerfectHash(keys)
    assert sorted(h.slots(keys).tolist()) == list(range(n))
    assert (h.slots(others) == -1).all()


def test_perfect_hash_of_repeated_keys_is_an_error():
    with pytest.raises(ValueError):
        PerfectHash(np.ones((2, 4), np.uint32))


def test_packing_is_exact():
    for x in (np.zeros(0, np.uint32), np.array([0, 1, 1 << 31, (1 << 32) - 1], np.uint32), np.arange(100_000, dtype=np.uint32)):
        assert (wordblocks.unpack(wordblocks.pack(x)) == x).all()


# --- collocations ----------------------------------------------------------------------------------


def brute_phrases(rows, least, top):
    n, f = Counter(), defaultdict(Counter)
    for _, text, lang in rows:
        lang = lang or "und"
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, g in f.items():
        good = {p: a for p, a in g.items() if len(p) >= 2 and a >= least}
        longer = Counter()
        for p, a in good.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    longer[p[i : i + size]] = max(longer[p[i : i + size]], a)
        ranked = []
        for p, a in good.items():
            s, _, left, right = min((2_000_000 * a // (g[p[:j]] + g[p[j:]]), j, g[p[:j]], g[p[j:]]) for j in range(1, len(p)))
            if 100 * longer[p] < 80 * a:
                ranked.append((-s, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(ranked)[:top], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(3)
    vocabulary = ["the", "Of", "river", "stone", "Éa", "éa", "日本", "x", "a\xa0b", "long" * 30, "q'", "-"]
    rows = [(0, None, "en"), (1, "", None), (2, " \t\n", "fr"), (None, "one. two", "en")]
    for i in range(3, 120):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(60))]
        text = "".join(w + rng.choice([" ", " ", " ", "\t ", ", ", ".", "\r\n"]) for w in words)
        rows.append((i, text + " new york city " * rng.randrange(3), rng.choice(["en", "en", "de", None])))
    return [*rows, rows[20], rows[20], (200, "the river stone " * 4000, "en")]


@pytest.mark.parametrize(("least", "top", "slots"), [(5, 2000, 1 << 20), (5, 7, 40), (30, 2000, 25)])
def test_phrases_equal_brute_force(spark, prose, least, top, slots):
    got = sorted(map(tuple, collocations.top_phrases(table(spark, prose), least, top, slots).collect()))
    assert got == brute_phrases(prose, least, top) and got


def test_full_buckets_lose_nothing(spark, prose):
    """A sketch so small that most occurrences share buckets lets nearly all through; the counts stay."""
    bigger = [(i, " ".join(f"w{(i * 7 + j * j) % 400}" for j in range(900)), "en") for i in range(1000, 1300)] + prose
    small, large = (sorted(map(tuple, collocations.top_phrases(table(spark, bigger), 5, 50, buckets=b).collect())) for b in (1 << 16, 1 << 22))
    assert small == large == brute_phrases(bigger, 5, 50)


def test_phrases_take_one_pass_a_length(spark):
    """However many candidates there are, and however few a task sums at once."""
    rng = random.Random(7)
    rows = [(i, " ".join(f"w{rng.randrange(40)}" for _ in range(200)), "en") for i in range(100)]

    def jobs(rows_a_bucket):
        name = f"phrases {rows_a_bucket}"
        spark.sparkContext.setJobGroup(name, name)
        got = sorted(map(tuple, collocations.top_phrases(table(spark, rows), 5, 50, rows_a_bucket).collect()))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert got == brute_phrases(rows, 5, 50)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))

    assert jobs(100) <= jobs(1 << 20) + 5


def test_sums_of_keys_with_one_hash(monkeypatch):
    """Keys of equal hash that stand in turns are told apart."""
    monkeypatch.setattr(collocations, "mixed", lambda keys, seed: np.zeros(len(keys), np.uint64))
    keys = np.array([[1, 2, 0, 0], [3, 4, 0, 0]] * 5 + [[1, 2, 5, 0]], np.uint32)
    for n, want in ((None, [5, 5, 1]), (np.arange(11) << 40, [20 << 40, 25 << 40, 10 << 40])):
        got, total, _ = collocations._summed(keys, n)
        assert dict(zip(map(tuple, got.tolist()), total.tolist(), strict=True)) == dict(zip([(1, 2, 0, 0), (3, 4, 0, 0), (1, 2, 5, 0)], want, strict=True))
        again, counts = collocations._unpacked(collocations._packed(got, total, 3), 3)
        assert (again == got).all() and (counts == total).all()


def test_hot_words_are_dealt_out(spark, prose, monkeypatch):
    monkeypatch.setattr(wordblocks, "HOT_BLOCKS", 3)
    monkeypatch.setattr(wordblocks, "HOT_SHARE", 1000)
    got = sorted(map(tuple, collocations.top_phrases(table(spark, prose), 5, 50, block_chars=200).collect()))
    assert got == brute_phrases(prose, 5, 50)


def test_phrases_of_nothing(spark):
    assert collocations.top_phrases(table(spark, []).limit(0)).collect() == []
    assert collocations.top_phrases(table(spark, [(1, "a b c", "en"), (2, None, None)])).collect() == []


def test_scores_pass_64_bits(spark):
    """The cut's arithmetic with counts near 2^45."""
    f, other = (1 << 45) + 7, (1 << 46) + 11
    row = spark.sql(f"SELECT (2000000 * cast({f}L as decimal(20, 0))) div (cast({f}L as decimal(20, 0)) + cast({other}L as decimal(20, 0))) AS s").first()
    assert row.s == 2_000_000 * f // (f + other)


# --- BPE by words ----------------------------------------------------------------------------------

ODD = [
    "", None, "   \n\t", "It's JUST don't we'll I'M they've 'S 'd 12345 ½²³ x1y2", "Ünï çödé Ÿ ŉ ſ İstanbul ΣΑΣ Σ", "é vs é; ́ alone á̧b", "日本語のテキスト。中国 한국어",
    "a\xa0b\x85c d e\x1cf\x00g", "<|endoftext|> and <|startoftext|>x<|ENDOFTEXT|><|endoftext|", "'<|endoftext|>'", "İı ŸŽ ǅ Ⱥ Ⱦ ɏ", "👍🏽👩‍👩‍👧 family …—“quotes”", "ﬁ ﬂ ℌ Ⅷ ⅷ ㎏ Å Ω", "-" * 500, "ab" * 3000, "A.B.C!?..'s ..'t", "퟿�\U0010ffff", "ÀÉ«»¿¡ªº·¸", "٣٤٥ ०१२ ௧",
]


def test_bpe_equals_the_tokenizer(spark):
    rng = random.Random(11)
    letters = "aAbB '.s1é́ßΣİ日 \n\t\xa0‍<|>endoftext" + "".join(chr(rng.randrange(0xA0, 0x3000)) for _ in range(60))
    rows = [(i, t, "en") for i, t in enumerate(ODD)] + [(None, "null id", None)]
    rows += [(100 + i, "".join(rng.choice(letters) for _ in range(rng.randrange(200))), "en") for i in range(300)]
    rows += [rows[5], rows[5], (900, "the quick brown fox " * 20_000, "en")]
    docs = table(spark, rows)
    t = bpe_words.load(bpe_words.default_tokenizer())
    want = []
    for i, text, _ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((i, len(ids), digest(" ".join(map(str, ids))), digest(t.decode(ids, skip_special_tokens=False))))
    key = lambda r: (r[0] is None, r[0] or 0)
    assert bpe_words._digest(iter([["", "1 2"], [], ["", ""], ["3", ""]])) == digest("1 2 3")
    assert sorted(map(tuple, bpe_words.report(docs).collect()), key=key) == sorted(want, key=key)
    small = docs.where("doc_id < 150 or doc_id is null")
    encoded = sorted(((r.doc_id, r.ids) for r in bpe_words.encode(small).collect()), key=key)
    assert encoded == sorted(((i, t.encode(x or "", add_special_tokens=False).ids) for i, x, _ in rows if i is None or i < 150), key=key)
    decoded = bpe_words.decode(bpe_words.encode(small)).collect()
    assert all(r.decoded == t.decode(r.ids, skip_special_tokens=False) for r in decoded) and len(decoded) == len(encoded)


def test_bpe_of_nothing(spark):
    docs = table(spark, [(1, "a", "en")]).limit(0)
    assert bpe_words.report(docs).collect() == [] and bpe_words.encode(docs).collect() == []
    rows = spark.createDataFrame([(1, None), (2, []), (3, [10_000_000, 0])], "decoded_by long, ids array<int>")
    assert [r.decoded for r in bpe_words.decode(rows).orderBy("decoded_by").collect()] == ["", "", "!"]


# --- Merkle manifest -------------------------------------------------------------------------------


def brute_manifest(rows):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    lower = lambda t: t and "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    leaf = lambda r, text: sha("".join(map(part, (r[0], "s", r[2], len(r[1] or ""), text))))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
        return levels

    def climb(levels, at, digest):
        siblings = []
        for level in levels[:-1]:
            lo = at // 8 * 8
            run = level[lo : lo + 8]
            siblings += run[: at - lo] + run[at - lo + 1 :]
            digest = sha("".join([*run[: at - lo], digest, *run[at - lo + 1 :]]))
            at //= 8
        return siblings, digest

    by = defaultdict(list)
    for r in rows:
        by[r[2]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: (tree([x[2] for x in sorted(by[g], key=lambda x: x[:3])]), sorted(by[g], key=lambda x: x[:3])) for g in langs}
    top = tree([trees[g][0][-1][0] for g in langs])
    out = []
    for k, g in enumerate(langs):
        levels, members = trees[g]
        for at, (_, _, plain, r) in enumerate(members):
            tampered = leaf(r, lower(r[1])) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else plain
            one, folded = climb(levels, at, tampered)
            two, folded = climb(top, k, folded)
            out.append((r[0], plain, levels[-1][0], top[-1][0], sha("".join(one + two)), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("n", "levels"), [(1, 4), (8, 4), (9, 1), (530, 1), (530, 2), (530, 4)])
def test_manifest_equals_brute_force(spark, n, levels):
    rng = random.Random(n)
    rows = [(i, rng.choice(["Text", "lower", "", None, "Ünï A"]), rng.choice(["en", "en", "en", "fr", None, "zz", "Z", "é"])) for i in rng.sample(range(-5, 2000), n)]
    if n > 100:
        rows += [(None, "null id", "en"), (None, None, None), rows[3], rows[3], (7000, "W" * 100_000, "fr")] + [(i, "one of a lang", f"l{i}") for i in range(20)]
    got = sorted(map(tuple, merkle.manifest(table(spark, rows), levels).collect()), key=repr)
    assert got == brute_manifest(rows)


def test_manifest_of_nothing(spark):
    assert merkle.manifest(table(spark, [(1, "a", "en")]).limit(0)).collect() == []


def test_every_tampered_text_is_found(spark):
    rows = [(i, "Upper" if i % 2 else "lower", "en") for i in range(100)]
    for r in merkle.manifest(table(spark, rows)).collect():
        assert r.verified == (r.doc_id % 2 == 0 or zlib.crc32(str(r.doc_id).encode()) % 3 != 0)


def test_numbered_over_ranges(spark):
    df = spark.range(1000).select(F.expr("cast(id % 3 as string)").alias("tree"), (F.col("id") * 7 % 1000).alias("x"))
    got = defaultdict(list)
    for r in numbered(df, "tree", [F.col("x")]).collect():
        got[r.tree].append((r.pos, r.x, r.n))
    for rows in got.values():
        rows.sort()
        assert [p for p, _, _ in rows] == list(range(len(rows))) and [x for _, x, _ in rows] == sorted(x for _, x, _ in rows) and {n for _, _, n in rows} == {len(rows)}
