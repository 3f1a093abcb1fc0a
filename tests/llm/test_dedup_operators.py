"""Substring dedup, SimHash, quality rules."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortlens.llm import golay, quality, recompression, simhash, substring_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _k string, spans long, fp string, names string"
WORD = re.compile(r"[^\x20\x09-\x0d]+")
EXTRA = ("clash", 1, "clash", "clash")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *EXTRA) for i, t in rows], SCHEMA)


def brute_removal(rows, window):
    first = {}
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in words:
        for k in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[k : k + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            f = first.get(tuple(w[k : k + window]))
            if f is not None and (i is None or f < i):
                gone[k : k + window] = [True] * window
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(a for a, g in zip(w, gone) if not g).encode()).hexdigest()))
    return sorted(out, key=str)


def texts(seed=0):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["é", "Ω x", "#"]
    some = lambda n: [vocabulary[j] for j in rng.integers(0, len(vocabulary), n)]
    shared = [some(n) for n in (50, 51, 80, 300)]
    rows = []
    for i in range(60):
        w = some(int(rng.integers(0, 120)))
        for p in rng.integers(0, 4, int(rng.integers(0, 3))):
            w = w + shared[p] + some(int(rng.integers(0, 30)))
        rows.append((i, "\n ".join(w)))
    run = "la " * 500
    return rows + [(70, run), (71, "x " + run + " y"), (72, None), (73, ""), (74, " \t\n"), (75, rows[5][1]), (75, rows[5][1]), (75, " ".join(shared[3])), (None, rows[7][1]), (None, " ".join(shared[2])), (80, "a b " * 300), (81, "b a " * 300)]


def test_substring_dedup_equals_brute_force(spark):
    rows = texts()
    got = [tuple(r) for r in substring_dedup.removal_figures(frame(spark, rows)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    assert sorted(got, key=str) == brute_removal(rows, 50)
    assert substring_dedup.removal_figures(frame(spark, rows).limit(0)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), min_size=50, max_size=130), min_size=2, max_size=4), st.integers(0, 40))
def test_equal_windows_have_equal_representatives(docs, at):
    docs = [*docs, docs[0][at : at + 50] if len(docs[0]) >= at + 50 else docs[0][:50]]
    w = recompression.hash_words([" ".join(d).encode() for d in docs], [len(d) for d in docs])
    rep, has = recompression.representatives(w, 50)
    h, g = recompression.window_hashes(w, 50)
    seen = {}
    for first, d in zip(w.first, docs):
        for k in range(len(d) - 49):
            value = (int(rep[first + k]) if has[first + k] else None, int(h[first + k]), int(g[first + k]))
            assert seen.setdefault(tuple(d[k : k + 50]), value) == value
    assert len({v[1:] for v in seen.values()}) == len(seen)


def test_cut_texts_keep_untouched_ones(spark):
    rows = texts(1)
    df = frame(spark, rows)
    out = substring_dedup.without_repeats(df)
    assert out.columns == df.columns
    kept = {(r["doc_id"], hashlib.sha256(" ".join(WORD.findall(r["text"] or "")).encode()).hexdigest()) for r in out.collect()}
    want = {(i, h) for i, n, gone, h in brute_removal(rows, 50) if not n or gone < n}
    assert kept == want
    assert all(r["n_chars"] == len(r["text"] or "") for r in out.collect())


def reference_fingerprint(text, k=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB É\n\t\x1cΣ", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == reference_fingerprint(text)


def test_golay_indices_meet_within_two_bits():
    _, count = golay.tables()
    assert Counter(count.tolist()) == {1: 277, 6: 1771}
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 23, 3000)
    for flips in (0, 1, 2):
        y = x.copy()
        for _ in range(flips):
            y ^= 1 << rng.integers(0, 23, len(x))
        a, b = [set() for _ in x], [set() for _ in x]
        for s, v in ((a, x), (b, y)):
            for i, k in zip(*golay.indices(v)):
                s[i].add(int(k))
        assert all(p & q for p, q in zip(a, b))


def brute_components(fps, ids):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 2) + i + 1:
            parent[root(int(j))] = root(i)
    least = {}
    for i, d in enumerate(ids):
        least[root(i)] = min(least.get(root(i), d), d)
    return [least[root(i)] for i in range(len(fps))]


@pytest.mark.parametrize("group", [2048, 6])
def test_links_equal_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(simhash, "GROUP", group)  # small groups force the further pigeonholes
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    fps = [int(b) for b in base]
    for b in base[:8]:  # chains and dense clusters
        for _ in range(25):
            x = int(b)
            for bit in rng.integers(0, 64, int(rng.integers(0, 5))):
                x ^= 1 << int(bit)
            fps.append(x)
    fps = np.unique(np.array(fps, np.uint64))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    found = {r["node"]: r["root"] for r in simhash.components(simhash.links(df)).collect()}
    labels = [found.get(int(x), int(x)) for x in fps.view(np.int64)]
    want = brute_components(fps, list(range(len(fps))))
    pairs = set(zip(labels, want))
    assert len(pairs) == len(set(labels)) == len(set(want))


def test_simhash_edge_cases(spark):
    near = " ".join(f"word{i}" for i in range(400))
    rows = [(5, None), (4, ""), (3, " \n"), (9, near), (8, near), (8, near), (7, near + " tail"), (None, near), (20, "one"), (21, "One"), (None, "alone here now ok")]
    out = simhash.near_duplicates(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], set()).add(r["component_id"])
    assert by[5] == by[4] == by[3] == {3} and by[20] == by[21] == {20} and by[8] == by[9] and by[8] <= {7, 8}
    assert None in by[None]
    assert simhash.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def reference_base(text):
    t = text or ""
    w = WORD.findall(t)
    c = Counter(zip(w, w[1:], w[2:]))
    covered = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("bits", [64, 3])
def test_base_statistics(spark, monkeypatch, bits):
    monkeypatch.setattr(quality, "HASH_BITS", bits)  # at three bits unequal windows often have one hash
    rows = texts(2) + [(90, "a b c a b c"), (91, "a b c"), (92, "a\nb\na\n \n \x1cé"), (93, "#$ 😀<|> a\x0bb\x0cc"), (94, "x x x x"), (95, " a b a b a b ")]
    got = quality.base_statistics(frame(spark, rows)).collect()
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == reference_base(r["text"]), r["text"][:50]


def reference_mcd(x, of=None):
    """The same estimator in numpy: robust start, then concentration by distance bins; distances of the rows ``of``."""
    floors = np.array(quality.FLOORS) * quality.SCALE
    n = len(x)

    def q(p, col):
        v = np.sort(col)
        return v[int(np.ceil(p * n)) - 1]

    mean = np.array([q(0.5, x[:, i]) for i in range(4)], float)
    cov = np.diag([((q(0.75, x[:, i]) - q(0.25, x[:, i])) / 1.349) ** 2 for i in range(4)]) + np.diag(floors**2)
    dist = lambda y=x: np.einsum("ij,jk,ik->i", y - mean, np.linalg.inv(cov), y - mean)
    for _ in range(quality.C_STEPS):
        b = np.minimum(quality.BINS, np.floor(np.sqrt(dist()) * quality.BINS_PER_UNIT))
        upto = np.sort(b)[int(np.ceil(quality.SUBSET * n)) - 1]
        h = x[b <= upto]
        mean = h.mean(0)
        cov = quality.CONSISTENCY * (h.T @ h / len(h) - np.outer(mean, mean)) + np.diag(floors**2)
    return dist(x if of is None else of)


def test_outliers_equal_numpy_and_junk_goes(spark):
    rng = np.random.default_rng(11)
    words = [f"{'abcdefgh'[i % 8] * (i % 6 + 2)}{i}" for i in range(900)]
    rows = []
    for i in range(240):
        w = [words[j] for j in rng.integers(0, 900, int(rng.integers(60, 200)))]
        if i % 9 == 0:
            w = [x + "###" for x in w]
        rows.append((i, " ".join(w)))
    df = frame(spark, rows)
    got = {r["doc_id"]: r for r in quality.quality_verdicts(df).collect()}
    base = [reference_base(t) for _, t in rows]
    x = np.array([[round(np.log(c / n) * 1000), round(np.arcsin(np.sqrt(min(1, s / c))) * 1000), round(np.arcsin(np.sqrt(d / len(t.split("\n")))) * 1000), round(np.arcsin(np.sqrt(r / n)) * 1000)] for (n, c, s, d, r), (_, t) in zip(base, rows)], float)
    assert np.allclose([got[i]["distance2"] for i in range(240)], reference_mcd(x), rtol=1e-6)
    assert not any(got[i]["kept"] for i in range(0, 240, 9)) and all(got[i]["kept"] for i in range(240) if i % 9)
    kept = quality.filter_documents(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {i for i in range(240) if i % 9}


def test_small_groups_take_the_estimate_of_whole_levels(spark):
    """Two sources of a language, one large and one small; a language too small for an estimate of its own."""
    rng = np.random.default_rng(5)
    words = [f"{'abcdefgh'[i % 8] * (i % 6 + 2)}{i}" for i in range(900)]
    rows = []
    for i in range(220):
        w = [words[j] for j in rng.integers(0, 900, int(rng.integers(60, 160)))]
        odd = i >= 210
        rows.append((i, " ".join(x + "###" if odd else x for x in w), "de" if i < 206 else "fr", "big" if i < 190 else "small"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in quality.quality_verdicts(df).collect()}
    base = [reference_base(r[1]) for r in rows]
    x = np.array([[round(np.log(c / n) * 1000), round(np.arcsin(np.sqrt(min(1, s / c))) * 1000), 0, round(np.arcsin(np.sqrt(r / n)) * 1000)] for n, c, s, d, r in base], float)
    language, everything = reference_mcd(x[:206], x), reference_mcd(x, x)
    assert np.allclose([got[i]["distance2"] for i in range(190, 206)], language[190:206], rtol=1e-6)
    assert np.allclose([got[i]["distance2"] for i in range(206, 220)], everything[206:], rtol=1e-6)
    assert not any(got[i]["kept"] for i in range(210, 220)) and all(got[i]["kept"] for i in range(190, 206))


def test_quality_edge_cases(spark):
    rows = [(1, None, None, None), (2, "", "en", "s"), (None, "w " * 60, None, None), (3, " ".join(f"a{i}" for i in range(60)), None, "s"), (3, " ".join(f"a{i}" for i in range(60)), None, "s")]
    df = spark.createDataFrame([(i, t, g, s, 0, *EXTRA) for i, t, g, s in rows], SCHEMA)
    out = quality.quality_verdicts(df).collect()
    assert len(out) == 5 and [r["kept"] for r in out if r["doc_id"] == 3] == [True, True]
    assert all(r["base_failed"] and not r["kept"] for r in out if r["doc_id"] != 3)
    assert quality.filter_documents(df).count() == 2
    assert quality.quality_verdicts(df.limit(0)).count() == 0


def test_no_python_in_quality_rules(spark, tmp_path):
    df = frame(spark, texts()[:20])
    plan = quality.quality_verdicts(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
