"""Style features against their inventory one by one, text vectors against numpy, the vector store."""

import hashlib
import json
import re
from collections import Counter

import numpy as np
import pytest

from cohortlens.operators import encoder as E
from cohortlens.operators import style as Y
from cohortlens.operators import two_sample as T
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.01"


def words_of(text):
    return re.findall(r"[a-z]+(?:'[a-z]+)?", (text or "").lower().replace("’", "'").replace("ʼ", "'"))


def features_of(text):
    words = words_of(text)
    joined, out = " ".join(words), set()
    for name, listed in Y.WORDS.items():
        for w in listed.split("|"):
            if w[0] == "-":
                hit = any(x.endswith(w[1:]) for x in words)
            elif w[-1] == "-":
                hit = any(x.startswith(w[:-1]) for x in words)
            else:
                hit = re.search(rf"(?:^| ){re.escape(w)}(?: |$)", joined)
            if hit:
                out.add(name)
    return sorted(out | {n for n, p in Y.PATTERNS.items() if re.search(p, text or "")})


def test_features_equal_the_inventory_word_by_word(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect()]
    texts += [None, "", "  ", "I can't see why you'd do it, kind of; THE END!!", "Isn’t he re-reading (un-)friendly things? www https://x.y #a @b …", "of", "gonna\n- list"]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "i long, text string, side string")
    got = {r["i"]: r for r in Y.style_features(df).collect()}
    assert len(Y.NAMES) == len(set(Y.NAMES)) == 97
    for i, t in enumerate(texts):
        assert got[i]["features"] == features_of(t) and got[i]["n_features"] == len(got[i]["features"]), t
    assert Y.style_features(df.limit(0)).count() == 0 and got[0]["side"] == "k"


def test_prevalence_by_hand(spark):
    rows = [("target", ["be", "do"]), ("target", ["be"]), ("baseline", []), ("baseline", ["be"]), ("baseline", ["digit"])]
    got = {r["feature"]: r for r in Y.prevalence(spark.createDataFrame(rows, "cohort string, features array<string>")).collect()}
    be = got["be"]
    assert (be["n_target"], be["n_baseline"], be["share_target"], be["share_baseline"]) == (2, 1, 1.0, pytest.approx(1 / 3))
    assert be["log_odds"] == pytest.approx(np.log(2.5 * 2.5 / (0.5 * 1.5))) and got["colon"]["log_odds"] == 0 and len(got) == 97
    assert be["place"] == 1 and sorted(r["place"] for r in got.values()) == list(range(1, 98))
    assert Y.prevalence(spark.createDataFrame([], "cohort string, features array<string>")).count() == 97


def dense(texts, known=None):
    """text -> vector, by definition; ``known``: the texts whose frequencies count."""
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    terms = lambda t: Counter(int(md5(x)[:4], 16) for x in (lambda w: [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))])(words_of(t)))
    base = set(known if known is not None else texts)
    df = Counter(b for t in base for b in terms(t))
    out = {}
    for t in texts:
        v = np.zeros(E.DIMENSIONS)
        for b, tf in terms(t).items():
            if b not in df:
                continue
            for k in range(E.SPREAD):
                h = int(md5(f"{b}:{k}")[:3], 16)
                v[h % E.DIMENSIONS] += (1 + np.log(tf)) * (np.log((1 + len(base)) / (1 + df[b])) + 1) * (-1 if h >= 2048 else 1)
        n = np.sqrt((v * v).sum())
        out[t] = v / n if n > 0 else None
    return out


TEXTS = ["the cat sat", "the cat sat on the mat", "a dog’s life", "", "123", "the the the"]


def test_vectors_by_definition(spark):
    df = spark.createDataFrame([(t,) for t in [*TEXTS, "the cat sat", None]], "text string")
    got = {r["text_id"]: r["v"] for r in E.encode(df).collect()}
    want = {hashlib.md5(t.encode()).hexdigest(): v for t, v in dense(TEXTS).items() if v is not None}
    assert got.keys() == want.keys() and len(want) == 4
    assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    assert E.encode(df.limit(0)).count() == 0


def test_store_encodes_each_text_once(spark, tmp_path):
    store = E.VectorStore(spark, str(tmp_path / "store"))
    frame = lambda texts: spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string")
    assert store.vectors().count() == 0
    assert store.add(frame(TEXTS + TEXTS)) == 6 and store.add(frame(TEXTS[:3])) == 0 and store.add(frame(["the new dog", "the cat sat"])) == 1
    want = dense([*TEXTS, "the new dog"], TEXTS)  # later texts weigh by the frequencies of the first
    got = {r["text_id"]: r["v"] for r in store.vectors().collect()}
    assert len(got) == 7
    for t, v in want.items():
        one = got[hashlib.md5(t.encode()).hexdigest()]
        assert (one is None) if v is None else one == pytest.approx(v, abs=1e-12)
    rows = store.embed(frame(["a dog’s life", "zzz", "the cat sat"])).orderBy("i").collect()
    assert rows[0]["v"] == pytest.approx(want["a dog’s life"]) and rows[1]["v"] is None and len(rows) == 3
    (tmp_path / "store" / "delta-dead").mkdir()  # a writer that died before its record
    assert store.vectors().count() == 8 and [set(r) for r in store._records()] == [{"delta", "model"}] * 4
    assert json.loads(next((tmp_path / "store" / "records").glob("*0.json")).read_text())["model"].startswith("model-")


def test_two_sample_test_from_text(spark):
    """Texts of two vocabularies are told apart from their vectors; those of one are not."""
    rng = np.random.default_rng(2)
    common, own = [f"w{c}" for c in "abcdefghij"], {"target": ["tree", "leaf"], "baseline": ["road", "car"]}
    rows = [(i, ("target", "baseline")[i % 2], f"a{i % 16}", " ".join([*rng.choice(common, 12), *rng.choice(own[("target", "baseline")[i % 2]], 4)])) for i in range(160)]
    df = spark.createDataFrame(rows, "vec_id long, side string, author_id string, text string")
    v = df.withColumn("text_id", E.text_id(F.col("text"))).join(E.encode(df), "text_id")
    assert T.c2st_linear(v, permutations=19).first()["accuracy"] > 0.9
    assert T.mmd_fuse(v, 49).first()["p_value"] == pytest.approx(0.02)
