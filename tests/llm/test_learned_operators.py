"""Language ID, toxicity, exact top-k, and the pipeline."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import language_id, topk, toxicity

DATA = "/root/testdata/sf0.01"


def brute(rows, queries, k=5):
    q = [(i, [int(np.floor(256 * c)) for c in v]) for i, v in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    for r, (i, v) in enumerate(q):
        if i % queries == 0:
            near = sorted((-sum(x * y for x, y in zip(v, w)), j) for s, (j, w) in enumerate(q) if s != r)[:k]
            out += [(i, n, j, -score) for n, (score, j) in enumerate(near, 1)]
    return sorted(out)


def test_topk_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(np.float32(c)) for c in rng.normal(0, 0.1, 24)]) for i in range(300)]
    rows += [(i, rows[0][1]) for i in range(300, 320)]  # ties
    rows += [(400, None), (401, [None] * 24), (402, [float("nan")] * 24), (None, rows[1][1]), (5, rows[6][1]), (450, [0.5] * 3), (451, [])]
    rows += [(50, rows[50][1]), (50, rows[51][1])]  # a repeated query, once with another vector
    df = spark.createDataFrame([(i, v, "clash", 0) for i, v in rows], "vec_id long, embedding array<double>, score string, rank int")
    every = F.col("vec_id") % 50 == 0
    for shard, seeds in ((4096, 1024), (37, 64), (37, 2)):
        monkeypatch.setattr(topk, "SHARD", shard)
        monkeypatch.setattr(topk, "SEEDS", seeds)
        got = topk.top_k(df, every)
        assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == brute(rows, 50)
    assert topk.top_k(df.limit(0), every).count() == 0
    assert topk.top_k(df.filter("vec_id = 0"), every).count() == 0


def test_topk_broadcasts_nothing_whatever_the_threshold(spark, monkeypatch):
    """Blocks of queries go to as many lanes as there are partitions: a broadcast of them would grow with both."""
    plans, written = [], topk.materialise
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()

    def spied(df, name):
        plans.append(plan(df))
        return written(df, name)

    monkeypatch.setattr(topk, "materialise", spied)
    df = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(60)], "vec_id long, embedding array<double>")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        found = topk.top_k(df, F.col("vec_id") % 20 == 0)
        assert found.count() == 3 * topk.K
        plans.append(plan(found))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(plans) == 3 and "SortMergeJoin" in plans[1] and not any("Broadcast" in p for p in plans)


def test_topk_over_many_shards_and_large_numbers(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 40)
    monkeypatch.setattr(topk, "BLOCK", 3)
    rng = np.random.default_rng(4)
    for scale in (1e6, 1e18):
        rows = [(int(i), rng.normal(0, scale, 6).tolist()) for i in range(120)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        got = topk.top_k(df, F.col("vec_id") % 10 == 0)
        hold = lambda r: (*r[:3], max(topk.INT64[0], min(topk.INT64[1], r[3])))
        want = brute(rows, 10)
        found = sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect())
        assert [(r[0], r[1], r[3]) for r in found] == [(r[0], r[1], r[3]) for r in map(hold, want)]


def test_topk_leaves_postings_early():
    """Vectors of few strong terms: most rows are never looked at, and the essential terms are few."""
    rng = np.random.default_rng(8)
    m = rng.integers(0, 4, (4000, 32))
    for i in range(4000):
        m[i, rng.integers(0, 32, 2)] += rng.integers(50, 200, 2)
    shard, ids = topk.Shard.of(m), np.arange(4000)
    looked = 0
    for i in range(0, 4000, 400):
        want = sorted((-int(m[i] @ m[j]), j) for j in range(4000) if j != i)[:5]
        threshold = sorted(int(m[i] @ m[j]) for j in range(1000) if j != i)[-5]
        own, free, seen = shard.candidates(m[i], threshold)
        looked += len(seen)
        assert len(own) + len(free) == 32 and len(free) > 0
        assert [(-s, j) for s, j in topk.search(m[i], i, shard, ids, ids, threshold)] == want
    assert looked < 0.5 * 4000 * 10


@pytest.mark.parametrize("both", [False, True])
def test_toxicity_learns_pairs_that_weights_cannot(both):
    """Label 1 where exactly one (or: both or none) of two words occurs: each word alone says nothing."""
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for _ in range(2000):
        words = {f"f{j}{'abcdefghij'[j % 10]}" for j in rng.integers(0, 300, int(rng.integers(5, 30)))}
        words = {w.translate(str.maketrans("0123456789", "klmnopqrst")) for w in words}
        insult, group = rng.integers(0, 2, 2)
        words |= ({"insult"} if insult else set()) | ({"group"} if group else set())
        rows.append(toxicity.terms(" ".join(words)))
        labels.append(float((insult == group) == both))
    y = np.array(labels)
    full, linear = (toxicity.fit(rows[:1500], y[:1500], 0.5, rank=r) for r in (toxicity.RANK, 0))
    right = lambda m: np.mean((m.scores(rows[1500:]) >= 0.5) == (y[1500:] == 1))
    assert right(full) > 0.97 and right(linear) < 0.6
    assert np.allclose(full.logits(rows[:40]), np.concatenate([full.logits([r]) for r in rows[:40]]))
    # by the definition, pair by pair
    x = [i for i in rows[3] if full.known[i]]
    p = np.bincount(np.concatenate(rows[:1500]), minlength=toxicity.BUCKETS) / 1500
    known = np.flatnonzero(full.known)
    c = (np.isin(known, x) - p[known])[:, None] * full.v[known]
    want = 0.5 * ((c.sum(0) ** 2).sum() - (c * c).sum()) * toxicity.LENGTH / max(len(x), toxicity.LENGTH)
    assert abs(full.pairs([rows[3]])[0] - want) < 1e-6


def test_toxicity_held_out_accuracy_and_edge_cases(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    model = toxicity.train(docs, labels)
    odd = spark.createDataFrame([(None, None, "x"), (1, "", "x"), (1, " ", "x"), (2, "é" * 30000, "x")], "doc_id long, text string, score string")
    out = toxicity.score(odd, model).collect()
    assert len(out) == 4 and len({r["score"] for r in out if r["doc_id"] in (None, 1)}) == 1 and all(0 <= r["score"] <= 1 for r in out)
    scored = toxicity.score(docs, model).join(labels, "doc_id").toPandas()
    held = scored[scored["held_out"]]
    clean = held[held["toxic"] == 0]
    assert (clean["predicted"] == 0).mean() > 0.95
    pos, neg = held[held["toxic"] == 1]["score"].to_numpy(), clean["score"].to_numpy()
    assert (pos[:, None] > neg[None]).mean() > 0.75
    assert toxicity.score(docs.limit(0), toxicity.train(docs, labels.limit(0))).count() == 0


def test_toxicity_pairs_count_on_documents(spark):
    """The pair terms of the documents' own model are not negligible: they move scores, and without them the model ranks held-out rows no better."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    texts = docs.join(labels.filter("toxic IS NOT NULL"), "doc_id").filter(toxicity.held_out()).select("text", "toxic").collect()
    rows, y = [toxicity.terms(r["text"]) for r in texts], np.array([r["toxic"] for r in texts])
    pairs = model.pairs(rows)
    assert np.abs(pairs).max() > 0.5 and np.abs(model.v).max() > 0.01
    whole, alone = model.logits(rows), model.logits(rows) - pairs
    auc = lambda s: (s[y > 0][:, None] > s[y == 0][None]).mean() + 0.5 * (s[y > 0][:, None] == s[y == 0][None]).mean()
    assert auc(whole) > 0.97 and auc(whole) >= auc(alone) - 0.005


def test_language_id(spark):
    docs = spark.createDataFrame([(i, "the and of house " * 5, "en") for i in range(20)] + [(i, "der und das haus " * 5, "de") for i in range(20, 40)] + [(50, None, "en"), (51, "x", None)], "doc_id long, text string, lang string")
    page = lambda lang, body: f'<html lang="{lang}"><body><script>der der der</script><p>{body}</p></body></html>' if lang else f"<p>{body}</p>"
    rows = [(i, f"http://a.example.de/de/{i}", page("de", "der und das haus")) for i in range(30)] + [(i, f"http://b.example.com/en/{i}", page("en", "the and of house")) for i in range(30, 60)]
    rows += [(60, None, None), (61, "http://a.example.de/", page("", "")), (62, "http://new.example.de/x", page("de", "zzz")), (63, "http://b.example.com/en/1", page("en", "the and der of")), (63, "http://b.example.com/en/1", page("en", "the and der of")), (64, "http://a.example.de/de/1", page("de", "the and of house the and"))]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, host string")
    out = language_id.identify(pages, docs).collect()
    got = {r["page_id"]: r["language"] for r in out}
    assert len(out) == len(rows)
    assert all(got[i] == "de" for i in range(30)) and all(got[i] == "en" for i in range(30, 60))
    assert got[61] == "de" and got[62] == "de" and got[63] == "en" and got[60] in ("de", "en")
    assert language_id.identify(pages.limit(0), docs).count() == 0 and language_id.identify(pages, docs.limit(0)).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["quality_rules", "simhash_near_dedup", "substring_dedup", "source_mixing", "packing"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before, names = docs.count(), docs.columns
    for name, stage in p.STAGES[:-1]:
        docs = p.materialise(stage(spark, docs, DATA), name)
        assert docs.columns == names and 0 < docs.count() <= before
        before = docs.count()
    packed = p.STAGES[-1][1](spark, docs, DATA)
    assert packed.select("doc_id").distinct().count() == before
    assert p.ORACLE_SQL is None


@pytest.mark.parametrize("name", ["op1_token_counts", "op4_substring_dedup", "op9_exact_topk", "op10_quality_rules"])
def test_queries_with_sql(spark, name):
    import duckdb
    from pathlib import Path

    from cohortlens.llm import registry

    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = registry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({registry.oracle_sql()[name]})").fetchall()
    cell = lambda v: "%.3f" % v if isinstance(v, float) else str(v)
    assert sorted([[cell(r[c]) for c in cols] for r in df.collect()]) == sorted([[cell(v) for v in r] for r in want])


def test_pipeline_packs_in_mixing_order(spark, monkeypatch, tmp_path):
    import corpus_pipeline as p
    from cohortlens.llm import mixing, packing, tokens

    rows = [(i, f"word{i} " * 4000, "en", f"src{i % 2}") for i in range(40)] + [(90, None, "en", None), (None, "x", "en", "src1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(p, "STAGES", p.STAGES[3:])  # mixing and packing
    found = []
    for targets in ({"src0": 0.9, "*": 0.1}, {"src0": 0.1, "*": 0.9}):
        monkeypatch.setattr(mixing, "TARGETS", targets)
        pieces = sorted(p.run(spark, str(tmp_path)).collect(), key=lambda r: (r["sequence_id"], r["offset"]))
        order = [r["doc_id"] for r in mixing.mix(docs).collect()]
        texts = {r[0]: tokens.encode(r[1], packing.END_ID) for r in rows}
        assert b"".join(r["ids"] for r in pieces) == b"".join(texts[i] for i in order)
        found.append([(r["doc_id"], r["sequence_id"], r["offset"]) for r in pieces])
    assert found[0] != found[1]
    # rows that are not read from files are packed in their own order
    pieces = packing.pack_in_order(docs.coalesce(1)).collect()
    assert [r["doc_id"] for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])) if r["start"] == 0] == [r[0] for r in rows]


def test_quality_fallback_is_fitted_on_the_whole_language(spark):
    from cohortlens.llm import quality

    plain = lambda i, n=80: " ".join(f"w{(i * 37 + j * j * 11 + j) % 5000:04d}" for j in range(n))
    odd = lambda i: plain(i) + " " + "#$%&|" * 150
    rows = [(i, plain(i, 70 + i % 20), "de", "src0") for i in range(200)]
    rows += [(1000 + i, odd(i), "de", "src9") for i in range(3)] + [(1010, plain(7), "de", None)]  # rare groups of a language
    rows += [(2000, odd(5), "fr", "src0"), (2001, plain(9), None, None)]  # rare languages
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"]: r["kept"] for r in quality.quality_verdicts(docs).collect()}
    assert sum(kept[i] for i in range(200)) > 190 and kept[1010] and kept[2001]
    assert not any(kept[i] for i in (1000, 1001, 1002, 2000))
    assert {r["doc_id"] for r in quality.filter_documents(docs).collect()} == {i for i, k in kept.items() if k}


def test_language_id_by_definition(spark):
    """Every factor by hand: text, markup, address path, suffix, and the host prior over three levels."""
    import math

    docs = spark.createDataFrame([(0, "aa bb cc aa", "en"), (1, "dd ee bb", "fr")], "doc_id long, text string, lang string")
    spec = [("h1.x.fr", "dd ee", "fr", "fr"), ("h1.x.fr", "dd bb", "fr", ""), ("h2.x.fr", "aa", "en", "en"), ("y.com", "aa cc", "en", ""), ("y.com", "bb", "", ""), ("z.fr", "", "", ""), (None, "cc", None, "")]
    rows = [(i, None if h is None else f"https://{h}/{p + '/' if p else ''}i", f'<html lang="{g}"><p>{t}</p>') for i, (h, t, g, p) in enumerate(spec)]
    got = {r["page_id"]: r for r in language_id.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), docs).collect()}
    langs, S, E = ["en", "fr"], language_id.SMOOTH, language_id.ERROR
    n = {"en": {"aa": 2, "bb": 1, "cc": 1}, "fr": {"dd": 1, "ee": 1, "bb": 1}}
    size = {g: sum(n[g].values()) for g in langs}
    word = lambda w, g: math.log(n[g].get(w, 0) / size[g] + 1 / sum(size.values()))
    norm = lambda x: [math.exp(v - max(x)) / sum(math.exp(u - max(x)) for u in x) for v in x]
    text = [[sum(word(w, g) for w in t.split()) * min(1, language_id.TEXT_WORDS / max(1, len(t.split()))) for g in langs] for _, t, _, _ in spec]
    p = [norm(x) for x in text]
    seen = [i for i, (_, t, _, _) in enumerate(spec) if t]
    sums = lambda keep: [sum(round(p[i][k], 6) for i in seen if keep(i)) for k in range(2)]
    host = lambda i: spec[i][0] or ""
    domain = lambda i: ".".join(host(i).split(".")[-2:]) if "." in host(i) else ""
    suffix = lambda i: host(i).rsplit(".", 1)[-1]
    smooth = lambda m, q: [(x + S * y) / (sum(m) + S) for x, y in zip(m, q)]
    every = sums(lambda i: True)
    q0 = [(x + S / 2) / (sum(every) + S) for x in every]
    for i, (_, _, declared, path) in enumerate(spec):
        prior = smooth(sums(lambda j: host(j) == host(i)), smooth(sums(lambda j: domain(j) == domain(i)), q0)) if any(host(j) == host(i) for j in seen) else q0
        logs = [math.log(x) + t for x, t in zip(prior, text[i])]
        for column, said in ((2, declared), (3, path)):
            if said in langs:
                m = {g: sums(lambda j: spec[j][column] == g) for g in langs}
                for k in range(2):
                    all_k = sum(m[g][k] for g in langs)
                    logs[k] += math.log((1 - E) * (m[said][k] + S * (said == langs[k]) + 1 / 2) / (all_k + S + 1) + E / 2)
        m = sums(lambda j: suffix(j) == suffix(i))
        if any(suffix(j) == suffix(i) for j in seen):
            share = sum(m) / sum(every)
            logs = [v + math.log((1 - E) * (m[k] + S * share) / (every[k] + S) + E * share) for k, v in enumerate(logs)]
        post = norm(logs)
        assert got[i]["confidence"] == pytest.approx(max(post), abs=2e-5) and got[i]["language"] == langs[post.index(max(post))]


def test_pages_take_linear_time():
    import time

    for html in ("<script>" * 200_000, "<!--" * 300_000, "<a " * 500_000, "<script>x</script>" * 100_000):
        t = time.perf_counter()
        language_id.visible_text(html)
        assert time.perf_counter() - t < 5
    assert language_id.visible_text("a<script>b</SCRIPT >c<!-- d -->e<style>f").split() == ["a", "c", "e", "f"]
    assert language_id.visible_text("x <b>y</b> < z") == "x  y  < z" and language_id.visible_text(None) == ""


def test_language_id_counts_long_and_rare_words(spark):
    rows = [(i, " ".join(f"{'abcdefghijklmnopqrstuvwxyz'[j % 26]}{'abcdefghijklmnopqrstuvwxyz'[j // 26 % 26]}{'abcdefghijklmnopqrstuvwxyz'[j // 676]}" for j in range(i * 500, i * 500 + 500)) + " common words", "en") for i in range(35)] * 3
    rows += [(900, "verantwortung geschwindigkeit", "de"), (901, "velmi zcela", "cs"), (902, "我们在学校学习中文", "zh"), (903, "私は学校で勉強します", "ja")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    texts = ["geschwindigkeit verantwortung", "zcela velmi", "学习中文在学校", "勉強します", "abb acb adb aeb common", "qqqqqqqq"]
    pages = spark.createDataFrame([(i, None, f"<p>{t}</p>") for i, t in enumerate(texts)], "page_id long, url string, html string")
    got = {r["page_id"]: (r["n_words"] > 0, r["text_language"]) for r in language_id.identify(pages, docs).collect()}
    assert got == {0: (True, "de"), 1: (True, "cs"), 2: (True, "zh"), 3: (True, "ja"), 4: (True, "en"), 5: (False, None)}
