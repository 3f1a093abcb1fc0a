"""Personal data, source divergence, collocations: against brute force, and the SQL where there is one."""

import hashlib
import re
from collections import Counter, defaultdict
from itertools import product

import duckdb
import pytest

from cohortlens.llm import collocations, private_data, source_divergence

DATA = "/root/testdata/sf0.001"
ROWS = "doc_id long, text string, lang string, source string"


def rows_of(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


@pytest.mark.parametrize("module", [source_divergence, collocations])
def test_query_equals_sql(spark, module):
    (name, query), con = next(iter(module.QUERIES.items())), duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{DATA}/documents.parquet'")
    cur = con.execute(module.ORACLE[name])
    names = [c[0] for c in cur.description]
    got = query(spark, DATA)
    assert sorted(names) == sorted(got.columns)
    assert rows_of(got, *names) == sorted(cur.fetchall())


# ---- op12


def divergence_by_hand(rows, min_docs, top):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    n, df = defaultdict(Counter), defaultdict(Counter)
    groups = set()
    for _, text, lang, source in rows:
        key = (lang or "", source or "")
        groups.add(key)
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(low))
        n[key].update(found)
        df[key[0]].update(set(found))
    out = []
    for lang, source in groups:
        sources = [s for k, s in groups if k == lang]
        kept = [t for t, d in df[lang].items() if d >= min_docs]
        v = len(kept)
        size = {s: sum(n[lang, s][t] for t in kept) for s in sources}
        p = lambda c, total: 1 + 10**9 * (c + 2) // (total + 2 * v)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        mine = {t: p(n[lang, source][t], size[source]) for t in kept}
        pairs = [(-sum(f(mine[t], p(n[lang, o][t], size[o])) for t in kept), o) for o in sources if o != source]
        whole = {t: p(sum(n[lang, s][t] for s in sources), sum(size.values())) for t in kept}
        terms = [(-f(mine[t], whole[t]), t) for t in kept if n[lang, source][t] and mine[t] > whole[t]]
        for part, found, most in (("pair", pairs, None), ("term", terms, top)):
            ordered = sorted(found, key=lambda x: (x[0], x[1].encode()))[:most]
            out += [(lang, source, part, item, -value, r) for r, (value, item) in enumerate(ordered, 1)]
    return sorted(out)


def test_divergence_by_hand(spark, monkeypatch):
    words = ["apple", "Birne", "ÄPFEL", "über", "naïve", "x", "rare", "日本", "k9k"]
    rows = [(i, " ".join(words[(i * j + j) % len(words)] for j in range(i % 13)), ("en", "de", None, "")[i % 4], ("a", "b", None, "", "ü")[i % 5]) for i in range(120)]
    rows += [(7, None, "fr", "a"), (7, "", "fr", "b"), (8, "only once", "it", "z")]
    rows += [rows[5]] * 12 + [(900 + i, f"tie{i % 3} " * 2, "en", "a") for i in range(30)]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], ROWS + ", term int, lane string, i int")
    want = divergence_by_hand(rows, 4, 3)
    names = ("lang", "source", "part", "item", "value", "rank")
    assert rows_of(source_divergence.audit(df, 4, 3), *names) == want
    monkeypatch.setattr(source_divergence, "HELD_TERMS", 5)
    monkeypatch.setattr(source_divergence, "CELLS", 8)
    assert rows_of(source_divergence.audit(df.repartition(3), 4, 3), *names) == want
    assert source_divergence.audit(df.limit(0)).count() == 0


def test_divergence_of_long_texts(spark):
    rows = [(1, "lorem " * 1_500_000 + "ä" * 3_000_000, "en", "a"), (2, "ipsum Lorem " * 9, "en", "b")]
    got = source_divergence.audit(spark.createDataFrame(rows, ROWS), 1, 5)
    assert rows_of(got, "lang", "source", "part", "item", "value", "rank") == divergence_by_hand(rows, 1, 5)


# ---- op13


def phrases_by_hand(rows, max_n, least, cover, top):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, _ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(low)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, max_n + 1):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        many = {p: c for p, c in counts.items() if len(p) > 1 and c >= least}
        found = []
        for p, a in many.items():
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: B023, E731
            if any(len(q) > len(p) and 100 * c >= cover * a and inside(q) for q, c in many.items()):
                continue
            score, _, left, right = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, r, p.decode(), -a, left, right, n[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def test_collocations_by_hand(spark, monkeypatch):
    words = ["the", "of", "New", "York", "é", "\x0e", "x"]
    rows = [(i, "  ".join(words[(i * i + 3 * j + j * j) % 7] + (",", "", "", ".\n", "\t")[(i + j) % 5] for j in range(i % 17)), ("en", None, "und", "de")[i % 4], "s") for i in range(160)]
    rows += [(1, None, "en", "s"), (2, "", "en", "s"), (3, " \t ", "en", "s"), (4, "...;!", "xx", "s")] + [(9, "new york city hall is new york", "en", "s")] * 8
    names = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    df = spark.createDataFrame([(*r, "a", "k", 1.0) for r in rows], ROWS + ", phrase string, words string, h double")
    for block, held, bits in ((1 << 20, 1 << 20, 1 << 27), (60, 10, 1 << 16)):
        monkeypatch.setattr(collocations, "BLOCK_BYTES", block)
        monkeypatch.setattr(collocations, "HELD", held)
        monkeypatch.setattr(collocations, "FILTER_BITS", bits)
        for max_n, least, cover, top in ((4, 5, 80, 2000), (2, 3, 50, 7), (5, 4, 90, 30)):
            got = collocations.collocations(df, max_n, least, cover, top)
            assert rows_of(got, *names) == phrases_by_hand(rows, max_n, least, cover, top)
    assert collocations.collocations(df.limit(0)).count() == 0


def test_filters_that_let_all_through_change_nothing(spark, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = rows_of(collocations.collocations(docs), "lang", "rank", "phrase", "a", "l", "r", "n", "score")
    monkeypatch.setattr(collocations, "frequent_filter", lambda docs, n, filters, min_count=0: collocations.np.full(4, 2**64 - 1, collocations.np.uint64))
    assert rows_of(collocations.collocations(docs), "lang", "rank", "phrase", "a", "l", "r", "n", "score") == want


def test_collocations_of_a_long_text(spark):
    text = "one two three, " * 200_000 + "z" * 5_000_000 + " one two"
    got = collocations.collocations(spark.createDataFrame([(1, text, "en", "s")], ROWS)).collect()
    assert [(r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in got] == [("one two three", 200_000, 200_001, 200_000, 600_003, 999_997)]


# ---- op11

PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def base_by_hand(text):
    out = []
    for k, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0 if k == 2 else False
            if (True, k == 1 and all(int(x) <= 255 for x in m.group().split(".")), 14 <= len(d) <= 19 and luhn, 10 <= len(d) <= 15)[k]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


HARD = [
    None, "", " ", "a@b.c", "x a.b%c@d-e.f.g h@i.j%k@l.m @n.o p@q r@.s t@u..v w@x.y.", "a@b@c.d a@b.c@d.e", "..@.. %@a.b-",
    "1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 01.002.0003.255 1..2.3.4 9.9.9 1.2.3.999.1", "00000000000000000000000001.2.3.4",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111111111111111", "4111  1111 4111111111111111- 5500005555555559 1", "0" * 14 + " x " + "0" * 20 + " 1",
    "+1 (523) 555-1055 +49 30 1234567 ++33 1.2.3 +1 555 +123456789012345 x +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "+1 (2) +3 (4567890123) +1)1", "é日本 a@b.co 🎉 1.2.3.4 🎉 4111111111111111é",
    "call 4111111111111111 4012888888881881 now", "phone +1 (826) 555-4081 190.137.2.44 end", "mail jane.doe (at) mail3 (dot) example.com or joe at host dot org", "2001:0db8:85a3:0000:0000:8a2e:0370:7334",
]


def test_base_spans_by_hand(spark):
    texts = HARD + [" ".join(x) for x in product(["1.2", "4111", "+1 2", "a@b"], [".3", " 1111", "-22", ".c"], [".4 5", " 11111111", "(345) 6789", "@d.e"])]
    df = spark.createDataFrame([(i, t, "clash", 1, None) for i, t in enumerate(texts)] + [(None, "z@y.xx", "c", 1, None), (3, HARD[3], "c", 1, None)], "doc_id long, text string, base string, kind int, s string")
    got = {}
    for r in private_data.detect(df).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for i, t in enumerate(texts):
        assert [tuple(x) for x in got[i][0]["base"]] == base_by_hand(t), t
    assert len(got[3]) == 2 and got[3][0] == got[3][1] and [tuple(x) for x in got[None][0]["base"]] == [(0, 0, 6)]
    assert private_data.detect(df.limit(0)).count() == 0


def test_many_matches_in_one_text(spark):
    text = "".join(f"é{i} u{i}@h.org 10.0.{i % 300}.1, " for i in range(3000))
    runs = "x" * 1_000_000 + "1" * 300_000  # without a match; linear in time
    got = private_data.detect(spark.createDataFrame([(1, text + runs)], "doc_id long, text string")).collect()[0]
    assert [tuple(x) for x in got["base"]] == base_by_hand(text)


def test_added_spans(spark):
    """Numbers that run into others are found again; numbers that fail their check, short ones and hashes are not."""
    docs = [(i, f"the card {4111111111111111} and mail u{i}@host.org or call +1 (523) 555-10{i:02d} host 10.1.2.{i}") for i in range(60)]
    docs += [(100 + i, f"decoy {4111111111111112 + i} version 1.2.{i + 300}.4 order 555-12{i:02d}") for i in range(8)]
    docs += [(200, "card 4111111111111111 4012888888881881 end"), (201, "call +1 (826) 555-4081 190.137.2.44 end"), (202, "hash 9f4111111111111111ab 41111111111111119")]
    got = {r["doc_id"]: [tuple(x) for x in r["added"]] for r in private_data.detect(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got.pop(200) == [(5, 2, 21), (22, 2, 38)] and got.pop(201) == [(5, 3, 22)]
    assert not any(got.values())


def test_posteriors_by_hand(spark):
    """Expectation maximisation over vote patterns, step by step."""
    import math

    votes = private_data.VOTES
    patterns = [(0, 1, 1, 0, 1, 1, 50), (0, 1, 1, 1, 0, 1, 20), (0, -1, 1, 0, 0, -1, 30), (0, 1, -1, 1, 0, 1, 40), (3, -1, -1, -1, -1, -1, 5), (3, 1, 1, 1, 1, 1, 1)]
    df = spark.createDataFrame(patterns, "kind int, " + ", ".join(f"{v} int" for v in votes) + ", n long")
    got = {tuple(r[:6]): r["p"] for r in private_data.posteriors(df).select("kind", *votes, "p").collect()}
    for kind in (0, 3):
        rows = [x[1:] for x in patterns if x[0] == kind]
        clip = lambda x, p: 0.0 if x[1] == -1 else p
        p = [clip(x, 1 / (1 + math.exp(-sum(x[:5])))) for x in rows]
        for _ in range(private_data.STEPS):
            yes, no = sum(x[5] * q for x, q in zip(rows, p)), sum(x[5] * (1 - q) for x, q in zip(rows, p))
            new = []
            for x in rows:
                logit = math.log((yes + 1) / (no + 1))
                for j in range(5):
                    a = sum(y[5] * q for y, q in zip(rows, p) if y[j] == x[j]) + (private_data.STRENGTH if x[j] == 1 else 1)
                    b = sum(y[5] * (1 - q) for y, q in zip(rows, p) if y[j] == x[j]) + (private_data.STRENGTH if x[j] == -1 else 1)
                    logit += math.log(a / (yes + private_data.STRENGTH + 2)) - math.log(b / (no + private_data.STRENGTH + 2))
                new.append(clip(x, 1 / (1 + math.exp(-logit))))
            p = new
        for x, q in zip(rows, p):
            assert got[kind, *x[:5]] == pytest.approx(q, abs=1e-9)


def test_query_returns_digests_of_all_rows_without_python(spark):
    name, query = next(iter(private_data.QUERIES.items()))
    out = query(spark, DATA)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    texts = dict(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect())
    rows = out.collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        spans = base_by_hand(texts[r["doc_id"]])
        said = ",".join(f"{private_data.KINDS[k]}:{a}:{z}" for a, k, z in spans)
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in private_data.KINDS] == [sum(x[1] == i for x in spans) for i in range(4)]
        assert set(filter(None, said.split(","))) <= set(r["spans"].split(","))
