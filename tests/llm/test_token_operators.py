"""Token counts, token files, packing, mixing."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortlens.llm import mixing, packing, token_counts, token_files, tokens
from cohortlens.llm._common import shared_dir

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _t string, start long"
ROWS = [
    (3, "Hello world, hello. <|endoftext|> x", "en", "src0", 1, "clash", 7),
    (1, None, None, None, None, None, None),
    (None, "no id here", "en", "src1", 1, "clash", 7),
    (2, "", "de", "src0", 0, "clash", 7),
    (2, "twice", "de", "src0", 0, "clash", 7),
    (2, "twice", "de", "src0", 0, "clash", 7),
    (9, "é̂ Straße don't " * 4000, "fr", "src2", 1, "clash", 7),
]


def library(text, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_path(tokens.TOKENIZER))
    return t.encode(text or "", add_special_tokens=False).ids + [end]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("aBİéÅ̂क़Σς'’.,!|$ \t\n\x1c\xa012<|endoftext|>st"), max_size=40))
def test_cached_ids_are_the_librarys(text):
    assert np.frombuffer(tokens.encode(text, 5), "<u4").tolist() == library(text, 5)


@pytest.mark.parametrize("bits", [1, 3, 8, 11, 16, 17, 24, 32])
def test_bit_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << min(bits, 31), 999).astype(np.uint32)
    assert (token_files.unpack(token_files.pack(ids, bits), len(ids), bits) == ids).all()
    assert len(token_files.pack(ids, bits)) == -(-999 * bits // 8)
    with pytest.raises(ValueError):
        token_files.pack(np.array([1 << bits if bits < 32 else 0, 1 << 31], np.uint32) if bits < 32 else np.array([2**40]), bits)


def test_bit_width():
    assert [token_files.bit_width(n) for n in (1, 2, 3, 49408, 65536, 65537)] == [1, 1, 2, 16, 16, 17]


def test_token_files(spark, docs):
    manifest = token_files.write(docs, shared_dir(spark, "t"))
    rows = sorted((r for r in token_files.read_back(manifest).collect()), key=lambda r: r["start"])
    order = [r["doc_id"] for r in rows]
    assert order == [None, 1, 2, 2, 2, 3, 9]
    at = 0
    texts = defaultdict(list)
    for i, t, *_ in ROWS:
        texts[i].append(zlib.crc32(np.array(library(t, 2), "<u4").tobytes()))
    for r in rows:
        assert r["start"] == at and r["ids_crc32"] in texts[r["doc_id"]]
        at += r["n_tokens"]
    for r in manifest.collect():  # random access
        f = token_files.Reader(r["path"])
        for i in range(len(f.ids)):
            if f.ids[i] == 9:
                assert f.document(i).tolist() == library(ROWS[-1][1], 2)
    assert token_files.read_back(token_files.write(docs.limit(0), shared_dir(spark, "t"))).count() == 0


def check_packing(rows, texts, size):
    seq, doc = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = texts[(r["doc_id"], r["doc_tokens"])]
        assert ids[r["start"] : r["start"] + r["length"]] == np.frombuffer(r["ids"], "<u4").tolist()
        assert zlib.crc32(r["ids"]) == r["ids_crc32"]
        seq[r["sequence_id"]].append((r["offset"], r["length"]))
        doc[r["doc_id"]].append((r["start"], r["length"]))
    total = 0
    for pieces in seq.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at and n > 0
            at += n
        assert at == size or at & (at - 1) == 0
        total += at
    assert sorted(seq) == list(range(len(seq)))
    return total


def test_packing(spark, docs):
    rows = packing.pack(docs, {"src0": 0.5, "src2": 0.2, "*": 0.3}, size=64).collect()
    texts = {}
    for i, t, *_ in ROWS:
        ids = library(t, 1)
        texts[(i, len(ids))] = ids
    assert check_packing(rows, texts, 64) == sum(len(library(t, 1)) for _, t, *_ in ROWS)
    assert packing.pack(docs.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.sampled_from("abcd"), st.integers(0, 3000), min_size=1), st.integers(0, 2**31))
def test_schedule_fills_every_window_once(totals, seed):
    size, targets = 64, {"a": 0.4, "b": 0.3, "c": 0.2, "d": 0.1}
    plan = packing.schedule(totals, targets, size)
    rng = np.random.default_rng(seed)
    windows, taken = defaultdict(list), defaultdict(lambda: defaultdict(int))
    for q, n in totals.items():
        if not n:
            continue
        cuts = np.unique(np.concatenate(([0, n], rng.integers(0, n, 5))))
        row, first, length, sequence, offset = packing.cut(plan[q], cuts[:-1], cuts[1:], size)
        covered = sorted(zip(first.tolist(), length.tolist()))
        at = 0
        for f, k in covered:
            assert f == at
            at += k
        assert at == n
        for s, o, k in zip(sequence.tolist(), offset.tolist(), length.tolist()):
            windows[s].append((o, k))
            taken[s][q] += k
    for s, parts in windows.items():
        at = 0
        for o, k in sorted(parts):
            assert o == at
            at += k
        assert at == size or at & (at - 1) == 0
    live = [q for q, n in totals.items() if n]
    if len(live) > 1 and min(totals[q] for q in live) > 500:  # while all queues last, none is a token from its share
        share = sum(targets[q] for q in live)
        got = dict.fromkeys(live, 0)
        for k in range(3):
            for q in live:
                got[q] += taken[k][q]
                assert abs(got[q] - (k + 1) * size * targets[q] / share) < 1.1


def test_pfair_keeps_every_source_within_one_block():
    for weights in ({"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 0.97, "b": 0.01, "c": 0.02}, {f"s{i}": 1 / 20 for i in range(20)}):
        w = mixing.units(weights)
        order = [None] * mixing.PERIOD
        for q, slots in mixing.one_period(w).items():
            for s in slots:
                order[s] = q
        assert None not in order and mixing.deviation(order * 2, w) < 1


def earliest_deadline_first(blocks, targets, period):
    """Slot by slot: of the released blocks the one due first runs; when a source runs out, weights and clocks start anew."""
    left, begun, out = dict(blocks), dict.fromkeys(blocks, 0), []
    while left:
        total = sum(targets[q] for q in left)
        exact = {q: targets[q] * period / total for q in left}
        w = {q: max(1, int(x)) for q, x in exact.items()}
        for q in sorted(exact, key=lambda q: (int(exact[q]) - exact[q], q))[: period - sum(w.values())]:
            w[q] += 1
        done, t = dict.fromkeys(left, 0), 0
        while all(left[q] > done[q] for q in left):
            released = [(-(-(n + 1) * period // w[q]), q) for q, n in done.items() if n * period // w[q] <= t]
            q = min(released)[1]
            out.append((q, begun[q] + done[q]))
            done[q] += 1
            t += 1
        begun = {q: begun[q] + done[q] for q in left}
        left = {q: left[q] - done[q] for q in left if left[q] > done[q]}
    return out


def test_mixing_against_a_plain_simulation(spark, docs):
    rows = [(i, "x" * (10 + i % 7), "en", f"src{i % 3}" if i % 5 else None, 1, "clash", 0) for i in range(300)] + ROWS
    df = spark.createDataFrame(rows, SCHEMA)
    targets = {"src0": 0.5, "src1": 0.3, "*": 0.2}
    out = mixing.slots(df, targets, block_chars=100, period=20).collect()
    assert sum(r["n_rows"] for r in out) == len(rows)
    assert all(r["release"] <= r["slot"] < r["due"] for r in out)
    slots = {}
    for r in out:
        assert slots.setdefault(r["slot"], (r["_q"], r["block"])) == (r["_q"], r["block"])
    assert sorted(slots) == list(range(len(slots)))
    left = defaultdict(int)
    for q, b in slots.values():
        left[q] += 1
    assert [slots[t] for t in range(len(slots))] == earliest_deadline_first(dict(left), targets, 20)
    mixed = mixing.mix(df, targets)
    assert mixed.columns == df.columns and mixed.count() == len(rows)
    assert mixing.slots(df.limit(0)).count() == 0 and mixing.mix(df.limit(0)).count() == 0


def test_token_count_rollup(spark):
    r = token_counts.Rollup(spark, shared_dir(spark, "roll"))
    feed = lambda rows: spark.createDataFrame(rows, "doc_id long, tokenizer string, op string, source string, lang string, n_tokens long, seq long, extra string")
    assert r.totals().count() == 0
    first = feed([(1, "t", "upsert", "a", "en", 5, 0, ""), (2, "t", "upsert", "a", "en", 7, 0, ""), (2, "t", "upsert", "a", "en", 7, 0, ""), (3, "t", "upsert", None, None, None, 0, ""), (None, "t", "upsert", "a", "en", 9, 0, "")])
    assert r.commit(1, first) is True and r.commit(1, first) is False
    totals = lambda: {(x["source"], x["lang"]): (x["n_docs"], x["n_tokens"]) for x in r.totals().collect()}
    assert totals() == {("a", "en"): (2, 12), (None, None): (1, 0)}
    with pytest.raises(ValueError):
        r.commit(1, first.limit(1))
    assert r.commit(2, feed([(1, "t", "delete", None, None, None, 1, ""), (8, "t", "delete", None, None, None, 1, ""), (2, "t", "upsert", "b", "en", 3, 1, ""), (2, "t", "upsert", "b", "en", 4, 2, "")]))
    assert totals() == {("b", "en"): (1, 4), (None, None): (1, 0)}
    assert r.commit(3, first.limit(0)) and totals() == {("b", "en"): (1, 4), (None, None): (1, 0)}
    assert [c.batch for c in r.commits()] == [1, 2, 3]


FEED = "doc_id long, tokenizer string, op string, source string, lang string, n_tokens long, seq long"


def test_interrupted_batch_is_written_anew(spark, monkeypatch):
    r = token_counts.Rollup(spark, shared_dir(spark, "roll"))
    rows = spark.createDataFrame([(1, "t", "upsert", "a", "en", 5, 0)], FEED)
    with monkeypatch.context() as m:
        m.setattr(token_counts.Rollup, "_publish", lambda *_: (_ for _ in ()).throw(RuntimeError("lost driver")))
        with pytest.raises(RuntimeError):
            r.commit(1, rows)
    assert r.totals().count() == 0
    assert r.commit(1, rows) and r.totals().first()["n_tokens"] == 5


def test_a_writer_that_dies_within_its_record_leaves_none(spark, monkeypatch):
    folder = shared_dir(spark, "roll")
    r = token_counts.Rollup(spark, folder)
    rows = lambda n: spark.createDataFrame([(1, "t", "upsert", "a", "en", n, 0)], FEED)
    assert r.commit(1, rows(5))
    with monkeypatch.context() as m:
        m.setattr(token_counts, "asdict", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            r.commit(2, rows(6))
    # what is left is an empty file under a hidden name
    left = token_counts.file_system(spark, folder).listStatus(token_counts.hadoop_path(spark, f"{folder}/commits"))
    assert [x.getPath().getName() for x in left if not x.getPath().getName().startswith(("_", "."))] == ["000000000000.json"]
    assert r.totals().first()["n_tokens"] == 5 and r.commit(2, rows(6)) and r.totals().first()["n_tokens"] == 6
    assert [c.batch for c in r.commits()] == [1, 2]


def test_records_are_never_replaced_and_object_stores_refused(spark, monkeypatch):
    r = token_counts.Rollup(spark, shared_dir(spark, "roll"))
    one = token_counts.Commit(1, "x", "p", None, [])
    assert r._publish(0, one) and not r._publish(0, token_counts.Commit(2, "y", "q", None, [])) and r.commits() == [one]

    class Store:
        def getUri(self):
            return self

        def getScheme(self):
            return "s3a"

    monkeypatch.setattr(token_counts, "file_system", lambda *_: Store())
    with pytest.raises(ValueError, match="s3a"):
        r._publish(1, one)


def test_token_folders_by_scheme():
    with pytest.raises(ValueError, match="nosuch"):
        token_files._open("nosuch://a/b")
    assert token_files._open("/tmp/x")[1] == "/tmp/x" and token_files._open("file:///tmp/x")[1] == "/tmp/x"


def test_two_writers_of_one_state(spark, monkeypatch):
    """The second writer publishes while the first one is still writing: the first begins again, nothing is lost."""
    folder = shared_dir(spark, "roll")
    one, two = (token_counts.Rollup(spark, folder) for _ in range(2))
    rows = lambda i, n: spark.createDataFrame([(i, "t", "upsert", "a", "en", n, 0)], FEED)
    write, raced = token_counts.Rollup._write, []

    def racing(self, batch, *rest):
        out = write(self, batch, *rest)
        if self is one and not raced:
            raced.append(two.commit(2, rows(7, 10)))
        return out

    monkeypatch.setattr(token_counts.Rollup, "_write", racing)
    assert one.commit(1, rows(7, 3)) and raced == [True]
    assert [c.batch for c in one.commits()] == [2, 1] and [tuple(r)[-2:] for r in one.totals().collect()] == [(1, 3)]


def test_ledger_is_compacted(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "COMPACT", 2)
    r, want = token_counts.Rollup(spark, shared_dir(spark, "roll"), buckets=3), {}
    rng = np.random.default_rng(1)
    for batch in range(7):
        rows = [(int(i), "t", "delete" if rng.random() < 0.3 else "upsert", f"s{rng.integers(2)}", "en", int(rng.integers(9)), 0) for i in rng.choice(12, 5, replace=False)]
        assert r.commit(batch, spark.createDataFrame(rows, FEED))
        for i, _, op, source, _, n, _ in rows:
            want.pop(i, None)
            if op == "upsert":
                want[i] = (source, n)
        sums = {s: (sum(v[0] == s for v in want.values()), sum(v[1] for v in want.values() if v[0] == s)) for s in {v[0] for v in want.values()}}
        assert {x["source"]: (x["n_docs"], x["n_tokens"]) for x in r.totals().collect()} == sums
    done = r.commits()
    assert max(len(c.runs) for c in done) <= 2 and done[-1].base
    standing = r._ledger(done[-1], None).groupBy("doc_id", "source", "n_tokens").agg({"sign": "sum"}).filter("`sum(sign)` <> 0").collect()
    assert {x["doc_id"]: (x["source"], x["n_tokens"]) for x in standing} == want


def test_cluster_needs_a_shared_folder():
    from types import SimpleNamespace as N

    for master, fails in (("local-cluster[3,2,1024]", True), ("yarn", True), ("local[2]", False), ("local", False)):
        s = N(conf=N(get=lambda *_: None), sparkContext=N(master=master))
        if fails:
            with pytest.raises(ValueError):
                shared_dir(s, "x")
        else:
            assert shared_dir(s, "x")


def test_token_counters(spark):
    df = spark.createDataFrame([("a b c, d12",), (None,), (" \t\n",)], "text string")
    n = [tuple(r) for r in df.select(token_counts.count_tokens("text", token_counts.WORDS), token_counts.count_tokens("text", token_counts.PIECES)).collect()]
    assert n == [(3, 7), (0, 0), (0, 0)]


def test_mixing_counts_every_block_of_a_long_text(spark):
    rows = [(i, "x" * 100, "a") for i in range(100)] + [(1000 + i, "y" * 5000, "b") for i in range(2)] + [(2000, "z" * 500, "b")] * 20
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.slots(df, {"a": 0.5, "b": 0.25, "*": 0.25}, block_chars=100, period=20).collect()
    at = defaultdict(set)
    for r in out:
        assert r["release"] <= r["slot"] < r["due"]
        at[r["_q"]].add(r["slot"])
    assert len(at["a"]) == 100 and len(at["b"]) == 200  # 10,000 and 20,000 characters
    assert sorted(at["a"] | at["b"]) == list(range(300))
    assert sum(r["n_rows"] for r in out) == len(rows)
    w = mixing.units({"a": 0.5, "b": 0.25}, 20)["a"] / 20
    for slot in range(1, 150):  # in every prefix a is less than one block of text away from its share
        assert abs(sum(s < slot for s in at["a"]) - slot * w) < 1


def test_latin_words_skip_the_normalizer_and_keep_the_librarys_ids(monkeypatch):
    """Words of Latin letters, the bulk of a corpus' new words, are not sent through the whole library, at equal ids."""
    cache = tokens._Words(tokens.TOKENIZER)
    whole, asked = cache.tokenizer, []

    class Spy:
        def encode(self, text, **k):
            asked.append(text)
            return whole.encode(text, **k)

    cache.tokenizer = Spy()
    letters = [chr(i) for i in range(33, 0x250)]
    for word in [f"{x}a{x}Ab" for x in letters] + ["été,", "STRASSE...", "Ångström", "ΣΑΣ", "İz", "é"]:
        ids = np.frombuffer(cache[word.encode()], "<u4").tolist()
        assert ids == whole.encode(word, add_special_tokens=False).ids, word
    asked.clear()
    for word in ("Zürich", "naïveté", "Words", "śćież"):
        cache[word.encode()]
    assert asked == []
