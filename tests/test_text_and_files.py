import dataclasses
import json

import pytest

from cohortlens.functions import parsing as J
from cohortlens.functions import text as T
from cohortlens.operators import etl
from cohortlens.operators import relational as R
from cohortlens.sources import files
from pyspark.sql import functions as F


def test_reply_parsing():
    assert J.from_reply('<think>no {"a": 2}</think> Sure:\n```json\n{"a": [1, 2,], "b": "x}"}\n``` bye') == '{"a": [1, 2], "b": "x}"}'
    assert J.from_reply('{"a": 1, "b": [1, 2') == '{"a": 1, "b": [1, 2]}'
    assert J.from_reply("nothing here") is None and J.from_reply(None) is None
    assert J.balanced_block('x ["]", {"k": 1}] y') == '["]", {"k": 1}]'
    assert J.loads('{"text": "a, ] b"}') == {"text": "a, ] b"}


def test_annotator_answers_bind_by_index():
    assert [r["m"] for r in J.bind_by_index('[{"i": 2, "m": 0}, {"i": 1, "m": 1}]', 2)] == [1, 0]
    for bad in ('[{"i": 1}]', '[{"i": 1}, {"i": 1}]', "no", '{"i": 1}'):
        with pytest.raises(ValueError):
            J.bind_by_index(bad, 2)


def test_reply_column(spark):
    df = spark.createDataFrame([('x {"a": 1}',), (None,)], "r string")
    assert [r[0] for r in df.select(J.json_of_reply(F.col("r"))).collect()] == ['{"a": 1}', None]


def test_json_files(tmp_path, spark):
    p = tmp_path / "a.json"
    p.write_bytes(b"\xef\xbb\xbf" + b'{"a": 1,}')
    assert files.load_json(p) == {"a": 1}
    p.write_bytes("{\"a\": \"é\"}".encode("latin-1"))
    assert files.load_json(p) == {"a": "é"}
    p.write_text("")
    assert files.load_json(p, []) == [] and files.load_json(tmp_path / "none", 3) == 3
    (tmp_path / "l.jsonl").write_text('{"id": "a", "n": 1}\n\n{"id": "b", "n"\n{"id": "c", "n": 3}\n')
    rows = files.read_jsonl(spark, str(tmp_path / "l.jsonl"), "id string, n long").collect()
    assert sorted(r["id"] for r in rows) == ["a", "c"]
    df = spark.createDataFrame([("x", "one\ntwo")], "id string, text string")
    assert files.joined_lines(files.readable_lines(df, "text"), "text").first()["text"] == "one\ntwo"
    files.write_jsonl(df, str(tmp_path / "out"))
    files.write_jsonl(df, str(tmp_path / "out"), append=True)
    assert files.read_jsonl(spark, str(tmp_path / "out"), "id string, text string").count() == 2


def test_csv_xml_truth(tmp_path, spark):
    (tmp_path / "a.csv").write_text('id,text\n1,"a ""b""\nc"\n')
    assert files.read_csv(spark, str(tmp_path / "a.csv"), "id int, text string").first()["text"] == 'a "b"\nc'
    (tmp_path / "a.xml").write_text("<author><documents><document>x</document><document>y</document></documents></author>")
    assert sorted(r[0] for r in files.read_xml(spark, str(tmp_path / "a.xml"), "document", "_VALUE string").collect()) == ["x", "y"]
    (tmp_path / "t.txt").write_text("a:::f:::gb\n\nb:::m:::us\n")
    assert files.read_truth(spark, str(tmp_path / "t.txt"), ["author", "gender", "variety"]).count() == 2


@dataclasses.dataclass
class Inner:
    n: int = 1


@dataclasses.dataclass
class Outer:
    inner: Inner = dataclasses.field(default_factory=Inner)
    name: str = "x"


def test_layered_settings(tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"_note": "?", "inner": {"n": 5}}))
    assert files.layered(Outer(), tmp_path / "a.json") == Outer(Inner(5))
    with pytest.raises(KeyError):
        files.patched(Outer(), {"inner": {"m": 1}})


def test_cache_and_markdown(spark):
    req = spark.createDataFrame([("a",), ("b",)], "request_id string")
    cache = spark.createDataFrame([("a", "yes")], "request_id string, answer string")
    assert [r[0] for r in files.misses(req, cache).collect()] == ["b"]
    assert files.with_answers(req, cache).filter("cached").count() == 1
    assert files.markdown_table(cache).splitlines()[2] == "| a | yes |"


def test_text_expressions(spark):
    df = spark.createDataFrame([("It’s the fooBar Baz!  No. 2\nx", "YES, surely"), (None, "maybe")], "t string, a string")
    r = df.select(T.word_tokens(F.col("t")).alias("w"), T.normalized_phrase(F.col("t")).alias("p"), T.axis_id(F.col("t")).alias("x"), T.yes_no(F.col("a")).alias("v"), T.first_words(F.col("t"), 2).alias("f")).collect()
    assert r[0]["w"] == ["it's", "the", "foobar", "baz", "no", "x"] and r[0]["p"] == "it s the foobar baz no 2" and r[0]["v"] is True and r[0]["f"] == "It’s the"
    assert r[1]["w"] == [] and r[1]["p"] == "unknown request" and r[1]["v"] is None and r[1]["f"] == ""


def test_slices_match_whole_elements(spark):
    df = spark.createDataFrame([(["Woman"], "0"), (["Man", "Non-binary"], "18-24"), ([], "")], "gender array<string>, age string")
    n = lambda c, op, v: df.filter(R.slice_mask(c, op, v)).count()
    assert (n("gender", "contains", "man"), n("gender", "contains_text", "man"), n("gender", "not_contains", "man")) == (1, 2, 1)
    assert (n("age", "not_in", "*"), n("age", "in", "*,18-24"), n("age", "eq", "0")) == (1, 3, 1)


def test_interleave_and_jaccard(spark):
    df = spark.createDataFrame([("target", i) for i in range(4)] + [("baseline", i) for i in range(2)], "side string, k int")
    rows = R.interleave(df, "side", "k").orderBy("place").collect()
    assert [r["place"] for r in rows] == [1, 2, 3, 4, 5, 6] and [r["side"][0] for r in rows] == list("tbtbtt")
    sets = spark.createDataFrame([(1, list("abcde")), (2, list("abcdf")), (3, list("xyz")), (4, [])], "id int, w array<string>")
    assert [tuple(r) for r in R.jaccard_pairs(sets, "id", "w", 0.6).collect()] == [(1, 2, pytest.approx(4 / 6, abs=1e-6))]


def test_greedy_pack(spark):
    posts = [("a", i, " ".join(f"w{i}" for _ in range(50))) for i in range(5)] + [("b", 0, "short"), ("c", 0, None)]
    out = etl.greedy_pack(spark.createDataFrame(posts, "author_id string, place int, text string")).orderBy("author_id", "chunk").collect()
    assert [(r["author_id"], r["chunk"], len(r["text"].split())) for r in out] == [("a", 0, 100), ("a", 1, 100), ("a", 2, 50)]
