"""Pretty JSON with commit and archive, quarantine, tab-separated text in zip files."""

import json
import os
import zipfile

import pytest

from cohortlens.sources import sinks as K
from cohortlens.sources import zipped as Z
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
SCHEMA = "id bigint, text string, tags array<string>, inner struct<trace:string,n:bigint>"


def frame(spark, n=20):
    text = F.when(F.col("id") % 3 == 0, F.concat(F.lit("one\ntwo "), F.col("id").cast("string"))).when(F.col("id") % 3 == 1, "é plain")
    return spark.range(n).select("id", text.alias("text"), F.array(F.lit("a\nb")).alias("tags"), F.struct(F.lit("x\ny").alias("trace"), F.col("id").alias("n")).alias("inner")).repartition(3)


def test_round_trip_of_pretty_json(spark, tmp_path):
    path = str(tmp_path / "out")
    K.write_pretty(frame(spark), path)
    names = os.listdir(path)
    assert names and all(n.startswith("part-") for n in names)
    one = json.loads((tmp_path / "out" / names[0]).read_text())
    assert any(r["text"] == ["one", f"two {r['id']}"] for r in one) and all(r["inner"]["trace"] == ["x", "y"] and r["tags"] == ["a\nb"] for r in one)
    assert (tmp_path / "out" / names[0]).read_text().startswith("[\n    {\n")
    key = lambda r: r["id"]
    assert sorted(K.read_pretty(spark, path, SCHEMA).collect(), key=key) == sorted(frame(spark).collect(), key=key)
    K.write_pretty(frame(spark, 2), path, append=True)
    assert K.read_pretty(spark, path, SCHEMA).count() == 22


def test_what_is_replaced_is_archived(spark, tmp_path):
    path = str(tmp_path / "out")
    K.write_pretty(frame(spark, 5), path)
    K.write_pretty(frame(spark, 3), path)
    assert K.read_pretty(spark, path, SCHEMA).count() == 3
    kept = list((tmp_path / "out" / "_archive").iterdir())
    assert len(kept) == 1 and sum(len(json.loads(f.read_text())) for f in kept[0].iterdir()) == 5
    K.write_pretty(frame(spark, 0), path)
    assert len(list((tmp_path / "out" / "_archive").iterdir())) == 2 and K.archive(path) is None


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    K.write_pretty(frame(spark, 4), path)
    before = sorted(os.listdir(path))

    def fails(batches):
        for b in batches:
            if 17 in b.column("id").to_pylist():
                raise RuntimeError("lost")
            yield b

    with pytest.raises(Exception):  # noqa: B017
        K.write_pretty(frame(spark).select("id").mapInArrow(fails, "id bigint"), path)
    assert sorted(os.listdir(path)) == before and K.read_pretty(spark, path, SCHEMA).count() == 4


def test_a_clean_run_removes_the_quarantine(spark, tmp_path):
    path = str(tmp_path / "quarantine")
    rows = spark.createDataFrame([(1, None), (2, "bad"), (3, None)], "i int, error string")
    assert [r["i"] for r in K.quarantine(rows, "error IS NOT NULL", path).orderBy("i").collect()] == [1, 3]
    assert [r["i"] for r in K.read_pretty(spark, path, "i int, error string").collect()] == [2]
    assert K.quarantine(rows.filter("error IS NULL"), "error IS NOT NULL", path).count() == 2
    assert not [f for f in os.listdir(path) if f.startswith("part-")]
    assert K.quarantine(rows, "error = 'bad'", path).count() == 0  # an unknown is a failure
    assert K.read_pretty(spark, path, "i int").count() == 3


def archive_of(spark, path, compress=zipfile.ZIP_DEFLATED, streamed=False):
    rows = [(r["conv_id"], r["turn"], json.dumps(r["text"])) for r in spark.read.parquet(f"{DATA}/conversations.parquet").orderBy("conv_id", "turn").collect()]
    body = "".join(f"{c}\t{t}\t{x}\n" for c, t, x in rows)

    class Stream:
        """Cannot seek, so that sizes follow the data."""

        def __init__(self, f):
            self.f = f

        def write(self, b):
            return self.f.write(b)

        def flush(self):
            self.f.flush()

    with open(path, "wb") as f, zipfile.ZipFile(Stream(f) if streamed else f, "w", compress) as z:
        z.writestr("readme.txt", "nothing here\n" * 9)
        z.writestr("data/turns.tsv", body)
        z.writestr("data/more.tsv", "7\t0\t\"last\"\r\nonly two\tfields\n8\t1\t\"unfinished\"")
    return rows


@pytest.mark.parametrize("compress, streamed", [(zipfile.ZIP_DEFLATED, False), (zipfile.ZIP_DEFLATED, True), (zipfile.ZIP_STORED, False)])
def test_zips_come_back_row_by_row(spark, tmp_path, compress, streamed):
    rows = archive_of(spark, tmp_path / "a.zip", compress, streamed)
    df = Z.read_tsv_in_zip(spark, str(tmp_path), ["conv_id", "turn", "raw"], r"data/.*\.tsv")
    got = df.withColumn("text", F.get_json_object(F.concat(F.lit('{"t":'), "raw", F.lit("}")), "$.t")).orderBy("member", "line").collect()
    turns = [r for r in got if r["member"] == "data/turns.tsv"]
    assert [(r["conv_id"], r["turn"], r["raw"]) for r in turns] == [(str(c), str(t), x) for c, t, x in rows]
    assert [r["text"] for r in turns] == [json.loads(x) for _, _, x in rows] and [r["line"] for r in turns] == list(range(len(rows)))
    assert [(r["conv_id"], r["line"], r["text"]) for r in got if r["member"] == "data/more.tsv"] == [("7", 0, "last")]


def test_a_cut_archive_gives_its_whole_lines(spark, tmp_path):
    rows = archive_of(spark, tmp_path / "a.zip")
    whole = (tmp_path / "a.zip").read_bytes()
    for share in (0.3, 0.6, 0.9):
        folder = tmp_path / f"cut{share}"
        folder.mkdir()
        (folder / "cut.zip").write_bytes(whole[: int(len(whole) * share)])
        got = Z.read_tsv_in_zip(spark, str(folder), ["c", "t", "x"], "data/turns.tsv").orderBy("line").collect()
        assert 0 < len(got) < len(rows) and [(r["c"], r["x"]) for r in got] == [(str(c), x) for c, _, x in rows[: len(got)]]


def test_a_large_member_is_held_in_parts(tmp_path):
    with zipfile.ZipFile(tmp_path / "big.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x", b"a\tb\n" * 5_000_000)
    with open(tmp_path / "big.zip", "rb") as f:
        name, parts = next(Z.members(f))
        sizes = [len(p) for p in parts]
    assert name == "x" and sum(sizes) == 20_000_000 and max(sizes) <= Z.STEP
