"""Token counts: rollups kept up to date by signed deltas.

A table folder holds, for each committed batch, signed document rows
(``batch=<id>/rows``: +1 for an insert, -1 for a delete, both for a revision)
and the totals after it (``batch=<id>/totals``), by source, language and
tokenizer version. Totals are additive: a batch adds its own signed rows to them.

A change is (doc_id, tokenizer, op, source, lang, n_tokens); op is "upsert" or
"delete". What a document counted before comes from the ledger, the sum of all
signed rows, so feeds need not carry old values. The ledger is dealt into
BUCKETS by a hash of doc_id, and a batch reads the buckets of its own documents
alone; after COMPACT batches their rows are summed into one (``batch=<id>/base``),
so that a bucket is at most COMPACT + 1 pieces however many batches there were.

A batch is committed by the last thing written, its record in ``commits``. A record
is written under a hidden name and then given its own, its place in the order, which
is done at once and only if the name is free. So a record is whole or not there, and
of two writers that start from the same state one commits and the other begins again
from the new state. An interrupted batch has no record and is written anew; one that
is replayed changes nothing. File systems that may rename onto a file (object stores)
are refused.

Defined cases
- null source or lang: a group of its own. Null text: zero tokens.
- null doc_id, tokenizer or op: the change is ignored.
- several changes of one document and tokenizer in a batch: the one of the
  greatest ``seq`` counts; of equal seq a delete, then the most tokens.
- delete of an unknown document: nothing. Equal upsert: nothing.
- an empty batch is committed and changes nothing. Extra columns are ignored.
- a batch id committed with other content: an error.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from py4j.protocol import Py4JJavaError

from ._common import Query, file_system, hadoop_path, materialise, read, shared_dir

GROUP = ["source", "lang", "tokenizer"]
ROWS = "doc_id long, tokenizer string, source string, lang string, n_tokens long, sign int"
TOTALS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
#: Schemes of file systems whose rename fails if the target exists.
RENAMES = ("hdfs", "viewfs", "abfs", "abfss")
#: Parts of the ledger, and batches after which their rows are summed.
BUCKETS, COMPACT = 16, 8
#: Tokenizer versions that SQL can express: white-space words, and letter or digit runs and single marks.
WORDS, PIECES = "words-1", "pieces-2"


def count_tokens(text: Column | str, tokenizer: str) -> Column:
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    pattern = {WORDS: r"[^\x20\x09-\x0D]+", PIECES: r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9\x00-\x20]"}[tokenizer]
    return F.regexp_count(text, F.lit(pattern)).cast("long")


@dataclass
class Commit:
    """``place``: the folder of the batch's rows and totals; ``base``: the folder of a compacted ledger, ``runs``: those of the batches since."""

    batch: int
    checksum: str
    place: str
    base: str | None
    runs: list[str]


class Rollup:
    """A delta-maintained rollup in one folder."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS) -> None:
        self.spark, self.folder, self.buckets = spark, folder, buckets

    def commits(self) -> list[Commit]:
        """In order; a record for each batch, a few hundred bytes."""
        path, fs = f"{self.folder}/commits", file_system(self.spark, self.folder)
        if not fs.exists(hadoop_path(self.spark, path)):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(hadoop_path(self.spark, path)))
        names = [n for n in names if n.endswith(".json")]
        io, out = self.spark._jvm.org.apache.commons.io.IOUtils, []
        for n in names:
            stream = fs.open(hadoop_path(self.spark, f"{path}/{n}"))
            try:
                out.append(Commit(**json.loads(bytes(io.toByteArray(stream)).decode())))
            finally:
                stream.close()
        return out

    def _publish(self, n: int, record: Commit) -> bool:
        """Puts the n-th record in place, whole; False if there is one. A writer that dies before leaves a hidden file that nobody reads."""
        fs, target = file_system(self.spark, self.folder), hadoop_path(self.spark, f"{self.folder}/commits/{n:012d}.json")
        scheme = fs.getUri().getScheme()
        if scheme not in RENAMES and scheme != "file":
            raise ValueError(f"commits need a file system that never renames onto an existing file ({', '.join(RENAMES)}, file), not {scheme}")
        part = hadoop_path(self.spark, f"{self.folder}/commits/_{n:012d}.{uuid4().hex}")
        stream = fs.create(part, False)
        stream.write(bytearray(json.dumps(asdict(record)).encode()))
        stream.close()
        try:
            if scheme != "file":
                return bool(fs.rename(part, target))
            # a local rename would replace a record; a second name for a file is given only if it is free
            local = lambda x: self.spark._jvm.java.nio.file.Paths.get(fs.makeQualified(x).toUri().getPath(), self.spark.sparkContext._gateway.new_array(self.spark._jvm.String, 0))
            self.spark._jvm.java.nio.file.Files.createLink(local(target), local(part))
            return True
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception):
                return False
            raise
        finally:
            fs.delete(part, False)

    def _ledger(self, last: Commit | None, buckets: list[int] | None) -> DataFrame:
        """Signed rows that stand in the ledger, of all buckets or of some."""
        places = [] if last is None else [*([last.base] if last.base else []), *last.runs]
        rows = None
        for p in places:
            try:
                part = self.spark.read.schema(f"{ROWS}, bucket int").parquet(p)
            except AnalysisException:  # a batch of no rows
                continue
            rows = part if rows is None else rows.union(part)
        if rows is None:
            return self.spark.createDataFrame([], f"{ROWS}, bucket int")
        return rows if buckets is None else rows.filter(F.col("bucket").isin(buckets))

    def totals(self) -> DataFrame:
        """n_docs and n_tokens by source, lang and tokenizer after the last committed batch."""
        return self._totals(self.commits())

    def _totals(self, done: list[Commit]) -> DataFrame:
        if not done:
            return self.spark.createDataFrame([], TOTALS)
        return self.spark.read.schema(TOTALS).parquet(f"{done[-1].place}/totals")

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Applies a batch; False if it was committed before."""
        bucket = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(self.buckets)).cast("int")
        changes = changes.filter("doc_id IS NOT NULL AND tokenizer IS NOT NULL AND op IN ('upsert', 'delete')").select(
            F.col("doc_id").cast("long").alias("doc_id"), "tokenizer", "op", "source", "lang", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"), F.col("seq").cast("long").alias("seq")
        )
        changes = materialise(changes, "token-changes")
        found = changes.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*changes.columns).cast("decimal(38,0)")).alias("sum"), F.collect_set(bucket).alias("buckets")).first()
        while True:
            done = self.commits()
            for c in done:
                if c.batch == batch:
                    if c.checksum != f"{found['n']}:{found['sum']}":
                        raise ValueError(f"batch {batch} was committed with other content")
                    return False
            if self._publish(len(done), self._write(batch, changes, f"{found['n']}:{found['sum']}", found["buckets"], done)):
                return True

    def _write(self, batch: int, changes: DataFrame, checksum: str, buckets: list[int], done: list[Commit]) -> Commit:
        """Rows, totals and now and then a compacted ledger of a batch, in a folder of its own."""
        key = ["doc_id", "tokenizer"]
        order = Window.partitionBy(*key).orderBy(F.col("seq").desc_nulls_last(), F.col("op"), F.desc("n_tokens"), F.col("source"), F.col("lang"))
        new = changes.withColumn("_n", F.row_number().over(order)).filter("_n = 1").select(*key, "op", "source", "lang", "n_tokens")
        last = done[-1] if done else None
        # the ledger's rows of these documents alone; what stands there now is what signed rows do not cancel
        old = self._ledger(last, buckets).join(new.select(*key), key, "left_semi")
        old = old.groupBy(*key, "source", "lang", "n_tokens").agg(F.sum("sign").alias("sign")).filter("sign <> 0")
        minus = old.select(*key, "source", "lang", "n_tokens", (-F.col("sign")).cast("int").alias("sign"))
        plus = new.filter("op = 'upsert'").select(*key, "source", "lang", "n_tokens", F.lit(1).alias("sign"))
        delta = minus.union(plus).groupBy(*key, "source", "lang", "n_tokens").agg(F.sum("sign").cast("int").alias("sign")).filter("sign <> 0")
        bucket = F.pmod(F.xxhash64("doc_id"), F.lit(self.buckets)).cast("int").alias("bucket")
        place = f"{self.folder}/batch={batch}/{uuid4().hex}"
        self._put(delta.select("doc_id", "tokenizer", "source", "lang", "n_tokens", "sign", bucket), f"{place}/rows")
        record = Commit(batch, checksum, place, last.base if last else None, [*(last.runs if last else []), f"{place}/rows"])
        signed = self._ledger(Commit(batch, checksum, place, None, [f"{place}/rows"]), None).select(*GROUP, F.col("sign").cast("long").alias("n_docs"), (F.col("sign") * F.col("n_tokens")).alias("n_tokens"))
        # a hot group is summed within each task first
        totals = self._totals(done).unionByName(signed).groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).filter("n_docs <> 0 OR n_tokens <> 0")
        totals.write.parquet(f"{place}/totals")
        if len(record.runs) > COMPACT:
            rows = self._ledger(record, None).groupBy(*key, "source", "lang", "n_tokens", "bucket").agg(F.sum("sign").cast("int").alias("sign")).filter("sign <> 0")
            self._put(rows.select("doc_id", "tokenizer", "source", "lang", "n_tokens", "sign", "bucket"), f"{place}/base")
            record.base, record.runs = f"{place}/base", []
        return record

    def _put(self, rows: DataFrame, path: str) -> None:
        """Rows by bucket; a task writes few files, as each holds few buckets."""
        rows.repartition("bucket", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4))).sortWithinPartitions("bucket").write.partitionBy("bucket").parquet(path)


def changes(docs: DataFrame, tokenizer: str, op: str = "upsert", seq: int = 0) -> DataFrame:
    """A feed of one kind of change for all rows of docs (doc_id, text, source, lang)."""
    n = count_tokens("text", tokenizer) if op == "upsert" else F.lit(0).cast("long")
    return docs.select("doc_id", F.lit(tokenizer).alias("tokenizer"), F.lit(op).alias("op"), "source", "lang", n.alias("n_tokens"), F.lit(seq).cast("long").alias("seq"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches over the whole of documents: all are inserted; ids with remainder 3 modulo 10 are
    deleted and those with remainder 7 revised to half their text under the same tokenizer; then all of
    remainder 3 modulo 20 come back under the second tokenizer as well. The second is sent twice."""
    docs = read(spark, sf_dir, "documents")
    ledger = Rollup(spark, shared_dir(spark, "token-counts"))
    ledger.commit(1, changes(docs, WORDS).unionByName(changes(docs, PIECES)))
    gone = changes(docs.filter("doc_id % 10 = 3"), WORDS, "delete", 1)
    half = docs.filter("doc_id % 10 = 7").withColumn("text", F.substring("text", F.lit(1), F.floor(F.length("text") / 2).cast("int")))
    second = gone.unionByName(changes(half, WORDS, seq=1))
    ledger.commit(2, second)
    ledger.commit(2, second)
    ledger.commit(3, changes(docs.filter("doc_id % 20 = 3"), WORDS, seq=2))
    return ledger.totals()


_SQL_WORDS = r"len(regexp_extract_all({t}, '[^\x20\x09-\x0D]+'))"
_SQL_PIECES = r"len(regexp_extract_all({t}, '[A-Za-z]+|[0-9]+|[^A-Za-z0-9\x00-\x20]'))"
ORACLE: dict[str, str] = {
    "op1_token_counts": f"""
WITH d AS (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents WHERE doc_id IS NOT NULL),
live AS (
  SELECT source, lang, '{WORDS}' AS tokenizer,
         CASE WHEN doc_id % 10 = 7 THEN {_SQL_WORDS.format(t="substr(t, 1, length(t) // 2)")} ELSE {_SQL_WORDS.format(t="t")} END AS n
  FROM d WHERE doc_id % 10 <> 3 OR doc_id % 20 = 3
  UNION ALL
  SELECT source, lang, '{PIECES}' AS tokenizer, {_SQL_PIECES.format(t="t")} AS n FROM d)
SELECT source, lang, tokenizer, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens
FROM live GROUP BY source, lang, tokenizer"""
}
QUERIES: dict[str, Query] = {"op1_token_counts": op1_token_counts}
