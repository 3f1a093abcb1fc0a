"""Language ID by Bayesian evidence fusion.

log posterior = log P(language | host) + text log-likelihood / TEMPER
                + log P(declared markup language | language) + log P(address suffix | language)

The prior of a host and the likelihood of its suffix are two things here: the suffix does not
take part in the smoothing of hosts, so that it counts once.

The text model is multinomial over all lower-cased words, hashed to BUCKETS and counted over
all labelled documents by grouped aggregation. The other tables are counted over the pages
themselves, with each page's text posterior as its label: the host prior is
smoothed towards its registered domain's, and that one towards the language shares of all
pages, each with SMOOTH pseudo-pages; a suffix's likelihood in each language towards its share of all pages.

Defined cases
- null html or no text: the other evidence decides. Null url: host, domain and suffix are "".
- no declared language: no such factor. Unknown words weigh alike in all languages.
- ties: the smaller language code. Nothing known at all: the most frequent language.
- null or repeated page_id: every row is judged by its own content.
- no labelled documents, or no pages: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Query, materialise, read

SMOOTH = 5.0
#: Words of one text are far from independent: the log-likelihood is divided by its word count over this.
TEXT_WORDS = 12.0
#: Share of pages whose markup or suffix says another language than theirs, at the least.
ERROR = 0.02
#: Places of the word table, the bound on what is broadcast: every word has one by its hash, none is left out.
BUCKETS = 1 << 18
#: Letters of scripts without spaces between words (Thai to Khmer, kana, Han): each is a word, as a run of them is a sentence.
_ALONE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff"
_ALONE_WIDE = (0x20000, 0x3FFFF)
_OPEN = re.compile(r"<(?:(script|style|head|nav|template)\b|!--)", re.I)
_CLOSE = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "head", "nav", "template")} | {"!--": re.compile("-->")}
_TAG = re.compile(r"<[^>]*>")
_ANY = f"[{_ALONE}{chr(_ALONE_WIDE[0])}-{chr(_ALONE_WIDE[1])}]"
_WORD = re.compile(rf"{_ANY}|[^\W\d_{_ANY[1:-1]}]+")
_JAVA = r"[%s\x{%x}-\x{%x}]" % (_ALONE, *_ALONE_WIDE)
_JAVA_WORD = rf"{_JAVA}|[\p{{L}}&&[^{_JAVA[1:-1]}]]+"


def without_hidden(html: str) -> str:
    """Hidden elements and comments as a space. One that is never closed stays; its kind is not searched for again, so a page takes linear time."""
    out, kept, at, unclosed = [], 0, 0, set()
    while m := _OPEN.search(html, at):
        at, kind = m.end(), (m[1] or "!--").lower()
        if kind in unclosed:
            continue
        end = _CLOSE[kind].search(html, at)
        if not end:
            unclosed.add(kind)
            continue
        out.append(html[kept : m.start()])
        kept = at = end.end()
    return " ".join([*out, html[kept:]])


def visible_text(html: str | None) -> str:
    if not html:
        return ""
    shown = without_hidden(html)
    last = shown.rfind(">") + 1  # behind it no tag ends
    return unescape(_TAG.sub(" ", shown[:last]) + shown[last:])


@lru_cache(maxsize=200_000)
def _bucket(word: str) -> int:
    return zlib.crc32(word.encode()) % BUCKETS


def word_model(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, for each word bucket its log-probability in each language, and which buckets hold a word.

    A bucket's share in a language is its own plus that of one more word among all languages' words.
    So a word that one language has never shown weighs as little there as in any other, however few its words are.
    """
    good = docs.filter("lang IS NOT NULL AND text IS NOT NULL")
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(_JAVA_WORD), F.lit(0)))
    counts = good.select("lang", word.alias("w")).groupBy("lang", (F.crc32("w") % BUCKETS).cast("int").alias("b")).agg(F.count("*").alias("n"))
    found = counts.toArrow()  # at most BUCKETS rows a language
    langs = sorted(found.column("lang").unique().to_pylist())
    n = np.zeros((BUCKETS, len(langs)))
    at = pa.compute.index_in(found.column("lang"), pa.array(langs, pa.string())).to_numpy()
    n[found.column("b").to_numpy(), at] = found.column("n").to_numpy()
    if not langs:
        return langs, n, n.any(1)
    return langs, np.log(n / n.sum(0) + 1 / n.sum()), n.any(1)


def features(pages: DataFrame, langs: list[str], model: np.ndarray, seen: np.ndarray) -> DataFrame:
    """page_id, host, domain, suffix, declared, n_words and text (the tempered log-likelihood of each language)."""
    shared = pages.sparkSession.sparkContext.broadcast((model.astype(np.float32), seen))
    host = F.regexp_extract(F.lower(F.coalesce("url", F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    declared = F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1))
    path = F.regexp_extract(F.lower(F.coalesce("url", F.lit(""))), r"^[a-z][a-z0-9+.-]*://[^/]*/([a-z]{2})(?:[/?#]|$)", 1)
    rows = pages.select(
        "page_id", host.alias("host"), F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("domain"), F.regexp_extract(host, r"([^.]+)$", 1).alias("suffix"),
        declared.alias("declared"), F.when(path.isin(langs), path).otherwise("").alias("path_language"), "html",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = shared.value
        for b in batches:
            n, text = [], []
            for html in b.column("html").to_pylist():
                found = np.fromiter(map(_bucket, _WORD.findall(visible_text(html).lower())), np.int64)
                found = found[seen[found]]
                n.append(len(found))
                scale = min(1.0, TEXT_WORDS / len(found)) if len(found) else 0.0
                text.append((table[found].sum(0, dtype=np.float64) * scale).tolist())
            keep = [c for c in b.schema.names if c != "html"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(n, pa.int64()), pa.array(text, pa.list_(pa.float64()))], [*keep, "n_words", "text"])

    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, host string, domain string, suffix string, declared string, path_language string, n_words long, text array<double>"
    return rows.mapInArrow(run, schema)


def _posterior(logs: F.Column) -> F.Column:
    e = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def _sums(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Sums of the posterior vector p by keys, as an array m."""
    each = [F.sum(F.round(F.col("p")[i] * 1_000_000).cast("long")).alias(f"_{i}") for i in range(k)]  # whole numbers: the same in any order
    return df.groupBy(*keys).agg(*each).select(*keys, F.array(*(F.col(f"_{i}") / 1e6 for i in range(k))).alias("m"))


def _smoothed(m: str, prior: str) -> F.Column:
    total = F.aggregate(F.col(m), F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(m, prior, lambda x, q: (x + SMOOTH * q) / (total + SMOOTH))


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, host, declared, suffix, n_words, language, confidence and text_language of every page."""
    langs, model, known = word_model(docs)
    k = len(langs)
    if not k:
        return pages.limit(0).select("page_id", *(F.lit("").alias(c) for c in ("host", "declared", "suffix")), F.lit(0).cast("long").alias("n_words"), F.lit("").alias("language"), F.lit(0.0).alias("confidence"), F.lit("").alias("text_language"))
    rows = materialise(features(pages, langs, model, known), "language-features")
    rows = rows.withColumn("p", _posterior(F.col("text")))
    seen = rows.filter("n_words > 0")
    # host priors: three levels of grouped aggregation, each smoothed towards the one above; suffixes beside them
    hosts = _sums(seen, ["host", "domain", "suffix"], k)
    up = lambda df, keys: df.groupBy(*keys).agg(F.array(*(F.sum(F.col("m")[i]) for i in range(k))).alias("m"))
    suffixes = up(hosts, ["suffix"])
    overall = suffixes.agg(F.array(*(F.coalesce(F.sum(F.col("m")[i]), F.lit(0.0)) for i in range(k))).alias("m")).select(_smoothed_even(k).alias("q0"))
    totals = suffixes.agg(F.array(*(F.coalesce(F.sum(F.col("m")[i]), F.lit(0.0)) for i in range(k))).alias("all"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    share = total(F.col("m")) / F.greatest(total(F.col("all")), F.lit(1e-9))
    likely = F.zip_with("m", "all", lambda x, n: F.log((1 - ERROR) * (x + SMOOTH * share) / (n + SMOOTH) + ERROR * share))
    suffixes = suffixes.crossJoin(F.broadcast(totals)).select("suffix", likely.alias("by_suffix"))  # one row of totals
    domains = up(hosts, ["domain", "suffix"]).crossJoin(F.broadcast(overall)).select("domain", "suffix", _smoothed("m", "q0").alias("q2"))
    hosts = hosts.join(domains, ["domain", "suffix"]).select("host", _smoothed("m", "q2").alias("q3"))
    q0 = overall.first()["q0"]
    even = F.array(*(F.lit(float(x)) for x in q0))
    # what declared markup and address paths say, given the language
    votes = {}
    for c in ("declared", "path_language"):
        table = {r[c]: r["m"] for r in _sums(seen.filter(F.col(c).isin(langs)), [c], k).collect()}  # at most k rows
        size = [sum(m[i] for m in table.values()) for i in range(k)]
        p = lambda v, i: (1 - ERROR) * (table.get(v, [0.0] * k)[i] + SMOOTH * (v == langs[i]) + 1 / k) / (size[i] + SMOOTH + 1) + ERROR / k  # noqa: B023, E731
        votes[c] = F.create_map(*(x for v in langs for x in (F.lit(v), F.array(*(F.lit(math.log(p(v, i))) for i in range(k))))))
    zero = F.array(*(F.lit(0.0) for _ in range(k)))
    vote = lambda c: F.coalesce(F.element_at(votes[c], F.col(c)), zero)
    out = rows.join(hosts, "host", "left").join(suffixes, "suffix", "left").withColumn("prior", F.transform(F.coalesce("q3", even), lambda x: F.log(F.greatest(x, F.lit(1e-9)))))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    evidence = F.col("prior")
    for one in (F.col("text"), vote("declared"), F.coalesce("by_suffix", zero), vote("path_language")):
        evidence = add(evidence, one)
    out = out.withColumn("post", _posterior(evidence))
    names = F.array(*(F.lit(g) for g in langs))
    best = lambda c: names[(F.array_position(c, F.array_max(c)) - 1).cast("int")]
    return out.select("page_id", "host", "declared", "suffix", "n_words", best(F.col("post")).alias("language"), F.array_max("post").alias("confidence"), F.when(F.col("n_words") > 0, best(F.col("p"))).alias("text_language"))


def _smoothed_even(k: int) -> F.Column:
    total = F.aggregate(F.col("m"), F.lit(0.0), lambda a, x: a + x)
    return F.transform("m", lambda x: (x + SMOOTH / k) / (total + SMOOTH))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "pages"), read(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {"op2_language_id": op2_language_id}
ORACLE: dict[str, str] = {}
