"""Personal data by weak supervision: labelers vote on candidate spans, expectation maximisation weighs them, a classifier decides.

Only DataFrame and SQL functions. The base rules of each kind (a pattern and a
check) give spans that always stay. Beside them stand candidates: matches that fail
their check, and matches of wider patterns (cards and phone numbers that run into
other digits, numbers without a country code, IPv6, addresses written with "(at)" or
"dot"). Five labelers vote for, against or not at all on every candidate, the base
spans among them: the usual form (regex), a check sum or range (regex), a list of
issuers, calling codes or domains (gazetteer), words before it (context), and what
stands directly beside it (context). Votes of a kind are counted by pattern, at most
3^5; expectation maximisation over these counts estimates how often each labeler is
right about true and about false spans, from a prior that it is right more often than
not. A span that fails its check (a card number without the check sum) is known to be
false: that anchors the estimates, as the other labelers take many such numbers for cards. The posteriors are the soft labels on which a naive Bayes classifier of span
features is fitted, by one aggregation. A candidate that it takes for personal data,
and that overlaps neither a base span nor an earlier added one, is added.

Texts are read once and not exchanged. Positions are sums of the lengths of matches
and of what lies between, added up in two levels, so a text of many matches takes
little more than linear time. Only documents with candidates beyond the base are
looked at again; what is sent to all tasks are the posteriors (4 x 3^5 rows at most)
and the weights (one row a kind).

Defined cases
- null or empty text: no spans; counts are zero, the digest is that of no bytes.
- n_email to n_phone count base spans; added ones are in ``spans`` alone.
- spans of different kinds may overlap among base spans; within a kind they don't.
- equal rows get equal answers, each its own row. Extra columns are ignored.
- empty table: no rows. No candidate of a kind, or none but base spans: nothing is added.
- doc_id may be null; documents are told apart by doc_id and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import Query, materialise, read

#: Kinds in the order of their numbers.
KINDS = ("email", "ip", "card", "phone")
STEPS, STRENGTH = 12, 4
#: Characters before a span in which cues are looked for, and matches whose lengths are added up at once.
CONTEXT, BLOCK = 40, 256
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Pattern of each kind's base rule. Possessive repeats and looks behind keep the same matches and take linear time.
BASE = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
#: Wider patterns. Runs of digits are taken whole, so that no number begins within another.
WIDE = (
    r"[A-Za-z0-9._%+-]{1,64} ?[\[(] ?(?:at|AT) ?[\])] ?[A-Za-z0-9-]{1,63}(?:(?: ?[\[(] ?(?:dot|DOT) ?[\])] ?|\.)[A-Za-z0-9-]{1,63}){1,8}|[A-Za-z0-9._%+-]{1,64} (?:at|AT) [A-Za-z0-9-]{1,63}(?: (?:dot|DOT) [A-Za-z0-9-]{1,63}){1,8}",
    r"[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}",
    r"[0-9]{4} [0-9]{4} [0-9]{4} [0-9]{4}|[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{4}|3[47][0-9]{2} [0-9]{6} [0-9]{5}|[0-9]+",
    r"(?:\+[0-9]{1,3}[ .-]?|00[0-9]{1,3}[ .-])?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}|[0-9]+",
)
#: What a text must hold for a kind's patterns to be tried: of the base rule, of the wide pattern.
GUARDS = (("@", r"[\])]|dot|DOT"), (r"[0-9]\.[0-9]", r":[0-9A-Fa-f]{1,4}:"), ("[0-9][0-9 -][0-9]", "[0-9]{4}"), (r"\+[0-9]", "[0-9]{4}"))
DOMAINS = ("com", "org", "net", "edu", "gov", "info", "biz", "io", "co", "de", "fr", "es", "at", "ch", "be", "uk", "us", "ca", "mx", "ar", "eu")
ISSUERS = r"^(?:4|5[1-5]|2(?:22[1-9]|2[3-9][0-9]|[3-6][0-9]{2}|7[01][0-9]|720)|3[47]|6011|65|64[4-9]|35|30[0-5]|36|38|62|50|5[6-8])"
CALLING = r"^(?:1|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])"
#: Words of four languages that stand before personal data, by kind, and before other numbers.
CUES = (
    r"e-?mail|mail|contact|kontakt|correo|courriel|write to|adresse",
    r"\bip\b|\bhost|\bserver|\bserveur|\bservidor|\blogin",
    r"\bcard|\bcredit|\bvisa\b|\bmaster|\bkarte|\btarjeta|\bcarte\b|\bkonto",
    r"\btel|\bphone|\bcall\b|\bmobile|\bfax\b|\bhandy\b|\bllam|\bappel",
)
OTHER = r"\bisbn\b|\border|\binvoice|\bversion|\bsku\b|\bhash|\bsection|\bserial|\bkey\b|\btoken\b|\bsecret|\bissn\b"
VOTES = ("v_form", "v_check", "v_list", "v_cue", "v_side")
FEATURES = ("check", "side", "list", "digits", "marks", "length")


def _matches(docs: DataFrame, name: str, pattern: str, guard: str) -> DataFrame:
    """Adds the column ``name``: the matches of a pattern with their positions, what stands before each and the next character."""
    m, g, lengths, blocks, before = (f"{name}_{x}" for x in ("m", "g", "l", "b", "c"))
    text = F.col("text")
    out = docs.withColumn(m, F.when(text.rlike(guard), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))
    out = out.withColumn(g, F.when(F.size(m) > 0, F.split(text, pattern, -1)))
    out = out.withColumn(lengths, F.when(F.col(g).isNotNull(), F.expr(f"transform({m}, (x, i) -> cast(length({g}[i]) + length(x) as bigint))")))
    add = lambda array, first, many: f"aggregate(slice({array}, {first}, {many}), 0L, (a, x) -> a + x)"
    out = out.withColumn(blocks, F.expr(f"transform(sequence(0, cast((size({lengths}) - 1) div {BLOCK} as int)), k -> {add(lengths, f'k * {BLOCK} + 1', BLOCK)})"))
    out = out.withColumn(before, F.expr(f"transform({blocks}, (x, k) -> {add(blocks, '1', 'k')})"))
    start = f"{before}[cast(i div {BLOCK} as int)] + {add(lengths, f'cast(i div {BLOCK} as int) * {BLOCK} + 1', f'i % {BLOCK}')} + length({g}[i])"
    out = out.withColumn(name, F.expr(f"transform({lengths}, (x, i) -> named_struct('start', {start}, 's', {m}[i], 'before', right({g}[i], {CONTEXT}), 'after', left({g}[i + 1], 1)))"))
    return out.drop(m, g, lengths, blocks, before)


def _luhn(digits: str) -> str:
    """SQL: whether a number's digits, at most 19, pass the check sum."""
    digit = f"cast(substr({digits}, -i, 1) as int)"
    return f"aggregate(sequence(1, length({digits})), 0, (a, i) -> a + CASE WHEN i % 2 = 1 THEN {digit} ELSE 2 * {digit} - CASE WHEN {digit} > 4 THEN 9 ELSE 0 END END) % 10 = 0"


def _passes(kind: int, s: str) -> str:
    """SQL: whether a match of a base pattern passes its check."""
    digits = f"regexp_replace({s}, '[^0-9]', '')"
    if kind == 0:
        return "true"
    if kind == 1:
        return f"{s} rlike r'^{OCTET}(?:\\.{OCTET}){{3}}$'"
    if kind == 2:
        return f"CASE WHEN length({digits}) BETWEEN 14 AND 19 THEN {_luhn(digits)} ELSE false END"
    return f"length({digits}) BETWEEN 10 AND 15"


def find_spans(docs: DataFrame) -> DataFrame:
    """The columns doc_id and text of docs, with base (kind, start, end of base spans by start) and candidates (all to be voted on)."""
    out = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    for k in range(len(KINDS)):
        out = _matches(out, f"b{k}", BASE[k], GUARDS[k][0])
        out = _matches(out, f"w{k}", WIDE[k], GUARDS[k][1])
    row = lambda k, ok: f"named_struct('start', x.start, 'kind', {k}, 'end', x.start + length(x.s), 's', x.s, 'before', x.before, 'after', x.after, 'base', {ok})"
    # short numbers are no candidates, nor are wide matches with a digit beside them
    digits = "length(regexp_replace(x.s, '[^0-9]', ''))"
    wide = ("true", "true", f"{digits} BETWEEN 13 AND 19", f"{digits} BETWEEN 10 AND 15 AND x.s rlike '[^0-9]'")
    base = ("true", "true", f"{digits} >= 13", f"{digits} >= 7")
    apart = "NOT x.before rlike '[0-9]$' AND NOT x.after rlike '[0-9]'"
    all_of = lambda name, k, ok, keep: f"coalesce(filter(transform({name}{k}, x -> {row(k, ok)}), x -> {keep}), array())"
    matched = [all_of("b", k, _passes(k, "x.s"), f"x.base OR {base[k]}") for k in range(len(KINDS))]
    more = [all_of("w", k, "false", f"{wide[k]} AND {apart}") for k in range(len(KINDS))]
    out = out.withColumn("candidates", F.expr(f"concat({', '.join(matched + more)})"))
    base_spans = F.expr("array_sort(transform(filter(candidates, x -> x.base), x -> named_struct('start', x.start, 'kind', x.kind, 'end', x.end)))")
    return out.select("doc_id", "text", base_spans.alias("base"), "candidates")


def _case(by_kind: list[str]) -> Column:
    return F.expr("CASE kind " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(by_kind)) + " END")


def _vote(yes: str, no: str = "true") -> str:
    return f"CASE WHEN {yes} THEN 1 WHEN {no} THEN -1 ELSE 0 END"


def votes(spans: DataFrame) -> DataFrame:
    """Adds the five labelers' votes (1, -1, 0) and the features of each candidate."""
    out = spans.withColumn("d", F.regexp_replace("s", "[^0-9]", ""))
    six = "s LIKE '%:%'"
    form = [
        _vote("s rlike r'^[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9])?@[A-Za-z0-9.-]+[.][A-Za-z]{2,24}$'", "s LIKE '%@%'"),
        _vote(f"s rlike r'^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$' OR {six}"),
        _vote("s rlike '^([0-9]{16}|[0-9]{4}( [0-9]{4}){3}|[0-9]{4}(-[0-9]{4}){3}|3[47][0-9]{13}|3[47][0-9]{2} [0-9]{6} [0-9]{5})$'"),
        _vote("s rlike r'^[+][0-9]{1,3}[ .-]?[(]?[0-9]{2,4}[)]?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}$'", "s LIKE '+%' OR length(d) > 11"),
    ]
    check = [
        _vote("s rlike r'[.)\\] ][A-Za-z]{2,24}$'"),
        _vote(f"s rlike r'^{OCTET}([.]{OCTET}){{3}}$' OR {six}"),
        f"CASE WHEN length(d) BETWEEN 13 AND 19 THEN CASE WHEN {_luhn('d')} THEN 1 ELSE -1 END ELSE -1 END",
        _vote("length(d) BETWEEN 10 AND 15"),
    ]
    domain = "lower(regexp_extract(s, '([A-Za-z]+)$', 1))"
    listed = [
        _vote(f"{domain} IN ({', '.join(repr(x) for x in DOMAINS)})", "false"),
        _vote("s rlike '^0*(?:[1-9][0-9]?|1[0-9]{2}|2[01][0-9]|22[0-3])[.]'", f"NOT {six}"),
        _vote(f"d rlike '{ISSUERS}'"),
        _vote(f"(s LIKE '+%' AND d rlike '{CALLING}') OR (NOT s LIKE '+%' AND d rlike '^[2-9]')"),
    ]
    cue = F.expr(_vote("lower(before) rlike " + "(CASE kind " + " ".join(f"WHEN {k} THEN r'{x}'" for k, x in enumerate(CUES)) + " END)", f"lower(before) rlike r'{OTHER}'"))
    side = F.expr(_vote("before rlike '[A-Za-z0-9]$' OR after rlike '^[A-Za-z0-9]'").replace("THEN 1 WHEN true THEN -1", "THEN -1 WHEN true THEN 1"))
    out = out.withColumns({"v_form": _case(form), "v_check": _case(check), "v_list": _case(listed), "v_cue": cue, "v_side": side})
    marks = "length(regexp_replace(s, '[A-Za-z0-9]', ''))"
    return out.withColumns(
        {
            "check": F.col("v_check"),
            "side": F.col("v_side"),
            "list": F.col("v_list"),
            "digits": F.expr("least(length(d), 24)"),
            "marks": F.expr(f"least({marks}, 8)"),
            "length": F.expr("least(length(s) div 4, 16)").cast("int"),
        }
    ).drop("d", "s", "before", "after")


def _unless_failed(p: Column) -> Column:
    return F.when(F.col("v_check") == -1, F.lit(0.0)).otherwise(p)


def posteriors(patterns: DataFrame) -> DataFrame:
    """kind and votes with p, the probability that such a span is personal data, from n, how many there are.

    ``patterns`` has at most 4 x 3^5 rows, so a kind is a bounded window.
    """
    out = patterns.withColumn("p", _unless_failed(1 / (1 + F.exp(-sum((F.col(v) for v in VOTES), F.lit(0)).cast("double")))))
    in_kind = Window.partitionBy("kind")
    for _ in range(STEPS):
        logit = F.log((F.sum(F.col("n") * F.col("p")).over(in_kind) + 1) / (F.sum(F.col("n") * (1 - F.col("p"))).over(in_kind) + 1))
        for v in VOTES:
            same = Window.partitionBy("kind", v)
            ratio = []
            for share, agrees in ((F.col("p"), 1), (1 - F.col("p"), -1)):
                # a prior of STRENGTH votes that agree with the truth, and one each of the others
                prior = F.when(F.col(v) == agrees, STRENGTH).otherwise(1)
                ratio.append((F.sum(F.col("n") * share).over(same) + prior) / (F.sum(F.col("n") * share).over(in_kind) + STRENGTH + 2))
            logit = logit + F.log(ratio[0] / ratio[1])
        out = out.withColumn("_q", logit).withColumn("p", _unless_failed(1 / (1 + F.exp(-F.col("_q"))))).drop("_q")
    return out


def classifier(labelled: DataFrame) -> DataFrame:
    """One row a kind: prior, and weights, a map from feature and value to its log ratio, from candidates with their p."""
    sums = lambda: (F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no"))
    pairs = F.explode(F.array(*(F.concat(F.lit(f"{f}="), F.col(f).cast("string")) for f in FEATURES)))
    by_value = labelled.select("kind", "p", pairs.alias("value")).groupBy("kind", "value").agg(*sums())
    whole = labelled.groupBy("kind").agg(F.sum("p").alias("all_yes"), F.sum(1 - F.col("p")).alias("all_no"))
    weight = F.log(((F.col("yes") + 1) / (F.col("all_yes") + 2)) / ((F.col("no") + 1) / (F.col("all_no") + 2)))
    prior = F.log((F.col("all_yes") + 1) / (F.col("all_no") + 1))
    # a feature has few values: at most some 60 entries a kind
    return by_value.join(F.broadcast(whole), "kind").groupBy("kind").agg(F.first(prior).alias("prior"), F.map_from_entries(F.collect_list(F.struct("value", weight.alias("w")))).alias("weights"))


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, base and added (arrays of start, kind, end) of every row."""
    found = find_spans(docs)
    wide = F.exists("candidates", lambda x: ~x["base"])
    key = F.when(wide, F.sha2("text", 256)).alias("key")
    rows = materialise(found.select("doc_id", key, "base", "candidates"), "private-spans")
    spans = rows.select("doc_id", "key", F.explode("candidates").alias("c")).select("doc_id", "key", "c.*")
    voted = materialise(votes(spans), "private-votes")
    patterns = voted.groupBy("kind", *VOTES).agg(F.count("*").alias("n"))
    labels = posteriors(patterns).select("kind", *VOTES, "p")  # bounded, see posteriors
    fitted = classifier(voted.join(F.broadcast(labels), ["kind", *VOTES]))
    # equal rows are one document here
    of_doc = voted.filter(F.col("key").isNotNull()).select("doc_id", "key", "kind", "start", "end", "base", *FEATURES).distinct()
    weights = [F.coalesce(F.element_at("weights", F.concat(F.lit(f"{f}="), F.col(f).cast("string"))), F.lit(0.0)) for f in FEATURES]
    scored = of_doc.join(F.broadcast(fitted), "kind").withColumn("score", sum(weights, F.col("prior"))).filter(F.col("base") | (F.col("score") > 0))
    one = scored.groupBy("doc_id", "key", "kind", "start", "end").agg(F.max("base").alias("base"))
    order = Window.partitionBy("doc_id", "key").orderBy("start", F.desc("base"), "kind", "end")
    until = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    later = F.min(F.when(F.col("base"), F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    clear = (F.coalesce(until, F.lit(0)) <= F.col("start")) & (later.isNull() | (later >= F.col("end")))
    added = one.withColumn("clear", clear).filter(F.col("clear") & ~F.col("base"))
    added = added.groupBy("doc_id", "key").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("added"))
    none = F.array().cast("array<struct<start: bigint, kind: int, end: bigint>>")
    alone = rows.filter(F.col("key").isNull()).select("doc_id", "base", none.alias("added"))
    more = rows.filter(F.col("key").isNotNull()).alias("r").join(added.alias("a"), F.col("r.doc_id").eqNullSafe(F.col("a.doc_id")) & (F.col("r.key") == F.col("a.key")), "left")
    return alone.unionByName(more.select("r.doc_id", "base", F.coalesce("added", none).alias("added")))


def written(spans: str) -> str:
    """SQL of spans as kind:start:end, joined by commas."""
    kinds = ", ".join(repr(k) for k in KINDS)
    return f"array_join(transform({spans}, x -> concat(array({kinds})[x.kind], ':', cast(x.start as string), ':', cast(x.end as string))), ',')"


def op11_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(read(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = {k})) as bigint)").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(F.expr(written("base")), 256).alias("base_sha256"), F.expr(written("array_sort(concat(base, added))")).alias("spans"))


QUERIES: dict[str, Query] = {"op11_private_data": op11_private_data}
ORACLE: dict[str, str] = {}
