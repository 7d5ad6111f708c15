"""Personal data in whole texts: fixed patterns, and contextual patterns bootstrapped from what these find.

Base entities are the seeds. Candidates are runs of words with digits or an `@` that look like an entity of a kind. The words around
a candidate are its lexical patterns. Patterns and instances (distinct candidate texts) form a graph that is scored in rounds: a pattern
by the instances it surrounds, out of all places where its words stand in the corpus, an instance by its other patterns. Patterns of high
confidence then find candidates that the fixed patterns miss. DataFrame and SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill.llm.common import staged

KINDS = ("email", "ip", "card", "phone")

#: The contract's patterns in forms that find the same matches in linear time: a run of characters that can't lead to a match
#: is tried once, from its start (or from the end of the match before), and repeated groups aren't kept for backtracking.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # Shorter chains of digits fail the count, so only those of 12 digits or more are looked for.
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have for a match.
NEEDS = {"email": "instr({t}, '@') > 0", "ip": "{t} rlike '[0-9]'", "card": "{t} rlike '[0-9]'", "phone": "instr({t}, '+') > 0"}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
_DIGITS = r"regexp_replace({v}, '[^0-9]', '')"
_LUHN = (
    "aggregate(transform(sequence(1, length({d})), i -> cast(substring(reverse({d}), i, 1) as int) * (2 - i % 2)), 0,"
    " (s, x) -> s + x - case when x > 9 then 9 else 0 end) % 10 = 0")
VALID = {
    "email": "true",
    "ip": rf"{{v}} rlike '^{_PART}(?:[.]{_PART}){{{{3}}}}$'",
    "card": f"case when length({_DIGITS}) between 12 and 19 then {_LUHN.format(d=_DIGITS)} else false end",
    "phone": f"length({_DIGITS}) between 9 and 15",
}

#: Runs of words that hold a digit or an @.
CANDIDATE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?:\x20[^\s0-9@]*+[0-9@]\S*+)*+"
#: What a candidate of each kind looks like without the signs around it; looser than the fixed patterns.
SHAPES = {
    "email": r"{v} rlike '^[^\\s@]+@[^\\s@]+$'",
    "ip": r"{v} rlike '^[0-9]+(?:[.,:][0-9]+){{3}}$|^[0-9A-Fa-f]{{1,4}}(?::[0-9A-Fa-f]{{0,4}}){{2,7}}$'",
    # Digits that fail the check digit are no card, whatever stands beside them.
    "card": f"{{v}} rlike '^[0-9](?:[ ./-]?[0-9])++$' and {VALID['card']}",
    "phone": f"{{v}} rlike '^[+]?[(]?[0-9][0-9()./ -]*+$' and length({_DIGITS}) between 7 and 15",
}
#: Characters of context on either side of a candidate, rounds of scoring, distinct seeds a pattern needs, and its least confidence.
CONTEXT, ROUNDS, SUPPORT, CONFIDENCE = 256, 3, 3, 0.6


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _located(found: str, between: str, extra: str = "", extra_type: str = "") -> str:
    """Array of (start, end, value) of the matches `found`, given the pieces `between` them. Code points, end exclusive."""
    start = f"s.at + length({between}[i])"
    end = f"{start} + length({found}[i])"
    return (
        f"case when size({found}) > 0 then aggregate(sequence(0, size({found}) - 1),"
        f" named_struct('at', 0, 'out', cast(array() as array<struct<start:int,end:int,value:string{extra_type}>>)),"
        f" (s, i) -> named_struct('at', {end}, 'out', array_append(s.out,"
        f" named_struct('start', {start}, 'end', {end}, 'value', {found}[i]{extra}))), s -> s.out) end")


def with_base(docs: DataFrame) -> DataFrame:
    """Adds `base`, an array of (start, kind_at, end, kind) by start and kind, and keeps `text`."""
    for kind in KINDS:
        pattern = _literal(PATTERNS[kind])
        docs = docs.withColumn(f"_m_{kind}", F.expr(f"case when {NEEDS[kind].format(t='text')} then regexp_extract_all(text, {pattern}, 0) end"))
        docs = docs.withColumn(f"_p_{kind}", F.expr(f"case when size(_m_{kind}) > 0 then split(text, {pattern}, -1) end"))
    spans = [
        f"transform(filter(coalesce({_located(f'_m_{kind}', f'_p_{kind}')}, array()), x -> {VALID[kind].format(v='x.value')}),"
        f" x -> named_struct('start', x.start, 'kind_at', {at}, 'end', x.end, 'kind', '{kind}'))" for at, kind in enumerate(KINDS)]
    base = F.expr(f"array_sort(concat({', '.join(spans)}))")
    return docs.withColumn("base", base).drop(*[f"_{x}_{k}" for x in "mp" for k in KINDS])


def with_candidates(docs: DataFrame) -> DataFrame:
    """Adds `candidates`: (start, end, value, left, left2, right, seeds, kinds); value without the signs around it. Needs `base`."""
    pattern = _literal(CANDIDATE)
    left, right = f"right(_p[i], {CONTEXT})", f"substring(_p[i + 1], 1, {CONTEXT})"
    plain = lambda x: f"regexp_replace(lower({x}), '[0-9]+', '0')"
    extra = "".join((
        f", 'left', {plain(f'''regexp_extract({left}, '(\\\\S+)\\\\s*$', 1)''')}",
        f", 'left2', {plain(f'''regexp_extract({left}, '(\\\\S+\\\\s+\\\\S+)\\\\s*$', 1)''')}",
        f", 'right', {plain(f'''regexp_extract({right}, '^\\\\s*(\\\\S+)', 1)''')}"))
    docs = docs.withColumn("_m", F.expr(f"case when text rlike '[0-9@]' then regexp_extract_all(text, {pattern}, 0) end"))
    docs = docs.withColumn("_p", F.expr(f"case when size(_m) > 0 then split(text, {pattern}, -1) end"))
    docs = docs.withColumn("_c", F.expr(f"coalesce({_located('_m', '_p', extra, ',left:string,left2:string,right:string')}, array())"))
    trimmed = (
        "transform(_c, x -> named_struct('start', x.start + length(regexp_extract(x.value, '^[^0-9A-Za-z+(@]*', 0)),"
        " 'value', regexp_replace(x.value, '^[^0-9A-Za-z+(@]+|(?<=[0-9A-Za-z)])[^0-9A-Za-z)]+$', ''),"
        " 'left', x.left, 'left2', x.left2, 'right', x.right))")
    docs = docs.withColumn("_t", F.expr(trimmed))
    kinds = ", ".join(f"case when {SHAPES[k].format(v='x.value')} then '{k}' end" for k in KINDS)
    seeds = "array_distinct(transform(filter(base, b -> b.start < x.start + length(x.value) and b.end > x.start), b -> b.kind))"
    full = (
        f"transform(_t, x -> named_struct('start', x.start, 'end', x.start + length(x.value), 'value', x.value, 'left', x.left,"
        f" 'left2', x.left2, 'right', x.right, 'seeds', {seeds}, 'kinds', filter(array({kinds}), k -> k is not null)))")
    return docs.withColumn("candidates", F.expr(f"filter({full}, x -> size(x.seeds) > 0 or size(x.kinds) > 0)")).drop("_m", "_p", "_c", "_t")


def _patterns() -> Column:
    return F.expr("array(concat('L ', left), concat('LL ', left2), concat('R ', right))")


def _graph(candidates: DataFrame) -> DataFrame:
    """Distinct edges (pattern, kind, value, seed, n) between patterns with a word in them and instances; n: how often they stand together."""
    rows = candidates.withColumn("kind", F.explode(F.array_union("seeds", "kinds"))).withColumn("pattern", F.explode(_patterns()))
    worded = rows.where(F.col("pattern").rlike(r"^\S+ .*\p{L}"))
    return worded.groupBy("pattern", "kind", "value").agg(F.max(F.expr("array_contains(seeds, kind)")).alias("seed"), F.count("*").alias("n"))


def _occurrences(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, occurrences): how often the words of the patterns stand anywhere in the texts, beside whatever."""
    plain = F.expr("case when text rlike '[0-9]' then regexp_replace(lower(text), '[0-9]+', '0') else lower(text) end")
    words = texts.select(F.split(F.trim(F.regexp_replace(plain, r"\s+", " ")), " ").alias("w"))
    pairs = words.select(F.expr("inline(transform(w, (x, i) -> named_struct('one', x, 'two', case when i > 0 then concat(w[i - 1], ' ', x) end)))"))
    marked = pairs.select(F.explode(F.expr("array(concat('L ', one), concat('LL ', two), concat('R ', one))")).alias("pattern"))
    return marked.join(patterns, "pattern", "left_semi").groupBy("pattern").agg(F.count("*").alias("occurrences"))


def confident_patterns(candidates: DataFrame, texts: DataFrame) -> DataFrame:
    """(pattern, kind, confidence) after ROUNDS rounds over the graph.

    A pattern's confidence is the share of all its occurrences in the corpus that stand beside an instance of the kind: seeds count
    whole, other instances as far as their other patterns vouch for them. So words that stand beside everything are worth nothing, and no
    pattern is raised by what only it supports.
    """
    edges = staged(_graph(candidates), "edges")
    supported = staged(edges.groupBy("pattern", "kind").agg(F.expr("count_if(seed)").alias("support")).where(F.col("support") >= SUPPORT), "supported")
    known = staged(_occurrences(texts, supported.select("pattern").distinct()), "occurrences")
    edges = staged(edges.join(supported.join(known, "pattern"), ["pattern", "kind"]), "edges")

    def scored(vouched: DataFrame) -> DataFrame:
        return vouched.groupBy("pattern", "kind", "occurrences").agg(F.sum(F.expr("n * score")).alias("beside")).select(
            "pattern", "kind", F.expr("round(beside / (occurrences + 1), 6)").alias("confidence"))

    patterns = staged(scored(edges.withColumn("score", F.col("seed").cast("double"))), "patterns")
    for _ in range(ROUNDS - 1):
        doubt = edges.join(patterns, ["pattern", "kind"]).withColumn("doubt", F.expr("ln(1 - least(confidence, 0.99D))"))
        whole = doubt.groupBy("value", "kind").agg(F.sum("doubt").alias("all"))
        others = doubt.join(whole, ["value", "kind"]).withColumn("score", F.expr("case when seed then 1D else round(1 - exp(least(all - doubt, 0D)), 6) end"))
        patterns = staged(scored(others), "patterns")
    return patterns.where(F.col("confidence") >= CONFIDENCE)


def located(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, base, spans) per row: the base spans, and those with what the contexts add.

    A candidate is added if one of its patterns is confident for a kind it looks like and it overlaps no base span; the most
    confident kind wins, then the order of KINDS. Null texts are empty. Rows equal in doc_id and text have equal spans and stay rows of their own.
    """
    read = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    found = with_candidates(with_base(read)).select("doc_id", F.xxhash64("text").alias("text_hash"), "base", "candidates")
    found = staged(found, "found")
    rows = found.where(F.size("candidates") > 0).select("doc_id", "text_hash", F.inline("candidates"))
    sure = confident_patterns(rows, read.select("text"))
    loose = rows.where(F.size("seeds") == 0).withColumn("kind", F.explode("kinds")).withColumn("pattern", F.explode(_patterns()))
    at = "case kind " + " ".join(f"when '{k}' then {i}" for i, k in enumerate(KINDS)) + " end"
    added = (
        loose.join(sure, ["pattern", "kind"]).withColumn("kind_at", F.expr(at))
        .groupBy("doc_id", "text_hash", "start", "end").agg(F.expr("max_by(struct(kind_at, kind), struct(confidence, -kind_at))").alias("best"))
        .groupBy("doc_id", "text_hash").agg(F.expr("collect_list(struct(start, best.kind_at as kind_at, end, best.kind as kind))").alias("more"))
        .select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "more"))
    both = found.drop("candidates").join(added, F.expr("doc_id <=> _id and text_hash = _hash"), "left")
    return both.select("doc_id", "text_hash", "base", F.expr(
        "case when more is null then base else array_sort(concat(base, more)) end").alias("spans"))


def _joined(spans: str) -> Column:
    return F.expr(f"array_join(transform({spans}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')")


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, base counts per kind, base_sha256 and spans of every row (doc_id, text; other columns are not read).

    A text without spans has counts 0, the digest of the empty text and empty spans.
    """
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS]
    return located(docs).select("doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """All rows and columns, with each span of the text replaced by its kind in brackets; spans that overlap become one of the first's kind."""
    spans = located(docs).where(F.size("spans") > 0).select("doc_id", "text_hash", "spans").dropDuplicates(["doc_id", "text_hash"])
    rows = docs.select(F.struct("*").alias("row")).join(spans, F.expr("cast(row.doc_id as long) <=> doc_id and xxhash64(row.text) = text_hash"), "left")
    cut = (
        "aggregate(spans, named_struct('at', 0, 'out', ''), (s, x) -> case when x.start >= s.at then named_struct('at', x.end, 'out',"
        " concat(s.out, substring(row.text, s.at + 1, x.start - s.at), '[', upper(x.kind), ']'))"
        " else named_struct('at', greatest(s.at, x.end), 'out', s.out) end, s -> concat(s.out, substring(row.text, s.at + 1)))")
    text = F.expr(f"case when spans is null then row.text else {cut} end").alias("text")
    return rows.select(*[text if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
