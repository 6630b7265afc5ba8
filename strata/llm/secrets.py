"""Secret scans over a trigram inverted index, in DataFrame operations alone.

1. Each rule's regular expression is turned into a Boolean query over the trigrams that every match
   must hold (lower case).  Alternatives become ORs, sequences ANDs.
2. Index: rows (trigram, text key) for the trigrams that some rule asks for; the key is the text's
   MD5, so copies share their postings.
3. The postings of a rule's query are intersected by key, which gives its candidate texts.
4. Candidates are verified with the full regular expression.  Rules without a mandatory trigram
   scan every text.

Rows learn whether their text may be a candidate from a bitmap of the candidates' keys, of fixed size:
no text is shuffled, whatever share of the rows has it, and a bit that two texts share costs a
verification, not a wrong span.

Defined results: null is the empty text (no spans); repeated rows give repeated results; spans are
code points, end exclusive, ordered by start, then by the rules' order; other columns pass through,
and new names avoid theirs.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from re import _constants as C
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import cut, flagged, fresh, table, whole


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern``, leftmost and non-overlapping, whose ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


#: assign, access and hex are fixed; the rest widens the scan.
RULES: tuple[Rule, ...] = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]{16,}", base=True),
    Rule("hex", r"[0-9a-f]{24,}", base=True),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----(?:[\s\S]*?-----END [A-Z ]{0,30}PRIVATE KEY-----|[\s\S]*)"),
    Rule("signed_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("forge_token", r"gh[opusr]_[A-Za-z0-9]{36,}"),
    Rule("url_password", r"[a-z][a-z0-9+.-]{1,20}://[^/\s:@]+:[^/\s:@]+@"),
    Rule("bearer", r"(?i:bearer)\x20+[A-Za-z0-9._~+/-]{20,}"),
)

#: Alternatives kept apart while literals are joined; beyond it the query gets looser, never wrong.
MOST_STRINGS = 64

#: A query is None (no mandatory trigram), a trigram, or (AND|OR, parts).
Query = "None | str | tuple[str, tuple[Query, ...]]"


def _all(*parts):
    parts = tuple(dict.fromkeys(p for p in parts if p is not None))
    return None if not parts else parts[0] if len(parts) == 1 else ("AND", parts)


def _any(*parts):
    if not parts or any(p is None for p in parts):
        return None
    parts = tuple(dict.fromkeys(parts))
    needs = {p: frozenset([p] if isinstance(p, str) else p[1] if p[0] == "AND" else [p]) for p in parts}
    parts = tuple(p for p in parts if not any(needs[q] < needs[p] for q in parts))  # a wider need than another's adds nothing
    return parts[0] if len(parts) == 1 else ("OR", parts)


def _of_strings(strings):
    return _any(*(_all(*(s[i : i + 3] for i in range(len(s) - 2))) for s in sorted(strings)))


def _walk(nodes):
    """(exact strings or None, query) of a parsed sequence."""
    queries, run, exact = [], {""}, True

    def flush():
        nonlocal run, exact
        queries.append(_of_strings(run))
        run, exact = {""}, False

    def add(strings):
        nonlocal run
        if len(run) * len(strings) > MOST_STRINGS:
            flush()
        run = {a + b for a in run for b in strings} if len(strings) <= MOST_STRINGS else {""}

    for op, arg in nodes:
        if op is C.LITERAL:
            add({chr(arg).lower()})
        elif op is C.IN and all(o is C.LITERAL for o, _ in arg) and len(arg) <= 8:
            add({chr(a).lower() for _, a in arg})
        elif op is C.SUBPATTERN:
            strings, query = _walk(arg[-1])
            if strings is not None:
                add(strings)
            else:
                flush()
                queries.append(query)
        elif op is C.BRANCH:
            found = [_walk(b) for b in arg[1]]
            if all(s is not None for s, _ in found):
                add(set().union(*(s for s, _ in found)))
            else:
                flush()
                queries.append(_any(*(q for _, q in found)))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, inner = arg
            strings, query = _walk(inner)
            if strings is not None and (low, high) == (0, 1):
                add(strings | {""})
            elif strings is not None and low == high and low <= 8:
                for _ in range(low):
                    add(strings)
            else:
                if strings is not None and low:
                    add(strings)
                flush()
                if strings is None and low:
                    queries.append(query)
        elif op is C.AT:
            continue
        else:
            flush()
    if exact:
        return run, _of_strings(run)
    return None, _all(*queries, _of_strings(run))


def trigram_query(pattern: str):
    """The Boolean trigram query that every text with a match of pattern satisfies; None if there is none."""
    return _walk(parser.parse(pattern))[1]


def _trigrams(query) -> set[str]:
    return set() if query is None else {query} if isinstance(query, str) else set().union(*map(_trigrams, query[1]))


def _holds(query, has) -> Column:
    if isinstance(query, str):
        return has(query)
    out = _holds(query[1][0], has)
    for q in query[1][1:]:
        out = out & _holds(q, has) if query[0] == "AND" else out | _holds(q, has)
    return out


def postings(df: DataFrame, grams: Sequence[str], text: str = "text") -> DataFrame:
    """The inverted index's rows: (gram, key) for every text and each of grams that it holds."""
    low = F.lower(F.col(f"`{text}`"))
    held = df.where(F.col(f"`{text}`").isNotNull()).select(F.unhex(F.md5(F.col(f"`{text}`"))).alias("key"), low.alias("low"))
    found = F.filter(F.array(*[F.lit(g) for g in grams]), lambda g: F.contains(F.col("low"), g))
    return held.select(F.explode(found).alias("gram"), "key")


def candidates(index: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(key, one boolean per rule that has a query): the postings intersected as the queries say."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not None}
    grams = sorted(set().union(*map(_trigrams, queries.values())))
    word = {g: divmod(i, 62) for i, g in enumerate(grams)}
    bits = []
    for w in range(len(grams) // 62 + 1):
        bit = F.lit(0).cast("bigint")
        for g, (x, i) in word.items():
            if x == w:
                bit = F.when(F.col("gram") == g, F.lit(1 << i).cast("bigint")).otherwise(bit)
        bits.append(F.bit_or(bit).alias(f"m{w}"))
    sets = index.groupBy("key").agg(*bits)
    has = lambda g: F.col(f"m{word[g][0]}").bitwiseAND(F.lit(1 << word[g][1])) != 0
    marks = sets.select("key", *[_holds(q, has).alias(f"may_{k}") for k, q in queries.items()])
    some = F.lit(False)
    for k in queries:
        some = some | F.col(f"may_{k}")
    return marks.where(some)


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """The rule's matches as array<struct<start, order, end, kind>>."""
    kind = "array<struct<start:int,order:int,end:int,kind:string>>"
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    kept = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), F.length)
    parts = F.zip_with(
        F.transform(F.split(text, rule.pattern, -1), F.length),
        F.zip_with(F.transform(matches, F.length), kept, lambda m, k: F.struct(m.alias("m"), k.alias("k"))),
        lambda p, m: F.struct(p.alias("p"), m.alias("m")),
    )  # text before the match, the match; after the last one nothing
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("found"))

    def step(a: Column, x: Column) -> Column:
        begin = a["at"] + x["p"]
        end = begin + x["m"]["m"]
        span = F.struct(begin.alias("start"), F.lit(order).alias("order"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        found = F.when(x["m"]["k"] >= rule.least, F.concat(a["found"], F.array(span))).otherwise(a["found"])
        return F.struct(F.coalesce(end, begin).alias("at"), found.alias("found"))

    return F.aggregate(F.filter(parts, lambda x: x["m"].isNotNull()), start, step, lambda a: a["found"])


def scan(df: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", out: str = "secrets") -> DataFrame:
    """df plus ``secrets``: array<struct<start, order, end, kind>> by start, then by the rules' order; where df has that name, it gets underscores."""
    out = fresh(df, out)
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    grams = sorted(set().union(*map(_trigrams, queries.values())))
    key, may = fresh(df, "__key"), fresh(df, "__may")
    base = df.withColumn(key, F.unhex(F.md5(F.col(f"`{text}`"))))
    if grams:
        found = cut(candidates(postings(df, grams, text), rules))
        base = flagged(base, found.select(F.col("key").alias(key)), [key], may)
    t, none = whole(F.col(f"`{text}`")), F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>")
    each = []
    for i, r in enumerate(rules):
        hit = t.rlike(r.pattern)
        each.append(F.when(hit if queries[r.kind] is None else F.col(may) & hit, _spans(t, r, i)).otherwise(none))
    return base.withColumn(out, F.sort_array(F.concat(*each))).drop(key, may)


def listed(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(df: DataFrame, text: str = "text", secrets: str = "secrets", mask: str = "[secret]") -> DataFrame:
    """df with every character of a span taken out of text and mask in place of each run of such characters; null stays null."""
    t = F.col(f"`{text}`")
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("kept"))

    def step(a: Column, s: Column) -> Column:
        ahead = s["start"] > a["at"]
        piece = F.substring(t, a["at"] + 1, s["start"] - a["at"])
        first = (F.size(a["kept"]) == 0) | ahead
        kept = F.when(first, F.concat(a["kept"], F.array(F.concat(F.when(ahead, piece).otherwise(F.lit("")), F.lit(mask))))).otherwise(a["kept"])
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), kept.alias("kept"))

    whole_run = F.aggregate(F.col(secrets), empty, step, lambda a: F.concat(F.array_join(a["kept"], ""), F.substring(t, a["at"] + 1, F.length(t))))
    return df.withColumn(text, F.when(F.size(secrets) > 0, whole_run).otherwise(t))


def query(spark, sf_dir):
    """op6: the rules over the whole of documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    s = F.col("secrets")

    def count(kind: str) -> Column:
        return F.size(F.filter(s, lambda x: x["kind"] == kind)).cast("bigint")

    base = F.filter(s, lambda x: x["kind"].isin(*[r.kind for r in RULES if r.base]))
    return scan(docs).select(
        "doc_id", *[count(r.kind).alias(f"n_{r.kind}") for r in RULES if r.base], F.sha2(listed(base), 256).alias("base_sha256"), listed(s).alias("spans")
    )


def oracle_sql(rules: Sequence[Rule] = RULES, source: str = "documents") -> str:
    """DuckDB SQL for the rows of ``query``, by plain scans."""
    parts = []
    for i, r in enumerate(rules):
        p = r.pattern.replace("'", "''")
        parts.append(
            f"SELECT rid, {i} AS o, '{r.kind}' AS kind, {r.base} AS base, m, g, p FROM (SELECT rid, regexp_extract_all(t, '{p}') AS m, "
            f"regexp_extract_all(t, '{p}', {r.group}) AS g, regexp_split_to_array(t, '{p}') AS p FROM d WHERE regexp_matches(t, '{p}'))"
        )
    least = " ".join(f"WHEN {i} THEN {r.least}" for i, r in enumerate(rules))
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in rules if r.base)
    names = [f"n_{r.kind}" for r in rules if r.base]
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM {source}),
f AS ({' UNION ALL '.join(parts)}),
x AS (SELECT rid, o, kind, base, m, g, p, unnest(range(1, len(m) + 1)) AS i FROM f),
s AS (
  SELECT rid, o, kind, base, length(g[i]) AS n,
    list_sum([length(y) for y in p[1:i]]) + coalesce(list_sum([length(y) for y in m[1:i - 1]]), 0) AS a, length(m[i]) AS w
  FROM x
), k AS (SELECT *, kind || ':' || CAST(a AS BIGINT) || ':' || CAST(a + w AS BIGINT) AS z FROM s WHERE n >= CASE o {least} END),
r AS (SELECT rid, {counts}, string_agg(z, ',' ORDER BY a, o) FILTER (base) AS b, string_agg(z, ',' ORDER BY a, o) AS spans FROM k GROUP BY rid)
SELECT d.doc_id, {', '.join(f'CAST(coalesce(r.{n}, 0) AS BIGINT) AS {n}' for n in names)}, sha256(coalesce(r.b, '')) AS base_sha256,
  coalesce(r.spans, '') AS spans
FROM d LEFT JOIN r USING (rid)
"""
