"""Heuristic quality rules: a threshold table compiled into one Spark projection.

Every metric is a built-in column expression over the row's own text, so the plan is a single
scan with a projection: no shuffle, no state, no user functions.  It costs the same per byte at
any size, and a hot source or a large group of copies changes nothing.

Defined results: a null text is treated as empty (0 words, ``base_failed``); ties and repeated
rows are scored independently; other columns pass through ``quality_metrics`` untouched.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import BLANKS, fresh, whole

#: Frequent function words of the supported languages, lower case.
STOP_WORDS = (
    # en
    "the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on", "are", "this",
    # de
    "der", "die", "das", "und", "den", "von", "zu", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht", "ein", "eine",
    # fr
    "le", "la", "les", "de", "et", "un", "une", "du", "dans", "que", "est", "pour", "par", "au", "en",
    # es
    "el", "los", "las", "y", "con", "por", "para", "del", "se", "una", "no", "su",
)


@dataclass(frozen=True)
class Rule:
    """Passes when ``low <= metric <= high``; a side left None does not bind."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


#: Production thresholds.  Ratios are per word or per line with a word.
RULES: tuple[Rule, ...] = (
    Rule("length", "n_words", low=50),
    Rule("repetition", "repeat_ratio", high=0.5),
    Rule("word_length", "mean_word_chars", low=1.5, high=15.0),
    Rule("symbols", "symbol_ratio", high=0.1),
    Rule("bangs", "bang_ratio", high=0.1),
    Rule("stop_words", "stop_ratio", low=0.02),
    Rule("duplicate_lines", "dup_line_ratio", high=0.5),
)


def _window_starts(word: Column) -> Column:
    """A 64-bit hash for each 3-word window, by its first word's place."""
    n = F.size(word)
    return F.when(
        n >= 3,
        F.transform(F.slice(word, 1, n - 2), lambda w, i: F.xxhash64(w, F.get(word, i + 1), F.get(word, i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))


def _repeated_words(window: Column) -> Column:
    """Words covered by windows found twice or more.

    Windows sort by (hash, place), so equal ones stand together; the places of those with an equal
    neighbour, sorted again, each add the words not yet covered.  64-bit hashes stand for the three
    words: in a text of 20,000 words two different windows meet with probability 1e-11.
    """
    rank = F.sort_array(F.transform(window, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def equal(a: Column, b: Column) -> Column:
        return F.coalesce(a["h"] == b["h"], F.lit(False))

    def places(r: Column) -> Column:
        twice = F.filter(r, lambda x, j: equal(x, F.get(r, j + 1)) | (equal(x, F.get(r, F.when(j > 0, j - 1)))))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, x: a + x)

    def let(value: Column, use) -> Column:
        return F.get(F.transform(F.array(value), use), F.lit(0))

    return F.when(F.size(F.array_distinct(window)) == F.size(window), F.lit(0).cast("bigint")).otherwise(
        let(rank, lambda r: let(places(r), covered))
    )


def quality_metrics(df: DataFrame, text: str = "text", out: str = "quality") -> DataFrame:
    """df with one struct column more (``quality``) of the counts and ratios of each row's whole text."""
    t0, w0, g0, l0, c0 = (fresh(df, x) for x in ("__t", "__w", "__g", "__l", "__c"))
    t = whole(F.col(f"`{text}`"))
    pieces = F.array_remove(F.split(t, f"[{BLANKS}]+"), "")
    held = df.withColumn(t0, t).withColumn(w0, pieces)
    # Guards keep the arrays from being computed once per metric: each stage refers to the last one's columns.
    held = held.withColumn(g0, _window_starts(F.col(w0)))
    lines = F.filter(F.split(F.col(t0), "\n"), lambda x: x.rlike(f"[^{BLANKS}]"))
    held = held.withColumn(l0, lines).withColumn(
        c0,
        F.struct(
            F.size(w0).cast("bigint").alias("n_words"),
            F.length(F.array_join(w0, "")).cast("bigint").alias("word_chars"),
            F.length(F.regexp_replace(t0, "[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
            (F.size(l0) - F.size(F.array_distinct(l0))).cast("bigint").alias("n_dup_lines"),
            _repeated_words(F.col(g0)).alias("n_repeat_words"),
            F.length(F.regexp_replace(t0, "[^!]+", "")).cast("bigint").alias("n_bangs"),
            F.size(l0).cast("bigint").alias("n_lines"),
            F.size(F.filter(w0, lambda w: F.lower(w).isin(*STOP_WORDS))).cast("bigint").alias("n_stop_words"),
        ),
    )
    c, per = F.col(c0), lambda a, b: F.col(f"{c0}.{a}") / F.greatest(F.col(f"{c0}.{b}"), F.lit(1))
    quality = F.struct(
        c["n_words"].alias("n_words"),
        c["word_chars"].alias("word_chars"),
        c["n_symbols"].alias("n_symbols"),
        c["n_dup_lines"].alias("n_dup_lines"),
        c["n_repeat_words"].alias("n_repeat_words"),
        per("n_repeat_words", "n_words").alias("repeat_ratio"),
        per("word_chars", "n_words").alias("mean_word_chars"),
        per("n_symbols", "n_words").alias("symbol_ratio"),
        per("n_bangs", "n_words").alias("bang_ratio"),
        per("n_stop_words", "n_words").alias("stop_ratio"),
        per("n_dup_lines", "n_lines").alias("dup_line_ratio"),
    )
    # Exploding one struct keeps later filters on it above this point; pushed below, each would compute all of it again.
    return held.withColumn(out, F.explode(F.array(quality))).drop(t0, w0, g0, l0, c0)


def verdict(rules: Sequence[Rule] = RULES, quality: str = "quality") -> Column:
    """The rules a row breaks, as an array of their names in the table's order."""
    broken = []
    for r in rules:
        m = F.col(f"{quality}.{r.metric}")
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (m < F.lit(r.low))
        if r.high is not None:
            bad = bad | (m > F.lit(r.high))
        broken.append(F.when(bad, F.lit(r.name)))
    return F.filter(F.array(*broken), lambda x: x.isNotNull())


def apply_rules(df: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """df plus ``quality`` (metrics), ``broken`` (names of failed rules) and ``keep``, which come last; a name that df has gets underscores."""
    quality, broken, keep = (fresh(df, x) for x in ("quality", "broken", "keep"))
    out = quality_metrics(df, text, quality).withColumn(broken, verdict(rules, quality))
    return out.withColumn(keep, F.size(broken) == 0)


def query(spark, sf_dir):
    """op1: the rules over the whole of documents."""
    from strata.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    q = F.col("quality")
    failed = (q["n_words"] < 50) | (100 * q["n_repeat_words"] > 50 * q["n_words"])
    return apply_rules(docs).select(
        "doc_id", q["n_words"].alias("n_words"), q["word_chars"].alias("word_chars"), q["n_symbols"].alias("n_symbols"),
        q["n_dup_lines"].alias("n_dup_lines"), q["n_repeat_words"].alias("n_repeat_words"),
        failed.alias("base_failed"), (~failed & F.col("keep")).alias("kept"),
        F.array_join("broken", ",").alias("broken"),
    )


def oracle_sql(rules: Sequence[Rule] = RULES, source: str = "documents") -> str:
    """DuckDB SQL for the rows of ``query``."""
    blanks = "[ \\t\\n\\x0b\\x0c\\r]"
    tests = []
    for r in rules:
        bad = [f"{r.metric} {op} {v}" for op, v in (("<", r.low), (">", r.high)) if v is not None]
        tests.append(f"CASE WHEN {' OR '.join(bad)} THEN '{r.name}' END")
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM {source}
), s AS (
  SELECT rid, doc_id, t, [x for x in regexp_split_to_array(t, '{blanks}+') if x <> ''] AS w,
    [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^ \\t\\n\\x0b\\x0c\\r]')] AS l
  FROM d
), g AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM s)
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1
), steps AS (
  SELECT rid, least(3, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 3)) AS n FROM twice
), covered AS (
  SELECT rid, CAST(sum(n) AS BIGINT) AS n FROM steps GROUP BY rid
), c AS (
  SELECT s.doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(length(regexp_replace(t, '[^!]+', '', 'g')) AS BIGINT) AS n_bangs,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, len(l) AS n_lines,
    CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
    len([x for x in w if lower(x) IN ({stops})]) AS n_stop_words
  FROM s LEFT JOIN covered USING (rid)
), r AS (
  SELECT *, n_repeat_words / greatest(n_words, 1) AS repeat_ratio, word_chars / greatest(n_words, 1) AS mean_word_chars,
    n_symbols / greatest(n_words, 1) AS symbol_ratio, n_bangs / greatest(n_words, 1) AS bang_ratio,
    n_stop_words / greatest(n_words, 1) AS stop_ratio, n_dup_lines / greatest(n_lines, 1) AS dup_line_ratio
  FROM c
), b AS (
  SELECT *, [x for x in [{', '.join(tests)}] if x IS NOT NULL] AS broken_list,
    (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM r
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND len(broken_list) = 0) AS kept, array_to_string(broken_list, ',') AS broken
FROM b
"""
