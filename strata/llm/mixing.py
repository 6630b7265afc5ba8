"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations alone.

Documents fall into cells by source, language and topic.  Cells start with their token counts and
are raked in turn to the target share of every source, language and topic; a cell's ratio of raked
to own tokens, over the largest such ratio, is the probability with which each of its documents is
kept.  A document's draw is a hash of its id, so runs agree and a lost task draws the same again.

Targets default to tempered shares, count ** ALPHA, computed from the data.

Only cell totals are shuffled, summed before the shuffle; raking works on the cells alone, and the
documents get their cell's probability by a join whose small side is counted before it is
broadcast.  A hot source is one of many rows of partial sums.

Defined results: a null source, language or topic is a value of its own (''); null and blank texts
have no tokens and take their cell's probability (1 in a cell without tokens); a null id draws like
the id ''; rows are drawn each by its id, so repeated rows stay or go together; other columns pass
through and new names avoid theirs.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import BLANKS, beside, cut, fresh, table, whole

#: Exponent of the default targets, and rounds over all marginals.
ALPHA, SWEEPS = 0.7, 8


def n_words(text: Column) -> Column:
    """Words of a text without an array of them: blanks runs, trimmed, are one less than words."""
    trimmed = F.trim(F.regexp_replace(whole(text), f"[{BLANKS}]+", " "))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.length(trimmed) - F.length(F.replace(trimmed, F.lit(" "), F.lit(""))) + 1).cast("bigint")


def topic_of(text: Column, words: Column) -> Column:
    """A coarse kind of text: listing, note, article or long."""
    return (
        F.when(F.contains(whole(text), F.lit(" | ")), "listing")
        .when(words < 100, "note").when(words < 1000, "article").otherwise("long")
    )


def raked(cells: DataFrame, dims: list[str], targets: Mapping[str, Mapping[str, float]] | None = None, sweeps: int = SWEEPS) -> DataFrame:
    """cells (dims, n) plus ``w``: n raked to the targets' shares of the total.

    targets maps a dimension to shares by value; values it lacks, and dimensions it lacks, get
    tempered shares.
    """
    total = float(cells.agg(F.sum("n")).first()[0] or 0)
    held = cells.withColumn("w", F.col("n").cast("double"))
    # A value's cells may be many: they are summed before a shuffle, as decimals, so that no order of addition matters.
    exact = "decimal(38,12)"
    for d in dims:
        goals = held.groupBy(d).agg(F.sum("n").alias("own"))
        share = F.when(F.col("own") > 0, F.pow(F.col("own").cast("double"), F.lit(ALPHA))).otherwise(F.lit(0.0))
        for value, s in (targets or {}).get(d, {}).items():
            share = F.when(F.col(d) == value, F.lit(float(s))).otherwise(share)
        goals = cut(goals.select(d, share.alias("g")))
        sums = float(goals.agg(F.sum(F.col("g").cast(exact))).first()[0] or 0) or 1.0  # shares add up to 1 over a dimension's values
        held = held.join(goals.select(d, (F.col("g") * F.lit(total / sums)).alias(f"goal_{d}")), d)
    held = cut(held)
    for _ in range(sweeps):
        for d in dims:
            now = held.groupBy(d).agg(F.sum(F.col("w").cast(exact)).cast("double").alias("now"))
            held = held.join(now, d).withColumn("w", F.when(F.col("now") > 0, F.col("w") * F.col(f"goal_{d}") / F.col("now")).otherwise(F.col("w"))).drop("now")
        held = cut(held)
    return held.select(*dims, "n", "w")


def draw(doc_id: Column) -> Column:
    """A number in [0, 1) from an id."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def mix(df: DataFrame, targets=None, sweeps: int = SWEEPS, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang") -> DataFrame:
    """df plus ``topic``, ``probability`` and ``sampled``."""
    names = {c: fresh(df, c) for c in ("topic", "probability", "sampled")}
    n, s, g = (fresh(df, x) for x in ("__n", "__s", "__g"))
    rows = df.withColumn(n, n_words(F.col(f"`{text}`")))
    rows = rows.withColumn(names["topic"], topic_of(F.col(f"`{text}`"), F.col(n)))
    rows = rows.withColumn(s, F.coalesce(F.col(f"`{source}`"), F.lit(""))).withColumn(g, F.coalesce(F.col(f"`{lang}`"), F.lit("")))
    cells = cut(rows.groupBy(F.col(s).alias("source"), F.col(g).alias("lang"), F.col(names["topic"]).alias("topic")).agg(F.sum(n).alias("n")))
    ratio = cut(raked(cells, ["source", "lang", "topic"], targets, sweeps).withColumn("r", F.when(F.col("n") > 0, F.col("w") / F.col("n"))))
    most = float(ratio.agg(F.max("r")).first()[0] or 1.0)
    a, b, c = (fresh(rows, x) for x in ("__a", "__b", "__c"))
    p = ratio.select(F.col("source").alias(a), F.col("lang").alias(b), F.col("topic").alias(c), F.coalesce(F.col("r") / F.lit(most), F.lit(1.0)).alias(names["probability"]))
    joined = beside(rows, p, (rows[s] == F.col(a)) & (rows[g] == F.col(b)) & (rows[names["topic"]] == F.col(c)), "left")
    return joined.drop(a, b, c, n, s, g).withColumn(names["sampled"], draw(F.col(f"`{doc_id}`")) < F.col(names["probability"]))


def query(spark, sf_dir):
    """op10: the whole of documents to tempered marginals."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mix(docs).select("doc_id", "source", "lang", "topic", F.round("probability", 9).alias("probability"), "sampled")


def oracle_ctes(source: str, dims: list[str] | None = None, sweeps: int = SWEEPS) -> str:
    """Common table expressions mixed_rows (rid and the query's columns) over a table ``source``."""
    dims = dims or ["source", "lang", "topic"]
    blanks = "[ \\t\\n\\x0b\\x0c\\r]+"
    out = [
        f"md AS (SELECT row_number() OVER () AS rid, *, trim(regexp_replace(coalesce(text, ''), '{blanks}', ' ', 'g')) AS tt FROM {source})",
        "mw AS (SELECT *, CAST(CASE WHEN tt = '' THEN 0 ELSE length(tt) - length(replace(tt, ' ', '')) + 1 END AS BIGINT) AS nw FROM md)",
        "mt AS (SELECT rid, doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, nw, CASE WHEN contains(coalesce(text, ''), ' | ') THEN 'listing' "
        "WHEN nw < 100 THEN 'note' WHEN nw < 1000 THEN 'article' ELSE 'long' END AS topic FROM mw)",
        "mc AS (SELECT source, lang, topic, CAST(sum(nw) AS DOUBLE) AS n FROM mt GROUP BY ALL)",
    ]
    for d in dims:
        out.append(f"mg_{d} AS (SELECT {d}, CASE WHEN sum(n) > 0 THEN pow(sum(n), {ALPHA}) ELSE 0 END AS g FROM mc GROUP BY {d})")
        out.append(f"mh_{d} AS (SELECT {d}, g * (SELECT sum(n) FROM mc) / (SELECT sum(g) FROM mg_{d}) AS g FROM mg_{d})")
    last = "mr0"
    out.append("mr0 AS (SELECT *, n AS w FROM mc)")
    step = 0
    for _ in range(sweeps):
        for d in dims:
            step += 1
            out.append(
                f"mr{step} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, c.n, CASE WHEN sum(c.w) OVER (PARTITION BY c.{d}) > 0 THEN c.w * t.g / sum(c.w) OVER (PARTITION BY c.{d}) ELSE c.w END AS w "
                f"FROM {last} c JOIN mh_{d} t ON c.{d} = t.{d})"
            )
            last = f"mr{step}"
    out.append(f"mp AS (SELECT source, lang, topic, coalesce(CASE WHEN n > 0 THEN w / n END / (SELECT max(w / n) FROM {last} WHERE n > 0), 1) AS p FROM {last})")
    out.append(
        "mixed_rows AS (SELECT rid, doc_id, mt.source, mt.lang, mt.topic, p AS probability, "
        "CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) / 4294967296.0 < p AS sampled FROM mt JOIN mp "
        "ON mt.source = mp.source AND mt.lang = mp.lang AND mt.topic = mp.topic)"
    )
    return ",\n".join(out)


def oracle_sql() -> str:
    return f"WITH {oracle_ctes('documents')}\nSELECT doc_id, source, lang, topic, round(probability, 9) AS probability, sampled FROM mixed_rows"
