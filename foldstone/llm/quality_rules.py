"""Quality rules (operator 10): thresholds from mergeable quantile sketches for each language and source.

Each document is measured once. For every metric of METRICS, in thousandths, a sketch counts documents by bucket:
values under 128 have a bucket each, larger ones share their seven leading bits, so a quantile is off by 1/64 of itself
at most. Sketches merge by adding counts: those of (language, source) merge into those of the language, and these into
the whole. A group's quantiles are those of its own documents together with PRIOR documents' worth of its language and
PRIOR of the whole, so small groups lean on the larger ones and no size is treated apart. A document fails a rule when
its rate lies beyond the group's fence q3 + REACH * (q3 - q1), and by more than chance: by REACH standard errors of its
own count, the square root of what was counted (in events: a repeated window marks six words). Rules with a lower fence
work the same way below q1. No cutoff is fixed: where the quartiles agree, as where most documents have no symbols at
all, the fence is that value, and the standard error decides how much is too much in a text of its length.

Null text has no words and fails the base rules, as empty texts do; texts may be of any length. Null languages and
sources form groups of their own. Documents that fail the base rules are not counted in the sketches, so junk that these
catch does not move the fences. Repeated rows count each, and get one verdict; a value on a fence is inside. An empty
table gives an empty result. Extra columns may have any name: only key, text, language and source are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldstone.llm.common import stored

REACH, PRIOR = 3, 50
#: name: (numerator, denominator, whether low values fail too, how much of the numerator one event makes).
METRICS = {
    "symbols": ("n_symbols", "n_words", False, 1),
    "dup_lines": ("n_dup_lines", "n_lines", False, 1),
    "repeats": ("n_repeat_words", "n_words", False, 6),
    "capitals": ("n_capitals", "word_chars", False, 1),
    "exclaims": ("n_exclaims", "n_words", False, 1),
    "word_length": ("word_chars", "n_words", True, 1),
}
SYMBOLS = b"#*$%&|<>"
CAPITALS = re.compile(r"[A-ZÀ-ÖØ-Þ]")
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_exclaims"]


def measure(text: str) -> tuple[int, ...]:
    """COUNTS of a text."""
    data = text.encode()
    words = data.split()  # of bytes: splits at the six ASCII blanks and nothing else
    n = len(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    windows = list(zip(words, words[1:], words[2:]))
    repeats = 0
    seen = set(windows)
    if len(seen) < len(windows):
        once: set = set()
        twice = {w for w in windows if w in once or once.add(w)}
        hit = bytearray(n)
        for i, w in enumerate(windows):
            if w in twice:
                hit[i : i + 3] = b"\1\1\1"
        repeats = sum(hit)
    chars = sum(map(len, words)) if text.isascii() else len(b"".join(words).decode())
    return n, chars, len(data) - len(data.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeats, len(lines), len(CAPITALS.findall(text)), data.count(b"!")


def measures(docs: DataFrame, key: str, text: str, keep: list[str]) -> DataFrame:
    """key, kept columns and COUNTS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [measure(v.as_py() or "") for v in batch.column(batch.num_columns - 1)]
            cols = zip(*got, strict=True) if got else [[]] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(c, pa.int64()) for c in cols]], [*batch.schema.names[:-1], *COUNTS])

    names = [key, *keep]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names), *(f"{c} long" for c in COUNTS)])
    return docs.select(*names, text).mapInArrow(run, schema)


def metric(name: str) -> Column:
    num, den, *_ = METRICS[name]
    return F.expr(f"(1000 * {num}) div greatest({den}, 1)")


def bucket(v: Column) -> Column:
    """The least value of v's bucket."""
    extra = F.greatest(F.length(F.bin(v)) - 7, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, extra), extra)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def sketches(measured: DataFrame) -> DataFrame:
    """lang, source, metric, bucket, n."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), bucket(metric(m)).alias("bucket")) for m in METRICS]))
    return measured.select("lang", "source", pairs.alias("p")).groupBy("lang", "source", "p.metric", "p.bucket").agg(F.count("*").alias("n"))


def fences(sketch: DataFrame) -> DataFrame:
    """lang, source, metric, low, high of each group. Counts are weighed in whole numbers, so quantiles are exact."""
    whole = sketch.groupBy("metric", "bucket").agg(F.sum("n").alias("_n2"))
    lang = sketch.groupBy(F.col("lang").alias("_lang"), F.col("metric").alias("_m"), F.col("bucket").alias("_b")).agg(F.sum("n").alias("_n1"))
    total = Window.partitionBy("metric")
    langs = sketch.groupBy("lang", "metric").agg(F.sum("n").alias("_all1")).withColumn("_all2", F.sum("_all1").over(total))
    big = "decimal(38,0)"
    base = langs.join(whole, "metric").join(lang, F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("metric") == F.col("_m")) & (F.col("bucket") == F.col("_b")), "left")
    prior = F.lit(PRIOR).cast(big) * (F.coalesce("_n1", F.lit(0)).cast("decimal(19,0)") * F.col("_all2").cast("decimal(18,0)") + F.col("_n2").cast("decimal(19,0)") * F.col("_all1").cast("decimal(18,0)"))
    base = base.select(F.col("lang").alias("_lang"), F.col("metric").alias("_m"), F.col("bucket").alias("_b"), prior.cast(big).alias("_prior"), (F.col("_all1").cast("decimal(19,0)") * F.col("_all2").cast("decimal(18,0)")).cast(big).alias("_unit"))
    groups = sketch.select("lang", "source", "metric").distinct()
    wide = groups.join(base, F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("metric") == F.col("_m"))).drop("_lang", "_m")
    own = sketch.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), F.col("metric").alias("_m"), F.col("bucket").alias("_k"), F.col("n").cast("decimal(19,0)").alias("_n0"))
    same = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("metric") == F.col("_m")) & (F.col("_b") == F.col("_k"))
    weight = (F.col("_prior") + F.coalesce((F.col("_n0") * F.col("_unit")).cast(big), F.lit(0).cast(big))).cast(big)
    weighed = wide.join(own, same, "left").select("lang", "source", "metric", F.col("_b").alias("bucket"), weight.alias("w"))
    group = Window.partitionBy("lang", "source", "metric")
    ranked = weighed.withColumn("_sum", F.sum("w").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("_all", F.sum("w").over(group))
    quarters = ranked.groupBy("lang", "source", "metric").agg(*[F.min(F.when(F.col("_sum") * 4 >= F.col("_all") * q, F.col("bucket"))).alias(f"q{q}") for q in (1, 3)])
    reach = REACH * (F.col("q3") - F.col("q1"))
    return quarters.select("lang", "source", "metric", (F.col("q1") - reach).cast("long").alias("low"), (F.col("q3") + reach).cast("long").alias("high"))


def beyond(name: str) -> Column:
    """Whether a document lies beyond its group's fence by more than REACH standard errors of its count."""
    num, den, below, event = METRICS[name]
    error = 1000 * REACH * F.sqrt(event * F.col(num).cast("double"))
    out = 1000 * F.col(num) - F.col(f"_{name}.high") * F.col(den) > error
    return out | (F.col(f"_{name}.low") * F.col(den) - 1000 * F.col(num) > error) if below else out


def judged(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """key, COUNTS, base_failed, failed (the metrics beyond their fences) and kept, for every row."""
    named = docs.select(F.col(key).alias("_key"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("_text"))
    measured = stored(measures(named, "_key", "_text", ["lang", "source"]), "measures")
    limits = fences(sketches(measured.filter(~base_failed())))
    wide = limits.groupBy("lang", "source").agg(*[F.max(F.when(F.col("metric") == m, F.struct("low", "high"))).alias(f"_{m}") for m in METRICS])
    wide = wide.withColumnRenamed("lang", "_lang").withColumnRenamed("source", "_source")
    both = measured.join(wide, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    off = F.filter(F.array(*[F.when(beyond(m), F.lit(m)) for m in METRICS]), lambda x: x.isNotNull())
    return both.select(F.col("_key").alias(key), *COUNTS, base_failed().alias("base_failed"), off.alias("failed")).withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))


def sql() -> str:
    """DuckDB SQL with the query's rows."""
    met = {m: f"(1000 * {n}) // greatest({d}, 1)" for m, (n, d, *_) in METRICS.items()}
    bucketed = "CASE WHEN v < 128 THEN v ELSE v - v % (1::BIGINT << (length(bin(v)) - 7)::INT) END"
    error = {m: f"{1000 * REACH} * sqrt(({v[3]} * {v[0]})::DOUBLE)" for m, v in METRICS.items()}
    beyond = " ".join(f"WHEN '{m}' THEN 1000 * {v[0]} - high * {v[1]} > {error[m]}" + (f" OR low * {v[1]} - 1000 * {v[0]} > {error[m]}" if v[2] else "") for m, v in METRICS.items())
    return rf"""WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
    w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
    tri AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
    rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri) WHERE c > 1) GROUP BY 1),
    m AS (SELECT doc_id, lang, source, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
        len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(ls) AS n_lines, len(regexp_extract_all(text, '[A-ZÀ-ÖØ-Þ]')) AS n_capitals,
        len(regexp_extract_all(text, '!')) AS n_exclaims FROM w LEFT JOIN rep USING (doc_id)),
    b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
    v AS (SELECT *, unnest([{", ".join(f"'{m}'" for m in METRICS)}]) AS metric, unnest([{", ".join(met.values())}]) AS v FROM b),
    sk AS (SELECT lang, source, metric, {bucketed} AS bucket, count(*) AS n FROM v WHERE NOT base_failed GROUP BY ALL),
    whole AS (SELECT metric, bucket, sum(n)::HUGEINT AS n2 FROM sk GROUP BY ALL),
    l1 AS (SELECT lang, metric, bucket, sum(n)::HUGEINT AS n1 FROM sk GROUP BY ALL),
    langs AS (SELECT *, (sum(all1) OVER (PARTITION BY metric))::HUGEINT AS all2 FROM (SELECT lang, metric, sum(n)::HUGEINT AS all1 FROM sk GROUP BY lang, metric)),
    base AS (SELECT langs.lang, metric, whole.bucket, {PRIOR} * (coalesce(n1, 0) * all2 + n2 * all1) AS prior, all1 * all2 AS unit
        FROM langs JOIN whole USING (metric) LEFT JOIN l1 ON l1.lang IS NOT DISTINCT FROM langs.lang AND l1.metric = langs.metric AND l1.bucket = whole.bucket),
    wide AS (SELECT g.lang, g.source, g.metric, base.bucket, prior + coalesce(sk.n, 0) * unit AS w FROM (SELECT DISTINCT lang, source, metric FROM sk) g
        JOIN base ON base.lang IS NOT DISTINCT FROM g.lang AND base.metric = g.metric
        LEFT JOIN sk ON sk.lang IS NOT DISTINCT FROM g.lang AND sk.source IS NOT DISTINCT FROM g.source AND sk.metric = g.metric AND sk.bucket = base.bucket),
    ranked AS (SELECT *, sum(w) OVER (PARTITION BY lang, source, metric ORDER BY bucket) AS _sum, sum(w) OVER (PARTITION BY lang, source, metric) AS _all FROM wide),
    q AS (SELECT lang, source, metric, min(bucket) FILTER (WHERE 4 * _sum >= _all) AS q1, min(bucket) FILTER (WHERE 4 * _sum >= 3 * _all) AS q3 FROM ranked GROUP BY ALL),
    f AS (SELECT lang, source, metric, q1 - {REACH} * (q3 - q1) AS low, q3 + {REACH} * (q3 - q1) AS high FROM q),
    bad AS (SELECT doc_id, count(*) AS n FROM v JOIN f ON f.lang IS NOT DISTINCT FROM v.lang AND f.source IS NOT DISTINCT FROM v.source AND f.metric = v.metric
        WHERE CASE v.metric {beyond} END GROUP BY 1)
    SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND coalesce(n, 0) = 0 AS kept FROM b LEFT JOIN bad USING (doc_id)"""
