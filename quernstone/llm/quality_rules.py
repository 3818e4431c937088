"""Quality rules with thresholds learned per language and source.

Every document gets base counts and shape ratios in one pass of built-in functions. Each ratio's upper
limit is a fence over the quartiles of its (lang, source) group, read from mergeable histogram sketches: a ratio is cut
down to a step of its sketch, rows are counted by (lang, source, ratio, step) with map-side combining, and counts of
languages and of the table are sums of those. So a source with a third of all rows costs one row per step and task, and
no task meets a group's rows; a sketch has at most a few thousand steps, however many rows it counts.
A group's fence is drawn towards that of its language, and that one's towards the table's, by SHRINK rows of the
wider one, so small groups lean on the wider ones without a jump at any size. The fences are joined back and filter the rows.

Defined results: a null text counts as empty; null lang or source form their own group, apart from the empty string; an empty
table gives an empty table; repeated rows each get their own result; extra columns, whatever their names, are ignored, or kept by
``filter_documents``; ties have no influence as all limits are values, not ranks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.llm.text import SPACE_WORD, fresh, let, words_of
from quernstone.plans.durable import durable, join_small

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: ratio -> least spread that a fence allows for, so that a group of equal values rejects nothing near them
RATIOS = {"symbol_ratio": 0.02, "dup_line_ratio": 0.15, "upper_ratio": 0.1, "mark_ratio": 0.05, "word_length": 1.0}
FENCE = 3.0
SHRINK = 50.0
#: (values below, step): a sketch's resolution. Steps are powers of two, so cutting a value to its step is exact.
STEPS = [(16.0, 1 / 4096), (65_536.0, 1.0), (float("inf"), 65_536.0)]


def repeated_words(words: Column, n: int = WINDOW) -> Column:
    """Words lying in n-word windows that occur twice or more in the array, the first included.

    Windows are compared by 64-bit hash within one text only. Documents without a repeated window leave
    after a hash-set comparison; the others sort their windows and sum the union of covered spans.
    """
    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.xxhash64(F.slice(words, i, n)))

    def covered(h: Column) -> Column:
        marked = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = lambda s: F.filter(s, lambda e, j: (F.get(s, j - 1)["h"] == e["h"]) | (F.get(s, j + 1)["h"] == e["h"]))
        at = let(marked, lambda s: F.array_sort(F.transform(twice(s), lambda e: e["i"])))
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        total = F.aggregate(
            at, start, lambda a, i: F.struct((a["n"] + n - F.greatest(F.lit(0), a["end"] - i)).alias("n"), (i + n).alias("end"))
        )
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(total["n"])

    return F.when(F.size(words) <= n, F.lit(0)).otherwise(let(hashes, covered)).cast("long")


def metrics(text: Column) -> Column:
    """A struct of the base counts and the ratios of a text."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(SPACE_WORD))
    packed = F.struct(
        let(words_of(t), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r"))).alias("w"),
        F.length(F.regexp_replace(t, r"[\x20\x09-\x0D]+", "")).cast("long").alias("chars"),
        F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), F.size(F.array_distinct(x)).cast("long").alias("d"))).alias("l"),
        F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long").alias("upper"),
        F.regexp_count(t, F.lit(r"[!?]")).cast("long").alias("marks"),
    )
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))

    def measured(p: Column) -> Column:
        dup = p["l"]["n"] - p["l"]["d"]
        out = {
            "n_words": p["w"]["n"],
            "word_chars": p["chars"],
            "n_symbols": p["symbols"],
            "n_dup_lines": dup,
            "n_repeat_words": p["w"]["r"],
            "base_failed": (p["w"]["n"] < MIN_WORDS) | (100 * p["w"]["r"] > MAX_REPEAT_PERCENT * p["w"]["n"]),
            "symbol_ratio": ratio(p["symbols"], p["chars"]),
            "dup_line_ratio": ratio(dup, p["l"]["n"]),
            "upper_ratio": ratio(p["upper"], p["chars"]),
            "mark_ratio": ratio(p["marks"], p["w"]["n"]),
            "word_length": ratio(p["chars"], p["w"]["n"]),
        }
        return F.struct(*[c.alias(k) for k, c in out.items()])

    return let(packed, measured)


def with_metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a last column of ``metrics``, named so that it clashes with none."""
    (name,) = fresh(docs, "metrics")
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns], metrics(F.col(f"`{text}`")).alias(name))


def group_key(col: str) -> Column:
    """A group's key: null is a group of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{col}`").cast("string")), F.lit(""))


def step_of(x: Column) -> Column:
    """``x`` cut down to its step."""
    cut = [(x < top, F.floor(x / step) * F.lit(step)) for top, step in STEPS[:-1]]
    out = F.when(*cut[0])
    for c in cut[1:]:
        out = out.when(*c)
    return out.otherwise(F.floor(x / STEPS[-1][1]) * F.lit(STEPS[-1][1]))


def sketches(measured: DataFrame, column: str, lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang_key, source_key, ratio, step, n): the histogram sketches of all groups."""
    pairs = F.array(*[F.struct(F.lit(r).alias("ratio"), step_of(F.col(f"`{column}`.{r}")).alias("step")) for r in RATIOS])
    long = measured.select(group_key(lang).alias("lang_key"), group_key(source).alias("source_key"), F.explode(pairs).alias("p"))
    return long.groupBy("lang_key", "source_key", "p.ratio", "p.step").agg(F.count("*").alias("n"))


def fences(counted: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ratio, docs, fence) by summing the sketches of ``counted`` over ``keys``: quartiles are the least steps
    whose running counts reach a quarter and three quarters of the rows."""
    merged = counted.groupBy(*keys, "ratio", "step").agg(F.sum("n").alias("n"))
    run = Window.partitionBy(*keys, "ratio").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    total = Window.partitionBy(*keys, "ratio")
    at = merged.select(*keys, "ratio", "step", F.sum("n").over(run).alias("below"), F.sum("n").over(total).alias("docs"))
    reached = lambda part: F.min(F.when(4 * F.col("below") >= part * F.col("docs"), F.col("step")))
    q = at.groupBy(*keys, "ratio").agg(F.max("docs").alias("docs"), reached(1).alias("low"), reached(3).alias("high"))
    least = F.create_map(*[F.lit(x) for r, v in RATIOS.items() for x in (r, float(v))])
    return q.select(*keys, "ratio", "docs", (F.col("high") + FENCE * F.greatest(F.col("high") - F.col("low"), least[F.col("ratio")])).alias("fence"))


def thresholds(measured: DataFrame, column: str, lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang_key, source_key, limits): one row per (lang, source), limits a struct by ratio."""
    counted = durable(sketches(measured, column, lang, source), narrow=True)
    table = fences(counted, []).select("ratio", F.col("fence").alias("table_fence"))
    langs = fences(counted, ["lang_key"]).select("lang_key", "ratio", F.col("docs").alias("lang_docs"), F.col("fence").alias("lang_fence"))
    wide = join_small(durable(langs, narrow=True), durable(table, narrow=True), ["ratio"])
    drawn = lambda own, n, wider: (F.col(n) * F.col(own) + SHRINK * wider) / (F.col(n) + SHRINK)
    lang_limit = drawn("lang_fence", "lang_docs", F.col("table_fence"))
    wide = durable(wide.select("lang_key", "ratio", lang_limit.alias("lang_limit")), narrow=True)
    own = join_small(fences(counted, ["lang_key", "source_key"]), wide, ["lang_key", "ratio"])
    limit = own.select("lang_key", "source_key", "ratio", drawn("fence", "docs", F.col("lang_limit")).alias("limit"))
    by_ratio = [F.max(F.when(F.col("ratio") == r, F.col("limit"))).alias(r) for r in RATIOS]
    return limit.groupBy("lang_key", "source_key").agg(*by_ratio).select("lang_key", "source_key", F.struct(*RATIOS).alias("limits"))


def passes(column: str, limits: str) -> Column:
    """Whether a row is kept. Each comparison is closed by a coalesce: a bare one (or the base verdict alone)
    would let the optimizer infer null checks on the measurements and push them below the join, which
    measures every text again for each of them."""
    m, limit = (lambda r: F.col(f"`{column}`.{r}")), (lambda r: F.col(f"`{limits}`.{r}"))
    over = lambda value, r: F.coalesce(value > limit(r), F.lit(False))
    first, *others = RATIOS
    bad = over(F.when(m("base_failed"), F.lit(float("inf"))).otherwise(m(first)), first)
    for r in others:
        bad = bad | over(m(r), r)
    return ~bad


def judged(docs: DataFrame) -> tuple[DataFrame, str, Column]:
    """(``docs`` measured once, written, and joined with their group's limits; the metrics' column; the verdict)."""
    rows = with_metrics(docs)
    column = rows.columns[-1]
    rows = durable(rows)
    lang, source, limits = fresh(rows, "lang_key", "source_key", "limits")
    found = durable(thresholds(rows, column), narrow=True).toDF(lang, source, limits)
    return join_small(rows.withColumn(lang, group_key("lang")).withColumn(source, group_key("source")), found, [lang, source]), column, passes(column, limits)


def score_documents(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, base counts, ratios, base_failed, kept."""
    slim = docs.select("doc_id", "lang", "source", metrics(F.col("text")).alias("metrics"))
    rows = durable(slim)
    found = durable(thresholds(rows, "metrics"), narrow=True)
    joined = join_small(rows.withColumn("lang_key", group_key("lang")).withColumn("source_key", group_key("source")), found, ["lang_key", "source_key"])
    return joined.select("doc_id", "metrics.*", passes("metrics", "limits").alias("kept"))


def filter_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns unchanged. Texts are measured once, and written beside
    their measurements so that neither sketches nor verdicts measure them again."""
    rows, _, kept = judged(docs)
    return rows.where(kept).select(*[F.col(f"`{c}`") for c in docs.columns])
