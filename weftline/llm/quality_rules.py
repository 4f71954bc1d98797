"""Quality rules as a short-circuit cascade (operator 5), with DataFrame functions only.

Each rule's cost and selectivity are measured on a sample; the rules then run in the order of rejections per cost, and a
row meets no rule after the first that rejects it. The order changes the cost, never the verdict.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import SPACES, free_name, staged, table, words_of

WINDOW = 5
#: About how many rows the rules are measured on, how many characters each rule reads, and how often a row at most.
SAMPLE, WORK, MOST_TIMES = 1_000, 16_000_000, 500

#: Rule -> when a row passes; on the columns of ``measured`` and the text.
RULES = {
    "symbols": "10 * n_symbols <= 3 * n_words",
    "lines": "10 * n_dup_lines <= 3 * n_lines",
    "word_length": "word_chars between 2 * n_words and 20 * n_words",
    "shouting": "2 * (length(text) - length(regexp_replace(text, '\\\\p{Lu}', ''))) <= word_chars",
    "exclamations": "2 * (length(text) - length(translate(text, '!', ''))) <= n_words",
    "digits": "2 * (length(text) - length(translate(text, '0123456789', ''))) <= word_chars",
}


def repeated_words(words: Column) -> Column:
    """How many words lie in a window of WINDOW words that the array holds twice or more.

    Windows are compared by 64-bit hashes of their words. Only where an array has fewer different hashes than windows are
    they sorted; equal neighbours give the positions, whose windows are then laid over each other. The words are bound to
    a variable too: a filter on the result is pushed below the projection that splits the text, and what stands within
    the loop over windows would then split it once a word.
    """

    def hashed(own: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(own) - WINDOW), lambda i: F.xxhash64(*(own[i + k] for k in range(WINDOW))))

    def covered(own: Column) -> Column:
        ordered = F.array_sort(F.transform(own, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def near(s: Column) -> Column:
            left, right = F.slice(s, F.lit(1), F.size(s) - 1), F.slice(s, F.lit(2), F.size(s) - 1)
            none = F.array().cast("array<int>")
            at = F.array_sort(F.array_distinct(F.flatten(F.zip_with(left, right, lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(none)))))
            start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).alias("end"))
            step = lambda acc, p: F.struct((acc["total"] + (p + WINDOW) - F.greatest(p, acc["end"])).alias("total"), (p + WINDOW).alias("end"))
            return F.aggregate(at, start, step, lambda acc: acc["total"])

        # a one-element array binds the sorted windows, which are read several times, to a variable
        return F.transform(F.array(ordered), near)[0]

    def judged(own: Column) -> Column:
        return F.when(F.size(F.array_distinct(own)) == F.size(own), F.lit(0).cast("long")).otherwise(covered(own))

    def counted(own: Column) -> Column:
        return F.when(F.size(own) < WINDOW + 1, F.lit(0).cast("long")).otherwise(F.transform(F.array(hashed(own)), judged)[0])

    return F.transform(F.array(words), counted)[0]


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed")


def _measured(rows: DataFrame) -> DataFrame:
    """Adds MEASURES to rows with a column ``text`` and none of these names."""
    text = F.coalesce(F.col("text"), F.lit(""))
    spaces = "".join(map(chr, [0x20, *range(0x09, 0x0E)]))
    blank = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACES}]"))
    out = rows.withColumns({"words": words_of(F.col("text")), "lines": blank})
    size = lambda c: F.size(c).cast("long")
    out = out.withColumns(
        {
            "n_words": size("words"),
            "word_chars": F.length(F.translate(text, spaces, "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
            "n_lines": size("lines"),
            "n_dup_lines": size("lines") - size(F.array_distinct("lines")),
            "n_repeat_words": repeated_words(F.col("words")),
        }
    ).drop("words", "lines")
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def _neutral(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` as c0, c1, ... with ``text``, so that its own columns may have any name."""
    slim = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    return slim.withColumn("text", F.col(f"c{docs.columns.index(text_col)}"))


def _named(out: DataFrame, docs: DataFrame, added: tuple[str, ...]) -> DataFrame:
    return out.select(*(f"c{k}" for k in range(len(docs.columns))), *added).toDF(*docs.columns, *(free_name(x, docs.columns) for x in added))


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words and base_failed.

    Where ``docs`` has columns of those names, the new ones' names get an underscore more.
    """
    return _named(_measured(_neutral(docs, text_col)), docs, MEASURES)


def rule_figures(docs: DataFrame, rules: dict[str, str] = RULES, sample: int = SAMPLE, text_col: str = "text") -> dict[str, tuple[float, float]]:
    """Each rule's cost (seconds a row) and selectivity (share of rows rejected) on a sample of ``docs``.

    About ``sample`` rows are drawn, and those that pass the base, which alone reach the rules, are written. A rule is run
    on every row so often that about WORK characters are read, in one job, so that what a job costs besides is small; a
    job that runs no rule as often is taken off.
    """
    n = docs.count()
    drawn = docs.select(F.col(text_col).alias("text"))
    drawn = drawn.sample(fraction=min(1.0, sample / n), seed=7) if n else drawn
    drawn = staged(_measured(staged(drawn, "rule-sample")), "rule-sample").where("not base_failed")
    rows, size = drawn.agg(F.count("*"), F.sum(F.length("text"))).first()
    if not rows:
        return {name: (1.0, 0.0) for name in rules}
    times = max(1, min(WORK // max(size, 1), MOST_TIMES))
    often = drawn.withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(times))))

    def timed(passes: str) -> tuple[float, int]:
        best, rejected = float("inf"), 0
        for _ in range(2):
            began = time.perf_counter()
            rejected = often.agg(F.sum(F.when(F.expr(passes), 0).otherwise(1))).first()[0]
            best = min(best, time.perf_counter() - began)
        return best, rejected

    idle = timed("text is null or again > 0")[0]
    out = {}
    for name, passes in rules.items():
        took, rejected = timed(passes)
        out[name] = (max(took - idle, 1e-3) / (rows * times), rejected / (rows * times))
    return out


def cascade_order(docs: DataFrame, rules: dict[str, str] = RULES, sample: int = SAMPLE, text_col: str = "text") -> list[str]:
    """The rules' names by rejections per cost (``rule_figures``); those that reject nothing come last, the cheap first."""
    figures = rule_figures(docs, rules, sample, text_col)
    return sorted(rules, key=lambda name: (-figures[name][1] / figures[name][0], figures[name][0], name))


def judge(docs: DataFrame, rules: dict[str, str] = RULES, sample: int = SAMPLE, order: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with the columns of ``measured``, ``failed_rule`` (the first that rejects the row, or null) and ``kept``.

    A row that fails the base or any rule is not kept; null and empty texts fail the base. Rules that a row's values make
    null count as failed. Rules that tie stand by cost and then name; repeated rows each get the result of their text; an
    empty table gives no rows. Where ``docs`` has columns of those names, the new ones' names get an underscore more.
    """
    order = order or cascade_order(docs, rules, sample, text_col)
    first = F.when(F.col("base_failed"), F.lit("base"))
    for name in order:
        first = first.when(~F.coalesce(F.expr(rules[name]), F.lit(False)), F.lit(name))
    out = _measured(_neutral(docs, text_col)).withColumn("failed_rule", first).withColumn("kept", F.col("failed_rule").isNull())
    return _named(out, docs, (*MEASURES, "failed_rule", "kept"))


def op5_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
i AS (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, list_slice(words, i, i + 4)) AS n FROM i),
c AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM g WHERE n > 1) GROUP BY r),
m AS (SELECT doc_id, text, CAST(len(words) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(lines) AS BIGINT) AS n_lines,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
      FROM d JOIN w USING (r) LEFT JOIN c USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 10 * n_symbols <= 3 * n_words AND 10 * n_dup_lines <= 3 * n_lines
  AND word_chars BETWEEN 2 * n_words AND 20 * n_words
  AND 2 * (length(text) - length(regexp_replace(text, '\p{Lu}', '', 'g'))) <= word_chars
  AND 2 * (length(text) - length(replace(text, '!', ''))) <= n_words
  AND 2 * (length(text) - length(regexp_replace(text, '[0-9]', '', 'g'))) <= word_chars AS kept
FROM b
"""
