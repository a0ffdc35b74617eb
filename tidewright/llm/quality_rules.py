"""Risk-controlled quality rules, in DataFrame functions alone.

Each rule rejects a text whose signal exceeds a cutoff.  Cutoffs come from a fixed grid; for each stratum, rule and
cutoff the labelled good texts that pass the base rules say how many of ``n`` it would reject, ``k``.  A cutoff may be
used where an exact binomial bound holds: with false rejection rate ``alpha / rules``, ``k`` or fewer rejections would
have probability ``delta / tests`` at most (Clopper-Pearson by test inversion; Bonferroni over all strata, rules and
cutoffs).  Of those the one that separates bad from good labelled texts best is used, the laxer one of equals; a rule
without one stays silent.  So with probability 1 - delta no stratum loses more than ``alpha`` of its good texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import cut, small_side

SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 8
#: Cutoffs of each rule: the share beyond which it rejects.
GRID = {
    "symbol_share": (0.01, 0.02, 0.03, 0.05, 0.08, 0.1, 0.15, 0.2, 0.3, 0.5),
    "upper_share": (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8),
    "dup_line_share": (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7),
    "repeat_share": (0.02, 0.05, 0.1, 0.15, 0.2, 0.25),
}


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, even where ``body`` uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def repeat_words(words: Column) -> Column:
    """Words inside runs of ``WINDOW`` words that are found twice or more, the first included."""

    def covered(windows: Column) -> Column:
        def of_sorted(order: Column) -> Column:
            again = F.filter(order, lambda x, i: (x["h"] == F.get(order, i - 1)["h"]) | (x["h"] == F.get(order, i + 1)["h"]))
            return let(F.array_sort(F.transform(again, lambda x: x["i"])), lambda at: F.aggregate(F.transform(at, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b))

        twice = F.size(F.array_distinct(windows)) < F.size(windows)
        return F.when(twice, let(F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), of_sorted)).otherwise(0)

    def of_words(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(w) - WINDOW + 1)
        return F.when(F.size(w) > WINDOW, let(F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, WINDOW))), covered)).otherwise(0)

    return let(words, of_words)


def signals(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", carry: bool = False) -> DataFrame:
    """doc_id, stratum, counts, base_failed and the rules' shares of whole texts; a null text has no words.

    With ``carry`` the column row has all columns of ``docs``.
    """
    more = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if carry else []
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"), text.alias("text"), *more)
    more = ["row"] if carry else []
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    without = lambda these: F.length("text") - F.length(F.translate("text", these, ""))
    words = F.array_remove(F.split("text", SPACE), "")
    counted = docs.select(
        "doc_id",
        "stratum",
        let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).cast("long").alias("n_repeat_words"))).alias("w"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        without(SYMBOLS).cast("long").alias("n_symbols"),
        without(UPPER).cast("long").alias("n_upper"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("x"),
        *more,
    )
    counted = counted.select("doc_id", "stratum", "w.*", "x.*", "word_chars", "n_symbols", "n_upper", *more)
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return counted.select(
        "*",
        ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"),
        share("n_symbols", "word_chars").alias("symbol_share"),
        share("n_upper", "word_chars").alias("upper_share"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
    )


def log_gamma(x: Column) -> Column:
    """Stirling's series at x + 8, carried back; for x >= 1."""
    y = x + 8.0
    series = (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    return series - reduce(lambda a, b: a + b, (F.log(x + float(i)) for i in range(8)))


def lower_tail(n: Column, k: Column, rate: float) -> Column:
    """P(Bin(n, rate) <= k) where k < n * rate, summed from k down until 12 standard deviations more add nothing; else 1."""
    n, k = n.cast("double"), k.cast("double")
    top = log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * F.log(F.lit(rate)) + (n - k) * F.log(F.lit(1 - rate))
    terms = F.least(k, F.ceil(12 * F.sqrt(n * rate * (1 - rate)) + 60).cast("double")).cast("int")
    down = F.aggregate(
        F.sequence(F.lit(0), terms),
        F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum")),
        lambda a, i: F.struct((a["term"] * (k - i) / (n - k + i + 1) * ((1 - rate) / rate)).alias("term"), (a["sum"] + a["term"]).alias("sum")),
        lambda a: a["sum"],
    )
    return F.when(k < n * rate, F.exp(top) * down).otherwise(1.0)


def cutoffs(measured: DataFrame, labels: DataFrame, *, alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """stratum, rule and cutoff of every rule that may speak, from ``labels`` (doc_id, quality) of all labelled texts."""
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    held = measured.filter(~F.col("base_failed")).join(known, "doc_id")
    good, bad = F.col("quality") == 1, F.col("quality") != 1
    grid = [(rule, c) for rule, cs in GRID.items() for c in cs]
    sums = [F.count_if(side & (F.col(rule) > c)).alias(f"{name}{i}") for i, (rule, c) in enumerate(grid) for name, side in (("g", good), ("b", bad))]
    counted = cut(held.groupBy("stratum").agg(F.count_if(good).alias("n"), F.count_if(bad).alias("m"), *sums))
    cells = F.array(*(F.struct(F.lit(rule).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"g{i}").alias("k"), F.col(f"b{i}").alias("caught")) for i, (rule, c) in enumerate(grid)))
    tests = counted.select("stratum", "n", "m", F.inline(cells))
    safe = tests.filter(lower_tail(F.col("n"), F.col("k"), alpha / len(GRID)) * len(grid) * counted.count() <= delta)
    gain = F.col("caught") / F.greatest(F.col("m"), F.lit(1)) - F.col("k") / F.greatest(F.col("n"), F.lit(1))
    useful = safe.withColumn("gain", gain).filter("gain > 0")
    return useful.groupBy("stratum", "rule").agg(F.max_by("cutoff", F.struct("gain", "cutoff")).alias("cutoff"))


def judge(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """Counts, base_failed and kept of whole texts, one row per input row.

    Null and repeated ids are judged by their own text; a null or empty text has no words and fails the base.  A null
    stratum is a stratum of its own; a stratum without labels keeps what passes the base.  Of a document's repeated
    labels the best counts, null labels do not.  Other columns are ignored; an empty table gives no rows.
    """
    measured = cut(signals(docs, id_col=id_col, text_col=text_col, stratum_col=stratum_col))
    judged = verdicts(measured, cut(cutoffs(measured, labels, alpha=alpha, delta=delta)))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def verdicts(measured: DataFrame, chosen: DataFrame) -> DataFrame:
    """``measured`` with kept: not base_failed, and no rule of its stratum fires."""
    limits = chosen.groupBy("stratum").agg(*(F.min(F.when(F.col("rule") == rule, F.col("cutoff"))).alias(f"{rule}_cutoff") for rule in GRID))
    fires = reduce(lambda a, b: a | b, (F.coalesce(F.col(rule) > F.col(f"{rule}_cutoff"), F.lit(False)) for rule in GRID))
    return measured.join(small_side(limits), "stratum", "left").withColumn("kept", ~F.col("base_failed") & ~fires)


def keep(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``judge`` keeps.  Only labelled rows are measured twice."""
    names = {"id_col": id_col, "text_col": text_col, "stratum_col": stratum_col}
    # texts stay where they are unless there are more labels than may be broadcast
    known = labels.filter("quality is not null").select(F.col("doc_id").alias(id_col)).distinct()
    labelled = docs.join(small_side(known, 500_000), id_col, "left_semi")
    chosen = cut(cutoffs(cut(signals(labelled, **names)), labels, alpha=alpha, delta=delta))
    return verdicts(signals(docs, **names, carry=True), chosen).filter("kept").select("row.*")


def oracle_sql(alpha: float = 0.02, delta: float = 0.05) -> str:
    """The same rows in DuckDB SQL over documents and labels."""
    rate = alpha / len(GRID)
    grid = ", ".join(f"('{rule}', {c!r})" for rule, cs in GRID.items() for c in cs)
    value = "CASE rule " + " ".join(f"WHEN '{rule}' THEN {rule}" for rule in GRID) + " END"
    return f"""
WITH texts AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text FROM documents),
split AS (SELECT *, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM texts),
windows AS (SELECT row_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS win FROM (SELECT row_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM split)),
again AS (SELECT row_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY row_id, win) > 1),
covered AS (SELECT row_id, count(DISTINCT p) AS c FROM (SELECT row_id, unnest(range(i, i + {WINDOW})) AS p FROM again) GROUP BY row_id),
counted AS (SELECT s.row_id, doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(length(regexp_replace(text, '[^A-Z]', '', 'g')) AS BIGINT) AS n_upper,
  CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c, 0) AS BIGINT) AS n_repeat_words
  FROM split s LEFT JOIN covered USING (row_id)),
measured AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, coalesce(n_symbols / nullif(word_chars, 0)::DOUBLE, 0) AS symbol_share,
  coalesce(n_upper / nullif(word_chars, 0)::DOUBLE, 0) AS upper_share, coalesce(n_dup_lines / nullif(n_lines, 0)::DOUBLE, 0) AS dup_line_share,
  coalesce(n_repeat_words / nullif(n_words, 0)::DOUBLE, 0) AS repeat_share FROM counted),
known AS (SELECT doc_id, max(quality) AS quality FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
held AS (SELECT * FROM measured JOIN known USING (doc_id) WHERE NOT base_failed),
grid(rule, cutoff) AS (VALUES {grid}),
tests AS (SELECT stratum, rule, cutoff, count(*) FILTER (quality = 1) AS n, count(*) FILTER (quality <> 1) AS m, count(*) FILTER (quality = 1 AND {value} > cutoff) AS k,
  count(*) FILTER (quality <> 1 AND {value} > cutoff) AS caught FROM held, grid GROUP BY ALL),
tails AS (SELECT t.*, CASE WHEN k < n * {rate!r} THEN (SELECT sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({rate!r}) + (n - j) * ln(1 - {rate!r}))) FROM unnest(range(0, k + 1)) AS r(j)) ELSE 1 END AS tail FROM tests t),
useful AS (SELECT *, caught / greatest(m, 1) - k / greatest(n, 1) AS gain FROM tails WHERE tail * (SELECT count(*) FROM grid) * (SELECT count(DISTINCT stratum) FROM held) <= {delta!r}),
chosen AS (SELECT stratum, rule, cutoff FROM useful WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY gain DESC, cutoff DESC) = 1),
fired AS (SELECT DISTINCT row_id FROM measured JOIN chosen USING (stratum) WHERE {value} > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND row_id NOT IN (SELECT row_id FROM fired) AS kept FROM measured
"""
