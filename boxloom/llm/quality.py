"""Quality rules: a table of thresholds compiled into one projection of length, symbol, stop-word and line ratios."""

from __future__ import annotations

from functools import reduce
from operator import and_, ge, le

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import packed, table, unpacked, words

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Frequent function words of English, German, French and Spanish (fixed values).
STOP_WORDS = (
    "the of and to in is that for it was with on as be by at this from or an "
    "der die das und ist nicht ein eine zu den von mit auf im des sich für dem "
    "le la les et est un une des du en que pour dans au qui sur pas "
    "el los las y es que por con para se una del no su lo"
).split()
#: (name, feature, comparison, bound); `base_` rules fail a document before the others are asked.
RULES = (
    ("base_words", "n_words", ">=", 50),
    ("base_repeats", "repeat_percent", "<=", 50),
    ("words_most", "n_words", "<=", 1_000_000),
    ("word_length_least", "mean_word_chars", ">=", 2.0),
    ("word_length_most", "mean_word_chars", "<=", 14.0),
    ("symbols", "symbol_ratio", "<=", 0.10),
    ("stop_words", "n_stop_words", ">=", 2),
    ("duplicate_lines", "dup_line_ratio", "<=", 0.30),
    ("punctuation_lines", "ellipsis_line_ratio", "<=", 0.30),
)
_COMPARE = {">=": ge, "<=": le}


def _repeated(w: Column, n: Column) -> Column:
    """Words inside three-word windows that occur twice or more: windows sorted, equal neighbours, covered positions."""
    triple = lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("t"), i.alias("i"))
    return F.sort_array(F.when(n >= 3, F.transform(F.sequence(F.lit(0), (n - 3).cast("int")), triple)))


def features(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Counts and ratios of every whole text beside doc_id and _kept, a struct of the columns in `keep`; a null text is an empty one. Works row by row without a shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    first = docs.select("doc_id", packed(keep).alias("_kept"), text.alias("_text"), words(F.col("text")).alias("_w"), lines.alias("_l"))
    n = F.size("_w")
    second = first.select(
        "*",
        n.cast("long").alias("n_words"),
        F.length(F.translate("_text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size("_l").cast("long").alias("n_lines"),
        F.size(F.filter("_l", lambda x: x.endswith("...") | x.endswith("…"))).cast("long").alias("n_ellipsis_lines"),
        F.size(F.filter("_w", lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        _repeated(F.col("_w"), n).alias("_s"),
    )
    s = F.col("_s")
    same = lambda x, j, by: F.coalesce(F.get(s, j + by)["t"] == x["t"], F.lit(False))
    third = second.withColumn("_i", F.transform(F.filter(s, lambda x, j: same(x, j, -1) | same(x, j, 1)), lambda x: x["i"]))
    i = F.col("_i")
    covered = F.size(F.array_distinct(F.concat(i, F.transform(i, lambda x: x + 1), F.transform(i, lambda x: x + 2))))
    fourth = third.withColumn("n_repeat_words", F.when(i.isNull(), F.lit(0)).otherwise(covered).cast("long"))
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return fourth.drop("_text", "_w", "_l", "_s", "_i").withColumns(
        {
            "repeat_percent": 100 * per("n_repeat_words", "n_words"),
            "mean_word_chars": per("word_chars", "n_words"),
            "symbol_ratio": per("n_symbols", "word_chars"),
            "dup_line_ratio": per("n_dup_lines", "n_lines"),
            "ellipsis_line_ratio": per("n_ellipsis_lines", "n_lines"),
        }
    )


def compiled(rules: tuple = RULES) -> tuple[Column, Column]:
    """(base_failed, kept) as columns over features(): the table of thresholds becomes one boolean projection."""
    passes = lambda chosen: reduce(and_, [_COMPARE[op](F.col(feature), F.lit(bound)) for _, feature, op, bound in chosen], F.lit(True))
    base = [r for r in rules if r[0].startswith("base_")]
    return ~passes(base), passes(rules)


def quality(docs: DataFrame, rules: tuple = RULES, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs(doc_id, text): the base counts, base_failed and kept.

    Null and empty texts have no words and fail; equal rows give equal results; an empty table gives none. Columns in `keep`
    may have any name and follow. A text is held whole, with its words, lines and three-word windows, by one task.
    """
    failed, kept = compiled(rules)
    # integer arithmetic for the base rule: 100 * n_repeat_words > 50 * n_words
    failed = failed | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return features(docs, keep).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (kept & ~failed).alias("kept"),
        *unpacked("_kept", keep),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


_STOPS = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
ORACLE = f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
w as (select r, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l from d),
t as (select r, unnest(range(len(w) - 2)) as i, w from w where len(w) >= 3),
g as (select r, i, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] as t from t),
m as (select r, i from (select r, i, count(*) over (partition by r, t) as c from g) where c > 1),
n as (select r, count(distinct i + k) as n_repeat_words from m, range(3) as x(k) group by r),
f as (select doc_id, len(w)::bigint as n_words, len(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::bigint as word_chars,
             len(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
             (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, len(l) as n_lines,
             len(list_filter(l, lambda x: ends_with(x, '...') or ends_with(x, '…'))) as n_ell,
             len(list_filter(w, lambda x: lower(x) in ({_STOPS}))) as n_stop,
             coalesce(n_repeat_words, 0)::bigint as n_repeat_words from w left join n using (r)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from f)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and n_words <= 1000000 and word_chars >= 2 * n_words and word_chars <= 14 * n_words
       and n_symbols <= 0.1::double * word_chars and n_stop >= 2 and n_dup_lines <= 0.3::double * n_lines and n_ell <= 0.3::double * n_lines as kept
from b
"""
QUERIES, SQL = {"op8_quality_rules": query}, {"op8_quality_rules": ORACLE}
