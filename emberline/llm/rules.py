"""Quality rules as a short-circuit cascade of SQL expressions.

Each rule is a Column that says "reject", with the work that takes: the code points it
reads beyond the measures that a row has anyway. Rejections and work are counted over
one sample in one job, and the rules then stand in a CASE by rejections per work, so that
a dear rule is evaluated only for what the cheap ones let through. Counted work is
the same in every run, which the time of a few hundred rows is not.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.session import cut_lineage

BREAKS = r"[\x20\x09-\x0D]+"
BREAK_CHARS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BREAKS), "")


def chars_outside(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def word_chars(text: Column) -> Column:
    return chars_outside(text, BREAK_CHARS).cast("long")


def symbols(text: Column) -> Column:
    return (F.length(text) - chars_outside(text, SYMBOLS)).cast("long")


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: F.trim(F.translate(line, BREAK_CHARS, "")) != "")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line of the text."""
    return let(lines_with_words(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def repeated_words(words: Column) -> Column:
    """Words that stand in some window of five that the text has twice or more, the first included."""
    hashed = lambda ws: F.transform(ws, lambda x: F.xxhash64(x))

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))

    def covered(w: Column) -> Column:
        pairs = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = lambda ps: F.filter(ps, lambda q, i: F.coalesce(q["h"] == F.get(ps, i - 1)["h"], F.lit(False)) | F.coalesce(q["h"] == F.get(ps, i + 1)["h"], F.lit(False)))
        places = F.sort_array(F.transform(let(pairs, twice), lambda q: q["i"]))
        gaps = lambda at: F.transform(at, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - x, F.lit(WINDOW))))
        return F.aggregate(let(places, gaps), F.lit(0), lambda a, x: a + x)

    counted = let(let(hashed(words), windows), lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w)))
    return F.when(F.size(words) < WINDOW + 1, F.lit(0)).otherwise(counted).cast("long")


@dataclass(frozen=True)
class Rule:
    """reject: a Column over text, n_words, word_chars, n_symbols and n_dup_lines (and whatever else the caller adds).
    passes: how often it reads the text; 0 for a rule on the measures alone."""

    name: str
    reject: Column
    passes: float = 1.0


def default_rules() -> list[Rule]:
    text, n, chars = F.col("text"), F.col("n_words"), F.col("word_chars")
    capitals = F.length(text) - chars_outside(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    return [
        Rule("symbols_per_word", F.col("n_symbols") > n, 0),
        Rule("shouting", capitals * 10 > 6 * chars, 2),
        Rule("marks", (F.length(text) - chars_outside(text, "!?")) > n, 2),
        Rule("word_length", (chars < 2 * n) | (chars > 25 * n), 0),
        Rule("duplicate_lines", F.col("n_dup_lines") * 2 > F.size(F.split(text, "\n")), 1),
    ]


def estimates(rows: DataFrame, rules: list[Rule]) -> list[tuple[Rule, int, float]]:
    """(rule, rejections, work) over rows, in one job; a rule's work is 1 for a row at least."""
    hits = [F.count_if(F.coalesce(rule.reject, F.lit(False))) for rule in rules]
    work = [F.coalesce(F.sum(1 + F.lit(float(rule.passes)) * F.length("text")), F.lit(1.0)) for rule in rules]
    got = rows.agg(*hits, *work).first() if rules else []
    return [(rule, got[k], max(1.0, got[len(rules) + k])) for k, rule in enumerate(rules)]


def order_rules(rows: DataFrame, rules: list[Rule]) -> list[Rule]:
    """Rules by rejections per work over rows, best first; by name where that is equal."""
    return [rule for rule, _, _ in sorted(estimates(rows, rules), key=lambda x: (-(x[1] + 0.5) / x[2], x[0].name))]


def sampled(docs: DataFrame, id_col: str, sample_rows: int) -> DataFrame:
    """At most sample_rows rows, those of the first ids by hash, wherever they stand; of a repeated id's rows the first by hash."""
    chosen = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_chosen")).distinct().orderBy(F.xxhash64("_chosen"), "_chosen").limit(sample_rows)
    return docs.join(F.broadcast(chosen), docs[id_col] == F.col("_chosen"), "left_semi").orderBy(F.xxhash64(*docs.columns)).limit(sample_rows)


def cascade(rules: list[Rule]) -> Column:
    """Name of the first rule that rejects, null for none; later rules are not evaluated."""
    out = None
    for rule in rules:
        hit = F.coalesce(rule.reject, F.lit(False))
        out = F.when(hit, rule.name) if out is None else out.when(hit, rule.name)
    return F.lit(None).cast("string") if out is None else out


def with_words(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id_col, text, words, n_words); a null text has no words."""
    texts = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return texts.withColumn("words", words_of(F.col("text"))).withColumn("n_words", F.size("words").cast("long"))


def measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    rows = with_words(docs, text_col, id_col)
    return rows.select(id_col, "text", "n_words", word_chars(F.col("text")).alias("word_chars"), symbols(F.col("text")).alias("n_symbols"), duplicate_lines(F.col("text")).alias("n_dup_lines"), repeated_words(F.col("words")).alias("n_repeat_words"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] | None = None, sample_rows: int = 400) -> DataFrame:
    """(id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept).

    A null or empty text has no words and fails. Rows with null or repeated ids
    are judged each by itself; other columns are ignored. An empty table gives no rows. The order that the sample (of
    at most sample_rows ids) gives never changes a verdict.
    """
    ordered = order_rules(cut_lineage(measured(sampled(docs.select(id_col, text_col), id_col, sample_rows), id_col, text_col)), rules if rules is not None else default_rules())
    judged = measured(docs, id_col, text_col).withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(cascade(ordered).isNull())
    return judged.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))
