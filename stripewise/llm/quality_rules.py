"""Quality rules: a threshold table compiled into one projection, without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stripewise.llm.common import let, without_spaces, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that it for on was be with as this by at or an from are not "
    "der die das und zu den von mit sich des ein eine einer einen ist nicht für auf im dem als auch "
    "le la les de des du un une et en que qui dans est pour par sur pas au ce il "
    "el los las un una y en que de del se por con para no su lo es al"
).split()


@dataclass(frozen=True)
class Rule:
    """A measure and the closed range that it must lie in; None leaves that end open."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: Judged besides the base rules; a ratio over nothing counts as passed. Values as usual in
#: published filters of web text.
RULES = (
    Rule("word_length", "mean_word_length", 3.0, 10.0),
    Rule("symbols", "symbol_ratio", None, 0.1),
    Rule("stop_words", "stop_word_ratio", 0.01, None),
    Rule("repeated_lines", "dup_line_ratio", None, 0.3),
    Rule("ellipses", "ellipsis_line_ratio", None, 0.3),
    Rule("bullets", "bullet_line_ratio", None, 0.9),
    Rule("letters", "letter_word_ratio", 0.8, None),
)

#: The loose table that the SQL of op10_quality_rules has.
LOOSE_RULES = (
    Rule("word_length", "mean_word_length", 1.5, 25.0),
    Rule("symbols", "symbol_ratio", None, 0.9),
    Rule("stop_words", "stop_word_ratio", 0.01, None),
    Rule("repeated_lines", "dup_line_ratio", None, 0.5),
    Rule("ellipses", "ellipsis_line_ratio", None, 0.5),
    Rule("bullets", "bullet_line_ratio", None, 0.9),
    Rule("letters", "letter_word_ratio", 0.5, None),
)


def _fold(hashes: Column, gap: int) -> Column:
    """From hashes of windows of gap words those of windows twice as long."""
    n = F.size(hashes) - gap
    return F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(1 + gap), n), lambda a, b: F.xxhash64(a, b))


def _windows(words: Column) -> Column:
    """A 64-bit hash of every window of eight words, made in three doubling steps."""
    one = F.transform(words, lambda w: F.xxhash64(w))
    return let(one, lambda a: let(_fold(a, 1), lambda b: let(_fold(b, 2), lambda c: _fold(c, 4))))


def _covered(windows: Column) -> Column:
    """Words that lie in windows found at least twice: equal windows meet after a sort."""
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def positions(s: Column) -> Column:
        same = lambda e, j: F.coalesce(F.get(s, j)["h"] == e["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda e, j: same(e, j - 1) | same(e, j + 1)), lambda e: e["i"]))

    def add(acc: Column, i: Column) -> Column:
        return F.struct((i + WINDOW).alias("end"), (acc["n"] + i + WINDOW - F.greatest(i, acc["end"])).alias("n"))

    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    return F.aggregate(let(placed, positions), start, add, lambda acc: acc["n"])


def repeated_words(words: Column) -> Column:
    """Number of words in windows of eight words found twice or more, the first included."""
    found = let(
        _windows(words),
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered(h)),
    )
    return F.when(F.size(words) > WINDOW, found).otherwise(F.lit(0))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b)


def _measures(text: Column) -> Column:
    with_word = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of_lines(lines: Column) -> list[Column]:
        return [
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)\s*$"))).cast("long").alias("n_ellipsis_lines"),
            F.size(F.filter(lines, lambda x: x.rlike(r"^\s*[-*•‣▪]"))).cast("long").alias("n_bullet_lines"),
        ]

    def of_words(words: Column) -> list[Column]:
        stops = sorted({s for w in STOP_WORDS for s in (w, w.capitalize(), w.upper())})
        return [
            F.size(words).cast("long").alias("n_words"),
            F.size(F.filter(words, lambda w: w.isin(stops))).cast("long").alias("n_stop_words"),
            F.size(F.filter(words, lambda w: w.rlike(r"\p{L}"))).cast("long").alias("n_letter_words"),
            repeated_words(words).cast("long").alias("n_repeat_words"),
        ]

    return F.struct(
        F.length(without_spaces(text)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(with_word, lambda lines: F.struct(*of_lines(lines))).alias("lines"),
        let(words_of(text), lambda words: F.struct(*of_words(words))).alias("words"),
    )


def quality_rules(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, failed_rules (names, base rules included) and the ratios judged.

    The rule table becomes part of the same projection: no shuffle, no user function, one scan.
    Null and empty texts have no words and fail the base rule on length; ratios over nothing
    are null and pass; repeated rows and null ids are judged like any other row; an empty
    table gives none; other columns of docs are not carried, so their names cannot clash.
    """
    m = F.col("m")
    text = F.coalesce(F.col(text_col), F.lit(""))
    w, ln = m["words"], m["lines"]
    measured = {
        "mean_word_length": _ratio(m["word_chars"], w["n_words"]),
        "symbol_ratio": _ratio(m["n_symbols"], w["n_words"]),
        "stop_word_ratio": _ratio(w["n_stop_words"], w["n_words"]),
        "letter_word_ratio": _ratio(w["n_letter_words"], w["n_words"]),
        "dup_line_ratio": _ratio(ln["n_dup_lines"], ln["n_lines"]),
        "ellipsis_line_ratio": _ratio(ln["n_ellipsis_lines"], ln["n_lines"]),
        "bullet_line_ratio": _ratio(ln["n_bullet_lines"], ln["n_lines"]),
    }
    short = w["n_words"] < MIN_WORDS
    repeats = 100 * w["n_repeat_words"] > MAX_REPEATED_PERCENT * w["n_words"]
    failed = [F.when(short, F.lit("min_words")), F.when(repeats, F.lit("repeated_words"))]
    for r in rules:
        x = measured[r.measure]
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (x < r.low)
        if r.high is not None:
            bad = bad | (x > r.high)
        failed.append(F.when(F.coalesce(bad, F.lit(False)), F.lit(r.name)))
    return (
        docs.select(F.col(id_col), _measures(text).alias("m"))
        .select(
            F.col(id_col),
            w["n_words"].alias("n_words"),
            m["word_chars"].alias("word_chars"),
            m["n_symbols"].alias("n_symbols"),
            ln["n_dup_lines"].alias("n_dup_lines"),
            w["n_repeat_words"].alias("n_repeat_words"),
            (short | repeats).alias("base_failed"),
            F.array_compact(F.array(*failed)).alias("failed_rules"),
            *[v.alias(k) for k, v in measured.items()],
        )
        .withColumn("kept", F.size("failed_rules") == 0)
    )
