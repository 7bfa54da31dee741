"""Quality rules: a threshold table compiled into one Spark projection.

All measures are built-in expressions over the word and line arrays of the whole text; no
row leaves its partition, nothing is shuffled and no user function runs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangeloom.llm.common import require

#: Function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that for it as with was on be at by this from are or an have not",
    "der die das und ist von zu den mit des im ein eine auf für dem nicht sich als auch",
    "le la les de et un une du est que dans pour pas sur qui il au en des elle",
    "el los las y del se por con una lo no es al como más su sus son",
)
SPACE = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """A ratio of two measures that must lie in [least, most], from ``min_words`` words on."""

    name: str
    measure: str
    per: str
    least: float | None = None
    most: float | None = None
    min_words: int = 1


#: Production thresholds.
RULES = (
    Rule("symbols", "n_symbols", "n_words", most=0.1),
    Rule("exclamations", "n_exclamations", "n_words", most=0.3),
    Rule("word_length", "word_chars", "n_words", least=2.0, most=15.0),
    Rule("capitals", "n_capitals", "word_chars", most=0.5),
    Rule("stop_words", "n_stop_words", "n_words", least=0.01, min_words=50),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", most=0.4),
)


def _let(value: Column, body) -> Column:
    """``body`` over a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _count(pattern: str, text: Column) -> Column:
    """Occurrences of a one-character class."""
    return F.size(F.split(text, pattern, -1)) - 1


def _covered(hashes: Column) -> Column:
    """Words in windows whose hash occurs twice or more: sort the windows, keep those with an
    equal neighbour, and add up how far each window reaches before the next one starts."""

    def pairs(s: Column) -> Column:
        twice = F.filter(s, lambda p, i: (p["h"] == F.get(s, i - 1)["h"]) | F.coalesce(p["h"] == F.get(s, i + 1)["h"], F.lit(False)))
        at = F.sort_array(F.transform(twice, lambda p: p["i"]))
        reach = lambda q: F.transform(q, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(q, i + 1) - p, F.lit(WINDOW))))
        return _let(at, lambda q: F.aggregate(reach(q), F.lit(0), lambda a, x: a + x))

    marked = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(F.sort_array(marked), pairs))


#: The measures become columns with this prefix.
PREFIX = "_m_"


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with long counts over the whole text as columns ``_m_<measure>``.

    Words lie between ASCII white space; null, empty and blank texts have zero everywhere.
    n_dup_lines counts \\n-split lines that have a word and equal an earlier line;
    n_repeat_words the words in five-word windows that the text has twice or more.  Windows
    are told apart by 64-bit hashes.  Columns of ``df`` named like a measure are replaced;
    repeated rows each have theirs.
    """
    require(df, text)
    own = {"_t", "_w", "_l", "_h", "_symbols", "_exclamations", "_capitals"}
    if own & set(df.columns):
        raise ValueError(f"columns {sorted(own & set(df.columns))} exist; drop them first")
    names = [F.col(f"`{c}`") for c in df.columns if not c.startswith(PREFIX)]
    t = F.col("_t")
    w, h = F.col("_w"), F.col("_h")
    # Each step stays a projection of its own, as later steps use its columns more than once.
    out = df.select(*names, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_t"))
    out = out.select(
        *names,
        F.array_remove(F.split(t, SPACE, -1), "").alias("_w"),
        F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD)).alias("_l"),
        _count("[#*$%&|<>]", t).alias("_symbols"),
        _count("!", t).alias("_exclamations"),
        _count("[A-Z]", t).alias("_capitals"),
    )
    stops = [s for line in STOP_WORDS for s in line.split()]
    keep = ["_symbols", "_exclamations", "_capitals", "_w", "_l"]
    out = out.select(*names, *keep, F.transform(w, lambda x: F.xxhash64(x)).alias("_h"))
    five = lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(WINDOW)])
    windows = F.when(F.size(h) < WINDOW, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - WINDOW, F.lit(0))), five))
    out = out.select(*names, *keep, windows.alias("_h"))
    values = {
        "n_words": F.size(w),
        "word_chars": F.length(F.array_join(w, "")),
        "n_symbols": F.col("_symbols"),
        "n_dup_lines": F.size("_l") - F.size(F.array_distinct("_l")),
        "n_repeat_words": _covered(h),
        "n_lines": F.size("_l"),
        "n_exclamations": F.col("_exclamations"),
        "n_capitals": F.col("_capitals"),
        "n_stop_words": F.size(F.filter(w, lambda x: F.lower(x).isin(stops))),
    }
    return out.select(*names, *[v.cast("long").alias(PREFIX + k) for k, v in values.items()])


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """One boolean expression: true where every rule holds.  A zero denominator passes."""
    verdict = F.lit(True)
    for r in rules:
        value, per, words = (F.col(PREFIX + c) for c in (r.measure, r.per, "n_words"))
        ok = F.lit(True)
        if r.least is not None:
            ok &= value >= per * r.least
        if r.most is not None:
            ok &= value <= per * r.most
        verdict &= (words < r.min_words) | ok
    return verdict


def base_failed() -> Column:
    """Fewer than ten words, or over a fifth of the words in repeated windows."""
    n, repeat = F.col(PREFIX + "n_words"), F.col(PREFIX + "n_repeat_words")
    return (n < 10) | (100 * repeat > 20 * n)


def judge(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``df`` with its measures, ``_base_failed`` and ``_kept`` (base holds and every rule holds).

    Columns of these names are replaced.  The verdict is tied to the row's id, which is never negative: a filter on it can then
    not be pushed below the measures, where it would compute them once per rule.
    """
    out = measures(df.drop("_base_failed", "_kept"), text)
    own_row = F.monotonically_increasing_id() >= 0
    return out.select("*", base_failed().alias("_base_failed"), (~base_failed() & compile_rules(rules) & own_row).alias("_kept"))


def keep_good(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``df`` that pass; same columns, whatever their names.

    Null, empty and blank texts have fewer than ten words and go; repeated rows are judged alike.
    """
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{text}`").alias("text"))
    return judge(packed, "text", rules).where("_kept").select("row.*")
