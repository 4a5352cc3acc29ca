"""Operator 4, quality rules: a threshold table compiled into one projection, without user functions.

Every rule is a row (name, numerator, denominator, lowest, highest, least words); the ratios are
Spark expressions, so the whole table runs inside one narrow projection: no shuffle, no state,
any number of rows. Lost executors only cost the tasks they ran.

Defined results: a null or blank text has no words, all measures are 0 and it fails; long texts are
measured whole; equal rows get equal verdicts; null ids pass through; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NON_SPACE, let, read, words

WINDOW = 5
SYMBOLS = "#*$%&|<>"
#: A word with a letter in it, whole, so that each is one match.
LETTER_WORD = rf"(?<!{NON_SPACE})[^\x20\x09-\x0D\p{{L}}]*+\p{{L}}{NON_SPACE}*+"
#: Frequent function words of the languages the corpora hold.
STOP_WORDS = (
    "the of and to in a is that for it on was with be as by at this are an or from not "
    "de la que el en los del se las por un una con para su al le les des et du est dans qui "
    "der die das und den von zu ist mit im ein eine nicht auf für sich dem au sur par il"
).split()


@dataclass(frozen=True)
class Rule:
    """Fails a text of at least `words` words whose measure/per lies outside [low, high]."""

    name: str
    measure: str
    per: str
    low: float = float("-inf")
    high: float = float("inf")
    words: int = 1


BASE_RULES = (
    Rule("few_words", "n_words", "one", low=10, words=0),
    Rule("repeated_windows", "n_repeat_words", "n_words", high=0.2),
)
RULES = (
    Rule("word_length", "word_chars", "n_words", low=2.5, high=12.0),
    Rule("symbols", "n_symbols", "n_words", high=0.1),
    Rule("shouting", "n_marks", "n_words", high=0.9),
    Rule("stop_words", "n_stop_words", "n_words", low=0.005, words=200),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=0.5),
    Rule("letters", "n_letter_words", "n_words", low=0.5),
)


def _repeat_words(ws: Column) -> Column:
    """Words inside 5-word windows that stand twice or more in the text.

    Window hashes (64 bits, compared within one text only) are sorted with their places; places whose
    neighbour has the same hash are covered, each up to the next covered place."""

    def windows(h: Column) -> Column:
        n = F.size(h) - WINDOW
        return F.transform(F.sequence(F.lit(0), n), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))

    def covered(win: Column) -> Column:
        def places(s: Column) -> Column:
            hit = F.transform(s, lambda x, i: F.when(_twin(s, i), x["i"]))
            return F.sort_array(F.array_compact(hit))

        sorted_ = F.sort_array(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        spans = let(let(sorted_, places), lambda p: F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))))
        return F.aggregate(spans, F.lit(0), lambda a, x: a + x)

    hashes = F.transform(ws, lambda w: F.xxhash64(w))
    some = lambda win: F.when(F.size(F.array_distinct(win)) < F.size(win), covered(win)).otherwise(F.lit(0))
    return F.when(F.size(ws) < WINDOW, F.lit(0)).otherwise(let(let(hashes, windows), some))


def _twin(s: Column, i: Column) -> Column:
    """Whether a neighbour among the sorted windows has the same hash."""
    return F.coalesce(F.get(s, i - 1)["h"] == s[i]["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == s[i]["h"], F.lit(False))


def _measures(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(NON_SPACE))

    def lost(chars: str) -> Column:
        """How many of some ASCII characters a text holds: the bytes that go with them."""
        rest = t
        for c in chars:
            rest = F.replace(rest, F.lit(c), F.lit(""))
        return F.octet_length(t) - F.octet_length(rest)

    def of(ws: Column) -> Column:
        return F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
            lost(SYMBOLS).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.struct(F.size(x).cast("long").alias("all"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
            _repeat_words(ws).cast("long").alias("n_repeat_words"),
            lost("!").cast("long").alias("n_marks"),
            F.size(F.filter(ws, lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
            F.regexp_count(t, F.lit(LETTER_WORD)).cast("long").alias("n_letter_words"),
        )

    return let(words(text), of)


def _fails(rule: Rule, measures: dict[str, Column]) -> Column:
    """measure/per against the bounds, multiplied out so that whole numbers decide exactly."""
    x, per = measures[rule.measure], measures[rule.per]
    out = F.lit(False)
    if rule.low != float("-inf"):
        out = out | (x * 1000 < per * round(rule.low * 1000))
    if rule.high != float("inf"):
        out = out | (x * 1000 > per * round(rule.high * 1000))
    return out & (measures["n_words"] >= rule.words)


def quality(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """docs with one struct column `_quality`: measures, base_failed, failed (names of rules) and kept.

    The measures are bound once inside the expression, so that a filter on the verdict, which the optimizer
    moves below the projection, computes them once too."""

    def judged(m: Column) -> Column:
        c = {k: m[k] for k in ("n_words", "word_chars", "n_symbols", "n_repeat_words", "n_marks", "n_stop_words", "n_letter_words")}
        c |= {"n_lines": m["lines"]["all"], "n_dup_lines": m["lines"]["dup"], "one": F.lit(1)}
        failed = F.array_compact(F.array(*[F.when(_fails(r, c), F.lit(r.name)) for r in (*base, *rules)]))
        base_failed = F.lit(False)
        for r in base:
            base_failed = base_failed | _fails(r, c)
        return let(failed, lambda f: F.struct(*[c[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], base_failed.alias("base_failed"), (F.size(f) == 0).alias("kept"), f.alias("failed")))

    return docs.withColumn("_quality", let(_measures(F.col(text)), judged))


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    q = quality(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return q.select("doc_id", *[f"_quality.{k}" for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])
