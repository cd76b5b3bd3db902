"""Quality rules with risk-controlled cutoffs. SQL functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import let, written

#: Characters counted as symbols (fixed values).
SYMBOLS = "#*$%&|<>"
_BITS = 21
_MASK = (1 << _BITS) - 1


def _repeats(w: Column) -> Column:
    """Words that lie in a 3-word window found twice or more, of an array of words.

    Windows are sorted as hash and position packed in one number; if two
    windows with one hash differ, or the text is too long to pack, windows are
    sorted by their words instead, with equal results.
    """
    last = F.size(w) - 3

    def covered(p: Column) -> Column:  # sorted starts of repeated windows
        gaps = F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3))))
        return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda a, g: a + g.cast("bigint"))

    def by_hash(s: Column, plain: Column) -> Column:
        top = lambda x: F.shiftright(x, _BITS)
        again = F.filter(s, lambda x, j: F.coalesce(top(x) == top(F.get(s, j + 1)), F.lit(False)) | F.coalesce(top(x) == top(F.get(s, j - 1)), F.lit(False)))

        def judged(d: Column) -> Column:
            at = lambda x, k: F.get(w, (x.bitwiseAND(F.lit(_MASK)) + k).cast("int"))
            differ = lambda x, y: (at(x, 0) != at(y, 0)) | (at(x, 1) != at(y, 1)) | (at(x, 2) != at(y, 2))
            clash = F.filter(d, lambda x, j: F.coalesce((top(x) == top(F.get(d, j + 1))) & differ(x, F.get(d, j + 1)), F.lit(False)))
            return F.when(F.size(clash) > 0, plain).otherwise(let(F.sort_array(F.transform(d, lambda x: x.bitwiseAND(F.lit(_MASK)))), covered))

        return F.when(F.size(again) == 0, F.lit(0).cast("bigint")).otherwise(let(again, judged))

    def by_words() -> Column:
        windows = F.sort_array(
            F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(F.get(w, i).alias("a"), F.get(w, i + 1).alias("b"), F.get(w, i + 2).alias("c"), i.cast("bigint").alias("i")))
        )

        def found(s: Column) -> Column:
            eq = lambda x, y: F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))
            return let(F.sort_array(F.transform(F.filter(s, lambda x, j: eq(x, F.get(s, j + 1)) | eq(x, F.get(s, j - 1))), lambda x: x["i"])), covered)

        return let(windows, found)

    def packed(h: Column) -> Column:
        return F.sort_array(
            F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)).bitwiseAND(F.lit(~_MASK)).bitwiseOR(i.cast("bigint")))
        )

    plain = by_words()
    fast = let(let(F.transform(w, lambda x: F.xxhash64(x)), packed), lambda s: by_hash(s, plain))
    return F.when(F.size(w) < 4, F.lit(0).cast("bigint")).when(F.size(w) > _MASK, plain).otherwise(fast)


def text_statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row: doc_id and the counts that rules use.

    n_words, word_chars, n_symbols, n_dup_lines (lines with a word that equal
    an earlier line), n_repeat_words, and n_lines (with a word), n_upper,
    n_marks (``!`` and ``?``) and n_doubled (words equal to the word before).
    A null text has no words. Null ids pass through, repeated rows repeat,
    other columns are ignored. No shuffle.
    """
    text = F.coalesce(df[text_col], F.lit(""))
    rows = df.select(df[id_col].alias("doc_id"), text.alias("text"))
    words = F.filter(F.split("text", r"[ \t-\r]+", -1), lambda x: x != "")
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    bare = F.col("text")
    for c in SYMBOLS:
        bare = F.replace(bare, F.lit(c), F.lit(""))
    marks = F.replace(F.replace(F.col("text"), F.lit("!"), F.lit("")), F.lit("?"), F.lit(""))
    stats = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
            _repeats(w).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x, i: F.coalesce(F.get(w, i - 1) == x, F.lit(False)))).cast("bigint").alias("n_doubled"),
        ),
    )
    by_line = let(lines, lambda x: F.struct(F.size(x).cast("bigint").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines")))
    size = F.char_length("text")
    counted = rows.select(
        "doc_id",
        stats.alias("w"),
        by_line.alias("l"),
        (size - F.char_length(bare)).cast("bigint").alias("n_symbols"),
        (size - F.char_length(F.regexp_replace("text", r"\p{Lu}+", ""))).cast("bigint").alias("n_upper"),
        (size - F.char_length(marks)).cast("bigint").alias("n_marks"),
    )
    return counted.select("doc_id", "w.n_words", "w.word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines", "n_upper", "n_marks", "w.n_doubled")


#: rule -> (SQL of its value; larger is worse, candidate cutoffs from lenient to strict)
RULES: dict[str, tuple[str, list[float]]] = {
    "symbols": ("n_symbols / greatest(word_chars, 1)", [0.5, 0.3, 0.2, 0.12, 0.08, 0.05]),
    "upper": ("n_upper / greatest(word_chars, 1)", [0.8, 0.6, 0.5, 0.4, 0.3, 0.2]),
    "marks": ("n_marks / greatest(n_words, 1)", [1.0, 0.6, 0.4, 0.3, 0.2, 0.15]),
    "doubled_words": ("n_doubled / greatest(n_words, 1)", [0.5, 0.4, 0.3, 0.2, 0.15, 0.1]),
    "repeated_words": ("n_repeat_words / greatest(n_words, 1)", [0.5, 0.45, 0.4, 0.35, 0.3, 0.25]),
    "repeated_lines": ("n_dup_lines / greatest(n_lines, 1)", [0.8, 0.7, 0.6, 0.5, 0.4, 0.3]),
    "long_words": ("word_chars / greatest(n_words, 1)", [40.0, 25.0, 20.0, 16.0, 14.0, 12.0]),
}
#: Strata by length: bounded in number and known for every document.
STRATA = 3
STRATUM = "CASE WHEN n_words < 200 THEN 0 WHEN n_words < 1000 THEN 1 ELSE 2 END"
BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


def binomial_cdf(x: int, n: int, p: float) -> float:
    """P(X <= x) of a binomial distribution, as a regularised incomplete beta function; its time does not grow with ``x``."""
    if x >= n:
        return 1.0
    return _beta_share(n - x, x + 1, 1 - p)


def _beta_share(a: float, b: float, t: float) -> float:
    """The regularised incomplete beta function, by Lentz's continued fraction."""
    if t <= 0 or t >= 1:
        return float(t >= 1)
    if t > (a + 1) / (a + b + 2):
        return 1 - _beta_share(b, a, 1 - t)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(t) + b * math.log1p(-t)) / a
    tiny, c = 1e-300, 1.0
    d = 1 / ((1 - (a + b) * t / (a + 1)) or tiny)
    f = d
    for m in range(1, 100_000):
        for k in (m * (b - m) * t / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * t / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + k * d) or tiny)
            c = (1 + k / c) or tiny
            f *= c * d
        if abs(c * d - 1) < 1e-13:
            break
    return front * f


def certified(lost: int, good: int, risk: float, delta: float) -> bool:
    """Whether the exact (Clopper-Pearson) upper bound, at confidence 1 - ``delta``, on a share seen as ``lost`` of ``good`` is at most ``risk``."""
    return good > 0 and lost <= risk * good and binomial_cdf(lost, good, risk) <= delta


@dataclass(frozen=True)
class Cutoffs:
    """Certified cutoffs by stratum and rule; a rule without one never rejects."""

    by: dict[tuple[int, str], float]

    def rejects(self) -> Column:
        out = F.lit(False)
        for (stratum, rule), c in sorted(self.by.items()):
            out = out | ((F.expr(STRATUM) == stratum) & (F.expr(RULES[rule][0]) > c))
        return out


def chain(bins: list[tuple[int, ...]], bad: list[int], good: list[int], price: float) -> list[tuple[str, int]]:
    """Steps (rule, number of its cutoff) that make the rules of a stratum stricter, best first.

    ``bins`` holds, for kinds of documents, how many cutoffs of each rule they
    exceed, and ``bad`` and ``good`` how many there are. Each step takes one rule
    to a stricter cutoff, the one that newly rejects the most bad documents with
    a good one counting as ``price`` bad ones (of equals the more lenient, then
    the rule listed first), until none gains. So the sets rejected are nested.
    """
    out: list[tuple[str, int]] = []
    left = list(range(len(bins)))
    while left:
        best = None
        for r, (name, (_, cuts)) in enumerate(RULES.items()):
            gain = 0.0
            for k in range(len(cuts)):
                gain += sum(bad[i] - price * good[i] for i in left if bins[i][r] == len(cuts) - k)
                if gain > 0 and (best is None or gain > best[0]):
                    best = (gain, name, k, r)
        if best is None:
            return out
        _, name, k, r = best
        out.append((name, k))
        left = [i for i in left if bins[i][r] < len(RULES[name][1]) - k]
    return out


def calibrate(stats: DataFrame, labels: DataFrame, risk: float = 0.02, delta: float = 0.05, price: float = 20.0) -> Cutoffs:
    """Chooses cutoffs on every labelled document with quality 0 or 1 that passes the base rules.

    A quarter of them (by a hash of the id) lays down, for each stratum, a
    sequence of ever stricter sets of cutoffs (:func:`chain`). The other three
    quarters are the holdout: along the sequence, each set as a whole is tested
    with the exact binomial bound on the share of good documents that it
    rejects, and the first that fails ends the tests. The last set that passes
    is taken. So with probability 1 - ``delta`` at least, in every stratum
    at most a share ``risk`` of all good documents is rejected by its rules
    together: a fixed sequence needs no correction, and ``delta`` is divided by
    the number of strata. A stratum with too few good labels (fewer than 203 in
    the holdout, by default) rejects nothing.

    Null ids or labels are not used; a document labelled twice counts as good
    if any label says so. The driver gets one row for each different set of
    exceeded cutoffs, which are bounded by the lists of RULES.
    """
    truth = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    exceeded = [sum((F.when(F.expr(value) > c, 1).otherwise(0) for c in cuts), F.lit(0)) for value, cuts in RULES.values()]
    holdout = F.crc32(F.concat(F.lit("rules"), F.col("doc_id").cast("string"))) % 4 != 0
    rows = stats.where(f"NOT ({BASE_FAILED})").join(truth, "doc_id")
    counts = rows.groupBy(F.expr(STRATUM).alias("stratum"), F.array(*exceeded).alias("bins"), holdout.alias("holdout"), (F.col("quality") == 1).alias("good")).count().collect()
    by: dict[tuple[int, str], float] = {}
    for stratum in range(STRATA):
        table: dict[tuple[int, ...], dict[tuple[bool, bool], int]] = {}
        for r in counts:
            if r["stratum"] == stratum:
                table.setdefault(tuple(r["bins"]), {})[r["holdout"], r["good"]] = r["count"]
        bins = sorted(table)
        n = lambda holdout, good: [table[b].get((holdout, good), 0) for b in bins]  # noqa: E731, B023
        held = n(True, True)
        lost, level = [False] * len(bins), {}
        for rule, k in chain(bins, n(False, False), n(False, True), price):
            at, least = list(RULES).index(rule), len(RULES[rule][1]) - k
            lost = [x or b[at] >= least for x, b in zip(lost, bins, strict=True)]
            if not certified(sum(h for h, x in zip(held, lost, strict=True) if x), sum(held), risk, delta / STRATA):
                break
            level[rule] = k
        by |= {(stratum, rule): RULES[rule][1][k] for rule, k in level.items()}
    return Cutoffs(by)


def quality_rules(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", risk: float = 0.02, delta: float = 0.05) -> DataFrame:
    """The statistics of :func:`text_statistics` with base_failed and kept.

    One row for each input row, repeated rows included; see there for nulls.
    Documents without labels, and null ids, are judged like the others. With
    an empty table or empty labels there are no cutoffs (:func:`calibrate`), and
    the base rules alone decide.
    """
    stats = written(text_statistics(df, id_col, text_col), "statistics")
    cutoffs = calibrate(stats, labels, risk, delta)
    failed = F.expr(BASE_FAILED)
    return stats.withColumn("base_failed", failed).withColumn("kept", ~failed & ~cutoffs.rejects())
