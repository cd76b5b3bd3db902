"""Regular-expression matches with code-point offsets, in SQL functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.llm.common import let, prefix_max, prefix_sums

SPAN = "array<struct<start:bigint,end:bigint,text:string,inner:string,left:string,right:string>>"
LABELLED = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"


def matches(text: Column, pattern: str, inner: int = 0) -> Column:
    """All leftmost non-overlapping matches: start, end (code points, end exclusive), text, group ``inner``, and what is beside.

    ``left`` has up to 30 characters before the match and ``right`` one after
    it, neither beyond the matches before and after. Splitting by the pattern gives the text between the matches; running sums
    of both lengths give offsets, in time that does not grow with the square
    of the number of matches.
    """
    p = F.lit(pattern)

    def spans(found: Column) -> Column:
        between = F.split(text, pattern, -1)
        groups = found if inner == 0 else F.regexp_extract_all(text, p, F.lit(inner))

        def with_ends(ends: Column, groups: Column, b: Column) -> Column:
            return F.transform(
                found,
                lambda x, i: F.struct(
                    (F.get(ends, i) - F.char_length(x)).alias("start"),
                    F.get(ends, i).alias("end"),
                    x.alias("text"),
                    F.get(groups, i).alias("inner"),
                    F.substring(F.get(b, i), -30, 30).alias("left"),
                    F.substring(F.get(b, i + 1), 1, 1).alias("right"),
                ),
            )

        steps = lambda b: F.transform(found, lambda x, i: (F.char_length(F.get(b, i)) + F.char_length(x)).cast("bigint"))
        return let(between, lambda b: let(groups, lambda g: let(prefix_sums(steps(b)), lambda e: with_ends(e, g, b))))

    empty = F.from_json(F.lit("[]"), SPAN)
    return let(F.regexp_extract_all(text, p, F.lit(0)), lambda found: F.when(F.size(found) == 0, empty).otherwise(spans(found)))


def labelled(spans: Column, kind: str, rank: int) -> Column:
    """Spans as (start, rank, end, kind), which sort by start and then kind."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def written_out(spans: Column) -> Column:
    """kind:start:end of sorted labelled spans, joined by commas."""
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def outside(spans: Column, others: Column) -> Column:
    """The labelled ``spans`` that lie within none of ``others``, in one sweep over both by start."""
    tag = lambda s, k: F.struct(s["start"].alias("start"), F.lit(k).alias("k"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))
    events = F.sort_array(F.concat(F.transform(others, lambda s: tag(s, 0)), F.transform(spans, lambda s: tag(s, 1))))

    def swept(e: Column) -> Column:
        ends = prefix_max(F.transform(e, lambda x: F.when(x["k"] == 0, x["end"]).otherwise(-1)))
        return let(ends, lambda far: F.filter(e, lambda x, i: (x["k"] == 1) & (F.get(far, i) < x["end"])))

    plain = lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))
    return F.when(F.size(others) == 0, spans).otherwise(F.transform(let(events, swept), plain))


def apart(spans: Column, others: Column) -> Column:
    """The structs ``spans`` (with start and end) that overlap none of ``others``, in one sweep.

    Of the others that start before a span's end, the furthest end decides.
    """
    events = F.sort_array(
        F.concat(
            F.transform(spans, lambda s, i: F.struct(s["end"].alias("at"), F.lit(0).alias("k"), s["start"].alias("x"), i.alias("i"))),
            F.transform(others, lambda s: F.struct(s["start"].alias("at"), F.lit(1).alias("k"), s["end"].alias("x"), F.lit(-1).alias("i"))),
        )
    )

    def swept(e: Column) -> Column:
        ends = prefix_max(F.transform(e, lambda x: F.when(x["k"] == 1, x["x"]).otherwise(-1)))
        fine = let(ends, lambda far: F.filter(e, lambda x, i: (x["k"] == 0) & (F.get(far, i) <= x["x"])))
        return F.transform(fine, lambda x: F.get(spans, x["i"]))

    return F.when((F.size(others) == 0) | (F.size(spans) == 0), spans).otherwise(let(events, swept))


def best_of_runs(spans: Column) -> Column:
    """Of each run of overlapping ``spans`` (structs with start, rank, end and score) the one of the best score; of equals the first."""

    def runs(s: Column) -> Column:
        far = prefix_max(F.transform(s, lambda x: x["end"]))
        heads = let(far, lambda f: F.transform(s, lambda x, i: F.when((i > 0) & (x["start"] < F.coalesce(F.get(f, i - 1), F.lit(0))), 0).otherwise(1).cast("bigint")))
        ranked = let(prefix_sums(heads), lambda run: F.sort_array(F.transform(s, lambda x, i: F.struct(F.get(run, i).alias("run"), (-x["score"]).alias("worse"), i.alias("i")))))
        return let(ranked, lambda r: F.transform(F.filter(r, lambda x, i: (i == 0) | (x["run"] != F.get(r, i - 1)["run"])), lambda x: F.get(s, x["i"])))

    return F.when(F.size(spans) < 2, spans).otherwise(let(F.sort_array(spans), runs))


def masked(text: Column, spans: Column) -> Column:
    """``text`` with each span, or run of overlapping spans, replaced by its first kind in brackets.

    The text is cut from an array of its characters, as finding a place in a
    string takes time with its distance from the start.
    """

    def build(s: Column, chars: Column) -> Column:
        furthest = prefix_max(F.transform(s, lambda x: x["end"]))
        some = lambda a, n: F.array_join(F.slice(chars, (a + 1).cast("int"), n.cast("int")), "")

        def cut(e: Column) -> Column:
            before = lambda i: F.coalesce(F.get(e, i - 1), F.lit(0).cast("bigint"))
            parts = F.transform(
                s,
                lambda x, i: F.when((i == 0) | (x["start"] >= before(i)), F.concat(some(before(i), x["start"] - before(i)), F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise(F.lit("")),
            )
            last = F.get(e, F.size(e) - 1)
            return F.concat(F.array_join(parts, ""), some(last, F.size(chars) - last))

        return let(furthest, cut)

    return F.when(F.size(spans) == 0, text).otherwise(let(F.sort_array(spans), lambda s: let(F.split(text, ""), lambda c: build(s, c))))
