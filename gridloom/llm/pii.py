"""Personal data: overlapping candidates, boosted trees, calibrated thresholds. SQL functions only."""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.boosting import Boosted, boost
from gridloom.llm.common import free_name
from gridloom.llm.spans import LABELLED, SPAN, apart, best_of_runs, labelled, masked, matches, written_out

#: The kinds in the order in which spans that start together are listed.
KINDS = ("email", "ip", "card", "phone")
#: Base patterns (fixed formats). Atomic forms of the plain ones: they match the
#: same and take linear time on long runs.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: High-recall generators of further candidates, overlapping ones too: (name, kind, pattern). Groups repeat possessively or a few times.
GENERATORS = (
    ("email_spelt", "email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[({]\x20?(?:at|AT|@)\x20?[\])}]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[\[({]\x20?(?:dot|DOT|\.)\x20?[\])}]\x20?)[A-Za-z0-9-]++)++"),
    ("email_words", "email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20(?:at|AT)\x20[A-Za-z0-9-]++(?:\x20(?:dot|DOT)\x20[A-Za-z0-9-]++)++"),
    ("ip_six", "ip", r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){1,7}(?::?[0-9A-Fa-f]{1,4})(?::[0-9A-Fa-f]{1,4}){0,6}(?![0-9A-Za-z:])"),
    ("ip_guarded", "ip", r"(?<![0-9.])[0-9]{1,3}(?:\x20?[\[({](?:\.|dot|DOT)[\])}]\x20?[0-9]{1,3}){3}(?![0-9.])"),
    ("card_groups", "card", r"(?<![0-9])[0-9]{4}(?:(?:[\x20./_-]{0,3}[0-9]{4}){3}|[\x20./_-]{0,3}[0-9]{6}[\x20./_-]{0,3}[0-9]{5})(?![0-9])"),
    ("phone_national", "phone", r"(?<![0-9+.-])\(?0?[0-9]{2,4}\)?(?:[\x20./-]{1,3}[0-9]{2,4}){2,4}(?![0-9]|[.-][0-9])"),
    ("phone_run", "phone", r"(?<![0-9A-Za-z+.,_-])[0-9]{9,15}(?![0-9A-Za-z_]|[.,-][0-9])"),
    ("phone_double_zero", "phone", r"(?<![0-9+])00[1-9][0-9]{0,2}[\x20./-]?\(?[0-9]{1,4}\)?(?:[\x20./-]{0,2}[0-9]{2,4}){2,4}(?![0-9])"),
)
FEATURES = ("generator", "digits", "length", "separators", "kinds_of_separator", "luhn", "top_octet", "different_digits", "before", "after", "cue", "other_cue", "letters", "groups", "first_group", "last_group", "octets", "zeros", "colons")
_CUES = {"email": "mail|contact|write|reach|send", "ip": r"\bip\b|addr|host|server|client|gateway|from", "card": "card|visa|master|credit|debit|paid|payment|charge", "phone": r"phone|\btel|call|mobile|fax|cell|dial|contact|ring|text"}
_OTHER = r"version|\bv\.|order|invoice|isbn|serial|\bid\b|\bno\b|page|total|price|section|figure|table|date|clock|release|part|score"


def digits_of(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.char_length(digits)

    def worth(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, d * 2 - 9).otherwise(d * 2))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + worth(i)) % 10 == 0


def _octets_fit(c: Column) -> Column:
    part = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
    return c.rlike(rf"^{part}\.{part}\.{part}\.{part}$")


def base_spans(text: Column) -> dict[str, Column]:
    """Valid base matches of each kind; a failing match is dropped without another try."""
    number = text.rlike("[0-9]")
    none = F.from_json(F.lit("[]"), SPAN)

    def where(ok: Column, kind: str, test) -> Column:
        found = matches(text, BASE[kind])
        return F.when(ok, found if test is None else F.filter(found, test)).otherwise(none)

    def card(s: Column) -> Column:
        d = digits_of(s["text"])
        return F.when(F.char_length(d).between(12, 19), luhn(d)).otherwise(False)

    return {
        "email": where(F.contains(text, F.lit("@")), "email", None),
        "ip": where(number, "ip", lambda s: _octets_fit(s["text"])),
        "card": where(number, "card", card),
        "phone": where(F.contains(text, F.lit("+")), "phone", lambda s: F.char_length(digits_of(s["text"])).between(9, 15)),
    }


def _features(s: Column, generator: int, kind: str) -> Column:
    t, d = s["text"], digits_of(s["text"])
    ahead = F.lower(s["left"])
    beside = lambda c: F.when(F.coalesce(c, F.lit("")) == "", 0).when(c.rlike(r"\s"), 0).when(c.rlike(r"[.,;:!?()\[\]\"'<>|]"), 1).when(c.rlike("[A-Za-z]"), 3).otherwise(2)
    seps = F.regexp_replace(t, "[0-9A-Za-z]", "")
    values = {
        "generator": F.lit(generator),
        "digits": F.char_length(d),
        "length": F.char_length(t),
        "separators": F.char_length(seps),
        "kinds_of_separator": F.size(F.array_distinct(F.split(seps, ""))),
        "luhn": F.when(F.char_length(d).between(12, 19), F.when(luhn(d), 1).otherwise(0)).otherwise(-1),
        "top_octet": F.coalesce(F.try_to_number(F.substring(d, 1, 3), F.lit("999")).cast("int"), F.lit(-1)),
        "different_digits": F.size(F.array_distinct(F.split(d, ""))),
        "before": beside(F.substring(s["left"], -1, 1)),
        "after": beside(s["right"]),
        "cue": F.when(ahead.rlike(_CUES[kind]), 1).otherwise(0),
        "other_cue": F.when(ahead.rlike(_OTHER), 1).otherwise(0),
        "letters": F.char_length(F.regexp_replace(t, "[^A-Za-z]", "")),
        "groups": F.size(F.regexp_extract_all(t, F.lit("[0-9]+"), F.lit(0))),
        "first_group": F.char_length(F.regexp_extract(t, "[0-9]+", 0)),
        "last_group": F.char_length(F.regexp_extract(t, "([0-9]+)[^0-9]*$", 1)),
        "zeros": F.when(d.startswith("00"), 2).when(d.startswith("0"), 1).otherwise(0),
        "colons": F.char_length(t) - F.char_length(F.replace(t, F.lit(":"), F.lit(""))),
        "octets": F.when(_octets_fit(F.regexp_replace(t, "[^0-9]+", ".")), 1).otherwise(0),
    }
    return F.struct(*[values[n].cast("double").alias(n) for n in FEATURES])


def candidates(text: Column) -> Column:
    """Generated candidates, overlapping ones too: start, rank, end, kind and features ``x``."""
    number = text.rlike("[0-9]")
    none = F.from_json(F.lit("[]"), SPAN)
    ready = {"email_spelt": text.rlike(r"[\[({]"), "email_words": F.contains(text, F.lit(" dot ")) | F.contains(text, F.lit(" DOT ")), "ip_six": F.contains(text, F.lit(":")) & text.rlike("[0-9A-Fa-f]:")}
    parts = []

    def lettered(g: int, kind: str):
        return lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), _features(s, g, kind).alias("x"))

    for g, (name, kind, pattern) in enumerate(GENERATORS):
        parts.append(F.transform(F.when(ready.get(name, number), matches(text, pattern)).otherwise(none), lettered(g, kind)))
    return F.concat(*parts)


#: Characters of context that an example keeps on each side.
CONTEXT = 40


def corpus_examples(rows: DataFrame, most: int) -> list[tuple[str, str, str, str]]:
    """(kind, before, value, after) of base spans, and of numbers that are surely none (kind ""), in at most ``most`` texts of ``rows``.

    The texts are those of the least hashes among all that hold a digit or an
    at sign, so the sample does not depend on how rows are dealt or how often
    a text is there. Hashes alone are shuffled to find the largest of them;
    then each task sends one text a hash up to that one. At most four spans
    and four numbers of a text, and 10 * ``most`` rows, reach the driver.
    """
    held = rows.where(F.col("text").rlike("[0-9@]")).select(F.xxhash64("text").alias("h"), "text")
    last = held.select("h").distinct().orderBy("h").limit(most).agg(F.max("h")).first()[0]
    some = held.where(F.col("h") <= F.lit(last)).groupBy("h").agg(F.min("text").alias("text"))
    found = base_spans(F.col("text"))
    named = lambda c, kind: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind")))
    base = F.concat(*[named(found[k], k) for k in KINDS])
    four = lambda c: F.slice(F.sort_array(F.transform(c, lambda s: F.struct(F.xxhash64(s["start"], s["end"]).alias("h"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))), 1, 4)
    numbers = matches(F.col("text"), r"(?<![A-Za-z0-9])(?<![0-9][^0-9]{0,4})[0-9](?:[\x20().:/_-]{0,2}[0-9]){2,18}(?![A-Za-z]|[^0-9]{0,4}[0-9])")
    # numbers too short for personal data, or long ones that fail the check: others may be personal data written otherwise
    digits = lambda s: digits_of(s["text"])
    wrong = F.filter(numbers, lambda s: F.when(F.char_length(digits(s)).between(12, 19), ~luhn(digits(s))).otherwise(F.char_length(digits(s)) < 7))
    spans, others = four(base), four(apart(named(wrong, ""), base))
    s = F.col("s")
    chars = lambda a, n: F.array_join(F.slice("chars", (a + 1).cast("int"), n.cast("int")), "")
    low = F.greatest(s["start"] - CONTEXT, F.lit(0))
    rows = some.select(F.split("text", "").alias("chars"), F.explode(F.concat(spans, others)).alias("s"))
    rows = rows.select(s["kind"].alias("kind"), chars(low, s["start"] - low).alias("a"), chars(s["start"], s["end"] - s["start"]).alias("v"), chars(s["end"], F.lit(CONTEXT)).alias("b"))
    return sorted(map(tuple, rows.collect()))


def _recast(kind: str, value: str, rng: random.Random) -> str:
    """A base match as it may be written without the marks that the base pattern asks for."""
    d = re.sub("[^0-9]", "", value)
    if kind == "email":
        name, host = value.split("@")
        a, b = rng.choice([("[", "]"), ("(", ")"), ("{", "}"), (" ", " ")])
        if a == " ":
            return f"{name} at {host.replace('.', ' dot ')}"
        return f"{name} {a}at{b} {host.replace('.', f' {a}dot{b} ') if rng.random() < 0.6 else host}"
    if kind == "ip":
        if rng.random() < 0.5:
            a, b = rng.choice([("[", "]"), ("(", ")")])
            return value.replace(".", f"{a}.{b}")
        part = lambda: f"{rng.randint(0, 65535):{rng.choice(['x', 'x', '04x', 'X'])}}"
        if rng.random() < 0.4:
            return f"{rng.choice(['fe80', '2001:db8', 'fd00', part()])}::{':'.join(part() for _ in range(rng.randint(1, 4)))}"
        return ":".join(rng.choice([part(), part(), part(), "0", "0000"]) for _ in range(8))
    if kind == "card":
        sep = rng.choice([".", "/", " - ", " / ", "  ", " ", "-", "_", ""])
        return sep.join([d[:4], d[4:10], d[10:]] if len(d) == 15 else [d[i : i + 4] for i in range(0, len(d), 4)])
    d = d[-10:] if len(d) >= 10 else d
    sep, form = rng.choice(" -."), rng.random()
    if form < 0.4:
        return f"({d[:3]}) {d[3:6]}{sep}{d[6:]}" if rng.random() < 0.4 else sep.join([d[:3], d[3:6], d[6:]])
    if form < 0.5:
        return d
    if form < 0.7:
        return f"0{d[:2]}{rng.choice(' -/')}{d[2:6]} {d[6:]}"
    cuts = rng.choice([(3, 6), (2, 6), (3, 5), (2, 5), (4, 7)])
    gap = rng.choice([" ", " ", "-", ".", "/"])
    return f"00{rng.randint(1, 99)}{gap}{gap.join([d[: cuts[0]], d[cuts[0] : cuts[1]], d[cuts[1] :]])}"


def _spoilt(value: str, rng: random.Random) -> str:
    """A number in a shape like those of personal data that is none."""
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    first = rng.randint(0, 50)
    return rng.choice(
        [
            value,
            value,
            f"{digits(4)}-{rng.randint(10, 12)}-{rng.randint(10, 28)} {rng.randint(10, 23)}:{digits(2)}:{digits(2)}",
            ":".join(digits(2) for _ in range(rng.randint(2, 8))),
            ":".join(f"{rng.randint(0, 255):02x}" for _ in range(rng.choice([2, 3, 6, 8]))),
            ":".join(word for word in rng.sample(["bad", "dead", "beef", "cafe", "face", "add", "ad", "be", "fade"], 2)),
            rng.choice(" -./").join(digits(4) for _ in range(4)),
            rng.choice(" -").join(f"{first + k:04d}" for k in range(4)),
            f"{digits(3)}[.]{rng.randint(256, 999)}[.]{digits(2)}[.]{rng.randint(256, 999)}",
            digits(rng.randint(9, 15)),
            f"{digits(3)} {digits(3)} {digits(3)}",
            "look at the dot on",
            f"{digits(3)}-{digits(2)}-{digits(5)}-{digits(2)}",
            f"00{rng.randint(1, 9)}.{digits(2)}.{digits(2)}.{digits(2)}",
        ]
    )


def training_texts(n: int, examples: list[tuple[str, str, str, str]], seed: int = 0) -> list[tuple[str, int, int, int]]:
    """``n`` short texts with one marked span each: (text, start, end, whether it is personal data).

    Up to half of them (less if there are few examples) stand in contexts of
    the corpus, with its base matches recast as positives and its other numbers
    as negatives; the rest are made up.
    """
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 9)))
    by = {k: [e for e in examples if e[0] == k] for k in (*KINDS, "")}
    cues = {"email": ["mail ", "contact ", "write to ", ""], "ip": ["host ", "server ", "from ip ", ""], "card": ["card ", "visa ", "paid with ", ""], "phone": ["phone ", "call ", "tel ", "mobile ", "fax: "]}
    other = ["order ", "invoice ", "id ", "page ", "serial ", "version ", "total ", "isbn ", "on ", ""]

    def valid_card() -> str:
        d = rng.choice("3456") + digits(14)
        odd = sum((2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(d)))
        return d + str(-odd % 10)

    def made(kind: str) -> str:
        return {
            "email": lambda: f"{word()}{rng.choice(['.', '_', ''])}{word()}@{word()}.{rng.choice(['com', 'org', 'net', 'de', 'co.uk'])}",
            "ip": lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
            "card": valid_card,
            "phone": lambda: f"+1{rng.randint(2, 9)}{digits(9)}",
        }[kind]()

    out = []
    for _ in range(n):
        real, kind = rng.random() < 0.5, rng.choice(KINDS)
        pool = by[kind] if real else by[""]
        e = rng.choice(pool) if rng.random() < min(0.5, len(pool) / 400) else None
        if real:
            value = _recast(kind, e[2] if e else made(kind), rng)
            cue = rng.choice(cues[kind])
        else:
            value = _spoilt(e[2] if e else digits(rng.randint(3, 12)), rng)
            cue = rng.choice(other)
        before, after = (e[1], e[3]) if e else (f"{word()} {word()} {cue}", f"{rng.choice([' ', '. ', ', ', ' '])}{word()}")
        out.append((f"{before}{value}{after}", len(before), len(before) + len(value), int(real)))
    return out


def trained(rows: DataFrame, texts: int = 3000, examples: int = 12_000, precision: float = 0.99) -> tuple[Boosted, tuple[float, ...]]:
    """The trees and the threshold of each generator, for the texts of ``rows`` (column ``text``).

    ``texts`` bounds the sample of the corpus (see :func:`corpus_examples`), and
    ``examples`` the texts made from it, two thirds for the trees and one third
    for the thresholds: the least margin above which the share of personal data
    is ``precision`` (a probability of one half at least). No threshold: never.
    """
    spark = rows.sparkSession
    made = training_texts(examples, corpus_examples(rows, texts))
    df = spark.createDataFrame([(i, t, s, e, y) for i, (t, s, e, y) in enumerate(made)], "i int, text string, s bigint, e bigint, y int")
    c = F.col("c")
    # candidates that lie elsewhere in a context are not judged; parts of the marked span count as wrong
    on = (c["start"] < F.col("e")) & (c["end"] > F.col("s"))
    y = F.col("y") * ((c["start"] == F.col("s")) & (c["end"] == F.col("e"))).cast("int")
    found = df.select("i", "s", "e", "y", F.explode(candidates(F.col("text"))).alias("c")).where(on).select("i", y.alias("y"), "c.x").collect()
    found.sort(key=lambda r: (r["i"], tuple(r["x"])))
    never = tuple(float("inf") for _ in GENERATORS)
    if not found:
        return boost(np.zeros((0, len(FEATURES))), np.zeros(0), FEATURES, rounds=0), never
    x = np.array([list(r["x"]) for r in found])
    y = np.array([r["y"] for r in found], dtype=float)
    held = np.array([r["i"] % 3 == 0 for r in found])
    model = boost(x[~held], y[~held], FEATURES, rounds=60, depth=4, rate=0.3)
    margin, cuts = model.predict(x[held]), []
    for g in range(len(GENERATORS)):
        mine = x[held][:, 0] == g
        m, t = margin[mine], y[held][mine]
        order = np.argsort(-m)
        share = np.cumsum(t[order]) / np.arange(1, len(order) + 1)
        fine = np.flatnonzero((share >= precision) & (np.append(m[order][1:], -np.inf) < m[order]))
        cuts.append(max(0.0, float(m[order][fine[-1]])) if len(fine) and fine[-1] >= 19 else float("inf"))
    return model, tuple(cuts)


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, base (spans of the base patterns), spans (those and more).

    Spans are structs start, rank, end, kind (code points, end exclusive).
    Base spans always stay. A generated candidate may join them if its margin
    reaches its generator's threshold and it overlaps no base span; of each run
    of overlapping candidates the best one does (of equals, the first). One row
    for each input row, repeated rows included; a null text is empty; null ids
    pass through; other columns are ignored; an empty table gives no rows. No
    row is shuffled; time per text grows with its length and not with the
    square of its candidates.
    """
    rows = df.select(df[id_col].alias("doc_id"), F.coalesce(df[text_col], F.lit("")).alias("text"))
    model, cuts = trained(rows)
    likely = F.col("text").rlike(r"[0-9@\[({]| (?:dot|DOT) |[A-Fa-f]:")
    found = base_spans(F.col("text"))
    none = F.from_json(F.lit("[]"), LABELLED)
    base = F.sort_array(F.concat(none, *[labelled(found[k], k, i) for i, k in enumerate(KINDS)]))
    # texts without a digit, an at sign, an opening bracket or the like take no part in what follows
    bare = rows.where(~likely).select("doc_id", "text", none.alias("base"), none.alias("spans"))
    rows = rows.where(likely).withColumn("base", base)

    def judged(c: Column) -> Column:
        score = model.margin(lambda n: c["x"][n])
        limit = F.get(F.array(*map(F.lit, cuts)), c["x"]["generator"].cast("int"))
        return F.struct(c["start"].alias("start"), c["rank"].alias("rank"), c["end"].alias("end"), c["kind"].alias("kind"), score.alias("score"), (score >= limit).alias("ok"))

    plain = lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))
    fine = rows.select("doc_id", "text", "base", F.filter(F.transform(candidates(F.col("text")), judged), lambda a: a["ok"]).alias("fine"))
    more = F.transform(best_of_runs(apart(F.col("fine"), F.col("base"))), plain)
    return bare.unionByName(fine.select("doc_id", "text", "base", F.sort_array(F.concat("base", more)).alias("spans")))


def redact_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, redacted: each found span replaced by its kind in brackets."""
    return find_pii(df, id_col, text_col).select("doc_id", masked(F.col("text"), F.col("spans")).alias("redacted"))


def redact_rows(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` with personal data in ``text_col`` replaced by its kind in brackets.

    All other columns stay as they are, whatever their names; null texts become
    empty; null ids and repeated rows stay; an empty table gives no rows.
    """
    row = free_name(df, "row")
    found = find_pii(df.withColumn(row, F.struct(*[df[c] for c in df.columns])), row, text_col)
    clean = masked(F.col("text"), F.col("spans"))
    return found.select(*[clean.alias(c) if c == text_col else F.col(f"doc_id.`{c}`").alias(c) for c in df.columns])


def pii_digests(found: DataFrame) -> DataFrame:
    """Counts of base spans by kind, a digest of them, and all spans written out."""
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return found.select("doc_id", *map(n, KINDS), F.sha2(written_out(F.col("base")), 256).alias("base_sha256"), written_out(F.col("spans")).alias("spans"))
