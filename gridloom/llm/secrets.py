"""Secret scans through a trigram index. SQL functions only."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import let, written
from gridloom.llm.patterns import Node, loops_over_a_group, parse
from gridloom.llm.spans import LABELLED, SPAN, labelled, masked, matches, outside, written_out

#: Above so many candidate texts, they are found by a shuffle and not a broadcast.
BROADCAST_ROWS = 500_000


@dataclass(frozen=True)
class Rule:
    """A pattern that Java and Python read alike. ``least`` bounds the length of group ``inner`` (0: the match).

    A pattern that loops over a group is refused: Java's engine recurses there,
    and one long text would end the executor. Loop over a class, or possessively.
    """

    kind: str
    pattern: str
    inner: int = 0
    least: int = 1
    base: bool = False

    def __post_init__(self) -> None:
        if loops_over_a_group(parse(self.pattern)):
            raise ValueError(f"the pattern of {self.kind} repeats a group without bound")


#: Base rules in the order in which spans that start together are listed, then further ones (fixed formats).
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
    Rule("github", r"\bgh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"\bxox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", r"\bAIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"\b(?:sk|rk)_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)

#: A query is a list of groups that must all hold; a group holds if one of its
#: branches has all its trigrams in the text (in lower case).
Query = list[list[frozenset[str]]]


def trigrams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def trigram_query(pattern: str, most: int = 64) -> Query:
    """The Boolean trigram query that every match of ``pattern`` satisfies; [] where there is none.

    Strings that a piece of the pattern must equal are multiplied along
    sequences and added over alternatives while there are at most ``most``;
    where they end, they become a group.
    """

    def closed(strings: set[str]) -> Query:
        branches = sorted({trigrams(s) for s in strings}, key=lambda b: (len(b), sorted(b)))
        least = [b for k, b in enumerate(branches) if not any(a <= b for a in branches[:k])]
        return [least] if least and all(least) else []

    def sequence(nodes: list[Node]) -> tuple[set[str] | None, Query]:
        exact: set[str] = {""}
        query: Query = []
        whole = True
        for node in nodes:
            some, more = one(node)
            if some is not None and len(exact) * len(some) <= most:
                exact = {a + b for a, b in product(exact, some)}
                continue
            whole = False
            query += closed(exact) + more
            exact = some if some is not None else {""}
        return (exact, []) if whole else (None, query + closed(exact))

    def one(node: Node) -> tuple[set[str] | None, Query]:
        if node.kind == "chars":
            low = {c.lower() for c in node.chars or ()}
            return (low, []) if low and len(low) <= most else (None, [])
        if node.kind == "sequence":
            return sequence(node.parts)
        if node.kind == "any of":
            found = [one(x) for x in node.parts]
            if all(e is not None for e, _ in found):
                return set().union(*(e for e, _ in found)), []
            # any branch may match: one group of each branch's first group, if all have one
            groups = [closed(e) if e is not None else q for e, q in found]
            return None, [[b for g in groups for b in g[0]]] if all(groups) else []
        some, more = one(node.parts[0])  # a repetition
        if some is not None and node.high is not None and node.high <= 8 and len(some) ** max(1, node.high) <= most:
            return {"".join(p) for k in range(node.low, node.high + 1) for p in product(sorted(some), repeat=k)}, []
        return None, (closed(some) if some is not None else more) if node.low else []

    exact, query = one(parse(pattern))
    return closed(exact) if exact is not None else query


def postings(rows: DataFrame, wanted: list[str]) -> DataFrame:
    """The index: (trigram, row_key) of the wanted trigrams, by trigram. Keys that collide only add candidates."""
    found = let(F.lower("text"), lambda low: F.filter(F.array(*map(F.lit, wanted)), lambda t: F.contains(low, t)))
    # the outer form: the plain one tests the array's size first, which would make it twice
    present = rows.select(F.explode_outer(found).alias("trigram"), "row_key").where("trigram IS NOT NULL")
    return written(present, "postings")


def trigram_candidates(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """row_key, rules (kinds that may match), from the intersected postings of each rule's query."""
    spark = rows.sparkSession
    terms, groups = [], []
    for r in rules:
        query = trigram_query(r.pattern)
        groups.append((r.kind, len(query)))
        terms += [(r.kind, g, b, t, len(branch)) for g, group in enumerate(query) for b, branch in enumerate(group) for t in sorted(branch)]
    index = postings(rows, sorted({t[3] for t in terms}))
    asked = F.broadcast(spark.createDataFrame(terms, "kind string, g int, b int, trigram string, need long"))
    counts = F.broadcast(spark.createDataFrame(groups, "kind string, groups long"))
    met = index.join(asked, "trigram").groupBy("row_key", "kind", "g", "b").agg(F.countDistinct("trigram").alias("have"), F.first("need").alias("need"))
    held = met.where("have = need").groupBy("row_key", "kind").agg(F.countDistinct("g").alias("held"))
    return held.join(counts, "kind").where("held = groups").groupBy("row_key").agg(F.collect_set("kind").alias("kinds"))


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, text, base (spans of base rules), spans (of all rules).

    Spans are structs start, rank, end, kind (code points, end exclusive),
    sorted; spans of further rules that lie within a base span are left out.
    Rules with mandatory trigrams are verified only on texts whose postings
    hold them; the others scan every text. One row for each input row, repeated
    rows included; a null text is empty; null ids pass through; other columns
    are ignored; an empty table gives no rows. Time per text grows with its
    length and not with the square of its matches.
    """
    rows = df.select(df[id_col].alias("doc_id"), F.coalesce(df[text_col], F.lit("")).alias("text"))
    rows = rows.withColumn("row_key", F.xxhash64("doc_id", "text"))
    indexed = tuple(r for r in rules if trigram_query(r.pattern))
    found = written(trigram_candidates(rows, indexed), "candidates")
    few = found.count() <= BROADCAST_ROWS
    both = rows.join(F.broadcast(found) if few else found, "row_key", "left")
    none = F.from_json(F.lit("[]"), SPAN)
    likely = F.col("kinds").isNotNull()
    for r in rules:
        if r not in indexed:
            likely = likely | F.col("text").rlike(r.pattern)

    def spans(r: Rule) -> Column:
        got = matches(F.col("text"), r.pattern, r.inner)
        if r.least > 1:
            got = F.filter(got, lambda s: F.char_length(s["inner"]) >= r.least)
        may = F.array_contains("kinds", r.kind) if r in indexed else F.col("text").rlike(r.pattern)
        return F.when(may, got).otherwise(none)

    # texts without a candidate take no part in what follows
    nothing = F.from_json(F.lit("[]"), LABELLED)
    plain = both.where(~likely).select("doc_id", "text", nothing.alias("base"), nothing.alias("spans"))
    ranked = list(enumerate(rules))
    base = F.sort_array(F.concat(nothing, *[labelled(spans(r), r.kind, i) for i, r in ranked if r.base]))
    more = F.concat(nothing, *[labelled(spans(r), r.kind, i) for i, r in ranked if not r.base])
    found = both.where(likely).select("doc_id", "text", base.alias("base"), more.alias("more"))
    return plain.unionByName(found.select("doc_id", "text", "base", F.sort_array(F.concat("base", outside(F.col("more"), F.col("base")))).alias("spans")))


def redact_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, redacted: each found span replaced by its kind in brackets."""
    return find_secrets(df, id_col, text_col).select("doc_id", masked(F.col("text"), F.col("spans")).alias("redacted"))


def secret_digests(found: DataFrame) -> DataFrame:
    """Counts of base spans by kind, a digest of them, and all spans written out."""
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    kinds = [r.kind for r in RULES if r.base]
    return found.select("doc_id", *map(n, kinds), F.sha2(written_out(F.col("base")), 256).alias("base_sha256"), written_out(F.col("spans")).alias("spans"))
