"""Canonical exact digests of documents. SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import written

#: Above so many buckets of equal hashes, their texts are joined by a shuffle.
BROADCAST_ROWS = 500_000
LOWEST = -(1 << 63)


def canonical(text: Column) -> Column:
    """NFKC, full case folding, NFKC again; runs of white space become one space, none at the ends."""
    for_icu = lambda c, f, *more: F.call_function("java_method", F.lit(f"com.ibm.icu.{f[0]}"), F.lit(f[1]), c, *more)
    normal = lambda c: for_icu(c, ("text.Normalizer", "compose"), F.lit(True))
    folded = normal(for_icu(normal(F.coalesce(text, F.lit(""))), ("lang.UCharacter", "foldCase"), F.lit(True)))
    return F.btrim(F.regexp_replace(folded, r"[\s\x85\p{Z}]+", " "))


def wide_hash(canon: Column) -> tuple[Column, Column]:
    """128 bits of xxhash, as two columns."""
    return F.xxhash64(canon), F.xxhash64(F.lit(11), canon)


def _hex(h1: Column, h2: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(h1), 16, "0"), F.lpad(F.hex(h2), 16, "0")))


def repeated(hashes: DataFrame) -> DataFrame:
    """(h1, h2) of more than one row of ``hashes``, marked for a broadcast if they are few."""
    counts = written(hashes.select("h1", "h2").groupBy("h1", "h2").count().where("count > 1").select("h1", "h2"), "buckets")
    return F.broadcast(counts) if counts.count() <= BROADCAST_ROWS else counts


def differing(texts: DataFrame) -> DataFrame | None:
    """(h1, h2) of the buckets of ``texts`` (h1, h2, canon) whose canonical texts differ in their bytes; None if there are none.

    Equal texts of a task move once: the partial aggregate groups by their bytes.
    """
    kinds = texts.groupBy("h1", "h2", "canon").agg(F.lit(1).alias("one"))
    found = written(kinds.groupBy("h1", "h2").count().where("count > 1").select("h1", "h2"), "collisions")
    return None if found.isEmpty() else found


def colliding(rows: DataFrame) -> DataFrame | None:
    """(h1, h2) of buckets of ``rows`` (text, h1, h2) whose canonical texts differ; None if there are none.

    Buckets of one row need no comparison, so only the texts of repeated hashes move.
    """
    # the canonical text is taken before the join, so that it is made once a row
    return differing(rows.join(repeated(rows), ["h1", "h2"], "left_semi").select("h1", "h2", canonical(F.col("text")).alias("canon")))


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Small table of doc_id, h1, h2: the hashes of each row's canonical text."""
    rows = df.select(df[id_col].alias("doc_id"), canonical(df[text_col]).alias("canon"))
    h1, h2 = wide_hash(F.col("canon"))
    return rows.select("doc_id", h1.alias("h1"), h2.alias("h2"))


def named(rows: DataFrame, h1: str, h2: str, text: Column, out: str, clash: DataFrame | None) -> DataFrame:
    """Adds the fingerprint ``out``: the hash in hexadecimal; in buckets whose texts differ, a SHA-256 of the text's bytes tells them apart."""
    if clash is None:
        return rows.withColumn(out, _hex(F.col(h1), F.col(h2)))
    met = rows.join(clash.select(F.col("h1").alias(h1), F.col("h2").alias(h2), F.lit(True).alias("_met")), [h1, h2], "left")
    tail = F.when(F.col("_met"), F.concat(F.lit("-"), F.sha2(canonical(text), 256))).otherwise("")
    return met.withColumn(out, F.concat(_hex(F.col(h1), F.col(h2)), tail)).drop("_met")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint of each row.

    Two rows have equal fingerprints exactly if their canonical texts are
    equal: texts meet by a 128-bit hash and, within a bucket of equal hashes,
    by their bytes. A null text is empty and equals one of white space; null
    ids pass through; repeated rows give repeated results; other columns are
    ignored; an empty table gives no rows.
    """
    rows = df.select(df[id_col].alias("doc_id"), F.coalesce(df[text_col], F.lit("")).alias("text"), canonical(df[text_col]).alias("canon"))
    h1, h2 = wide_hash(F.col("canon"))
    rows = rows.select("doc_id", "text", h1.alias("h1"), h2.alias("h2"))
    return named(rows, "h1", "h2", F.col("text"), "fingerprint", colliding(rows)).select("doc_id", "fingerprint")


def with_next(rows: DataFrame, order: str, columns: list[str], ties: list[str]) -> DataFrame:
    """Adds struct ``next`` of ``columns`` of the row that follows by ``order`` (then ``ties``); the first follows the last.

    Rows are dealt into quantile ranges of ``order``, about one a task, and each
    range is one window group; the first rows of a range also go, as ghosts, to
    the end of the range before. The driver holds one number a range.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col(order).cast("bigint"), F.lit(LOWEST))
    keyed = rows.withColumn("_key", key)
    bounds = keyed.agg(F.percentile_approx("_key", [k / n for k in range(1, n)], 10_000)).first()[0] or []
    bounds = sorted(set(bounds))
    # binary search: the number of bounds at or below the key
    steps = F.array(*[F.lit(1 << k) for k in range(len(bounds).bit_length() - 1, -1, -1)])
    limits = F.array(*[F.lit(b).cast("bigint") for b in bounds]) if bounds else F.array().cast("array<bigint>")
    bucket = F.aggregate(steps, F.lit(0), lambda at, s: at + F.when(F.coalesce(F.get(limits, at + s - 1) <= F.col("_key"), F.lit(False)), s).otherwise(0))
    keyed = keyed.withColumn("_bucket", bucket)
    heads = sorted((r["_bucket"], r["low"]) for r in keyed.groupBy("_bucket").agg(F.min("_key").alias("low")).collect())
    low, before = [None] * (len(bounds) + 1), [0] * (len(bounds) + 1)
    for k, (b, least) in enumerate(heads):
        low[b], before[b] = least, heads[k - 1][0]
    lows = F.array(*[F.lit(x).cast("bigint") for x in low])
    own = F.struct(F.col("_bucket").alias("b"), F.lit(0).alias("ghost"))
    ahead = F.struct(F.get(F.array(*map(F.lit, before)), F.col("_bucket")).alias("b"), F.lit(1).alias("ghost"))
    spread = keyed.withColumn("_at", F.explode(F.when(F.col("_key") == F.get(lows, F.col("_bucket")), F.array(own, ahead)).otherwise(F.array(own))))
    placed = spread.withColumns({"_r": F.col("_at.b"), "_g": F.col("_at.ghost")}).drop("_at", "_bucket").repartitionByRange(n, "_r")
    w = Window.partitionBy("_r").orderBy("_g", "_key", *ties)
    return placed.withColumn("next", F.lead(F.struct(*columns)).over(w)).where("_g = 0").drop("_r", "_g", "_key")


def _hashed(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, text) with h1, h2 of their canonical texts."""
    h1, h2 = wide_hash(F.col("canon"))
    return rows.withColumn("canon", canonical(F.col("text"))).select("doc_id", "text", h1.alias("h1"), h2.alias("h2"))


def _with_edited(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, text and others) with the struct ``next`` of the row that follows, n_chars and the edited text."""
    both = with_next(rows, "doc_id", rows.columns, ["text"]).withColumn("n_chars", F.char_length("text").cast("bigint"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    return both.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next.text", F.lit(1), half)))


def _edited_hashed(rows: DataFrame) -> DataFrame:
    """:func:`_with_edited` with e1, e2 of the edited text's canonical form, which stays as ``canon``."""
    e1, e2 = wide_hash(F.col("canon"))
    return _with_edited(rows).withColumn("canon", canonical(F.col("edited"))).withColumns({"e1": e1, "e2": e2})


def _clashes(rows: DataFrame, hashes: DataFrame) -> DataFrame | None:
    """Buckets of ``hashes`` (of ``rows`` and of their edited texts) whose texts differ in their bytes; None if there are none.

    Of the edited texts only those of repeated hashes are made again: their
    rows and the rows that follow these are taken by their ids, so each still
    meets its own successor.
    """
    many = repeated(hashes.select("h1", "h2").unionByName(hashes.select(F.col("e1").alias("h1"), F.col("e2").alias("h2"))))
    met = hashes.join(many, (hashes["e1"] == many["h1"]) & (hashes["e2"] == many["h2"]), "left_semi")
    wanted = written(met.select(F.explode(F.array("doc_id", "next_id")).alias("_wanted")).distinct(), "wanted")
    few = wanted.count() <= BROADCAST_ROWS
    some = rows.join(F.broadcast(wanted) if few else wanted, rows["doc_id"].eqNullSafe(F.col("_wanted")), "left_semi")
    own = _hashed(rows).join(many, ["h1", "h2"], "left_semi").select("h1", "h2", canonical(F.col("text")).alias("canon"))
    edited = _edited_hashed(some).select(F.col("e1").alias("h1"), F.col("e2").alias("h2"), "canon").join(many, ["h1", "h2"], "left_semi")
    return differing(own.unionByName(edited))


def edited_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text, and of the text with its latter half exchanged.

    The last floor(n_chars / 2) code points give way to the first as many (or
    all) of the next document's by ascending id; after the last comes the
    first. Fingerprints of texts and of edited texts are equal exactly if the
    canonical texts are: their bytes are compared wherever hashes are equal.
    Likeness is 1 if the canonical texts are equal, else 0. Rows with
    equal ids follow one another by text; a null id comes before all others.
    """
    rows = df.select(df[id_col].cast("bigint").alias("doc_id"), F.coalesce(df[text_col], F.lit("")).alias("text"))
    # each text is folded once, before it moves; the row before gets its hashes with it
    both = _edited_hashed(_hashed(rows)).drop("canon").withColumns({"next_id": F.col("next.doc_id"), "n1": F.col("next.h1"), "n2": F.col("next.h2")})
    fixed = ["doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256")]
    hashes = written(both.select(*fixed, "next_id", "h1", "h2", "e1", "e2", "n1", "n2"), "hashes")
    clash = _clashes(rows, hashes)
    edited_equal, next_equal = ((F.col("h1") == F.col(f"{x}1")) & (F.col("h2") == F.col(f"{x}2")) for x in "en")
    if clash is None:  # equal hashes are equal texts
        done = hashes.withColumns({"fingerprint": _hex(F.col("h1"), F.col("h2")), "edited_fingerprint": _hex(F.col("e1"), F.col("e2"))})
    else:
        edited_equal &= canonical(F.col("text")) == canonical(F.col("edited"))
        next_equal &= canonical(F.col("text")) == canonical(F.col("next.text"))
        done = named(named(both, "h1", "h2", F.col("text"), "fingerprint", clash), "e1", "e2", F.col("edited"), "edited_fingerprint", clash)
        done = done.withColumn("edited_sha256", F.sha2("edited", 256))
    like = lambda same: F.when(same, 1.0).otherwise(0.0)
    return done.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", like(edited_equal).alias("near_edited"), like(next_equal).alias("near_next"))
