"""Line de-duplication that returns keep bitmaps instead of text. SQL functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import SPACE_CHARS, ascii_lower, written

#: Keys with more than 1/HEAVY of all lines (so fewer than HEAVY of them) leave the range-partitioned path.
HEAVY = 1000


def _rows(df: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    text = F.coalesce(df[text_col], F.lit(""))
    rest = [F.struct(*[df[c] for c in carry]).alias("carried")] if carry else []
    return df.select(df[id_col].alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"), *rest)


def line_marks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """Which lines each document loses: doc_id, text_hash, n_dropped, keep_runs.

    A text is split at ``\\n``; a line's key is the line without ASCII white
    space at its ends and with A-Z lower-cased. A key of ``min_chars`` code
    points or more that is in two documents or more stays only in the smallest
    doc_id that holds it (there, every repetition stays). ``keep_runs`` is the
    document's bitmap, run-length coded: lines kept, lines dropped, lines kept
    and so on; lines beyond the last run are kept. Documents that lose nothing
    have no row.

    A null or empty text is one empty line. Rows with a null id neither lose
    lines nor hold them. Rows that repeat an id are one document; where their
    texts differ, each text (``text_hash``) has a bitmap of its own. An empty
    table gives no rows; other columns are ignored.

    Hashes of lines are dealt into ranges, sorted by document and position, and
    the first occurrence streams down each key. Keys so common that they would
    fill a range (found by a frequent-items sketch over all lines; the path is
    exact for any set of keys) are reduced to their first document by partial
    aggregation instead and joined by a broadcast of fewer than ``HEAVY`` rows.
    """
    rows = _rows(df, id_col, text_col).where("doc_id IS NOT NULL")
    lines = rows.select("doc_id", "text_hash", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = lines.select("doc_id", "text_hash", "pos", F.btrim("line", F.lit(SPACE_CHARS)).alias("line")).where(F.char_length("line") >= min_chars)
    key = ascii_lower(F.col("line"))
    lines = written(lines.select("doc_id", "text_hash", "pos", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2")), "lines")

    found = lines.agg(F.count("*").alias("n"), F.expr(f"approx_top_k(h1, {HEAVY}, 50000)").alias("top")).first()
    heavy = [x["item"] for x in found["top"] or [] if x["count"] * HEAVY > found["n"]]
    by_key = Window.partitionBy("h1", "h2").orderBy("doc_id", "pos")
    light = lines if not heavy else lines.where(~F.col("h1").isin(heavy))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dropped = (
        light.repartitionByRange(parts, "h1")
        .withColumn("first", F.first("doc_id").over(by_key.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .where("doc_id <> first")
        .select("doc_id", "text_hash", "pos")
    )
    if heavy:
        common = lines.where(F.col("h1").isin(heavy))
        firsts = common.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"))
        dropped = dropped.unionByName(common.join(F.broadcast(firsts), ["h1", "h2"]).where("doc_id <> first").select("doc_id", "text_hash", "pos"))

    lost = dropped.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("pos")).alias("lost"))
    ends = F.expr("filter(lost, (x, i) -> i = size(lost) - 1 OR get(lost, i + 1) <> x + 1)")
    begins = F.expr("filter(lost, (x, i) -> i = 0 OR get(lost, i - 1) <> x - 1)")
    runs = lost.select("doc_id", "text_hash", F.size("lost").cast("bigint").alias("n_dropped"), begins.alias("b"), ends.alias("e"))
    return runs.select(
        "doc_id",
        "text_hash",
        "n_dropped",
        F.expr("flatten(transform(b, (x, i) -> array(x - coalesce(get(e, i - 1) + 1, 0), get(e, i) - x + 1)))").alias("keep_runs"),
    )


def keep_mask(runs):
    """array<boolean> of a run-length bitmap, as far as its runs go."""
    return F.flatten(F.transform(runs, lambda n, i: F.array_repeat(i % 2 == 0, n)))


def apply_line_marks(df: DataFrame, marks: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Every document with n_lines, n_dropped and kept_text (its kept lines joined by ``\\n``).

    Columns named in ``carry`` come along in the struct ``carried``.
    """
    rows = _rows(df, id_col, text_col, carry)
    rest = ["carried"] if carry else []
    both = rows.join(marks, ["doc_id", "text_hash"], "left")
    # the mask is a column of its own, made once a row and not once a line
    with_mask = both.select("doc_id", *rest, "text", "n_dropped", keep_mask(F.col("keep_runs")).alias("mask"), F.split("text", "\n", -1).alias("lines"))
    kept = F.expr("array_join(transform(array(mask), m -> filter(lines, (x, i) -> coalesce(get(m, i), true)))[0], '\n')")
    return with_mask.select(
        "doc_id",
        *rest,
        F.size("lines").cast("bigint").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0).cast("bigint")).alias("n_dropped"),
        F.when(F.col("mask").isNull(), F.col("text")).otherwise(kept).alias("kept_text"),
    )
