"""Queries of metrics, sampling, specifications and chunk tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import specs
from gridloom.operators import metrics as M
from gridloom.operators import sampling as A
from gridloom.operators import scalar as S
from gridloom.operators import volumes as V
from gridloom.plans.catalog import query
from gridloom.plans.views import SERIES, VOX, series, table, vox
from gridloom.sources import volumes as store

_PAIRS = f"{SERIES}, e AS (SELECT user_id, t, v AS target, lag(v) OVER (PARTITION BY user_id ORDER BY t) AS pred, avg(v) OVER (PARTITION BY user_id) AS base FROM series), p AS (SELECT * FROM e WHERE pred IS NOT NULL)"


def _pairs(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id")
    s = series(spark, sf_dir)
    out = s.select("user_id", "t", F.col("v").alias("target"), F.lag("v").over(w.orderBy("t")).alias("pred"), F.avg("v").over(w).alias("base"))
    return out.where("pred IS NOT NULL")


def _r(df, *names, digits=5):
    return df.withColumns({n: F.round(n, digits) for n in names})


for _name, _error, _sql in (
    ("mse", M.squared_error, "pow(pred - target, 2)"),
    ("mae", M.absolute_error, "abs(pred - target)"),
    ("mape", M.percentage_error, "abs(pred - target) / greatest(abs(target), 1e-8)"),
):

    def _mean(spark, sf_dir, error=_error):
        return _r(M.mean_metric(_pairs(spark, sf_dir), ["user_id"], error), "value", digits=7)

    query(f"metric_{_name}", f"WITH {_PAIRS} SELECT user_id, round(avg({_sql}), 7) AS value FROM p GROUP BY user_id")(_mean)


@query("metric_relative_mse", f"WITH {_PAIRS} SELECT user_id, round(avg(pow(pred - target, 2)) / avg(pow(base - target, 2)), 5) AS value FROM p GROUP BY user_id")
def metric_relative_mse(spark, sf_dir):
    return _r(M.relative_metric(_pairs(spark, sf_dir), ["user_id"], M.squared_error, "base"), "value")


@query("metric_per_step_mae", f"WITH {_PAIRS} SELECT t, round(avg(abs(pred - target)), 5) AS value FROM p GROUP BY t")
def metric_per_step_mae(spark, sf_dir):
    return _r(M.mean_metric(_pairs(spark, sf_dir), ["t"], M.absolute_error), "value")


_BOOL = "tp, fp, fn, tn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1"


@query("confusion_bool", f"WITH c AS (SELECT doc_id % 7 AS batch, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS tp, count(*) FILTER (WHERE quality <> 1 AND toxic = 1) AS fp, count(*) FILTER (WHERE quality = 1 AND toxic <> 1) AS fn, count(*) FILTER (WHERE quality <> 1 AND toxic <> 1) AS tn FROM labels GROUP BY 1) SELECT batch, {_BOOL} FROM c")
def confusion_bool(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").withColumn("batch", F.col("doc_id") % 7)
    return _r(M.confusion_bool(rows, ["batch"], F.col("toxic") == 1, F.col("quality") == 1), "precision", "recall", "f1", digits=6)


@query("confusion_thresholded", f"WITH {_PAIRS}, c AS (SELECT t % 5 AS batch, count(*) FILTER (WHERE pred > 40 AND target > 40) AS tp, count(*) FILTER (WHERE pred > 40 AND NOT target > 40) AS fp, count(*) FILTER (WHERE NOT pred > 40 AND target > 40) AS fn, count(*) FILTER (WHERE NOT pred > 40 AND NOT target > 40) AS tn FROM p GROUP BY 1) SELECT batch, {_BOOL} FROM c")
def confusion_thresholded(spark, sf_dir):
    rows = _pairs(spark, sf_dir).withColumn("batch", F.col("t") % 5)
    return _r(M.confusion_bool(rows, ["batch"], F.col("pred") > 40, F.col("target") > 40), "precision", "recall", "f1", digits=6)


_BEST = "SELECT vec_id, label AS truth, list_position(embedding[1:10], list_max(embedding[1:10])) - 1 AS pred FROM embeddings"


def _best(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    first = F.slice("embedding", 1, 10)
    return e.select("vec_id", F.col("label").alias("truth"), (F.array_position(first, F.array_max(first)) - 1).cast("int").alias("pred"))


@query("confusion_classes", f"SELECT truth, CAST(pred AS INTEGER) AS pred, count(*) AS n FROM ({_BEST}) GROUP BY ALL")
def confusion_classes(spark, sf_dir):
    return M.confusion(_best(spark, sf_dir), "pred", "truth")


_CLASS = f"""b AS ({_BEST}), k AS (SELECT truth AS class FROM b UNION SELECT pred FROM b),
c AS (SELECT CAST(class AS INTEGER) AS class, count(*) FILTER (WHERE truth = class) AS support, count(*) FILTER (WHERE pred = class) AS predicted, count(*) FILTER (WHERE truth = class AND pred = class) AS tp FROM b, k GROUP BY class),
m AS (SELECT class, support, CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted END AS precision, CASE WHEN support = 0 THEN 0 ELSE tp / support END AS recall, 2 * tp / (predicted + support) AS f1 FROM c)"""


@query("per_class_scores", f"WITH {_CLASS} SELECT class, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM m")
def per_class_scores(spark, sf_dir):
    return _r(M.per_class(_best(spark, sf_dir), "pred", "truth"), "precision", "recall", "f1", digits=6)


@query("macro_scores", f"WITH {_CLASS} SELECT (SELECT round(avg(CAST(truth = pred AS DOUBLE)), 6) FROM b) AS accuracy, round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1 FROM m")
def macro_scores(spark, sf_dir):
    return _r(M.macro(_best(spark, sf_dir), "pred", "truth"), "accuracy", "macro_precision", "macro_recall", "macro_f1", digits=6)


@query("ranking_metrics", """WITH s AS (SELECT CAST(round(CAST(embedding[1] AS DOUBLE), 2) AS DOUBLE) AS s, label < 3 AS t FROM embeddings), g AS (SELECT s, count(*) FILTER (WHERE t) AS pos, count(*) FILTER (WHERE NOT t) AS neg FROM s GROUP BY s),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM g WINDOW w AS (ORDER BY s DESC))
SELECT round(sum(neg * (tp - pos / 2)) / (sum(pos) * sum(neg)), 6) AS roc_auc, round(sum(pos * tp / (tp + fp)) / sum(pos), 6) AS average_precision FROM c""")
def ranking_metrics(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.round(F.get("embedding", F.lit(0)).cast("double"), 2).alias("s"), "label")
    return _r(M.ranking_metrics(e, "s", F.col("label") < 3), "roc_auc", "average_precision", digits=6)


@query("valid_prediction_time", f"WITH {_PAIRS}, s AS (SELECT t, avg(abs(pred - target)) AS e FROM p GROUP BY t) SELECT coalesce(min(CASE WHEN e > 60 THEN t END), max(t) + 1) AS step FROM s")
def valid_prediction_time(spark, sf_dir):
    return M.valid_prediction_time(_pairs(spark, sf_dir), "t", F.abs(F.col("pred") - F.col("target")), 60.0)


@query("binned_loss", f"WITH {_PAIRS}, b AS (SELECT CAST(least(floor(t / 90.0 * 12), 11) AS INTEGER) AS bin, abs(pred - target) AS v FROM p) SELECT CAST(i AS INTEGER) AS bin, count(v) AS n, round(CASE WHEN count(v) > 0 THEN avg(v) ELSE -1 END, 5) AS mean FROM range(12) r(i) LEFT JOIN b ON b.bin = i GROUP BY i")
def binned_loss(spark, sf_dir):
    return _r(M.binned(_pairs(spark, sf_dir), F.col("t") / 90.0, F.abs(F.col("pred") - F.col("target")), 12), "mean")


@query("summaries", "SELECT event_type, max(value) AS max, min(value) AS min, round(avg(value), 5) AS mean, round(stddev_pop(value), 5) AS std, count(value) AS n FROM events GROUP BY event_type")
def summaries(spark, sf_dir):
    return _r(M.summaries(table(spark, sf_dir, "events"), "event_type", "value"), "mean", "std")


@query("ensemble_errors", "WITH e AS (SELECT user_id % 10 AS k, event_type, avg(pow(value - 50, 2)) AS e FROM events GROUP BY 1, 2) SELECT k, round(avg(e), 4) AS mean, round(min(e), 4) AS least FROM e GROUP BY k")
def ensemble_errors(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("k"), F.col("event_type").alias("member"), F.col("value").alias("pred"), F.lit(50.0).alias("target"))
    return _r(M.ensemble(rows, ["k"], M.squared_error), "mean", "least", digits=4)


@query("stratified_split", """WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5('5:' || doc_id), doc_id) - 1 AS k, count(*) OVER (PARTITION BY quality) AS n FROM labels)
SELECT doc_id, quality, CASE WHEN k < floor(0.7 * n) THEN 'train' WHEN k < floor(0.7 * n) + floor(0.1 * n) THEN 'valid' ELSE 'test' END AS split FROM r""")
def stratified_split(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return A.stratified_split(rows, "doc_id", "quality", [0.7, 0.1], ["train", "valid", "test"], seed=5)


_FOLDS = "f AS (SELECT doc_id, CAST((row_number() OVER (PARTITION BY quality ORDER BY md5('1:' || doc_id), doc_id) - 1) % 5 AS INTEGER) AS fold FROM labels)"


@query("folds", f"WITH {_FOLDS} SELECT doc_id, fold FROM f")
def folds(spark, sf_dir):
    return A.folds(table(spark, sf_dir, "labels"), "doc_id", "quality", 5, seed=1).select("doc_id", "fold")


@query("rotated_folds", f"WITH {_FOLDS} SELECT doc_id, fold, CAST(r AS INTEGER) AS rotation, CASE WHEN (fold - r + 5) % 5 < 1 THEN 'test' WHEN (fold - r + 5) % 5 < 3 THEN 'valid' ELSE 'train' END AS split FROM f, range(5) t(r)")
def rotated_folds(spark, sf_dir):
    f = A.folds(table(spark, sf_dir, "labels"), "doc_id", "quality", 5, seed=1).select("doc_id", "fold")
    return A.rotated(f, 5, valid=2)


@query("concatenated_splits", "SELECT s_suppkey AS id FROM supplier UNION ALL SELECT c_custkey + 1000 FROM customer UNION ALL SELECT p_partkey + 6000 FROM part")
def concatenated_splits(spark, sf_dir):
    part = lambda t, c: table(spark, sf_dir, t).select(F.col(c).alias("id"))
    return A.concatenated([(part("supplier", "s_suppkey"), 1000), (part("customer", "c_custkey"), 5000), (part("part", "p_partkey"), 1)], "id")


@query("repeated_rows", "SELECT s_suppkey + i * 100000 AS id FROM supplier, range(3) r(i)")
def repeated_rows(spark, sf_dir):
    return A.repeated(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")), "id", 3, 100000)


@query("balanced_classes", """WITH n AS (SELECT quality, count(*) AS n, max(count(*)) OVER () AS top FROM labels GROUP BY quality),
r AS (SELECT doc_id, quality, n, top, row_number() OVER (PARTITION BY quality ORDER BY md5('0:' || doc_id), doc_id) - 1 AS k FROM labels JOIN n USING (quality))
SELECT doc_id, quality, CAST(unnest(range(top // n + CASE WHEN k < top % n THEN 1 ELSE 0 END)) AS INTEGER) AS copy FROM r""")
def balanced_classes(spark, sf_dir):
    return A.balanced(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "quality")


@query("sample_each", """WITH r AS (SELECT doc_id, event_type AS kind, row_number() OVER (PARTITION BY event_type ORDER BY md5('3:' || doc_id), doc_id) AS k, count(*) OVER (PARTITION BY event_type) AS n, count(*) OVER () AS t FROM (SELECT event_id AS doc_id, event_type FROM events))
SELECT doc_id, kind FROM r WHERE k <= greatest(floor(n * 200 / t), 2)""")
def sample_each(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.col("event_type").alias("kind"))
    return A.sample_each(rows, "doc_id", "kind", 200, guarantee=2, seed=3)


_BYTES = "CAST(('0x' || substr(h, {}, 2)) AS BIGINT)"
_SHARD = "CAST(0 AS BIGINT)"
for _i in reversed(range(16)):
    _SHARD = f"(({_SHARD} * 256 + {_BYTES.format(2 * _i + 1)}) % 97)"


@query("md5_shard", f"SELECT o_orderkey, {_SHARD} AS shard FROM (SELECT o_orderkey, md5(CAST(o_orderkey AS VARCHAR)) AS h FROM orders)")
def md5_shard(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", A.md5_shard(F.col("o_orderkey"), 97).alias("shard"))


@query("split_signature", "WITH r AS (SELECT md5(doc_id || ':' || quality) AS h FROM labels), l AS (SELECT substr(any_value(r.h), 1, 2) AS b, md5(string_agg(r.h, '' ORDER BY r.h)) AS h FROM r GROUP BY substr(r.h, 1, 4)), b AS (SELECT md5(string_agg(h, '' ORDER BY h)) AS h FROM l GROUP BY l.b) SELECT md5(string_agg(h, '' ORDER BY h)) AS signature FROM b")
def split_signature(spark, sf_dir):
    return A.signature(table(spark, sf_dir, "labels"), "doc_id", "quality")


@query("json_pointer", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_pointer(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", specs.json_pointer(F.col("props"), "/k").alias("k"))


OPS = {
    "clip": lambda df, low=None, high=None: df.withColumn("v", S.clip(F.col("v"), low, high)),
    "scale": lambda df, factor: df.withColumn("v", F.col("v") * factor),
    "log1p": lambda df: df.withColumn("v", F.log1p("v")),
    "threshold": lambda df, t: df.withColumn("v", S.threshold(F.col("v"), t)),
    "downsample": lambda df, how="mean", **f: V.downsample(df, f, how),
    "project": lambda df, dim, how: V.project(df, dim, how),
}


@query("operator_chain", f"WITH {VOX}, a AS (SELECT x // 2 AS x, y // 2 AS y, z, avg(ln(1 + least(greatest(v, 5.0), 200.0) * 0.5)) AS v FROM vox GROUP BY 1, 2, 3) SELECT x, y, round(max(v), 6) AS v FROM a GROUP BY x, y")
def operator_chain(spark, sf_dir):
    whole = vox(spark, sf_dir).select("x", "y", "z", "v")
    return _r(specs.apply_chain(whole, "clip(low=5.0, high=200.0) | scale(0.5) | log1p | downsample(x=2, y=2) | project('z', 'max')", OPS), "v", digits=6)


@query("operator_configs", f"WITH {VOX} SELECT x, y, z, CASE WHEN v * 2 > 90 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM vox")
def operator_configs(spark, sf_dir):
    return specs.apply_configs(vox(spark, sf_dir).select("x", "y", "z", "v"), '[{"name": "scale", "args": {"factor": 2.0}}, {"name": "threshold", "args": {"t": 90.0}}]', OPS)


@query("kebab_names", "SELECT c_custkey, lower(regexp_replace(regexp_replace(replace(initcap_name, ' ', ''), '([a-z])([A-Z])', '\\1-\\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1-\\2', 'g')) AS name FROM (SELECT c_custkey, c_name || 'HTTPServer' || c_mktsegment AS initcap_name FROM customer)")
def kebab_names(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", specs.kebab(F.replace(F.concat("c_name", F.lit("HTTPServer"), "c_mktsegment"), F.lit(" "), F.lit(""))).alias("name"))


@query("chunk_range_read", f"WITH {VOX} SELECT x, y, z, v FROM vox WHERE x >= 3 AND x < 11 AND y >= 6 AND y < 20 AND z >= 2 AND z < 9")
def chunk_range_read(spark, sf_dir):
    chunks = store.to_chunks(vox(spark, sf_dir), (8, 8, 4))
    return store.read_range(chunks, (8, 8, 4), (3, 6, 2), (11, 20, 9))


@query("resume_missing_chunks", f"WITH {VOX}, c AS (SELECT DISTINCT x // 8 AS cx, y // 8 AS cy, z // 4 AS cz FROM vox) SELECT cx, cy, cz FROM c WHERE (cx + cy + cz) % 3 <> 0")
def resume_missing_chunks(spark, sf_dir):
    chunks = store.to_chunks(vox(spark, sf_dir), (8, 8, 4)).select("cx", "cy", "cz")
    return chunks.join(chunks.where("(cx + cy + cz) % 3 = 0"), ["cx", "cy", "cz"], "left_anti")
