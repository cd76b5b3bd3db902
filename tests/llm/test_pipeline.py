"""The pipeline, stage by stage, against plain versions."""

import random
import re
from collections import Counter

import corpus_pipeline
import pytest

from gridloom.llm.classifier import quality_scores
from tests.llm.test_jaccard import plain as plain_groups
from tests.llm.test_native import plain_lines
from tests.llm.test_spans import PII, fits


def test_pipeline(spark, tmp_path):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(3, 8)))
    shared = "a line that many documents share"
    docs = []
    for i in range(160):
        lines = [" ".join(word() for _ in range(12)) for _ in range(rng.randint(2, 6))]
        if i % 4 == 0:
            lines.append(shared)
        if i % 5 == 0:
            lines.append(f"mail {word()}@{word()}.com or +1 (555) 123-{i:04d} from 10.0.0.{i}")
        if i % 8 == 1:
            lines = [" ".join(x + "***" for x in y.split()) for y in lines]
        docs.append((i, "\n".join(lines)))
    docs += [(200 + i, t.replace("\n", " ") + " zz") for i, t in docs[2:60:6]] + [(300, None), (301, "")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 8 != 1), 0) for i in range(160)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now, sf = spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = {r["doc_id"]: r["text"] for r in now.collect()}
        out = stage(spark, now, sf)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        after = {r["doc_id"]: r["text"] for r in now.collect()}
        assert now.count() == len(after)
        kept.append(len(after))
        if name == "quality_classifier":
            scores = quality_scores(df, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()
            assert after == {i: before[i] for i in (r["doc_id"] for r in scores if r["predicted"] == 1)}
            assert {i for i in range(160) if i % 8 == 1}.isdisjoint(after) and {i for i in range(160) if i % 8 != 1} <= set(after)
        elif name == "line_dedup":
            assert Counter((i, t) for i, t in after.items()) == Counter((i, t) for i, _, _, t in plain_lines(list(before.items())).elements())
        elif name == "ngram_jaccard":
            assert set(after) == {i for i, _, c in plain_groups(list(before.items())) if i == c}
        elif name == "pii":
            for i, t in before.items():
                spans = sorted((m.start(), -m.end()) for kind, p in PII.items() for m in re.finditer(p, t) if fits(kind, m))
                assert ("[" in after[i]) == bool(spans)
                assert not any(fits(kind, m) for kind, p in PII.items() for m in re.finditer(p, after[i]))
        assert all(r["n_chars"] == len(r["text"] or "") for r in now.collect())
    assert kept[0] < len(docs) and kept[2] < kept[1]
    pieces = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in pieces} == set(after)


CLASHES = ("row", "node", "h", "text_hash", "component_id", "kept_text", "label", "x")


def edge_table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *(7,) * len(CLASHES)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} int" for c in CLASHES))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_nulls_repeats_empty_tables_and_clashing_columns(spark, tmp_path, name):
    stage, rng = dict(corpus_pipeline.STAGES)[name], random.Random(4)
    text = lambda: " ".join("".join(rng.choice("aeioulmnrst") for _ in range(5)) for _ in range(30))
    rows = [(i, text()) for i in range(12)]
    rows += [rows[0], rows[0], (None, text()), (None, None), (20, None), (21, ""), (21, ""), (None, rows[1][1]), (22, text() + " 10.1.2.3"), (23, text() * 200)]
    spark.createDataFrame([(i, 1, 0) for i in range(12)] + [(None, 0, 0), (3, None, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    df = edge_table(spark, rows)
    none = stage(spark, df.where("doc_id = -1"), str(tmp_path))
    assert none.count() == 0
    out = stage(spark, df, str(tmp_path))
    if name == "best_fit_packing":
        assert {r["doc_id"] for r in out.collect()} == {i for i, _ in rows}
        return
    assert out.columns == df.columns == none.columns and out.schema["n_chars"].dataType == df.schema["n_chars"].dataType
    got = Counter((r["doc_id"], r["text"], r["node"]) for r in out.collect())
    want = Counter((i, t, 7) for i, t in rows)
    if name == "quality_classifier":
        assert got == want  # one class alone is the score of all
    elif name == "line_dedup":
        assert sum(got.values()) == len(rows) and got[rows[0][0], rows[0][1], 7] == 3 and got[None, rows[1][1], 7] == 1
    elif name == "ngram_jaccard":
        want[rows[0][0], rows[0][1], 7] = 1
        assert got == want
    else:
        assert sum(got.values()) == len(rows) and any("[" in t and i == 22 for i, t, _ in got) and got[20, "", 7] == 1
