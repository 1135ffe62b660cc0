"""The corpus pipeline stage by stage against plain versions, and as a whole."""

from __future__ import annotations

import sys
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))
import brute
import corpus_pipeline as P

from tabassay.llm import quality
from tabassay.llm import queries as Q

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for _, stage in P.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), stage(spark, docs, SF).schema)
        out.append(docs.collect())
    return out


def texts(rows):
    return {r["doc_id"]: r["text"] for r in rows}


def test_quality_stage(spark, stages):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ranker = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = {}
    for r in stages[0]:
        data = np.frombuffer(r["text"].encode(), np.uint8)
        if ranker.score(quality.features(data, np.array([0, len(data)])))[0] >= 0.5:
            want[r["doc_id"]] = r["text"]
    assert texts(stages[1]) == want and len(want) < len(stages[0])
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [i for i, y in label.items() if y == 1]
    assert np.mean([i in want for i in good]) > 0.97 and np.mean([i in want for i, y in label.items() if y == 0]) < 0.1


def test_line_stage(stages):
    want = brute.repeated_lines(list(texts(stages[1]).items()))
    got = texts(stages[2])
    assert got == {i: t for i, t in want.items() if t == stages_text(stages[1], i) or brute.words(t)}
    assert all(r["n_chars"] == len(r["text"]) for r in stages[2])


def stages_text(rows, i):
    return next(r["text"] for r in rows if r["doc_id"] == i)


def test_near_stage(stages):
    kept = {i for i, (_, _, k) in brute.near(list(texts(stages[2]).items())).items() if k}
    assert set(texts(stages[3])) == kept and len(kept) < len(stages[2])


def test_benchmark_stage(spark, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    clean = {r[0] for r in brute.contaminated(list(texts(stages[3]).items()), items) if not r[-1]}
    assert set(texts(stages[4])) == clean


def test_packing_stage_and_columns(stages):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(Q.tokenizer_path())
    got = defaultdict(dict)
    for r in stages[5]:
        got[r["doc_id"]][r["piece"]] = (r["length"], r["ids_crc32"])
    for i, t in texts(stages[4]).items():
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
        assert got[i] == {k // 2048: (len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())) for k in range(0, len(ids), 2048)}
    assert all(tuple(s[0].asDict()) == P.COLUMNS for s in stages[:5])


def test_run_is_the_stages(spark, stages):
    key = lambda r: (r["doc_id"], r["piece"], r["length"], r["ids_crc32"])
    assert sorted(map(key, P.run(spark, SF).collect())) == sorted(map(key, stages[5]))


def test_stages_take_empty_and_odd_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    empty = docs.limit(0)
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (None, "a b c", None, None, None)], docs.schema)
    for name, stage in P.STAGES:
        assert stage(spark, empty, SF).count() == 0, name
        assert stage(spark, odd, SF).count() >= 0, name


def test_stages_take_any_column(spark):
    names = ["score", "n_removed", "n_lines", "t", "marks", "first", "lo", "hi", "each", "base", "n", "x", "_c0", "_t", "_other0", "kept", "component_id", "items", "quality", "w", "_id", "_hash"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 150").select("*", *[F.lit(c).alias(c) for c in names])
    for name, stage in P.STAGES[:-1]:
        plain, odd = stage(spark, docs.drop(*names), SF), stage(spark, docs, SF)
        assert odd.columns == docs.columns, name
        assert all(r[c] == c for r in odd.collect() for c in names), name
        assert sorted(map(str, odd.drop(*names).collect())) == sorted(map(str, plain.collect())), name
    assert P.STAGES[-1][1](spark, docs, SF).count() == P.STAGES[-1][1](spark, docs.drop(*names), SF).count()


def test_line_stage_drops_documents_cut_down_to_white_space(spark):
    line = "one two three four five six seven eight"
    docs = spark.createDataFrame([(1, line), (2, f"\t\n{line}\n \r"), (3, "\t\n")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in dict(P.STAGES)["line_dedup"](spark, docs, SF).collect()) == [1, 3]
