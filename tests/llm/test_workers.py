"""How many Python workers a task of near-duplicate removal holds at once, and that it returns the same."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from convoflow.llm import jaccard


def test_no_task_of_near_duplicates_needs_two_python_workers(spark, monkeypatch):
    plans = []
    real = jaccard.cut

    def watched(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df)

    monkeypatch.setattr(jaccard, "cut", watched)
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(i, text) for i in range(9)] + [(20 + i, " ".join(f"v{i}x{k}" for k in range(40))) for i in range(9)] + [(None, text), (50, None), (51, ""), (3, text), (4, "short text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("more", F.lit("kept"))
    kept = jaccard.one_of_each(docs)
    assert kept.columns == ["doc_id", "text", "more"]
    assert sorted((r["doc_id"], r["more"]) for r in kept.collect()) == sorted((i, "kept") for i in [0, *range(20, 29), 50, 51, 4])
    narrow = [p for p in plans if "Exchange" not in p]
    assert narrow and max(len(re.findall("ArrowEvalPython|MapInArrow|MapInPandas", p)) for p in narrow) == 1
