"""Queries read whole texts, however long."""

from __future__ import annotations

from coverloom.plans import analysis


def test_stem_forms_of_a_long_text(spark, tmp_path):
    rows = [(1, "ab " * 400_000 + "lastword"), (2, "short text"), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.w: r.stems for r in analysis.QUERIES["stem_forms"](spark, str(tmp_path)).collect()}
    assert got == {"ab": "ab", "lastword": "lastword,lastwords", "short": "short,shorts", "text": "text,texts"}
