"""Queries read the whole of their input."""

from beaconframe.plans import QUERIES
from beaconframe.plans.stats import MARKS

FILLER = " and so on and so forth" * 20


def folder(spark, tmp_path, texts):
    spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_nature_reads_whole_transcripts(spark, tmp_path):
    phrases = ["structure fire", "gas leak", "overdose"]
    plate = len(MARKS) - 1  # its marker alone would be SMOKE
    texts = {i: f"{p} reported{FILLER}" for i, p in enumerate(phrases)} | {plate: f"license plate of a car{FILLER}"}
    sf = folder(spark, tmp_path, texts)
    found = {(r.call_id, r.label) for r in QUERIES["f40_nature_evidence"](spark, sf).collect()}
    assert found >= {(i, p.upper()) for i, p in enumerate(phrases)}
    natures = {r.call_id: r.nature for r in QUERIES["f43_final_nature"](spark, sf).collect()}
    assert len(natures) == len(texts) and natures[1] == "GAS LEAK" and natures[plate] == "UNKNOWN PROBLEM"
