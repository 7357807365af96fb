"""Queries read their tables whole: against plain Python."""

from quillstone import plans


def test_layers_of_whole_texts(spark, sf_dir):
    want = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        width = len(r.text) // 6
        want |= {(r.doc_id, k): r.text[k * width : (k + 1) * width] for k in range(6)}
    got = {(r.doc_id, r.layer): r.part for r in plans.QUERIES["f19_layer_slice"](spark, sf_dir).collect()}
    assert got == want and max(map(len, want.values())) > 1000
