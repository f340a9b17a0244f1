import numpy as np
from pyspark.sql import functions as F

from quarry import plans
from quarry.operators import vectors as V
from quarry.operators.chunking import chunk_files
from quarry.sources import adapters as A


def test_find_similar_searches_all_files(spark, sf_dir):
    rows = V.embed(chunk_files(A.files(spark, sf_dir)), 64).withColumn("key", F.xxhash64("file_path", "chunk_index")).collect()
    asked = np.array(min((r.file_path, r.vector) for r in rows if r.chunk_index == 0)[1])
    near = sorted((-round(float(asked @ np.array(r.vector)), 9), r.key, r.file_path, r.content_hash) for r in rows)[:40]
    best = {}
    for sim, _, path, content in near:
        if -sim >= 0.5:
            best.setdefault((path, content), -sim)
    want = sorted((round(s, 5) for s in best.values()), reverse=True)[:20]
    got = plans.QUERIES["tx6_find_similar_code"](spark, sf_dir).collect()
    assert np.allclose(sorted((r.similarity for r in got), reverse=True), want, atol=2e-5)
    files = {r.file_path: r.id for r in rows}
    assert any(files[r.file_path] % 20 for r in got)
