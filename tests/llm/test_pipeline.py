"""The pipeline's stages one after another on a small corpus, and the registry."""

import __spark_entry__
import corpus_pipeline
from skilltide.llm.common import written

from test_operators import links_by_hand, near_rows, prose


def test_stages(spark, tmp_path):
    rows = [*near_rows(), *((1000 + i, prose(1000 + i, 30) + (" vileword" if i % 3 == 0 else ""), "b") for i in range(90)), (5000, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in rows], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1000 + i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, str(tmp_path)), name)
        seen.append(docs)
    clean = [(i, t, s) for i, t, s in rows if not (t or "").endswith("vileword")]
    assert sorted(r.doc_id for r in seen[0].collect()) == sorted(i for i, _, _ in clean)
    _, comp = links_by_hand(clean)
    assert sorted(r.doc_id for r in seen[1].collect()) == sorted(i for i, c in comp.items() if i == c)
    assert seen[2].columns == seen[0].columns and {r.doc_id for r in seen[2].collect()} <= {r.doc_id for r in seen[1].collect()}
    assert seen[3].count() == seen[2].count()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen[3].count()


def test_registered():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
