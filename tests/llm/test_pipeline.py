import random

import corpus_pipeline
from trigflow.llm import secrets


def test_stages_take_effect(spark, tmp_path):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghijk") for _ in range(rnd.randint(2, 7)))
    fill = lambda n: " ".join(word() for _ in range(n))
    clean = fill(80)
    item = fill(25)
    rows = [(5, clean), (3, clean), (7, fill(70) + " " + item), (8, fill(90) + " token = abcdefgh1234"), (9, "too short"), (10, None), (11, fill(900))]
    docs = [(i, t, "en", "s", len(t) if t else None) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    columns = table.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        table = stage(spark, table, str(tmp_path))
        assert table.columns == columns
        left.append({r.doc_id for r in table.collect()})
    assert left == [{5, 3, 7, 8, 11}, {3, 7, 8, 11}, {3, 8, 11}, {3, 8, 11}]
    masked = {r.doc_id: r for r in table.collect()}
    assert masked[8].text.endswith(" [SECRET]") and masked[8].n_chars == len(masked[8].text) and masked[3].text == clean
    assert len(secrets.RULES) == 8
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == {3, 8, 11} and all(r.offset + r.length <= 2048 for r in packed)
