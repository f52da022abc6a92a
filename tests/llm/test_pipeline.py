import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from loomsieve import llm


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in llm.queries()) == list(range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "neardup", "suffixes", "pii", "packing"]


def test_stages(spark, docs, labels, corpus, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    at, counts = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, str(tmp_path))
        assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
        out.write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        counts.append(at.count())
    assert len(corpus) > counts[0] > counts[1] == counts[2] == counts[3]
    rows = at.collect()
    assert all(r["n_chars"] == len(r["text"]) for r in rows if r["text"] is not None) and any("<email>" in (r["text"] or "") for r in rows)
    assert any(r["text"] is None for r in rows)
    last = corpus_pipeline.STAGES[-1][1](spark, at, str(tmp_path)).collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sum(len(library.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in rows)
    assert sum(len(np.frombuffer(r["ids"], "<u4")) for r in last) == want
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(last)


def test_empty_table(spark, docs, labels, tmp_path):
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
