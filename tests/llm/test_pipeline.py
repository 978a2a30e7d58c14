"""The pipeline against its stages' own rules, and its queries' names."""

import pytest

pytest.importorskip("strataweave.llm")

import corpus_pipeline  # noqa: E402
from strataweave.llm import registry  # noqa: E402


def test_ten_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 11))
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_each_stage_follows_its_operator(spark, sf_dir):
    from strataweave.llm.bpe import bpe
    from strataweave.llm.decontamination import benchmark_leaks
    from strataweave.llm.line_dedup import line_dedup
    from strataweave.llm.near_dedup import near_duplicates
    from strataweave.llm.quality_classifier import quality_classifier

    docs = registry.table(spark, sf_dir, "documents")
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.spool(stage(spark, docs, sf_dir))
        if name == "quality classifier":
            want = ids(quality_classifier(docs, registry.table(spark, sf_dir, "labels")).where("predicted = 1"))
        elif name == "line dedup":
            kept = line_dedup(docs).collect()
            want = {r["doc_id"] for r in kept if r["n_dropped"] < r["n_lines"] or not r["n_dropped"]}
            texts = {r["doc_id"]: r["kept_text"] for r in kept}
            assert all(texts[r["doc_id"]] == r["text"] and len(r["text"]) == r["n_chars"] for r in out.collect())
        elif name == "near-dedup":
            want = ids(near_duplicates(docs).where("doc_id = class_id"))
        elif name == "decontamination":
            want = ids(docs) - ids(benchmark_leaks(docs, registry.table(spark, sf_dir, "benchmark")))
        else:
            want = ids(docs)
            tokens = {r["doc_id"]: len(r["ids"]) for r in bpe(docs, registry.tokenizer_path()).collect()}
            assert all(tokens[r["doc_id"]] == r["n_tokens"] for r in out.collect())
        assert ids(out) == want and out.count() == len(want)
        if name != "BPE":
            assert out.columns == corpus_pipeline.COLUMNS
        seen.append(out.count())
        docs = out
    assert seen == sorted(seen, reverse=True) and 0 < seen[-1]
