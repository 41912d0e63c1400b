import re

import corpus_pipeline

from pointweave.llm import bpe, common, hashing, pii, toxicity
from tests.llm.helpers import odd_documents


def test_no_stage_of_the_pipeline_needs_two_python_workers_for_a_task(spark):
    docs = odd_documents(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[1:]:  # the first has one map over the documents
        plan = stage(spark, docs, "")._jdf.queryExecution().executedPlan().toString()
        python = re.findall(r"ArrowEvalPython|BatchEvalPython|MapInArrow|MapInPandas", plan)
        assert len(python) <= 1, (name, python)


def test_a_worker_keeps_the_caches_of_one_operator_only():
    model = toxicity.fit(["a", "b"], [1, 1])
    for operator in ("toxicity", "minhash", "pii", "bpe", "toxicity"):
        common.turn(operator)
        model.score("an idiot") if operator == "toxicity" else None
        hashing.word_hashes([b"two words"]) if operator == "minhash" else None
        pii.chain("two words") if operator == "pii" else None
        bpe.encoder(*bpe.default_vocabulary()).encode("two words") if operator == "bpe" else None
        kept = {"toxicity": len(toxicity._AUTOMATA), "minhash": len(hashing._WORDS), "pii": len(pii._SHAPES), "bpe": bpe.encoder.cache_info().currsize}
        assert [k for k, n in kept.items() if n] == [operator]
        common.turn(operator)  # the same again loses nothing
        assert kept[operator]
