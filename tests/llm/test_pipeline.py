from __future__ import annotations

import corpus_pipeline
from llm_edges import EDGES
from orderlens.llm import bpe


def test_stages_keep_what_they_should(spark, docs):
    text = "the quick brown fox jumps over the lazy dog and runs away from it into the wood " * 3
    other = "der schnelle braune Fuchs springt über den faulen Hund und läuft in den dunklen Wald " * 3
    rows = [*EDGES, (10, text, "en", "a"), (11, text + "\n", "en", "a"), (12, other, "de", "b"),
            (13, other + "heute", "de", "b")]
    current = docs(rows)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        current = stage(spark, current, None)
        kept[name] = [r.asDict() for r in current.collect()]
        if name != "bpe":
            assert list(kept[name][0]) == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {name: {r["doc_id"] for r in rows} for name, rows in kept.items()}
    assert not {1, 2, 3} & ids["language_id"] and {10, 11, 12, 13} <= ids["language_id"]
    assert 10 not in ids["exact_dedup"] and 11 in ids["exact_dedup"] and 5 not in ids["exact_dedup"]
    assert {12} == {12, 13} & ids["near_dedup"]
    assert all(r["n_tokens"] == len(bpe.bpe(bpe.default_tokenizer()).encode([t["text"]])[0])
               for r in kept["bpe"] for t in kept["mixing"][:1] if r["doc_id"] == t["doc_id"])


def test_run_on_the_small_table(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 50
