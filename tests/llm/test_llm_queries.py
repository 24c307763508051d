"""The registered queries and the pipeline over whole small tables."""

from collections import Counter

import pytest
import tiktoken
from oracle import differences
from pyspark.sql import functions as F
from test_llm_operators import removed, slow_base, slow_lines, slow_statistics
from test_whole_jobs import first_of_like

import corpus_pipeline
from octarine.llm import bpe, decontamination, language_id, quality_rules, registry, simhash, suffix_dedup


def texts(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_equals_sql(spark, sf, name):
    assert differences(registry.QUERIES[name](spark, sf), registry.SQL[name], sf) == (0, 0)


def test_all_ten_are_registered():
    assert [n for n in range(1, 11) if any(q.startswith(f"op{n}_") for q in registry.QUERIES)] == list(range(1, 11))


def test_op1(spark, sf):
    rows = texts(spark, sf)
    got = suffix_dedup.dedup(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), block_bytes=50_000).collect()
    assert Counter((g.doc_id, g.n_bytes, tuple(tuple(s) for s in g.spans), bytes(g.kept)) for g in got) == removed(rows)
    digest = {r.doc_id: (r.n_removed, r.n_spans) for r in registry.QUERIES["op1_suffix_dedup"](spark, sf).collect()}
    assert digest == {g.doc_id: (sum(b - a for a, b in g.spans), len(g.spans)) for g in got}


def test_op3(spark, sf):
    got = registry.QUERIES["op3_lm_scoring"](spark, sf).collect()
    want = {x[0]: x[1:] for x in slow_base(texts(spark, sf))}
    assert len(got) == len(want)
    for g in got:
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == want[g.doc_id][:4]
        assert g.base_score == pytest.approx(want[g.doc_id][4], abs=1e-5)
    held = [g for g in got if g.held_out]
    gain = sum(g.score - g.base_score for g in held) / sum(g.n_tokens for g in held)
    assert gain > 0.1  # in powers of ten, for each token


def test_op4(spark, sf):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    held = [g for g in registry.QUERIES["op4_language_id"](spark, sf).collect() if g.held_out]
    assert held and sum(g.lang_pred == lang[g.doc_id] for g in held) >= 0.9 * len(held)


def test_op6(spark, sf):
    ranks = bpe.codec(bpe.VOCABULARY, bpe.public_tokenizers.PATTERN).ranks
    public = tiktoken.Encoding("own", pat_str=bpe.public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = bpe.Codec()
    want = {i: (len(ids := public.encode_ordinary(t or "")), own.digest(ids)) for i, t in texts(spark, sf)}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256) for r in registry.QUERIES["op6_bpe"](spark, sf).collect()} == want


def test_op7(spark, sf):
    by = dict(texts(spark, sf))
    for r in registry.QUERIES["op7_quality_rules"](spark, sf).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == slow_statistics(by[r.doc_id])
        assert r.kept <= (not r.base_failed)


def test_op7_learns_what_labels_tell(spark):
    """Fitted on two thirds of the labelled rows, held against the rest."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0
    got = quality_rules.judge(docs, labels.where(~held)).join(labels.where(held).select("doc_id", "quality", "toxic"), "doc_id").collect()
    assert any(r.failed_rule for r in got)
    caught = [r for r in got if r.failed_rule]
    assert sum(r.quality == 0 or r.toxic == 1 for r in caught) >= 0.9 * len(caught)
    assert sum(r.failed_rule > 0 for r in got if r.quality == 0) >= 0.85 * sum(r.quality == 0 for r in got)
    assert sum(r.failed_rule > 0 for r in got if r.toxic == 1) >= 0.4 * sum(r.toxic == 1 for r in got)


def groups(rows):
    """The least doc_id of each row's group, by all pairs of fingerprints."""
    fps = {i: simhash.fingerprint(t) for i, t in rows}
    least = {f: f for f in fps.values()}
    changed = True
    while changed:
        changed = False
        for a in least:
            for b in least:
                if least[a] < least[b] and (a ^ b).bit_count() <= 2:
                    least[b] = least[a]
                    changed = True
    first = {}
    for i in sorted(fps):
        first.setdefault(least[fps[i]], i)
    return {i: first[least[f]] for i, f in fps.items()}


def test_op8(spark, sf):
    assert {r.doc_id: r.component_id for r in registry.QUERIES["op8_simhash"](spark, sf).collect()} == groups(texts(spark, sf))


def leaked(text, items, tile=5):
    """Whether the text's windows of five words cover enough of an item."""
    words = decontamination.words(text)
    windows = {tuple(words[k : k + tile]) for k in range(len(words) - tile + 1)}
    for item in items:
        hit = {k + j for k in range(len(item) - tile + 1) if tuple(item[k : k + tile]) in windows for j in range(tile)}
        if item and len(hit) >= decontamination.COVERAGE * len(item):
            return True
    return False


def test_op10(spark, sf):
    items = [decontamination.words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {r.doc_id for r in registry.QUERIES["op10_decontamination"](spark, sf).collect()}
    assert got == {i for i, t in texts(spark, sf) if leaked(t, items)}


def test_pipeline_stage_by_stage(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "lines", "near_duplicates", "benchmark", "tokens"]
    model = language_id.fit(language_id.known_part(docs))
    keep = {r.doc_id for r in language_id.predict(docs, model).where("not rejected").collect()}
    rows = [(i, t) for i, t in texts(spark, sf) if i in keep]
    rows = [(i, x[0]) for i, x in slow_lines(rows, 10).items()]
    keep = first_of_like(rows)
    rows = [(i, t) for i, t in rows if i in keep]
    items = [decontamination.words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = [(i, t) for i, t in rows if not leaked(t, items)]
    own = bpe.Codec()
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id: r.ids_sha256 for r in got} == {i: own.digest(own.encode(t)) for i, t in rows}
    assert {r.doc_id: r.n_chars for r in got} == {i: len(t) for i, t in rows}


def test_pipeline_of_no_documents(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
