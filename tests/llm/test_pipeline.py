import hashlib

from conftest import SF
from test_decontaminate import brute as brute_hits
from test_quality import brute as brute_statistics
from test_simhash import brute_groups, brute_print
from test_substrings import brute_words

import corpus_pipeline
from plumbline.llm import quality


def test_stages_match_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        after = {r.doc_id: r for r in docs.collect()}
        assert docs.count() == len(after) > 0
        if name == "source_mixing":
            assert set(names) < set(docs.columns)
            assert all(0 < r.taken <= 2 * len((r.text or "").encode().split()) for r in after.values())
            continue
        assert docs.columns == names
        if name == "quality_rules":
            base = {k for k, r in before.items() if (s := brute_statistics(r.text)) and (s[0] < 50 or 100 * s[4] > 50 * s[0])}
            kept = {r.doc_id for r in quality.judge(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")).where("kept").collect()}
            assert not base & kept and set(after) == kept
        elif name == "simhash_near_dedup":
            groups = brute_groups([(k, brute_print(r.text)) for k, r in sorted(before.items())])
            assert set(after) == set(groups.values())
        elif name == "substring_dedup":
            want = brute_words([(k, r.text) for k, r in before.items()])
            for k, (n, gone, digest) in want.items():
                if gone == n and n:
                    assert k not in after
                elif gone:
                    assert hashlib.sha256(after[k].text.encode()).hexdigest() == digest and after[k].n_chars == len(after[k].text)
                else:
                    assert after[k] == before[k]
        else:
            bad = {k for k, n, hit, _ in brute_hits([(k, r.text) for k, r in before.items()], bench) if hit and 20 * hit >= n}
            assert set(after) == set(before) - bad


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert 0 < out.count() <= spark.read.parquet(f"{SF}/documents.parquet").count()


def test_odd_rows(spark, odd_docs, tmp_path):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert stage(spark, docs.limit(0).select("doc_id", "text", "lang", "source", "n_chars"), str(tmp_path)).count() == 0
    assert docs.count() >= 1


def test_extra_columns_with_clashing_names(spark, odd_docs, tmp_path):
    """Extra columns survive every stage, whatever their names; every row is judged by its own text."""
    for t in ("benchmark", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    names = ["cut", "size", "target", "taken", "source_size", "placements", "component", "row", "fp", "kept", "n_words", "mix_size", "a.b"]
    docs = odd_docs.selectExpr("*", *[f"{i} AS `{n}`" for i, n in enumerate(names)])
    for name, stage in corpus_pipeline.STAGES:
        before = docs.columns
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns[: len(before)] == before
    assert docs.columns[len(before) :] == ["mix_mix_size", "mix_source_size", "mix_target", "mix_taken", "mix_placements"]


def test_rows_without_a_doc_id_are_judged(spark, tmp_path):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    passage = bench.first().text
    docs = spark.createDataFrame([(None, passage, "en", "a", 1), (None, "clean words", "en", "a", 1), (5, passage, "en", "a", 1), (5, "other clean words", "en", "a", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    assert sorted(r.text for r in stages["decontamination"](spark, docs, str(tmp_path)).collect()) == ["clean words", "other clean words"]
    kept = stages["simhash_near_dedup"](spark, docs, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.text == passage) for r in kept) == [(0, False), (5, False), (5, True)]
