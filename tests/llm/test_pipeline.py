import zlib

import corpus_pipeline
from skyloom.llm import language_id, packing
from tests.llm.test_dedup import DATA, brute_exact, brute_near
from tests.llm.test_language_packing import PATTERN, RANKS
from tests.llm.test_substring import brute as brute_cut


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert [len(corpus_pipeline.STAGES)] == [5]
    model = language_id._compressors(language_id.learn(docs))
    want = {i: t for i, t in rows.items() if (d := language_id.letters(t or "")) and language_id.decide(language_id.sizes(d, model))[2] >= language_id.MARGIN}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, DATA)
        assert out.columns == list(corpus_pipeline.COLUMNS)
        path = str(tmp_path / name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        got = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        if k == 1:
            want = {i: want[i] for i, keep, *_ in brute_exact(sorted(want.items())) if i == keep}
        if k == 2:
            want = {i: want[i] for i, *_, kept in brute_near(sorted(want.items()), 5, 80) if kept}
        if k == 3:
            assert got.keys() <= want.keys()
            for i, n, gone, _sha in brute_cut(sorted(want.items())):
                if gone == 0:
                    assert got[i] == want[i]
                elif gone < n:
                    assert len(got[i].split()) == n - gone
                else:
                    assert i not in got
            assert all(r.n_chars == len(r.text) for r in docs.collect() if r.text != want[r.doc_id])
        else:
            assert got == want, name
    encode = packing.encoder(RANKS, PATTERN).encode
    found = {}
    for r in corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect():
        found.setdefault(r.doc_id, []).append((r.piece, r.length, r.ids_crc32))
    for r in docs.collect():
        ids = encode(r.text) + b"\0\0\0\0"
        assert sum(n for _, n, _ in found[r.doc_id]) == len(ids) // 4
        if len(found[r.doc_id]) == 1:
            assert found[r.doc_id][0][2] == zlib.crc32(ids)


def test_empty_and_null_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, rid string"
    for rows in ([], [(1, None, None, None, None, "x"), (None, "the one", "en", "s", 7, "x"), (None, "the one", "en", "s", 7, "x"), (2, "", "en", "s", 0, "x"), (3, "der eine", "de", "s", 8, "x"), (3, "der eine", "de", "s", 8, "x")]):
        for _name, stage in corpus_pipeline.STAGES:
            stage(spark, spark.createDataFrame(rows, schema), DATA).collect()


def test_repeated_ids_are_judged_by_their_text(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    w = " ".join(f"w{i}" for i in range(80))
    rows = [(1, w, "en", "s", 1), (5, w + " end", "en", "s", 1), (5, "a text of its own", "en", "s", 1)]
    docs = spark.createDataFrame(rows, schema)
    assert sorted(r.text for r in corpus_pipeline.near(spark, docs, DATA).collect()) == sorted([w, "a text of its own"])
    rows = [(1, "a b", "en", "s", 1), (1, "a  b", "en", "s", 1), (1, "a b", "en", "s", 1), (2, "ab", "en", "s", 1), (None, "n", "en", "s", 1), (None, "n ", "en", "s", 1)]
    assert sorted(r.text for r in corpus_pipeline.exact(spark, spark.createDataFrame(rows, schema), DATA).collect()) == ["a  b", "n "]


def test_extreme_ids_and_long_white_space(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(-(2**63), "the one and the other" + " " * 2_000_000 + "end", "en", "s", 1), (2**63 - 1, "der eine und der andere" + "\n" * 2_000_000, "de", "s", 1), (None, "the next one", "en", "s", 1), (3, " \t\n" * 700_000, "en", "s", 1)]
    docs = spark.createDataFrame(rows, schema)
    for _name, stage in corpus_pipeline.STAGES[1:]:
        docs = stage(spark, docs, DATA)
    assert {r.doc_id for r in docs.collect()} >= {-(2**63), 2**63 - 1, None}


def test_run_leaves_only_its_stages(spark):
    import os

    from skyloom.llm import scratch

    with scratch.dropped(spark) as made:
        out = corpus_pipeline.run(spark, DATA)
        assert out.where("length > 0").count() > 0 and out.columns[:2] == ["doc_id", "piece"]
        assert len(made) == 1 and os.path.isdir(made[0])
    assert not os.path.isdir(made[0])


def test_a_cluster_needs_a_shared_folder(spark):
    import pytest

    from skyloom.llm import scratch

    class Stub:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})
        sparkContext = type("Context", (), {"master": "spark://host:7077", "getConf": staticmethod(lambda: {})})

    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        scratch.shared_dir(Stub())
