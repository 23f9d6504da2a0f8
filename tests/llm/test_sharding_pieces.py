import hashlib
from collections import defaultdict

import public_tokenizers
import pytest

from skyloom.llm import pieces, sharding
from tests.llm.test_dedup import DATA, table

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def brute(rows, limit):
    rows = [(i, len((t or "").encode()), bin(int(hashlib.md5(f"{'' if i is None else i}\x1f{t or ''}".encode()).hexdigest()[:15], 16))[2:].zfill(60)) for i, t in rows]
    out = []

    def split(part, depth):
        total = sum(n for _, n, _ in part)
        if total <= limit or depth == 60:
            out.extend((i, n, bits[:depth] or "*", depth, total) for i, n, bits in part)
            return
        for bit in "01":
            if some := [r for r in part if r[2][depth] == bit]:
                split(some, depth + 1)

    split(rows, 0)
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [5_000_000, 60_000, 20_000])
def test_directory(spark, limit):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sorted((tuple(r)[:5] for r in sharding.sharded(docs, limit).collect()), key=str)
    assert got == brute(rows, limit)


def test_same_hashes_and_edges(spark):
    rows = [(7, "x" * 100)] * 25 + [(8, None), (None, "y"), (9, "z" * 900)]
    got = sharding.sharded(table(spark, rows), 400).collect()
    assert len(got) == len(rows)
    weight = defaultdict(int)
    for r in got:
        weight[r.shard_id] += r.n_bytes
    assert all(w <= 400 or r.oversize for r in got for w in [weight[r.shard_id]])
    assert all(r.shard_bytes == weight[r.shard_id] for r in got) and [r.doc_id for r in got if r.oversize] == [9]
    assert sharding.sharded(table(spark, [])).count() == 0


def test_round_trip(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    odd = [None, "", " ", "  a  b ", "▁x▁", "\U0001f600\x00​", "\n\t\r", "łódź 日本語 <0x41> <s>", "a" * 100_000]
    docs = docs.unionByName(spark.createDataFrame([(9000 + i, t) for i, t in enumerate(odd)], docs.schema))
    back = {r.doc_id: r.text for r in pieces.decoded(pieces.encoded(docs, MODEL), MODEL).collect()}
    assert back == {r.doc_id: r.text or "" for r in docs.collect()}
    assert all(r.round_trip for r in pieces.digested(docs, MODEL).collect())


def test_best_score_against_brute_force():
    vocabulary = {"a": -3.0, "b": -3.0, "ab": -4.0, "ba": -4.5, "aba": -5.0, "▁": -1.0, "▁a": -2.0, "bb": -9.0}
    use = pieces.Pieces([(p, s, 300 + k) for k, (p, s) in enumerate(vocabulary.items())], {b: b for b in range(256)})
    score = {300 + k: s for k, s in enumerate(vocabulary.values())}

    def best(text):
        if not text:
            return 0.0
        return max([best(text[1:]) + use.floor, *(best(text[len(p) :]) + s for p, s in vocabulary.items() if text.startswith(p))])

    for text in ["", "a", "abab", "bbba", "▁abba▁ab", "xaby", "cc", "abcba"]:
        ids = use.viterbi(text)
        total = sum(score[i] for i in ids if i >= 256) + use.floor * len([c for c in text if c not in "ab▁"])
        assert abs(total - best(text)) < 1e-9
        assert use.decode(ids) == text.replace("▁", " ")


def test_very_long_texts(spark):
    texts = [" " * 2_000_000, "\n" * 200_000 + "end", "x " * 300_000, " \t\n" * 100_000]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in pieces.digested(table(spark, rows), MODEL).collect()}
    assert all(got[i].round_trip and got[i].n_ids > 0 for i, _ in rows)


def test_a_row_repeated_by_the_thousand(spark):
    rows = [(7, "x" * 100)] * 5000 + [(i, "y" * 50) for i in range(8, 40)]
    got = sharding.sharded(table(spark, rows), 1000).collect()
    weight = defaultdict(int)
    for r in got:
        weight[r.shard_id] += r.n_bytes
    assert len(got) == len(rows) and max(weight.values()) <= 1000
    assert sum(r.doc_id == 7 for r in got) == 5000 and sum(w == 1000 for w in weight.values()) == 500
