import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from skyloom.llm import language_id, packing
from tests.llm.test_dedup import DATA, table

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = "crc32(cast(doc_id as string)) % 3 = 1"
    model = language_id.learn(docs.where(f"not ({held})"))
    assert set(model) == {"de", "en", "es", "fr"} and all(len(d) <= language_id.DICTIONARY for d in model.values())
    got = language_id.classify(docs.where(held), model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.97
    assert np.mean([r.accepted for r in got]) > 0.99
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edge_cases(spark):
    model = {"aa": b"one two three four five six seven eight", "bb": b"un deux trois quatre cinq six sept huit"}
    rows = [(1, None), (2, ""), (3, "12 34 !?"), (4, "three four five seven"), (5, "trois quatre cinq sept"), (6, "three four " * 50_000)]
    got = {r.doc_id: r for r in language_id.classify(table(spark, rows), model).collect()}
    assert [got[i].lang_pred for i in range(1, 7)] == ["und"] * 3 + ["aa", "bb", "aa"]
    assert [got[i].accepted for i in range(1, 6)] == [False] * 3 + [True] * 2
    assert language_id.classify(table(spark, []), model).count() == 0
    assert {r.lang_pred for r in language_id.classify(table(spark, rows), {}).collect()} == {"und"}
    docs = table(spark, rows).selectExpr("doc_id", "text", "if(doc_id = 6, null, if(doc_id = 5, 'bb', 'aa')) as lang", "bucket as source", "n as n_chars")
    kept = language_id.keep_identified(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {4, 5}


def test_ids_equal_tokenizers(spark):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    use = packing.encoder(RANKS, PATTERN)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    texts += ["", " ", "  ", "a  b", "a\n b", "a \n\nb ", " x", "x ", "é  y", "it's don't", "<|endoftext|>", "a <|endoftext|> b", "tab\t tab", "　 z", "1 2 33", "a\x1c b", "x\x85 y", "\U0001f600 \U0001f600"]
    for t in texts:
        assert np.frombuffer(use.encode(t), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, t[:50]


def test_long_white_space_equals_tokenizers():
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    use = packing.encoder(RANKS, PATTERN)
    rng = np.random.default_rng(6)
    runs = [" " * 300, "\n" * 300, "\t" * 301, " \n" * 200, "\u3000" * 256, "\xa0\u2003" * 200, "\x1c" * 300, "".join(rng.choice(list(" \n\t\r\x0b\x85"), 999))]
    for r in runs:
        for t in (r, f"a{r}", f"{r}b", f"a{r}b", f"a {r}\u00e9 c", f"a{r}<|endoftext|>b", f"<|endoftext|>{r}", f"it{r}'s{r}1{r}"):
            assert np.frombuffer(use.encode(t), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, (t[:3], len(t))
    for r in (" ", "\n", "\t", " \n\t"):
        text = r * (2_000_000 // len(r))
        for t in (text, f"a{text}b"):
            assert len(use.encode(t)) > 4


def test_very_long_text_equals_tokenizers(spark):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    words = " ".join(r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect())
    text = (words + " ") * (20_000_000 // len(words))
    assert np.frombuffer(packing.encoder(RANKS, PATTERN).encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def check_packing(spark, docs, rows):
    use = packing.encoder(RANKS, PATTERN)
    got = packing.packed(docs, RANKS, PATTERN).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i, text in rows:
        ids = use.encode(text or "") + b"\0\0\0\0"
        at = 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and (r.length == 2048 or k == 0) and r.ids_crc32 == zlib.crc32(ids[4 * at : 4 * (at + r.length)])
            at += r.length
        assert at == len(ids) // 4
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    return len(by_seq), sum(r.length for r in got)


def test_packing(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    sequences, tokens = check_packing(spark, docs, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert sequences <= -(-tokens // 2048) * 1.02 + 1
    rows = [(1, None), (2, ""), (3, "word " * 5000), (None, "x")]
    check_packing(spark, table(spark, rows), rows)
    assert packing.packed(table(spark, []), RANKS, PATTERN).count() == 0


def test_pack_quality():
    rng = np.random.default_rng(2)
    length = np.sort(np.minimum(2048, rng.lognormal(6, 1, 20000).astype(int) + 1))[::-1]
    sequence, offset = packing.pack(length)
    fill = np.bincount(sequence, weights=length)
    assert fill.max() <= 2048 and len(fill) <= -(-length.sum() // 2048) * 1.01
    assert set(zip(sequence, offset)) and len(set(zip(sequence, offset))) == len(length)


def test_predictions_equal_plain_compression(spark):
    """Each text is compressed anew with each dictionary, without the operator's prepared compressors."""
    import re

    import zstandard

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = language_id.learn(docs)

    def size(text, content):
        total = 0
        for k in range(0, len(text), language_id.BLOCK):
            block = text[k : k + language_id.BLOCK]
            level, match = language_id.LEVELS[len(block) < language_id.SHORT]
            how = zstandard.ZstdCompressionParameters.from_level(level, min_match=match, dict_size=len(content), source_size=language_id.BLOCK, write_content_size=False, write_checksum=False, write_dict_id=False)
            raw = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(compression_params=how)
            total += len(zstandard.ZstdCompressor(dict_data=raw, compression_params=how).compress(block + b" " * 64))
        return total

    got = {r.doc_id: r for r in language_id.classify(docs, model).collect()}
    for r in docs.orderBy("doc_id").limit(40).collect():
        text = " ".join(re.findall(r"[^\W\d_]+", (r.text or "").lower())).encode()
        sizes = sorted((size(text, d), lang) for lang, d in model.items())
        assert got[r.doc_id].lang_pred == (sizes[0][1] if text else "und")
        assert not text or abs(got[r.doc_id].margin - (1 - sizes[0][0] / sizes[1][0])) < 1e-12


def test_every_label_is_learned(spark):
    rows = [(i, f"text number {i} of label {i % 400} and some more words", f"l{i % 400:03}") for i in range(1200)] + [(None, "the same row", "same")] * 2000
    model = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model) == 401 and all(model.values()) and sum(map(len, model.values())) <= language_id.TOTAL


def test_repeated_rows_are_packed_full(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 500)
    rows = [(1, "one two three four five six seven eight")] * 4000
    got = packing.packed(table(spark, rows), RANKS, PATTERN).collect()
    per = 2048 // got[0].length
    assert len(got) == 4000 and len({(r.sequence_id, r.offset) for r in got}) == 4000
    assert len({r.sequence_id >> 32 for r in got}) == 8 and len({r.sequence_id for r in got}) <= -(-4000 // per) + 8


def test_language_of_very_long_texts(spark):
    model = {"aa": b"one two three four five six seven eight", "bb": b"un deux trois quatre cinq six sept huit"}
    rows = [(1, " " * 2_000_000 + "three four five seven"), (2, "\n" * 2_000_000), (3, "trois quatre cinq sept " * 40_000)]
    got = {r.doc_id: r.lang_pred for r in language_id.classify(table(spark, rows), model).collect()}
    assert got == {1: "aa", 2: "und", 3: "bb"}
