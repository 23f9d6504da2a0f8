"""Operator 9, SentencePiece encoding and decoding by an Aho-Corasick automaton and Viterbi.

All pieces of a public model sit in one Aho-Corasick automaton.  A single pass over a text feeds
it one character at a time; at each position the state and its output links name every piece that
ends there, and each of them relaxes the best score of that position.  The path of best scores,
read backwards, is the encoding; characters that no piece covers become byte pieces.  Decoding
joins the pieces and turns byte pieces and the space mark back.

The public model's scores are those of merges, so this is the segmentation of greatest total
score and not the order-of-merges encoding of the model's own library; the two differ in ids and
agree in the decoded text.  No piece joins a letter to a following space mark (checked when the
model is read), so a text may be cut before each space and frequent parts are remembered.

Defined results: null and empty texts have no ids and decode to the empty text; every text
round-trips exactly; repeated rows each come back; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .scratch import base

SPACE = "▁"
_BYTE = re.compile(r"<0x([0-9A-F]{2})>$")
_PART = re.compile(r" *[^ ]+| +")
_MEMO = 300_000
_UNKNOWN = -100.0  # score of a byte piece, below any piece's own
_loaded: dict[str, "Pieces"] = {}


class Pieces:
    """A model's pieces with their scores: encode() and decode()."""

    def __init__(self, pieces: list[tuple[str, float, int]], bytes_at: dict[int, int]) -> None:
        """pieces: (text with space marks, score, id); bytes_at: id of each byte's piece."""
        self.automaton = ahocorasick.Automaton()
        self.text = {i: p for p, _, i in pieces}
        self.byte = {i: b for b, i in bytes_at.items()}
        self.bytes_at = bytes_at
        self.floor = min([s for _, s, _ in pieces], default=0.0) + _UNKNOWN
        for p, score, i in pieces:
            self.automaton.add_word(p, (len(p), score, i))
        self.automaton.make_automaton()
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p, _, _ in pieces):
            raise ValueError("a piece joins a letter to a following space mark")
        self.memo: dict[str, tuple[int, ...]] = {}

    @classmethod
    def read(cls, path: str) -> "Pieces":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, bytes_at = [], {}
        for i in range(model.get_piece_size()):
            p = model.id_to_piece(i)
            if m := _BYTE.match(p):
                bytes_at[int(m[1], 16)] = i
            elif not (model.is_unknown(i) or model.is_control(i) or model.is_unused(i)):
                pieces.append((p, model.get_score(i), i))
        return cls(pieces, bytes_at)

    def viterbi(self, text: str) -> list[int]:
        """Ids of the segmentation of greatest total score; of equal ones, that found first."""
        n = len(text)
        best, back = [0.0] + [None] * n, [None] * (n + 1)
        done = 0
        for last, (length, score, i) in self.automaton.iter(text):
            while done < last:  # positions that no piece reaches: the bytes of the character
                done += 1
                if best[done] is None:
                    best[done], back[done] = best[done - 1] + self.floor, (1, -1)
            end = last + 1
            total = best[end - length] + score
            if best[end] is None or total > best[end]:
                best[end], back[end] = total, (length, i)
            whole = best[last] + self.floor
            if whole > best[end]:
                best[end], back[end] = whole, (1, -1)
        while done < n:
            done += 1
            if best[done] is None:
                best[done], back[done] = best[done - 1] + self.floor, (1, -1)
        out, at = [], n
        while at:
            length, i = back[at]
            if i >= 0:
                out.append(i)
            else:
                out.extend(self.bytes_at[b] for b in reversed(text[at - 1].encode()))
            at -= length
        return out[::-1]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part in _PART.findall(text):
            ids = self.memo.get(part)
            if ids is None:
                # a literal space mark is no space: it is spelled in bytes
                ids = tuple(i for k, x in enumerate(part.split(SPACE)) for i in ([self.bytes_at[b] for b in SPACE.encode()] if k else []) + self.viterbi(x.replace(" ", SPACE)))
                if len(self.memo) < _MEMO and len(part) < 64:
                    self.memo[part] = ids
            out.extend(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        byte, text = self.byte, self.text
        return b"".join(bytes((byte[i],)) if i in byte else text[i].replace(SPACE, " ").encode() for i in ids).decode("utf-8", "replace")


def loaded(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces.read(path)
    return _loaded[path]


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = loaded(model)
        for batch in batches:
            ids = pa.array([np.array(use.encode(t.as_py() or ""), np.int32) for t in batch.column(1)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), ids], names=["doc_id", "ids"])

    return base(docs, "doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = loaded(model)
        for batch in batches:
            text = pa.array([use.decode(x.as_py() or []) for x in batch.column(1)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), text], names=["doc_id", "text"])

    return base(rows, "doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digested(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_ids, n_bytes_ids, ids_crc32, round_trip) of every row: what ``encoded`` gives, in
    short, and whether decoding it returns the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = loaded(model)
        for batch in batches:
            n, in_bytes, crc, same = [], [], [], []
            for t in batch.column(1):
                text = t.as_py() or ""
                ids = use.encode(text)
                packed = np.array(ids, "<u4")
                n.append(len(ids))
                in_bytes.append(sum(map(use.byte.__contains__, ids)))
                crc.append(zlib.crc32(packed.tobytes()))
                same.append(use.decode(ids) == text)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(in_bytes, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())], names=["doc_id", "n_ids", "n_byte_ids", "ids_crc32", "round_trip"])

    return base(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_ids long, n_byte_ids long, ids_crc32 long, round_trip boolean")
