"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

The model file gives pieces and scores.  A text is normalised as the model says (identity, one leading space, spaces to
U+2581).  The automaton reads it once; at each position its output links give every piece that ends there, and each
relaxes the best score at that position.  A character that no one-character piece covers may be an unknown (score: the
lowest piece score less 10) and becomes its UTF-8 byte pieces.  The result is the segmentation of highest total score;
ties go to the longer last piece.  Decoding joins the surfaces and takes the leading space away: it restores
any text that holds no U+2581 itself.

No piece goes on after U+2581 has followed another character and none holds a line feed (checked when the model is
loaded), so the best path of a text is the concatenation of the best paths of its words; paths of words met of late are
kept in a bounded cache of two generations.  Texts are encoded and handed on in slices of bounded size.

Defined results: null and empty texts give no ids and decode to ''; extra columns pass through; very long texts and
words are encoded whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .util import map_arrow, slices, text_buffer

SPACE = "▁"
SLICE = 1 << 20


def default_model() -> str:
    return "/opt/tokenizers/piece_bpe_32k.model"


class Codec:
    """Encoder and decoder for one model's bytes."""

    def __init__(self, proto: bytes, cache_words: int = 100_000):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = sp.get_piece_size()
        self.surface: list[bytes] = [b""] * n
        self.byte_id = [sp.unk_id()] * 256
        self.automaton = ahocorasick.Automaton()
        lowest, self.apart = 0.0, True
        self.single = set()
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.surface[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                score = sp.get_score(i)
                lowest = min(lowest, score)
                self.surface[i] = piece.replace(SPACE, " ").encode()
                self.apart &= SPACE not in piece.lstrip(SPACE) and "\n" not in piece
                self.automaton.add_word(piece, (len(piece), score, i))
                if len(piece) == 1:
                    self.single.add(piece)
        self.automaton.make_automaton()
        self.unknown = lowest - 10.0
        self.words = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n") if self.apart else None
        self.cache: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.cache_words = cache_words

    def viterbi(self, s: str) -> list[int]:
        """The best segmentation of a normalised string, in one pass."""
        n = len(s)
        worst = float("-inf")
        best, back = [0.0] + [worst] * n, [(0, -1)] * (n + 1)
        hits = self.automaton.iter(s)
        hit = next(hits, None)
        for end in range(n):
            to = end + 1
            top = worst
            if s[end] not in self.single:
                top, back[to] = best[end] + self.unknown, (end, -1)
            while hit is not None and hit[0] == end:
                length, score, i = hit[1]
                at = best[to - length] + score
                if at > top:
                    top, back[to] = at, (to - length, i)
                hit = next(hits, None)
            best[to] = top
        out: list[int] = []
        to = n
        while to:
            start, i = back[to]
            if i < 0:
                out.extend(self.byte_id[b] for b in reversed(s[start:to].encode()))
            else:
                out.append(i)
            to = start
        out.reverse()
        return out

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        s = SPACE + text.replace(" ", SPACE)
        if self.words is None:
            return self.viterbi(s)
        out: list[int] = []
        cache = self.cache
        for w in self.words.findall(s):
            ids = cache.get(w)
            if ids is None:
                ids = self.older.get(w) or tuple(self.viterbi(w))
                if len(w) <= 64:
                    if len(cache) >= self.cache_words:
                        self.older, self.cache = cache, {}
                        cache = self.cache
                    cache[w] = ids
            out.extend(ids)
        return out

    def decode(self, ids) -> str:
        return b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace")[1:]


def encode(docs: DataFrame, model: str | None = None, column: str = "text", decoded: bool = False) -> DataFrame:
    """``docs`` with ``ids`` (array of int), ``n_pieces`` and ``round_trip`` (decoding gives the text back); with ``decoded`` also the decoded text."""
    with open(model or default_model(), "rb") as f:
        proto = docs.sparkSession.sparkContext.broadcast(f.read())  # a model file: its size does not grow with the data
    docs = docs.drop("ids", "n_pieces", "round_trip", "decoded")
    fields = [T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("n_pieces", T.IntegerType()), T.StructField("round_trip", T.BooleanType())]
    schema = T.StructType(docs.schema.fields + fields + [T.StructField("decoded", T.StringType())] * decoded)

    def parts(batches):
        for b in batches:
            for i, j in slices(text_buffer(b.column(b.schema.get_field_index(column)))[1], SLICE):
                yield b.slice(i, j - i)

    def run(batches):
        codec = Codec(proto.value)
        for b in parts(batches):
            flat, ends, same, texts = [], [0], [], []
            for t in b.column(b.schema.get_field_index(column)).to_pylist():
                ids = codec.encode(t)
                flat.extend(ids)
                ends.append(len(flat))
                back = codec.decode(ids)
                same.append(back == (t or ""))
                if decoded:
                    texts.append(back)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(flat, np.int32)))
            new = [lists, pa.array(np.diff(ends).astype(np.int32)), pa.array(same, pa.bool_())] + ([pa.array(texts, pa.string())] if decoded else [])
            yield pa.RecordBatch.from_arrays(list(b.columns) + new, names=[f.name for f in schema.fields])

    return map_arrow(docs, run, schema)


def op10_sentencepiece(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs).drop("text")
