"""SentencePiece encoding through tables of distinct chunks.

In the model's vocabulary the white-space marker stands only in front of a piece (or in a piece of
markers alone), so no piece crosses from a word into the next marker. A text therefore falls
into chunks, each a run of markers with the word behind it, whose pieces do not depend on their
neighbours. Each worker process keeps a bounded table of the chunks it has met (see packed), lets
the library segment the distinct new ones of about 2 MB of text at a time, and joins the ids back
by position. A vocabulary for which the property does not hold is refused.

One table for the whole corpus would segment a word once instead of once per worker, but joining ids
back by position would shuffle a row per word, many times the text; the library's share is small.

Defined results: a null or empty text has no ids and decodes to ''. Rows are independent, so repeated
rows, ties and null keys give a result each. A very long text is encoded whole and must fit in a task's
memory. An empty table gives no rows. Other columns of docs are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trailmark.llm.common import small_batches, stored
from trailmark.llm.packed import PackedTable
from trailmark.llm.shingles import chunks as runs

CHUNK = re.compile("[ ▁]+[^ ▁]*")


@lru_cache(maxsize=2)
def processor(model: str):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    crossing = [p for p in map(sp.id_to_piece, range(sp.get_piece_size())) if "▁" in p.lstrip("▁")]
    if crossing:
        raise ValueError(f"pieces cross white space markers: {crossing[:3]}")
    return sp


def chunks(text: str) -> list[str]:
    """Chunks of a text with the marker that the library puts in front of it."""
    return CHUNK.findall(" " + text) if text else []


class ChunkTable:
    """Ids of texts as bytes, through a table of chunks."""

    def __init__(self, model: str):
        self.sp = processor(model)
        self.kind = "<u2" if self.sp.get_piece_size() <= 1 << 16 else "<u4"
        self.marker = [self.sp.piece_to_id("▁")]  # a marker alone; the library leaves out an empty string
        self.text = list(map(str, range(self.sp.get_piece_size())))
        self.table = PackedTable(self._segment, self.kind)
        for probe in ("a  b ", "  a", "▁ b\n"):
            if self.encode([probe])[0].tolist() != self.sp.encode(probe):
                raise ValueError("the model changes white space, so chunks cannot stand alone")

    def _segment(self, new: list[str]) -> list[list[int]]:
        # the library puts one marker in front of what it is given, which the chunk has already
        found = self.sp.encode([c[1:] for c in new], num_threads=1)
        return [ids if len(c) > 1 else self.marker for c, ids in zip(new, found, strict=True)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(x, self.kind) for x in self.table.pack([chunks(t) for t in texts])]

    def digests(self, ids: np.ndarray) -> tuple[str, str, str]:
        """(SHA-256 of the decimal ids joined by commas, SHA-256 of the decoded text, decoded text)"""
        each = ids.tolist()
        decoded = self.sp.decode(each) if each else ""
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        return sha(",".join(map(self.text.__getitem__, each))), sha(decoded), decoded


@lru_cache(maxsize=1)
def chunk_table(model: str) -> ChunkTable:
    """One table per worker process, which its later tasks use again."""
    return ChunkTable(model)


SCHEMA = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_texts(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", *, ids: bool = False) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256), and with ids=True also ids and decoded, a row per row of docs."""
    kind = docs.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = chunk_table(model)
        for batch in batches:
            for a, b in runs(batch.column(1)):
                part = batch.slice(a, b - a)
                texts = [t or "" for t in part.column(1).to_pylist()]
                once = {t: i for i, t in enumerate(dict.fromkeys(texts))}  # equal texts are encoded once
                found = table.encode(list(once))
                told = list(map(table.digests, found))
                at = [once[t] for t in texts]
                cols = [part.column(0), pa.array([len(found[i]) for i in at], pa.int64()), pa.array([told[i][0] for i in at]), pa.array([told[i][1] for i in at])]
                names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    cols += [pa.array([found[i].tolist() for i in at], pa.list_(pa.int32())), pa.array([told[i][2] for i in at])]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names)

    out = docs.select(key, text).mapInArrow(work, f"`{key}` {kind}, {SCHEMA}" + ", ids array<int>, decoded string" * ids)
    with small_batches(docs.sparkSession):
        return stored(out, "pieces")
