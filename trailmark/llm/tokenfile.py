"""Token ids in files: frequency ranks in a byte-aligned code with separate control bytes.

Ids are replaced by their rank in the corpus (the most frequent is 0) and each rank takes one to
four bytes, little-endian. Two bits per id, four ids to a control byte, say how many; control and
data bytes stand apart, so a decoder finds all lengths by one table lookup and the data by a
running sum. A file is a sequence of blocks of whole documents:

    file   = MAGIC, u32 vocabulary size, u32 per rank: its id, blocks
    block  = u32 documents, u32 ids, u32 data bytes, i64 key per document, u32 length per
             document, control bytes, data bytes            (all little-endian)

Text is cut where the pre-tokenizer always cuts, between words, marks and white space; each worker process
keeps a bounded table of the units it has met (see packed) and asks the library for the new ones of about
2 MB of text at a time. Texts that hold a special token's string go to the library as a whole.

Defined results: a null or empty text is its end id alone. Documents are ordered by key, and rows that
repeat a key by their ids; a null key is refused, since the files are ordered by it. A very long text
is encoded whole, in a batch and a block of its own, and must fit in a task's memory. An empty table gives no
files and no rows. Other columns of docs are not read, so their names cannot clash.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmark.llm.common import shared_dir, small_batches, stored
from trailmark.llm.files import WholeFile, as_uri, made, read_files
from trailmark.llm.packed import PackedTable
from trailmark.llm.shingles import chunks

MAGIC = b"RKVB0001"
#: Fixed value: white space as the byte-level pre-tokenizer sees it.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Characters that the pre-tokenizer parts from letters and digits on either side; an apostrophe may begin a contraction.
MARKS = re.escape('!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~')
LETTERS = "A-Za-z0-9À-ÖØ-öø-ÿ"
#: Letters and digits up to a mark or white space, with the blank before them; any other run up to white space; white
#: space up to such a blank. The pre-tokenizer cuts these units further, but never joins two of them.
UNIT = re.compile(f" ?[{LETTERS}]+(?![^{SPACE}{MARKS}])| ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
WORD = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Byte -> the character that stands for it in the vocabulary: itself if it is visible in Latin-1, the others count up from 256.
_VISIBLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
AS_CHARS = {b: b for b in _VISIBLE} | {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - _VISIBLE))}
#: Bytes of a generation of a worker's table of units.
TABLE = 64 << 20
IDS_PER_FILE, IDS_PER_BLOCK = 4_000_000, 500_000
#: Bytes of each of the four ids that a control byte speaks of.
LENGTHS = (((np.arange(256)[:, None] >> np.arange(0, 8, 2)) & 3) + 1).astype(np.uint8)


@lru_cache(maxsize=2)
def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def id_type(path: str) -> str:
    """The little-endian type that holds every id of the vocabulary."""
    return "<u2" if tokenizer(path).get_vocab_size() <= 1 << 16 else "<u4"


class UnitTable:
    """Ids of texts as bytes, through a table of units."""

    def __init__(self, path: str):
        self.tk, self.kind = tokenizer(path), id_type(path)
        self.special = [t.content for t in self.tk.get_added_tokens_decoder().values()]
        self.table = PackedTable(self._units, self.kind, TABLE)
        self.model = self.tk.model

    def _units(self, units: list[str]) -> list[list[int]]:
        # a run of letters is one word of the pre-tokenizer, which the library's model takes as it is, byte by byte
        rest = [u for u in units if not WORD.fullmatch(u)]
        found = dict(zip(rest, (e.ids for e in self.tk.encode_batch_fast(rest, add_special_tokens=False)), strict=True))
        tokens = self.model.tokenize
        return [found[u] if u in found else [t.id for t in tokens(u.encode().decode("latin-1").translate(AS_CHARS))] for u in units]

    def encode(self, texts: list[str]) -> list[bytes]:
        # equal texts are encoded once; a text with the string of a special token is one unit, which stays out of the table
        whole = {t for t in texts if any(s in t for s in self.special)}
        plain = [t for t in dict.fromkeys(texts) if t not in whole]
        found = dict(zip(plain, self.table.pack([UNIT.findall(t) for t in plain]), strict=True))
        for t in whole:
            found[t] = np.array(self.tk.encode(t, add_special_tokens=False).ids, self.kind).tobytes()
        return [found[t] for t in texts]


@lru_cache(maxsize=1)
def unit_table(path: str) -> UnitTable:
    """One table per worker process, which its later tasks use again."""
    return UnitTable(path)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes)"""
    r = ranks.astype("<u4")
    top = int(r.max(initial=0))
    width = max(1, -(-top.bit_length() // 8))  # bytes that any of them takes
    longer = [r >= 1 << 8 * k for k in range(1, width)]
    four = np.zeros(-(-len(r) // 4) * 4, np.uint8)
    for x in longer:
        four[: len(r)] += x
    control = four[::4] | four[1::4] << 2 | four[2::4] << 4 | four[3::4] << 6
    has = np.ones((len(r), width), bool)
    for k, x in enumerate(longer, 1):
        has[:, k] = x
    return control.tobytes(), r.view(np.uint8).reshape(-1, 4)[:, :width][has].tobytes()


def decode_ranks(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    size = LENGTHS[control].ravel()[:n]
    at = np.cumsum(size, dtype=np.int64) - size
    out = data[at].astype(np.uint32)
    for k in range(1, int(size.max(initial=1))):
        has = np.flatnonzero(size > k)
        out[has] |= data[at[has] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def token_ids(docs: DataFrame, tokenizer_path: str, *, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n, ids): ids of each text with the end id, as bytes of the type id_type."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = unit_table(tokenizer_path)
        end = np.array([end_id], table.kind).tobytes()
        for batch in batches:
            for a, b in chunks(batch.column(1)):
                part = batch.slice(a, b - a)
                found = [x + end for x in table.encode([t or "" for t in part.column(1).to_pylist()])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) // len(end) for x in found], pa.int64()), pa.array(found, pa.binary())], ["key", "n", "ids"])

    return docs.select(F.col(key).cast("long"), text).mapInArrow(work, "key long, n long, ids binary")


def frequencies(ids: DataFrame, vocabulary: int, kind: str) -> DataFrame:
    """(id, n) over all documents: one row per id and task, then summed."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            every = b"".join(batch.column(0).to_pylist())
            total += np.bincount(np.frombuffer(every, kind), minlength=vocabulary)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], ["id", "n"])

    return ids.select("ids").mapInArrow(work, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_files(docs: DataFrame, tokenizer_path: str, folder: str, *, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the corpus in key order; returns (file, docs, ids) per file, already written."""
    folder = made(folder)
    with small_batches(docs.sparkSession):
        ids = stored(token_ids(docs, tokenizer_path, end_id=end_id, key=key, text=text), "token-ids", "zstd")
    if ids.where("key is null").limit(1).count():
        raise ValueError("token files are ordered by key, which may not be null")
    vocabulary = tokenizer(tokenizer_path).get_vocab_size()
    kind = id_type(tokenizer_path)
    counted = frequencies(ids, vocabulary, kind).orderBy(F.desc("n"), "id").collect()  # at most a row per vocabulary entry
    by_rank = np.array([r["id"] for r in counted], "<u4")
    rank = np.zeros(vocabulary, np.uint32)
    rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    total = sum(r["n"] for r in counted)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        n_docs = n_ids = 0
        with WholeFile(folder, f"part-{number:06d}.rkvb") as out:
            out.write(MAGIC + np.uint32(len(by_rank)).tobytes() + by_rank.tobytes())
            keys, rows, held = [], [], 0

            def flush() -> None:
                r = rank[np.concatenate(rows)]
                control, data = encode_ranks(r)
                out.write(np.array([len(keys), len(r), len(data)], "<u4").tobytes() + np.array(keys, "<i8").tobytes() + np.array([len(x) for x in rows], "<u4").tobytes() + control + data)

            for batch in batches:
                for k, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    keys.append(k)
                    rows.append(np.frombuffer(x.as_py(), kind))
                    held += len(rows[-1])
                    n_docs, n_ids = n_docs + 1, n_ids + len(rows[-1])
                    if held >= IDS_PER_BLOCK:
                        flush()
                        keys, rows, held = [], [], 0
            if rows:
                flush()
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([n_docs], pa.int64()), pa.array([n_ids], pa.int64())], ["file", "docs", "ids"])

    n = max(1, -(-total // IDS_PER_FILE))
    ordered = ids.select("key", "ids", F.xxhash64("ids").alias("tie")).repartitionByRange(n, "key", "tie").sortWithinPartitions("key", "tie")
    return stored(ordered.select("key", "ids").mapInArrow(work, "file int, docs long, ids long"), "token-files")


def decode_file(content: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, lengths, ids) of each block."""
    if content[:8] != MAGIC:
        raise ValueError("not a token file")
    raw = np.frombuffer(content, np.uint8)
    u4 = lambda at, n: raw[at : at + 4 * n].view("<u4")
    size = int(np.frombuffer(content, "<u4", 1, 8)[0])
    by_rank, at = np.frombuffer(content, "<u4", size, 12), 12 + 4 * size
    while at < len(raw):
        n_docs, n_ids, n_data = map(int, np.frombuffer(content, "<u4", 3, at))
        keys = np.frombuffer(content, "<i8", n_docs, at + 12)
        lengths = np.frombuffer(content, "<u4", n_docs, at + 12 + 8 * n_docs)
        at += 12 + 12 * n_docs
        n_control = -(-n_ids // 4)
        if at + n_control + n_data > len(raw) or int(lengths.sum()) != n_ids:
            raise ValueError("a token file is cut short")
        yield keys, lengths, by_rank[decode_ranks(raw[at : at + n_control], raw[at + n_control : at + n_control + n_data], n_ids)]
        at += n_control + n_data


def read_tokens(spark, folder: str, files: DataFrame, *, ids: bool = False) -> DataFrame:
    """(key, start, n_tokens, ids_crc32[, ids]) of all documents of a folder; start counts the ids before it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                number, before = int(path.rsplit("part-", 1)[1][:6]), 0
                for keys, lengths, found in decode_file(content.as_buffer().to_pybytes()):
                    ends = np.cumsum(lengths, dtype=np.int64)
                    parts = np.split(found.astype("<u4"), ends[:-1])
                    cols = [pa.array(np.full(len(keys), number, np.int32)), pa.array(keys), pa.array(before + ends - lengths), pa.array(lengths.astype(np.int64)), pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64())]
                    if ids:
                        cols.append(pa.array([p.astype(np.int64) for p in parts], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(cols, ["file", "key", "before", "n_tokens", "ids_crc32", "ids"][: len(cols)])
                    before += int(ends[-1])

    rows = read_files(spark, folder, ".rkvb").mapInArrow(work, "file int, key long, before long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids)
    ahead = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row per file of IDS_PER_FILE ids
    first = files.select("file", F.coalesce(F.sum("ids").over(ahead), F.lit(0)).alias("first"))
    out = rows.join(first, "file").withColumn("start", F.col("first") + F.col("before"))
    return out.select("key", "start", "n_tokens", "ids_crc32", *["ids"] * ids)


def round_trip(docs: DataFrame, tokenizer_path: str, *, end_id: int = 0) -> DataFrame:
    spark = docs.sparkSession
    folder = as_uri(shared_dir(spark, "tokens"))
    files = write_files(docs, tokenizer_path, folder, end_id=end_id)
    return read_tokens(spark, folder, files)
