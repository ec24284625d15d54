"""Token ids in length-delimited binary records, with an offset index.

One record is framed as in the TFRecord format: the length of the data (8
bytes, little endian), its masked CRC-32C (4 bytes), the data, the data's
masked CRC-32C (4 bytes).  The data are a document's token ids, little endian,
each of ``width`` bytes: 2 for a vocabulary of up to 65 536 ids, else 4.  The
index says which.  Every task writes one file of records; beside the files goes
an index table with the place of each record, so that a reader can shuffle
records over the whole set and read any one by a seek.

A file is written under a name of its own attempt and then renamed, and its
index rows are committed by Spark with the task, so that a task that runs
again or twice leaves whole files, and the index names those of the attempt
that counted.

Tokens are those of the byte-level BPE vocabulary at ``vocabulary`` (a
parameter; rank file of base64 tokens).

Nulls: a null or empty text is a record of no tokens; a null doc_id stays null
in the index.  Long texts are one record, whole.  Repeated rows are repeated
records.  An empty table gives an empty index.  Extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

import base64
import importlib.util
import os
import re
import struct
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgraph.llm.common import Columns, batches_of, shared_path, table

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for texts whose white space stands alone, between two other characters: without the look ahead it runs faster.
SINGLE = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"""
ODD = re.compile(r"\s\s|\s$")
INDEX = "doc_id bigint, file string, start_at bigint, bytes bigint, tokens bigint, checksum bigint, width int"


def default_vocabulary() -> str:
    root = importlib.util.find_spec("public_tokenizers").submodule_search_locations[0] if importlib.util.find_spec("public_tokenizers") else "/opt/tokenizers"
    return os.path.join(root, "byte_bpe_50k.tiktoken")


class Tokens:
    """Token ids of texts, as bytes."""

    def __init__(self, vocabulary: str):
        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        self.size = max(ranks.values()) + 1
        self.width = 2 if self.size <= 1 << 16 else 4
        self.whole = tiktoken.Encoding("whole", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.single = tiktoken.Encoding("single", pat_str=SINGLE, mergeable_ranks=ranks, special_tokens={})

    def of(self, text: str | None) -> bytes:
        """The text's token ids, ``width`` bytes each."""
        if not text:
            return b""
        odd = ODD.search(text) if not text.replace("\n", "").isprintable() else "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[-1] in " \n"
        return array("H" if self.width == 2 else "I", (self.whole if odd else self.single).encode_ordinary(text)).tobytes()


_tokens: dict[str, Tokens] = {}


def tokens_of(vocabulary: str) -> Tokens:
    """The worker's encoder for a vocabulary."""
    if vocabulary not in _tokens:
        _tokens[vocabulary] = Tokens(vocabulary)
    return _tokens[vocabulary]


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """CRC-32C of two bytes at once, and the CRC after BLOCK zero bytes, by byte of the CRC."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = (one >> 1) ^ np.where(one & 1, np.uint32(0x82F63B78), np.uint32(0)).astype(np.uint32)
    pair = np.arange(65536, dtype=np.uint32)
    for _ in range(2):
        pair = one[pair & 255] ^ (pair >> np.uint32(8))
    on = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * i) for i in range(4)])
    for _ in range(BLOCK // 2):
        on = pair[on & 65535] ^ (on >> np.uint32(16))
    return pair, on


BLOCK = 128
PAIR, ON = _tables()


def crc32c(data: list[bytes]) -> np.ndarray:
    """CRC-32C of every item, of an even number of bytes, by steps over all of them at once.

    Items are cut into blocks, the first filled up in front with zeros (which
    leave a CRC of 0 as it is; the start value is put on the first bytes), and
    the blocks' CRCs are joined: the CRC is linear.
    """
    n = len(data)
    sizes = np.fromiter(map(len, data), np.int64, n)
    blocks = np.maximum(1, -(-sizes // BLOCK))
    first = np.concatenate([[0], np.cumsum(blocks)])
    begin = first[1:] * BLOCK - sizes
    fill = bytes(BLOCK)
    raw = np.frombuffer(bytearray(b"".join([x for d, s in zip(data, sizes.tolist()) for x in (fill[:-s % BLOCK if s else BLOCK], d)])), np.uint8)
    for i in range(4):  # the start value 0xffffffff acts on the first four bytes
        some = sizes > i
        raw[begin[some] + i] ^= 255
    words = raw.view("<u2").reshape(-1, BLOCK // 2)
    c = np.zeros(len(words), np.uint32)
    for j in range(BLOCK // 2):
        c = PAIR[(c ^ words[:, j]) & np.uint32(65535)] ^ (c >> np.uint32(16))
    out = np.zeros(n, np.uint32)
    order = np.argsort(-blocks, kind="stable")
    start, many = first[:-1][order], blocks[order]
    total = np.zeros(n, np.uint32)
    for k in range(int(many[0]) if n else 0):
        live = int(np.searchsorted(-many, -k, "left"))
        t = total[:live]
        t = ON[0][t & 255] ^ ON[1][(t >> 8) & 255] ^ ON[2][(t >> 16) & 255] ^ ON[3][t >> 24]
        total[:live] = t ^ c[start[:live] + k]
    out[order] = total
    out ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(sizes < 4):  # too short for the start value
        out[i] = crc32c_plain(data[i])
    return out


def crc32c_plain(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c ^= b
        for _ in range(8):
            c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
    return c ^ 0xFFFFFFFF


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(0xA282EAD8)


def frame(data: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Framed records and the masked checksums of their data."""
    lengths = [struct.pack("<Q", len(d)) for d in data]
    heads, sums = masked(crc32c(lengths)), masked(crc32c(data))
    return [b"".join((n, h.tobytes(), d, s.tobytes())) for n, h, d, s in zip(lengths, heads, data, sums)], sums


def read_record(f, start: int, width: int = 2) -> np.ndarray:
    """The token ids of the record at ``start`` of an open file; raises ValueError if a checksum is wrong."""
    f.seek(start)
    head = f.read(12)
    size = struct.unpack("<Q", head[:8])[0]
    if int(masked(crc32c([head[:8]]))[0]) != struct.unpack("<I", head[8:])[0]:
        raise ValueError(f"the length at {start} is damaged")
    body = f.read(size + 4)
    if int(masked(crc32c([body[:size]]))[0]) != struct.unpack("<I", body[size:])[0]:
        raise ValueError(f"the record at {start} is damaged")
    return np.frombuffer(body[:size], f"<u{width}")


def file_system(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri) if "://" in uri else (pa.fs.LocalFileSystem(), uri.removeprefix("file:"))


def write_records(docs: DataFrame, folder: str, vocabulary: str | None = None) -> DataFrame:
    """Writes documents' token ids to files in ``folder``/data and their index to ``folder``/index; gives the index."""
    vocabulary = vocabulary or default_vocabulary()
    data = f"{folder}/data"
    fs, path = file_system(data)
    fs.create_dir(path, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_of(vocabulary)
        task = TaskContext.get()
        fs, path = file_system(data)
        name = f"part-{task.partitionId():06d}-{uuid.uuid4().hex[:12]}.records"
        at, index = 0, []
        with fs.open_output_stream(f"{path}/_{name}") as out:
            for b in (part for b in batches if b.num_rows for part in batches_of(b, "text")):
                held = [tokens.of(t) for t in b.column(1).to_pylist()]
                frames, sums = frame(held)
                sizes = np.fromiter(map(len, frames), np.int64, len(frames))
                starts = at + np.concatenate([[0], np.cumsum(sizes)[:-1]])
                out.write(b"".join(frames))
                at += int(sizes.sum())
                index.append(pa.RecordBatch.from_arrays([b.column(0), pa.array([name] * len(frames)), pa.array(starts), pa.array(sizes), pa.array((sizes - 16) // tokens.width), pa.array(sums.astype(np.int64)), pa.array(np.full(len(frames), tokens.width, np.int32))], ["doc_id", "file", "start_at", "bytes", "tokens", "checksum", "width"]))
        fs.move(f"{path}/_{name}", f"{path}/{name}")
        yield from index

    index = f"{folder}/index"
    Columns(docs, ["doc_id", "text"]).only().withColumn("doc_id", F.col("doc_id").try_cast("bigint")).mapInArrow(write, INDEX).write.parquet(index)
    return docs.sparkSession.read.schema(INDEX).parquet(index)


def op4_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of all documents' records, without the files' own names, which differ by run."""
    index = write_records(table(spark, sf_dir, "documents"), shared_path(spark, "records"))
    return index.withColumn("file", F.substring("file", 1, 11))


QUERIES = {"op4_binary_records": op4_binary_records}
ORACLE_SQL: dict[str, str] = {}
