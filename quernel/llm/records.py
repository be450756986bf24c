"""Token-ID / binary output: length-delimited records of token ids in shards, with an offset index for shuffled reads.

A record is framed as: length of the payload (8 bytes), masked CRC-32C of these, payload, masked CRC-32C of the payload;
little-endian, the mask being rotation right by 15 bits plus 0xa282ead8. The payload holds the ids as 2-byte numbers if
the vocabulary has at most 65,536 ids, else as 4-byte ones. A shard is what one partition of the input yields, in its
order, so no data move; a record's offset is its place in the shard's file. in_file_order() numbers shards by the place of
their rows in the files of a table instead, so that the shards' order is that in which the table was written.

encode() returns a row per document: shard, seq, doc_id, n_tokens, offset, size (of the frame), record (the frame).
write_shards() writes the frames of each shard one behind the other to shard-NNNNN.rec, and the index (shard, seq,
doc_id, n_tokens, offset, size) as a Parquet table beside them; read_record() fetches one record by its index row.
Files appear under their names only when complete, and a task that runs again writes the same file.

Token ids are those of a file of ranks: an argument, else the setting spark.quernel.tokenizer.ranks, else RANKS.

Null texts give no tokens, as empty ones do: an empty record (with end only, if an end id is given). A null doc_id stays
null. Repeated rows give a record each. Extra columns are ignored; an empty table gives no records.
"""

from __future__ import annotations

import base64
import os
import struct
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm import _spark, _text

RANKS, SETTING = "/opt/tokenizers/byte_bpe_50k.tiktoken", "spark.quernel.tokenizer.ranks"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of a lane of the checksum.
LANE = 64


def _crc_tables() -> np.ndarray:
    t = np.zeros((4, 256), np.uint32)
    for i in range(256):
        c = i
        for _ in range(8):
            c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
        t[0, i] = c
    for k in range(1, 4):
        t[k] = (t[k - 1] >> np.uint32(8)) ^ t[0][t[k - 1] & np.uint32(255)]
    return t


_T = _crc_tables()


def _steps(state: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Takes in four bytes of each lane at a time; words: a row for each step."""
    for w in words:
        x = state ^ w
        state = _T[3][x & 255] ^ _T[2][(x >> 8) & 255] ^ _T[1][(x >> 16) & 255] ^ _T[0][x >> 24]
    return state


def _shifts() -> np.ndarray:
    """What LANE zero bytes do to a state, by its four bytes."""
    state = np.array([[np.uint32(b << (8 * k)) for b in range(256)] for k in range(4)], np.uint32).reshape(-1)
    return _steps(state, np.zeros((LANE // 4, len(state)), np.uint32)).reshape(4, 256)


_SHIFT = _shifts()


def crc32c(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """CRC-32C of each of the byte strings data[offs[i]:offs[i+1]]."""
    n = np.diff(offs)
    if not len(n):
        return np.zeros(0, np.uint32)
    # each string is moved to the end of whole lanes: zeros in front leave a zero state as it is
    lanes = np.maximum(1, -(-n // LANE))
    first = np.concatenate([[0], np.cumsum(lanes)])
    buf = np.zeros(int(first[-1]) * LANE, np.uint8)
    start = first[1:] * LANE - n
    at = np.repeat(start - offs[:-1], n) + np.arange(offs[0], offs[-1])
    buf[at] = data[offs[0] : offs[-1]]
    head = np.minimum(n, 4)  # the initial state of ones is xored to the first four bytes
    for k in range(4):
        buf[start[head > k] + k] ^= 0xFF
    words = np.ascontiguousarray(buf.view("<u4").reshape(-1, LANE // 4).T)
    state = _steps(np.zeros(words.shape[1], np.uint32), words)
    out = state[first[:-1]]
    live = np.flatnonzero(lanes > 1)
    k = 1
    while len(live):
        x = out[live]
        x = _SHIFT[0][x & 255] ^ _SHIFT[1][(x >> 8) & 255] ^ _SHIFT[2][(x >> 16) & 255] ^ _SHIFT[3][x >> 24]
        out[live] = x ^ state[first[live] + k]
        k += 1
        live = live[lanes[live] > k]
    out ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(n < 4):  # too short for the initial state: by the table
        c = 0xFFFFFFFF
        for b in data[offs[i] : offs[i + 1]].tolist():
            c = (c >> 8) ^ int(_T[0][(c ^ b) & 255])
        out[i] = c ^ 0xFFFFFFFF
    return out


def mask(crc: np.ndarray) -> np.ndarray:
    crc = crc.astype(np.uint32)
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(0xA282EAD8)


def frames(payload: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All records of the payloads payload[offs[i]:offs[i+1]] (bytes), and each record's start (with the end at last)."""
    n = np.diff(offs)
    out_offs = np.concatenate([[0], np.cumsum(n + 16)])
    out = np.zeros(int(out_offs[-1]), np.uint8)
    heads = np.ascontiguousarray(n.astype("<u8")).view(np.uint8)
    crc_n = mask(crc32c(heads, np.arange(len(n) + 1) * 8)).astype("<u4").view(np.uint8).reshape(-1, 4)
    crc_p = mask(crc32c(payload, offs)).astype("<u4").view(np.uint8).reshape(-1, 4)
    out[(out_offs[:-1, None] + np.arange(8)).reshape(-1)] = heads
    out[out_offs[:-1, None] + np.arange(8, 12)] = crc_n
    out[np.repeat(out_offs[:-1] + 12 - offs[:-1], n) + np.arange(offs[0], offs[-1])] = payload[offs[0] : offs[-1]]
    out[out_offs[1:, None] + np.arange(-4, 0)] = crc_p
    return out, out_offs


def unframe(record: bytes) -> bytes:
    """The payload of a record; raises ValueError if a checksum or a length is wrong."""
    if len(record) < 16:
        raise ValueError("truncated record")
    (n,), (c,) = struct.unpack("<Q", record[:8]), struct.unpack("<I", record[8:12])

    def right(data: bytes, crc: int) -> bool:
        return int(mask(crc32c(np.frombuffer(data, np.uint8), np.array([0, len(data)])))[0]) == crc

    if not right(record[:8], c) or len(record) != n + 16:
        raise ValueError("wrong length")
    if not right(record[12:-4], struct.unpack("<I", record[-4:])[0]):
        raise ValueError("wrong checksum")
    return record[12:-4]


def tokenizer(ranks: dict[bytes, int], pattern: str = PATTERN):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def load_ranks(path: str = RANKS) -> dict[bytes, int]:
    if not os.path.exists(path):
        raise FileNotFoundError(f"no tokenizer ranks at {path}; name a file in {SETTING} or as an argument")
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


FIELDS = "shard int, seq long, doc_id long, n_tokens long, offset long, size long, record binary"


def in_file_order(docs: DataFrame, name: str) -> DataFrame:
    """docs, read from files as they are, with a column of that name: the place of the row's part of a file, by path and start."""
    at = docs.select("*", F.col("_metadata.file_path").alias(f := _spark.fresh(docs, "file")), F.col("_metadata.file_block_start").alias(s := _spark.fresh(docs, "start")))
    parts = sorted(at.select(f, s).distinct().collect())  # as many as tasks read the table
    order = docs.sparkSession.createDataFrame([(*r, k) for k, r in enumerate(parts)], f"`{f}` string, `{s}` long, `{name}` int")
    return at.join(F.broadcast(order), [f, s]).select(*docs.columns, name)


def _framing(docs: DataFrame, ranks_path: str | None, end_id: int | None, shard: str | None):
    """What encode() reads of docs, and what makes batches of records of it."""
    spark = _spark.session(docs)
    ranks = load_ranks(ranks_path or spark.conf.get(SETTING, RANKS))
    kind = "<u2" if max(len(ranks) - 1, end_id or 0) < 1 << 16 else "<u4"
    shared = spark.sparkContext.broadcast(ranks)  # of fixed size: the vocabulary
    end = [] if end_id is None else [end_id]

    def run(batches):
        enc = tokenizer(shared.value)
        last, seq, offset = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            shards = np.full(b.num_rows, last, np.int32) if shard is None else b.column(2).to_numpy()
            edges = sorted({*range(0, b.num_rows, 500), *(np.flatnonzero(np.diff(shards)) + 1).tolist(), b.num_rows})
            for lo, hi in zip(edges, edges[1:]):
                part = b.slice(lo, hi - lo)
                if shards[lo] != last:
                    last, seq, offset = int(shards[lo]), 0, 0
                ids = [np.array(enc.encode_ordinary(t or "") + end, kind) for t in part.column(1).to_pylist()]
                n = np.array([len(x) for x in ids])
                width = np.dtype(kind).itemsize
                payload = np.ascontiguousarray(np.concatenate(ids).astype(kind)).view(np.uint8)
                data, offs = frames(payload, np.concatenate([[0], np.cumsum(n * width)]))
                record = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(n), last, np.int32)),
                        pa.array(np.arange(seq, seq + len(n))),
                        part.column(0),
                        pa.array(n),
                        pa.array(offset + offs[:-1]),
                        pa.array(np.diff(offs)),
                        record.cast(pa.binary()),
                    ],
                    ["shard", "seq", "doc_id", "n_tokens", "offset", "size", "record"],
                )
                seq += len(n)
                offset += int(offs[-1])

    columns = [F.col("doc_id").cast("long").alias("doc_id"), "text"] + ([] if shard is None else [F.col(shard).cast("int").alias("shard")])
    return docs.select(*columns), run


def encode(docs: DataFrame, ranks_path: str | None = None, end_id: int | None = None, shard: str | None = None) -> DataFrame:
    """Records of docs (doc_id, text); see the module for the result. end_id is put behind each sequence, if given. shard: a
    column of shard numbers, the rows of each of which follow each other in one partition."""
    texts, run = _framing(docs, ranks_path, end_id, shard)
    return texts.mapInArrow(_text.tidy(run), FIELDS)


def _place(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder.removeprefix("file:"))


def write_shards(docs: DataFrame, folder: str, ranks_path: str | None = None, end_id: int | None = None, shard: str | None = None) -> DataFrame:
    """Writes shards and their index under folder, which all executors must share; returns the index. The rest as for encode()."""
    texts, frame = _framing(docs, ranks_path, end_id, shard)

    def run(batches):
        fs, base = _place(folder)
        fs.create_dir(base, recursive=True)
        out, temp, last = None, "", None

        def close():
            if out is not None:
                out.close()
                fs.move(temp, f"{base}/shard-{last:05d}.rec")

        for b in frame(batches):
            shards = b.column(0).to_numpy()
            edges = np.flatnonzero(np.append(True, np.diff(shards) != 0)).tolist() if len(shards) else []
            for lo, hi in zip(edges, [*edges[1:], len(shards)]):
                if out is None or shards[lo] != last:
                    close()
                    last, temp = int(shards[lo]), f"{base}/_writing-{uuid.uuid4().hex}"
                    out = fs.open_output_stream(temp)
                data, _ = _text.raw(b.column(6).slice(lo, hi - lo))
                out.write(memoryview(np.ascontiguousarray(data)))
            yield b.select(range(6))
        close()

    index = texts.mapInArrow(_text.tidy(run), FIELDS.removesuffix(", record binary"))
    at = folder if "://" in folder else f"file://{os.path.abspath(folder)}"
    index.write.parquet(f"{at}/index")
    fs, base = _place(folder)
    for f in fs.get_file_info(pafs.FileSelector(base)):
        if f.base_name.startswith("_writing-"):  # of a task that broke off
            fs.delete_file(f.path)
    return docs.sparkSession.read.parquet(f"{at}/index")


def read_record(folder: str, shard: int, offset: int, size: int, width: int = 2) -> list[int]:
    """Token ids of one record, its checksums verified; width: bytes of an id."""
    fs, base = _place(folder)
    with fs.open_input_file(f"{base}/shard-{shard:05d}.rec") as f:
        return np.frombuffer(unframe(f.read_at(size, offset)), f"<u{width}").tolist()
