"""Token ids in training order: fixed-stride binary shards of randomly placed sequences.

1. Documents are tokenized, ended with token 50256 and cut into sequences of ``LENGTH`` tokens,
   which are written to the shared folder once, a batch of them in a row, with their partition and the first one's number there.
2. The counts of the partitions give each sequence a dense index, which a keyed Feistel network over the
   next power of four permutes; values outside the range walk on through the permutation until they
   are inside, so slots are a permutation of 0..N-1.
3. Records are partitioned by ranges of slots, whole shards to a partition, and sorted: one shuffle, no
   sampling. A task puts its records for a range together and compresses them before they are shuffled. Frequent tokens take one
   byte there and in the written table, others two or three: by their counts in the batch, and in all documents. A record is ``2 + 2 * LENGTH`` bytes: the token count and the ids, 16 bits each in little-endian
   order, then zeros. So slot s is at byte ``(s % SLOTS) * stride`` of shard ``s // SLOTS``, and a reader
   resumes at any slot with one seek.
4. Each partition writes its shards to files in the shared folder and returns their records as read from them.

The slots depend on the key, the number of sequences and the order in which partitions hold them; written
tables fix that order, so a retried task repeats it.

Defined results: null id: row ignored. Null or empty text: no sequence. Texts of any length are tokenized
whole. Repeated rows are separate documents. Fewer sequences than a shard: the last shard is
short. An empty table gives no records and no file. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import Scratch, ship
from . import _tokens as T
from ._arrow import fixed_binary, select_text

#: A row of the written table is large; with these options few are held in memory at once.
LARGE_ROWS = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1"}
#: Ranks below this take one byte; the other values of that byte but 255 take one more, which reaches up to rank ONE + (255 - ONE) * 256.
ONE = 224
#: Bytes of records that a task puts together at once.
HELD = 64 << 20
LENGTH, SLOTS, SHARDS_PER_TASK, KEY, ROUNDS = 512, 4096, 8, 0x5EED_CAFE, 8


def feistel(x: np.ndarray, n: int, key: int = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """A permutation of 0..n-1, keyed: a balanced Feistel network with cycle-walking."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = np.random.default_rng(key).integers(0, 1 << 63, rounds, dtype=np.int64).astype(np.uint64)

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> shift, v & mask
        for k in keys:
            f = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            f ^= f >> np.uint64(29)
            f *= np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ (f >> np.uint64(32) & mask)
        return left << shift | right

    out = once(np.asarray(x).astype(np.uint64))
    while len(out_of := np.flatnonzero(out >= np.uint64(n))):
        out[out_of] = once(out[out_of])
    return out.astype(np.int64)


def pack(tokens: np.ndarray, rank: np.ndarray) -> bytes:
    """Tokens by their ranks: all first bytes, then all second ones, then the ranks, 16 bits each, of those whose first byte is 255."""
    x = rank[tokens]
    first = np.where(x < ONE, x, np.minimum(ONE + (x - ONE >> 8), 255)).astype(np.uint8)
    return first.tobytes() + (x[(first >= ONE) & (first < 255)] - ONE & 255).astype(np.uint8).tobytes() + x[first == 255].astype("<u2").tobytes()


def unpack(data: bytes, n: int, order: np.ndarray) -> np.ndarray:
    """The n tokens that ``pack`` took; order: the tokens by rank."""
    first = np.frombuffer(data, np.uint8, n)
    x, two, rest = first.astype(np.int32), np.flatnonzero((first >= ONE) & (first < 255)), first == 255
    x[two] = ONE + (x[two] - ONE << 8) + np.frombuffer(data, np.uint8, len(two), n)
    x[rest] = np.frombuffer(data, "<u2", -1, n + len(two)) if rest.any() else 0
    return order[x]


def ranks(order: np.ndarray) -> np.ndarray:
    """The rank of each token that is in order."""
    out = np.zeros(1 << 16, np.int32)
    out[order] = np.arange(len(order))
    return out


_SEQUENCE = np.dtype([("part", "<i4"), ("n_tokens", "<i4"), ("doc_id", "<i8")])


def sequences(df: DataFrame, id_col: str, text_col: str, vocabulary: str, length: int) -> DataFrame:
    """(pid, row, n, head, order, counts, body) of all documents, n sequences in a row: its tokens by falling counts, the counts, and the packed tokens."""
    data = T.ship_vocabulary(df.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, pid, row, zstd = T.encoder(data.value), TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(level=9)
        for b in batches:
            head, pieces = [], []
            for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = t.as_py()
                if not text:
                    continue
                tokens = np.append(T.encode(e, text), T.END).astype("<u2")
                head += [(k // length, min(length, len(tokens) - k), d) for k in range(0, len(tokens), length)]
                pieces.append(tokens)
            if head:
                n, tokens = len(head), np.concatenate(pieces)
                counts = np.bincount(tokens, minlength=1 << 16)
                order = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)]
                columns = [order.astype("<u2").tobytes(), counts[order].astype("<i8").tobytes(), pack(tokens, ranks(order))]
                columns = [pa.array([zstd.compress(x)], pa.binary()) for x in (np.array(head, _SEQUENCE).tobytes(), *columns)]
                yield pa.RecordBatch.from_arrays([pa.array([pid], pa.int32()), pa.array([row]), pa.array([n]), *columns], ["pid", "row", "n", "head", "order", "counts", "body"])
                row += n

    return select_text(df, id_col, text_col).mapInArrow(run, "pid int, row long, n long, head binary, order binary, counts binary, body binary")


def _token_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, n) of rows (order, counts)."""
    zstd, total = zstandard.ZstdDecompressor(), np.zeros(1 << 16, np.int64)
    for b in batches:
        for order, counts in zip(*(c.to_pylist() for c in b.columns), strict=True):
            total[np.frombuffer(zstd.decompress(order), "<u2")] += np.frombuffer(zstd.decompress(counts), "<i8")
    found = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], ["token", "n"])


def training_order(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = T.VOCABULARY, length: int = LENGTH, slots: int = SLOTS, key: int = KEY) -> DataFrame:
    """(slot, shard, offset, doc_id, part, n_tokens, record), partitioned by ranges of slots and sorted within them."""
    if not 1 <= length <= 65535:
        raise ValueError("length must be 1..65535")
    spark = df.sparkSession
    ship(spark)
    saved = Scratch(spark, "tokens").save(sequences(df, id_col, text_col, vocabulary, length), "sequences", **LARGE_ROWS)
    # One row for each input partition comes to the driver.
    sizes = {r[0]: r[1] for r in saved.groupBy("pid").agg(F.max(F.col("row") + F.col("n"))).collect()}
    # And one for each token that there is.
    counts = saved.select("order", "counts").mapInArrow(_token_counts, "token int, n long").groupBy("token").agg(F.sum("n")).collect()
    order = np.array([t for t, _ in sorted(counts, key=lambda r: (-r[1], r[0]))], "<u2")
    pids = np.int64(sorted(sizes))
    starts = np.concatenate(([0], np.cumsum([sizes[p] for p in pids.tolist()]))).astype(np.int64)
    n = int(starts[-1])
    first = spark.sparkContext.broadcast((pids, starts, order))

    per = slots * SHARDS_PER_TASK
    partitions = max(1, -(-n // per))
    parcels = saved.select("pid", "row", "head", "order", "body").mapInArrow(partial(_parcels, first=first, n=n, key=key, per=per), "range int, head binary, body binary")
    whole = partial(_unpack, first=first, per=per, slots=slots, length=length)
    return parcels.repartitionById(partitions, "range").mapInArrow(whole, "slot long, shard long, offset long, doc_id long, part int, n_tokens int, record binary")


_HEAD = np.dtype([("at", "<i4"), *_SEQUENCE.descr])


def _parcels(batches: Iterator[pa.RecordBatch], first: Broadcast, n: int, key: int, per: int) -> Iterator[pa.RecordBatch]:
    """Sequences given their slots and put together by ranges of ``per`` slots, compressed: (range, head, body), so that much less is shuffled."""
    pids, starts, order = first.value
    rank, held, size = ranks(order), [], 0
    zstd, unzstd = zstandard.ZstdCompressor(level=9), zstandard.ZstdDecompressor()

    def flush() -> pa.RecordBatch:
        index, rows, tokens = (np.concatenate(x) for x in zip(*held, strict=True))
        slot = feistel(index, n, key)
        by = np.argsort(slot)
        slot, end = slot[by], np.cumsum(rows["n_tokens"], dtype=np.int64)[by]
        head, of = np.empty(len(slot), _HEAD), slot // per
        head["at"] = slot - of * per
        for c in _SEQUENCE.names:
            head[c] = rows[c][by]
        tokens = np.concatenate([tokens[e - k : e] for e, k in zip(end.tolist(), head["n_tokens"].tolist(), strict=True)])
        offset = np.concatenate(([0], np.cumsum(head["n_tokens"], dtype=np.int64)))
        begin = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        ends = [*begin[1:].tolist(), len(of)]
        parcels = [(zstd.compress(head[i:j].tobytes()), zstd.compress(pack(tokens[offset[i] : offset[j]], rank))) for i, j in zip(begin.tolist(), ends, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(of[begin].astype(np.int32)), pa.array([r[0] for r in parcels], pa.binary()), pa.array([r[1] for r in parcels], pa.binary())], ["range", "head", "body"])

    for b in batches:
        for pid, row, head, own, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
            rows = np.frombuffer(unzstd.decompress(head), _SEQUENCE)
            tokens = unpack(unzstd.decompress(body), int(rows["n_tokens"].sum(dtype=np.int64)), np.frombuffer(unzstd.decompress(own), "<u2"))
            held.append((starts[np.searchsorted(pids, pid)] + row + np.arange(len(rows)), rows, tokens))
            size += tokens.nbytes + rows.nbytes
            if size >= HELD:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def _unpack(batches: Iterator[pa.RecordBatch], first: Broadcast, per: int, slots: int, length: int) -> Iterator[pa.RecordBatch]:
    """The records of the partition's ranges of slots, in their order and padded to the stride; a range is at most ``per`` records."""
    zstd, found, order = zstandard.ZstdDecompressor(), {}, first.value[2]
    for b in batches:
        for r, head, body in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
            found.setdefault(r, []).append((head, body))
    for r in sorted(found):
        heads, tokens = [], []
        for h, b in found.pop(r):
            heads.append(np.frombuffer(zstd.decompress(h), _HEAD))
            tokens.append(unpack(zstd.decompress(b), int(heads[-1]["n_tokens"].sum(dtype=np.int64)), order))
        head, tokens = np.concatenate(heads), np.concatenate(tokens)
        end, by = np.cumsum(head["n_tokens"], dtype=np.int64), np.argsort(head["at"])
        for lo in range(0, len(by), 1024):
            rows = by[lo : lo + 1024]
            size = head["n_tokens"][rows]
            record = np.zeros((len(rows), 1 + length), "<u2")
            record[:, 0] = size
            record[:, 1:][np.arange(length) < size[:, None]] = np.concatenate([tokens[e - k : e] for e, k in zip(end[rows].tolist(), size.tolist(), strict=True)])
            slot = head["at"][rows].astype(np.int64) + r * per
            columns = [pa.array(x) for x in (slot, slot // slots, slot % slots * record.strides[0], head["doc_id"][rows], head["part"][rows], size)]
            yield pa.RecordBatch.from_arrays([*columns, fixed_binary(record)], ["slot", "shard", "offset", "doc_id", "part", "n_tokens", "record"])


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def write_shards(records: DataFrame, folder: str) -> DataFrame:
    """Write the records of ``training_order`` to one file a shard, in a folder (URI) that all executors share.

    Returns (shard, first_slot, n_slots, bytes, crc32). A file appears whole or not at all, so a lost or repeated task
    does no harm; the files are written when the result is first computed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        now, out, crc, size, first, count = None, None, 0, 0, 0, 0

        def close() -> pa.RecordBatch:
            out.close()
            system.move(f"{root}/.{shard_name(now)}.{attempt}", f"{root}/{shard_name(now)}")
            return pa.RecordBatch.from_pydict({"shard": pa.array([now]), "first_slot": pa.array([first]), "n_slots": pa.array([count]), "bytes": pa.array([size]), "crc32": pa.array([crc])})

        for b in batches:
            for slot, shard, record in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if shard != now:
                    if now is not None:
                        yield close()
                    now, crc, size, first, count = shard, 0, 0, slot, 0
                    out = system.open_output_stream(f"{root}/.{shard_name(now)}.{attempt}")
                data = record.as_py()
                out.write(data)
                crc, size, count = zlib.crc32(data, crc), size + len(data), count + 1
        if now is not None:
            yield close()

    return records.select("slot", "shard", "record").mapInArrow(run, "shard long, first_slot long, n_slots long, bytes long, crc32 long")


def stored_records(records: DataFrame, folder: str) -> DataFrame:
    """The records of ``training_order`` as they are read back from their shard files, each with its file (URI).

    A task writes a shard as ``write_shards`` does, reads the finished file again and compares it with what was
    written; so a record that is returned is one that ``read_shards`` finds. The files are written when the result is first
    computed, and stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        now, out, crc, held = None, None, 0, []

        def close() -> Iterator[pa.RecordBatch]:
            out.close()
            path = f"{root}/{shard_name(now)}"
            system.move(f"{root}/.{shard_name(now)}.{attempt}", path)
            with system.open_input_stream(path) as f:
                data = f.read()
            if zlib.crc32(data) != crc:
                raise OSError(f"{path} doesn't hold what was written")
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            values = np.frombuffer(data, np.uint8).reshape(len(rows), -1)
            names = pa.array([f"{folder}/{shard_name(now)}"] * len(rows))
            yield pa.RecordBatch.from_arrays([*rows.columns, fixed_binary(values), names], [*rows.schema.names, "record", "file"])

        for b in batches:
            shards = b.column(1).to_numpy()
            cuts = np.flatnonzero(np.diff(shards)) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(shards)], strict=True):
                if i == j:
                    continue
                if shards[i] != now:
                    if now is not None:
                        yield from close()
                    now, crc, held = int(shards[i]), 0, []
                    out = system.open_output_stream(f"{root}/.{shard_name(now)}.{attempt}")
                data = b"".join(b.column(6).slice(i, j - i).to_pylist())
                out.write(data)
                crc = zlib.crc32(data, crc)
                held.append(b.select(range(6)).slice(i, j - i))
        if now is not None:
            yield from close()

    columns = ["slot", "shard", "offset", "doc_id", "part", "n_tokens", "record"]
    return records.select(*columns).mapInArrow(run, "slot long, shard long, offset long, doc_id long, part int, n_tokens int, record binary, file string")


def read_shards(folder: str, start: int = 0, length: int = LENGTH, slots: int = SLOTS) -> Iterator[tuple[int, np.ndarray]]:
    """(slot, token ids) from slot ``start`` on, in order: one seek, then sequential reads."""
    system, root = fs.FileSystem.from_uri(folder)
    stride, slot = 2 + 2 * length, start
    while system.get_file_info(path := f"{root}/{shard_name(slot // slots)}").type == fs.FileType.File:
        with system.open_input_file(path) as f:
            f.seek(slot % slots * stride)
            while len(record := f.read(stride)) == stride:
                x = np.frombuffer(record, "<u2")
                yield slot, x[1 : 1 + x[0]]
                slot += 1
        if slot % slots:
            return
