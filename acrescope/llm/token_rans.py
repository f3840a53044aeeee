"""Token ids in compressed binary blocks: static range ANS with shared tables, interleaved lanes, checkpoints and checksums."""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acrescope.llm.common import SpanIds, cut_lineage, small_batches, text_slices, word_spans

BLOCK = 1 << 18  # ids in a block
LANES = 1 << 10  # interleaved coders of a block
STRIDE = 128  # steps of all lanes between checkpoints
SCALE = 20  # frequencies of a table add up to 2 ** SCALE
MAX_VOCAB = 1 << (SCALE - 1)
_LOW = np.uint64(1 << 31)  # lane states lie in [2 ** 31, 2 ** 63)
_U = np.uint64


# --- tokens -------------------------------------------------------------------
_loaded: dict = {}
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
TEXT_SLICE = 2 << 20


def _tokenizer(path: str) -> SpanIds:
    """The tokenizer behind a store of recent words, loaded once per Python worker."""
    if path not in _loaded:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)

        def make(words):
            flat, size = array("i"), []
            for k in range(0, len(words), 20_000):
                for found in tokenizer.encode_batch_fast([w.decode() for w in words[k:k + 20_000]], add_special_tokens=False):
                    ids = found.ids
                    flat.extend(ids)
                    size.append(len(ids))
            return np.array(flat, np.int32), np.array(size, np.int64)

        _loaded[path] = SpanIds(make)
    return _loaded[path]


def encode_texts(path: str, texts: pa.Array, end_id: int) -> Iterator[np.ndarray]:
    """Ids of whole texts, the end id last, as int32 arrays.

    The tokenizer splits at white space, and between an ASCII letter or digit and
    a full stop or comma before a space; none of its rules looks across such a
    place, so a text's ids are those of the pieces between. Case plays no part,
    but in special tokens, which hold "<|". A piece goes to the library when the
    worker has not met it lately.
    """
    store, end = _tokenizer(path), np.array([end_id], np.int32)
    for _, _, data, offsets in text_slices(texts, TEXT_SLICE):
        odd = data >= 128
        odd[:-1] |= (data[:-1] == 60) & (data[1:] == 124)
        plain = np.diff(np.concatenate([[0], np.cumsum(odd, dtype=np.int32)])[offsets]) == 0
        data = np.where(np.repeat(plain, np.diff(offsets)), _LOWER[data], data)
        starts, ends, before = word_spans(data, offsets)
        stop = data[ends - 1]
        stop = np.flatnonzero(((stop == 44) | (stop == 46)) & (ends - starts > 1) & _ALNUM[data[ends - 2]])
        before = before + np.searchsorted(stop, before)
        split = ends[stop] - 1
        ends = ends.copy()
        ends[stop] = split
        starts, ends = np.insert(starts, stop + 1, split), np.insert(ends, stop + 1, split + 1)
        ids, count = store.ids(data, starts, ends)
        cuts = count[before]
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield np.concatenate([ids[a:b], end])


def _tokenize(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        for batch in small_batches(batches):
            ids = list(encode_texts(path, batch.column("text"), end_id))
            width = [2 if i.max() < 65536 else 4 for i in ids]  # 16 bits where all ids of the document allow it
            body = [i.astype(np.uint16 if w == 2 else np.uint32).tobytes() for w, i in zip(width, ids)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(width, pa.int32()), pa.array(body, pa.binary())],
                                             names=["doc_id", "width", "ids"])

    return run


def _wide(width: int, body: bytes) -> np.ndarray:
    return np.frombuffer(body, np.uint16 if width == 2 else np.uint32).astype(np.int64)


# --- tables -------------------------------------------------------------------
@dataclass(frozen=True)
class Table:
    """Frequencies of the ids that occur, scaled to 2 ** SCALE."""

    symbols: np.ndarray
    freq: np.ndarray

    def __post_init__(self):
        start = np.cumsum(self.freq) - self.freq
        object.__setattr__(self, "start", start.astype(np.uint64))
        place = np.zeros(int(self.symbols.max(initial=-1)) + 1, np.int32)
        place[self.symbols] = np.arange(len(self.symbols))
        object.__setattr__(self, "place", place)
        object.__setattr__(self, "slot", np.repeat(np.arange(len(self.freq), dtype=np.int32), self.freq.astype(np.int64)))


def scale_counts(symbols: np.ndarray, counts: np.ndarray) -> Table:
    """Whole frequencies of at least 1 that add up to 2 ** SCALE, by largest remainder."""
    if len(symbols) > MAX_VOCAB:
        raise ValueError(f"{len(symbols)} different ids; tables hold {MAX_VOCAB}")
    order = np.argsort(symbols)
    symbols, counts = symbols[order], counts[order].astype(np.float64)
    room = (1 << SCALE) - len(symbols)
    exact = counts / max(counts.sum(), 1) * room
    freq = np.floor(exact).astype(np.int64)
    left = room - int(freq.sum())
    if len(symbols):
        freq[np.argsort(freq - exact, kind="stable")[:left]] += 1
    return Table(symbols.astype(np.int64), (freq + 1).astype(np.uint64))


COUNT_IDS = 1 << 20  # ids counted at once


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, held, size = np.zeros(0, np.int64), [], 0

    def add():
        nonlocal total, held, size
        if held:
            found = np.bincount(np.concatenate(held), minlength=len(total))
            found[:len(total)] += total
            total, held, size = found, [], 0

    for batch in batches:
        for width, body in zip(batch.column("width").to_pylist(), batch.column("ids").to_pylist()):
            held.append(np.frombuffer(body, np.uint16 if width == 2 else np.uint32))
            size += len(held[-1])
            if size >= COUNT_IDS:
                add()
    add()
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["symbol", "n"])


# --- coder --------------------------------------------------------------------
def encode_block(index: np.ndarray, table: Table, lanes: int = LANES, stride: int = STRIDE) -> bytes:
    """One block: id k belongs to lane k mod lanes; words leave in the order in which the decoder wants them.

    Layout: ids, lanes, steps, words and checkpoints as uint32; checkpoints
    (first word as uint32, then the lanes' states as uint64) for steps 0,
    stride, 2 * stride ...; then the words as uint32.
    """
    n = len(index)
    lanes = min(lanes, max(1, n))
    steps = -(-n // lanes)
    state = np.full(lanes, _LOW)
    chunks, marks = [], []
    for step in range(steps - 1, -1, -1):
        sym = index[step * lanes:(step + 1) * lanes]
        live = len(sym)
        f, c, x = table.freq[sym], table.start[sym], state[:live]
        over = x >= (_LOW >> _U(SCALE) << _U(32)) * f
        if over.any():
            chunks.append((x[over] & _U(0xFFFFFFFF)).astype(np.uint32))
            x = np.where(over, x >> _U(32), x)
        else:
            chunks.append(np.zeros(0, np.uint32))
        q = x // f
        state[:live] = (q << _U(SCALE)) + (x - q * f) + c
        if step % stride == 0:
            marks.append((step, state.copy()))
    chunks.reverse()
    marks.reverse()
    at = np.concatenate([[0], np.cumsum([len(c) for c in chunks])]).astype(np.uint32)
    words = np.concatenate(chunks) if chunks else np.zeros(0, np.uint32)
    head = np.array([n, lanes, steps, len(words), len(marks)], np.uint32).tobytes()
    return head + b"".join(at[step:step + 1].tobytes() + s.tobytes() for step, s in marks) + words.tobytes()


def decode_block(body: bytes, table: Table, stride: int = STRIDE, first: int = 0, last: int | None = None) -> np.ndarray:
    """Table indices of ids [first, last) of a block, started at the checkpoint before ``first``."""
    n, lanes, steps, n_words, n_marks = np.frombuffer(body, np.uint32, 5).astype(int)
    last = n if last is None else last
    if not n or first >= last:
        return np.zeros(0, np.int64)
    size = 4 + 8 * lanes
    words = np.frombuffer(body, np.uint32, n_words, 20 + n_marks * size)
    mark = first // lanes // stride
    at = int(np.frombuffer(body, np.uint32, 1, 20 + mark * size)[0])
    state = np.frombuffer(body, np.uint64, lanes, 24 + mark * size).copy()
    out, begin = [], mark * stride
    for step in range(begin, -(-last // lanes)):
        live = min(lanes, n - step * lanes)
        x = state[:live]
        low = x & _U((1 << SCALE) - 1)
        sym = table.slot[low]
        out.append(sym)
        x = table.freq[sym] * (x >> _U(SCALE)) + low - table.start[sym]
        under = np.flatnonzero(x < _LOW)
        if len(under):
            x[under] = x[under] << _U(32) | words[at:at + len(under)]
            at += len(under)
        state[:live] = x
    return np.concatenate(out)[first - begin * lanes:last - begin * lanes]


def _table_of(body) -> Table:
    return Table(np.frombuffer(body.value[0], np.int64), np.frombuffer(body.value[1], np.uint64))


_BLOCKS = ("shard int, block int, start long, n_ids long, crc32 long, doc_id array<long>, no_id array<boolean>, doc array<long>, piece array<long>, "
           "doc_start array<long>, n array<long>, body binary")


def _write_blocks(shared, block: int):
    """Cut the ids of one shard into blocks; a block lists the pieces of documents in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table_of(shared)
        shard, number, total, doc = TaskContext.get().partitionId(), 0, 0, 0
        held, pieces, size = [], [], 0

        def flush():
            nonlocal held, pieces, size, number
            ids = np.concatenate(held)
            columns = list(zip(*pieces))
            row = [shard, number, total - size, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), *map(list, columns),
                   encode_block(table.place[ids], table)]
            held, pieces, size, number = [], [], 0, number + 1
            names = [c.strip().split(" ")[0] for c in _BLOCKS.split(",")]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()),
                     pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=names)

        for batch in batches:
            for key, width, body in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "width", "ids"))):
                ids, begin, piece = _wide(width, body), total, 0
                while len(ids):
                    part, ids = ids[:block - size], ids[block - size:]
                    held.append(part)
                    pieces.append((key or 0, key is None, doc, piece, begin, len(part)))
                    size, total, piece = size + len(part), total + len(part), piece + 1
                    if size == block:
                        yield flush()
                doc += 1
        if size:
            yield flush()

    return run


def write_ids(docs: DataFrame, path: str, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", end_id: int = 1, block: int = BLOCK) -> None:
    """Encode texts and write their ids in ascending doc_id order under ``path``.

    ``path/table`` holds the shared frequency table, ``path/blocks`` one row per
    block: shard (ascending with doc_id), block, first id of it in the shard,
    ids, crc32 of the ids as little-endian uint32, the pieces of documents in
    it, and the coded body (``encode_block``). Blocks decode independently.

    Null texts are empty and give the end id alone. Null doc_ids come first;
    rows of equal doc_id are kept apart, ordered by their ids.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    tokens = cut_lineage(rows.mapInArrow(_tokenize(tokenizer, end_id), "doc_id long, width int, ids binary"), "tokens")
    counts = tokens.select("width", "ids").mapInArrow(_count, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n"))
    counts.coalesce(1).write.parquet(f"{path}/table")
    table = read_table(spark, path)
    shared = spark.sparkContext.broadcast((table.symbols.tobytes(), table.freq.tobytes()))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = tokens.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "width", "ids")
    ordered.mapInArrow(_write_blocks(shared, block), _BLOCKS).write.parquet(f"{path}/blocks")


def read_table(spark: SparkSession, path: str) -> Table:
    """The shared table; at most MAX_VOCAB rows come to the driver."""
    rows = spark.read.schema("symbol long, n long").parquet(f"{path}/table").limit(MAX_VOCAB + 1).toArrow()
    return scale_counts(rows.column("symbol").to_numpy(), rows.column("n").to_numpy())


def _read_blocks(shared, finish):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table_of(shared)
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r].as_py() for c in batch.schema.names}
                ids = table.symbols[decode_block(row["body"], table)].astype("<u4")
                if zlib.crc32(ids.tobytes()) != row["crc32"]:
                    raise ValueError(f"block {row['block']} of shard {row['shard']} is damaged")
                cuts = np.concatenate([[0], np.cumsum(row["n"])])
                yield finish(row, [ids[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])])

    return run


def _pieces(row, parts) -> pa.RecordBatch:
    n = len(parts)
    key = pa.array(row["doc_id"], pa.int64(), mask=np.array(row["no_id"], bool))
    return pa.RecordBatch.from_arrays(
        [pa.array([row["shard"]] * n, pa.int32()), key, *(pa.array(row[c], pa.int64()) for c in ("doc", "piece", "doc_start", "n")), pa.array(parts, pa.binary())],
        names=["shard", "doc_id", "doc", "piece", "doc_start", "n", "ids"])


def _digests(row, parts) -> pa.RecordBatch:
    out = _pieces(row, [b""] * len(parts))
    return out.set_column(6, "crc", pa.array([zlib.crc32(p) for p in parts], pa.int64()))


def _decode(spark: SparkSession, path: str, finish, last: str) -> DataFrame:
    table = read_table(spark, path)
    shared = spark.sparkContext.broadcast((table.symbols.tobytes(), table.freq.tobytes()))
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    return blocks.mapInArrow(_read_blocks(shared, finish), f"shard int, doc_id long, doc long, piece long, doc_start long, n long, {last}")


def _starts(spark: SparkSession, path: str) -> DataFrame:
    """(shard, before): ids in all shards before each, from one row per shard."""
    from pyspark.sql import Window

    sizes = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks").groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    over = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("shard", F.coalesce(F.sum("ids").over(over), F.lit(0)).alias("before"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(shard, doc, doc_id, piece, start, n, ids): decoded pieces of documents, ids as little-endian uint32.

    A document that runs over several blocks has a piece in each.
    """
    return _decode(spark, path, _pieces, "ids binary").join(_starts(spark, path), "shard") \
        .select("shard", "doc", "doc_id", "piece", (F.col("before") + F.col("doc_start")).alias("start"), "n", "ids")


def _gf2_times(matrix: list[int], vector: int) -> int:
    total, k = 0, 0
    while vector:
        if vector & 1:
            total ^= matrix[k]
        vector >>= 1
        k += 1
    return total


def crc32_join(one: int, two: int, n_bytes: int) -> int:
    """crc32 of a text from those of its two parts, the second of n_bytes: one moves over n_bytes zero bytes by matrix powers."""
    shift = [0xEDB88320] + [1 << k for k in range(31)]  # one zero bit
    for _ in range(3):
        shift = [_gf2_times(shift, c) for c in shift]  # one zero byte
    while n_bytes:
        if n_bytes & 1:
            one = _gf2_times(shift, one)
        n_bytes >>= 1
        if n_bytes:
            shift = [_gf2_times(shift, c) for c in shift]
    return one ^ two


def _join_crcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for parts in batch.column("parts").to_pylist():
            crc = 0
            for k, p in enumerate(parts):
                crc = p["crc"] if not k else crc32_join(crc, p["crc"], 4 * p["n"])
            out.append(crc)
        names = [c for c in batch.schema.names if c != "parts"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out, pa.int64())], names=[*names, "ids_crc32"])


def digest_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files; only sums of pieces are shuffled, never ids."""
    parts = _decode(spark, path, _digests, "crc long")
    docs = parts.groupBy("shard", "doc").agg(F.first("doc_id").alias("doc_id"), F.first("doc_start").alias("doc_start"), F.sum("n").alias("n_tokens"),
                                             F.sort_array(F.collect_list(F.struct("piece", "crc", "n"))).alias("parts"))
    docs = docs.join(_starts(spark, path), "shard").select("doc_id", (F.col("before") + F.col("doc_start")).alias("start"), "n_tokens", "parts")
    return docs.mapInArrow(_join_crcs, "doc_id long, start long, n_tokens long, ids_crc32 long")
