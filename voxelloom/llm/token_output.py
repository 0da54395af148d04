"""Token-ID output: static range asymmetric numeral system over independent, interleaved blocks.

File format. A folder with two Parquet containers: `freq` is the shared frequency table (id,
freq; the frequencies sum to 2**PRECISION), `blocks` has one row per block of whole documents:
part and seq (the block's place in ascending document order), doc_ids, n_tokens, and `payload`:

    magic "RNS1" | uint32 tokens | uint32 lanes | uint32 words | uint32 checkpoints | uint32 CRC-32 of the rest
    checkpoints x (uint32 first step | uint32 first word | lanes x uint64 states)
    words x uint32

Token i of a block belongs to lane i % lanes, step i // lanes. Every CHECKPOINT steps the states
of all lanes are kept, so that parts of one block can be decoded by themselves, and any block
needs only its own row and the shared table.
"""

from __future__ import annotations

import itertools
import os
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, materialise, prepare, shared_path, tidy, worker_cache

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
LETTER, DIGIT, SIGN, FAR = 1, 2, 3, 4
#: Kinds of bytes; 0 stands for ASCII white space and control characters, FAR for all beyond ASCII.
KINDS = np.zeros(256, np.uint8)
KINDS[33:127], KINDS[48:58], KINDS[65:91], KINDS[97:123], KINDS[128:] = SIGN, DIGIT, LETTER, LETTER, FAR
PRECISION = 20
LANES = 1024
CHECKPOINT = 128
BLOCK_TOKENS = 1 << 17
LOW = np.uint64(1 << 31)
HEAD = struct.Struct("<4sIIIII")


# --- tokenising ------------------------------------------------------------------------------

#: Slots of the table of known units, and how many ids they keep before the table starts anew.
SLOT_BITS = 21
KNOWN_IDS = 16_000_000
#: Units that the library encodes at a time: each makes an object of its own there.
ENCODE_AT_ONCE = 2000


class CachedTokenizer:
    """A byte-level BPE tokenizer that encodes each different unit of text once.

    Units are cut only where the tokenizer's own pre-tokenizer always cuts: before a space that
    follows a character other than white space of any kind, and before '.', ',' or a line break
    after an ASCII letter. The library encodes every unit; letters alone, digits alone and signs
    alone, which its pre-tokenizer leaves whole, go to its model directly. Known units stand in a
    table with one unit a slot, told apart by 96 bits of two hashes; a unit may displace another.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(printable)]
        chars = {b: b for b in printable} | {b: 256 + i for i, b in enumerate(others)}
        self.byte_chars = np.array([chars[b] for b in range(256)], np.dtype("<u2"))
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.clear()

    def clear(self, ids: int = KNOWN_IDS) -> None:
        slots = 1 << SLOT_BITS
        self.key, self.check = np.zeros(slots, np.uint64), np.zeros(slots, np.uint32)
        self.at, self.size = np.zeros(slots, np.int32), np.zeros(slots, np.int32)
        self.flat, self.used = np.empty(ids, self.kind), 0

    def _encode_units(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different units, one after another, and how many each has."""
        kinds = KINDS[data]
        body = np.minimum(starts + (data[starts] == 32), ends - 1)
        changes = np.concatenate([[0], np.cumsum(kinds[1:] != kinds[:-1])])
        others = np.concatenate([[0], np.cumsum((kinds != LETTER) & (kinds != FAR))])
        whole = (changes[ends - 1] == changes[body]) & (kinds[body] > 0) & (kinds[body] < FAR)
        letters = ~whole & (others[ends] == others[body])
        raw, chars, tokenize = data.tobytes(), self.byte_chars[data].tobytes().decode("utf-16-le"), self.tokenizer.model.tokenize
        found: list[list[int] | None] = []
        hard: list[int] = []
        for at, (a, c, b, w, m) in enumerate(zip(starts.tolist(), body.tolist(), ends.tolist(), whole.tolist(), letters.tolist(), strict=True)):
            if w or (m and raw[c:b].decode().isalpha()):
                found.append([t.id for t in tokenize(chars[a:b])])
            else:
                found.append(None)
                hard.append(at)
        for i in range(0, len(hard), ENCODE_AT_ONCE):
            part = hard[i : i + ENCODE_AT_ONCE]
            for at, e in zip(part, self.tokenizer.encode_batch_fast([raw[starts[k] : ends[k]].decode() for k in part], add_special_tokens=False), strict=True):
                found[at] = e.ids
        lens = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(lens.sum())), lens

    def _places(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each unit begin in `flat` and how many there are; unknown units are added."""
        h1, h2 = span_hashes(data, starts, ends)
        slot, check = (h1 >> np.uint64(64 - SLOT_BITS)).astype(np.int64), h2.astype(np.uint32)
        begin, size = self.at[slot].astype(np.int64), self.size[slot].astype(np.int64)
        new = np.flatnonzero((self.key[slot] != h1) | (self.check[slot] != check) | (size == 0))
        if not len(new):
            return begin, size
        _, first, inverse = np.unique(h1[new], return_index=True, return_inverse=True)
        if not (check[new[first]][inverse] == check[new]).all():
            first = inverse = np.arange(len(new))
        one = new[first]
        ids, lens = self._encode_units(data, starts[one], ends[one])
        if self.used + len(ids) > len(self.flat):
            known = len(new) < len(starts)
            self.clear(max(KNOWN_IDS, len(ids)))
            if known:  # ids that this slice uses went too
                return self._places(data, starts, ends)
        places = self.used + np.cumsum(lens) - lens
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        begin[new], size[new] = places[inverse], lens[inverse]
        _, single = np.unique(slot[one], return_index=True)
        to, of = slot[one[single]], one[single]
        self.key[to], self.check[to], self.at[to], self.size[to] = h1[of], check[of], places[single], lens[single]
        return begin, size

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes and text bounds -> ids of all texts, END_ID after each, and n_tokens."""
        first = np.zeros(len(data) + 1, bool)
        first[offsets] = True
        if len(data) > 2:
            prev, here, after = data[:-2], data[1:-1], data[2:]
            first[1:-2] |= (here == 32) & (after != 32) & ~_after_space(data)[:-2]
            letter = ((prev | 32) >= 97) & ((prev | 32) <= 122)
            first[1:-2] |= ((here == 46) | (here == 44) | (here == 10)) & letter
        bounds = np.flatnonzero(first)
        starts, ends = bounds[:-1], bounds[1:]
        begin, lens = self._places(data, starts, ends) if len(starts) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        total = np.concatenate([[0], np.cumsum(lens)])
        at_unit = np.searchsorted(starts, offsets)
        n_docs = len(offsets) - 1
        counts = total[at_unit[1:]] - total[at_unit[:-1]]
        out = np.full(int(total[-1]) + n_docs, END_ID, np.uint32)
        if total[-1]:
            # One slot after each document is left for its end id.
            doc_of_unit = np.repeat(np.arange(n_docs), at_unit[1:] - at_unit[:-1])
            within = np.arange(int(total[-1]))
            out[within + np.repeat(doc_of_unit, lens)] = self.flat[within + np.repeat(begin - total[:-1], lens)]
        return out, counts + 1


def _after_space(data: np.ndarray) -> np.ndarray:
    """Whether each byte ends white space; true also of some signs that share its lead bytes."""
    out = (data == 32) | ((data >= 9) & (data <= 13)) | ((data >= 28) & (data <= 31))
    out[1:] |= (data[:-1] == 0xC2) & ((data[1:] == 0x85) | (data[1:] == 0xA0))
    a, b = data[:-2], data[1:-1]
    out[2:] |= ((a == 0xE1) & (b == 0x9A)) | ((a == 0xE2) & ((b == 0x80) | (b == 0x81))) | ((a == 0xE3) & (b == 0x80))
    return out


_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit hashes of each span of bytes, eight bytes at a time."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    words = np.ndarray((len(data) + 8,), np.dtype("<u8"), padded, strides=(1,))
    size = ends - starts
    out = [size.astype(np.uint64) * odd for odd in _ODD]
    left, at = np.arange(len(starts)), starts
    rest = size
    while len(left):
        word = words[at] & _MASKS[np.minimum(rest, 8)]
        for h, odd in zip(out, _ODD, strict=True):
            x = (h[left] ^ word) * odd
            h[left] = x ^ (x >> np.uint64(29))
        more = rest > 8
        left, at, rest = left[more], at[more] + 8, rest[more] - 8
    return out


def text_slices(column: pa.Array, most: int = 1 << 20):
    """Slices of a string column of about `most` bytes: first row, bytes, bounds. Null: empty."""
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string())
    bounds = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        to = int(np.searchsorted(bounds, bounds[row] + most, "right")) - 1
        to = min(max(to, row + 1), len(column))
        yield row, data[bounds[row] : bounds[to]], bounds[row : to + 1] - bounds[row]
        row = to


def tokenizer_of(path: str) -> CachedTokenizer:
    """The worker's tokenizer: later tasks know the units of earlier ones."""
    cache = worker_cache("tokenizers")
    if path not in cache:
        cache[path] = CachedTokenizer(path)
    return cache[path]


def _tokenise(path: str, block_tokens: int):
    def run(batches):
        tok = tokenizer_of(path)
        part, seq = TaskContext.get().partitionId(), 0
        ids, lens, docs, held = [], [], [], 0

        def block():
            nonlocal ids, lens, docs, held, seq
            flat = np.concatenate(ids)
            small = flat.astype(np.uint16) if flat.max(initial=0) < 1 << 16 else flat
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([docs], pa.list_(pa.int64())), pa.array([np.concatenate(lens)], pa.list_(pa.int64())), pa.array([small.tobytes()], pa.binary()), pa.array([small.itemsize], pa.int32()), pa.array([len(flat)], pa.int64())], names=["part", "seq", "doc_ids", "n_tokens", "ids", "width", "tokens"])
            ids, lens, docs, held, seq = [], [], [], 0, seq + 1
            return row

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            give_back()
            for row, data, bounds in text_slices(batch.column(1)):
                flat, counts = tok.encode(data, bounds)
                ends = np.cumsum(counts)
                done = 0
                while done < len(counts):
                    base = ends[done - 1] if done else 0
                    to = min(len(counts), int(np.searchsorted(ends, base + block_tokens - held)) + 1)
                    ids.append(flat[base : ends[to - 1]])
                    lens.append(counts[done:to])
                    docs += doc_ids[row + done : row + to]
                    held += int(ends[to - 1] - base)
                    done = to
                    if held >= block_tokens:
                        yield block()
        if docs:
            yield block()

    return tidy(run, "tokenizers")


# --- coding ----------------------------------------------------------------------------------


def normalise(counts: np.ndarray, precision: int = PRECISION) -> np.ndarray:
    """Counts -> frequencies that sum to 2**precision, at least 1 where the count isn't 0."""
    whole = 1 << precision
    counts = counts.astype(np.int64)
    used = np.flatnonzero(counts)
    freq = np.zeros(len(counts), np.int64)
    if not len(used):
        return freq
    if len(used) > whole:
        raise ValueError("more symbols than 2**precision")
    exact = counts[used] * (whole / counts[used].sum())
    freq[used] = np.maximum(1, np.floor(exact).astype(np.int64))
    short = whole - int(freq.sum())
    order = used[np.argsort(-freq[used], kind="stable")]
    if short > 0:
        freq[order[0]] += short
    for i in order:  # what the minimum of 1 took comes from the most frequent
        if short >= 0:
            break
        give = min(int(freq[i]) - 1, -short, max(1, int(freq[i]) // 2))
        freq[i] -= give
        short += give
    while short < 0:
        i = int(np.argmax(freq))
        give = min(int(freq[i]) - 1, -short)
        freq[i] -= give
        short += give
    return freq


class Coder:
    def __init__(self, freq: np.ndarray, precision: int = PRECISION):
        self.precision = np.uint64(precision)
        self.freq = freq.astype(np.uint64)
        self.first = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64) if len(freq) else self.freq
        self.mask = np.uint64((1 << precision) - 1)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    def encode(self, ids: np.ndarray, lanes: int = LANES, every: int = CHECKPOINT) -> bytes:
        n = len(ids)
        lanes = max(1, min(lanes, n))
        steps = -(-n // lanes)
        x = np.full(lanes, LOW, np.uint64)
        f, c = self.freq[ids], self.first[ids]
        if n and not f.all():
            raise ValueError("an id has no frequency")
        shift = np.uint64(63) - self.precision
        out, points, words = [], [], 0
        for s in range(steps - 1, -1, -1):
            fs, cs = f[s * lanes : (s + 1) * lanes], c[s * lanes : (s + 1) * lanes]
            xs = x[: len(fs)]
            full = xs >= (fs << shift)
            if full.any():
                w = (xs[full] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                out.append(w)
                words += len(w)
                xs = np.where(full, xs >> np.uint64(32), xs)
            q = xs // fs
            x[: len(fs)] = (q << self.precision) + (xs - q * fs) + cs
            if s % every == 0:
                points.append((s, words, x.copy()))
        body = b"".join(struct.pack("<II", s, words - w) + p.tobytes() for s, w, p in reversed(points))
        body += b"".join(w.tobytes() for w in reversed(out))
        return HEAD.pack(b"RNS1", n, lanes, words, len(points), zlib.crc32(body)) + body

    def decode(self, payload: bytes, checkpoint: int | None = None) -> np.ndarray:
        """All ids, or those from one checkpoint to the next."""
        magic, n, lanes, words, points, crc = HEAD.unpack_from(payload)
        body = memoryview(payload)[HEAD.size :]
        size = 8 + 8 * lanes
        if magic != b"RNS1" or len(body) != points * size + 4 * words or zlib.crc32(body) != crc:
            raise ValueError("damaged block")
        steps = -(-n // lanes)
        if not n:
            return np.zeros(0, np.uint32)
        at = checkpoint or 0
        step, word = struct.unpack_from("<II", body, at * size)
        x = np.frombuffer(body, np.uint64, lanes, at * size + 8).copy()
        end = steps if checkpoint is None or at + 1 == points else struct.unpack_from("<I", body, (at + 1) * size)[0]
        stream = np.frombuffer(body, np.uint32, words, points * size)
        out = np.empty(min(n, end * lanes) - step * lanes, np.uint32)
        for s in range(step, end):
            k = min(lanes, n - s * lanes)
            xs = x[:k]
            slot = xs & self.mask
            ids = self.symbol[slot.astype(np.int64)]
            out[(s - step) * lanes : (s - step) * lanes + k] = ids
            xs = self.freq[ids] * (xs >> self.precision) + slot - self.first[ids]
            low = np.flatnonzero(xs < LOW)
            if len(low):
                xs[low] = (xs[low] << np.uint64(32)) | stream[word : word + len(low)]
                word += len(low)
            x[:k] = xs
        return out


# --- the operator ----------------------------------------------------------------------------

BLOCKS = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("seq", T.IntegerType()), T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("n_tokens", T.ArrayType(T.LongType())), T.StructField("ids", T.BinaryType()), T.StructField("width", T.IntegerType()), T.StructField("tokens", T.LongType())])
STORED = T.StructType([*BLOCKS.fields[:4], T.StructField("payload", T.BinaryType()), BLOCKS["tokens"]])
FREQ = "id long, freq long"


def _ids(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint16 if width == 2 else np.uint32).astype(np.uint32)


def _count(batches):
    counts = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for raw, width in zip(batch.column("ids"), batch.column("width").to_pylist(), strict=True):
            add = np.bincount(_ids(raw.as_buffer(), width))
            counts = np.pad(counts, (0, max(0, len(add) - len(counts))))
            counts[: len(add)] += add
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["id", "n"])


def _dense(pairs) -> np.ndarray:
    freq = np.zeros(max((r[0] for r in pairs), default=-1) + 1, np.int64)
    for i, f in pairs:
        freq[i] = f
    return freq


def write_tokens(docs: DataFrame, path: str, tokenizer: str, block_tokens: int = BLOCK_TOKENS) -> None:
    """Encode the text of every row of docs(doc_id, text, ...) into the format above at path.

    Order: ascending doc_id, nulls first; rows of one id by text. Null text is empty: the end id
    alone. An empty table writes no blocks. Further columns aren't read.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    blocks = materialise(ordered.mapInArrow(_tokenise(tokenizer, block_tokens), BLOCKS), "tokens")
    # At most one row per symbol of the vocabulary: bounded whatever the corpus.
    counts = [tuple(r) for r in blocks.select("ids", "width").mapInArrow(tidy(_count, "tokenizers"), "id long, n long").groupBy("id").agg(F.sum("n")).collect()]
    freq = normalise(_dense(counts))
    used = np.flatnonzero(freq)
    spark.createDataFrame([(int(i), int(freq[i])) for i in used], FREQ).coalesce(1).write.parquet(f"{path}/freq")
    shared = spark.sparkContext.broadcast(freq)

    def encode(batches):
        coder = Coder(shared.value)
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                payload = coder.encode(_ids(row.column("ids")[0].as_buffer(), row.column("width")[0].as_py()))
                yield pa.RecordBatch.from_arrays([*[row.column(c) for c in ("part", "seq", "doc_ids", "n_tokens")], pa.array([payload], pa.binary()), row.column("tokens")], names=STORED.names)

    blocks.mapInArrow(tidy(encode), STORED).write.option("compression", "none").parquet(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document of the files at path: doc_id, start, n_tokens, ids_crc32 (and its ids)."""
    freq = _dense([tuple(r) for r in spark.read.schema(FREQ).parquet(f"{path}/freq").collect()])
    shared = spark.sparkContext.broadcast(freq)
    stored = spark.read.schema(STORED).parquet(f"{path}/blocks")
    per_block = stored.select("part", "seq", "tokens")
    parts = per_block.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range partition
    parts = parts.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_block.select("part", "seq", F.coalesce(F.sum("tokens").over(inside), F.lit(0)).alias("block_start"))
    starts = starts.join(parts, "part").select("part", "seq", (F.col("part_start") + F.col("block_start")).alias("start"))
    schema = "part int, seq int, doc_id long, within long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")

    def decode(batches):
        coder = Coder(shared.value)
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                ids = coder.decode(row.column("payload")[0].as_buffer())
                lens = np.array(row.column("n_tokens")[0].as_py(), np.int64)
                ends = np.cumsum(lens)
                if int(ends[-1]) != len(ids):
                    raise ValueError("a block's documents don't add up to its tokens")
                pieces = [ids[b - n : b] for b, n in zip(ends.tolist(), lens.tolist(), strict=True)]
                many = len(lens)
                columns = [pa.array(np.full(many, row.column("part")[0].as_py(), np.int32)), pa.array(np.full(many, row.column("seq")[0].as_py(), np.int32)), pa.array(row.column("doc_ids")[0].as_py(), pa.int64()), pa.array(ends - lens), pa.array(lens), pa.array([zlib.crc32(np.ascontiguousarray(p, "<u4")) for p in pieces], pa.int64())]
                names = ["part", "seq", "doc_id", "within", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([p.astype(np.int64) for p in pieces], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    docs = stored.mapInArrow(tidy(decode), schema)
    out = docs.join(materialise(starts, "token-starts"), ["part", "seq"])
    return out.select("doc_id", (F.col("start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def token_output(docs: DataFrame, tokenizer: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Write docs in the format above to the shared folder and read the files back."""
    spark = prepare(docs.sparkSession)
    path = shared_path(spark, "token-files")
    write_tokens(docs, path, tokenizer, block_tokens)
    return read_tokens(spark, path)
