"""Byte-level BPE by a global distinct-word shuffle.

A word here is a stretch of text whose ends are ends of pre-tokens wherever it stands: a run of non-space characters
with the blank before it, or white space. Texts are read in blocks of a few MB; a block's texts become sequences of
word numbers in order of position, and its distinct words go to one hash bucket each over the whole corpus. There a
word is cut by the tokenizer's pattern and encoded once, however many blocks hold it, and the ids come back by a join
on the block, which reassembles every text by position. Both shuffles carry distinct words and word numbers packed
per block, never one row per token. Decoding joins the ids with the token-byte table, which a vocabulary bounds.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of text in a block, at least one text. Larger blocks repeat fewer words, smaller ones need less memory.
BLOCK_CHARS = 8_000_000
#: A bucket's task forgets its words after so many, to bound its memory; a word met again is then encoded again.
WORDS_HELD = 1_000_000
#: Word buckets at most: a block sends one row to each, so rows grow with the blocks alone.
MOST_BUCKETS = 2048
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"  # Unicode White_Space
_WORD = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]")


@lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Callable[[str], list[int]]:
    """Ids of a word, each match of pattern in it separately, no special tokens."""
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={}).encode_ordinary


def words_of(texts: list[str]) -> Iterator[list[str]]:
    return map(_WORD.findall, texts)


def ordered(words: Iterable[str], buckets: int) -> tuple[list[str], np.ndarray]:
    """Distinct words by bucket, then by themselves (sorted words compress well), and their buckets."""
    words = sorted(words)
    of = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.uint32, len(words)) % buckets
    by = np.argsort(of, kind="stable")
    return [words[i] for i in by.tolist()], of[by]


def _pack(*parts: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b"".join(struct.pack("<q", len(p)) for p in parts) + b"".join(parts))


def _unpack(data: bytes, n: int) -> list[bytes]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 8 * n, []
    for size in struct.unpack_from(f"<{n}q", raw):
        out.append(raw[at : at + size])
        at += size
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array, list[str]]]:
    """(block id, doc ids, texts). The id holds the task's partition and a checksum: a second pass over other rows
    would give other ids, which encode() finds out rather than mix up two blocks."""
    part, ordinal = TaskContext.get().partitionId(), 0
    ids, texts, chars = [], [], 0

    def flush() -> tuple[str, pa.Array, list[str]]:
        check = 0
        for t in texts:
            check = zlib.crc32(t.encode("utf-8", "surrogatepass"), check)
        return f"{part}-{ordinal}-{len(texts)}-{check:08x}", pa.concat_arrays(ids), list(texts)

    for b in batches:
        column, from_ = b.column(1), 0
        for i in range(b.num_rows):
            t = column[i].as_py() or ""
            texts.append(t)
            chars += len(t)
            if chars >= BLOCK_CHARS:
                ids.append(b.column(0).slice(from_, i + 1 - from_))
                yield flush()
                ids, texts, chars, from_, ordinal = [], [], 0, i + 1, ordinal + 1
        if from_ < b.num_rows:
            ids.append(b.column(0).slice(from_))
    if texts:
        yield flush()


def encode(docs: DataFrame, ranks_path: str, pattern: str, buckets: int | None = None) -> DataFrame:
    """Blocks of encoded texts: (block string, payload binary), to be read by map_encoded().

    docs: doc_id (bigint, else TypeError), text; they are read twice, so they should come from files. buckets: number of
    word buckets, by default the number of shuffle partitions, MOST_BUCKETS at most."""
    buckets = min(buckets or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), MOST_BUCKETS)
    docs = docs.select("doc_id", "text")
    if docs.schema["doc_id"].dataType.simpleString() != "bigint":
        raise TypeError("doc_id must be a bigint")

    def words_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, texts in _blocks(batches):
            found: set[str] = set()
            for ws in words_of(texts):
                found.update(ws)
            words, of = ordered(found, buckets)
            edges = np.searchsorted(of, np.arange(buckets + 1)).tolist()
            rows = [(b, _pack(*_joined(words[edges[b] : edges[b + 1]]))) for b in range(buckets) if edges[b] < edges[b + 1]]
            names = pa.array([block] * len(rows), pa.string())
            yield pa.RecordBatch.from_arrays([names, pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["block", "bucket", "payload"])

    def skeletons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, texts in _blocks(batches):
            number: defaultdict[str, int] = defaultdict()
            number.default_factory = number.__len__
            codes = [np.fromiter(map(number.__getitem__, ws), np.int64, len(ws)) for ws in words_of(texts)]
            words, _ = ordered(number, buckets)
            place = np.empty(len(words), np.uint32)
            place[np.fromiter(map(number.__getitem__, words), np.int64, len(words))] = np.arange(len(words))
            dense = place[np.concatenate(codes)]
            counts = np.fromiter(map(len, codes), np.int64, len(codes))
            null = np.asarray(pc.is_null(ids)).astype(np.uint8).tobytes()
            filled = np.asarray(pc.fill_null(ids, 0)).astype(np.int64).tobytes()
            payload = _pack(_planes(dense), counts.tobytes(), filled, null, struct.pack("<q", len(words)))
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([payload], pa.binary())], ["block", "payload"])

    def encode_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_word, known = encoder(ranks_path, pattern), {}
        for b in batches:
            out = []
            for payload in b.column(2):
                words = _split(*_unpack(payload.as_py(), 2))
                ids = []
                for w in words:
                    found = known.get(w)
                    if found is None:
                        if len(known) >= WORDS_HELD:
                            known.clear()
                        ids_of = encode_word(w.decode("utf-8", "surrogatepass"))
                        found = known[w] = struct.pack(f"<{len(ids_of)}I", *ids_of)
                    ids.append(found)
                sizes = np.fromiter(map(len, ids), np.uint32, len(ids)) // 4
                out.append(_pack(sizes.tobytes(), _planes(np.frombuffer(b"".join(ids), np.uint32))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["block", "bucket", "payload"])

    words = docs.mapInArrow(words_out, "block string, bucket int, payload binary")
    coded = words.repartitionById(buckets, "bucket").mapInArrow(encode_words, "block string, bucket int, payload binary")
    by_block = coded.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("bucket", "payload"))).alias("ids"))
    texts = docs.mapInArrow(skeletons, "block string, payload binary")
    return texts.join(by_block, "block", "left").select("block", "payload", F.col("ids.payload").alias("ids"))


def _planes(x: np.ndarray) -> bytes:
    """Bytes of unsigned ints by significance, which compress better apart."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def _joined(words: list[str]) -> tuple[bytes, bytes]:
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    return np.fromiter(map(len, raw), np.uint32, len(raw)).tobytes(), b"".join(raw)


def _split(sizes: bytes, data: bytes) -> list[bytes]:
    ends = np.cumsum(np.frombuffer(sizes, np.uint32), dtype=np.int64).tolist()
    return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []


def _reassemble(payload: bytes, coded: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(doc ids, ids of all texts in order, number of ids of each text)."""
    planes, counts, doc_ids, null, n_words = _unpack(payload, 5)
    codes = _from_planes(planes)
    counts = np.frombuffer(counts, np.int64)
    docs = pa.array(np.frombuffer(doc_ids, np.int64), mask=np.frombuffer(null, np.uint8).astype(bool))
    sizes, flats = [], []
    for part in coded:
        size, ids = _unpack(part, 2)
        sizes.append(np.frombuffer(size, np.uint32).astype(np.int64))
        flats.append(_from_planes(ids))
    sizes = np.concatenate(sizes) if sizes else np.empty(0, np.int64)
    flat = np.concatenate(flats) if flats else np.empty(0, np.uint32)
    if len(sizes) != struct.unpack("<q", n_words)[0]:
        raise RuntimeError("the input gave other rows when it was read again")
    start = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    many = sizes[codes]
    stop = np.cumsum(many)
    total = int(stop[-1]) if len(stop) else 0
    position = np.arange(total) - np.repeat(stop - many, many) + np.repeat(start[codes], many)
    ends = np.concatenate([[0], stop])[np.cumsum(counts)]
    return docs, flat[position], np.diff(ends, prepend=0)


def map_encoded(blocks: DataFrame, use: Callable[[pa.Array, np.ndarray, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """use(doc ids, ids of all texts in order, number of ids of each text) for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for payload, ids in zip(b.column(1), b.column(2), strict=True):
                yield use(*_reassemble(payload.as_py(), ids.as_py() or []))

    return blocks.mapInArrow(run, schema)


class TokenBytes:
    """The token-byte table and the join of ids with it."""

    def __init__(self, ranks: dict[bytes, int]):
        top = max(ranks.values()) + 1
        of = [b""] * top
        for token, rank in ranks.items():
            of[rank] = token
        self.bytes = pa.array(of, pa.large_binary())
        self.digits = pa.array([str(i) + "," for i in range(top)], pa.large_string())

    @staticmethod
    def _concat(table: pa.Array, ids: np.ndarray, ends: np.ndarray) -> Iterator[memoryview]:
        rows = table.take(pa.array(ids))
        offsets = np.frombuffer(rows.buffers()[1], np.int64)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
        data = memoryview(rows.buffers()[2] or b"")
        at = offsets[np.concatenate([[0], ends])].tolist()
        return (data[a:b] for a, b in zip(at, at[1:], strict=False))

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> Iterator[memoryview]:
        """Bytes of each text; ends: running number of ids."""
        return self._concat(self.bytes, ids, ends)

    def listed(self, ids: np.ndarray, ends: np.ndarray) -> Iterator[memoryview]:
        """Decimal ids of each text, joined by commas."""
        return (x[:-1] for x in self._concat(self.digits, ids, ends))


@lru_cache(maxsize=2)
def token_bytes(path: str) -> TokenBytes:
    return TokenBytes(load_ranks(path))


def encoded_rows(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array of int) for every row of docs."""

    def use(doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        return pa.RecordBatch.from_arrays([doc_ids, pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])

    return map_encoded(encode(docs, ranks_path, pattern), use, "doc_id long, ids array<int>")


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of docs: ids of the whole text, and their decoding.

    Null and empty texts have no tokens. Null doc_ids and repeated rows stay as they are; an empty table gives no
    rows. A text longer than a block ends a block. doc_id must be a bigint (else TypeError); other columns are left out,
    whatever their names.
    """

    def use(doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        table, ends = token_bytes(ranks_path), np.cumsum(counts)
        hexes = [[hashlib.sha256(x).hexdigest() for x in rows] for rows in (table.listed(ids, ends), table.decode(ids, ends))]
        return pa.RecordBatch.from_arrays([doc_ids, pa.array(counts), pa.array(hexes[0]), pa.array(hexes[1])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_encoded(encode(docs, ranks_path, pattern), use, schema)


def op2_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Digests of ids and decoded bytes of every document, by the public multilingual byte-level vocabulary."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
