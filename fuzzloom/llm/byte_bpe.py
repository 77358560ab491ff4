"""Byte-level BPE by a global shuffle of distinct pre-tokens.

Documents are cut into blocks.  A pass over a block's texts gives its distinct pre-tokens;
these meet by word hash, where each distinct word is encoded once, and their ids go back
to the block.  A second pass gives, for each document, its positions as indexes into the
block's distinct words, and every document is put together again by position.  (An
exploded (document, position, word) table holds the same, but needs many times the
shuffle; storing the first pass for the second needs twice the disk.)  A block is named
by a hash of what it holds in order, so a pass that would see other blocks fails instead of
mixing them.  Files give their rows in the same order each time; other inputs have to be
written first.  Ids are decoded by the table from id to bytes, which has the vocabulary's size.

Null texts count as empty and have no ids.  Rows are never merged: equal documents and
equal doc_ids give equal rows each.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame

from fuzzloom.llm.common import rows_in_slices, text_bytes

BLOCK_CHARS, BLOCK_DOCS = 4_000_000, 4096
#: Distinct words of a bucket are held in one task at a time; blocks give so many rows each.
BUCKETS = 64
_PIECES: dict = {}


def load_ranks(path: str) -> dict[bytes, int]:
    """The rank file: base64 of the token and its id on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


class _Index(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def _packed(x: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(x)


def _unpacked(x: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(x)


def _planes(x: np.ndarray) -> bytes:
    """Numbers as packed byte planes: all low bytes first."""
    return _packed(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _from_planes(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_unpacked(x), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _joined(parts: list[bytes]) -> bytes:
    """Byte strings with their lengths, packed."""
    n = _planes(np.fromiter(map(len, parts), np.uint32, len(parts)))
    return len(n).to_bytes(4, "little") + n + _packed(b"".join(parts))


def _parts(x: bytes) -> list[bytes]:
    size = 4 + int.from_bytes(x[:4], "little")
    raw = _unpacked(x[size:])
    at = [0, *np.cumsum(_from_planes(x[4:size]).astype(np.int64)).tolist()]
    return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]


#: kind 0: a page of a block's distinct words or, after encoding, of their ids; kind 1: a document.
SCHEMA = "block long, kind int, bucket int, doc_id {key}, n int, places binary, payload binary"


def _batch(rows: list[tuple], key: pa.DataType) -> pa.RecordBatch:
    types = {"block": pa.int64(), "kind": pa.int32(), "bucket": pa.int32(), "doc_id": key, "n": pa.int32(), "places": pa.binary(), "payload": pa.binary()}
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, types.values(), strict=True)], names=list(types))


def _blocks(docs: DataFrame, pattern: str, buckets: int, pages: bool, text: str = "text") -> DataFrame:
    """The pages of distinct words, or the documents, of all blocks."""
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        find, index, rows, chars, kind, name = regex.compile(pattern).findall, _Index(), [], 0, None, xxhash.xxh3_64()

        def flush():
            block = name.intdigest() - (1 << 63)
            every = np.concatenate([r[2] for r in rows])
            order = np.argsort(-np.bincount(every, minlength=len(index)), kind="stable")  # frequent words get small numbers, which pack well
            if not pages:
                rank = np.empty(len(order), np.uint32)
                rank[order] = np.arange(len(order), dtype=np.uint32)
                return _batch([(block, 1, None, doc_id, n, None, _planes(rank[x])) for doc_id, n, x in rows], kind)
            first = [w.encode() for w in index]
            words = [first[i] for i in order.tolist()]
            dealt = [[] for _ in range(buckets)]
            for i, w in enumerate(words):
                dealt[xxhash.xxh3_64_intdigest(w) % buckets].append(i)
            out = []
            for b, own in enumerate(dealt):
                if own:
                    own.sort(key=words.__getitem__)
                    out.append((block, 0, b, None, len(own), _planes(np.array(own, np.uint32)), _joined([words[i] for i in own])))
            return _batch(out, kind)

        for part in rows_in_slices(batches):
            kind = part.column(0).type
            for doc_id, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                words = find(x or "")
                rows.append((doc_id, len(words), np.fromiter(map(index.__getitem__, words), np.uint32, len(words))))
                name.update(f"{doc_id} {x}".encode())
                chars += len(x or "")
                if chars >= BLOCK_CHARS or len(rows) >= BLOCK_DOCS:
                    yield flush()
                    index, rows, chars, name = _Index(), [], 0, xxhash.xxh3_64()
        if rows:
            yield flush()

    return docs.select("doc_id", text).mapInArrow(run, SCHEMA.format(key=key))


def encoder(ranks: dict[bytes, int], pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


def _encode_pages(pages: DataFrame, ranks, pattern: str) -> DataFrame:
    """The same pages with ids in place of words.  Pages come sorted by bucket; each distinct word of a bucket is encoded once."""
    schema = pages.schema

    def run(batches: Iterator[pa.RecordBatch]):
        if "encode" not in _PIECES:
            _PIECES["encode"] = encoder(ranks.value, pattern)
        encode, bucket, known = _PIECES["encode"], None, {}
        for part in rows_in_slices(batches, 64):
            out = []
            for r in part.to_pylist():
                if r["bucket"] != bucket:
                    bucket, known = r["bucket"], {}
                ids = []
                for w in _parts(r["payload"]):
                    if (got := known.get(w)) is None:
                        known[w] = got = np.array(encode(w), np.uint32).tobytes()
                    ids.append(got)
                out.append((r["block"], 0, r["bucket"], None, r["n"], r["places"], _joined(ids)))
            yield _batch(out, part.column(3).type)

    return pages.mapInArrow(run, schema)


def token_bytes(ranks: dict[bytes, int]) -> list[bytes]:
    """The table from id to bytes, of the vocabulary's size."""
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, i in ranks.items():
        table[i] = token
    return table


def decoded_bytes(ids: list[int], table: list[bytes]) -> bytes:
    """A document's bytes: its ids looked up in the table, in order."""
    return b"".join([table[i] for i in ids])


def _reassemble(rows: DataFrame, ranks, finish, schema: str) -> DataFrame:
    """Blocks arrive with their id pages first; finish(doc_id, ids as bytes, token bytes by id) gives a document's row."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]):
        table = token_bytes(ranks.value)
        block, ids = None, []
        for part in rows_in_slices(batches, 256):
            out = []
            for r in part.to_pylist():
                if r["block"] != block:
                    block, ids = r["block"], []
                if r["kind"] == 0:
                    places = _from_planes(r["places"])
                    if (size := int(places.max()) + 1) > len(ids):
                        ids += [None] * (size - len(ids))
                    for i, x in zip(places.tolist(), _parts(r["payload"]), strict=True):
                        ids[i] = x
                else:
                    places = _from_planes(r["payload"]).tolist()
                    out.append(finish(r["doc_id"], b"".join([ids[i] for i in places]), table))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t.type) for c, t in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return rows.mapInArrow(run, schema)


def _run(docs: DataFrame, ranks_path: str, pattern: str, finish, columns: str, buckets: int) -> DataFrame:
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(load_ranks(ranks_path))  # the vocabulary: its size doesn't depend on the documents
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pages = _blocks(docs, pattern, buckets, True).repartition(min(parts, buckets), "bucket").sortWithinPartitions("bucket")
    back = _encode_pages(pages, ranks, pattern).unionByName(_blocks(docs, pattern, buckets, False))
    by_block = back.repartition(parts, "block").sortWithinPartitions("block", "kind")
    return _reassemble(by_block, ranks, finish, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {columns}")


def buckets_for(text_bytes: int) -> int:
    """More buckets where there are more distinct words, which grow as a power of 0.6 or so of the text; a block never has over 2048 pages."""
    return min(2048, max(BUCKETS, 1 << math.ceil(math.log2(16 * (1 + text_bytes / 32e6) ** 0.6))))


def encode(docs: DataFrame, ranks_path: str, pattern: str, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, ids array<int>) of every document."""

    def finish(doc_id, raw, table):
        return doc_id, np.frombuffer(raw, np.uint32).astype(np.int32).tolist()

    return _run(docs, ranks_path, pattern, finish, "ids array<int>", buckets)


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, decoded binary): each id's bytes, by a broadcast of the token-byte table."""
    from fuzzloom.llm.common import by_slice

    ranks = encoded.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))
    key = encoded.schema["doc_id"].dataType.simpleString()

    def make():
        table = token_bytes(ranks.value)
        return lambda part: {"doc_id": part.column(0), "decoded": [decoded_bytes(x or [], table) for x in part.column(1).to_pylist()]}

    return by_slice(encoded.select("doc_id", "ids"), make, f"doc_id {key}, decoded binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document's ids and of the bytes decoded from them."""

    def finish(doc_id, raw, table):
        ids = np.frombuffer(raw, np.uint32).tolist()
        return doc_id, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded_bytes(ids, table)).hexdigest()

    return _run(docs, ranks_path, pattern, finish, "n_tokens long, ids_sha256 string, decoded_sha256 string", buckets)


def round_trip_query(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    return round_trip(docs.select("doc_id", "text"), ranks_path, pattern, buckets_for(text_bytes(docs)))
