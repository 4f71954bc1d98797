"""Token-ID output: a content-addressed store of id chunks with document recipes and Merkle manifests (operator 9).

A store is a folder of Parquet files:

* ``data/kind=chunk``: ``address`` (blake2b-128 of the chunk's bytes), ``ids`` (little-endian uint16 or uint32 ids); each
  different chunk once;
* ``recipes``: per document, in ascending ``doc_id`` order over ``shard`` and ``place``: ``doc_id``, ``start`` (ids before
  it), ``n_tokens``, ``chunks`` (the addresses of its chunks, joined), ``root`` (its Merkle root over them);
* ``manifest``: per shard: its documents, ids, first ``start`` and Merkle ``root`` over the document roots.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.arrows import slices
from weftline.llm.common import bounded_batches, new_path, staged, table
from weftline.llm.tokens import encoder

END_ID = 2
#: Chunks have at least LEAST and at most MOST ids, and LEAST + MEAN on average.
LEAST, MEAN, MOST = 64, 256, 1024
#: The ids that the rolling hash sees.
WINDOW = 24
ADDRESS = 16
#: The bytes of text that a task encodes at once, and those of a generation of its cache.
SLICE, CACHE = 6_000_000, 80_000_000


def address(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=ADDRESS).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """The root of the binary Merkle tree over addresses; an odd last node moves up as it is."""
    level = [hashlib.blake2b(b"\0" + x, digest_size=ADDRESS).digest() for x in leaves] or [bytes(ADDRESS)]
    while len(level) > 1:
        level = [hashlib.blake2b(b"\1" + b"".join(level[i : i + 2]), digest_size=ADDRESS).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def borders(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where the rolling hash allows a cut: True after an id. ``starts`` are the first ids of documents.

    The hash is the polynomial sum of the last WINDOW ids of the same document modulo 2**64, from prefix sums.
    """
    n = len(ids)
    base = np.uint64(0x9E3779B97F4A7C15)
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, dtype=np.uint64)
        mixed = ids.astype(np.uint64)
        mixed += np.uint64(1)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.cumprod(np.full(n, inverse, dtype=np.uint64))
        np.cumsum(mixed, out=sums[1:])
        low = np.maximum(np.arange(1 - WINDOW, n + 1 - WINDOW), np.repeat(starts, np.diff(np.append(starts, n))))
        mixed = sums[1:] - sums[low]
        del low, sums
        mixed *= np.cumprod(np.full(n, base, dtype=np.uint64))
        mixed *= np.uint64(0xFF51AFD7ED558CCD)
    return (mixed >> np.uint64(40)) % np.uint64(MEAN) == 0


def cuts(allowed: np.ndarray, length: int) -> list[int]:
    """Ends of the chunks of a document of ``length`` ids: the first allowed place from LEAST on, MOST at the latest."""
    out, start = [], 0
    for place in allowed.tolist():
        while place - start > MOST:
            start += MOST
            out.append(start)
        if place - start >= LEAST:
            out.append(start := place)
    while length - start > MOST:
        start += MOST
        out.append(start)
    if start < length:
        out.append(length)
    return out


ROWS = "key binary, kind string, doc_id long, n_tokens long, chunks binary, ids binary"


def _chunked(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """A recipe row per document and a row for each chunk that is new to the task's batch."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, CACHE)
        narrow = enc.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16
        kind = "<u2" if narrow else "<u4"
        for batch in slices(batches, 1, SLICE):
            n = batch.num_rows
            ids, offsets = enc.encode(batch.column(1))
            ids = np.insert(ids, offsets[1:], end_id)
            offsets = offsets + np.arange(n + 1)
            allowed = np.flatnonzero(borders(ids, offsets[:-1])) + 1
            edges = np.searchsorted(allowed, offsets, side="right")
            data, wide = ids.astype(kind).tobytes(), 2 if narrow else 4
            del ids
            seen: dict[bytes, bytes] = {}
            recipes = []
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                own, begin = [], a
                for end in cuts(allowed[edges[i] : edges[i + 1]] - a, b - a):
                    piece = data[begin * wide : (a + end) * wide]
                    own.append(h := address(piece))
                    seen.setdefault(h, piece)
                    begin = a + end
                recipes.append(b"".join(own))
            docs_ = batch.column(0)
            keys = [address(b"%d" % i + r) for i, r in enumerate(recipes)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(["recipe"] * n), docs_, pa.array(np.diff(offsets)), pa.array(recipes, pa.binary()), pa.nulls(n, pa.binary())], names=["key", "kind", "doc_id", "n_tokens", "chunks", "ids"])
            m = len(seen)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(["chunk"] * m), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.array(list(seen.values()), pa.binary())], names=["key", "kind", "doc_id", "n_tokens", "chunks", "ids"])

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(work, ROWS)


def _unique(rows: DataFrame) -> DataFrame:
    """Chunk rows once each, recipe rows all. Equal chunks meet in one task, sorted, at most one from each batch."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not (n := batch.num_rows):
                continue
            keys, new = batch.column(0), np.ones(n, dtype=bool)
            new[0] = keys[0].as_py() != last
            new[1:] = pc.not_equal(keys.slice(1), keys.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            last = keys[n - 1].as_py()
            yield batch.filter(pc.or_(pa.array(new), pc.equal(batch.column(1), "recipe")))

    return rows.repartition("kind", "key").sortWithinPartitions("kind", "key").mapInArrow(first, ROWS)


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every text (null: empty), appends ``end_id`` and writes the store to ``path``.

    Documents are in ascending order of the id, nulls first, ties by content, repeated rows as often as they occur; an
    empty table makes an empty store. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = _unique(_chunked(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), tokenizer, end_id))
    rows.withColumnRenamed("key", "address").write.partitionBy("kind").parquet(f"{path}/data")
    recipes = _read(spark, f"{path}/data", "address binary, doc_id long, n_tokens long, chunks binary, ids binary, kind string").where("kind = 'recipe'").select("doc_id", "n_tokens", "chunks")

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, done, place = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            n = batch.num_rows
            tokens = batch.column(1).to_numpy()
            ends = done + np.cumsum(tokens)
            roots = [merkle_root([c[i : i + ADDRESS] for i in range(0, len(c), ADDRESS)]) for c in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, shard)), pa.array(np.arange(place, place + n)), pa.array(ends - tokens), pa.array(roots, pa.binary())], names=["doc_id", "n_tokens", "chunks", "shard", "place", "local", "root"])
            done, place = int(ends[-1]) if n else done, place + n

    order = ["doc_id", "n_tokens", "chunks"]
    laid = staged(recipes.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lay, "doc_id long, n_tokens long, chunks binary, shard long, place long, local long, root binary"), "recipes")
    # one row per shard: the driver's share is bounded by the number of partitions
    sums = {r["shard"]: r["n"] for r in laid.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect()}
    starts, total = [], 0
    for shard in sorted(sums):
        starts.append((shard, total))
        total += sums[shard]
    laid = laid.join(F.broadcast(spark.createDataFrame(starts, "shard long, base long")), "shard")
    laid.select("shard", "place", "doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "chunks", "root").write.parquet(f"{path}/recipes")

    def shard_root(group: pa.Table) -> pa.Table:
        rows = group.sort_by("place")
        return pa.table({"shard": rows["shard"][:1], "documents": [rows.num_rows], "n_tokens": [int(np.sum(rows["n_tokens"].to_numpy()))], "start": rows["start"][:1], "root": pa.array([merkle_root(rows["root"].to_pylist())], pa.binary())})

    done = _read(spark, f"{path}/recipes", RECIPES)
    done.select("shard", "place", "n_tokens", "start", "root").groupBy("shard").applyInArrow(shard_root, MANIFEST).write.parquet(f"{path}/manifest")


RECIPES = "shard long, place long, doc_id long, start long, n_tokens long, chunks binary, root binary"
MANIFEST = "shard long, documents long, n_tokens long, start long, root binary"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, f"{path}/data", "address binary, ids binary, kind string").where("kind = 'chunk'").select("address", "ids")


def _listed(spark: SparkSession, path: str) -> DataFrame:
    """A row for each chunk of each document."""
    pieces = F.transform(F.sequence(F.lit(1), (F.length("chunks") / ADDRESS).cast("int")), lambda i: F.substring(F.col("chunks"), (i - 1) * ADDRESS + 1, F.lit(ADDRESS)))
    return _read(spark, f"{path}/recipes", RECIPES).select("shard", "place", F.posexplode(pieces).alias("pos", "address"))


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Documents rebuilt from the files: doc_id, start, n_tokens, ids (array<int>)."""

    def rebuild(group: pa.Table) -> pa.Table:
        data = b"".join(group.sort_by("pos")["ids"].to_pylist())
        return pa.table({"shard": group["shard"][:1], "place": group["place"][:1], "data": pa.array([data], pa.binary())})

    def widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(d, dtype="<u2" if len(d) == 2 * n else "<u4").astype(np.int32) for d, n in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "start", "n_tokens", "ids"])

    whole = _listed(spark, path).join(_chunks(spark, path), "address").groupBy("shard", "place").applyInArrow(rebuild, "shard long, place long, data binary")
    recipes = _read(spark, f"{path}/recipes", RECIPES).select("shard", "place", "doc_id", "start", "n_tokens")
    return recipes.join(whole, ["shard", "place"]).select("doc_id", "start", "n_tokens", "data").mapInArrow(widen, "doc_id long, start long, n_tokens long, ids array<int>")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """What the files say of each document: doc_id, start, n_tokens and the crc32 of its ids as unsigned 32-bit ids.

    Every chunk is read whole, held against its address, and summed up as its id count and crc32; the crc32 of a
    document follows from those of its chunks in recipe order, so that no ids are shuffled. The recipes' Merkle roots
    are recomputed. Whatever doesn't fit raises.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, crcs = batch.column(0).to_pylist(), [], []
            for key, data in zip(keys, batch.column(1).to_pylist(), strict=True):
                if address(data) != key:
                    raise ValueError(f"the chunk at {key.hex()} has other content")
                # an address says nothing of the width; both are summed and the recipe's id count decides
                narrow = np.frombuffer(data, dtype="<u2").astype("<u4").tobytes()
                sizes.append(len(data))
                crcs.append((zlib.crc32(narrow), zlib.crc32(data)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array([c[0] for c in crcs], pa.int64()), pa.array([c[1] for c in crcs], pa.int64())], names=["address", "bytes", "crc2", "crc4"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zeros = bytes(4 * MOST)
        after = [zlib.crc32(zeros[: 4 * k]) for k in range(MOST + 1)]
        for batch in batches:
            n, rows = batch.num_rows, []
            lengths = pc.list_value_length(batch.column(4)).to_numpy(zero_copy_only=False)
            pos, *columns = batch.column(4).flatten().flatten()
            order = pa.array(np.lexsort((pos.to_numpy(), np.repeat(np.arange(n), lengths))))
            keys, *numbers = (c.take(order).to_pylist() for c in columns)
            ends = np.cumsum(lengths).tolist()
            for doc, tokens, root, a, b in zip(batch.column(0), batch.column(2).to_pylist(), batch.column(3).to_pylist(), [0, *ends], ends, strict=False):
                if merkle_root(keys[a:b]) != root:
                    raise ValueError(f"document {doc} has another Merkle root")
                sizes = numbers[0][a:b]
                wide = {2 * tokens: 2, 4 * tokens: 4}.get(sum(sizes))
                if not wide:
                    raise ValueError(f"document {doc} has another length")
                crc = 0
                for size, own in zip(sizes, numbers[1 if wide == 2 else 2][a:b], strict=True):
                    k = size // wide
                    crc = zlib.crc32(zeros[: 4 * k], crc) ^ after[k] ^ own
                rows.append(crc)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(rows, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    known = _chunks(spark, path).mapInArrow(sums, "address binary, bytes long, crc2 long, crc4 long")
    parts = _listed(spark, path).join(known, "address").groupBy("shard", "place").agg(F.collect_list(F.struct("pos", "address", "bytes", "crc2", "crc4")).alias("parts"))
    recipes = _read(spark, f"{path}/recipes", RECIPES).select("shard", "place", "doc_id", "start", "n_tokens", "root")
    return recipes.join(parts, ["shard", "place"]).select("doc_id", "start", "n_tokens", "root", "parts").mapInArrow(join, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "store")
    write_store(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return digests(spark, path)
