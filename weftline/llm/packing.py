"""Packing: shortest-pack-first over the length histogram (operator 8)."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm.arrows import slices
from weftline.llm.common import bounded_batches, staged, table
from weftline.llm.tokens import encoder

END_ID = 2
CAPACITY = 4096

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of at most ``capacity`` ids of each document's ids with the end id; null text counts as empty."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        for batch in slices(batches, 1):
            ids, offsets = enc.encode(batch.column(1))
            data, step = ids.tobytes(), 4 * capacity
            rows = []
            for doc, a, b in zip(batch.column(0).to_pylist(), (offsets[:-1] * 4).tolist(), (offsets[1:] * 4).tolist(), strict=True):
                own = data[a:b] + end
                rows += [(doc, i // 4, len(own[i : i + step]) // 4, zlib.crc32(own[i : i + step]), len(own) // 4) for i in range(0, len(own), step)]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, PIECES)


def pack_histogram(histogram: dict[int, int], capacity: int = CAPACITY) -> pd.DataFrame:
    """Places lengths longest first into the open packing pattern with the most room, splitting patterns by count.

    The work depends on the number of different lengths and patterns only, never on the number of documents. Returns
    one row per slot of a pattern: ``length``, ``rank`` (of the first piece of that length in this slot), ``packs``
    (how many packs follow the pattern, so how many ranks the slot takes), ``first`` (the first pack's number) and
    ``offset`` in the pack.
    """
    # A pattern is a chain of (length, parent) links; the heap orders open patterns by room, the roomiest first.
    open_: list[tuple[int, int, int, tuple | None]] = []
    closed: list[tuple[int, tuple | None]] = []
    made = 0
    for length in sorted((x for x, n in histogram.items() if n), reverse=True):
        left, later = histogram[length], []
        while left:
            if open_ and -open_[0][0] >= length:
                room, _, count, chain = heapq.heappop(open_)
                used = min(count, left)
                if count > used:
                    made += 1
                    heapq.heappush(open_, (room, made, count - used, chain))
                rest = -room - length
            else:
                per = capacity // length  # a new pattern; further equal lengths join it in the next rounds
                used, rest, chain = max(1, -(-left // per)), capacity - length, None
            left -= used
            made += 1
            entry = (-rest, made, used, (length, chain))
            later.append(entry) if not rest else heapq.heappush(open_, entry)
        closed += [(e[2], e[3]) for e in later]
    closed += [(e[2], e[3]) for e in sorted(open_)]
    rows, first, taken = [], 0, dict.fromkeys(histogram, 0)
    for count, chain in closed:
        slots = []
        while chain:
            slots.append(chain[0])
            chain = chain[1]
        offset = 0
        for length in reversed(slots):
            rows.append((length, taken[length], count, first, offset))
            taken[length] += count
            offset += length
        first += count
    return pd.DataFrame(rows, columns=["length", "rank", "packs", "first", "offset"], dtype="int64")


def ranked(pieces: DataFrame) -> DataFrame:
    """Numbers the pieces of each length 0, 1, ... in the order of doc_id and start.

    A range exchange by length and document deals a common length out to several tasks; each counts its own pieces and
    a table of at most one row per task and length carries the counts on. No length meets in one task.
    """
    order = ["length", "doc_id", "start", "ids_crc32"]
    pieces = staged(pieces, "cut")  # a range exchange reads its input twice

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, length, done = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(batch.schema.get_field_index("length")).to_numpy()
            new = np.concatenate([[True], x[1:] != x[:-1]])
            begins = np.flatnonzero(new)
            base = np.zeros(len(begins), dtype=np.int64)
            if x[0] == length:
                base[0] = done
            sizes = np.diff(np.append(begins, len(x)))
            local = np.arange(len(x)) - np.repeat(begins - base, sizes)
            length, done = x[-1], int(local[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(local), pa.array(np.full(len(x), part))], names=[*batch.schema.names, "local", "part"])

    local = staged(pieces.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(number, f"{PIECES}, local long, part long"), "pieces")
    counts = local.groupBy("length", "part").agg(F.count("*").alias("n"))
    # a row for each length and task: a window by length has a row for each task at most
    before = counts.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    return local.join(before, ["length", "part"]).withColumn("rank", F.col("local") + F.col("before")).drop("local", "part", "before")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces of length 1 to ``capacity``.

    The histogram (at most ``capacity`` rows) and the packing patterns are all that the driver sees. Pieces find their
    slot by their rank among the pieces of their length.
    """
    order = ranked(pieces)
    histogram = {r["length"]: r["n"] for r in order.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = pack_histogram(histogram, capacity).sort_values(["length", "rank"])
    # length and rank in one key, ascending over the slots
    key = (slots["length"].to_numpy() << 48) + slots["rank"].to_numpy()
    found = order.sparkSession.sparkContext.broadcast((key, slots["rank"].to_numpy(), slots["first"].to_numpy(), slots["offset"].to_numpy()))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ranks, first, offset = found.value
        for batch in batches:
            get = lambda name: batch.column(batch.schema.get_field_index(name)).to_numpy()  # noqa: B023, E731
            at = np.searchsorted(keys, (get("length") << 48) + get("rank"), side="right") - 1
            own = [batch.column(batch.schema.get_field_index(x)) for x in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(first[at] + get("rank") - ranks[at]), pa.array(offset[at])], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return order.mapInArrow(place, f"{PIECES}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cuts documents into pieces and packs them into sequences of at most ``capacity`` ids.

    Null and empty texts are a piece of the end id alone; repeated rows are packed as often as they occur; an empty
    table gives no rows. Columns other than the id and the text are not read.
    """
    return pack(pieces_of(docs, tokenizer, capacity, end_id, id_col, text_col), capacity)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
