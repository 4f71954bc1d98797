"""Removal of repeated passages with a sparse suffix array (operator 11).

A passage is a string of LENGTH bytes that starts at two places or more. Of every such string one place is an anchor: the
least of the gram hashes at its first WINDOW places, which depends on the string alone, so that copies have their anchors
at the same places. Only suffixes at anchors are sorted, and each stands for the run of strings that share its anchor.

1. Anchors are counted by a hash of the bytes that all strings of a run hold (its head); an anchor whose head occurs once
   goes. Runs that are equal as a whole are one class, whatever their number: of a class, one suffix is sorted.
2. Sampled splitters deal the suffixes out by their heads. A task sorts its bucket by multikey quicksort, with eight bytes
   as a key, forwards from the anchor and backwards before it, and compares neighbours: strings are equal where they agree
   on both sides. Equal heads are never parted, so that no string crosses from one bucket to the next, but where a head has
   more classes than a bucket should hold: their strings are compared across all buckets by 128-bit hashes.
3. The strings found lie in one span around each anchor; a document's spans are laid over each other and cut out.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.arrows import slices
from weftline.llm.common import bounded_batches, free_name, staged, table

LENGTH, GRAM = 200, 8
#: About how many suffixes a bucket has, and how many classes of one head it holds at most.
BUCKET, WIDE = 50_000, 65_536
PRIMES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
HIGH = np.uint64(0xFFFFFFFF00000000)


def window_of(length: int) -> int:
    """How many places the anchor of a string is chosen from: a power of two that leaves room for the last gram."""
    if length < GRAM:
        raise ValueError(f"passages have {GRAM} bytes or more")
    return 1 << ((length - GRAM + 1).bit_length() - 1)


class Anchors(NamedTuple):
    """Anchors at ``at`` of ``data``, for the strings that start at ``first`` to ``last``, in text ``doc``."""

    data: bytes
    starts: np.ndarray
    doc: np.ndarray
    at: np.ndarray
    first: np.ndarray
    last: np.ndarray


def anchors(texts: list[bytes], length: int) -> Anchors:
    """The anchors of all strings of ``length`` bytes in ``texts``, which lie in ``data`` with a byte between them."""
    window = window_of(length)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    data = b"\0".join(texts) + bytes(window + GRAM)
    n = len(data) - GRAM + 1
    with np.errstate(over="ignore"):
        x = np.ndarray((n,), dtype="<u8", buffer=data, strides=(1,)) * PRIMES[0]
        x ^= x >> np.uint64(29)
        x *= PRIMES[1]
    # the place in the low half: the first of equal hashes is the least
    x = (x & HIGH) | np.arange(n, dtype=np.uint64)
    step = 1
    while step < window:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    whole = np.zeros(len(x) + 1, dtype=np.int8)
    long = sizes >= length
    np.add.at(whole, starts[long], 1)
    np.add.at(whole, starts[long] + sizes[long] - length + 1, -1)
    begin = np.flatnonzero(np.cumsum(whole[:-1]))
    place = (x[begin] & ~HIGH).astype(np.int64)
    new = np.ones(len(begin), dtype=bool)
    new[1:] = place[1:] != place[:-1]
    ends = np.append(new[1:], True) if len(new) else new
    at = place[new]
    return Anchors(data, starts, np.searchsorted(starts, at, side="right") - 1, at, begin[new], begin[ends])


def prints(found: Anchors, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each anchor's head and that of its whole run, as int64."""
    view, head = memoryview(found.data), length - window_of(length) + 1
    of = xxhash.xxh3_64_intdigest
    c = np.fromiter((of(view[p : p + head]) for p in found.at.tolist()), dtype=np.uint64, count=len(found.at))
    f = np.fromiter((of(view[a : b + length], 1) for a, b in zip(found.first.tolist(), found.last.tolist(), strict=True)), dtype=np.uint64, count=len(found.at))
    return c.view(np.int64), f.view(np.int64)


def _texts(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()]


def _prints(length: int):  # noqa: ANN202
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            found = anchors(_texts(batch.column(1)), length)
            c, f = prints(found, length)
            order = np.lexsort((f, c, found.doc))
            doc, c, f = found.doc[order], c[order], f[order]
            new = np.ones(len(c), dtype=bool)
            new[1:] = (doc[1:] != doc[:-1]) | (c[1:] != c[:-1]) | (f[1:] != f[:-1])
            at = np.flatnonzero(new)
            times = np.diff(np.append(at, len(c)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc[at], pa.int64())), pa.array(c[at]), pa.array(f[at]), pa.array(times, pa.int64())], names=["u", "c", "f", "n"])

    return work


def multikey_sort(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows of big-endian words, and how many leading bytes each row in it shares with the one before.

    Multikey quicksort: rows are sorted by one word, and only those that are still equal by the next.
    """
    n, depth = words.shape
    order, shared = np.arange(n), np.full(n, depth)
    todo, group = np.arange(n), np.zeros(n, dtype=np.int64)
    for k in range(depth):
        if len(todo) < 2:
            break
        rows = order[todo]
        keys = words[rows, k]
        perm = np.lexsort((keys, group))
        keys = keys[perm]
        order[todo] = rows[perm]
        apart = group[1:] != group[:-1]
        differs = ~apart & (keys[1:] != keys[:-1])
        shared[todo[1:][differs]] = k
        group = np.cumsum(np.append(False, apart | differs))
        keep = np.bincount(group)[group] > 1
        todo, group = todo[keep], group[keep]
    at = np.flatnonzero(shared < depth)
    at = at[at > 0]
    x = words[order[at - 1], shared[at]] ^ words[order[at], shared[at]]
    same = 8 * shared
    same[at] += sum((x < np.uint64(1 << (64 - 8 * j))).astype(np.int64) for j in range(1, 8))
    same[:1] = 0
    return order, same


def _words(parts: list[bytes], size: int) -> np.ndarray:
    size = -(-size // 8) * 8
    return np.frombuffer(b"".join(x.ljust(size, b"\0") for x in parts), dtype=">u8").astype(np.uint64).reshape(len(parts), size // 8)


def repeated(right: list[bytes], left: list[bytes], often: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """How far before its anchor the last and the first repeated string of each run start; -1 where none is repeated.

    ``right`` are the bytes from the anchor to the end of the run's last string, ``left`` those from the start of its first
    string to the anchor. Runs differ from each other; one that occurs ``often`` has all its strings repeated.
    """
    n, window = len(right), window_of(length)
    nearest, farthest = length - np.array([len(x) for x in right], dtype=np.int64), np.array([len(x) for x in left], dtype=np.int64)
    low = np.where(often, nearest, window)
    high = np.where(often, farthest, -1)
    forward, forward_same = multikey_sort(_words(right, length))
    backward, backward_same = multikey_sort(_words([x[::-1] for x in left], window))
    after, before = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    for a in range(window):
        # strings that start ``a`` bytes before the anchor are equal where both sides are
        has = np.flatnonzero((nearest <= a) & (a <= farthest))
        if len(has) < 2:
            continue
        after[forward] = np.cumsum(forward_same < length - a)
        before[backward] = np.cumsum(backward_same < a)
        key = after[has] * (n + 1) + before[has]
        order = np.argsort(key, kind="stable")
        key, same = key[order], np.zeros(len(has), dtype=bool)
        equal = key[1:] == key[:-1]
        same[1:] |= equal
        same[:-1] |= equal
        found = has[order[same]]
        low[found] = np.minimum(low[found], a)
        high[found] = np.maximum(high[found], a)
    return np.where(high < 0, -1, low), high


def _bucket(length: int):  # noqa: ANN202
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches([b for b in batches if b.num_rows] or [pa.RecordBatch.from_pylist([], pa.schema([("c", pa.int64()), ("f", pa.int64()), ("n", pa.int64()), ("right", pa.binary()), ("left", pa.binary())]))])
        c, f = rows["c"].to_numpy(), rows["f"].to_numpy()
        order = np.lexsort((f, c))
        new = np.ones(len(order), dtype=bool)  # rows of documents that share an id and a text repeat a class
        new[1:] = (np.diff(c[order]) != 0) | (np.diff(f[order]) != 0)
        rows = rows.take(pa.array(order[new]))
        low, high = repeated(rows["right"].to_pylist(), rows["left"].to_pylist(), rows["n"].to_numpy() > 1, length)
        at = np.flatnonzero(high >= 0)
        kept = rows.take(pa.array(at))
        out = pa.table({"c": kept["c"], "f": kept["f"], "low": pa.array(low[at], pa.int32()), "high": pa.array(high[at], pa.int32())})
        yield from out.combine_chunks().to_batches(max_chunksize=50_000)

    return work


def _flat(column: pa.Array, *names: str) -> tuple[np.ndarray, ...]:
    """The number of the row of each entry of a column of lists of structs, and the entries' fields."""
    own = np.repeat(np.arange(len(column)), np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False), nan=0).astype(np.int64))
    entries = column.flatten()
    return own, *(entries.field(x).to_numpy(zero_copy_only=False) for x in names)


def _wanted(batch: pa.RecordBatch, text: int, wanted: int, length: int, *names: str):  # noqa: ANN202
    """Anchors of the batch's texts and, for those that the lists of column ``wanted`` name, their fields ``names``."""
    own, c, f, *fields = _flat(batch.column(wanted), "c", "f", *names)
    rows = np.unique(own)
    found = anchors(_texts(batch.column(text).take(pa.array(rows))), length)
    known = {key: k for k, key in enumerate(zip(own.tolist(), c.tolist(), f.tolist(), strict=True))}
    heads, runs = prints(found, length)
    at = np.array([known.get(key, -1) for key in zip(rows[found.doc].tolist(), heads.tolist(), runs.tolist(), strict=True)], dtype=np.int64)
    hit = np.flatnonzero(at >= 0)
    return found, rows, hit, heads, runs, [x[at[hit]] for x in fields]


def _contexts(text: int, wanted: int, length: int):  # noqa: ANN202
    """The suffixes that are asked for: c, f, n, right and left, a class once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            found, _, hit, c, f, (n,) = _wanted(batch, text, wanted, length, "n")
            _, once = np.unique(np.stack([c[hit], f[hit]]), axis=1, return_index=True)
            hit, n, view = hit[once], n[once], found.data
            right = [view[p : b + length] for p, b in zip(found.at[hit].tolist(), found.last[hit].tolist(), strict=True)]
            left = [view[a:p] for p, a in zip(found.at[hit].tolist(), found.first[hit].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c[hit]), pa.array(f[hit]), pa.array(n, pa.int64()), pa.array(right, pa.binary()), pa.array(left, pa.binary())], names=["c", "f", "n", "right", "left"])

    return work


def _strings(length: int):  # noqa: ANN202
    """The strings of each run: c, f, n, a (how far before the anchor they start) and two hashes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                run, far = r["left"] + r["right"], len(r["left"])
                hashes = [xxhash.xxh3_128_digest(run[k : k + length]) for k in range(len(run) - length + 1)]
                both = np.frombuffer(b"".join(hashes), dtype="<i8").reshape(-1, 2)
                m = len(both)
                yield pa.RecordBatch.from_arrays([pa.array([r[x]] * m, pa.int64()) for x in ("c", "f", "n")] + [pa.array(far - np.arange(m), pa.int32()), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["c", "f", "n", "a", "h1", "h2"])

    return work


def _cut(columns: int, text: int, marks: int, length: int):  # noqa: ANN202
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            texts, kept, spans = _texts(batch.column(text)), None, [[] for _ in range(batch.num_rows)]
            found, rows, hit, _, _, (low, high) = _wanted(batch, text, marks, length, "low", "high")
            # without bounds, all strings of the run are repeated
            low = np.where(np.isnan(low.astype(np.float64)), found.at[hit] - found.last[hit], low).astype(np.int64)
            high = np.where(np.isnan(high.astype(np.float64)), found.at[hit] - found.first[hit], high).astype(np.int64)
            begin, end = found.at[hit] - high, found.at[hit] - low + length
            order = np.argsort(begin, kind="stable")
            begin, end = begin[order], end[order]
            if len(begin):
                reach = np.maximum.accumulate(end)
                new = np.append(True, begin[1:] > reach[:-1])
                for a, b in zip(begin[new].tolist(), reach[np.append(new[1:], True)].tolist(), strict=True):
                    k = int(np.searchsorted(found.starts, a, side="right")) - 1
                    base = int(found.starts[k])
                    spans[rows[k]].append({"start": a - base, "end": b - base})
            kept = [t if not s else b"".join(t[x:y] for x, y in zip([0, *(e["end"] for e in s)], [*(e["start"] for e in s), len(t)], strict=True)) for t, s in zip(texts, spans, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(columns)), pa.array(spans, spans_type), pa.array(kept, pa.binary())], names=[*(f"c{k}" for k in range(columns)), "removed", "kept"])

    return work


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """u and the columns as c0, c1, ...: rows of the same id and text share a u."""
    columns = docs.columns
    slim = docs.toDF(*(f"c{k}" for k in range(len(columns))))
    return slim.select(F.xxhash64(*(f"c{columns.index(x)}" for x in (id_col, text_col))).alias("u"), "*")


def without_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET, wide: int = WIDE) -> DataFrame:
    """``docs`` with ``removed``, the spans (start, end) in bytes that strings of ``length`` bytes cover which start at another
    place too, in this document or another, and ``kept``, the other bytes of the text.

    Strings are judged on the texts as they are, and copies may overlap. Null texts count as empty; empty ones and those
    shorter than ``length`` have no spans. Repeated rows are copies of each other. An empty table gives no rows. Ids are
    keys only, may be null, repeat or tie, and decide nothing. Where ``docs`` has columns of the new names, the new ones'
    get an underscore more. ``kept`` may part the bytes of a character.
    """
    spark, columns = docs.sparkSession, docs.columns
    bounded_batches(spark)
    head, text = length - window_of(length) + 1, columns.index(text_col)
    rows = _keyed(docs, id_col, text_col)
    anchored = rows.where(F.octet_length(f"c{text}") >= length).select("u", f"c{text}").mapInArrow(_prints(length), "u long, c long, f long, n long")
    heads = anchored.groupBy("c").agg(F.sum("n").alias("all"), F.min("f").alias("least"), F.max("f").alias("most")).where("all > 1")
    shared = staged(anchored.join(heads.select("c", (F.col("least") != F.col("most")).alias("mixed")), "c"), "shared-heads")
    classes = shared.where("mixed").groupBy("c", "f").agg(F.sum("n").alias("n"), F.min("u").alias("u"))
    sized = classes.join(classes.groupBy("c").agg((F.count("*") > wide).alias("wide")), "c")

    def suffixes(which: str) -> DataFrame:
        asked = sized.where(which).groupBy("u").agg(F.collect_list(F.struct("c", "f", "n")).alias("wanted"))
        return rows.join(asked, "u").mapInArrow(_contexts(1 + text, 1 + len(columns), length), "c long, f long, n long, right binary, left binary")

    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-shared.where("mixed").count() // bucket))
    dealt = suffixes("not wide").repartitionByRange(buckets, F.substring("right", 1, head))
    found = dealt.mapInArrow(_bucket(length), "c long, f long, low int, high int")
    strings = suffixes("wide").mapInArrow(_strings(length), "c long, f long, n long, a int, h1 long, h2 long")
    again = strings.groupBy("h1", "h2").agg(F.sum("n").alias("all")).where("all > 1").select("h1", "h2")
    across = strings.join(again, ["h1", "h2"], "left_semi").groupBy("c", "f").agg(F.min("a").alias("low"), F.max("a").alias("high"))
    none = F.lit(None).cast("int")
    marks = shared.where("not mixed").select("u", "c", "f", none.alias("low"), none.alias("high"))
    marks = marks.union(shared.where("mixed").join(found.union(across), ["c", "f"]).select("u", "c", "f", "low", "high"))
    of_row = marks.groupBy("u").agg(F.collect_list(F.struct("c", "f", "low", "high")).alias("marks"))
    met = rows.join(of_row, "u", "left").drop("u")
    kinds = [("removed", T.ArrayType(T.StructType().add("start", T.LongType()).add("end", T.LongType()))), ("kept", T.BinaryType())]
    schema = T.StructType([*met.drop("marks").schema, *(T.StructField(x, kind) for x, kind in kinds)])
    out = met.mapInArrow(_cut(len(columns), text, len(columns), length), schema)
    return out.toDF(*columns, *(free_name(x, columns) for x, _ in kinds))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT r, i, md5_number(substr(h, 2 * i + 1, {2 * LENGTH})) AS m FROM (SELECT r, h, unnest(range(0, n - {LENGTH - 1})) AS i FROM d)),
g AS (SELECT r, i, count(*) OVER (PARTITION BY m) AS times FROM w),
s AS (SELECT r, i, i > coalesce(max(i) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {LENGTH}, -1) AS new FROM g WHERE times > 1),
p AS (SELECT r, i, sum(CAST(new AS INT)) OVER (PARTITION BY r ORDER BY i) AS part FROM s),
x AS (SELECT r, part, min(i) AS a, max(i) + {LENGTH} AS b FROM p GROUP BY r, part),
y AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS z FROM x),
c AS (SELECT r, sum(b - a) AS gone, count(*) AS spans, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS before, max(b) AS last FROM y JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(before, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN c USING (r)
"""
