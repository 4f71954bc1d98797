"""MinHash near-dedup with a multi-index Hamming join (operator 6).

A signature is SYMBOLS min-hashes of BITS bits each; two sets of similarity s differ in a symbol with probability 1 - s.
The signature is split into CHUNKS chunks. By the pigeonhole principle, two signatures that differ in at most
``distance`` symbols have a chunk with at most ``distance // CHUNKS`` wrong symbols; all ways to leave out that many
symbols of a chunk are enumerated as keys, so that every pair under the distance threshold shares a key.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.arrows import MIX, hashed_words, mixed, shingle_sets, slices
from weftline.llm.common import bounded_batches, staged, table

#: 32 symbols of 16 bits in 8 chunks. At similarity 0.8 the distance has mean 6.4 and exceeds 15 in about one pair of
#: 7,000; with one allowed error a chunk of 4 is matched with probability 0.82, all 8 fail once in a million.
SYMBOLS, BITS, CHUNKS, DISTANCE = 32, 16, 8, 15
SEED = 20_231
#: Open buckets of at most so many members are joined as they are, larger ones on what tells them from the hub.
SMALL = 16
#: About how many signatures tell how rare symbols are.
ORDER_SAMPLE = 10_000


def _functions(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(seed)
    return draw.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), draw.integers(0, 2**63, n, dtype=np.uint64)


def signatures(sets: np.ndarray, offsets: np.ndarray, seed: int = SEED) -> np.ndarray:
    """The signatures (n x SYMBOLS uint16) of sets of 64-bit hashes; zeros for an empty set."""
    out = np.zeros((len(offsets) - 1, SYMBOLS), dtype=np.uint16)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        starts = offsets[:-1][full]
        with np.errstate(over="ignore"):
            for k, (a, b) in enumerate(zip(*_functions(seed, SYMBOLS), strict=True)):
                least = np.minimum.reduceat((sets ^ b) * a, starts)
                out[full, k] = (mixed(least) >> np.uint64(64 - BITS)).astype(np.uint16)
    return out


def chunk_keys(sig: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """The keys of each signature: for each chunk, its hash with each choice of the allowed errors left out."""
    width, errors = SYMBOLS // CHUNKS, distance // CHUNKS
    keys = []
    with np.errstate(over="ignore"):
        for chunk in range(CHUNKS):
            for n, kept in enumerate(itertools.combinations(range(width), width - errors)):
                key = np.full(len(sig), mixed(np.array([chunk * 1000 + n + 1], dtype=np.uint64))[0], dtype=np.uint64)
                for k in kept:
                    key = mixed(key * MIX + sig[:, chunk * width + k].astype(np.uint64))
                keys.append(key)
    return np.stack(keys, axis=1).view(np.int64)


def fingerprinted(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, set_hash (of the whole set; null if empty) and signature of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            sets, at = shingle_sets(*hashed_words(batch.column(1)), size)
            sig = signatures(sets, at)
            data = sets.tobytes()
            hashes = [hashlib.blake2b(data[8 * a : 8 * b], digest_size=16).digest() if b > a else None for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at)), pa.array(hashes, pa.binary()), pa.array([x.tobytes() for x in sig], pa.binary())], names=["doc_id", "n_shingles", "set_hash", "signature"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, "doc_id long, n_shingles long, set_hash binary, signature binary")


def _keyed(reps: DataFrame, distance: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint16).reshape(-1, SYMBOLS)
            keys = chunk_keys(sig, distance)
            rep = np.repeat(batch.column(0).to_numpy(), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(rep)], names=["key", "rep"])

    return reps.select("rep", "signature").mapInArrow(work, "key long, rep long")


def _sets(docs: DataFrame, reps: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """rep, n and the sorted set (binary) of the representatives that some other may match."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            sets, at = shingle_sets(*hashed_words(batch.column(1)), size)
            data = sets.tobytes()
            own = [data[8 * a : 8 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], names=["rep", "members"])

    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text"))
    return texts.join(reps.hint("shuffle_merge"), "rep", "left_semi").mapInArrow(work, "rep long, members binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union on their full sets."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                both = 0
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    z = np.concatenate([x, y])
                    z.sort(kind="stable")
                    both = int(np.count_nonzero(z[1:] == z[:-1]))
                keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("rep").alias("a"), F.col("members").alias("x"))
    right = sets.select(F.col("rep").alias("b"), F.col("members").alias("y"))
    return pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(work, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of the links (a, b), which are read in every round.

    In a round, a node and its label both learn the least label next to the node, and a node learns its label's label, so
    that long chains take few rounds. Every round is one written table.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        label = lambda node, to: labels.select(F.col("node").alias(node), F.col("component").alias(to))  # noqa: B023, E731
        near = both.join(label("b", "to"), "b").groupBy("a").agg(F.min("to").alias("to")).join(label("a", "own"), "a")
        told = near.select(F.explode(F.array(F.struct(F.col("a").alias("node"), "to"), F.struct(F.col("own").alias("node"), "to"))).alias("x")).select("x.node", "x.to")
        jump = labels.join(label("component", "to"), "component").select("node", "to")
        new = told.union(jump).groupBy("node").agg(F.min("to").alias("component")).join(label("node", "old"), "node")
        new = staged(new.select("node", "old", F.least("old", "component").alias("component")), "labels")
        labels = new.select("node", "component")
        if new.where("old != component").isEmpty():
            return labels


def _labelled(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Key rows with the component of their representative, where a key still has several components."""
    comp = components(links)
    rows = rows.join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left").select("key", "rep", "pop", F.coalesce("component", "rep").alias("component"))
    open_ = rows.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("key")
    return rows.join(open_, "key")


def _open_pairs(rows: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, distance: int) -> DataFrame:
    """The pairs (a, b) of different components that share an open bucket and may be linked.

    The buckets whose hubs are of one component are one family with one hub. Two members of a family differ in at most
    ``distance`` symbols if they are linked. So one that differs from the hub in more has, with all that are linked to
    it, such a symbol in common (``_placed``). Members that are all close to the hub are told apart by their
    differences from its full set (``_differences``).
    """
    hubs = rows.groupBy("key").agg(F.count("*").alias("n"), F.max(F.struct("pop", (-F.col("rep")).alias("back"), "component")).alias("hub"))
    hubs = hubs.select("key", "n", "hub", F.col("hub.component").alias("home"))
    rows = staged(rows.join(hubs, "key").select("key", "rep", "component", "n", "hub", "home"), "open")
    few = rows.where(F.col("n") <= SMALL)
    x = few.where("component != home").select("key", F.col("rep").alias("a"), F.col("component").alias("ca"))
    y = few.select("key", F.col("rep").alias("b"), F.col("component").alias("cb"))
    pairs = x.join(y, "key").where("ca != cb").select("a", "b")

    many = rows.where(F.col("n") > SMALL)
    best = many.groupBy("home").agg((-F.max("hub")["back"]).alias("hub"))
    many = many.groupBy("home", "rep").agg(F.first("component").alias("component")).join(best, "home").where("rep != hub")
    placed = staged(_placed(many, classes, distance), "placed")
    symbols = _shared(staged(placed.select("home", "rep", "component", "off", F.explode("symbols").alias("symbol")), "symbols"), distance)
    x = symbols.where(F.col("off") > distance).select("home", "symbol", F.col("rep").alias("a"), F.col("component").alias("ca"))
    y = symbols.select("home", "symbol", F.col("rep").alias("b"), F.col("component").alias("cb"))
    pairs = pairs.union(x.join(y, ["home", "symbol"]).where("ca != cb").select("a", "b"))

    close = placed.where(F.col("off") <= distance).select("hub", "rep", "component", (F.col("component") != F.col("home")).alias("far"))
    parts = staged(_differences(close, sets, percent), "differences")
    columns = ("component", "n", "d", "added", "lacking")
    x = parts.where("outer").select("part", F.col("rep").alias("a"), *(F.col(k).alias(f"a_{k}") for k in columns))
    y = parts.where("inner").select("part", F.col("rep").alias("b"), *(F.col(k).alias(f"b_{k}") for k in columns))
    # no difference before this one is shared, or the pair meets there
    shared = F.least("a_added", "b_added") + F.least("a_lacking", "b_lacking")
    near = 2 * (100 + percent) * shared >= (100 + percent) * (F.col("a_d") + F.col("b_d")) - (100 - percent) * (F.col("a_n") + F.col("b_n"))
    met = x.join(y, "part").where((F.col("a_component") != F.col("b_component")) & near)
    # a far member that the family's hub itself is linked to shows in the hub's own row
    direct = close.where("far").select(F.col("hub").alias("a"), F.col("rep").alias("b"))
    pairs = pairs.union(met.select("a", "b")).union(direct)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _placed(members: DataFrame, classes: DataFrame, distance: int) -> DataFrame:
    """Members of families (home, hub, rep, component) with ``off`` and ``symbols``.

    ``off`` counts the symbols in which a member differs from the hub. Say that A and B differ in at most ``distance``
    symbols and that A differs from the hub in a > distance. Then they share at least a - distance symbols that the hub
    lacks: where A differs from the hub, B differs from A at most ``distance`` times, and the same holds for B's b. In
    one order of all symbols they share one of the first a - (a - distance) + 1 of A and b - max(1, b - distance) + 1 of
    B. Rare symbols come first. How rare they are is counted on a bounded sample of signatures, as the order decides
    the work alone, not the pairs.
    """
    spark = classes.sparkSession
    n = classes.count()
    drawn = classes.select("signature").sample(min(1.0, ORDER_SAMPLE / max(n, 1)), SEED).limit(2 * ORDER_SAMPLE).collect()
    seen = np.frombuffer(b"".join(bytes(r[0]) for r in drawn), dtype=np.uint16).reshape(-1, SYMBOLS).astype(np.int64)
    counts = spark.sparkContext.broadcast(np.stack([np.bincount(seen[:, k] >> 4, minlength=1 << (BITS - 4)) for k in range(SYMBOLS)]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.arange(SYMBOLS, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            own, base = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint16).reshape(-1, SYMBOLS).astype(np.int64) for k in (4, 5))
            differs = own != base
            off = differs.sum(axis=1)
            names = (place << BITS) + own
            rank = (np.where(differs, counts.value[place, own >> 4], 1 << 40) << 22) + names
            order = np.argsort(rank, axis=1)
            first = np.where(off > distance, distance + 1, off)
            names = np.take_along_axis(names, order, axis=1)[place < first[:, None]]
            ends = np.concatenate([[0], np.cumsum(first)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(off), pa.ListArray.from_arrays(pa.array(ends), pa.array(names))], names=["home", "hub", "rep", "component", "off", "symbols"])

    own = classes.select("rep", F.col("signature").alias("x"))
    base = classes.select(F.col("rep").alias("hub"), F.col("signature").alias("y"))
    return members.join(own, "rep").join(base, "hub").select("home", "hub", "rep", "component", "x", "y").mapInArrow(work, "home long, hub long, rep long, component long, off long, symbols array<long>")


def _shared(symbols: DataFrame, distance: int) -> DataFrame:
    """The symbol rows (home, rep, component, off, symbol) that a pair can come of, written once for both its sides.

    Those are of symbols that several components have, one of them far from the hub. What a large group of linked members
    has to itself would meet itself otherwise, and give nothing.
    """
    several = symbols.groupBy("home", "symbol").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.max("off").alias("most"))
    several = several.where((F.col("x") != F.col("y")) & (F.col("most") > distance)).select("home", "symbol")
    return staged(symbols.join(several, ["home", "symbol"]).select("home", "rep", "component", "off", "symbol"), "symbols")


def _differences(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Differences from the hub, of which linked members share one.

    Rows are (part, rep, component, n, d, added, lacking, inner, outer); n and d are the sizes of the set and of its
    difference, ``added`` and ``lacking`` count what of the difference stands here and later in the order.

    d(X) is the size of X's symmetric difference from the hub H, and c = (100 - percent) / (100 + percent). X and Y are
    linked where their own symmetric difference is at most c (|X| + |Y|); it is d(X) + d(Y) - 2 s, where s counts the
    differences from H that both have. A far member A that is linked to H needs no differences. Any other has
    d(A) > c (|A| + |H|), and a member B that is linked to A has 2 s > d(B) + c (|H| - |B|): about half of B's
    differences are A's too. For either, s is at least d(X) - c |X| (1 + 100 / percent), as s is no more than the
    other's d. In one order of all differences, shingles that H lacks before those that it has, A and B then share one
    of the first d - s + 1 of each.
    ``outer`` marks those of a far member, ``inner`` those of any member that is linked to a far one.
    """
    c = (100 - percent) / (100 + percent)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for hub, rep, comp, far, own, base in zip(*(batch.column(k).to_pylist() for k in range(4)), batch.column(4), batch.column(5), strict=True):
                own, base = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (own, base))
                more, less = np.setdiff1d(own, base, assume_unique=True), np.setdiff1d(base, own, assume_unique=True)
                parts = np.concatenate([more, less])
                d, n = len(parts), len(own)
                least = max(1, int(np.ceil(d - c * n * (1 + 100 / percent) - 1e-6)))
                inner = max(0, d + 1 - max(least, int(np.floor((d + c * (len(base) - n)) / 2 - 1e-6)) + 1))
                outer = max(0, d + 1 - least) if far else 0
                at = np.arange(max(inner, outer))
                with np.errstate(over="ignore"):
                    keys = mixed(parts[: len(at)] * MIX + np.uint64(hub % 2**64))
                out.append((keys.view(np.int64), np.full(len(at), rep), np.full(len(at), comp), np.full(len(at), n), np.full(len(at), d), np.maximum(len(more) - at, 0), np.minimum(d - at, len(less)), at < inner, at < outer))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["part", "rep", "component", "n", "d", "added", "lacking", "inner", "outer"])

    own = sets.select("rep", F.col("members").alias("x"))
    base = sets.select(F.col("rep").alias("hub"), F.col("members").alias("y"))
    return members.join(own, "rep").join(base, "hub").select("hub", "rep", "component", "far", "x", "y").mapInArrow(work, "part long, rep long, component long, n long, d long, added long, lacking long, inner boolean, outer boolean")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row.

    Documents of equal sets stand as one representative. Every pair of representatives whose signatures differ in at
    most ``distance`` symbols is a candidate. In each bucket, members are first compared with the hub, the member that
    meets most others; members that are linked already need no more comparison, since only components are asked for.
    Then members of different components are compared where they share a symbol or a shingle that their hub
    lacks and that a link would need (``_placed``, ``_differences``), so that no link between components is lost and no
    bucket is multiplied by itself.
    Links are confirmed on the full sets.

    Null, empty and blank texts have an empty set and are linked with nothing. Rows that share an id are one document:
    they have one component. A null id takes no part (component_id null, kept). An empty table gives no rows; other
    columns are not read.
    """
    bounded_batches(docs.sparkSession)
    facts = staged(fingerprinted(docs, size, id_col, text_col), "fingerprints")
    whole = facts.where("doc_id is not null and set_hash is not null")
    classes = whole.groupBy("set_hash").agg(F.min("doc_id").alias("rep"), F.min_by("signature", "doc_id").alias("signature"))
    classes = staged(classes, "classes")
    keyed = _keyed(classes, distance)
    often = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    rows = staged(keyed.join(often, "key"), "buckets")
    pop = rows.groupBy("rep").agg(F.sum("n").alias("pop"))
    sets = staged(_sets(docs, pop.select("rep"), size, id_col, text_col), "sets")
    rows = staged(rows.join(pop, "rep").select("key", "rep", "pop"), "buckets")
    # an id with several sets links them, and so do equal sets
    equal = whole.join(classes.select("set_hash", "rep"), "set_hash").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).where("a != b").distinct()
    best = rows.groupBy("key").agg(F.max(F.struct("pop", (-F.col("rep")).alias("back"))).alias("hub")).select("key", (-F.col("hub.back")).alias("a"))
    pairs = rows.join(best, "key").where("a != rep").select("a", F.col("rep").alias("b")).distinct()
    links = staged(equal.union(_confirmed(_close(pairs, classes, distance), sets, percent)), "links")
    labelled = staged(_labelled(rows, links), "open")
    if not labelled.isEmpty():
        pairs = staged(_open_pairs(labelled, classes, sets, percent, distance), "pairs")
        links = staged(links.union(_confirmed(_close(pairs, classes, distance), sets, percent)), "links")
    comp = components(links)
    found = facts.join(comp.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    out = found.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _close(pairs: DataFrame, classes: DataFrame, distance: int) -> DataFrame:
    """The pairs whose signatures differ in at most ``distance`` symbols."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint16).reshape(-1, SYMBOLS) for k in (2, 3))
                yield batch.select([0, 1]).filter(pa.array((x != y).sum(axis=1) <= distance))

    left = classes.select(F.col("rep").alias("a"), F.col("signature").alias("x"))
    right = classes.select(F.col("rep").alias("b"), F.col("signature").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(work, "a long, b long")


def op6_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=2)
