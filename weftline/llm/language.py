"""Language ID by rank-order profiles (operator 2).

A profile is the list of the most frequent character n-grams (1 to ORDER letters, with a mark at word edges). A
document's language is the one whose profile is nearest in out-of-place distance: the sum, over the document's own
most frequent n-grams, of how far each stands from its place in the profile.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm.arrows import slices
from weftline.llm.common import bounded_batches, crc_mod, free_name, table

ORDER = 3
#: The length of a profile, and the distance of an n-gram that it lacks.
PROFILE = 300
#: At most about this many documents of each language are learned from, drawn by a hash of their text.
SAMPLE = 400
UNKNOWN = "und"


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point, whether it is a letter (general category L)."""
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)


def ranked_grams(texts: pa.Array, profile: int = PROFILE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The most frequent n-grams of each text: (text number, n-gram code, rank from 0, count), by text and rank.

    Texts are lower-cased; what is not a letter counts as a word edge, code 0. An n-gram's code holds its code points,
    21 bits each. Ties go to the smaller code.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    # an edge before, between and after the texts keeps n-grams inside them
    flat = " " + " ".join(pc.utf8_lower(texts).to_pylist()) + " "
    points = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    sizes = np.fromiter((len(x) for x in pc.utf8_lower(texts).to_pylist()), dtype=np.int64, count=n) + 1
    docs = np.repeat(np.arange(n), sizes)
    docs = np.append(0, docs) if n else docs
    points = np.where(_letters()[points], points, 0)
    keep = np.ones(len(points), dtype=bool)
    keep[1:] = (points[1:] > 0) | (points[:-1] > 0)  # one edge between words
    points, docs = points[keep], docs[keep]
    alphabet, small = np.unique(points, return_inverse=True)
    width = max(1, int(len(alphabet) - 1).bit_length())
    if n > 1 and 3 * width + 2 + n.bit_length() > 62:  # so many characters that a key would not fit: in halves
        a, b = ranked_grams(texts.slice(0, n // 2), profile), ranked_grams(texts.slice(n // 2), profile)
        return np.append(a[0], b[0] + n // 2), np.append(a[1], b[1]), np.append(a[2], b[2]), np.append(a[3], b[3])
    edge = small == 0 if len(alphabet) and alphabet[0] == 0 else np.zeros(len(small), dtype=bool)
    found = []
    grams = small.astype(np.int64)
    for order in range(1, ORDER + 1):
        if len(small) < order:
            break
        if order > 1:
            grams = (grams[:-1] << width) | small[order - 1 :]
        inner = ~edge if order == 1 else np.ones(len(grams), dtype=bool)
        if order == 2:
            inner = ~(edge[:-1] & edge[1:])
        for k in range(1, order - 1):  # no edge inside
            inner &= ~edge[k : len(grams) + k]
        # the text of a gram is that of its first letter
        own = docs[: len(grams)] if order == 1 else np.where(edge[: len(grams)], docs[1 : len(grams) + 1], docs[: len(grams)])
        found.append((own[inner] << np.int64(3 * width + 2)) | (np.int64(order) << np.int64(3 * width)) | grams[inner])
    keys = np.concatenate(found) if found else np.zeros(0, dtype=np.int64)
    keys.sort()
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    counts = np.diff(np.append(first, len(keys)))
    keys = keys[first]
    own = keys >> np.int64(3 * width + 2)
    by = np.lexsort((keys, -counts, own))
    keys, counts, own = keys[by], counts[by], own[by]
    starts = np.searchsorted(own, np.arange(n))
    rank = np.arange(len(own)) - starts[own]
    top = rank < profile
    keys, counts, own, rank = keys[top], counts[top], own[top], rank[top]
    order = (keys >> np.int64(3 * width)) & np.int64(3)
    code = np.zeros(len(keys), dtype=np.int64)
    for k in range(ORDER):
        shift = (order - 1 - k) * width
        part = np.where(k < order, alphabet[(keys >> np.maximum(shift, 0)) & np.int64((1 << width) - 1)] if len(alphabet) else 0, 0)
        code = np.where(k < order, (code << np.int64(21)) | part, code)
    return own, code * 4 + order, rank, counts


def learn_profiles(docs: DataFrame, profile: int = PROFILE, sample: int = SAMPLE, lang_col: str = "lang", text_col: str = "text") -> dict[str, dict[int, int]]:
    """The profile (n-gram code -> rank) of each language that ``docs`` name; rows without a language or text are left out.

    About ``sample`` documents a language are used whole, those with the smallest hashes of their text: a bounded sample,
    whose share follows from the language's count. The counts of their n-grams are added up by Spark; the driver gets
    ``profile`` rows a language.
    """
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    share = F.coalesce(*(F.when(F.col("lang") == k, F.lit(min(1.0, sample / n))) for k, n in sorted(counts.items())))
    drawn = rows.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < share * 1_000_000)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            own, code, _, n = ranked_grams(batch.column(1), 1 << 40)
            langs = batch.column(0).dictionary_encode()
            number = langs.indices.to_numpy()[own].astype(np.int64)
            order = np.lexsort((code, number))
            number, code, n = number[order], code[order], n[order]
            if not len(code):
                continue
            first = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (number[1:] != number[:-1])]))
            yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(number[first])), pa.array(code[first]), pa.array(np.add.reduceat(n, first))], names=["lang", "gram", "n"])

    total = drawn.mapInArrow(work, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # ranks beyond the profile are left out before the exchange
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    out: dict[str, dict[int, int]] = {}
    for r in total.withColumn("rank", rank).where(F.col("rank") <= profile).collect():
        out.setdefault(r["lang"], {})[r["gram"]] = r["rank"] - 1
    return out


def identify(docs: DataFrame, profiles: dict[str, dict[int, int]], profile: int = PROFILE, text_col: str = "text") -> DataFrame:
    """``docs``' columns other than the text with ``lang_pred`` and ``score``.

    The score is 1 minus the nearest profile's distance as a share of the largest possible. Texts that are null or have
    no letter, and all texts where there are no profiles, get ``und`` with score 0. Ties go to the first language by
    code point; repeated rows each get the result of their text; an empty table gives no rows. Where ``docs`` has columns
    of those names, the new ones' names get an underscore more.
    """
    bounded_batches(docs.sparkSession)
    names = sorted(profiles)
    others = [c for c in docs.columns if c != text_col]
    slim = docs.select(*(F.col(c).alias(f"c{k}") for k, c in enumerate(others)), F.col(text_col).alias("text"))
    codes = np.array(sorted({g for p in profiles.values() for g in p}), dtype=np.int64)
    places = np.full((len(codes) + 1, len(names)), -1, dtype=np.int64)
    for j, name in enumerate(names):
        for g, k in profiles[name].items():
            places[np.searchsorted(codes, g), j] = k
    at = len(others)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            n = batch.num_rows
            own, code, rank, _ = ranked_grams(batch.column(at), profile)
            size = np.bincount(own, minlength=n)
            pred, score = np.full(n, UNKNOWN, dtype=object), np.zeros(n)
            if names and len(own):
                where = np.searchsorted(codes, code)
                where = np.where((where < len(codes)) & (codes[np.minimum(where, len(codes) - 1)] == code), where, len(codes))
                place = places[where]
                off = np.where(place < 0, profile, np.abs(place - rank[:, None]))
                full = np.flatnonzero(size)
                starts = np.cumsum(size)[full] - size[full]
                far = np.add.reduceat(off, starts, axis=0)
                best = far.argmin(axis=1)
                pred[full] = np.array(names, dtype=object)[best]
                score[full] = 1 - far[np.arange(len(full)), best] / (profile * size[full])
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(pred, pa.string()), pa.array(score)], names=[*batch.schema.names[:at], "lang_pred", "score"])

    schema = slim.drop("text").withColumns({"lang_pred": F.lit("").cast("string"), "score": F.lit(0.0)}).schema
    return slim.mapInArrow(work, schema).toDF(*others, free_name("lang_pred", others), free_name("score", others))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = crc_mod(F.col("doc_id"), 4)
    profiles = learn_profiles(docs.where(fold != 2))
    return identify(docs.select("doc_id", (fold == 2).alias("held_out"), "text"), profiles).select("doc_id", "held_out", "lang_pred", "score")
