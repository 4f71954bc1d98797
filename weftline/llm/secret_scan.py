"""Secret scans with multipart credential linking (operator 7).

Strong patterns are reported as they are. Weak parts (client names, endpoints, key-shaped strings, and the values of
passwords, secrets, tokens and keys that no strong pattern reports whole) are reported only where complementary parts lie
in one scope. Such a value may be of any length; in quotes it goes to the closing quote of its line. Key-shaped are 16 or
more of [A-Za-z0-9/+_-] with a digit and letters of both cases; what is part of a client's name or of an endpoint is not,
as it would complete itself, unless it follows a = in it or is 40 of [A-Za-z0-9/+]. Scopes are overlapping intervals of 2 * REACH code points, so
that parts that start within REACH of each other always share one; parts are joined with the scopes they lie in, and
what a scope holds is summed up before the parts read it, so that no pairs are made.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.arrows import slices
from weftline.llm.common import bounded_batches, free_name, staged, table

REACH = 512

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
#: Kind -> a quick test for Arrow (RE2), and the pattern. Kinds are in the order in which equal starts are listed.
STRONG = {
    "assign": (r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", ASSIGN),
    "access": (r"AKIA[A-Z0-9]{14}", re.compile(r"AKIA[A-Z0-9]{14,}")),
    "hex": (r"[0-9a-f]{16}", re.compile(r"[0-9a-f]{16,}")),
}
WEAK = {
    "short": (r"(?i)(password|passwd|pwd|secret|token|api_?key)[\"']?\x20*[:=]", re.compile(r"""(?:password|passwd|pwd|secret|token|api_?key)["']?\x20*[:=]\x20*""", re.A | re.I)),
    "client": (r"(?i)(client_?id|user_?name|user|login|account)[\"']?\x20*[:=]", re.compile(r"""\b(?:client_?id|user_?name|user|login|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}""", re.A | re.I)),
    "endpoint": (r"://|[0-9]\.[0-9]", re.compile(r"\b(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqps?|s3)://[^\s\"'<>]{3,}|(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9.])(?::[0-9]{2,5})?", re.A)),
    "key": (r"[A-Za-z0-9/+_-]{16}", re.compile(r"[A-Za-z0-9/+_-]{16,}={0,2}")),
}
KINDS = [*STRONG, *WEAK]
#: The value after the head of a short: in quotes, or up to a delimiter.
QUOTED = re.compile(r""""(?:[^"\\\n]|\\.)++(?=")|'(?:[^'\\\n]|\\.)++(?=')""")
VALUE = re.compile(r"""[^\s"',;]+""", re.A)
MIXED = re.compile(r"(?=[^0-9]*[0-9])(?=[^A-Z]*[A-Z])[^a-z]*[a-z]")
PLAIN = re.compile(r"[A-Za-z0-9/+]{40}")

PART = "struct<start:int,place:int,kind:string,end:int>"


def _assigned(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of every short part with a value, also of those in the value of another."""
    until = 0
    for m in WEAK["short"][1].finditer(text):
        at = m.end()
        if v := QUOTED.match(text, at):
            yield m.start(), v.end()
            continue
        at += text.startswith(('"', "'"), at)
        if at >= until:  # else it is in the run that was read last
            until = v.end() if (v := VALUE.match(text, at)) else at
        if until > at:
            yield m.start(), until


def _inside(at: int, spans: list[tuple[int, int]]) -> bool:
    """Whether ``at`` lies in one of the (start, end), which are in order and do not overlap."""
    i = bisect_right(spans, (at, math.inf)) - 1
    return i >= 0 and at < spans[i][1]


def _spans(texts: pa.Array) -> list[list[tuple[int, int, str, int]]]:
    """All parts of each text, strong and weak: (start, place of the kind, kind, end), in code points."""
    found: list[list[tuple[int, int, str, int]]] = [[] for _ in range(len(texts))]
    for place, (kind, (quick, pattern)) in enumerate([*STRONG.items(), *WEAK.items()]):
        mask = pc.match_substring_regex(texts, quick)
        for i in pc.indices_nonzero(mask).to_pylist():
            text = texts[i].as_py()
            matches = pattern.finditer(text)
            if kind == "short":
                known = {a: b for a, _, k, b in found[i] if k == "assign"}
                spans = [(a, b) for a, b in _assigned(text) if b > known.get(a, 0)]
            elif kind == "key":
                clients, endpoints = ([(a, b) for a, _, k, b in found[i] if k == name] for name in ("client", "endpoint"))
                spans = [m.span() for m in pattern.finditer(text) if MIXED.match(m[0]) and (PLAIN.fullmatch(m[0]) or not _inside(m.start(), clients) and (text.endswith("=", 0, m.start()) or not _inside(m.start(), endpoints)))]
            else:
                spans = [m.span() for m in pattern.finditer(text) if kind != "assign" or len(m[2]) >= 12]
            found[i] += [(a, place, kind, b) for a, b in spans]
    return [sorted(x) for x in found]


def _marked(docs: DataFrame, id_col: str, text_col: str, keep_text: bool) -> DataFrame:
    """``docs`` as c0, c1, ... with ``doc`` (the id), ``text_key``, ``parts`` (strong and weak) and ``weak`` (has a weak one).

    The text is left out if it is not kept. Neutral names let ``docs`` have columns of any name.
    """
    at = docs.columns.index(text_col)
    slim = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    slim = slim.withColumns({"doc": F.col(f"c{docs.columns.index(id_col)}"), "text_key": F.xxhash64(f"c{at}")})
    columns = [c for c in slim.columns if keep_text or c != f"c{at}"]
    schema = slim.select(*columns).withColumns({"parts": F.lit(None).cast(f"array<{PART}>"), "weak": F.lit(None).cast("boolean")}).schema
    kind = pa.list_(pa.struct([("start", pa.int32()), ("place", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            found = _spans(pc.fill_null(batch.column(at).cast(pa.large_string()), ""))
            rows = [[{"start": a, "place": p, "kind": k, "end": b} for a, p, k, b in x] for x in found]
            weak = pa.array([any(p >= len(STRONG) for _, p, _, _ in x) for x in found], pa.bool_())
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in columns), pa.array(rows, kind), weak], names=[*columns, "parts", "weak"])

    bounded_batches(docs.sparkSession)
    return slim.mapInArrow(work, schema)


def linked(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """For each document (``doc``, ``text_key``) with any: ``links``, its weak parts whose complement is in their scope.

    A short password or a key needs a client, an access identifier or an endpoint; a client needs a password or a key; an
    endpoint needs both an identifier and a secret. Equal rows have one result.
    """
    each = parts.where("weak").select("doc", "text_key", F.explode(F.array_distinct("parts")).alias("p")).distinct()
    cell = F.floor(F.col("p.start") / reach)
    each = each.select("doc", "text_key", "p", F.explode(F.array(cell, cell + 1)).alias("scope"))
    has = lambda *kinds: F.max(F.col("p.kind").isin(*kinds))
    scopes = each.groupBy("doc", "text_key", "scope").agg(has("access", "client").alias("who"), has("assign", "hex", "key", "short").alias("secret"), has("endpoint").alias("where"))
    met = each.where(F.col("p.place") >= len(STRONG)).alias("e").join(scopes.alias("s"), F.col("e.doc").eqNullSafe(F.col("s.doc")) & (F.col("e.text_key") == F.col("s.text_key")) & (F.col("e.scope") == F.col("s.scope")))
    kind = F.col("e.p.kind")
    fits = F.when(kind.isin("short", "key"), F.col("who") | F.col("where")).when(kind == "client", F.col("secret")).otherwise(F.col("who") & F.col("secret"))
    return met.where(fits).groupBy(F.col("e.doc").alias("doc"), F.col("e.text_key").alias("text_key")).agg(F.collect_set("e.p").alias("links"))


def _spanned(docs: DataFrame, id_col: str, text_col: str, keep_text: bool) -> DataFrame:
    """``docs`` as c0, c1, ... with ``spans`` and ``base``.

    Texts are searched once. Only rows with a weak part are joined with their links; the rest needs no exchange.
    """
    marked = staged(_marked(docs, id_col, text_col, keep_text), "parts")
    columns = [c for c in marked.columns if c not in ("doc", "text_key", "parts", "weak")]
    links = linked(marked.select("doc", "text_key", "parts", "weak")).withColumnsRenamed({"doc": "link_doc", "text_key": "link_key"})
    base = F.filter("parts", lambda p: p["place"] < len(STRONG))
    more = F.coalesce("links", F.array().cast(f"array<{PART}>"))
    met = marked.where("weak").join(links, F.col("doc").eqNullSafe(F.col("link_doc")) & (F.col("text_key") == F.col("link_key")), "left")
    met = met.select(*columns, F.array_sort(F.concat(base, more)).alias("spans"), base.alias("base"))
    return marked.where("not weak").select(*columns, F.col("parts").alias("spans"), F.col("parts").alias("base")).union(met)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` (without the text if it is not kept) with ``spans`` (strong parts and linked weak ones) and ``base`` (strong).

    Both are arrays of (start, place, kind, end) in code points, by start, the end exclusive. Null and empty texts have
    empty ones; null ids are scanned like any other; repeated rows each get the result of their text; an empty table
    gives no rows. Where ``docs`` has columns of those names, the new ones' names get an underscore more.
    """
    names = [c for c in docs.columns if keep_text or c != text_col]
    return _spanned(docs, id_col, text_col, keep_text).toDF(*names, free_name("spans", names), free_name("base", names))


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of their texts replaced by ``mark``; spans that overlap or touch become one mark.

    Null and empty texts stay as they are, repeated rows each get their own text, an empty table gives no rows, and
    other columns may have any name.
    """
    spanned = _spanned(docs, id_col, text_col, True).drop("base")
    columns, at, spans = spanned.columns[:-1], docs.columns.index(text_col), len(docs.columns)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            found = pc.indices_nonzero(pc.greater(pc.list_value_length(batch.column(spans)), 0)).to_pylist()
            texts = batch.column(at).to_pylist() if found else []
            for i in found:
                text, out, done = texts[i], [], 0
                for p in batch.column(spans)[i].as_py():
                    if not out or p["start"] > done:
                        out += [text[done : p["start"]], mark]
                    done = max(done, p["end"])
                texts[i] = "".join([*out, text[done:]])
            yield pa.RecordBatch.from_arrays([pa.array(texts, batch.column(at).type) if found and k == at else batch.column(k) for k in range(spans)], names=columns)

    return spanned.mapInArrow(work, spanned.drop("spans").schema).toDF(*docs.columns)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    told = lambda c: F.array_join(F.transform(c, lambda p: F.concat_ws(":", p["kind"], p["start"], p["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda p: p["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(told("base"), 256).alias("base_sha256"), told("spans").alias("spans"))
