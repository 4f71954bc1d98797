"""Every stage of the pipeline against a plain version of it, with nulls, repeated rows, clashing names and empty tables."""

from __future__ import annotations

import itertools
import re

import pytest

import corpus_pipeline
from weftline.llm import quality

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
OWN = ("score", "predicted", "base", "parts", "spans", "text_key", "_doc", "links", "size", "taken", "ranges", "_n", "place", "c0")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"{c} string" for c in OWN)
LONG = " ".join(f"word{i}" for i in range(60))


def fixture() -> list[tuple]:
    texts = {1: LONG, 2: LONG.upper(), 3: LONG + " more", 4: "user=bob password=hunter22 and some more words here", 5: None, 6: "", 7: " \n", 8: "quite another text with words of its own in it", 9: LONG.replace("word1 ", "x ")}
    rows = [(k, t, "en", f"s{k % 2}", len(t or ""), *("mine",) * len(OWN)) for k, t in texts.items()]
    return [*rows, rows[7], (None, LONG, None, None, 1, *("mine",) * len(OWN)), (8, "a version of eight", None, "s0", 1, *("mine",) * len(OWN))]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(fixture(), SCHEMA)


def plain(rows) -> list[tuple]:
    return sorted(map(tuple, rows), key=repr)


def test_stages_are_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_dups", "secrets", "mixing", "packing"]


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_an_empty_table(spark, docs, stage):
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs.limit(0), SF)
    assert out.count() == 0 and (stage == "packing" or out.columns == docs.columns)


def test_quality_keeps_what_the_network_accepts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.good_quality(spark, docs, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0")
    net = quality.learn(docs, labels)
    rows = docs.collect()
    scores = net.predict([(r["text"] or "").encode() for r in rows])
    want = {r["doc_id"] for r, p in zip(rows, scores, strict=True) if p >= 0.3}
    near = {r["doc_id"] for r, p in zip(rows, scores, strict=True) if abs(p - 0.3) < 1e-3}
    assert out.schema == docs.schema and {r["doc_id"] for r in out.collect()} ^ want <= near


def test_quality_leaves_columns_as_they_are(spark, docs):
    out = corpus_pipeline.good_quality(spark, docs, SF)
    assert out.schema == docs.schema and not set(map(repr, plain(out.collect()))) - set(map(repr, plain(fixture())))


def test_near_dups_keep_one_of_each(spark, docs):
    rows = fixture()
    sets = {}
    for r in rows:
        words = WORD.findall((r[1] or "").lower())
        sets.setdefault(r[0], set()).update(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, min(len(words), 1))))
    root = {d: d for d in sets}
    for a, b in itertools.combinations(sorted(d for d in sets if d is not None), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            low, high = sorted((root[a], root[b]))
            root = {d: low if x == high else x for d, x in root.items()}
    want = [min((r for r in rows if r[0] == d), key=lambda r: (r[1] is not None, r[1] or "")) for d in root if d is not None and root[d] == d]
    out = corpus_pipeline.one_of_each(spark, docs, SF)
    assert out.schema == docs.schema and plain(out.collect()) == plain([*want, *(r for r in rows if r[0] is None)])


def test_secrets_are_marked(spark, docs):
    out = corpus_pipeline.without_secrets(spark, docs, SF)
    want = [(r[0], "[SECRET] [SECRET] and some more words here", *r[2:4], 42, *r[5:]) if r[0] == 4 else (*r[:4], len(r[1]) if r[1] is not None else None, *r[5:]) for r in fixture()]
    assert out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType and plain(out.collect()) == plain(want)
    assert corpus_pipeline.without_secrets(spark, docs.drop("n_chars"), SF).columns == docs.drop("n_chars").columns


def test_the_mix_repeats_and_cuts(spark, docs):
    out = corpus_pipeline.mixed(spark, docs, SF)
    assert out.columns == docs.columns
    whole = {}
    for r in fixture():
        whole.setdefault(r[0], []).append(WORD.findall(r[1] or ""))
    for r in out.collect():
        words = WORD.findall(r["text"])
        assert words and r["n_chars"] == len(r["text"]) and any(set(words) <= set(w) for w in whole[r["doc_id"]]) and r["size"] == "mine"


def test_packed_pieces_cover_all_ids(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted(((r[0], len(t.encode(r[1] or "", add_special_tokens=False).ids) + 1) for r in fixture()), key=repr)
    assert sorted(((r["doc_id"], r["length"]) for r in corpus_pipeline.packed(spark, docs, SF).collect()), key=repr) == want


def test_the_whole_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    known = {r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    assert rows and {r["doc_id"] for r in rows} <= known
    packs: dict[int, list] = {}
    for r in rows:
        packs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in packs.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 4096
