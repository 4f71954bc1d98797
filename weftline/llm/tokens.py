"""Batch encoding with a public vocabulary: Arrow splits and codes the text, each distinct piece is encoded once."""

from __future__ import annotations

import functools
import itertools
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The code points that the vocabularies' patterns take as white space.
WHITE = "\t-\r \x85\xa0  -     　"

#: White space with the text after it. No pre-token crosses the border from text to the white space that follows.
RUNS = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")

#: Texts in which a space follows white space; there a single space need not be a border.
WIDE = f"[{WHITE}] "

#: A character that cuts are written as; texts that hold it are cut as those with WIDE are.
CUT = "\x00"

#: Where pieces end besides spaces: around a line feed that stands alone, and where a letter or digit meets ASCII
#: punctuation. Pre-tokens of letters or digits end there in every Unicode version; the cuts that overlap leave out only
#: make a piece longer.
CUTS = (
    (f"([^{WHITE}])\n([^{WHITE}])", f"\\1{CUT}\n{CUT}\\2"),
    (r"([0-9A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}])([!-/:-@\[-`{-~])", f"\\1{CUT}\\2"),
)

#: The pieces of a call; longer strings cost the library more a piece.
CALL = 50

#: About the bytes that a kept piece takes besides its characters and ids.
ENTRY = 200


class Encoder:
    """Encodes whole columns of texts, as the library's own call does with add_special_tokens=False.

    What it has encoded is kept in two generations of about ``limit`` bytes; what is still in use moves to the younger
    one. That bounds a task's memory at any size of the corpus. Vocabularies that keep spaces have one pool of ids, of about
    twice as much; when it is full, what the last call used stays.
    """

    def __init__(self, path: str, limit: int = 72_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        t.model._resize_cache(0)  # pieces are kept here instead
        #: Finds texts that hold a special string, which may be cut at it; they are encoded alone.
        self.special = "|".join(sorted(re.escape(x.content) for x in t.get_added_tokens_decoder().values()))
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.limit, self.held = limit, 0
        self.place: dict[str, int] = {}
        self.ids, self.sizes = np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64)
        self.drops_spaces = not t.encode(" \n ", add_special_tokens=False).ids
        #: Stands between pieces that are encoded in one call; its id shows where a piece ends.
        self.between = " \x01 " if self.drops_spaces else "\n"
        (self.border,) = t.encode(self.between, add_special_tokens=False).ids

    def _encode(self, pieces: list[str]) -> list[bytes]:
        """Many pieces in few calls; those that would run into the border are encoded alone."""
        apart = [not p.isprintable() or " " in p[1:] or p in ("", " ") for p in pieces]
        many = [p for p, x in zip(pieces, apart, strict=True) if not x]
        joined = [self.between.join([*many[i : i + 500], ""]) for i in range(0, len(many), 500)]
        found: list[bytes] = []
        for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False):
            ids = np.asarray(e.ids, dtype="<u4")
            data, ends = ids.tobytes(), (np.flatnonzero(ids == self.border) * 4).tolist()
            start = 0
            for end in ends:
                found.append(data[start:end])
                start = end + 4
        if len(found) != len(many):
            raise ValueError("the vocabulary's border token is not unique")
        rest = iter(self.tokenizer.encode_batch_fast([p for p, x in zip(pieces, apart, strict=True) if x], add_special_tokens=False))
        dealt = iter(found)
        return [np.asarray(next(rest).ids, dtype="<u4").tobytes() if x else next(dealt) for x in apart]

    def ids_of(self, pieces: list[str]) -> list[bytes]:
        """The ids of distinct pieces, as little-endian uint32 bytes."""
        if self.held > self.limit:
            self.old, self.young, self.held = self.young, {}, 0
        young, old = self.young, self.old
        out = list(map(young.get, pieces))
        lacking = [i for i, ids in enumerate(out) if ids is None]
        new = []
        for i in lacking:
            p = pieces[i]
            if (ids := old.get(p)) is None:
                new.append(i)
            else:
                out[i] = young[p] = ids
                self.held += ENTRY + len(p) + len(ids)
        for i, ids in zip(new, self._encode([pieces[i] for i in new]), strict=True):
            out[i] = ids
            if len(pieces[i]) <= 64:
                young[pieces[i]] = ids
                self.held += ENTRY + len(pieces[i]) + len(ids)
        return out

    def _joined(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many pieces, none of which would run into the border, in few calls: flat, and how many each has."""
        joined = [self.between.join([*pieces[i : i + CALL], ""]) for i in range(0, len(pieces), CALL)]
        # some thousand pieces at a time, whose encodings go at once
        found = [np.asarray(e.ids, dtype="<u4") for i in range(0, len(joined), 200) for e in self.tokenizer.encode_batch_fast(joined[i : i + 200], add_special_tokens=False)]
        ids = np.concatenate(found) if found else np.zeros(0, dtype="<u4")
        ends = np.flatnonzero(ids == self.border)
        if len(ends) != len(pieces):
            raise ValueError("the vocabulary's border token is not unique")
        return ids[ids != self.border], np.diff(ends, prepend=-1) - 1

    def _pooled(self, pieces: list[str]) -> np.ndarray:
        """Where each of some distinct pieces stands in the pool; those that it lacks are encoded."""
        found = np.fromiter(map(self.place.get, pieces, itertools.repeat(-1)), dtype=np.int64, count=len(pieces))
        if self.held > 2 * self.limit:
            old = np.flatnonzero(found >= 0)
            self.ids, self.sizes = gathered(self.ids, self.sizes, found[old]), self.sizes[found[old]]
            kept = [pieces[i] for i in old.tolist()]
            self.place = dict(zip(kept, range(len(kept)), strict=True))
            self.held = ENTRY * len(kept) + sum(map(len, kept)) + 4 * len(self.ids)
            found[old] = np.arange(len(kept))
        if len(lacking := np.flatnonzero(found < 0)):
            new = [pieces[i] for i in lacking.tolist()]
            apart = [not p.isprintable() or " " in p[1:] or p in ("", " ") for p in new]
            many = [p for p, x in zip(new, apart, strict=True) if not x]
            alone = [p for p, x in zip(new, apart, strict=True) if x]
            ids, sizes = self._joined(many)
            rest = [np.asarray(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(alone, add_special_tokens=False)]
            n = len(self.sizes)
            self.ids = np.concatenate([self.ids, ids, *rest])
            self.sizes = np.concatenate([self.sizes, sizes, np.array(list(map(len, rest)), dtype=np.int64)])
            self.place.update(zip(itertools.chain(many, alone), range(n, n + len(new)), strict=True))
            self.held += ENTRY * len(new) + sum(map(len, new)) + 4 * (len(ids) + sum(map(len, rest)))
            apart = np.array(apart)
            found[lacking[~apart]] = np.arange(n, n + len(many))
            found[lacking[apart]] = np.arange(n + len(many), n + len(new))
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts (none for null), and the n + 1 offsets at which each text's ids start."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if self.special and pc.any(odd := pc.match_substring_regex(texts, self.special)).as_py():
            alone = {i: np.asarray(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, dtype="<u4") for i in pc.indices_nonzero(odd).to_pylist()}
            ids, at = self._plain(pc.if_else(odd, "", texts))
            rows = [alone.get(i, ids[a:b]) for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))]
            return np.concatenate(rows), np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int64)
        return self._plain(texts)

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``encode`` for texts without nulls and special strings."""
        n = len(texts)
        if self.drops_spaces:
            parts = pc.ascii_split_whitespace(texts)
            starts = parts.offsets.to_numpy().astype(np.int64)
            coded = parts.values.dictionary_encode()
            codes = coded.indices.to_numpy().astype(np.int64)
            known = self.ids_of(coded.dictionary.to_pylist())
            pool = np.frombuffer(b"".join(known), dtype="<u4")
            sizes = np.fromiter(map(len, known), dtype=np.int64, count=len(known)) // 4
        else:
            odd = pc.or_(pc.match_substring_regex(texts, WIDE), pc.match_substring(texts, CUT))
            slow = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
            quick = pc.replace_substring(pc.if_else(odd, "", texts) if len(slow) else texts, " ", f"{CUT} ")
            for pattern, to in CUTS:
                quick = pc.replace_substring_regex(quick, pattern, to)
            parts = pc.split_pattern(quick, CUT)
            starts = parts.offsets.to_numpy().astype(np.int64)
            coded = parts.values.dictionary_encode()
            names, codes = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy().astype(np.int64)
            del quick, parts, coded
            if len(slow):
                wide = {i: RUNS.findall(texts[int(i)].as_py()) for i in slow}
                place = {p: k for k, p in enumerate(names)}
                pieces = np.split(codes, starts[1:-1])
                for i, runs in wide.items():
                    pieces[i] = np.array([place.setdefault(r, len(place)) for r in runs], dtype=np.int64)
                names = list(place)
                starts = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
                codes = np.concatenate(pieces)
            codes = self._pooled(names)[codes]
            pool, sizes = self.ids, self.sizes
        ends = np.cumsum(sizes[codes])
        return gathered(pool, sizes, codes), np.concatenate([[0], ends])[starts] if n else np.zeros(1, dtype=np.int64)


def gathered(pool: np.ndarray, sizes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The values of some rows of a pool, flat; ``sizes`` tells how many values each row of the pool has."""
    begins, lengths = np.cumsum(sizes) - sizes, sizes[rows]
    ends = np.cumsum(lengths)
    return pool[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins[rows] - (ends - lengths), lengths)]


@functools.lru_cache(maxsize=2)
def encoder(path: str, limit: int = 72_000_000) -> Encoder:
    return Encoder(path, limit)
