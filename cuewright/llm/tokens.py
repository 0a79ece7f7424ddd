"""Token ids of whole texts by the public byte-level BPE file, with a bounded memo of repeated words.

A single space between two characters that are not white space always starts a new pre-token
of a byte-level BPE, and a single line feed there is one itself, so a text can be cut there and its parts
encoded apart.  Letters and the marks behind them are two pre-tokens.  Parts recur, so each worker keeps
the ids of those it met first, and asks for each of the others once a call; all ids come from the tokenizers
library.  Texts are cut, parts told apart and ids put together in whole arrays.
"""

from __future__ import annotations

import os
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_ALONE = re.compile(r"(?<=\S) (?=\S)")
_LETTERS = r"\A\n?[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]+\z"  # letters by every version of Unicode
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # no apostrophe, which may take letters with it
_SPACES = r"\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_NOT_PLAIN = rf"[\x09-\x0d\x1c-\x20{_SPACES}]{{2}}|\A[\x09\x0b-\x0d\x1c-\x1f{_SPACES}]"
_GATHERED = 1 << 16  # parts whose ids are put together at a time


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    Parts of texts, without marks behind letters, have numbers; ``starts`` and ``sizes`` tell where in ``pool`` a number's ids are.
    Numbers below ``used`` are those of ``memo``, further ones hold until ``_ids`` ends.  A part that begins with a line feed stands for itself,
    any other for itself behind a space; in the memo, marks have a space before them, and stand for themselves.
    """

    #: Parts kept at most, about 180 bytes each; further ones are encoded in each call that meets them.
    KEPT = 450_000

    def __init__(self, path: str, kept: int | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        (self.tab,), (self.feed,) = (self.tokenizer.encode(x, add_special_tokens=False).ids for x in "\t\n")
        vocab = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocab.values()) + 1, dtype=bool)  # ids that begin with a space
        self.spaced[[i for x, i in vocab.items() if x.startswith("Ġ")]] = True
        self.memo: dict[str, int] = {}
        self.used, self.kept = 0, kept or self.KEPT
        self.starts, self.sizes, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, dtype="<u4") for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, parts: list[str], before: str, first) -> tuple[np.ndarray, np.ndarray]:
        """Ids of ``parts`` one after another and the number of each one's, a thousand to a text; ``first`` tells the ids that begin a part."""
        found = self._library([before + before.join(parts[i : i + 1000]) for i in range(0, len(parts), 1000)])
        flat = np.concatenate([*found, np.zeros(0, "<u4")])
        return flat, np.diff(np.append(np.flatnonzero(first(flat)), len(flat)))

    def _apart(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self._library(texts)
        return np.concatenate([*found, np.zeros(0, "<u4")]), np.array([len(x) for x in found], dtype=np.int64)

    def _behind_tabs(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of space-led parts without tabs: a tab between them is a token of its own."""
        flat, sizes = self._joined(parts, "\t ", lambda x: x == self.tab)
        return flat[flat != self.tab], sizes - 1

    def _append(self, n: int, flat: np.ndarray, sizes: np.ndarray) -> int:
        """Give the numbers from ``n`` on to parts with these ids; the next number."""
        at = int(self.starts[n - 1] + self.sizes[n - 1]) if n else 0
        end, top = n + len(sizes), at + len(flat)
        if end > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x[:n], np.zeros(max(n // 2, len(sizes)), np.int64)]) for x in (self.starts, self.sizes))
        if top > len(self.pool):
            self.pool = np.concatenate([self.pool[:at], np.zeros(max(at // 2, len(flat)), "<u4")])
        self.sizes[n:end], self.pool[at:top] = sizes, flat
        self.starts[n:end] = at + np.cumsum(sizes) - sizes
        return end

    def _add(self, n: int, parts: list[str], ids) -> int:
        """Give ``parts``, which are not in the memo, the numbers from ``n`` on; as many as it has room for are kept.  The next number."""
        if not parts:
            return n
        end = self._append(n, *ids(parts))
        keep = min(len(parts), self.kept - len(self.memo)) if n == self.used else 0
        if keep > 0:
            self.memo.update(zip(parts[:keep], range(n, n + keep)))
            self.used += keep
        return end

    def _numbers(self, n: int, parts: list[str], kinds) -> tuple[np.ndarray, int]:
        """Numbers of distinct ``parts``, and the next one; ``kinds(holes)`` deals those that are not in the memo to ways of encoding."""
        number = np.fromiter(map(self.memo.get, parts, repeat(-1)), np.int64, len(parts))
        for at, ids in kinds(np.flatnonzero(number < 0)):
            number[at] = np.arange(n, n + len(at))
            n = self._add(n, [parts[i] for i in at.tolist()], ids)
        return number, n

    def _ids(self, parts: pa.Array) -> tuple[bytes, np.ndarray]:
        """The ids of all parts, and where each one's end, with 0 before."""
        told = parts.dictionary_encode()
        names = told.dictionary
        bare = pc.utf8_rtrim(names, _MARKS)
        marked = pc.and_(pc.not_equal(pc.binary_length(bare), pc.binary_length(names)), pc.match_substring_regex(bare, _LETTERS))
        stems = pc.if_else(marked, bare, names).dictionary_encode()
        stem, some = _listed(stems.dictionary), np.flatnonzero(marked.to_numpy(zero_copy_only=False))
        letters = pc.match_substring_regex(stems.dictionary, _LETTERS).to_numpy(zero_copy_only=False)

        def kinds(holes):
            words, odd = holes[letters[holes]], holes[~letters[holes]].tolist()
            lines = np.fromiter((stem[i][0] == "\n" for i in words.tolist()), bool, len(words))
            tabs = [i for i in odd if (x := stem[i]) and x[0] != "\n" and "\t" not in x and not x[-1].isspace()]
            yield words[~lines], lambda x: self._joined(x, " ", self.spaced.__getitem__)
            yield words[lines], lambda x: self._joined(x, "", lambda ids: ids == self.feed)
            yield np.array(tabs, dtype=np.int64), self._behind_tabs
            yield np.array(sorted({*odd} - {*tabs}), dtype=np.int64), lambda x: self._apart([y if y[:1] == "\n" else " " + y for y in x])

        number, n = self._numbers(self.used, stem, kinds)
        marks = [" " + x[len(y) :] for x, y in zip(_listed(names.take(pa.array(some))), _listed(bare.take(pa.array(some))))]
        known = {x: i for i, x in enumerate(dict.fromkeys(marks))}
        mark, _ = self._numbers(n, list(known), lambda holes: [(holes, lambda x: self._apart([y[1:] for y in x]))])
        # the ids of each distinct part: those of its stem and of its marks
        two = np.full((len(names), 2), -1, dtype=np.int64)
        two[:, 0] = number[stems.indices.to_numpy()]
        two[some, 1] = mark[[known[x] for x in marks]] if marks else 0
        sizes = np.where(two < 0, 0, self.sizes[two]) if len(self.sizes) else np.zeros(two.shape, np.int64)
        pool = _gathered(self.pool, self.starts[two].ravel() if len(self.starts) else two.ravel(), sizes.ravel())
        sizes = sizes.sum(axis=1)
        starts, at = np.cumsum(sizes) - sizes, told.indices.to_numpy()
        out = [_gathered(pool, starts[x], sizes[x]).tobytes() for a in range(0, len(at), _GATHERED) for x in (at[a : a + _GATHERED],)]
        return b"".join(out), 4 * np.concatenate([[0], np.cumsum(sizes[at])])

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        rows = texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        rows = pc.fill_null(rows, "")
        odd = pc.match_substring_regex(rows, _NOT_PLAIN).to_numpy(zero_copy_only=False)
        out: list[bytes] = [b""] * len(rows)
        if not odd.all():
            # behind a line feed, whose id is left out again, a first part is as any other
            feed = pa.scalar("\n", pa.large_string())
            lines = pc.replace_substring(rows.filter(pa.array(~odd)), "\n", " \n")
            parts = pc.split_pattern(pc.binary_join_element_wise(feed, lines, pa.scalar("", pa.large_string())), " ")
            raw, ends = self._ids(parts.flatten())
            at = ends[parts.offsets.to_numpy() - parts.offsets[0].as_py()].tolist()
            for i, a, b in zip(np.flatnonzero(~odd).tolist(), at, at[1:]):
                out[i] = raw[a + 4 : b]
        if odd.any():
            some = np.flatnonzero(odd).tolist()
            cut = [_ALONE.split(rows[i].as_py()) for i in some]
            raw, ends = self._ids(pa.array([x for parts in cut for x in parts[1:]], pa.large_string()))
            at = ends[np.cumsum([0] + [len(parts) - 1 for parts in cut])].tolist()
            for i, first, a, b in zip(some, self._library([parts[0] for parts in cut]), at, at[1:]):
                out[i] = first.tobytes() + raw[a:b]
        return out


def _listed(texts: pa.Array) -> list[str]:
    return texts.to_numpy(zero_copy_only=False).tolist()


def _gathered(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``pool`` that begin at ``starts``, one after another."""
    at = np.repeat(starts - np.cumsum(sizes) + sizes, sizes)
    at += np.arange(len(at))
    return pool[at]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str, kept: int | None = None) -> Encoder:
    """This worker's encoder for ``path``, with its memo; the last bound asked for holds."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    _ENCODERS[path].kept = kept or Encoder.KEPT
    return _ENCODERS[path]


def slices(batch, size: int = 1 << 21):
    """(doc_ids, text column) of runs of rows of an Arrow batch with texts of about ``size`` bytes, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    a, done = 0, 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, done + size, side="right")))
        part = batch.slice(a, b - a)
        yield part.column("doc_id").to_pylist(), part.column("text")
        a, done = b, int(ends[b - 1])
