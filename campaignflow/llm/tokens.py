"""Ids of a byte-level BPE vocabulary, as the tokenizers library gives them, with each piece encoded once per worker.

Byte-level BPE never joins across a space that has a visible character on each side, so the ids of a text whose spaces are
all like that are those of its units, one after another: its first part, and each other part with the space before it.
Units recur, whole texts hardly do, so Arrow finds the distinct ones of many texts and only these are encoded. Runs of white
space are one unit to the tokenizer; a text that has spaces in such runs is cut at its other spaces only.

Most of a call of the library is spent on cutting a text into words. Units of common characters are cut here, by the same
pattern, and each different word goes to the library's BPE model in its own spelling, many at a time with a symbol between
them that no merge has; all other units take the whole call.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import compress, repeat
from unicodedata import category

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: When so many units are known, they are forgotten and learnt anew. This bounds memory, not input.
REMEMBERED = 1_000_000
#: Units and words encoded in one call.
LINES, WORDS_AT_ONCE = 4096, 1024

#: Space, line end and the Latin letters and signs up to U+024F, whose categories no version of Unicode changes.
_COMMON = " \n" + "".join(map(chr, [*range(0x21, 0x7F), *range(0xA1, 0x250)]))
_KINDS = {x: "space" if x.isspace() else category(x)[0] for x in _COMMON}
_LETTERS, _NUMBERS = ("".join(re.escape(x) for x in _COMMON if _KINDS[x] == kind) for kind in "LN")
_SIGNS = "".join(re.escape(x) for x in _COMMON if _KINDS[x] not in ("L", "N", "space"))
#: Words of units of common characters by the pattern of byte-level BPE; a NUL stands after each unit.
WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[{_SIGNS}]+|\s+(?![^\s\0])|\s+|\0")
LETTER, OTHER_COMMON, OTHER = 0, 1, 2
KIND = np.full(0x251, OTHER, np.uint8)
for _x in _COMMON:
    KIND[ord(_x)] = LETTER if _KINDS[_x] == "L" else OTHER_COMMON


def _symbols() -> np.ndarray:
    """The character that stands for each byte in a byte-level vocabulary."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = np.zeros(256, "<u2")
    out[own] = own
    out[np.setdiff1d(np.arange(256), own)] = 256 + np.arange(256 - len(own))
    return out


SYMBOLS = _symbols()
#: Of byte 0, which no common character holds.
BETWEEN = chr(SYMBOLS[0])
#: All white space, and nothing.
WHITE = pa.array(["", *(chr(i) for i in range(0x3001) if chr(i).isspace())])


def stretches(text: str) -> list[str]:
    """``text`` cut before every space that has no white space beside it."""
    parts = text.split(" ")
    out = [parts[0]]
    for part in parts[1:]:
        last = out[-1]
        if part and not part[0].isspace() and last and not last[-1].isspace():
            out.append(" " + part)
        else:
            out[-1] = last + " " + part
    return out


class Units:
    """Numbers of units of text, and the ids of each number; units not seen before are encoded many at a time."""

    def __init__(self, tokenizer):
        from tokenizers import Tokenizer
        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer, cut = tokenizer, tokenizer.pre_tokenizer
        (self.line_end,) = tokenizer.encode("\n", add_special_tokens=False).ids
        plain = (tokenizer.normalizer is None and isinstance(cut, ByteLevel) and cut.use_regex and not cut.add_prefix_space
                 and isinstance(tokenizer.model, BPE) and tokenizer.model.dropout is None)
        self.between = [i for token, i in tokenizer.get_vocab(with_added_tokens=False).items() if BETWEEN in token] if plain else []
        self.model = Tokenizer(tokenizer.model) if len(self.between) == 1 and tokenizer.token_to_id(BETWEEN) in self.between else None
        self._forget()

    def _forget(self) -> None:
        self.known = {"": 0}
        self.ids, self.begin, self.size = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def _add(self, units: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        n = len(self.size)
        self.known.update(zip(units, range(n, n + len(units)), strict=True))
        self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, ids])

    def of(self, units: list[str]) -> np.ndarray:
        """The number of each unit. Numbers hold until the next call."""
        if len(self.known) > REMEMBERED:
            self._forget()
        out = self._numbers(units)
        at = np.flatnonzero(out < 0)
        if len(at):
            missing = [units[i] for i in at.tolist()]
            self._learn(list(dict.fromkeys(missing)))
            out[at] = self._numbers(missing)
        return out

    def _numbers(self, units: list[str]) -> np.ndarray:
        return np.fromiter(map(self.known.get, units, repeat(-1)), np.int64, len(units))

    def read(self, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The ids from each ``begin`` on, one after another."""
        before = np.cumsum(size) - size
        return self.ids[np.repeat(begin - before, size) + np.arange(size.sum())]

    def _learn(self, missing: list[str]) -> None:
        if self.model is None:
            return self._rest(missing)
        size = np.fromiter(map(len, missing), np.int64, len(missing))
        points = np.frombuffer("".join(missing).encode("utf-32-le"), "<u4")
        begin = np.cumsum(size) - size
        kind = KIND[np.minimum(points, len(KIND) - 1)]
        kind[begin[points[begin] == 0x20]] = LETTER  # the space before a word is part of it
        kind = np.maximum.reduceat(kind, begin)
        words, several, rest = (list(compress(missing, (kind == k).tolist())) for k in (LETTER, OTHER_COMMON, OTHER))
        cut = WORDS.findall("\0".join([*several, ""]))
        self._words([*words, *(w for w in {*cut}.difference(words, ["\0"]) if w not in self.known)])
        at = self._numbers(cut)
        end = np.fromiter(map("\0".__eq__, cut), bool, len(cut))
        at[end] = 0
        # A unit that is one word by itself gets a second number with the same ids.
        self._add(several, self.read(self.begin[at], self.size[at]), np.diff(np.cumsum(self.size[at])[end], prepend=0))
        if rest:
            self._rest(rest)

    def _words(self, words: list[str]) -> None:
        """Words of common characters, in the vocabulary's symbols, by the model alone."""
        found = []
        for at in range(0, len(words), WORDS_AT_ONCE):
            joined = "\0".join([*words[at:at + WORDS_AT_ONCE], ""])
            spelt = SYMBOLS[np.frombuffer(joined.encode(), np.uint8)].tobytes().decode("utf-16-le")
            found.append(self._encoded(self.model, spelt))
        self._cut(words, found, self.between[0])

    def _encoded(self, tokenizer, text: str) -> np.ndarray:
        return np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _cut(self, units: list[str], found: list[np.ndarray], end: int) -> None:
        """Adds units whose ids ``found`` holds, each followed by ``end``."""
        ids = np.concatenate([np.zeros(0, np.uint32), *found])
        inner = ids != end
        self._add(units, ids[inner], np.diff(np.flatnonzero(~inner), prepend=-1) - 1)

    def _rest(self, units: list[str]) -> None:
        """Units without white space inside go as lines of few texts, which is faster; the line ends tell them apart again."""
        lines, others = [], []
        for unit in units:
            body = unit.removeprefix(" ")
            (lines if body.split() == [body] else others).append(unit)
        self._cut(lines, [self._encoded(self.tokenizer, "\n".join([*lines[at:at + LINES], ""])) for at in range(0, len(lines), LINES)], self.line_end)
        found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(others, add_special_tokens=False)]
        self._add(others, np.concatenate([np.zeros(0, np.uint32), *found]), np.array([len(x) for x in found], np.int64))


class Encoder:
    """Texts to ids with a vocabulary file of the tokenizers library; strings of added tokens are ordinary text.

    With ``added``, they are the ids that the file gives them, as by the library's default: texts that hold one are encoded
    whole.
    """

    def __init__(self, path: str, added: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.size = self.tokenizer.get_vocab_size()
        self.whole = Tokenizer.from_file(path)
        self.held = [t.content for t in self.whole.get_added_tokens_decoder().values() if t.content] if added else []
        self.units = Units(self.tokenizer)

    def some(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text, none of them null."""
        lists = pc.split_pattern(texts, " ")
        ends = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
        ends -= ends[0]
        part, distinct = coded.indices.to_numpy(), coded.dictionary
        first = np.zeros(len(part), bool)
        first[ends[:-1]] = True
        last = np.zeros(len(part), bool)
        last[ends[1:] - 1] = True

        apart: dict[int, bytes] = {}
        for string in self.held:
            for i in np.flatnonzero(pc.match_substring(texts, string).to_numpy(zero_copy_only=False)).tolist():
                apart[i] = np.array(self.whole.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32).tobytes()
        # A space stands in a run of white space if such a character, or nothing, is on one side of it.
        begins, stops = (
            pc.is_in(pc.utf8_slice_codeunits(distinct, at, to), WHITE).to_numpy(zero_copy_only=False) for at, to in ((0, 1), (-1, None)))
        text = np.repeat(np.arange(len(texts)), np.diff(ends))
        in_run = np.unique(text[(begins[part] & ~first) | (stops[part] & ~last)])
        in_run = [i for i in in_run.tolist() if i not in apart]
        cuts = [stretches(texts[i].as_py()) for i in in_run]
        number = self.units.of([u for units in cuts for u in units])
        for i, at in zip(in_run, np.split(number, np.cumsum([len(x) for x in cuts])[:-1].astype(np.int64)), strict=False):
            apart[i] = self.units.read(self.units.begin[at], self.units.size[at]).tobytes()

        here = np.ones(len(texts), bool)
        here[list(apart)] = False
        here = here[text]
        # First parts are units as they are, others with the space before them.
        code = part.astype(np.int64) + np.where(first, len(distinct), 0)
        used = np.zeros(2 * len(distinct), bool)
        used[code[here]] = True
        n = len(distinct)
        other, own = distinct.filter(pa.array(used[:n])), distinct.filter(pa.array(used[n:]))
        used = np.flatnonzero(used)
        spaced = pc.binary_join_element_wise("", other, " ")
        number = self.units.of(np.concatenate([x.to_numpy(zero_copy_only=False) for x in (spaced, own)]).tolist())
        size, begin = np.zeros(2 * n, np.int64), np.zeros(2 * n, np.int64)
        size[used], begin[used] = self.units.size[number], self.units.begin[number]

        size = size[code] * here
        to = np.concatenate([[0], np.cumsum(size)])
        out = memoryview(self.units.read(begin[code], size).tobytes())
        at = (4 * to[ends]).tolist()
        for i in range(len(texts)):
            yield apart[i] if i in apart else bytes(out[at[i]:at[i + 1]])

    def encode(self, texts: pa.Array | list[str | None], about: int = 1 << 23) -> Iterator[bytes]:
        """The ids of each text in order, null being empty, as native unsigned 32-bit integers; about ``about`` bytes are worked on at a time."""
        texts = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).fill_null("")
        total = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))])
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(total, total[at] + about, "right")) - 1)
            yield from self.some(texts.slice(at, to - at))
            at = to


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file, with the ids of its added tokens."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path, added=True)
    return _ENCODERS[path]
