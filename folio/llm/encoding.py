"""Whole-text encoding with the tokenizers library; texts are cut where no token can cross, and each distinct piece is encoded once.

A byte-level pattern never joins what stands before a space with that space and the next character, a letter with a mark
after it, or a lone line break with its neighbours; a pattern that drops white space never crosses it. So the pieces' ids,
joined, are the text's ids. Texts that hold a special string, and other tokenizers' texts, are given to the library whole.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import HELD

LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
#: ASCII marks that make up one run in the patterns; the apostrophe is left out, contractions begin with it.
MARKS = r"!-&(-/:-@\[-`{-~"
_PLAIN = rf"\A ?[{LATIN}]+\z"
_BEFORE_WORD = re.compile(r"(?= \S)")
#: What is put where a text is cut; texts that hold it are uneven.
_CUT = "\x01"
#: Texts that can't be cut at every space: a space before white space or at the end, characters beyond Latin-1.
_UNEVEN = _CUT + r"| [ \t-\r\x1c-\x1f\x{85}\x{a0}]| \z|[^\x{00}-\x{ff}]"
_MARKED, _BETWEEN = f"([{LATIN}])([{MARKS}])", f"\\1{_CUT}\\2"
_LINE, _LINES = r"([^\t-\r \x1c-\x1f\x{85}\x{a0}])\n([^\t-\r \x1c-\x1f\x{85}\x{a0}])", f"\\1{_CUT}\n{_CUT}\\2"
#: Bytes of texts that are encoded at once (one text at least); pieces and characters of pieces held from then on.
PART_BYTES, HELD_PIECES, HELD_CHARS = 4_000_000, 600_000, 12_000_000


def _byte_chars() -> dict[int, str]:
    """Byte to printable character of byte-level vocabularies: printable bytes stay, the others follow from 256."""
    stay = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in stay]
    return {b: chr(b) for b in stay} | {b: chr(256 + i) for i, b in enumerate(rest)}


BYTE_CHARS = _byte_chars()


class Encoder:
    """encode(text) gives the ids of tokenizer.encode(text, add_special_tokens=False).

    Memory is bounded by the pieces of PART_BYTES of texts, or of one longer text, besides HELD_PIECES.
    """

    def __init__(self, path: str, held: int = HELD_PIECES):
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), held
        self.model = self.tokenizer.model
        with open(path) as f:
            spec = json.load(f)
        added = spec.get("added_tokens") or []
        self.specials = [x["content"] for x in added]
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        parts = [x.get("type") for x in pre.get("pretokenizers", [])]
        plain = spec["model"].get("type") == "BPE" and not spec["model"].get("dropout") and not spec.get("truncation")
        plain = plain and not any(x.get(k) for x in added for k in ("normalized", "lstrip", "rstrip", "single_word"))
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 65536 else np.dtype("<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        marked = "".join(f"|{re.escape(x)}" for x in self.specials if x)
        #: What texts are not cut at every space, and whether a space belongs to the piece after it.
        self.uneven, self.spaced = None, False
        if plain and norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            self.uneven, self.spaced = _UNEVEN + marked, True
        elif plain and parts == ["Split", "ByteLevel"] and pre["pretokenizers"][0].get("behavior") == "Removed" and "\\s" in json.dumps(norm):
            self.uneven = _CUT + marked
        self._forget()

    def _forget(self) -> None:
        """Pieces by number: their ids end to end, and where each one's end."""
        self.known: dict[str, int] = {}
        self.held, self.ends, self.chars = array(self.code), array("q", [0]), 0

    def _add(self, ids: list[int]) -> int:
        self.held.extend(ids)
        self.ends.append(len(self.held))
        return len(self.ends) - 2

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, pieces: pa.Array, names: list[str]) -> None:
        """Number the pieces, each once: words by the model, others by the whole tokenizer."""
        tokenize, first, found = self.model.tokenize, len(self.ends) - 1, []
        chars = pc.replace_substring(pieces, " ", BYTE_CHARS[32]) if self.spaced else pc.ascii_lower(pieces)
        columns = (chars.to_numpy(zero_copy_only=False).tolist(), pc.match_substring_regex(pieces, _PLAIN).to_pylist(), pc.string_is_ascii(pieces).to_pylist())
        for name, own, word, ascii_ in zip(names, *columns, strict=True):
            if not word:
                found.append(self._whole(name))
                continue
            if not ascii_:
                own = (name if self.spaced else name.lower()).encode().decode("latin1").translate(BYTE_CHARS)
            found.append([t.id for t in tokenize(own)])
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        self.ends.frombytes((np.cumsum(sizes) + len(self.held)).tobytes())
        self.held.frombytes(np.fromiter(chain.from_iterable(found), self.dtype, int(sizes.sum())).tobytes())
        self.known.update(zip(names, range(first, len(self.ends) - 1), strict=True))
        self.chars += sum(map(len, names))

    def _numbers(self, pieces: pa.Array) -> np.ndarray:
        """The pieces' numbers; the pieces differ."""
        names = pieces.to_numpy(zero_copy_only=False).tolist()
        found = np.fromiter(map(self.known.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(found < 0)
        if len(new):
            found[new] = np.arange(len(new)) + len(self.ends) - 1
            self._learn(pieces.take(pa.array(new)), [names[i] for i in new.tolist()])
        return found

    def _uneven(self, text: str) -> np.ndarray:
        """The numbers of the pieces of a text that can't be cut at every space."""
        if not self.spaced or any(x in text for x in self.specials):
            return np.array([self._add(self._whole(text))])
        words = pa.array(_BEFORE_WORD.split(text)).dictionary_encode()
        return self._numbers(words.dictionary)[words.indices.to_numpy()]

    def _part(self, texts: pa.Array, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        if len(self.ends) > self.limit or self.chars > HELD_CHARS:
            self._forget()
        odd = np.ones(len(texts), bool) if self.uneven is None else pc.match_substring_regex(texts, self.uneven).to_numpy(zero_copy_only=False)
        cut = pc.replace_substring_regex(texts.filter(pa.array(~odd)), _MARKED, _BETWEEN)
        if self.spaced:
            cut = pc.replace_substring(pc.replace_substring_regex(cut, _LINE, _LINES), " ", f"{_CUT} ")
        else:
            cut = pc.replace_substring(pc.replace_substring(cut, "\n", _CUT), " ", _CUT)
        lists = pc.split_pattern(cut, _CUT)
        words = lists.values.dictionary_encode()
        own = self._numbers(words.dictionary)[words.indices.to_numpy()] if len(cut) else np.zeros(0, np.int64)
        lone = [self._uneven(x) for x in texts.filter(pa.array(odd)).to_pylist()]
        counts, closing = np.zeros(len(texts), np.int64), int(end is not None)
        counts[~odd] = np.diff(lists.offsets.to_numpy()) if len(cut) else 0
        counts[odd] = [len(x) for x in lone]
        after = np.cumsum(counts + closing)
        kind = np.repeat(odd.astype(np.int8), counts + closing)
        if closing:
            kind[after - 1] = 2
        pieces = np.empty(len(kind), np.int64)
        pieces[kind == 0], pieces[kind == 1] = own, np.concatenate([*lone, np.zeros(0, np.int64)])
        pieces[kind == 2] = self._add([end]) if closing else 0
        # the ids of all pieces, and of each text
        width = self.dtype.itemsize
        known = pa.Array.from_buffers(pa.large_binary(), len(self.ends) - 1, [None, pa.py_buffer(np.array(self.ends) * width), pa.py_buffer(self.held)])
        _, ends, ids = known.take(pa.array(pieces)).buffers()
        upto = np.frombuffer(ends, np.int64, len(pieces) + 1) // width
        return np.frombuffer(ids or b"", self.dtype, int(upto[-1])), upto[after] - upto[after - counts - closing]

    def parts(self, column: pa.Array, end: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of successive texts (null: empty), each followed by `end`, and how many ids each text has; about PART_BYTES of texts at once."""
        texts = pc.fill_null(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, "")
        total = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PART_BYTES, "right")))
            yield self._part(texts.slice(at, to - at), end)
            at = to

    def encode(self, text: str) -> np.ndarray:
        return next(self.parts(pa.array([text])))[0]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder a worker process and vocabulary file."""
    return Encoder(path)


HELD["encoder"] = encoder.cache_clear
