"""Token ids of whole texts by a vocabulary of the tokenizers library, with pieces that recur encoded once.

A text is cut only where no rule of the vocabulary can reach across, and the ids of a text are those of its pieces in
order, which is exactly what the library gives for the whole text:

* the byte-level vocabulary splits at a single blank (which begins the next piece) or line feed between two visible
  Latin characters in any case; texts with anything else between their words are cut at fewer places;
* the word-end vocabulary drops white space, so it is cut at every blank and line feed;
* in both, a mark of `MARKS` after a Latin letter begins a piece. The word-end vocabulary lower-cases, so that pieces are
  looked up in lower case.

The pieces of a batch are cut in its bytes and made distinct by Arrow; the library encodes each distinct one that isn't
held, words in lines of 64, which it always parts at their ends. Each worker holds the first `held` pieces that it meets. A
text that spells a special token is encoded whole.
"""

from __future__ import annotations

import os
import re
from array import array
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Pieces that a worker holds by default (about 20 MB); later ones are encoded again in each batch that has them.
HELD = 400_000
#: Characters that are neither letters, numbers nor white space, and no apostrophe.
MARKS = ".,;:!?|*%#&$"
_IS_MARK = np.isin(np.arange(256), list(MARKS.encode()))
_PLAIN = re.compile(r"[ \n!-~À-ɏ]*")
_WORD = re.compile(r" ?[!-~À-ɏ]+")
_NO_BAR = re.compile(r"[!-{}~À-ɏ]+")
_SAFE = re.compile(r"(?<=[!-~À-ɏ])(?= [!-~À-ɏ])")


def _after_letter(data: np.ndarray) -> np.ndarray:
    """For each byte of UTF-8 but the first, whether it's one of `MARKS` after a Latin letter.

    No letters are the signs of multiplication and division; a capital dotted I ends in a mark of its own when lower-cased.
    """
    before = data[:-1]
    letter = (before | 32) - np.uint8(97) < 26
    lead, second = data[:-2], data[1:-1]
    wide = (lead - np.uint8(0xC3) < 7) & (second - np.uint8(0x80) < 64)
    wide &= ~((lead == 0xC3) & ((second == 0x97) | (second == 0xB7)) | (lead == 0xC4) & (second == 0xB0))
    letter[1:] |= wide
    return _IS_MARK[data[1:]] & letter


class Encoder:
    """`ids` gives what encode(text, add_special_tokens=False) does, as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str, held: int = HELD):
        self.held = held
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; the library would start a thread for each of the machine's
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.size = self.tokenizer.get_vocab_size()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.drops_space = "Replace" in str(self.tokenizer.normalizer)
        self.known = pa.array([], pa.large_string())
        self.sizes, self.known_ids = np.empty(0, np.int64), np.empty(0, "<u4")
        self.between, self.word = (" | ", _NO_BAR) if self.drops_space else ("\n", _WORD)
        ends = self.tokenizer.encode(self.between, add_special_tokens=False).ids
        self.line_end = ends[0] if len(ends) == 1 else None

    def regular(self, text: str) -> bool:
        """Whether the text may be cut at each blank and line feed."""
        if any(s in text for s in self.special):
            return False
        if self.drops_space:
            return True
        odd = "  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[:1] in " \n" or text[-1:] in " \n"
        return not odd and _PLAIN.fullmatch(text) is not None

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text that isn't regular."""
        return [text] if self.drops_space or any(s in text for s in self.special) else _SAFE.split(text)

    def _encode(self, pieces: list[str], into: dict[str, bytes]) -> None:
        if self.line_end is not None:
            pieces = self._encode_words(pieces, into)
        for at in range(0, len(pieces), 20_000):
            some = pieces[at : at + 20_000]
            made = self.tokenizer.encode_batch_fast(some, add_special_tokens=False)
            into.update(zip(some, [array("I", e.ids).tobytes() for e in made], strict=True))

    def _encode_words(self, pieces: list[str], into: dict[str, bytes]) -> list[str]:
        """Encode the pieces that are words in lines of 64, with a token of its own between them; gives the others back."""
        words = list(filter(self.word.fullmatch, pieces))
        for at in range(0, len(words), 64 * 300):
            lines = [words[i : i + 64] for i in range(at, min(at + 64 * 300, len(words)), 64)]
            for line, made in zip(lines, self.tokenizer.encode_batch_fast([self.between.join(x) for x in lines], add_special_tokens=False), strict=True):
                ids = array("I", made.ids)
                parts, first = [], 0
                for _ in line[1:]:
                    last = ids.index(self.line_end, first)
                    parts.append(ids[first:last].tobytes())
                    first = last + 1
                parts.append(ids[first:].tobytes())
                into.update(zip(line, parts, strict=True))
        return pieces if not words else [x for x in pieces if x not in into]

    def _copied(self, pieces: pa.LargeStringArray, bounds: np.ndarray) -> list[np.ndarray]:
        """The ids of texts, each of the pieces from one bound to the next: those of each distinct piece are copied to its places."""
        coded = pieces.dictionary_encode()
        distinct = pc.ascii_ltrim(coded.dictionary, " \n") if self.drops_space else coded.dictionary
        found = pc.index_in(distinct, value_set=self.known)
        at, sizes, ids = found.fill_null(0).to_numpy(), self.sizes, self.known_ids
        if found.null_count:
            unknown = found.is_null()
            missing = distinct.filter(unknown).to_pylist()
            new: dict[str, bytes] = {}
            self._encode(list(dict.fromkeys(missing)), new)
            number = {p: i for i, p in enumerate(new, len(self.known))}
            at = at.copy()
            at[unknown.to_numpy(zero_copy_only=False)] = [number[p] for p in missing]
            sizes = np.concatenate([sizes, np.fromiter(map(len, new.values()), np.int64, len(new)) // 4])
            ids = np.concatenate([ids, np.frombuffer(b"".join(new.values()), "<u4")])
            if (room := self.held - len(self.known)) > 0:
                self.known = pa.concat_arrays([self.known, pa.array(islice(new, room), pa.large_string())])
                self.sizes = sizes[: len(self.known)].copy()
                self.known_ids = ids[: self.sizes.sum()].copy()
        first = np.cumsum(sizes) - sizes
        places = at[coded.indices.to_numpy()]
        own = sizes[places]
        upto = np.concatenate([[0], np.cumsum(own)])
        ids = ids[np.repeat(first[places] - upto[:-1], own) + np.arange(upto[-1])]
        ends = upto[bounds].tolist()
        return [ids[a:b] for a, b in zip(ends, ends[1:])]

    def _regular_ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of regular texts, cut as one run of bytes."""
        whole = pa.array(texts, pa.large_string())
        _, starts, content = whole.buffers()
        ends = np.frombuffer(starts, np.int64)[: len(texts) + 1]
        if not len(ends) or not ends[-1]:
            return [np.empty(0, "<u4")] * len(texts)
        data = np.frombuffer(content, np.uint8)[: ends[-1]]
        cut = np.zeros(len(data) + 1, bool)
        cut[ends] = True
        line = data == 10
        cut[:-1] |= (data == 32) | line
        cut[1:-1] |= _after_letter(data)
        if self.drops_space:
            # a capital that a mark of another byte may follow stays, as the two may be one letter when composed
            data = data + np.uint8(32) * ((data - np.uint8(65) < 26) & (np.append(data[1:], np.uint8(32)) < 128))
        else:
            cut[1:] |= line
        at = np.flatnonzero(cut)
        pieces = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data))
        return self._copied(pieces, np.searchsorted(at, ends))

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        regular = list(map(self.regular, texts))
        cut = iter(self._regular_ids([t for t, r in zip(texts, regular, strict=True) if r]))
        parts = [self.pieces(t) for t, r in zip(texts, regular, strict=True) if not r]
        if not parts:
            return list(cut)
        bounds = np.cumsum([0, *map(len, parts)])
        others = iter(self._copied(pa.array([p for ps in parts for p in ps], pa.large_string()), bounds))
        return [next(cut if r else others) for r in regular]


_encoders: dict[str, Encoder] = {}


def encoder(path: str, held: int = HELD) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path, held)
    return _encoders[path]


def forget() -> None:
    """Drop the worker's encoders with the pieces that they hold."""
    _encoders.clear()


def batches_of(texts: list[str | None], chars: int = 4_000_000):
    """Runs (first, last, texts) of about so many characters, with null as empty."""
    first, held, some = 0, 0, []
    for i, text in enumerate(texts):
        some.append(text or "")
        held += len(some[-1])
        if held >= chars:
            yield first, i + 1, some
            first, held, some = i + 1, 0, []
    if some:
        yield first, len(texts), some
