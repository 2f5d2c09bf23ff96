"""Token ids by a public tokenizer file, with a bounded memory of frequent words.

The tokenizers library encodes about a megabyte a second; most of a corpus is
a small set of words. Texts of Latin letters, digits and ASCII signs are cut
into parts by the pre-tokenizer's own pattern, and only parts not seen before go
to the library's model; where blanks belong to the tokens, many such texts are cut and
looked up together, as arrays. Of other texts: both kinds of vocabulary here never
merge across a space that stands between two other characters, so a text is cut
there, pieces are looked up, and only unseen ones go to the library.
"""

from __future__ import annotations

import re

import numpy as np

#: Single letters-then-marks words, whose two parts the pre-tokenizers always separate.
_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
_LATIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
_BLANKS = re.compile(r" \s")
#: Texts of these signs only: letters, digits and blanks are then those of the patterns below.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]*")
_PLAIN_BYTES = bytes([9, 10, 13, *range(32, 127), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)])  # the same in Latin-1
_SHORT = r"'(?:[stmd]|re|ve|ll)"
#: Parts into which the pre-tokenizers cut a plain text; the first kind's blanks belong to the parts, the second kind drops them.
_WITH_BLANKS = re.compile(_SHORT + r"| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-zÀ-ÖØ-öø-ÿ0-9]+|\s+(?!\S)|\s+")
_WITHOUT_BLANKS = re.compile(_SHORT + r"|[a-zà-öø-ÿß]+|[0-9]|[^\sa-zà-öø-ÿß0-9]+")
_CUT = re.compile(r"(?<=\S) (?=\S)")
_LONGEST = 64


def _byte_letters() -> dict[int, str]:
    """Latin-1 characters as byte-level vocabularies write their UTF-8 bytes: printable bytes as themselves, the others counted up from 256."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    letter = {b: chr(b) if b in printable else chr(256 + others.index(b)) for b in range(256)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(256)}


_BYTES = _byte_letters()


def _plain_bytes(text: str) -> bytes | None:
    """``text`` in Latin-1 if all of it is of _PLAIN's signs; the pattern itself takes much longer."""
    try:
        coded = text.encode("latin-1")
    except UnicodeEncodeError:
        return None
    return None if coded.translate(None, _PLAIN_BYTES) else coded


def _plain(text: str) -> bool:
    return _plain_bytes(text) is not None


class _Words(dict):
    """Ids of pieces that follow a blank (``lead`` is the blank, where it belongs to the tokens).

    Words of letters are remembered; when ``limit`` of them are held it starts
    anew. Words with marks behind them are put together, all else goes to the
    library.
    """

    def __init__(self, library, lead: str, spaced: bool, limit: int):
        super().__init__()
        self.library, self.model, self.lead, self.spaced, self.limit = library, library.model, lead, spaced, limit
        self.marks: dict[str, bytes] = {}
        self.bare = _Words(library, "", spaced, limit // 8) if lead else self

    def __missing__(self, piece: str) -> bytes:
        word, mark = self.get(piece[:-1]), self.marks.get(piece[-1:])
        if word is not None and mark is not None:  # words held are of letters only, so the mark stands alone
            return word + mark
        if piece.isalpha() and (piece.isascii() or _LATIN.fullmatch(piece)):
            lower = piece if self.spaced else piece.lower()
            made = self.part(self.lead + piece) if lower == piece else self[lower]
            if len(piece) <= _LONGEST:
                if len(self) >= self.limit:
                    self.clear()
                self[piece] = made
            return made
        if "\n" not in piece:
            found = _WORD.fullmatch(piece)
            if found:
                return self[found[1]] + self.mark(found[2])
        else:
            first, *rest = piece.split("\n")
            if all(map(_WORD.fullmatch, (first, *rest))):
                line = self.mark("\n") if self.spaced else b""
                return line.join([self[first], *map(self.bare.__getitem__, rest)])
        return self.raw(self.lead + piece) if self.lead + piece else b""

    def raw(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def part(self, part: str) -> bytes:
        """Ids of letters or marks that the pre-tokenizer leaves in one part: the library's model alone, in half the time."""
        word = part[1:] if part[:1] == " " else part
        if word.isascii() and word.isalpha():  # letters are written as themselves
            part = word if word is part else "\u0120" + word
        else:
            part = part.translate(_BYTES)
        return b"".join([x.id.to_bytes(4, "little") for x in self.model.tokenize(part)])

    def mark(self, mark: str) -> bytes:
        if mark not in self.marks:
            if len(self.marks) >= 10_000:
                self.marks.clear()
            self.marks[mark] = self.part(mark)
        return self.marks[mark]


class _Parts(dict):
    """Ids of the parts of plain texts; when ``limit`` of them are held it starts anew."""

    def __init__(self, words: _Words, limit: int):
        super().__init__()
        self.words, self.limit = words, limit

    def __missing__(self, part: str) -> bytes:
        made = self.words.part(part)
        if len(part) <= _LONGEST:
            if len(self) >= self.limit:
                self.clear()
            self[part] = made
        return made


_END, _LETTER, _DIGIT, _MARK, _BLANK = range(5)
_KINDS = np.array([_BLANK if b in b"\t\n\r " else _DIGIT if 48 <= b < 58 else _LETTER if _LATIN.fullmatch(chr(b)) else _MARK if b else _END for b in range(256)], np.uint8)
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # masks of the first k bytes


def part_starts(signs: np.ndarray) -> np.ndarray:
    """Where the parts of _WITH_BLANKS begin in plain texts in Latin-1, each with a zero behind it, which is a part; a zero first, three last."""
    kind = _KINDS[signs]
    begins = np.empty(len(signs), bool)
    begins[0], begins[1:] = True, kind[1:] != kind[:-1]
    begins[kind == _END] = True
    last = np.flatnonzero((kind[:-1] == _BLANK) & (kind[1:] != _BLANK) & (kind[1:] != _END))  # of blanks before something: a part, or the head of one
    begins[last] = True
    begins[last[signs[last] == 32] + 1] = False
    at = np.flatnonzero(signs == 39)
    at = at[(kind[at - 1] != _MARK) & (signs[at - 1] != 32)]  # apostrophes that begin a part
    second, third = signs[at + 1], signs[at + 2]
    for size, short in ((2, np.isin(second, np.frombuffer(b"stmd", np.uint8))), (3, (third == 101) & ((second == 114) | (second == 118)) | (second == 108) & (third == 108))):
        begins[at[short] + 1] = False
        begins[at[short] + size] = True
    return np.flatnonzero(begins)


class _PartTable:
    """Ids of the parts of many plain texts at once.

    Parts of up to 16 bytes are two integers, found in an open hash table that
    is probed for a chunk of parts together; both integers are compared. It starts
    anew beyond ``limit`` parts or POOL ids; longer parts go to ``longer``.
    """

    CHUNK = 1 << 18
    POOL = 1 << 22

    def __init__(self, words: _Words, longer: _Parts, limit: int):
        self.words, self.longer, self.limit = words, longer, limit
        most = limit + self.CHUNK + 1
        self.bits = (2 * most).bit_length()
        self.slots = np.empty(1 << self.bits, np.int32)
        self.low, self.high = np.zeros(most, np.uint64), np.zeros(most, np.uint64)
        self.at, self.size = np.zeros(most, np.int64), np.zeros(most, np.int64)
        self.pool = np.zeros(1 << 16, np.uint32)
        self.clear()

    def clear(self) -> None:
        self.slots.fill(-1)
        self.count = self.used = 0

    def _hold(self, ids: list[bytes], low: np.ndarray | int = 0, high: np.ndarray | int = 0) -> np.ndarray:
        """Numbers of new entries with these ids."""
        new = np.frombuffer(b"".join(ids), "<u4")
        while self.used + len(new) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        self.pool[self.used : self.used + len(new)] = new
        own = slice(self.count, self.count + len(ids))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        self.low[own], self.high[own], self.size[own] = low, high, sizes
        self.at[own] = self.used + np.cumsum(sizes) - sizes
        self.count, self.used = own.stop, self.used + len(new)
        return np.arange(own.start, own.stop, dtype=np.int32)

    def _found(self, low: np.ndarray, high: np.ndarray, signs: bytes, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        h = (low ^ (high * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0x9E3779B97F4A7C15)
        slot = (((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - self.bits)).astype(np.int64)
        held = self.slots[slot]
        todo = np.flatnonzero((held < 0) | (self.low[held] != low) | (self.high[held] != high))
        unseen = [todo[:0]]
        while len(todo):
            none = held[todo] < 0
            unseen.append(todo[none])
            todo = todo[~none]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            held[todo] = now = self.slots[slot[todo]]
            todo = todo[(now < 0) | (self.low[now] != low[todo]) | (self.high[now] != high[todo])]
        unseen = np.concatenate(unseen)
        if not len(unseen):
            return held
        parts = [signs[a:b].decode("latin-1") for a, b in zip(begin[unseen].tolist(), (begin + length)[unseen].tolist(), strict=True)]
        fresh = dict(zip(parts, range(len(parts)), strict=True))  # the last place of each
        first = unseen[np.fromiter(fresh.values(), np.int64, len(fresh))]
        new = self._hold(list(map(self.words.part, fresh)), low[first], high[first])
        held[unseen] = np.fromiter(map(dict(zip(fresh, new.tolist(), strict=True)).__getitem__, parts), np.int32, len(parts))
        slot = slot[first]
        while len(new):  # of several that want one slot the last gets it
            free = self.slots[slot] < 0
            self.slots[slot[free]] = new[free]
            left = self.slots[slot] != new
            slot, new = (slot[left] + 1) & ((1 << self.bits) - 1), new[left]
        return held

    def encode(self, texts: list[bytes], end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``texts``, ``end`` behind each, and how many each has."""
        joined = b"\0".join([b"", *texts, bytes(24)])
        signs = np.frombuffer(joined, np.uint8)
        starts = part_starts(signs)
        starts = starts[1 : len(starts) - 24]  # but for the zeros around
        window = np.ndarray((len(signs) - 7,), "<u8", signs, strides=(1,))
        made, ends, before = [], [], 0
        for a in range(0, len(starts), self.CHUNK):
            begin = starts[a : a + self.CHUNK]
            length = np.diff(begin, append=starts[a + len(begin)] if a + len(begin) < len(starts) else len(signs) - 24)
            if self.count >= self.limit or self.used >= self.POOL:
                self.clear()
            closes, far = signs[begin] == 0, length > 16
            known = np.flatnonzero(~closes & ~far)
            b, n = begin[known], length[known]
            held = np.zeros(len(begin), np.int64)
            held[known] = self._found(window[b] & _FIRST[np.minimum(n, 8)], window[b + 8] & _FIRST[np.clip(n - 8, 0, 8)], joined, b, n)
            held[closes] = self._hold([end.to_bytes(4, "little")])
            held[far] = self._hold([self.longer[joined[i : i + k].decode("latin-1")] for i, k in zip(begin[far].tolist(), length[far].tolist(), strict=True)])
            size = self.size[held]
            stop = np.cumsum(size)
            made.append(self.pool[np.repeat(self.at[held] - stop + size, size) + np.arange(stop[-1])])
            ends.append(before + stop[closes])
            before += int(stop[-1])
        return np.concatenate(made), np.diff(np.concatenate(ends), prepend=0)


class TextEncoder:
    """``encode(text)``: the library's ids as little-endian unsigned 32-bit integers.

    ``encode_all(texts, end)``: arrays of the ids of each text, ``end`` behind them.
    ``limit`` bounds the words that a worker remembers, at about 200 bytes each.
    """

    def __init__(self, path: str, limit: int = 1_000_000):
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._spaced = self._library.normalizer is None  # blanks belong to the tokens; else they are dropped
        self._words = _Words(self._library, " " if self._spaced else "", self._spaced, limit // 4)
        self._parts = _Parts(self._words, limit)
        self._table: _PartTable | None = None
        self._limit = limit
        added = [t.content for t in self._library.get_added_tokens_decoder().values()]
        self._added = added if self._spaced else []
        self._added_any_case = re.compile("|".join(map(re.escape, added)), re.IGNORECASE) if added and not self._spaced else None

    @property
    def vocabulary(self) -> int:
        return self._library.get_vocab_size()

    def encode_all(self, texts: list[str | None], end: int) -> list[np.ndarray]:
        coded = [None if not self._spaced or any(x in t for x in self._added) else _plain_bytes(t) for t in (t or "" for t in texts)]
        plain = [c for c in coded if c is not None]
        if plain:
            self._table = self._table or _PartTable(self._words, _Parts(self._words, self._limit // 8), self._limit)
            ids, sizes = self._table.encode(plain, end)
            cuts = iter(np.split(ids, np.cumsum(sizes)[:-1]))
        tail = end.to_bytes(4, "little")
        return [np.frombuffer(self.encode(t or "") + tail, "<u4") if c is None else next(cuts) for t, c in zip(texts, coded, strict=True)]

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if _plain(text) and not any(x in text for x in self._added) and not (self._added_any_case and self._added_any_case.search(text)):
            parts = _WITH_BLANKS.findall(text) if self._spaced else _WITHOUT_BLANKS.findall(text.lower())
            return b"".join(map(self._parts.__getitem__, parts))
        if not self._spaced:
            return b"".join(map(self._words.__getitem__, text.split(" ")))
        first, *rest = _CUT.split(text) if _BLANKS.search(text) else text.split(" ")
        return (self._words.bare[first] if first else b"") + b"".join(map(self._words.__getitem__, rest))


_HELD: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """One encoder per tokenizer file and Python worker."""
    if path not in _HELD:
        _HELD[path] = TextEncoder(path)
    return _HELD[path]
