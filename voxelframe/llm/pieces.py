"""Token ids of whole texts as the tokenizers library gives them, with a table of the pieces seen before in NumPy arrays."""

from __future__ import annotations

import json

import numpy as np

from .token_counts import byte_letters

#: Bytes that the table may take before it starts anew; longer pieces aren't kept; bytes of text looked up at once.
REMEMBERED, LONGEST, WINDOW = 64 << 20, 256, 1 << 19
BASE = 0x9E3779B97F4A7C15
OTHER, LETTER, MARK, SPACE = 0, 1, 2, 3


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1), modulo 2 ** 64."""
    out = np.ones(n, np.uint64)
    out[1:] = base
    return np.cumprod(out, dtype=np.uint64)


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of ragged stretches, one behind the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class Growing:
    """An array that doubles when it is full."""

    def __init__(self, kind: np.dtype | str) -> None:
        self.kind = kind
        self.clear()

    def clear(self) -> None:
        self.held, self.n = np.zeros(1024, self.kind), 0

    def add(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.held):
            more = np.zeros(max(2 * len(self.held), self.n + len(values)), self.kind)
            more[: self.n] = self.held[: self.n]
            self.held = more
        self.held[self.n : self.n + len(values)] = values
        self.n += len(values)


class PieceTable:
    """Ids by piece (bytes), found by open addressing; entries behind ``kept`` are for one window only."""

    def __init__(self, kind: np.dtype) -> None:
        self.hash, self.size, self.at = Growing("<u8"), Growing("<i4"), Growing("<u4")
        self.count, self.ids_at, self.bytes, self.ids = Growing("<i4"), Growing("<u4"), Growing("<u1"), Growing(kind)
        self.clear()

    def clear(self) -> None:
        for g in self._all():
            g.clear()
        self.kept, self.bits = 0, 12
        self.slots = np.full(1 << self.bits, -1, np.int32)

    def _all(self) -> tuple[Growing, ...]:
        return self.hash, self.size, self.at, self.count, self.ids_at, self.bytes, self.ids

    def taken(self) -> int:
        return sum(g.held.nbytes for g in self._all()) + self.slots.nbytes

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return ((h * np.uint64(BASE)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Entries with this hash and size, -1 where there is none."""
        out = np.full(len(h), -1, np.int64)
        at, todo, last = self._slot(h), np.arange(len(h)), (1 << self.bits) - 1
        while len(todo):
            e = self.slots[at]
            hit = (e >= 0) & (self.hash.held[e] == h[todo]) & (self.size.held[e] == size[todo])
            out[todo[hit]] = e[hit]
            on = (e >= 0) & ~hit
            at, todo = (at[on] + 1) & last, todo[on]
        return out

    def add(self, h: np.ndarray, pieces: list[bytes], ids: list[list[int]]) -> int:
        """Append entries, not yet to be found; returns the number of the first."""
        first = self.hash.n
        sizes, counts = (np.fromiter(map(len, x), np.int64, len(x)) for x in (pieces, ids))
        self.at.add(self.bytes.n + np.cumsum(sizes) - sizes)
        self.ids_at.add(self.ids.n + np.cumsum(counts) - counts)
        self.hash.add(h)
        self.size.add(sizes)
        self.count.add(counts)
        self.bytes.add(np.frombuffer(b"".join(pieces), np.uint8))
        self.ids.add(np.fromiter((i for x in ids for i in x), np.int64, int(counts.sum())))
        return first

    def keep(self) -> None:
        """Let the entries added so far be found."""
        new = np.arange(self.kept, self.hash.n)
        self.kept = self.hash.n
        if 2 * self.kept > len(self.slots):
            self.bits = max(self.bits + 1, int(4 * self.kept - 1).bit_length())
            self.slots, new = np.full(1 << self.bits, -1, np.int32), np.arange(self.kept)
        at, last = self._slot(self.hash.held[new]), (1 << self.bits) - 1
        while len(new):
            free = self.slots[at] < 0
            self.slots[at[free]] = new[free]
            lost = self.slots[at] != new
            at, new = (at[lost] + 1) & last, new[lost]

    def forget(self) -> None:
        """Drop the entries that aren't to be found."""
        if self.hash.n > self.kept:
            self.bytes.n, self.ids.n = int(self.at.held[self.kept]), int(self.ids_at.held[self.kept])
            for g in (self.hash, self.size, self.at, self.count, self.ids_at):
                g.n = self.kept


class PieceEncoder:
    """Ids of whole texts, remembering the ids of pieces.

    By the byte-level pattern no token crosses from other characters to the white space behind them, or from a letter
    to a mark that no contraction and no special string begins or goes on with. Texts are cut there, and a piece has
    the same ids alone as in its text. Pieces that aren't in the table go to the library: single words to its merges,
    which is what it does with them itself, all others through its whole pipeline. Behind a character that isn't
    ASCII, and so may be white space, only a single blank or line end before an ASCII character is cut at.
    Found entries are compared byte by byte, so hashes only steer.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.merges = self.library.model
        self.kind = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        told = json.loads(self.library.to_str())
        special = "".join(t["content"] for t in told["added_tokens"])
        plain = [told["pre_tokenizer"], told["normalizer"]] == [{"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}, None]
        #: Only vocabularies with the plain byte-level pattern are cut.
        self.cuts = plain and not any(c.isspace() for c in special) and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in told["added_tokens"])
        self.letters = byte_letters()
        self.classes = np.zeros(256, np.uint8)
        self.classes[[c for c in range(128) if chr(c).isalpha()]] = LETTER
        self.classes[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in special and chr(c) != "'"]] = MARK
        self.classes[[9, 10, 11, 12, 13, 32]] = SPACE
        self.table = PieceTable(self.kind)
        self.powers, self.inverse = powers(BASE, 1), powers(pow(BASE, -1, 1 << 64), 1)

    def _new_ids(self, piece: bytes) -> list[int]:
        bare = piece[1:] if piece[:1] == b" " else piece
        text = piece.decode()
        if bare.isalpha() or text.lstrip(" ").isalpha() and len(text) - len(text.lstrip(" ")) < 2:
            return [t.id for t in self.merges.tokenize("".join([self.letters[b] for b in piece]))]
        return self.library.encode(text, add_special_tokens=False).ids

    def _starts(self, raw: np.ndarray, texts: np.ndarray) -> np.ndarray:
        """Where pieces begin; ``texts``: where texts begin."""
        kind = self.classes[raw]
        space = kind == SPACE
        cut = np.zeros(len(raw), bool)
        cut[1:] = (space[1:] & ~space[:-1]) | ((kind[1:] == MARK) & (kind[:-1] == LETTER))
        odd = np.flatnonzero(space[1:-1] & (raw[:-2] >= 128)) + 1
        cut[odd[space[odd + 1] | (raw[odd + 1] >= 128)]] = False
        cut[-1:] &= kind[-1:] != SPACE
        cut[texts[texts < len(raw)]] = True
        return np.flatnonzero(cut)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text."""
        if not self.cuts:
            return [np.array(self.library.encode(t, add_special_tokens=False).ids, self.kind).tobytes() for t in texts]
        coded = [t.encode() for t in texts]
        raw = np.frombuffer(b"".join(coded), np.uint8)
        text_at = np.cumsum([0, *map(len, coded)])
        start = self._starts(raw, text_at[:-1])
        ids, done, counts = [], 0, []
        while done < len(start):
            stop = max(done + 1, int(np.searchsorted(start, start[done] + WINDOW)))
            end = start[stop] if stop < len(start) else len(raw)
            found, count = self._window(raw[start[done] : end], start[done:stop] - start[done])
            ids.append(found)
            counts.append(count)
            done = stop
        # Ids ahead of each text, by the pieces ahead of it.
        ahead = np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1, np.int64)
        bounds = ahead[np.searchsorted(start, text_at)] * self.kind.itemsize
        packed = b"".join(x.tobytes() for x in ids)
        return [packed[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def encode(self, text: str) -> bytes:
        """Little-endian ids of one text."""
        return self.encode_all([text])[0]

    def _window(self, raw: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, and their number for each piece."""
        table, n = self.table, len(raw)
        if table.taken() > REMEMBERED:
            table.clear()
        size = np.diff(np.append(start, n))
        h = self._hashes(raw, start, size)
        entry = table.find(h, size)
        new = np.flatnonzero((entry < 0) & (size <= LONGEST))
        if len(new):
            _, first, which = np.unique(h[new], return_index=True, return_inverse=True)
            entry[new] = self._learn(raw, start, size, h, new[first]) + which
            table.keep()
        other = (entry < 0) | (table.size.held[entry] != size)
        at, known = np.where(other, 0, table.at.held[entry]), np.where(other, 0, size)
        same = raw[spread(start, known)] == table.bytes.held[spread(at, known)]
        # Pieces too long to keep, and those that share their hash with another piece.
        wrong = np.repeat(np.arange(len(start)), known)[~same]
        alone = np.unique(np.concatenate([np.flatnonzero(other), wrong]))
        if len(alone):
            entry[alone] = self._learn(raw, start, size, h, alone) + np.arange(len(alone))
        count = table.count.held[entry].astype(np.int64)
        found = table.ids.held[spread(table.ids_at.held[entry], count)]
        table.forget()
        return found, count

    def _learn(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray, h: np.ndarray, which: np.ndarray) -> int:
        pieces = [raw[a : a + s].tobytes() for a, s in zip(start[which].tolist(), size[which].tolist(), strict=True)]
        return self.table.add(h[which], pieces, [self._new_ids(p) for p in pieces])

    def _hashes(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The sum of (byte + 1) * base ** place, modulo 2 ** 64, as differences of one running sum."""
        if len(self.powers) < len(raw):
            self.powers, self.inverse = powers(BASE, len(raw)), powers(pow(BASE, -1, 1 << 64), len(raw))
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.powers[: len(raw)], out=total[1:])
        h = (total[start + size] - total[start]) * self.inverse[start]
        return h ^ (h >> np.uint64(31))
