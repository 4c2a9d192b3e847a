"""Token ids of whole texts, by the ``tokenizers`` library, remembered by piece.

A byte-level BPE never joins bytes across the place before a single space that
follows a visible character and precedes one. A text may therefore be cut there,
each distinct piece encoded once, and the pieces' ids joined: the same ids as
from the whole text, for a fraction of the work. The same holds on both sides of a
single line end between visible characters, and between a letter or digit and punctuation.
Texts with white space outside ASCII, with NUL or with the text of an added token
(which the library takes for that token) are encoded whole.

Cutting, looking up and joining are numpy work on the UTF-8 bytes of many texts. A piece of up to
24 bytes is its own key, as three 64-bit words; a table of ``REMEMBERED`` places holds the ids of those
that were met last, each in the place that its hash names, so memory is fixed and a
worker keeps learning however long it runs.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

import numpy as np

#: What is white space outside ASCII, and NUL.
ODD = ("\0", *map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Pieces that one worker remembers, rounded up to a power of two.
REMEMBERED = 1 << 20
JOINED = 4_000
#: Bytes of a piece that is remembered, its most ids; pieces and bytes handled at once.
KEY_BYTES, KEY_IDS = 24, 8
PIECES_AT_ONCE, BYTES_AT_ONCE = 1 << 18, 1 << 21

_VISIBLE = np.ones(256, bool)
_VISIBLE[[*range(9, 14), *range(0x1C, 0x21)]] = False
_SEEN = _VISIBLE.tolist()
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[list(b".,;:!?")] = True
_WORD = np.zeros(256, bool)
_WORD[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True
#: Second bytes of the letters from U+00C0 to U+00FF; the first is 0xC3.
_LATIN = np.zeros(256, bool)
_LATIN[[b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]] = True
#: Bits of a word that its first n bytes fill.
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)

_encoders: dict[str, PieceEncoder] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cuts(data: np.ndarray) -> np.ndarray:
    """Marks of the bytes before which a text may be cut; ``data`` has two more bytes at each end."""
    before, own, after = data[1:-3], data[2:-2], data[3:-1]
    seen, seen_after = _VISIBLE[before], _VISIBLE[after]
    line_end = (own == 10) & seen & seen_after
    marks = ((own == 32) & seen & seen_after) | line_end
    marks[1:] |= line_end[:-1]
    if len(marks):  # the byte before the first
        marks[0] |= bool(data[1] == 10 and _VISIBLE[data[0]] and _VISIBLE[data[2]])
    word = _WORD[before] | ((data[:-4] == 0xC3) & _LATIN[before])
    return marks | (_PUNCTUATION[own] & word)


def _ragged(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for every count, one after the other."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


class PieceEncoder:
    """Encodes texts with one vocabulary file; ids come as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.size = max(vocabulary.values()) + 1
        self.width = np.zeros(self.size, np.int64)  # bytes of text behind an id
        for token, i in vocabulary.items():
            self.width[i] = len(token)
        self.bits = max(1, (REMEMBERED - 1).bit_length())
        self.keys = [np.zeros(1 << self.bits, np.uint64) for _ in range(KEY_BYTES // 8)]
        self.counts = np.zeros(1 << self.bits, np.uint8)
        self.ids = np.zeros((1 << self.bits, KEY_IDS), np.uint16 if self.size <= 1 << 16 else np.uint32)

    def _encode_new(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the ids of each piece begin, how many they are, and all ids.

        Pieces that begin with a single space go into one call and are taken apart by their bytes.
        """
        starts, counts = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
        ids: list[np.ndarray] = []
        made = 0

        def put(part: list[int], n: np.ndarray, found: np.ndarray) -> None:
            nonlocal made
            counts[part] = n
            starts[part] = made + np.cumsum(n) - n
            ids.append(found)
            made += len(found)

        alike, rest = [], []
        for i, p in enumerate(new):
            (alike if len(p) > 1 and p[0] == 32 and _SEEN[p[1]] and _SEEN[p[-1]] else rest).append(i)
        for at in range(0, len(alike), JOINED):
            part = alike[at : at + JOINED]
            ends = np.cumsum([len(new[i]) for i in part])
            joined = b"".join([new[i] for i in part]).decode("utf-8", "surrogatepass")
            found = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
            reached = np.cumsum(self.width[found])
            places = np.searchsorted(reached, ends) + 1
            if not np.array_equal(reached[places - 1], ends):
                raise ValueError("a token crosses two pieces: the vocabulary is not byte-level BPE")
            put(part, np.diff(places, prepend=0), found)
        for at in range(0, len(rest), 1_000):
            part = rest[at : at + 1_000]
            texts = [new[i].decode("utf-8", "surrogatepass") for i in part]
            encoded = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            put(part, np.array([len(e) for e in encoded], np.int64), np.array([i for e in encoded for i in e], np.uint32))
        return starts, counts, np.concatenate(ids)

    def _encode_pieces(
        self, data: np.ndarray, begins: np.ndarray, lengths: np.ndarray, whole: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each piece of ``data``, and all ids; ``data`` has KEY_BYTES more bytes at its end.

        Pieces that are ``whole`` texts may hold NUL, which a key cannot, so they are not remembered.
        """
        words = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
        short = (lengths <= KEY_BYTES) & ~whole
        own = [words[begins + 8 * k] & _MASKS[np.clip(lengths - 8 * k, 0, 8)] for k in range(KEY_BYTES // 8)]
        mixed = np.zeros(len(begins), np.uint64)
        for part in own:
            mixed = (mixed ^ part) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(32)
        place = ((mixed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.bits)).astype(np.int64)
        known = short.copy()
        for part, table in zip(own, self.keys, strict=True):
            known &= table[place] == part
        counts = np.where(known, self.counts[place], 0).astype(np.int64)

        fresh = np.flatnonzero(~known)
        if len(fresh):
            new, first, same = self._distinct(data, begins, lengths, [part[fresh] for part in own], fresh, short[fresh])
            new_starts, new_counts, new_ids = self._encode_new(new)
            counts[fresh] = new_counts[same]
            keep = np.flatnonzero(short[first] & (new_counts <= KEY_IDS))
            at = place[first[keep]]
            rows = np.zeros((len(keep), KEY_IDS), self.ids.dtype)
            inside = np.arange(KEY_IDS) < new_counts[keep][:, None]
            rows[inside] = new_ids[np.repeat(new_starts[keep], new_counts[keep]) + _ragged(new_counts[keep])]
        starts = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.uint32)
        held = np.flatnonzero(known)
        if len(held):
            inside = np.arange(KEY_IDS) < counts[held][:, None]
            out[(starts[held][:, None] + np.arange(KEY_IDS))[inside]] = self.ids[place[held]][inside]
        if len(fresh):
            n = counts[fresh]
            step = _ragged(n)
            out[np.repeat(starts[fresh], n) + step] = new_ids[np.repeat(new_starts[same], n) + step]
            # Of new pieces with one place the last is remembered, in all columns alike.
            last = np.unique(at[::-1], return_index=True)[1]
            last = len(at) - 1 - last
            for part, table in zip(own, self.keys, strict=True):
                table[at[last]] = part[first[keep[last]]]
            self.counts[at[last]] = new_counts[keep[last]]
            self.ids[at[last]] = rows[last]
        return counts, out

    @staticmethod
    def _distinct(data, begins, lengths, keys, fresh, short) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The distinct pieces among ``fresh``: their bytes, the first place of each, and which one each place has."""
        raw = data.tobytes()
        same = np.zeros(len(fresh), np.int64)
        brief = np.flatnonzero(short)
        order = brief[np.lexsort([k[brief] for k in keys])]
        differ = np.ones(len(order), bool)
        if len(order):
            differ[1:] = False
            for k in keys:
                differ[1:] |= k[order][1:] != k[order][:-1]
        same[order] = np.cumsum(differ) - 1
        first = fresh[order[differ]].tolist()
        new = [raw[b : b + n] for b, n in zip(begins[first].tolist(), lengths[first].tolist(), strict=True)]
        long: dict[bytes, int] = {}
        for i in np.flatnonzero(~short).tolist():
            b, n = int(begins[fresh[i]]), int(lengths[fresh[i]])
            piece = raw[b : b + n]
            if piece not in long:
                long[piece] = len(new)
                new.append(piece)
                first.append(int(fresh[i]))
            same[i] = long[piece]
        return new, np.array(first, np.int64), same

    def _encode_some(self, texts: list[bytes], whole: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts, and the number of ids of each text."""
        raw = b"\n\n" + b"\n\n".join(texts) + b"\n\n"
        bounds = np.cumsum([2, *[len(t) + 2 for t in texts]])[:-1]
        sizes = np.array([len(t) for t in texts], np.int64)
        data = np.frombuffer(raw + bytes(KEY_BYTES), np.uint8)
        marks = np.zeros(len(raw), bool)
        for at in range(2, len(raw) - 2, BYTES_AT_ONCE):  # two blank bytes between texts: nothing is cut there
            end = min(at + BYTES_AT_ONCE, len(raw) - 2)
            marks[at:end] = cuts(data[at - 2 : end + 2])
        for b, n, one in zip(bounds.tolist(), sizes.tolist(), whole, strict=True):
            if one:
                marks[b : b + n] = False
        filled = sizes > 0
        marks[bounds[filled]] = True
        ends = (bounds + sizes)[filled]
        begins = np.flatnonzero(marks)
        piece_ends = np.append(begins[1:], len(raw))
        text = np.searchsorted(bounds[filled], begins, "right") - 1
        piece_ends = np.minimum(piece_ends, ends[text]) if len(begins) else piece_ends[:0]
        alone = np.array(whole, bool)[filled]
        counts, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for at in range(0, len(begins), PIECES_AT_ONCE):
            part = slice(at, at + PIECES_AT_ONCE)
            low, high = int(begins[part][0]), int(piece_ends[part][-1])
            n, found = self._encode_pieces(data[low : high + KEY_BYTES], begins[part] - low, piece_ends[part] - begins[part], alone[text[part]])
            counts.append(n)
            ids.append(found)
        per_text = np.zeros(len(texts), np.int64)
        owner = np.flatnonzero(filled)[text] if len(begins) else text
        np.add.at(per_text, owner, np.concatenate(counts))
        return np.concatenate(ids), per_text

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        """Ids of each text; a null text counts as empty."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            some: list[bytes] = []
            whole: list[bool] = []
            size = 0
            while at < len(texts) and size < BYTES_AT_ONCE:
                text = texts[at] or ""
                odd = ODD[:1] if text.isascii() else ODD
                whole.append(any(o in text for o in odd) or any(a in text for a in self.added))
                some.append(text.encode("utf-8", "surrogatepass"))
                size += len(some[-1])
                at += 1
            ids, counts = self._encode_some(some, whole)
            ends = np.cumsum(counts) * 4
            raw = ids.astype("<u4", copy=False).tobytes()
            out += [raw[b:e] for b, e in zip((ends - counts * 4).tolist(), ends.tolist(), strict=True)]
        return out


def encoder(path: str) -> PieceEncoder:
    """This worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]
