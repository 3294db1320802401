"""Whole-text tokenization on the executors, piece by piece.

The word tokenizer splits at white space before anything else looks at its neighbours, so a text's ids are
those of its white-space separated pieces in order (the tests compare whole texts). Of the distinct pieces of
a batch a worker first looks up those it has met. Of the others those of lower-case letters, digits and plain
punctuation are cut into words and merged all at once by the tokenizer's own merge list (`Merges`); the
tokenizer itself takes the rest.
"""

from __future__ import annotations

import sys
import unicodedata

import numpy as np

from sluice.llm import textcore as tc

#: The tokenizer's name among the public files, the parameter of every operator that tokenizes.
TOKENIZER = "word_bpe_49k.json"
#: Pieces that a worker remembers before it starts afresh.
REMEMBER = 150_000
#: Bytes of text that are encoded at once: the more, the fewer pieces are distinct.
SLICE = 16 << 20
#: Bytes of a piece that is merged with others at once; longer ones go to the tokenizer.
LONGEST = 64


class Merges:
    """Byte-pair merges of many words at once; a word's last byte is that of a word's end."""

    def __init__(self, tokenizer):
        import json

        model = json.loads(tokenizer.to_str())["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        by_byte = _byte_characters()
        self.inner, self.last = (np.asarray([vocab[chr(by_byte[b]) + end] for b in range(256)], np.int32) for end in ("", suffix))
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank_to_id = np.asarray([vocab[a + b] for a, b in pairs], np.int32)
        self.none = len(pairs)
        # pair -> rank in a table of slots; the few pairs whose slot is taken are in a sorted list
        self.keys = np.append(np.asarray([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64), -1)
        self.table = np.full(1 << 19, self.none, np.int32)
        self.table[self._slot(self.keys[:-1])[::-1]] = np.arange(self.none)[::-1]
        over = np.flatnonzero(self.table[self._slot(self.keys[:-1])] != np.arange(self.none))
        over = over[np.argsort(self.keys[over])]
        self.over_keys, self.over_ranks = np.append(self.keys[over], 2**63 - 1), np.append(over, self.none).astype(np.int32)
        self.crowded = np.zeros(1 << 19, bool)
        self.crowded[self._slot(self.keys[over])] = True

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(tc.MULTIPLIERS[0])) >> np.uint64(45)).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs; `none` for those that do not merge."""
        keys = a.astype(np.int64) << 32 | b
        slot = self._slot(keys)
        rank = self.table.take(slot)
        wrong = self.keys.take(rank) != keys
        if wrong.any():
            rank[wrong] = self.none
            k = np.flatnonzero(wrong & self.crowded.take(slot))
            if len(k):
                at = np.searchsorted(self.over_keys, keys[k])
                rank[k] = np.where(self.over_keys[at] == keys[k], self.over_ranks[at], self.none)
        return rank

    def __call__(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, given as bytes one after the other with their lengths, and the ids of each."""
        ends = np.cumsum(lengths)
        symbol = self.inner.take(data)
        symbol[ends - 1] = self.last.take(data[ends - 1])
        word, n = np.arange(len(lengths)), lengths.copy()
        rank = np.full(len(symbol), self.none, np.int32)
        inside = np.ones(len(symbol), bool)
        inside[ends - 1] = False
        k = np.flatnonzero(inside)
        rank[k] = self.ranks(symbol[k], symbol[k + 1])
        found, of, sizes = [], [], []
        while len(word):
            starts = np.cumsum(n) - n
            best = np.minimum.reduceat(rank, starts)
            going = best < self.none
            if not going.all():
                each = np.repeat(going, n)
                found.append(symbol[~each])
                of.append(word[~going])
                sizes.append(n[~going])
                symbol, rank, word, n, best = symbol[each], rank[each], word[going], n[going], best[going]
                if not len(word):
                    break
                starts = np.cumsum(n) - n
            at = np.flatnonzero(rank == np.repeat(best, n))
            # the first of equals in each word
            owner = np.searchsorted(starts, at, "right") - 1
            first = np.ones(len(at), bool)
            first[1:] = owner[1:] != owner[:-1]
            at = at[first]
            symbol[at] = self.rank_to_id.take(best)
            stay = np.ones(len(symbol), bool)
            stay[at + 1] = False
            symbol, rank = symbol[stay], rank[stay]
            at, n = at - np.arange(len(at)), n - 1
            starts = np.cumsum(n) - n
            rank[at] = self.none
            k = at[at < starts + n - 1]
            rank[k] = self.ranks(symbol[k], symbol[k + 1])
            k = at[at > starts] - 1
            rank[k] = self.ranks(symbol[k], symbol[k + 1])
        if not found:
            return np.empty(0, np.int32), np.zeros(0, np.int64)
        # back into the words' order
        of, sizes, flat = np.concatenate(of), np.concatenate(sizes), np.concatenate(found)
        start = np.cumsum(sizes) - sizes
        order = np.argsort(of, kind="stable")
        n = sizes[order]
        out = np.cumsum(n)
        return flat[np.repeat(start[order] - (out - n), n) + np.arange(out[-1])], n


class Pieces:
    """The pieces met so far: `known`, and their ids, with where each one's start and how many they are."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.merges = Tokenizer.from_file(path), None
        ids = lambda x: self.tokenizer.encode(x, add_special_tokens=False).ids
        # what is taken for granted below is tried out: other tokenizers encode whole texts, or whole pieces
        self.splits = all(ids(a + " " + b) == ids(a) + ids(b) == ids(f"\n{a.upper()}\t{b} ") for a, b in (("the", "cats"), ("eine", "straße.")))
        try:
            self.merges = Merges(self.tokenizer)
        except (KeyError, TypeError):  # not a model of byte pairs with word ends
            pass
        self.forget()
        if self.merges:
            import pyarrow as pa

            found, n = self._new(pa.array(_TRIED, pa.large_string()))
            if found.tolist() != [i for x in _TRIED for i in ids(x)]:
                self.merges = None

    def forget(self):
        """Starts afresh."""
        import pyarrow as pa

        self.known, self.of = pa.array([], pa.large_string()), (np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64))

    def look(self, distinct) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and for each of the distinct pieces (an Arrow array) where its ids start and how many they are."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if len(self.known) > REMEMBER:
            self.forget()
        distinct = distinct.cast(pa.large_string())
        number = pc.index_in(distinct, value_set=self.known)
        fresh = np.flatnonzero(np.asarray(number.is_null()))
        number = np.asarray(number.fill_null(0)).astype(np.int64)
        if len(fresh):
            number[fresh] = len(self.known) + np.arange(len(fresh))
            column = distinct.take(pa.array(fresh))
            ids, length = self._new(column)
            self.of = (np.concatenate([self.of[0], ids]), np.concatenate([self.of[1], len(self.of[0]) + np.cumsum(length) - length]), np.concatenate([self.of[2], length]))
            self.known = pa.concat_arrays([self.known, column])
        return self.of[0], self.of[1][number], self.of[2][number]

    def _new(self, column) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces (an Arrow array of large strings) one after the other, and how many each has."""
        import pyarrow as pa

        if not self.merges:
            return self._asked(column)
        _, offsets, held = column.buffers()
        edges = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(held, np.uint8)[edges[0] : edges[-1]] if held else np.empty(0, np.uint8)
        size, kinds = np.diff(edges), _kinds(data)
        odd = np.concatenate([[0], np.cumsum(kinds == 0)])
        edges = edges - edges[0]
        simple = (odd[edges[1:]] == odd[edges[:-1]]) & (size > 0) & (size <= LONGEST)
        each = np.repeat(simple, size)
        data, kinds, size = data[each], kinds[each], size[simple]
        # a word is a run of letters or of punctuation, or a digit
        begins = (kinds == _DIGIT) | np.concatenate([[True], kinds[1:] != kinds[:-1]])[: len(kinds)]
        begins[np.cumsum(size) - size] = True
        first = np.flatnonzero(begins)
        ids, n = self.merges(data, np.diff(np.append(first, len(data))))
        words = np.concatenate([[0], np.cumsum(begins)])[np.cumsum(size)]  # up to each piece's end
        so_far = np.concatenate([[0], np.cumsum(n)])[words]
        length = np.zeros(len(column), np.int64)
        length[simple] = np.diff(so_far, prepend=0)
        rest = np.flatnonzero(~simple)
        if not len(rest):
            return ids, length
        asked, length[rest] = self._asked(column.take(pa.array(rest)))
        out = np.empty(length.sum(), np.int32)
        mine = np.repeat(simple, length)
        out[mine], out[~mine] = ids, asked
        return out, length

    def _asked(self, column) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts by the tokenizer itself."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(column.to_pylist(), add_special_tokens=False)]
        n = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((x for ids in found for x in ids), np.int32, int(n.sum())), n

    def encode(self, column, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of an Arrow string column's texts, one after the other, and the ids in each; end is appended to each text."""
        if not self.splits:
            return self._whole(column, end)
        distinct, number, counts = tc.split(_lowered(tc.strings(column)))
        flat, start, length = self.look(distinct)
        del distinct
        length = length.take(number)
        before = np.concatenate([[0], np.cumsum(length)])
        first = (start.take(number) - before[:-1]).astype(np.int32)  # a slice of texts is far below 2**31 ids
        del number
        at = np.repeat(first, length)
        del first, length
        at += np.arange(before[-1], dtype=np.int32)
        ids = flat.take(at)
        del at
        edges = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        n = before[edges[1:]] - before[edges[:-1]]
        if end is not None:
            ids = np.insert(ids, np.cumsum(n), end)
            n = n + 1
        return ids, n

    def _whole(self, column, end):
        ids, n = self._asked(tc.strings(column))
        return (ids, n) if end is None else (np.insert(ids, np.cumsum(n), end), n + 1)


_TRIED = ("unbelievable", "straße", "élève,", "привет", "ab", "a", "zzxq.", "banana", "日本語", "internationalization", "aaaaaaa", "a12b,c%%%", "...!?", "2024-11-26", "(x)")
_LETTER, _DIGIT, _STOP = 1, 2, 3


def _kind(c: int) -> int:
    """A code point's kind; 0 if its neighbours or a normalization might matter."""
    x = chr(c)
    if c < 128:
        return _LETTER if x.islower() else _DIGIT if x.isdigit() else _STOP if 33 <= c < 127 and not x.isalpha() and x not in "'<" else 0
    jamo = 0x1100 <= c < 0x1200 or 0xA960 <= c < 0xA980 or 0xD7B0 <= c < 0xD800  # letters that join others
    return _LETTER if x.isalpha() and x.lower() == x and unicodedata.is_normalized("NFC", x) and not jamo else 0


def _kinds(data: np.ndarray) -> np.ndarray:
    """The kind of each byte's character."""
    held = getattr(sys, "_sluice_kinds", None)
    if held is None:
        held = sys._sluice_kinds = np.full(0x110000, -1, np.int8)
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    found = held.take(points)
    if (found < 0).any():
        for c in np.unique(points[found < 0]).tolist():
            held[c] = _kind(c)
        found = held.take(points)
    return found if len(points) == len(data) else np.repeat(found, 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000))


def _byte_characters() -> dict[int, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from 256 on in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(others)}


def _lowered(column):
    """A-Z to a-z, the tokenizer's own first steps, so that there are fewer distinct pieces. Texts with combining marks or `<|` are left as they are: there the order of the steps matters."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = column.cast(pa.string())
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held else np.empty(0, np.uint8)
    if ((data == 0xCC) | (data == 0xCD)).any() or ((data[:-1] == 60) & (data[1:] == 124)).any():  # such marks begin with one of these bytes
        as_is = pc.match_substring_regex(column, "[\u0300-\u036f]|<[|]")
        return pc.if_else(as_is, column, pc.ascii_lower(column))
    return pc.ascii_lower(column)


def pieces(name: str = TOKENIZER) -> Pieces:
    """This worker's cache; name is that of a public tokenizer file, or a path."""
    held = getattr(sys, "_sluice_pieces", None)
    if held is None:
        held = sys._sluice_pieces = {}
    if name not in held:
        import os

        path = name
        if not os.path.isabs(name):
            import public_tokenizers

            path = public_tokenizers.path(name)
        held[name] = Pieces(path)
    return held[name]


tc.by_value(__name__)
