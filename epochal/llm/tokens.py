"""Token ids of whole texts, remembering the ids of words seen before.

Both public tokenizers cut text before merging, and never merge across a space
between two other characters. So a word's ids don't depend on its neighbours,
and a frequent word is tokenised once a task. Texts with white space in runs go
through the tokenizer whole.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import hashes_at


class WordIds:
    """``spaces`` tells whether a word's ids include the space before it; where
    not, the tokenizer must drop white space and fold case."""

    def __init__(self, path: str, spaces: bool, most: int = 1_200_000, special_as_text: bool = True):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.spaces, self.most = spaces, most
        self.first: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.edge[i] = token.startswith("\u0120") if spaces else token.endswith("</w>")
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = WhitespaceSplit()
        self.marks = dict(zip(",.", self.whole([",", "."]), strict=True))
        self.forget()

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def letters(self, words: list[str], prefix: str) -> list[bytes]:
        """Ids of words, from texts of many words each.

        A word has one id that begins with the space before it, or, if it is of letters
        alone, one that ends at the word-end mark. Where some word has more, all are
        asked singly."""
        out: list[bytes] = []
        for k in range(0, len(words), 400):
            part = words[k : k + 400]
            text = " ".join(part)
            ids = np.array(self.tokenizer.encode(prefix + text, add_special_tokens=False).ids, "<u4")
            cut = np.flatnonzero(self.edge[ids])
            if len(cut) == len(part):
                data, ends = ids.tobytes(), [*(4 * cut[1:]).tolist(), 4 * len(ids)] if self.spaces else (4 * cut + 4).tolist()
                out.extend(data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True))
            else:
                out.extend(self.whole([prefix + w for w in part]))
        return out

    def learn(self, memo: dict[str, bytes], lists: list[list[str]]) -> None:
        """Remember the words; one of letters before a mark has the ids of both."""
        new = set(filterfalse(memo.__contains__, chain.from_iterable(lists)))
        if len(memo) + len(new) > self.most // 2:
            memo.clear()
            new = set(chain.from_iterable(lists))
        marked = {w: w[:-1] for w in new if w[-1:] in self.marks and w[:-1].isalpha() and w[-2].isascii()}
        plain = list(new.difference(marked).union(marked.values()).difference(memo))
        joined = [w for w in plain if w.isalpha()]
        memo.update(zip(joined, self.letters(joined, ""), strict=True))
        rest = [w for w in plain if w not in memo]
        memo.update(zip(rest, self.whole(rest), strict=True))
        for w, stem in marked.items():
            memo[w] = memo[stem] + self.marks[w[-1]]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return self.spaced(texts) if self.spaces else [np.frombuffer(x, "<u4") for x in self.plain(texts)]

    def plain(self, texts: list[str]) -> list[bytes]:
        cut = [folded(t).replace("\n", " ").split(" ") for t in texts]
        self.learn(self.first, cut)
        return [b"".join(map(self.first.__getitem__, words)) for words in cut]

    def spaced(self, texts: list[str]) -> list[np.ndarray]:
        """The pieces of all texts are slices of one array; the distinct ones are looked up once,
        and ids are taken for all at once.

        A piece is a word with the space before it, or without one after a line feed or mark; a
        line feed between two words; or marks after a letter or digit. The tokenizer cuts there
        too, as a run of letters or digits ends at a mark, and one of marks at a letter or digit,
        but for what follows an apostrophe."""
        out: list = [None] * len(texts)
        raw = [t.encode() for t in texts]
        data, kind, cut = joined(raw)
        doubtful = (kind == ODD) | cut & np.append(True, cut[:-1])
        ends = np.cumsum([len(x) + 1 for x in raw])
        hard = [i for i in np.unique(np.searchsorted(ends, np.flatnonzero(doubtful), "right")).tolist() if not plainly_spaced(texts[i])]
        for i, ids in zip(hard, self.whole([texts[i] for i in hard]), strict=True):
            out[i] = np.frombuffer(ids, "<u4")
        easy = sorted({*range(len(texts))}.difference(hard))
        if not easy:
            return out
        if hard:
            raw = [raw[i] for i in easy]
            data, kind, cut = joined(raw)
            ends = np.cumsum([len(x) + 1 for x in raw])
        after = cut[1:-1]
        after |= kind[:-2] == FEED
        at, mark = np.frombuffer(data, np.uint8), kind == MARK
        after |= mark[:-2] & (kind[1:-1] == SIGN)
        high = at > 127
        ahead = np.flatnonzero(mark[:-1] & high[1:]) + 1
        mark |= kind == QUOTE
        after |= mark[1:-1] & (kind[:-2] == SIGN)
        behind = np.flatnonzero(mark[2:] & high[1:-1])
        cut[ahead[wide_letters(at, ahead)]] = True
        cut[behind[wide_letters(at, behind)] + 2] = True
        cut[0] = True
        cuts = np.append(np.flatnonzero(cut), len(data))
        pieces = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(data)]).dictionary_encode()
        place = pieces.indices.to_numpy().copy()
        ends = np.searchsorted(cuts, ends - 1)
        place[ends] = len(pieces.dictionary)  # the line feed after a text has no ids
        found = pa.concat_arrays([self.found(pieces.dictionary), pa.array([b""], pa.large_binary())]).take(pa.array(place))
        upto, ids = (np.frombuffer(x, kind) for x, kind in zip(found.buffers()[1:], ("<i8", "<u4"), strict=True))
        stops = (upto[ends] // 4).tolist()
        for i, a, b in zip(easy, [0, *stops[:-1]], stops, strict=True):
            out[i] = ids[a:b]
        return out

    def found(self, pieces: pa.Array) -> pa.Array:
        """The ids of distinct pieces, as bytes; new ones are learnt. Where too many are known, all are forgotten."""
        starts = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset : pieces.offset + len(pieces) + 1]
        data = bytes(memoryview(pieces.buffers()[2])[: starts[-1]]) + bytes(8)
        hashes = hashes_at(data, starts[:-1], np.diff(starts))
        at = np.searchsorted(self.hashes[:-1], hashes)
        place = np.where(self.hashes[at] == hashes, self.where[at], -1)
        old = np.flatnonzero(place >= 0)
        same = pc.equal(self.known.take(pa.array(place[old])), pieces.take(pa.array(old))).to_numpy(zero_copy_only=False)
        place[old[~same]] = -1
        new = np.flatnonzero(place < 0)
        if len(new):
            place[new] = np.arange(len(self.known), len(self.known) + len(new))
            own = pieces.take(pa.array(new))
            self.known, self.pool = pa.concat_arrays([self.known, own]), pa.concat_arrays([self.pool, self.asked(own)])
            new = new[np.argsort(hashes[new])]
            at = np.searchsorted(self.hashes[:-1], hashes[new])
            self.hashes, self.where = np.insert(self.hashes, at, hashes[new]), np.insert(self.where, at, place[new])
        out = self.pool.take(pa.array(place))
        if len(self.known) > self.most:
            self.forget()
        return out

    def forget(self) -> None:
        """Know no piece. Hashes are in order, with the place of each one's piece; the last is none's."""
        self.hashes, self.where = np.zeros(1, np.uint64), np.full(1, -1, np.int32)
        self.known = self.pool = pa.array([], pa.large_binary())

    def asked(self, pieces: pa.Array) -> pa.Array:
        """Ids of distinct pieces. Words of letters, which the tokenizer doesn't cut, go to the merges alone."""
        data, at = laid_out(pieces)
        data, at = np.frombuffer(data, np.uint8), np.array(at[:-1])
        inner = data[at] == 32
        low = data | np.uint8(32)
        other = (low < 97) | (low > 122)
        other[at[inner]] = False  # their spaces
        pairs = np.flatnonzero(data[:-1] > 127)
        pairs = pairs[wide_letters(data, pairs)]
        wide = np.add.reduceat(other, at, dtype=np.int32) > 0
        other[pairs] = other[pairs + 1] = False
        strange = np.add.reduceat(other, at, dtype=np.int32) > 0
        kinds = [np.flatnonzero(x) for x in (inner & ~wide, inner & wide & ~strange, ~inner & ~strange, inner & strange, ~inner & strange)]
        parts = [pieces.take(pa.array(k)) for k in kinds]
        ids = [self.merged(part, inner=k < 2) for k, part in enumerate(parts[:3])]
        ids.append(pa.array(self.letters([w[1:].decode() for w in listing(parts[3])], " "), pa.large_binary()))
        ids.append(pa.array(self.whole(list(map(bytes.decode, listing(parts[4])))), pa.large_binary()))
        back = np.empty(len(pieces), np.int64)
        back[np.concatenate(kinds)] = np.arange(len(pieces))
        return pa.concat_arrays(ids).take(pa.array(back))

    def merged(self, words: pa.Array, inner: bool) -> pa.Array:
        """As ``letters``, without the search for pieces. ``inner``: after a space, which is
        part of the word's first id; other words are asked with a space after each."""
        out, ends, n = [], [0], 0
        data, at = laid_out(words) if len(words) else (b"", [])
        for k in range(0, len(words), 400):
            bounds = at[k : k + 401]
            text = data[bounds[0] : bounds[-1]] if inner else b" ".join([*(data[a:b] for a, b in zip(bounds, bounds[1:], strict=False)), b""])
            text = text.replace(b" ", b" \xc4\xa0").decode() if text.isascii() else named(text)
            ids = np.array(self.merges.encode_batch_fast([text if inner else text.replace("\u0120", "\u0120 ")], add_special_tokens=False)[0].ids, "<u4")
            cut = np.flatnonzero(self.edge[ids])
            if len(cut) != len(bounds) - 1:
                raise ValueError("a word of letters has another number of starts than one")
            if inner:
                sizes = np.diff(cut, append=len(ids))
            else:
                sizes = np.diff(cut, prepend=-1) - 1
                ids = np.delete(ids, cut)
            out.append(ids.tobytes())
            ends.append(n + 4 * np.cumsum(sizes))
            n += 4 * len(ids)
        return pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(np.hstack(ends).astype(np.int64)), pa.py_buffer(b"".join(out))])


def byte_names() -> dict[int, int]:
    """How byte-level vocabularies write the bytes that don't print: as letters from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in plain)}


#: A space is two characters, so that a line feed, which is in no word, stands for the one before its name.
BYTES = np.array([byte_names().get(b, b) if b != 10 else 32 for b in range(256)], "<u2")


def named(words: bytes) -> str:
    """Words of letters as byte-level vocabularies write them, with the space before each beside its name."""
    return BYTES.take(np.frombuffer(words.replace(b" ", b"\n "), np.uint8)).tobytes().decode("utf-16-le")


#: What a byte can be beside a cut. A mark is any that is printed but letters, digits and the apostrophe, with which a piece can go on into letters.
#: An odd one is or begins white space but for space and line feed, or may.
SIGN, MARK, QUOTE, ODD, SPACE, FEED = 1, 2, 3, 4, 5, 6
#: Which code points of two bytes in UTF-8 are letters; those from U+0530 on are left to the tokenizer.
LETTERS = np.array([chr(c).isalpha() and 128 <= c < 0x530 for c in range(0x800)])


def wide_letters(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether letters of two bytes begin at these places."""
    first = data[at]
    return (first >= 0xC3) & (first < 0xD5) & LETTERS.take((first & np.uint8(31)).astype(np.uint16) << np.uint16(6) | data[at + 1] & np.uint8(63))


#: White space but for space and line feed; the first eight are ASCII.
STRANGE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
KINDS = bytes({10: FEED, 32: SPACE, 39: QUOTE, **{c.encode()[0]: ODD for c in STRANGE}}.get(b) or (0 if not 32 < b < 127 else SIGN if chr(b).isalnum() else MARK) for b in range(256))


def joined(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Texts with a line feed after each, what their bytes are, and which are a space or line feed."""
    data = b"\n".join([*texts, b""])
    kind = np.frombuffer(data.translate(KINDS), np.uint8)
    return data, kind, kind >= SPACE


def laid_out(array: pa.Array) -> tuple[bytes, list[int]]:
    """The bytes of an array's values, one after the other, and where each begins, with the end."""
    at = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    return bytes(memoryview(array.buffers()[2])[at[0] : at[-1]]), (at - at[0]).tolist()


def listing(array: pa.Array) -> list[bytes]:
    """As ``to_pylist``, several times faster."""
    if not len(array):
        return []
    data, at = laid_out(array)
    return [data[a:b] for a, b in zip(at, at[1:], strict=False)]


def plainly_spaced(text: str) -> bool:
    """Whether single spaces and line feeds, each between two words, are its only white space."""
    if not text or text[0] in " \n" or text[-1] in " \n" or any(x in text for x in ("  ", " \n", "\n ", "\n\n")):
        return False
    return not any(c in text for c in (STRANGE[:8] if text.isascii() else STRANGE))


def folded(text: str) -> str:
    """Lower case where Python's rule is sure to be the tokenizer's, in Latin-1."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


@lru_cache(maxsize=2)
def word_ids(path: str, spaces: bool) -> WordIds:
    """One per worker process, so that later tasks know the words of earlier ones."""
    return WordIds(path, spaces)
