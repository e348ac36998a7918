"""Cutting text into pieces that a byte-level vocabulary encodes independently.

The public pattern cuts before every space that follows a non-space, so a text
without a white-space character in front of a space can be split at its spaces
first.  What lies between two spaces repeats often and is cached, and so is
each match of the pattern inside it.  Ids are kept as little-endian unsigned
32-bit integers, ready to be joined and hashed.  Texts are handled a batch at a
time: Arrow splits them and numbers the different words, each of which is looked
up once, and what is new is encoded in one call.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: A space behind white space: here the cheap split would cut a run in two.
_RUN = "[\\t-\\r\\x{1c}-\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}] "
#: Entries of one generation of a cache; pieces that are longer are kept for their batch only.
CACHE_PIECES, CACHE_LENGTH = 500_000, 40
#: Below this code point letters are the same in all versions of Unicode at hand.
_SETTLED = "ɐ"
#: Marks that the pattern keeps together behind a word.
MARKS = ".,;:!?*#%&$|"


def _is_word(text: str) -> bool:
    return text.isalpha() and (text.isascii() or max(text) < _SETTLED)


class _Cache:
    """The last two generations of entries; what is used again moves to the young one."""

    def __init__(self):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.brief: list[str] = []

    def turn(self) -> None:
        for key in self.brief:
            self.young.pop(key, None)
        self.brief.clear()
        if len(self.young) > CACHE_PIECES:
            self.old, self.young = self.young, {}

    def missing(self, keys: set[str]) -> list[str]:
        """Keys of neither generation; those of the old one become young."""
        out = []
        for key in keys.difference(self.young):
            found = self.old.get(key)
            if found is None:
                out.append(key)
            else:
                self.young[key] = found
        return out

    def put_all(self, keys: list[str], values: list[bytes]) -> None:
        self.young.update(zip(keys, values, strict=True))
        if len(max(keys, key=len)) > CACHE_LENGTH:
            self.brief += [k for k in keys if len(k) > CACHE_LENGTH]


class CachedEncoder:
    """Ids of texts, by an encoder of lists of matches of the pattern; equal matches are encoded once."""

    def __init__(self, pattern: str, encode_matches: Callable[[list[str]], list[bytes]], encode_words: Callable[[list[str]], list[bytes]] | None = None):
        """encode_words, if given, encodes words of letters, each with a space in front of it."""
        self.findall, self.encode_matches = regex.compile(pattern).findall, encode_matches
        self.encode_words = encode_words or (lambda words: encode_matches([" " + w for w in words]))
        self.words, self.matches = _Cache(), _Cache()

    def _encode(self, texts: Iterable[str]) -> dict[str, bytes]:
        parts = {t: self.findall(t) for t in texts}
        new = self.matches.missing({m for found in parts.values() for m in found})
        if new:
            self.matches.put_all(new, self.encode_matches(new))
        known = self.matches.young
        return {t: b"".join([known[m] for m in f]) for t, f in parts.items()}

    def _learn(self, words: list[str]) -> None:
        """Cache what stands behind a space; letters, and letters before a run of marks, are told without the pattern."""
        plain = [w for w in words if w.isalpha()]
        marked, odd = [], []
        if len(plain) < len(words):
            for word in words:
                if not word.isalpha():
                    stem = word.rstrip(MARKS)
                    if stem and stem.isalpha():
                        marked.append((word, stem))
                    else:
                        odd.append(word)
        if any(c >= _SETTLED for c in set("".join(words))):
            odd += [w for w in plain if not _is_word(w)] + [w for w, stem in marked if not _is_word(stem)]
            plain, marked = [w for w in plain if _is_word(w)], [(w, stem) for w, stem in marked if _is_word(stem)]
        if marked:
            plain += self.words.missing({stem for _, stem in marked}.difference(plain))
        if plain:
            self.words.put_all(plain, self.encode_words(plain))
        if marked:
            ends, known = self._encode({w[len(s) :] for w, s in marked}), self.words.young
            self.words.put_all([w for w, _ in marked], [known[s] + ends[w[len(s) :]] for w, s in marked])
        if odd:
            self.words.put_all(odd, list(self._encode([" " + w for w in odd]).values()))

    def raw_many(self, texts: list[str] | pa.Array) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        self.words.turn()
        self.matches.turn()
        column = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        if not len(column):
            return []
        runs = pc.match_substring_regex(column, _RUN)
        split = pc.split_pattern(pc.if_else(runs, "", column), " ")
        ends = split.offsets.to_numpy().astype(np.int64)
        heads = [h if h is not None else t.as_py() for h, t in zip(pc.if_else(runs, None, pc.list_element(split, 0)).to_pylist(), column, strict=True)]
        rest = np.ones(ends[-1] - ends[0], dtype=bool)
        rest[ends[:-1] - ends[0]] = False
        numbered = split.flatten().filter(pa.array(rest)).dictionary_encode()
        different = numbered.dictionary.to_pylist()
        self._learn(self.words.missing(set(different)))
        found = list(map(self.words.young.__getitem__, different))
        sizes = np.fromiter(map(len, found), dtype=np.int32, count=len(found)) // 4
        ids, first = np.frombuffer(b"".join(found), dtype="<u4"), np.cumsum(sizes, dtype=np.int32) - sizes
        at = numbered.indices.to_numpy()
        n = sizes[at]
        behind = np.cumsum(n, dtype=np.int64)
        place = np.repeat(first[at] - (behind - n).astype(np.int32), n)
        place += np.arange(len(place), dtype=np.int32)
        out = ids[place].tobytes()
        del place
        # a text's words end where its share of all words ends
        upto = np.concatenate([[0], behind])[ends - ends[0] - np.arange(len(ends))] * 4
        known = self._encode({h for h in heads if h})
        known[""] = b""
        return [known[h] + out[a:b] for h, a, b in zip(heads, upto[:-1].tolist(), upto[1:].tolist(), strict=True)]

    def raw(self, text: str) -> bytes:
        return self.raw_many([text])[0]
