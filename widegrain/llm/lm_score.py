"""Language-model scores by prediction by partial matching over bytes.

A text is modelled as its lower-cased words, joined by single spaces, and an end
mark (0xFF, which UTF-8 never uses); the score is the log10 probability of all
that.  The model is a trie of byte contexts of up to ORDER bytes with the counts
of all training texts.  A byte is predicted in its longest known context; what
the context hasn't seen escapes to the next shorter one, with a chance estimated
from the number of different bytes seen (half a count for each), and bytes that
the longer context has seen are excluded there.  Below the empty context all
remaining bytes are equally likely.  Above the trie stand long contexts of the
text itself (LONG bytes): the byte that followed last time is predicted with
the confidence that such a context has earned in the training texts, else it is
excluded.

Texts are read once.  Each block of texts keeps its different grams (ORDER bytes
of context and a byte) with their counts in training texts; also those that are
only asked about.  Grams meet by the last bytes of their contexts: there the
counts of all blocks add up, the part of the trie above the shortest contexts is
whole, and each gram's probability goes back to the blocks that have it, where
the texts wait.  Counts of the shortest contexts (LOW bytes) are a table of at
most 2^24 entries, which every task gets.  Contexts that very many blocks share
are added up and answered in several places each.

Beside it stands an add-one unigram model of words.  Its counts cover all
training words.  Each block of texts keeps a dictionary; dictionaries, and not
words in texts, meet the corpus counts in a join, and come back to their block.

Defined cases: a null text counts as empty and consists of the end alone; a
null doc_id is never held out; repeated rows are learned and scored one by one;
without training texts nothing is known; other columns are ignored; an empty
table gives an empty result.  A very long text is scored in slices, and what its
long contexts saw goes from slice to slice; memory for that grows with the text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, prepare, save, whole_text

ORDER = 5
#: Part of a count that each different byte gives up for the bytes that a context hasn't seen.
GIVEN = 0.33
#: Lengths of the contexts that are looked up in the text itself.
LONG = (16, 12)
END = 0xFF
#: Bytes of the contexts whose counts every task gets.
LOW = 2
#: Words of a block's dictionary; bytes of texts whose grams make a block.
BLOCK_WORDS, BLOCK_BYTES = 200_000, 8 << 20
#: Bytes scored at once, of several texts or of one.
SLICE = 1 << 20
#: Places where grams meet, by the last bytes of their contexts; grams that are added up and answered in one of them at once.
BUCKETS, ENTRIES = 4_096, 1_500_000
_MULT = np.uint64(0x9E3779B97F4A7C15)


def grams_of(raw: bytes) -> np.ndarray:
    """For each byte and the end mark: its ORDER bytes of context and itself, packed."""
    return _packed(np.frombuffer(bytes([END]) * ORDER + raw + bytes([END]), dtype=np.uint8).astype(np.uint64))


def modelled(text: str) -> bytes:
    """What the models see of a text: its words, joined by single spaces."""
    return b" ".join(text.encode("utf-8", "surrogatepass").lower().split())


_PLACE, _SHIFT, _TEXT = np.uint64((1 << 24) - 1), np.uint64(24), np.uint64(0xD6E8FEB86659FD93)


class _Past:
    """Long contexts of a text's slices so far: their keys in order, and the byte that followed each last."""

    def __init__(self):
        self.keys = [np.zeros(0, dtype=np.uint64) for _ in LONG]
        self.said = [np.zeros(0, dtype=np.uint8) for _ in LONG]

    def _add(self, k: int, keys: np.ndarray, said: np.ndarray) -> None:
        self.keys[k], first = np.unique(np.concatenate([keys, self.keys[k]]), return_index=True)
        self.said[k] = np.concatenate([said, self.said[k]])[first]

    def _find(self, k: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the keys are known, what followed those)."""
        if not len(self.keys[k]):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint8)
        at = np.minimum(np.searchsorted(self.keys[k], keys), len(self.keys[k]) - 1)
        found = np.flatnonzero(self.keys[k][at] == keys)
        return found, self.said[k][at[found]]

    def expected(self, symbols: np.ndarray, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """For the places from begin to end: the level of the long context that has occurred before (or -1), and what followed it then."""
        level, said = np.full(end - begin, -1), np.zeros(end - begin, dtype=np.int64)
        lead = min(begin, max(LONG))
        powers = _powers(symbols[begin - lead : end - 1])
        for k, length in enumerate(LONG):
            first = max(begin, length)
            if end <= first:
                continue
            h = _mixed(_hashes(powers, length)[first - length - begin + lead :])
            keys = (h & ~_PLACE) | np.arange(end - first, dtype=np.uint64)
            keys.sort()
            place, keys = (keys & _PLACE).astype(np.int64) + first, keys >> _SHIFT
            again = np.flatnonzero(keys[1:] == keys[:-1])
            fresh = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            known, told = self._find(k, keys[fresh])
            here, says = np.concatenate([place[again + 1], place[fresh[known]]]), np.concatenate([symbols[place[again]], told])
            last = np.flatnonzero(np.append(keys[1:] != keys[:-1], True))
            self._add(k, keys[last], symbols[place[last]])
            new = level[here - begin] < 0
            level[here[new] - begin], said[here[new] - begin] = k, says[new]
        return level, said


def counted(grams: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Different grams in order, and how often each occurs."""
    if weights is None:
        grams = np.sort(grams)
        at = np.flatnonzero(np.append(True, grams[1:] != grams[:-1])) if len(grams) else np.zeros(0, np.int64)
        return grams[at], np.diff(np.append(at, len(grams)))
    order = np.argsort(grams, kind="stable")
    grams, weights = grams[order], weights[order]
    at = np.flatnonzero(np.append(True, grams[1:] != grams[:-1])) if len(grams) else np.zeros(0, np.int64)
    return grams[at], np.add.reduceat(weights, at) if len(grams) else weights


def bucket_of(grams: np.ndarray) -> np.ndarray:
    """Where a gram meets those of other blocks: by the last LOW + 1 bytes of its context."""
    end = (grams >> np.uint64(8)) & np.uint64((1 << 8 * (LOW + 1)) - 1)
    return ((end * _MULT) >> np.uint64(40)) % np.uint64(BUCKETS)


class _Level:
    """Contexts of one length: counts of their symbols, and what is left of the next shorter context's once theirs are excluded."""

    def __init__(self, k: int, grams: np.ndarray, counts: np.ndarray, lower: _Level | None):
        self.k, self.grams, self.counts = k, grams, counts.astype(np.float64)
        context = grams >> np.uint64(8)
        first = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(grams) else np.zeros(0, np.int64)
        self.contexts = context[first]
        self.total = np.add.reduceat(self.counts, first) if len(grams) else np.zeros(0)
        self.kinds = np.diff(np.append(first, len(grams))).astype(np.float64)
        if lower is None:
            return
        mask = np.uint64((1 << 8 * k) - 1)
        found, at = lower.find_gram(grams & mask)
        seen = np.add.reduceat(np.where(found, lower.counts[at], 0), first) if len(grams) else np.zeros(0)
        _, node = lower.find_context(self.contexts & np.uint64((1 << 8 * (k - 1)) - 1))
        self.rest_total = lower.total[node] - seen if len(grams) else np.zeros(0)
        self.rest_kinds = lower.kinds[node] - self.kinds if len(grams) else np.zeros(0)

    @staticmethod
    def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(table):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return table[at] == keys, at

    def find_gram(self, grams: np.ndarray):
        return self._find(self.grams, grams)

    def find_context(self, contexts: np.ndarray):
        return self._find(self.contexts, contexts)


def low_levels(grams: np.ndarray, counts: np.ndarray) -> list[_Level]:
    """The levels of the contexts of up to LOW bytes, from the counts of all grams of that length."""
    tables = {LOW: (grams, counts)}
    for k in range(LOW - 1, -1, -1):
        g, c = tables[k + 1]
        tables[k] = counted(g & np.uint64((1 << 8 * (k + 1)) - 1), c)
    levels: list[_Level] = []
    for k in range(LOW + 1):
        levels.append(_Level(k, *tables[k], levels[-1] if k else None))
    return levels


def short_grams(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grams with contexts of LOW bytes and their counts."""
    return counted(grams & np.uint64((1 << 8 * (LOW + 1)) - 1), counts)


class Ppm:
    """The trie of all contexts that end alike, from the counts of their longest grams; low has the levels below."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, low: list[_Level]):
        tables = {ORDER: (grams, counts)}
        for k in range(ORDER - 1, LOW, -1):
            g, c = tables[k + 1]
            tables[k] = counted(g & np.uint64((1 << 8 * (k + 1)) - 1), c)
        self.levels = list(low)
        for k in range(LOW + 1, ORDER + 1):
            self.levels.append(_Level(k, *tables[k], self.levels[-1]))

    def log10(self, grams: np.ndarray) -> np.ndarray:
        """log10 probabilities by going down the contexts."""
        out = np.zeros(len(grams))
        open_ = np.arange(len(grams))
        above = None  # node of the longer context for each open gram, or -1 where it is unknown
        for k in range(ORDER, -1, -1):
            if not len(open_):
                break
            level, own = self.levels[k], grams[open_] & np.uint64((1 << 8 * (k + 1)) - 1)
            has, node = level.find_context(own >> np.uint64(8))
            seen, at = level.find_gram(own)
            if not len(level.contexts):
                total, kinds = np.zeros(len(own)), np.zeros(len(own))
                count = np.zeros(len(own))
            else:
                total, kinds, count = level.total[node], level.kinds[node], level.counts[at] if len(level.grams) else np.zeros(len(own))
            if above is not None:
                upper = self.levels[k + 1]
                known = above >= 0
                if known.any():
                    total = np.where(known, upper.rest_total[above], total)
                    kinds = np.where(known, upper.rest_kinds[above], kinds)
            usable = has & (total > 0)
            hit = usable & seen
            out[open_[hit]] += np.log10((count[hit] - GIVEN) / total[hit])
            escaped = usable & ~seen
            out[open_[escaped]] += np.log10(GIVEN * kinds[escaped] / total[escaped])
            stay = ~hit
            above = np.where(has, node, -1)[stay]
            open_ = open_[stay]
        if len(open_):
            out[open_] -= np.log10(256 - (self.levels[0].kinds[0] if len(self.levels[0].kinds) else 0))
        return out


class Logs:
    """log10 probabilities of different grams in order; a direct table answers most questions."""

    def __init__(self, grams: np.ndarray, logs: np.ndarray):
        self.grams, self.logs = grams, logs
        self.bits = max(8, int(len(grams) * 2).bit_length())
        self.slot_gram = np.full(1 << self.bits, np.iinfo(np.uint64).max, dtype=np.uint64)
        self.slot_log = np.zeros(1 << self.bits, dtype=np.float32)
        # of grams that share a slot the likeliest is there
        order = np.argsort(logs, kind="stable")
        slot = self._slot(grams[order])
        self.slot_gram[slot], self.slot_log[slot] = grams[order], logs[order]

    def _slot(self, grams: np.ndarray) -> np.ndarray:
        return ((grams * _MULT) >> np.uint64(64 - self.bits)).astype(np.int64)

    def log10(self, grams: np.ndarray) -> np.ndarray:
        slot = self._slot(grams)
        out = self.slot_log[slot].astype(np.float64)
        odd = np.flatnonzero(self.slot_gram[slot] != grams)
        out[odd] = self.logs[np.searchsorted(self.grams, grams[odd])]
        return out


def score_places(grams: np.ndarray, told: np.ndarray, level: np.ndarray, said: np.ndarray, log10, trust: tuple[float, ...]) -> np.ndarray:
    """log10 probabilities of places; told are those whose long context has occurred before, with its level and what followed it."""
    p = log10(grams)
    if len(told):
        hit = (grams[told] & np.uint64(0xFF)).astype(np.int64) == said
        sure = np.array(trust)[level]
        p[told[hit]] = np.log10(sure[hit])
        miss = told[~hit]
        other = 10 ** log10(_other(grams[miss], said[~hit]))
        p[miss] += np.log10(1 - sure[~hit]) - np.log10(np.maximum(1 - other, 1e-9))
    return p


def score_texts(texts: list[bytes], log10, trust: tuple[float, ...]) -> list[float]:
    """log10 probabilities of texts and their ends; log10 has those of grams."""
    out = np.zeros(len(texts))
    for which, grams, level, said, sizes in placed(texts):
        told = np.flatnonzero(level >= 0)
        out[which] += np.add.reduceat(score_places(grams, told, level[told], said[told], log10, trust), np.cumsum(sizes) - sizes)
    return out.tolist()


def score_group(raw: bytes, sizes: np.ndarray, told: np.ndarray, level: np.ndarray, said: np.ndarray, log10, trust: tuple[float, ...]) -> np.ndarray:
    """As score_texts(), for texts one behind the other whose long contexts are known."""
    ends = np.cumsum(sizes)
    if len(sizes) > 1:
        grams, places = _grams_of([raw[e - n : e] for n, e in zip(sizes.tolist(), ends.tolist(), strict=True)])
        return np.add.reduceat(score_places(grams, told, level, said, log10, trust), np.cumsum(places) - places)
    out = 0.0
    for begin, grams in _slices(raw):
        a, b = np.searchsorted(told, (begin, begin + len(grams)))
        out += score_places(grams, told[a:b] - begin, level[a:b], said[a:b], log10, trust).sum()
    return np.array([out])


def _other(grams: np.ndarray, said: np.ndarray) -> np.ndarray:
    """Grams with another last byte."""
    return (grams & ~np.uint64(0xFF)) | said.astype(np.uint64)


def placed(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(which texts, grams, level and said of their places, number of places of each): many short texts, or a slice of a long one, at a time."""
    some, size = [], 0
    for k, raw in enumerate(texts):
        if len(raw) >= SLICE:
            if some:
                yield np.array(some), *_together([texts[i] for i in some])
                some, size = [], 0
            symbols, past = np.frombuffer(raw + bytes([END]), dtype=np.uint8), _Past()
            for begin, grams in _slices(raw):
                yield np.array([k]), grams, *past.expected(symbols, begin, begin + len(grams)), np.array([len(grams)])
            continue
        if some and size + len(raw) > SLICE:
            yield np.array(some), *_together([texts[i] for i in some])
            some, size = [], 0
        some.append(k)
        size += len(raw) + ORDER + 1
    if some:
        yield np.array(some), *_together([texts[i] for i in some])


def _framed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(texts with ORDER end marks in front and one behind, places of their bytes and ends in that, number of places of each)."""
    lead, end = bytes([END]) * ORDER, bytes([END])
    data = np.frombuffer(b"".join([x for raw in texts for x in (lead, raw, end)]), dtype=np.uint8)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    place = np.arange(int(sizes.sum())) + np.repeat(ORDER * np.arange(1, len(texts) + 1), sizes)
    return data, place, sizes


def _grams_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Grams of the places of several texts, and the number of places of each."""
    data, place, sizes = _framed(texts)
    return _packed(data.astype(np.uint64))[place - ORDER], sizes


def _together(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Grams, level and said of the places of several texts, and the number of places of each."""
    data, place, sizes = _framed(texts)
    grams = _packed(data.astype(np.uint64))[place - ORDER]
    level, said = np.full(len(place), -1), np.zeros(len(place), dtype=np.int64)
    nth = np.arange(len(place)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    powers = _powers(data)
    # equal contexts of different texts are different
    of = np.repeat(np.arange(1, len(texts) + 1, dtype=np.uint64) * _TEXT, sizes)
    for k, length in enumerate(LONG):
        here = np.flatnonzero(nth >= length)
        if len(here) < 2:
            continue
        hashes = _mixed(_hashes(powers, length)[place[here] - length] + of[here])
        keys = (hashes & ~_PLACE) | np.arange(len(here), dtype=np.uint64)
        keys.sort()
        same = np.flatnonzero((keys[1:] ^ keys[:-1]) <= _PLACE)
        now, before = (keys[same + 1] & _PLACE).astype(np.int64), (keys[same] & _PLACE).astype(np.int64)
        alike = hashes[now] == hashes[before]
        here, before = here[now[alike]], here[before[alike]]
        new = level[here] < 0
        level[here[new]], said[here[new]] = k, data[place[before[new]]]
    return grams, level, said, sizes


def _powers(data: np.ndarray) -> dict[int, np.ndarray]:
    """Hashes of all strings of 1, 2, 4, .. bytes, up to the length of the long contexts."""
    powers, width = {1: data.astype(np.uint64) + np.uint64(1)}, 1
    while 2 * width <= max(LONG):
        h, factor = powers[width], np.uint64(pow(0x9E3779B97F4A7C15, width, 1 << 64))
        powers[2 * width] = h[:-width] * factor + h[width:] if len(h) > width else h[:0]
        width *= 2
    return powers


def _hashes(powers: dict[int, np.ndarray], length: int) -> np.ndarray:
    """Hashes of all strings of a length."""
    parts = [w for w in sorted(powers, reverse=True) if length & w]
    n, done, h = len(powers[1]) - length + 1, 0, None
    for w in parts:
        part = powers[w][done : done + n]
        h = part if h is None else h * np.uint64(pow(0x9E3779B97F4A7C15, w, 1 << 64)) + part
        done += w
    return h


def _mixed(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> np.uint64(29))) * _MULT


def _slices(raw: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """(first place, grams) of a text and its end, SLICE places at a time."""
    symbols = np.frombuffer(raw + bytes([END]), dtype=np.uint8)
    for begin in range(0, len(symbols), SLICE):
        lead = raw[begin - ORDER : begin] if begin else bytes([END]) * ORDER
        yield begin, _packed(np.concatenate([np.frombuffer(lead, dtype=np.uint8), symbols[begin : begin + SLICE]]).astype(np.uint64))


def _packed(data: np.ndarray) -> np.ndarray:
    n = len(data) - ORDER
    out = np.zeros(n, dtype=np.uint64)
    for k in range(ORDER + 1):
        out = (out << np.uint64(8)) | data[k : k + n]
    return out


GATHERED = "kind int, block long, texts_block long, row long, doc_id long, held_out boolean, n_tokens long, payload binary, raw binary, token binary, number long, n long"
_KINDS = pa.schema(
    [("kind", pa.int32()), ("block", pa.int64()), ("texts_block", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("payload", pa.binary()), ("raw", pa.binary()), ("token", pa.binary()), ("number", pa.int64()), ("n", pa.int64())]
)
#: What a gathered row is: a document; some texts of a block; a word of a block's dictionary; a block's grams of one bucket; a count of a short gram; a count of right or wrong long contexts.
DOC, TEXT, WORD, GRAM, SHORT, TRUST = range(6)


def _rows(size: int, /, **cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cols[f.name], type=f.type) if f.name in cols else pa.nulls(size, f.type) for f in _KINDS], schema=_KINDS)


def _bytes6(grams: np.ndarray) -> np.ndarray:
    """Grams as six bytes each."""
    return np.ascontiguousarray(grams.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : ORDER + 1])


def _from6(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // (ORDER + 1), 8), dtype=np.uint8)
    out[:, : ORDER + 1] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, ORDER + 1)
    return out.view("<u8").ravel().astype(np.uint64)


def by_bucket(grams: np.ndarray) -> tuple[np.ndarray, Iterator[tuple[int, int, int]]]:
    """(order by bucket, (bucket, first, last) of the grams in that order)."""
    if not len(grams):
        return np.zeros(0, np.int64), iter(())
    buckets = bucket_of(grams)
    order = np.argsort(buckets, kind="stable")
    buckets = buckets[order]
    edge = np.flatnonzero(np.append(True, buckets[1:] != buckets[:-1]))
    return order, zip(buckets[edge].tolist(), edge.tolist(), [*edge[1:].tolist(), len(grams)], strict=True)


class _Grams:
    """The grams of a block of texts."""

    def __init__(self):
        self.learned: list[tuple[np.ndarray, np.ndarray]] = []
        self.held: list[np.ndarray] = []
        self.only: list[np.ndarray] = []
        self.places = self.waiting = 0

    def add(self, grams: np.ndarray, learn: np.ndarray, more: np.ndarray) -> None:
        """learn tells which grams are counted; the others, and more, are asked about."""
        self.held.append(grams[learn])
        self.only += [grams[~learn], more]
        self.places += len(grams)
        self.waiting += len(grams)
        if self.waiting > 2 * SLICE:
            self.settle()

    def settle(self) -> None:
        if self.held:
            self.learned.append(counted(np.concatenate(self.held)))
            self.learned = [counted(np.concatenate([g for g, _ in self.learned]), np.concatenate([c for _, c in self.learned]))]
        if self.only:
            self.only = [np.unique(np.concatenate(self.only))]
        self.held, self.waiting = [], 0

    def rows(self, block: int) -> Iterator[pa.RecordBatch]:
        """A row for each bucket, and one for each short gram."""
        self.settle()
        grams, counts = self.learned[0] if self.learned else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        short, times = short_grams(grams, counts)
        for k in range(0, len(short), 20_000):
            m = len(short[k : k + 20_000])
            yield _rows(m, kind=[SHORT] * m, number=short[k : k + m].view(np.int64), n=times[k : k + m])
        only = np.setdiff1d(self.only[0], grams, assume_unique=True) if self.only else grams[:0]
        grams, counts = np.concatenate([grams, only]), np.concatenate([counts, np.zeros(len(only), np.int64)])
        order, parts = by_bucket(grams)
        packed, counts = _bytes6(grams[order]), counts[order].astype("<u4")
        some: list[tuple] = []
        for bucket, a, b in parts:
            some.append((bucket, packed[a:b].tobytes(), counts[a:b].tobytes(), b - a))
            if len(some) == 1_024:
                yield self._made(block, some)
                some = []
        if some:
            yield self._made(block, some)

    @staticmethod
    def _made(block: int, some: list[tuple]) -> pa.RecordBatch:
        buckets, payloads, raws, ns = zip(*some, strict=True)
        m = len(some)
        return _rows(m, kind=[GRAM] * m, texts_block=[block] * m, number=buckets, payload=payloads, raw=raws, n=ns)


class _Words:
    """A block's dictionary, with the counts of its words in training texts."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.counts = np.zeros(BLOCK_WORDS, dtype=np.int64)

    def tallies(self, texts: list[bytes], learn: np.ndarray) -> tuple[list[int], list[bytes]]:
        """Of each text the number of its words, and its different words and how often it has them, compressed."""
        split = pc.split_pattern(pa.array(texts, pa.binary()), " ")
        sizes = np.diff(split.offsets.to_numpy().astype(np.int64))
        coded = split.flatten().dictionary_encode()
        different, number = coded.dictionary.to_pylist(), self.number
        for w in different:
            if w not in number:
                number[w] = len(number)
        if len(number) > len(self.counts):  # more words at once than a block has room for
            self.counts = np.concatenate([self.counts, np.zeros(len(number), dtype=np.int64)])
        ids = np.fromiter(map(number.__getitem__, different), dtype=np.int64, count=len(different))[coded.indices.to_numpy()]
        empty = np.array([not t for t in texts])
        of = np.repeat(np.arange(len(texts)), sizes)
        words = ~empty[of]
        keys = np.sort((of[words] << 32) | ids[words])
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        times, keys = np.diff(np.append(first, len(keys))), keys[first]
        of, ids = keys >> 32, keys & 0xFFFFFFFF
        np.add.at(self.counts, ids[learn[of]], times[learn[of]])
        ends = np.searchsorted(of, np.arange(len(texts)), side="right").tolist()
        made = [zlib.compress(np.diff(ids[a:b], prepend=0).astype("<u4").tobytes() + times[a:b].astype("<u4").tobytes(), 1) for a, b in zip([0, *ends], ends, strict=False)]
        return np.where(empty, 0, sizes).tolist(), made

    def rows(self, block: int) -> Iterator[pa.RecordBatch]:
        names = list(self.number)
        for k in range(0, len(names), 20_000):
            some = names[k : k + 20_000]
            m = len(some)
            yield _rows(m, kind=[WORD] * m, block=[block] * m, token=some, number=np.arange(k, k + m), n=self.counts[k : k + m])


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of texts: their words as numbers of a block's dictionary; the dictionaries; the grams of blocks, with counts in training texts."""
    part = TaskContext.get().partitionId()
    block, words = part << 24, _Words()
    texts_block, own = part << 24, _Grams()
    trust = np.zeros((len(LONG), 2), dtype=np.int64)

    def group(some):
        nonlocal block, words, texts_block, own
        rows, ids, out, texts = (list(c) for c in zip(*some, strict=True))
        learn = ~np.array(out)
        n, payloads = words.tallies(texts, learn)
        yield _rows(len(some), kind=[DOC] * len(some), block=[block] * len(some), row=rows, doc_id=ids, held_out=out, n_tokens=[x + 1 for x in n], payload=payloads)
        if len(words.number) >= BLOCK_WORDS:
            yield from words.rows(block)
            block, words = block + 1, _Words()
        known, at = [], 0
        for which, grams, level, said, sizes in placed(texts):
            told = np.flatnonzero(level >= 0)
            right = (grams[told] & np.uint64(0xFF)).astype(np.int64) == said[told]
            learned = np.repeat(learn[which], sizes)
            used = learned[told]
            trust[:] += np.bincount(2 * level[told][used] + right[used], minlength=trust.size).reshape(trust.shape)
            own.add(grams, learned, _other(grams[told[~right]], said[told[~right]]))
            known.append((told + at, level[told], said[told]))
            at += len(grams)
        told, level, said = (np.concatenate(x) for x in zip(*known, strict=True))
        sizes = np.fromiter(map(len, texts), dtype="<i8", count=len(texts))
        payload = np.concatenate([np.array(rows, dtype="<i8"), sizes]).tobytes()
        contexts = np.diff(told, prepend=0).astype("<u4").tobytes() + level.astype(np.uint8).tobytes() + said.astype(np.uint8).tobytes()
        raw = pa.compress(b"".join(texts), codec="zstd", asbytes=True)
        yield _rows(1, kind=[TEXT], texts_block=[texts_block], payload=[payload], raw=[raw], token=[pa.compress(contexts, codec="zstd", asbytes=True)], n=[len(told)])
        if own.places >= BLOCK_BYTES:
            yield from own.rows(texts_block)
            texts_block, own = texts_block + 1, _Grams()

    for b in batches:
        some, size = [], 0
        for row, doc_id, out, text in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
            raw = modelled(text)
            if some and size + len(raw) > SLICE // 2:  # a long text makes a group of its own
                yield from group(some)
                some, size = [], 0
            some.append((row, doc_id, out, raw))
            size += len(raw)
        if some:
            yield from group(some)
    yield from words.rows(block)
    yield from own.rows(texts_block)
    yield _rows(trust.size, kind=[TRUST] * trust.size, number=np.arange(trust.size), n=trust.ravel())


def _base(n: int, v: int, ends: int):
    """Rows sorted by (block, kind): a block's dictionary with corpus counts, then its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, numbers, counts, table = None, [], [], None
        for b in batches:
            blocks, kinds = b.column("block").to_numpy(), b.column("kind").to_numpy()
            number, c = b.column("number").to_numpy(zero_copy_only=False), b.column("c").to_numpy(zero_copy_only=False)
            edge = np.flatnonzero(np.append(True, (blocks[1:] != blocks[:-1]) | (kinds[1:] != kinds[:-1])))
            out: list[tuple] = []
            for a, z in zip(edge, np.append(edge[1:], len(blocks)), strict=True):
                if blocks[a] != at:
                    at, numbers, counts, table = blocks[a], [], [], None
                if kinds[a] == 0:
                    numbers.append(number[a:z])
                    counts.append(c[a:z])
                    continue
                if table is None:
                    table = np.zeros(int(max((x.max() for x in numbers), default=-1)) + 1)
                    for x, y in zip(numbers, counts, strict=True):
                        table[x.astype(np.int64)] = y
                    logs = np.log10((table + 1) / (n + v + 1))
                for row, payload in zip(b.column("row").slice(a, z - a).to_pylist(), b.column("payload").slice(a, z - a).to_pylist(), strict=True):
                    raw = np.frombuffer(zlib.decompress(payload), dtype="<u4").astype(np.int64)
                    ids, times = np.cumsum(raw[: len(raw) // 2]), raw[len(raw) // 2 :]
                    out.append((row, int(times[table[ids] > 0].sum()) + (ends > 0), float((times * logs[ids]).sum() + np.log10((ends + 1) / (n + v + 1)))))
            cols = list(zip(*out, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["row", "n_known", "base_score"])

    return run


ANSWERS = "texts_block long, grams binary, logs binary"
_ANSWERS = pa.schema([("texts_block", pa.int64()), ("grams", pa.binary()), ("logs", pa.binary())])
COUNTS = "bucket long, grams binary, counts binary"
_COUNTS = pa.schema([("bucket", pa.int64()), ("grams", pa.binary()), ("counts", pa.binary())])
LOGS = "bucket long, grams binary, logs binary"
_LOGS = pa.schema([("bucket", pa.int64()), ("grams", pa.binary()), ("logs", pa.binary())])


def _columns(b: pa.RecordBatch, *names: str) -> zip:
    return zip(*(b.column(k).to_pylist() for k in names), strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows with two binary values at their end, in batches of bounded size."""
    some, n = [], 0
    for row in rows:
        some.append(row)
        n += len(row[-1]) + len(row[-2])
        if len(some) == 1_024 or n > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)
            some, n = [], 0
    if some:
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)


def _known(low, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """log10 probabilities of grams, in order, all of whose counts are given."""
    learned = counts > 0
    return Ppm(grams[learned], counts[learned], low).log10(grams)


def _settle(short):
    """Rows sorted by bucket, all of a bucket's here: counts are added up and each block's grams answered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = low_levels(*short.value)

        def answers(held):
            every = [_from6(g) for _, _, g, _ in held]
            grams, counts = counted(np.concatenate(every), np.concatenate([np.frombuffer(c, dtype="<u4") for *_, c in held]).astype(np.int64))
            logs = _known(low, grams, counts).astype("<f4")
            found = logs[np.searchsorted(grams, np.concatenate(every))]
            ends = np.cumsum([len(g) for g in every]).tolist()
            for (_, block, g, _), a, b in zip(held, [0, *ends], ends, strict=False):
                yield block, g, found[a:b].tobytes()

        def rows():
            held, n = [], 0
            for b in batches:
                for row in _columns(b, "bucket", "texts_block", "grams", "counts"):
                    if n > ENTRIES and row[0] != held[-1][0]:
                        yield from answers(held)
                        held, n = [], 0
                    held.append(row)
                    n += len(row[3]) // 4
            if held:
                yield from answers(held)

        yield from _batches(rows(), _ANSWERS)

    return run


def _added(batches: Iterator[pa.RecordBatch], done) -> Iterator[tuple]:
    """Rows sorted by bucket: done(bucket, grams, counts) of the sums of each; what is held is added up again and again."""
    at, held, n = None, [], 0

    def add():
        return [counted(np.concatenate([g for g, _ in held]), np.concatenate([c for _, c in held]))]

    for b in batches:
        for bucket, g, c in _columns(b, "bucket", "grams", "counts"):
            if held and bucket != at:
                yield from done(at, *add()[0])
                held, n = [], 0
            at = bucket
            held.append((_from6(g), np.frombuffer(c, dtype="<u8" if len(c) * 6 == len(g) * 8 else "<u4").astype(np.int64)))
            n += len(held[-1][0])
            if n > max(ENTRIES, 2 * len(held[0][0])):
                held = add()
                n = len(held[0][0])
    if held:
        yield from done(at, *add()[0])


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def done(bucket, grams, counts):
        for k in range(0, len(grams), 200_000):
            yield bucket, _bytes6(grams[k : k + 200_000]).tobytes(), counts[k : k + 200_000].astype("<u8").tobytes()

    yield from _batches(_added(batches, done), _COUNTS)


def _model(short):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = low_levels(*short.value)

        def done(bucket, grams, counts):
            logs = _known(low, grams, counts).astype("<f4")
            for k in range(0, len(grams), 200_000):
                yield bucket, _bytes6(grams[k : k + 200_000]).tobytes(), logs[k : k + 200_000].tobytes()

        yield from _batches(_added(batches, done), _LOGS)

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket, salt and kind: the bucket's grams with their logs, then grams of blocks."""

    def rows():
        at, known, grams, logs = None, [], None, None
        for b in batches:
            for *here, kind, block, g, x in _columns(b, "bucket", "salt", "kind", "texts_block", "grams", "logs"):
                if here != at:
                    at, known, grams = here, [], None
                if not kind:
                    known.append((_from6(g), np.frombuffer(x, dtype="<f4")))
                    continue
                if grams is None:
                    grams, logs = (np.concatenate(v) for v in zip(*known, strict=True))
                    order = np.argsort(grams)
                    grams, logs = grams[order], logs[order]
                yield block, g, logs[np.searchsorted(grams, _from6(g))].tobytes()

    yield from _batches(rows(), _ANSWERS)


def _score(trust: tuple[float, ...]):
    """Rows sorted by (texts_block, kind): a block's grams with their logs, then its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, known, table = None, [], None
        for b in batches:
            blocks, kinds = b.column("texts_block").to_numpy(), b.column("kind").to_numpy()
            edge = np.flatnonzero(np.append(True, (blocks[1:] != blocks[:-1]) | (kinds[1:] != kinds[:-1])))
            out: list[list] = [[], []]
            for a, z in zip(edge.tolist(), [*edge[1:].tolist(), len(blocks)], strict=True):
                if blocks[a] != at:
                    at, known, table = blocks[a], [], None
                x, y = (b.column(c).slice(a, z - a).to_pylist() for c in ("x", "y"))
                if not kinds[a]:
                    known += [(_from6(g), np.frombuffer(v, dtype="<f4")) for g, v in zip(x, y, strict=True)]
                    continue
                if table is None:
                    grams, logs = (np.concatenate(v) for v in zip(*known, strict=True))
                    order = np.argsort(grams)
                    known, table = [], Logs(grams[order], logs[order])
                for payload, raw, contexts, n in zip(x, y, b.column("z").slice(a, z - a).to_pylist(), b.column("n").slice(a, z - a).to_pylist(), strict=True):
                    rows, sizes = np.frombuffer(payload, dtype="<i8").reshape(2, -1)
                    whole = pa.decompress(raw, decompressed_size=int(sizes.sum()), codec="zstd", asbytes=True)
                    known = pa.decompress(contexts, decompressed_size=6 * n, codec="zstd", asbytes=True)
                    told = np.cumsum(np.frombuffer(known, dtype="<u4", count=n), dtype=np.int64)
                    level, said = np.frombuffer(known, dtype=np.uint8, offset=4 * n).reshape(2, n).astype(np.int64)
                    out[0] += rows.tolist()
                    out[1] += score_group(whole, sizes, told, level, said, table.log10, trust).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.float64())], names=["at", "score"])

    return run


def _answers(gathered: DataFrame, short) -> DataFrame:
    """log10 probabilities of all grams of all blocks."""
    spark = gathered.sparkSession
    rows = gathered.where(F.col("kind") == GRAM).select(F.col("number").alias("bucket"), "texts_block", F.col("payload").alias("grams"), F.col("raw").alias("counts"), "n")
    # one row for each bucket
    sizes = rows.groupBy("bucket").agg(F.ceil(F.sum("n") / ENTRIES).alias("salts"))
    crowded = sizes.where("salts > 1")
    n = partitions(spark)
    if crowded.isEmpty():
        return rows.drop("n").repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_settle(short), ANSWERS)
    plain = rows.join(F.broadcast(crowded), "bucket", "left_anti").drop("n").repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_settle(short), ANSWERS)
    many = rows.drop("n").join(F.broadcast(crowded), "bucket").withColumn("salt", F.pmod(F.xxhash64("texts_block"), F.col("salts")))
    added = many.select("bucket", "salt", "grams", "counts").repartition(n, "bucket", "salt").sortWithinPartitions("bucket").mapInArrow(_add_up, COUNTS)
    model = save(added.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_model(short), LOGS), "crowded")
    beside = model.join(F.broadcast(crowded), "bucket").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    beside = beside.select("bucket", "salt", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("texts_block"), "grams", "logs")
    asking = many.select("bucket", "salt", F.lit(1).alias("kind"), "texts_block", "grams", F.lit(None).cast("binary").alias("logs"))
    both = beside.unionByName(asking).repartition(n, "bucket", "salt").sortWithinPartitions("bucket", "salt", "kind")
    return plain.unionByName(both.mapInArrow(_answer, ANSWERS))


def score_documents(docs: DataFrame, held_out) -> DataFrame:
    """Scores of all texts by models of those for which the column held_out is false.

    Broadcast are the counts of short grams (2^24 at most, which the driver
    sees) and which buckets are crowded (BUCKETS at most)."""
    spark = docs.sparkSession
    prepare(spark)
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), whole_text().alias("text"))
    gathered = save(texts.mapInArrow(_gather, GATHERED), "gathered")
    rows = gathered.where(F.col("kind") == DOC).select("block", "row", "doc_id", "held_out", "n_tokens", "payload")
    ends = rows.where("NOT held_out").count()

    # words
    entries = gathered.where(F.col("kind") == WORD).select("block", "token", "number", "n")
    known = save(entries.groupBy("token").agg(F.sum("n").alias("c")).where("c > 0"), "words")
    sums = known.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = (sums["n"] or 0) + ends, sums["v"] + (ends > 0)
    back = entries.join(known, "token", "left").select("block", F.lit(0).alias("kind"), "number", F.coalesce("c", F.lit(0).cast("long")).alias("c"), F.lit(None).cast("long").alias("row"), F.lit(None).cast("binary").alias("payload"))
    texts_of = rows.select("block", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("number"), F.lit(0).cast("long").alias("c"), "row", "payload")
    base = back.unionByName(texts_of).repartition(partitions(spark), "block").sortWithinPartitions("block", "kind").mapInArrow(_base(n, v, ends), "row long, n_known long, base_score double")
    base = save(base, "base")

    # bytes
    told = {r["number"]: r["n"] for r in gathered.where(F.col("kind") == TRUST).groupBy("number").agg(F.sum("n").alias("n")).collect()}
    trust = tuple((told.get(2 * k + 1, 0) + 1) / (told.get(2 * k, 0) + told.get(2 * k + 1, 0) + 2) for k in range(len(LONG)))
    short = gathered.where(F.col("kind") == SHORT).groupBy("number").agg(F.sum("n").alias("n")).toArrow()
    order = np.argsort(short.column("number").to_numpy())
    counts = spark.sparkContext.broadcast((short.column("number").to_numpy()[order].view(np.uint64), short.column("n").to_numpy()[order]))
    answers = _answers(gathered, counts).select("texts_block", F.lit(0).alias("kind"), F.col("grams").alias("x"), F.col("logs").alias("y"), F.lit(None).cast("binary").alias("z"), F.lit(None).cast("long").alias("n"))
    waiting = gathered.where(F.col("kind") == TEXT).select("texts_block", F.lit(1).alias("kind"), F.col("payload").alias("x"), F.col("raw").alias("y"), F.col("token").alias("z"), "n")
    beside = answers.unionByName(waiting).repartition(partitions(spark), "texts_block").sortWithinPartitions("texts_block", "kind")
    scores = beside.mapInArrow(_score(trust), "at long, score double")
    out = rows.select("row", "doc_id", "held_out", "n_tokens").join(base, "row").join(scores, F.col("row") == F.col("at"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
