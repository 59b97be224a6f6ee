"""Burrows-Wheeler transform and common prefixes of a collection, column by column, in sequential files.

Round j puts the suffix of length j of every string among those that are there. The state between
rounds is three files, read and written from front to back in slices: the transform's symbols, the
length of the common prefix of every suffix with the one before it, and, for suffixes that are long
enough to be asked for, which suffix it is. In memory are a slice, a few numbers per symbol, and a
few per string and per kind of symbol. The files live in a folder of the store that driver and
executors share.

A symbol may stand for several bytes. Of a string, the windows of w bytes from its byte 0, w, 2 w, ...
are one string of symbols, those from 1, w + 1, ... another, and so on: together their suffixes are the
suffixes of the bytes, up to less than w bytes at the end, in w times fewer rounds. Common
prefixes are exact in steps of w bytes (``windows``).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyarrow import fs

END = 0xFF  # never a byte of UTF-8
#: Entries of the files handled at once.
SLICE = 1 << 20
#: Bits of an entry's code that hold the suffix's length; longer strings are not taken.
SIZE_BITS = 7
MOST = (1 << SIZE_BITS) - 1
#: Marks, in the file of prefixes, the entries that have a code.
CODED = np.uint8(1 << SIZE_BITS)


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder: a plain path, or any address that pyarrow knows."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


class Files:
    """The files of one collection, in a folder of their own that goes when it is done."""

    def __init__(self, uri: str, end: int = END):
        self.end = end  # the symbol after the last; all others are less
        self.kinds = {"symbol": np.uint8 if end <= 0xFF else np.uint16 if end <= 0xFFFF else np.uint32, "prefix": np.uint8, "code": np.int32}
        self.system, path = store_of(uri)
        self.path = f"{path}/{uuid.uuid4().hex}"
        self.system.create_dir(self.path, recursive=True)
        self.round = 0
        self.coded = False  # whether any entry has a code

    def _name(self, kind: str, k: int) -> str:
        return f"{self.path}/{kind}-{k % 2}"

    def write(self, slices: Iterator[tuple[np.ndarray, ...]]) -> None:
        """The next round's files, from slices of symbols, prefixes and codes."""
        out = [self.system.open_output_stream(self._name(kind, self.round + 1)) for kind in self.kinds]
        for parts in slices:
            for stream, part, kind in zip(out, parts, self.kinds.values(), strict=True):
                stream.write(np.ascontiguousarray(part, kind))
        for stream in out:
            stream.close()
        self.round += 1

    def read(self, *kinds: str) -> Iterator[tuple[np.ndarray, ...]]:
        """Slices of this round's files of the given kinds, symbols and prefixes."""
        types = self.kinds
        streams = [self.system.open_input_stream(self._name(kind, self.round)) for kind in kinds]
        while True:
            parts = [np.frombuffer(s.read(SLICE * types[k]().itemsize), types[k]) for s, k in zip(streams, kinds, strict=True)]
            if not len(parts[0]):
                break
            yield tuple(parts)
        for stream in streams:
            stream.close()

    def codes(self) -> Callable[[int], np.ndarray]:
        """A function that reads the next so many of this round's codes."""
        stream = self.system.open_input_stream(self._name("code", self.round))
        return lambda n: np.frombuffer(stream.read(4 * n), np.int32) if n else np.zeros(0, np.int32)

    def close(self) -> None:
        self.system.delete_dir(self.path)


class _Least:
    """Least of values[first : last + 1] for ranges, from the least of every 2 ** k values in turn."""

    def __init__(self, values: np.ndarray):
        self.tables = [values]

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """No range is empty."""
        if not len(first):
            return np.zeros(0, np.int64)
        level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        for k in range(len(self.tables), int(level.max()) + 1):
            half = 1 << (k - 1)
            self.tables.append(np.minimum(self.tables[-1][:-half], self.tables[-1][half:]))
        # All tables end to end: table k has n - 2 ** k + 1 entries.
        whole = np.concatenate(self.tables)
        begin = np.cumsum([0, *map(len, self.tables)])[level]
        return np.minimum(whole[begin + first], whole[begin + last + 1 - (1 << level)]).astype(np.int64)


def _order(b: np.ndarray) -> np.ndarray:
    """Stable order of symbols, by halves of 16 bits, which numpy sorts by their digits."""
    if b.itemsize <= 2:
        return np.argsort(b, kind="stable")
    by = np.argsort((b & 0xFFFF).astype(np.uint16), kind="stable")
    return by[np.argsort((b >> 16).astype(np.uint16)[by], kind="stable")]


def _places(files: Files, row: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the suffixes one longer than those at ``row`` (ascending) go, and the common prefixes
    that change: (place of each, places of changed entries, their prefixes).

    Suffixes that begin with a symbol stand in the order of its occurrences in the transform, and
    two that follow each other share one symbol more than the least prefix between the two
    occurrences. Occurrences in other slices are known by counts and running least prefixes.
    """
    symbol = np.zeros(len(row), np.int64)
    rank = np.zeros(len(row), np.int64)
    changes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # symbol, rank, prefix
    count = np.zeros(files.end + 1, np.int64)
    since = np.full(files.end + 1, 255, np.int64)  # least prefix after a symbol's last occurrence
    waiting = np.full(files.end + 1, -1, np.int64)  # rank of a symbol's next occurrence, if its prefix changes
    least = np.full(files.end + 1, 255, np.int64)  # least prefix before that so far
    base = 0
    slices = files.read("symbol", "prefix")
    now = next(slices, None)
    while now is not None:
        (b, prefix), now = now, next(slices, None)
        prefix = prefix & ~CODED if files.coded else prefix
        n = len(b)
        lo, hi = np.searchsorted(row, [base, base + n])
        q = row[lo:hi] - base
        by = _order(b)
        here = np.bincount(b, minlength=files.end + 1)
        begin = np.cumsum(here) - here
        a = b[q].astype(np.int64)
        k = np.empty(n, np.int64)  # places of the occurrences q among all, by symbol
        k[by] = np.arange(n)
        k = k[q]
        between = _Least(prefix)
        # Least prefixes from the slice's begin and to its end matter where there are other slices.
        front = np.minimum.accumulate(prefix) if base else prefix
        back = np.minimum.accumulate(prefix[::-1])[::-1] if now is not None else prefix
        if base:
            open_ = np.flatnonzero(waiting >= 0)
            least[open_] = np.minimum(least[open_], np.where(here[open_] > 0, front[by[np.minimum(begin[open_], n - 1)]], front[-1]))
            met = open_[here[open_] > 0]
            changes.append((met, waiting[met], least[met] + 1))
            waiting[met] = -1
        symbol[lo:hi], rank[lo:hi] = a, count[a] + k - begin[a]
        # The occurrence before: in this slice, in an earlier one, or none.
        inner = k > begin[a]
        value = np.zeros(len(q), np.int64)
        value[inner] = between(by[k[inner] - 1] + 1, q[inner]) + 1
        outer = ~inner & (count[a] > 0)
        value[outer] = np.minimum(since[a[outer]], front[q[outer]]) + 1
        changes.append((a, rank[lo:hi], value))
        # The occurrence after.
        inner = k + 1 < begin[a] + here[a]
        value = between(q[inner] + 1, by[k[inner] + 1]) + 1
        changes.append((a[inner], rank[lo:hi][inner] + 1, value))
        if now is not None:
            last = ~inner  # of their symbols in this slice
            waiting[a[last]] = rank[lo:hi][last] + 1
            least[a[last]] = np.where(q[last] + 1 < n, back[np.minimum(q[last] + 1, n - 1)], 255)
            seen = here > 0
            last = by[(begin + here - 1)[seen]]
            since = np.minimum(since, int(back[0]))
            since[seen] = np.where(last + 1 < n, back[np.minimum(last + 1, n - 1)], 255)
        count += here
        base += n
    start = m + np.cumsum(count) - count  # the empty suffixes come first
    at, what, value = (np.concatenate(x) for x in zip(*changes, strict=True))
    return start[symbol] + rank, start[at] + what, value


def _merged(files: Files, place: np.ndarray, symbols: np.ndarray, codes: np.ndarray | None, changed: np.ndarray, value: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Slices of the next round: new entries at ``place`` (ascending), with codes or without, and
    prefixes as changed."""
    before = place - np.arange(len(place))  # old entries before each new one
    base = written = done = 0
    coded = files.codes()
    old = files.read("symbol", "prefix")
    now = next(old, None)
    while now is not None:
        after = next(old, None)
        n = len(now[0])
        upto = int(np.searchsorted(before, base + n)) if after is not None else len(before)
        spot = before[done:upto] - base + np.arange(upto - done)  # of the new entries in what goes out
        kept = np.ones(n + upto - done, bool)
        kept[spot] = False
        symbol, prefix = np.empty(len(kept), now[0].dtype), np.empty(len(kept), np.uint8)
        symbol[kept], prefix[kept] = now
        symbol[spot], prefix[spot] = symbols[done:upto], 0 if codes is None else CODED
        lo, hi = np.searchsorted(changed, [written, written + len(symbol)])
        spot = changed[lo:hi] - written
        prefix[spot] = value[lo:hi] | (prefix[spot] & CODED)
        had = np.flatnonzero(now[1] & CODED) if codes is not None or files.coded else np.zeros(0, np.int64)
        code = coded(len(had))
        if codes is not None:
            code = np.insert(code, np.searchsorted(had, before[done:upto] - base), codes[done:upto])
        yield symbol, prefix, code
        base, written, done, now = base + n, written + len(symbol), upto, after
    files.coded |= codes is not None


def windows(texts: np.ndarray, begin: np.ndarray, length: np.ndarray, width: int, match: int = 0) -> tuple[np.ndarray, int, np.ndarray, np.ndarray]:
    """(symbols, end, begin, length): the window of ``width`` bytes at every byte as a number in the
    windows' order, the number after the last, and the strings of symbols, ``width`` for each of
    the strings texts[begin : begin + length], which lie end to end; those of fewer than ``match``
    symbols are empty."""
    left = np.repeat(begin + length, length) - np.arange(len(texts))  # bytes to the string's end
    symbols, known, done = texts.astype(np.int64), 256, 1
    while done < width:
        more = min(done, width - done)  # a window is two shorter ones, which overlap where they must
        pair = symbols[: max(0, len(texts) - more)] * known + symbols[more:]
        done += more
        within = left[: len(pair)] >= done
        symbols = np.zeros(len(texts), np.int64)
        if done < width and known**2 < 1 << 31:  # few enough to need no new numbers
            symbols[: len(pair)][within], known = pair[within], known**2
        else:
            names, symbols[: len(pair)][within] = np.unique(pair[within], return_inverse=True)
            known = len(names)
    shift = np.arange(width)
    count = np.maximum(length[:, None] - shift, 0) // width
    return symbols, known, (begin[:, None] + shift).ravel(), np.where(count < match, 0, count).ravel()


def build(files: Files, texts: np.ndarray, begin: np.ndarray, length: np.ndarray, match: int, step: int = 1) -> None:
    """Put all suffixes of the strings texts[begin : begin + step * length : step] into the files, in
    order, those of ``match`` symbols or more with codes; suffixes that are equal stand in the order of
    their strings."""
    m = len(begin)
    kind = files.kinds["symbol"]
    if length.max(initial=0) > MOST:
        raise ValueError(f"a string is longer than {MOST} symbols")

    def symbol(i: np.ndarray, j: int) -> np.ndarray:
        """The symbol before the suffix of length j."""
        return np.where(j < length[i], texts[np.maximum(begin[i] + step * (length[i] - 1 - j), 0)], files.end).astype(kind)

    def code(i: np.ndarray, j: int) -> np.ndarray | None:
        return ((i << SIZE_BITS) | j).astype(np.int32) if j >= match else None

    live = np.arange(m)
    none = np.zeros(0, np.int32)
    empty = CODED if match <= 0 else 0
    files.coded = match <= 0
    files.write((symbol(part, 0), np.full(len(part), empty, np.uint8), none if match > 0 else code(part, 0)) for part in (live[a : a + SLICE] for a in range(0, m, SLICE)))
    row = live.copy()
    for j in range(1, int(length.max(initial=0)) + 1):
        keep = length[live] >= j
        live, row = live[keep], row[keep]
        place, changed, value = _places(files, row, m)
        order = np.argsort(place)
        live, row = live[order], place[order]
        order = np.argsort(changed)  # what changes twice gets one value
        files.write(_merged(files, row, symbol(live, j), code(live, j), changed[order], value[order].astype(np.uint8)))


def groups(files: Files, match: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(string, suffix length, group) of the suffixes that share ``match`` symbols with another one,
    by slices; a group is never divided between two slices."""
    held: tuple[np.ndarray, np.ndarray] | None = None
    coded = files.codes()
    for (prefix,) in files.read("prefix"):
        prefix = prefix[(prefix & CODED) != 0] & ~CODED  # suffixes without a code share less
        code = coded(len(prefix))
        if held is not None:
            prefix, code = np.concatenate([held[0], prefix]), np.concatenate([held[1], code])
        new = prefix < match
        last = int(np.flatnonzero(new)[-1]) if new.any() else 0
        held = (prefix[last:], code[last:])
        yield from _grouped(new[:last], code[:last])
    if held is not None:
        yield from _grouped(held[0] < match, held[1])


def _grouped(new: np.ndarray, code: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    if len(new) < 2:
        return
    shared = ~new
    shared[:-1] |= ~new[1:]
    group = np.cumsum(new)
    if shared.any():
        yield (code >> SIZE_BITS)[shared].astype(np.int64), (code & MOST)[shared].astype(np.int64), group[shared]
