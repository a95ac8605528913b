"""Suffix arrays with common-prefix values by induced sorting through disk-backed bucket queues.

A text's suffixes are L-type (greater than the suffix behind them) or S-type; an S-type suffix
behind an L-type one is a seed (S*). Sorted seeds induce the order of all L-type suffixes in one
ascending sweep over the suffixes in order, and those of all S-type suffixes in one descending
sweep: the suffix one place to the left of the suffix at hand goes to the queue of its first
letter. The queues are a priority queue over (first letter, order of arrival), whose entries
are tuples of position and common-prefix value. Sweeps work on runs of tuples, as arrays; what
the queues hold beyond `room` tuples lies on disk, in the folder they are given.

Common-prefix values are carried along: two neighbours in a queue share one letter more than
their inducers do, which is the least value in the stream between those two; at the border of
the L- and S-type suffixes of one letter it is the shorter of the two runs of that letter.

Seeds are sorted by recursion on a text of names: a first induction, without common-prefix
values, sorts the substrings between seeds, which get their ranks as names. The reduced text's
alphabet is too large for arrays by letter to pay, so there the recursion ends and ranks of
1, 2, 4, ... names are doubled. Order and values are exact up to `cap` letters, and values are
cut off there: suffixes that share `cap` letters or more stand together, in any order.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np

Tuples = tuple[np.ndarray, np.ndarray]  # positions, common-prefix values


class BucketQueues:
    """First-in, first-out queues of tuples by letter. With a folder, at most about `room` tuples stay in memory: beyond it the letter with most of them goes to a file, as one run behind its earlier ones."""

    def __init__(self, folder: str | None = None, room: int = 1 << 24):
        self.folder, self.room, self.held = folder, room, 0
        self.queues: dict[int, deque] = defaultdict(deque)
        self.sizes: dict[int, int] = defaultdict(int)  # tuples in memory, by letter
        self.written = 0

    def push(self, letter: int, positions: np.ndarray, values: np.ndarray) -> None:
        self.queues[letter].append((positions, values))
        self.sizes[letter] += len(positions)
        self.held += len(positions)
        while self.folder is not None and self.held > self.room:
            most = max(self.sizes, key=self.sizes.__getitem__)
            paths, taken = self._in_memory(most)
            self.queues[most] = deque([*paths, self._spill(*taken)])

    def _in_memory(self, letter: int) -> tuple[list[str], Tuples]:
        """Take a letter's runs that are in memory, as one; the files before them."""
        queue = self.queues[letter]
        paths = [x for x in queue if isinstance(x, str)]
        taken = [x for x in queue if not isinstance(x, str)]
        queue.clear()
        self.held -= self.sizes[letter]
        self.sizes[letter] = 0
        return paths, taken[0] if len(taken) == 1 else (np.concatenate([t[0] for t in taken]), np.concatenate([t[1] for t in taken]))

    def runs(self, letter: int) -> Iterator[Tuples]:
        """Take the letter's runs in order of arrival, those that arrive meanwhile too; runs in memory are taken together."""
        while queue := self.queues[letter]:
            if isinstance(queue[0], str):
                yield self._load(queue.popleft())
            else:
                yield self._in_memory(letter)[1]

    def _open(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.folder) if "://" in self.folder or self.folder.startswith("file:") else (fs.LocalFileSystem(), self.folder)

    def _spill(self, positions: np.ndarray, values: np.ndarray) -> str:
        system, root = self._open()
        system.create_dir(root, recursive=True)
        path = f"{root}/run-{self.written:08d}"
        with system.open_output_stream(path) as out:
            out.write(np.array([len(positions)], dtype=np.int64).tobytes() + positions.tobytes() + values.tobytes())
        self.written += 1
        return path

    def _load(self, path: str) -> Tuples:
        system, _ = self._open()
        with system.open_input_stream(path) as stream:
            data = stream.read()
        system.delete_file(path)
        count = int(np.frombuffer(data, np.int64, 1)[0])
        return np.frombuffer(data, np.int32, count, 8), np.frombuffer(data, np.int32, count, 8 + 4 * count)

    def close(self) -> None:
        if self.written:
            system, root = self._open()
            system.delete_dir(root)


def _range_least(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """min(values[b:e]) of each range (none empty)."""
    length = end - begin
    level = np.frexp(length.astype(np.float64))[1] - 1
    out = np.empty(len(begin), dtype=values.dtype)
    table, step = values, 0
    for now in range(int(level.max(initial=0)) + 1):
        if now:
            step = 1 << (now - 1)
            table = np.minimum(table[:-step], table[step:])
        at = np.flatnonzero(level == now)
        if len(at):
            out[at] = np.minimum(table[begin[at]], table[end[at] - (1 << now)])
    return out


class Sorter:
    """text: letters from 0 on, the last one 0 and the only 0."""

    def __init__(self, text: np.ndarray, cap: int, folder: str | None = None, room: int = 1 << 24):
        self.text, self.cap, self.folder, self.room = text, cap, folder, room
        count = len(text)
        change = np.flatnonzero(text[1:] != text[:-1])
        run_end = np.append(change, count - 1)  # last place of each run of one letter
        which = np.zeros(count, dtype=np.int32)
        which[change + 1] = 1
        which = np.cumsum(which, dtype=np.int32)
        rises = np.append(text[change] < text[change + 1], True)
        self.small = rises[which]
        self.run = np.minimum(run_end[which] - np.arange(count) + 1, cap).astype(np.int32)
        self.seeds = (np.flatnonzero(self.small[1:] & ~self.small[:-1]) + 1).astype(np.int32)

    def induce(self, seeds: np.ndarray, values: np.ndarray, carry: bool) -> Iterator[Tuples]:
        """From sorted seeds, the stream of all suffixes in descending order: runs of (positions, value with the suffix given before)."""
        letters = int(self.text.max()) + 1
        queues = BucketQueues(self.folder and f"{self.folder}/up", self.room)
        kept = BucketQueues(self.folder and f"{self.folder}/kept", self.room)
        bounds = np.searchsorted(self.text[seeds], np.arange(letters + 1))
        try:
            self._sweep(range(letters), queues, kept, seeds, values, bounds, carry)
            queues.close()
            queues = BucketQueues(self.folder and f"{self.folder}/down", self.room)
            yield from self._descend(range(letters - 1, -1, -1), queues, kept, carry)
        finally:
            queues.close()
            kept.close()

    def _pass_on(self, positions: np.ndarray, stream: np.ndarray, want_small: bool, queues: BucketQueues, least: np.ndarray | None) -> None:
        """Queue what a run of the stream induces; least: for each letter, the least value since its last arrival."""
        before = positions - 1
        use = np.flatnonzero((positions > 0) & (self.small[before] == want_small))
        place = before[use]
        letter = self.text[place]
        if not len(use):
            if least is not None:
                np.minimum(least, stream.min(), out=least)
            return
        order = np.argsort(letter, kind="stable")
        letter, place, at = letter[order], place[order], use[order]
        starts = np.flatnonzero(np.append(True, letter[1:] != letter[:-1]))
        if least is None:
            value = np.zeros(len(place), dtype=np.int32)
        else:
            begin = np.append(0, at[:-1] + 1)
            begin[starts] = 0
            value = _range_least(stream, begin, at + 1)
            value[starts] = np.minimum(value[starts], least[letter[starts]])
            value = np.minimum(value + 1, self.cap).astype(np.int32)
            np.minimum(least, stream.min(), out=least)
            last = at[np.append(starts[1:], len(letter)) - 1] + 1
            tail = np.append(np.minimum.accumulate(stream[::-1])[::-1], self.cap)
            least[letter[starts]] = tail[last]
        place = place.astype(np.int32)
        for a, b in zip(starts.tolist(), np.append(starts[1:], len(letter)).tolist(), strict=True):
            queues.push(int(letter[a]), place[a:b], value[a:b])

    def _sweep(self, letters, queues: BucketQueues, kept: BucketQueues, seeds: np.ndarray, values: np.ndarray, bounds: np.ndarray, carry: bool) -> None:
        least = np.zeros(len(bounds), dtype=np.int32) if carry else None
        for c in letters:
            last = -1
            for positions, value in queues.runs(c):
                value = value.copy()
                if last < 0:
                    value[0] = 0
                last = int(positions[-1])
                kept.push(c, positions, value)
                self._pass_on(positions, value, False, queues, least)
            a, b = bounds[c], bounds[c + 1]
            if a < b:
                positions, value = seeds[a:b], values[a:b].copy()
                value[0] = min(self.run[last], self.run[positions[0]]) if last >= 0 else 0
                self._pass_on(positions, value, False, queues, least)

    def _descend(self, letters, queues: BucketQueues, kept: BucketQueues, carry: bool) -> Iterator[Tuples]:
        least = np.zeros(len(letters) + 1, dtype=np.int32) if carry else None
        for c in letters:
            last = -1
            for positions, value in queues.runs(c):
                value = value.copy()
                if last < 0:
                    value[0] = 0
                last = int(positions[-1])
                yield positions, value
                self._pass_on(positions, value, True, queues, least)
            large = list(kept.runs(c))
            if c == 0:  # the text's end, an S-type suffix that nothing induces
                positions, value = np.array([len(self.text) - 1], dtype=np.int32), np.zeros(1, dtype=np.int32)
                yield positions, value
                self._pass_on(positions, value, True, queues, least)
            for k in range(len(large) - 1, -1, -1):
                positions = large[k][0][::-1]
                # a value belongs to the pair of a suffix and its lower neighbour, which comes next now
                upper = large[k + 1][1][0] if k + 1 < len(large) else (min(self.run[last], self.run[positions[0]]) if last >= 0 else 0)
                value = np.append(upper, large[k][1][:0:-1]).astype(np.int32)
                yield positions, value
                self._pass_on(positions, value, True, queues, least)

    def sorted_seeds(self) -> Tuples:
        """Seeds in order, and the value of each with the one before."""
        seeds = self.seeds
        if len(seeds) < 2:
            return seeds, np.zeros(len(seeds), dtype=np.int32)
        zero = np.zeros(len(seeds), dtype=np.int32)
        by_letter = seeds[np.argsort(self.text[seeds], kind="stable")]
        is_seed = np.zeros(len(self.text), dtype=bool)
        is_seed[seeds] = True
        order = np.concatenate([p[is_seed[p]] for p, _ in self.induce(by_letter, zero, False)])[::-1]
        rank = np.empty(len(self.text), dtype=np.int32)
        rank[seeds] = np.arange(len(seeds), dtype=np.int32)
        order = rank[order]  # seeds by number, in order of their substrings
        ends = np.append(seeds[1:], len(self.text) - 1)
        size = ends - seeds + 1
        total = np.zeros(len(self.text) + 1, dtype=np.uint64)
        odd = np.uint64(0x9E3779B97F4A7C15)
        powers = np.cumprod(np.full(len(self.text), odd, dtype=np.uint64))
        back = np.cumprod(np.full(len(self.text), np.uint64(pow(int(odd), -1, 1 << 64)), dtype=np.uint64))
        letters = np.random.default_rng(7).integers(1, 1 << 63, int(self.text.max()) + 1).astype(np.uint64)
        np.cumsum(letters[self.text] * powers, out=total[1:])
        hashed = (total[ends + 1] - total[seeds]) * back[seeds]
        differs = (hashed[order[1:]] != hashed[order[:-1]]) | (size[order[1:]] != size[order[:-1]])
        name = np.empty(len(seeds), dtype=np.int64)
        name[order] = np.append(0, np.cumsum(differs))
        levels, width = [name], 1
        while name.max() + 1 < len(seeds) and 2 * width <= self.cap + 2:  # seeds are two letters apart at least
            behind = np.zeros(len(seeds), dtype=np.int64)
            behind[:-width] = name[width:] + 1
            _, name = np.unique(name * (len(seeds) + 1) + behind, return_inverse=True)
            levels.append(name)
            width *= 2
        order = np.argsort(name, kind="stable")
        a, b = order[:-1].copy(), order[1:].copy()
        start = seeds[a]
        for power in range(len(levels) - 1, -1, -1):
            inside = np.flatnonzero((a < len(seeds)) & (b < len(seeds)))
            same = inside[levels[power][a[inside]] == levels[power][b[inside]]]
            a[same] += 1 << power
            b[same] += 1 << power
        places = np.append(seeds, len(self.text) - 1)
        a, b = np.minimum(a, len(seeds)), np.minimum(b, len(seeds))
        value = places[a] - start
        left, right, open_ = places[a].astype(np.int64), places[b].astype(np.int64), np.arange(len(value))
        final = len(self.text) - 1
        while len(open_):
            same = (self.text[np.minimum(left, final)] == self.text[np.minimum(right, final)]) & (value[open_] < self.cap) & (left < final) & (right < final)
            open_, left, right = open_[same], left[same] + 1, right[same] + 1
            value[open_] += 1
        return seeds[order], np.append(0, np.minimum(value, self.cap)).astype(np.int32)

    def stream(self) -> Iterator[Tuples]:
        """All suffixes in descending order, in runs: positions, and the value of each with the suffix given before it."""
        return self.induce(*self.sorted_seeds(), True)


def join_texts(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text for Sorter, place of each part): bytes count from 2, a 1 follows each part, a 0 ends all."""
    size = np.array([len(p) for p in parts], dtype=np.int64)
    places = np.concatenate([[0], np.cumsum(size + 1)])
    text = np.frombuffer(b"\0".join(parts) + b"\0\0", dtype=np.uint8).astype(np.int16) + 2
    text[places[1:] - 1] = 1
    text[-1] = 0
    return text, places[:-1]


def repeated_starts(parts: list[bytes], length: int, folder: str | None = None, room: int = 1 << 24) -> list[np.ndarray]:
    """For each part, the places at which a string of `length` bytes starts that starts elsewhere in the parts too."""
    text, places = join_texts(parts)
    flags = np.zeros(len(text), dtype=bool)
    previous = -1
    for positions, values in Sorter(text, length, folder, room).stream():
        same = values >= length
        flags[positions[same]] = True
        if same[0] and previous >= 0:
            flags[previous] = True
        flags[positions[:-1][same[1:]]] = True
        previous = int(positions[-1])
    return [np.flatnonzero(flags[a : a + max(0, len(p) - length + 1)]) for a, p in zip(places.tolist(), parts, strict=True)]
