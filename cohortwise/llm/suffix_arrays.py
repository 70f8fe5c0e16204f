"""Suffix arrays by induced sorting, with queues that go to disk.

Suffixes are sorted by induction: from the sorted S* suffixes (of type S after
one of type L) follow the L-type suffixes in one scan upwards, and from those
the S-type ones in one scan downwards. A scan is a priority queue over
(character, arrival): it takes the suffixes of the least (greatest) character
in the order of their arrival, and puts the suffix before each of them into
the queue of its own character. As arrivals are in order already, the queue of
a character is first in, first out; a queue holds blocks of positions and
moves them to an unnamed file where they exceed their share of memory.

The S* suffixes are sorted by inducing their substrings, naming them, and
sorting the string of names: by names of twice the length in each round.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Positions that the queues of one scan keep in memory.
IN_MEMORY = 1 << 23


class _Queues:
    """First-in-first-out queues of positions, one for each character."""

    def __init__(self, characters: int, in_memory: int = IN_MEMORY):
        self.blocks: list[list[np.ndarray | tuple[int, int]]] = [[] for _ in range(characters)]
        self.held, self.in_memory, self.file = 0, in_memory, None

    def put(self, positions: np.ndarray, characters: np.ndarray) -> None:
        """Append each position to the queue of its character, in order."""
        if not len(positions):
            return
        order = np.argsort(characters, kind="stable")
        characters = characters[order]
        edges = np.r_[0, np.flatnonzero(np.diff(characters)) + 1, len(characters)]
        sorted_ = positions[order]
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            self._append(int(characters[a]), sorted_[a:b])

    def _append(self, character: int, block: np.ndarray) -> None:
        if self.held + len(block) > self.in_memory:
            if self.file is None:
                self.file = tempfile.TemporaryFile()  # has no name: gone with the task
            at = self.file.seek(0, 2)
            self.file.write(block.astype(np.int64).tobytes())
            self.blocks[character].append((at, len(block)))
        else:
            self.held += len(block)
            self.blocks[character].append(block)

    def take(self, character: int) -> np.ndarray | None:
        """All that waits in a queue now, in order of arrival; None if nothing does."""
        waiting, self.blocks[character] = self.blocks[character], []
        if not waiting:
            return None
        out = []
        for block in waiting:
            if isinstance(block, tuple):
                self.file.seek(block[0])
                out.append(np.frombuffer(self.file.read(8 * block[1]), np.int64))
            else:
                self.held -= len(block)
                out.append(block)
        return out[0] if len(out) == 1 else np.concatenate(out)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _types(text: np.ndarray) -> np.ndarray:
    """True for type S: the suffix is smaller than the one before it would be, read forward (0 always is)."""
    edges = np.flatnonzero(np.diff(text))  # last place of each run but the last
    up = text[edges + 1] > text[edges]
    runs = np.diff(np.r_[-1, edges, len(text) - 1])
    return np.repeat(np.r_[up, True], runs) | (text == 0)


def _induced(text: np.ndarray, small: np.ndarray, seeds: np.ndarray, characters: int, in_memory: int) -> np.ndarray:
    """All suffixes in order, from the S* suffixes ``seeds`` in order."""
    by = np.argsort(text[seeds], kind="stable")
    seeds = seeds[by]
    ends = np.searchsorted(text[seeds], np.arange(characters + 1))
    queues, large = _Queues(characters, in_memory), []
    for c in range(characters):
        done = []
        while (block := queues.take(c)) is not None:
            done.append(block)
            before = block[block > 0] - 1
            before = before[text[before] >= c]
            queues.put(before, text[before])
        large.append(np.concatenate(done) if done else np.empty(0, np.int64))
        block = seeds[ends[c]:ends[c + 1]]
        before = block[block > 0] - 1
        before = before[~small[before]]
        queues.put(before, text[before])
    queues.close()
    queues, out = _Queues(characters, in_memory), []
    for c in range(characters - 1, -1, -1):
        done = []
        while (block := queues.take(c)) is not None:
            done.append(block)
            before = block[block > 0] - 1
            before = before[(text[before] <= c) & small[before]]
            queues.put(before, text[before])
        up = np.concatenate(done) if done else np.empty(0, np.int64)
        if c == 0:  # ends of texts: in order of their places
            up = seeds[ends[0]:ends[1]]
        block = large[c][::-1]
        before = block[block > 0] - 1
        before = before[text[before] < c]
        queues.put(before, text[before])
        out.append(up[::-1] if c else up)
        out.append(large[c])
    queues.close()
    return np.concatenate(out[::-1])


def _sorted_names(names: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of a string of names in order, as far as ``depth`` names tell them apart."""
    n, width = len(names), 1
    rank = names.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    while width < depth:
        in_order = rank[order]
        same = np.r_[False, in_order[1:] == in_order[:-1]]
        tied = same | np.r_[same[1:], False]
        if not tied.any():
            break
        # only the tied ones are sorted again, within their group, by the rank `width` further on
        places = np.flatnonzero(tied)
        who = order[places]
        further = np.where(who + width < n, rank[np.minimum(who + width, n - 1)], -1)
        again = np.lexsort((further, in_order[places]))
        order[places] = who[again]
        # ranks are first places, so those of other groups stay as they are
        first, next_ = in_order[places], further[again]
        new = np.r_[True, (first[1:] != first[:-1]) | (next_[1:] != next_[:-1])]
        at = places[np.maximum.accumulate(np.where(new, np.arange(len(places)), 0))]
        rank[order[places]] = at
        if width == 1:
            alone = np.flatnonzero(~tied)
            rank[order[alone]] = alone
        width *= 2
    return order


def suffix_array(text: np.ndarray, depth: int, in_memory: int = IN_MEMORY) -> np.ndarray:
    """The places of ``text`` in the order of their suffixes, as far as ``depth`` characters and a 0 tell them apart.

    ``text`` holds whole numbers; 0 ends each of the texts in it and stands at
    the end. A suffix does not go on beyond its 0; zeros are in the order of
    their places.
    """
    text = np.ascontiguousarray(text)
    n = len(text)
    if not n:
        return np.empty(0, np.int64)
    characters = int(text.max()) + 1
    small = _types(text)
    star = np.flatnonzero(small[1:] & (~small[:-1] | (text[1:] == 0))) + 1
    if text[0] == 0:
        star = np.r_[0, star]
    if len(star) > 1:
        rough = _induced(text, small, star, characters, in_memory)
        is_star = np.zeros(n, bool)
        is_star[star] = True
        in_order = rough[is_star[rough]]
        # substrings are equal if their lengths and all their characters are; zeros are all different
        number = np.full(n, -1)
        number[star] = np.arange(len(star))
        lengths = np.diff(np.r_[star, n - 1]) + 1
        which = number[in_order]
        a, b = in_order[:-1], in_order[1:]
        equal = (lengths[which[:-1]] == lengths[which[1:]]) & (text[a] == text[b]) & (text[a] != 0)
        rest, k = np.flatnonzero(equal), 1
        while len(rest):  # character by character, the unequal and the finished ones drop out
            going = k < lengths[which[rest]]
            rest = rest[going]
            if not len(rest):
                break
            differ = text[a[rest] + k] != text[b[rest] + k]
            equal[rest[differ]] = False
            # a 0 at the end of both: different ends, but nothing beyond them is compared
            rest = rest[~differ]
            k += 1
        names = np.empty(len(star), np.int64)
        first = np.r_[True, ~equal]
        names[which] = np.maximum.accumulate(np.where(first, np.arange(len(which)), 0))
        star = star[_sorted_names(names, depth)]
    return _induced(text, small, star, characters, in_memory)


def repeated_starts(texts: list[bytes], length: int, in_memory: int = IN_MEMORY) -> tuple[np.ndarray, np.ndarray]:
    """(text, place) of every string of ``length`` bytes in ``texts`` that also stands somewhere else in them."""
    sizes = np.array([len(t) for t in texts], np.int64)
    if not len(sizes):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    starts = np.r_[0, np.cumsum(sizes + 1)[:-1]]
    flat = np.zeros(int(sizes.sum()) + len(texts), np.int16)
    of = np.repeat(np.arange(len(texts)), sizes)
    flat[np.arange(len(of)) + of] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int16) + 1
    order = suffix_array(flat, length, in_memory)
    # places with `length` bytes before the end of their text
    delta = np.zeros(len(flat) + 1, np.int32)
    np.add.at(delta, starts, 1)
    np.add.at(delta, starts + np.maximum(sizes - length + 1, 0), -1)
    room = np.cumsum(delta[:-1]) > 0
    a, b = order[:-1], order[1:]
    pairs = np.flatnonzero(room[a] & room[b])
    # the common prefix of neighbours, as far as `length`: eight bytes at a time (there is room, so no 0 among them)
    words = np.zeros(len(flat), np.uint64)
    for j in range(min(8, length, len(flat))):
        words[: len(flat) - j] = (words[: len(flat) - j] << np.uint64(8)) | (flat[j:] - 1).astype(np.uint8)
    for k in sorted({min(k, max(length - 8, 0)) for k in range(0, length, 8)}):
        pairs = pairs[words[a[pairs] + k] == words[b[pairs] + k]]
    hit = np.zeros(len(flat), bool)
    hit[a[pairs]] = True
    hit[b[pairs]] = True
    places = np.flatnonzero(hit)
    text = np.searchsorted(starts, places, side="right") - 1
    return text, places - starts[text]
