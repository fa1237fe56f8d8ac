"""External induced sorting of the suffixes of a shard, with common-prefix values.

A shard is a sequence of symbols whose last one is the smallest and occurs once. Its suffixes
at local minima are put in order first: the phrases between minima are sorted and named, and
where names repeat, the sequence of names is sorted by recursion. All other suffixes follow by
induction: one pass in rising order for those that fall to the next minimum, one in falling order
for the rest. A tuple of a suffix carries the symbols before it, so the text is never looked up.

Each tuple also carries the prefix it has in common with its neighbour: the symbol's weight and
the smallest value passed since the last suffix that went to the same queue. Values end at ``cap``,
so the stack that answers for the smallest one has at most ``cap`` entries.

Queues, sorts and tapes keep ``held`` items in memory and the others in unnamed temporary files,
which nobody but the running task can see and which go with it, like Spark's own spills. In memory
stay two numbers for each different symbol and phrase.
"""

from __future__ import annotations

import pickle
import tempfile
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush, merge

import numpy as np

#: Items that one queue, sort or tape keeps in memory.
HELD = 200_000
_BLOCK = 4096


class Blocks:
    """Pickled blocks in an unnamed file."""

    def __init__(self) -> None:
        self.file = None

    def put(self, items: list) -> int:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        at = self.file.seek(0, 2)
        pickle.dump(items, self.file, pickle.HIGHEST_PROTOCOL)
        return at

    def get(self, at: int) -> list:
        self.file.seek(at)
        return pickle.load(self.file)



class Spilled(list):
    """A list whose owner calls :meth:`trim` now and then, which moves what is more than ``held`` to a file."""

    def __init__(self, held: int) -> None:
        super().__init__()
        self.most, self.places, self.blocks = held, [], Blocks()

    add = list.append

    def trim(self) -> None:
        if len(self) >= self.most:
            self.spill()

    def cut(self) -> list[int]:
        places = [self.blocks.put(self[i : i + _BLOCK]) for i in range(0, len(self), _BLOCK)]
        self.clear()
        return places


class DiskSort(Spilled):
    """Sorts more items than memory holds: sorted runs in a file, then their merge."""

    def spill(self) -> None:
        self.sort()
        self.places.append(self.cut())

    def _run(self, places: list[int]) -> Iterator[tuple]:
        for at in places:
            yield from self.blocks.get(at)

    def ordered(self) -> Iterator[tuple]:
        self.sort()
        if not self.places:
            return iter(self)
        self.places.append(self.cut())
        return merge(*map(self._run, self.places))


class Tape(Spilled):
    """A list that is written once and read once, forwards or backwards."""

    def spill(self) -> None:
        self.places += self.cut()

    def forwards(self) -> Iterator[tuple]:
        for at in self.places:
            yield from self.blocks.get(at)
        yield from self

    def backwards(self) -> Iterator[tuple]:
        yield from reversed(self)
        for at in reversed(self.places):
            yield from reversed(self.blocks.get(at))


class DiskQueue:
    """Priority queue by symbol, then by arrival. Nothing arrives before the symbol that is being drained."""

    def __init__(self, held: int, sign: int = 1) -> None:
        self.most, self.sign, self.heap = held, sign, []
        self.queues: dict[int, list] = {}
        self.places: dict[int, list[int]] = {}
        self.size, self.blocks = 0, Blocks()

    def push(self, symbol: int, item: tuple) -> None:
        queue = self.queues.get(symbol)
        if queue is None:
            self.queues[symbol] = [item]
            if symbol not in self.places:
                heappush(self.heap, self.sign * symbol)
        else:
            queue.append(item)
        self.size += 1
        if self.size >= self.most:
            for symbol, queue in self.queues.items():
                self.places.setdefault(symbol, []).append(self.blocks.put(queue))
            self.queues, self.size = {}, 0

    def first(self) -> int | None:
        while self.heap:
            symbol = self.sign * self.heap[0]
            if symbol in self.queues or symbol in self.places:
                return symbol
            heappop(self.heap)
        return None

    def drain(self, symbol: int) -> Iterator[tuple]:
        """All items of ``symbol``, those too that arrive meanwhile."""
        while True:
            if places := self.places.pop(symbol, None):
                for at in places:
                    yield from self.blocks.get(at)
            elif queue := self.queues.pop(symbol, None):
                self.size -= len(queue)
                yield from queue
            else:
                return


class Alphabet:
    """Weights of symbols, and what each has in common with the symbol before it."""

    def __init__(self, weights: list[int], common: list[int], cap: int) -> None:
        self.weights, self.cap = weights, cap
        self.common = np.asarray(common, np.int32)

    def shared(self, low: int, high: int) -> int:
        """Common prefix of two different symbols."""
        return int(self.common[high]) if high == low + 1 else int(self.common[low + 1 : high + 1].min())

    def turn(self, symbol: int, falling: tuple[int, int], rising: tuple[int, int]) -> int:
        """Common prefix of a falling and a rising suffix: runs of ``symbol``, then the symbols behind them."""
        (a, x), (b, y) = falling, rising
        beyond = self.shared(x, symbol) if a < b else self.shared(symbol, y) if a > b else self.shared(x, y)
        return min(self.cap, min(a, b) * self.weights[symbol] + beyond)


def minima(symbols: Iterable[int]) -> Iterator[tuple[tuple | None, int, int, int, int, tuple]]:
    """The local minima from left to right.

    Each as (phrase of the minimum before it, position, symbol, length of its run, symbol behind
    the run, symbols before it back to the minimum before it). A phrase ends where the next minimum is
    proved, so no phrase is the beginning of another one.
    """
    buffer: list[int] = []  # from the last minimum on
    last, falling, run, start = -1, False, 1, None
    at = -1
    for at, symbol in enumerate(symbols):
        if symbol == last:
            run += 1
        else:
            if falling and symbol > last:
                low = at - run
                phrase = None if start is None else (*buffer, symbol)
                cutoff = len(buffer) - run
                yield phrase, low, last, run, symbol, tuple(buffer[cutoff - 1 :: -1]) if cutoff else ()
                start, buffer = low, buffer[cutoff:]
            falling, run, last = last > symbol, 1, symbol
        buffer.append(symbol)
    yield (None if start is None else tuple(buffer)), at, last, 1, last, tuple(buffer[-2::-1]) if len(buffer) > 1 else ()


def suffix_order(symbols: Iterable[int], alphabet: Alphabet, held: int = HELD) -> Iterator[tuple[int, int]]:
    """(position, common prefix with the suffix before it) of all suffixes in order; every symbol occurs."""
    falls, rises, last_fall, last_rise, end = induce(symbols, alphabet, held)
    yield end, 0
    fall = falls.forwards()
    rise = rises.backwards()
    left, right = next(fall, None), next(rise, None)
    while left is not None or right is not None:
        symbol = min(x[0] for x in (left, right) if x is not None)
        value = int(alphabet.common[symbol])
        while left is not None and left[0] == symbol:
            yield left[1], value if left[2] is None else left[2]
            left = next(fall, None)
        if right is not None and right[0] == symbol:
            if symbol in last_fall:
                value = alphabet.turn(symbol, last_fall[symbol][1:], last_rise[symbol][1:])
            while right is not None and right[0] == symbol:
                yield right[1], value
                value = right[2]
                right = next(rise, None)


def repeated(symbols: Iterable[int], alphabet: Alphabet, held: int = HELD) -> Iterator[int]:
    """Positions of suffixes that share ``cap`` with a neighbour; a position may come more than once."""
    found = Tape(held)
    _, _, last_fall, last_rise, _ = induce(symbols, alphabet, held, found)
    yield from found.forwards()
    for symbol, (place, *fall) in last_fall.items():
        if (other := last_rise.get(symbol)) and alphabet.turn(symbol, fall, other[1:]) >= alphabet.cap:
            yield place
            yield other[0]


def induce(symbols: Iterable[int], alphabet: Alphabet, held: int, found: Tape | None = None) -> tuple[Tape, Tape, dict, dict, int]:
    """Falling suffixes in order, rising ones in reverse order, the last of each symbol, the last position.

    Suffixes come as (symbol, position, common prefix with the one before it, or None where the symbol is new).
    With ``found`` the suffixes themselves are dropped, and positions of neighbours that share the cap go there.

    In both passes ``values`` rises from bottom to top and ends at the last step: the smallest value since
    a step is the first one behind it.
    """
    seeds, end = ordered_minima(symbols, alphabet, held)
    weights, cap, shared = alphabet.weights, alphabet.cap, alphabet.shared

    falls, turns = Tape(held), Tape(held)
    written = [falls, turns] if found is None else [found, turns]
    last_fall: dict[int, tuple[int, int, int]] = {}
    queue = DiskQueue(held)
    push, sent, steps, values, now = queue.push, {}, [], [], -1
    turned, before = (-1, -1), -1
    seed = next(seeds, None)
    while (symbol := queue.first()) is not None or seed is not None:
        if symbol is None or (seed is not None and seed[1] < symbol):
            symbol = seed[1]
        fall, last = None, -1
        for place, k, carry, value, run, behind in queue.drain(symbol):
            if found is None:
                falls.add((symbol, place, value))
            elif value == cap:
                found.add(last)
                found.add(place)
            if value is None:
                value = shared(before, symbol) if before >= 0 else 0
            now += 1
            if not now & 1023:
                for held_back in written:
                    held_back.trim()
            while values and values[-1] >= value:
                values.pop()
                steps.pop()
            steps.append(now)
            values.append(value)
            before, last = symbol, place
            fall = run, behind
            if k < len(carry):
                to = carry[k]
                if to >= symbol:
                    since = sent.get(to)
                    sent[to] = now
                    if since is not None:
                        since = weights[to] + values[bisect_right(steps, since)]
                        if since > cap:
                            since = cap
                    push(to, (place - 1, k + 1, carry, since, run + 1, behind) if to == symbol else (place - 1, k + 1, carry, since, 1, symbol))
                else:
                    turns.add((symbol, place, k, carry, values[bisect_right(steps, turned[1])] if turned[0] == symbol else None, run, behind))
                    turned = (symbol, now)
        if fall is not None:
            last_fall[symbol] = (last, *fall)
        first = True
        while seed is not None and seed[1] == symbol:
            _, _, place, value, run, behind, carry = seed
            if first:
                value = alphabet.turn(symbol, fall, (run, behind)) if fall is not None else shared(before, symbol) if before >= 0 else 0
            first, before = False, symbol
            now += 1
            if not now & 1023:
                for held_back in written:
                    held_back.trim()
            while values and values[-1] >= value:
                values.pop()
                steps.pop()
            steps.append(now)
            values.append(value)
            if carry:
                to = carry[0]
                since = sent.get(to)
                sent[to] = now
                push(to, (place - 1, 1, carry, None if since is None else min(cap, weights[to] + values[bisect_right(steps, since)]), 1, symbol))
            seed = next(seeds, None)

    rises = Tape(held)
    written = [rises] if found is None else [found]
    last_rise: dict[int, tuple[int, int, int]] = {}
    queue = DiskQueue(held, -1)
    push, sent, steps, values, now, before = queue.push, {}, [], [], -1, -1
    stream = turns.backwards()
    turn = next(stream, None)
    while (symbol := queue.first()) is not None or turn is not None:
        if symbol is None or (turn is not None and turn[0] > symbol):
            symbol = turn[0]
        rise, last = None, -1
        for place, k, carry, value, run, behind in queue.drain(symbol):
            if found is None:
                rises.add((symbol, place, value))
            elif value == cap:
                found.add(last)
                found.add(place)
            if value is None:
                value = shared(symbol, before) if before >= 0 else 0
            now += 1
            if not now & 1023:
                for held_back in written:
                    held_back.trim()
            while values and values[-1] >= value:
                values.pop()
                steps.pop()
            steps.append(now)
            values.append(value)
            before, last = symbol, place
            rise = run, behind
            if k < len(carry):
                to = carry[k]
                since = sent.get(to)
                sent[to] = now
                if since is not None:
                    since = weights[to] + values[bisect_right(steps, since)]
                    if since > cap:
                        since = cap
                push(to, (place - 1, k + 1, carry, since, run + 1, behind) if to == symbol else (place - 1, k + 1, carry, since, 1, symbol))
        if rise is not None:
            last_rise[symbol] = (last, *rise)
        above = None
        while turn is not None and turn[0] == symbol:
            _, place, k, carry, value, run, behind = turn
            if above is None:
                above = alphabet.turn(symbol, (run, behind), rise) if rise is not None else shared(symbol, before) if before >= 0 else 0
            now += 1
            while values and values[-1] >= above:
                values.pop()
                steps.pop()
            steps.append(now)
            values.append(above)
            above, before = value, symbol
            to = carry[k]
            since = sent.get(to)
            sent[to] = now
            push(to, (place - 1, k + 1, carry, None if since is None else min(cap, weights[to] + values[bisect_right(steps, since)]), 1, symbol))
            turn = next(stream, None)
    return falls, rises, last_fall, last_rise, end


def ordered_minima(symbols: Iterable[int], alphabet: Alphabet, held: int) -> tuple[Iterator[tuple], int]:
    """The local minima in the order of their suffixes, and the last position.

    Each as (rank, symbol, position, common prefix with the one before it, run, symbol behind, symbols before it).
    """
    weights, cap = alphabet.weights, alphabet.cap
    phrases, seeds, number, end = DiskSort(held), Tape(held), 0, 0
    for phrase, place, symbol, run, behind, carry in minima(symbols):
        if phrase is not None:
            # What follows the next minimum's first symbol only proves it; the weight ends before it.
            phrases.add((phrase, number - 1, min(cap, sum(map(weights.__getitem__, carry)))))
        seeds.add((symbol, place, run, behind, carry))
        number, end = number + 1, place
        if not number & 1023:
            phrases.trim()
            seeds.trim()
    phrases.add(((symbol,), number - 1, weights[symbol]))

    names, sums, common, before = DiskSort(held), [], [], None
    for phrase, nth, weight in phrases.ordered():
        if phrase != before:
            common.append(_common(before, phrase, alphabet) if before is not None else 0)
            sums.append(weight)
            before = phrase
        names.add((nth, len(sums) - 1))
        if not nth & 1023:
            names.trim()
    ranks = DiskSort(held)
    if len(sums) == number:
        for nth, name in names.ordered():
            ranks.add((nth, name, common[name]))
            if not nth & 1023:
                ranks.trim()
    else:
        inner = suffix_order((name for _, name in names.ordered()), Alphabet(sums, common, cap), held)
        for rank, (nth, value) in enumerate(inner):
            ranks.add((nth, rank, value))
            if not nth & 1023:
                ranks.trim()
    placed = DiskSort(held)
    for (_, rank, value), (symbol, place, run, behind, carry) in zip(ranks.ordered(), seeds.forwards(), strict=True):
        placed.add((rank, symbol, place, value, run, behind, carry))
        if not rank & 1023:
            placed.trim()
    return placed.ordered(), end


def _common(a: tuple, b: tuple, alphabet: Alphabet) -> int:
    total = 0
    for x, y in zip(a, b):
        if x != y:
            total += alphabet.shared(x, y)
            break
        total += alphabet.weights[x]
    return min(total, alphabet.cap)
