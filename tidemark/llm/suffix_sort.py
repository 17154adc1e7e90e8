"""Suffix order of a shard by recursive induced sorting on disk.

Texts, types and reduced texts are files that are mapped and gone through in
blocks.  Suffixes wait in priority queues as tuples of character, place and
common prefix with the tuple before: a first-in first-out queue for each byte,
sorted runs for the larger alphabets of reduced texts, both in files beyond the
memory limit.  The smallest tuples are taken in blocks; each yields its predecessor, with a common prefix
that is one more than the least one passed since the last predecessor with that
character.  What was taken is written in order.

Suffixes of type S that follow one of type L are sorted by a first induction of
the substrings between them.  If substrings repeat, their numbers are a reduced
text, which is sorted by the same method, until one fits in memory; a second
induction gives the order of all suffixes.  Orders and common prefixes go as deep as asked for.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np

#: Bytes of tuples that each queue and each written order of a level holds in memory.
MEMORY = 96 << 20
#: Tuples or characters handled at a time.
BLOCK = 1 << 20
CODES = 258  # 0 ends the shard, 1 parts records, bytes are raised by 2
#: Tuples are two rows of numbers: the code, and the place with the common prefix in its low byte.
NONE = np.zeros((2, 0), np.int64)
FAR = 255
#: Bytes that a number of a reduced text takes where it is sorted in memory.
IN_MEMORY = 32
#: Tuples that wait unsorted, and sorted runs that are kept apart, at most.
PENDING, RUNS = 1 << 13, 64


def tuples(code: np.ndarray, at: np.ndarray, lcp) -> np.ndarray:
    out = np.empty((2, len(at)), np.int64)
    out[0], out[1] = code, at
    out[1] <<= 8
    out[1] |= lcp
    return out


def joined(parts: list[np.ndarray]) -> np.ndarray:
    return NONE if not parts else parts[0] if len(parts) == 1 else np.concatenate(parts, axis=1)


def by_code(items: np.ndarray) -> np.ndarray:
    return items[:, np.argsort(items[0], kind="stable")]


class Folder:
    """Scratch files of one task, gone with it."""

    def __init__(self):
        self.place = tempfile.TemporaryDirectory(prefix="suffixes-")
        self.files = 0

    def path(self) -> str:
        self.files += 1
        return os.path.join(self.place.name, str(self.files))

    def array(self, size: int, kind) -> np.ndarray:
        """A mapped array of zeros."""
        return np.memmap(self.path(), dtype=kind, mode="w+", shape=(max(size, 1),)).view(np.ndarray)[:size]

    def close(self) -> None:
        self.place.cleanup()


class Spilled:
    """A block in a file."""

    def __init__(self, path: str, items: np.ndarray):
        self.path, self.shape = path, items.shape
        np.ascontiguousarray(items).tofile(path)

    def mapped(self) -> np.ndarray:
        return np.memmap(self.path, dtype=np.int64, mode="r", shape=self.shape).view(np.ndarray)


class Store:
    """Blocks of tuples, in memory up to a limit and else in files."""

    def __init__(self, folder: Folder, memory: int):
        self.folder, self.memory, self.held, self.spilled = folder, memory, 0, 0

    def put(self, items: np.ndarray) -> np.ndarray | Spilled:
        if self.held + items.nbytes <= self.memory:
            self.held += items.nbytes
            return items
        self.spilled += items.nbytes
        return Spilled(self.folder.path(), items)

    def get(self, block: np.ndarray | Spilled) -> np.ndarray:
        return block if isinstance(block, np.ndarray) else np.fromfile(block.path, np.int64).reshape(block.shape)

    def drop(self, block: np.ndarray | Spilled) -> None:
        """A block that is not needed any more."""
        if isinstance(block, Spilled):
            os.unlink(block.path)
        else:
            self.held -= block.nbytes


class Queues:
    """First-in first-out queues, one for each code."""

    def __init__(self, store: Store, codes: int):
        self.store = store
        self.queues: list[list] = [[] for _ in range(codes)]

    def put(self, items: np.ndarray) -> None:
        if not items.shape[1]:
            return
        items = by_code(items)
        cuts = [0, *(np.nonzero(np.diff(items[0]))[0] + 1).tolist(), items.shape[1]]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            self.queues[items[0, a]].append(self.store.put(np.ascontiguousarray(items[:, a:b])))

    def take(self, code: int) -> np.ndarray:
        """The first tuples of a code, about ``BLOCK`` of them."""
        queue, n, size = self.queues[code], 0, 0
        while n < len(queue) and size < BLOCK:
            size += queue[n].shape[1]
            n += 1
        parts, self.queues[code] = queue[:n], queue[n:]
        out = joined([self.store.get(p) for p in parts])
        for p in parts:
            self.store.drop(p)
        return out


class Runs:
    """A priority queue of sorted runs: what was put first comes first among equal codes."""

    def __init__(self, store: Store):
        self.store, self.runs, self.pending, self.size = store, [], [], 0

    def put(self, items: np.ndarray) -> None:
        if items.shape[1]:
            self.pending.append(items)
            self.size += items.shape[1]
            if self.size > PENDING:
                self.settle()

    def settle(self) -> None:
        """What waits becomes a run; many runs become one."""
        new, self.pending, self.size = by_code(joined(self.pending)), [], 0
        if len(self.runs) >= RUNS:
            new = by_code(joined([*(np.asarray(r[:, at:]) for r, at, _ in self.runs), new]))
            for _, _, block in self.runs:
                self.store.drop(block)
            self.runs = []
        block = self.store.put(np.ascontiguousarray(new))
        self.runs.append((block.mapped() if isinstance(block, Spilled) else block, 0, block))

    def below(self, bound: int) -> np.ndarray:
        """All tuples of codes below a bound, sorted."""
        parts = []
        for k, (run, at, block) in enumerate(self.runs):
            if at < run.shape[1] and run[0, at] < bound:
                end = at + int(np.searchsorted(run[0, at:], bound))
                parts.append(np.asarray(run[:, at:end]))
                self.runs[k] = (run, end, block)
        if self.pending:
            waiting = joined(self.pending)
            here = waiting[0] < bound
            if here.any():
                parts.append(waiting[:, here])
                waiting = waiting[:, ~here]
            self.pending, self.size = [waiting], waiting.shape[1]
        return by_code(joined(parts)) if parts else NONE


class Sequence:
    """Tuples in the order in which they were written."""

    def __init__(self, store: Store):
        self.store, self.blocks = store, []
        self.open: list[np.ndarray] = []
        self.size = 0

    def put(self, items: np.ndarray) -> None:
        if items.shape[1]:
            self.open.append(items)
            self.size += items.shape[1]
            if self.size >= BLOCK // 8:
                self.flush()

    def flush(self) -> None:
        if self.open:
            self.blocks.append(self.store.put(joined(self.open)))
            self.open, self.size = [], 0

    def read(self) -> Iterator[np.ndarray]:
        self.flush()
        for b in self.blocks:
            yield self.store.get(b)

    def backwards(self) -> Iterator[np.ndarray]:
        """From the last to the first; the common prefix is again that with the tuple before."""
        self.flush()
        after = 0
        for b in reversed(self.blocks):
            items = self.store.get(b)[:, ::-1]
            lcp = items[1] & 255
            prefix = np.empty(len(lcp), np.int64)
            prefix[0], prefix[1:] = after, lcp[:-1]
            after = lcp[-1]
            yield tuples(items[0], items[1] >> 8, prefix)


class Cursor:
    """Takes from blocks in ascending code as many tuples as lie below a bound."""

    def __init__(self, blocks: Iterator[np.ndarray]):
        self.blocks, self.left = blocks, NONE

    def below(self, bound: int, most: int = 0) -> np.ndarray:
        parts, size = [], 0
        while True:
            if not self.left.shape[1]:
                self.left = next(self.blocks, NONE)
                if not self.left.shape[1]:
                    break
            n = int(np.searchsorted(self.left[0], bound))
            n = min(n, most - size) if most else n
            if n:
                parts.append(self.left[:, :n])
                size += n
            stopped = n < self.left.shape[1]
            self.left = self.left[:, n:]
            if stopped or most and size >= most:
                break
        return joined(parts)


class Level:
    """A text of one level of the recursion: codes that end with the only 0."""

    def __init__(self, text: np.ndarray, codes: int, depth: int, folder: Folder, memory: int):
        self.text, self.codes, self.depth, self.folder, self.memory = text, codes, depth, folder, memory
        self.n = len(text)
        # Tuples of a range are handled together as far as none of them yields one into it, so ranges are best as large as the root.
        self.span = 1 if codes <= 1024 else max(1, int(codes / max(self.n / max(self.n, 1) ** 0.5, 1)))
        self.types = folder.array(self.n, np.uint8)
        self.write_types()

    def write_types(self) -> None:
        """1 for suffixes that are smaller than the next one (type S), from the end on."""
        later = 1
        for a in range((self.n - 1) // BLOCK * BLOCK, -1, -BLOCK):
            b = min(a + BLOCK, self.n)
            here = np.asarray(self.text[a : min(b + 1, self.n)]).astype(np.int64)
            step = np.diff(here)
            size = b - a
            if b == self.n:
                step = np.r_[step, 1]
            # The next place where the character changes decides.
            at = np.where(step != 0, np.arange(size), size)
            at = np.minimum.accumulate(at[::-1])[::-1]
            kind = np.r_[step > 0, bool(later)].astype(np.uint8)[at]
            self.types[a:b] = kind
            later = kind[0]

    def stars(self) -> np.ndarray:
        """Places of type S that follow type L, in their order."""
        found = [np.zeros(0, np.int64)]
        for a in range(0, self.n, BLOCK):
            kind = np.asarray(self.types[max(a - 1, 0) : a + BLOCK])
            found.append(np.nonzero((kind[1:] == 1) & (kind[:-1] == 0))[0] + max(a - 1, 0) + 1)
        out = self.folder.array(sum(map(len, found)), np.int64)
        out[:] = np.concatenate(found)
        return out

    def extend(self, a: np.ndarray, b: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Common prefixes of the suffixes at ``a`` and ``b``, of which some is known, up to the depth."""
        out = np.minimum(known, self.depth).astype(np.int64)
        live = np.nonzero(out < self.depth)[0]
        while len(live):
            x, y = a[live] + out[live], b[live] + out[live]
            inside = (x < self.n) & (y < self.n)
            live, x, y = live[inside], x[inside], y[inside]
            live = live[self.text[x] == self.text[y]]
            out[live] += 1
            live = live[out[live] < self.depth]
        return out

    def induce(self, seeds: Iterator[np.ndarray], want: int, exact: bool) -> Sequence:
        """All suffixes of type ``want`` in order, from sorted ones of the other type.

        Type S comes in falling order: its codes count from the largest down.  In
        a character, queued suffixes come before seeds.  ``exact`` tells that
        seeds are whole suffixes and not only the ends of substrings.
        """
        store = Store(self.folder, self.memory)
        queues = Queues(store, self.codes) if self.span == 1 else Runs(store)
        out, cursor = Sequence(store), Cursor(seeds)
        flip = self.codes - 1 if want else 0
        tail, pushed = np.zeros(self.codes, np.uint8), np.full(self.codes, -1, np.int32)
        least = np.full(1 << 10, FAR, np.uint8)  # of the common prefixes from each round on
        rounds, before = 0, (-1, -1, 0)  # code, kind and place of the last tuple
        text, types, depth = self.text, self.types, self.depth

        def predecessors(items: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Which tuples yield one, its place and its code."""
            at = (items[1] >> 8) - 1
            keep = (at >= 0) & (types[at] == want)  # -1 is the last place, and dropped
            from_ = np.nonzero(keep)[0]
            at = at[from_]
            code = text[at].astype(np.int64)
            return from_, at, flip - code if flip else code

        def settle(items: np.ndarray, kinds: np.ndarray | int, yields) -> np.ndarray:
            """Take tuples in order; returns what they yield."""
            nonlocal rounds, before, least
            code, m = items[0], items.shape[1]
            prefix = (items[1] & 255).astype(np.uint8)
            prefix[1:][code[1:] != code[:-1]] = 0
            if isinstance(kinds, int):  # all of one kind
                turn = []
                last_kind = kinds
            else:
                turn = (np.nonzero((code[1:] == code[:-1]) & (kinds[1:] != kinds[:-1]))[0] + 1).tolist()
                last_kind = int(kinds[-1])
            first_kind = kinds if isinstance(kinds, int) else int(kinds[0])
            if int(code[0]) != before[0]:
                prefix[0] = 0
            elif first_kind != before[1]:
                turn = [0, *turn]
            if turn:
                if exact:
                    at = items[1] >> 8
                    ends = np.array([before[2] if k == 0 else at[k - 1] for k in turn])
                    prefix[turn] = self.extend(ends, at[turn], np.ones(len(turn), np.int64))
                else:
                    prefix[turn] = 1
            before = (int(code[-1]), last_kind, int(items[1, -1] >> 8))
            if isinstance(kinds, int):
                if not kinds:
                    out.put(items)
            else:
                out.put(items[:, kinds == 0])
            from_, place, to = yields
            if rounds >= len(least):
                least = np.concatenate([least, np.full(len(least), FAR, np.uint8)])
            made = NONE
            if len(from_):
                order = np.argsort(to, kind="stable")
                c, f = to[order], from_[order]
                first = np.empty(len(c), bool)
                first[0], first[1:] = True, c[1:] != c[:-1]
                heads, rest = np.nonzero(first)[0], np.nonzero(~first)[0]
                value = np.empty(len(c), np.int64)
                new, known = c[heads], pushed[c[heads]]
                so_far = np.minimum.accumulate(prefix)[f[heads]]
                value[heads] = np.where(known >= 0, np.minimum(np.minimum(tail[new], least[np.minimum(known + 1, rounds)]), so_far).astype(np.int64) + 1, 0)
                if len(rest):
                    value[rest] = range_least(prefix, f[rest - 1] + 1, f[rest]) + 1
                lcp = np.empty(len(c), np.int64)
                lcp[order] = np.minimum(value, depth)
                made = tuples(to, place, lcp)
                tails = np.full(m + 1, FAR, np.uint8)
                tails[:m] = np.minimum.accumulate(prefix[::-1])[::-1]
                final = np.append(heads[1:], len(c)) - 1
                tail[c[final]] = tails[f[final] + 1]
                pushed[c[final]] = rounds
            # Least values from each round on never fall, so only the last ones change.
            low = prefix.min()
            least[int(np.searchsorted(least[:rounds], low, "right")) : rounds + 1] = low
            rounds += 1
            return made

        def both(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            items = np.concatenate([p, q], axis=1)
            kinds = np.zeros(items.shape[1], np.int8)
            kinds[p.shape[1] :] = 1
            order = np.argsort(2 * items[0] + kinds, kind="stable")
            return items[:, order], kinds[order]

        if self.span == 1:
            for code in range(self.codes):
                while (block := queues.take(code)).shape[1]:
                    queues.put(settle(block, 0, predecessors(block)))
                while (block := cursor.below(code + 1, BLOCK)).shape[1]:
                    queues.put(settle(block, 1, predecessors(block)))
            out.flush()
            return out
        for start in range(0, self.codes, self.span):
            end = start + self.span
            pool, others = queues.below(end), cursor.below(end)
            while pool.shape[1] or others.shape[1]:
                items, kinds = both(pool, others)
                low = int(items[0, 0])
                yields = predecessors(items)
                near = yields[2][yields[2] < end]
                bound = int(near.min()) if len(near) else end
                if bound == low:  # a character that yields itself: its queue first, as long as it grows
                    taken = int(np.searchsorted(pool[0], low + 1))
                    pool = pool[:, taken:]
                else:
                    taken = int(np.searchsorted(items[0], bound))
                    pool, others = pool[:, int(np.searchsorted(pool[0], bound)) :], others[:, int(np.searchsorted(others[0], bound)) :]
                chosen = int(np.searchsorted(yields[0], taken))
                made = settle(items[:, :taken], kinds[:taken], tuple(x[:chosen] for x in yields))
                if len(near):
                    inside = made[0] < end
                    queues.put(made[:, ~inside])
                    pool = by_code(np.concatenate([pool, made[:, inside]], axis=1))
                else:
                    queues.put(made)
        out.flush()
        return out

    def induced(self, seeds: Iterator[np.ndarray], exact: bool) -> Iterator[np.ndarray]:
        """All suffixes but the last one in order, as tuples."""
        low = self.induce(seeds, 0, exact)
        top = self.codes - 1

        def turned(blocks: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
            for block in blocks:
                block[0] = top - block[0]
                yield block

        high = self.induce(turned(low.backwards()), 1, exact)
        smaller, larger = Cursor(low.read()), Cursor(turned(high.backwards()))
        before = (-1, -1, 0)
        step = 1 if self.span == 1 else max(1, int(self.codes * BLOCK / (4 * self.n)))
        for code in range(0, self.codes, step):
            p, q = smaller.below(code + step), larger.below(code + step)
            items = np.concatenate([p, q], axis=1)
            if not items.shape[1]:
                continue
            kinds = np.zeros(items.shape[1], np.int8)
            kinds[p.shape[1] :] = 1
            if step > 1:
                order = np.argsort(2 * items[0] + kinds, kind="stable")
                items, kinds = items[:, order], kinds[order]
            at, lcp = items[1] >> 8, items[1] & 255
            last = np.concatenate([[before[0]], items[0, :-1]])
            lcp[items[0] != last] = 0
            turn = np.nonzero((items[0] == last) & (kinds != np.concatenate([[before[1]], kinds[:-1]])))[0]
            if len(turn):
                lcp[turn] = self.extend(np.concatenate([[before[2]], at[:-1]])[turn], at[turn], np.ones(len(turn), np.int64)) if exact else 1
            before = (int(items[0, -1]), int(kinds[-1]), int(at[-1]))
            yield tuples(items[0], at, lcp)

    def by_position(self, stars: np.ndarray) -> Iterator[np.ndarray]:
        """Seeds of the first induction: by character, then place; those of one character are equal so far."""
        store = Store(self.folder, self.memory)
        queues = Queues(store, self.codes) if self.span == 1 else Runs(store)
        for a in range(0, len(stars), BLOCK):
            at = np.asarray(stars[a : a + BLOCK])
            queues.put(tuples(self.text[at], at, 1))
        for code in range(0, self.codes, self.span):
            if self.span > 1:
                yield queues.below(code + self.span)
            else:
                while (block := queues.take(code)).shape[1]:
                    yield block

    def seeds(self, stars: np.ndarray) -> Iterator[np.ndarray]:
        """The stars in the order of their suffixes, with common prefixes."""
        names, count = self.folder.array(len(stars), np.int64), 0
        ranked = Sequence(Store(self.folder, self.memory))
        size, passed = -1, FAR
        for items in self.all_but_last(self.induced(full(self.by_position(stars)), False)):
            at, lcp = items[1] >> 8, items[1] & 255
            chosen = np.nonzero((at > 0) & (self.types[at] == 1) & (self.types[np.maximum(at - 1, 0)] == 0))[0]
            if not len(chosen):
                passed = min(passed, int(lcp.min()))
                continue
            # The least common prefix since the star before.
            prefix = range_least(lcp.astype(np.uint8), np.concatenate([[0], chosen[:-1] + 1]), chosen)
            prefix[0] = min(prefix[0], passed)
            passed = int(lcp[chosen[-1] + 1 :].min()) if chosen[-1] + 1 < len(at) else FAR
            place = np.searchsorted(stars, at[chosen])
            after = np.minimum(place + 1, len(stars) - 1)
            sizes = np.minimum(np.where(place + 1 < len(stars), stars[after] + 1 - stars[place], 1), self.depth)
            same = (sizes == np.concatenate([[size], sizes[:-1]])) & (prefix >= sizes)
            name = count + np.cumsum(~same) - 1
            names[place] = name
            count, size = int(name[-1]) + 1, int(sizes[-1])
            ranked.put(tuples(items[0, chosen], at[chosen], np.minimum(prefix, self.depth)))
        if count == len(stars) or self.depth < 2:
            order = ((b[1] >> 8, b[1] & 255) for b in ranked.read())
        else:
            below = Level(names, count, min(self.depth // 2 + 2, FAR - 1), self.folder, self.memory)
            order = below.star_order(stars)
        last = -1
        for at, known in order:
            ends = np.concatenate([[last], at[:-1]])
            lcp = np.where(ends < 0, 0, self.extend(np.maximum(ends, 0), at, np.where(ends < 0, 0, known)))
            last = int(at[-1])
            yield tuples(self.text[at], at, lcp)

    def all_but_last(self, blocks: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
        """The last suffix, which is the smallest and induced by nothing, and all others."""
        yield tuples(np.zeros(1, np.int64), np.array([self.n - 1]), 0)
        yield from blocks

    def order(self) -> Iterator[np.ndarray]:
        """All suffixes in order, sorted by ``depth`` characters at least."""
        return self.all_but_last(self.induced(full(self.seeds(self.stars())), True) if self.n > 1 else iter(()))

    def in_memory(self) -> Iterator[np.ndarray]:
        """The same order for a reduced text that fits in memory, where the recursion ends: ranks of twice the length each round."""
        rank = np.array(self.text)
        covered, n = 1, self.n
        while covered < self.depth and int(rank.max()) + 1 < n:
            pair = rank * (n + 2)
            pair[:-covered] += rank[covered:] + 1
            order = np.argsort(pair)
            pair = pair[order]
            rank[order] = np.concatenate([[0], np.cumsum(pair[1:] != pair[:-1])])
            covered *= 2
        order = np.argsort(rank, kind="stable")
        lcp = np.zeros(n, np.int64)
        lcp[1:] = self.extend(order[:-1], order[1:], np.zeros(n - 1, np.int64))
        yield tuples(np.asarray(self.text)[order], order, lcp)

    def star_order(self, stars: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places in the text above in the order of this reduced one, and the characters that equal numbers in front of them cover."""
        for items in self.order() if self.n * IN_MEMORY > self.memory else self.in_memory():
            i = items[1] >> 8
            yield stars[i], stars[np.minimum(i + (items[1] & 255), len(stars) - 1)] - stars[i]


def full(blocks: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """Without empty blocks."""
    return (b for b in blocks if b.shape[1])


def range_least(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The least of ``values`` from ``begin`` to ``end``, both included, for many ranges that are not empty."""
    size = end - begin + 1
    out = np.full(len(begin), FAR, np.int64)
    table, width, power = values, 1, 0
    level = np.frexp(size.astype(float))[1] - 1  # the power of two within
    while True:
        own = np.nonzero(level == power)[0]
        if len(own):
            out[own] = np.minimum(table[begin[own]], table[end[own] - width + 1])
        if power >= (level.max() if len(level) else 0):
            return out
        table = np.minimum(table[:-width], table[width:])
        width, power = 2 * width, power + 1


def suffix_order(text: np.ndarray, depth: int, memory: int | None = None, folder: Folder | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of suffix places, sorted by their first ``depth`` characters at least, and their common prefixes with the one before, up to the depth.

    ``text``: uint16 codes, mapped or not, that end with the only 0.
    """
    own = folder or Folder()
    try:
        for items in Level(text, CODES, min(depth, FAR - 1), own, MEMORY if memory is None else memory).order():
            yield items[1] >> 8, items[1] & 255
    finally:
        if folder is None:
            own.close()
