"""Adaptive context-mixing range coder for token ids, over many independently reset blocks at once.

Order 2 and order 1 each predict one id: the one last seen after the same two ids, or the same one. Order 0 gives each id
that the block has had a share by its adaptive frequency, and an escape to any 16-bit id. The three are mixed: the weights
of order 2 and order 1 are learnt from every id, apart for each pair of confidences that the two predictions have and for
whether they agree; what is left goes to order 0. So an id is one stretch of WHOLE parts, and one step of a block's range
coder codes it. Everything is integer arithmetic, so all machines decode alike.

Blocks are the lanes of numpy arrays: step t codes the t-th id of every block, so no Python loop runs over single ids. Order 2
and order 1 are two rows of the same arrays. Weights and the shares of order 0 are brought up to date at a refresh, so that
both are found by one look at a table. All lanes take the same steps: one that hits takes the whole of order 0, which is the
first entry of its table. The coder keeps 60 bits and moves them by digits of 20; carries are added to the digits when a
block ends.
"""

from __future__ import annotations

import numpy as np

#: Contexts that an order remembers, and ids that order 0 can hold, in a block (powers of two).
SLOTS, HELD = 128, 512
#: Steps between two refreshes; the first ones double. The sums at which frequencies of ids and of hits are halved.
REFRESH, FIRST, MOST, RECENT = 512, 32, 4096, 512
#: A prediction that isn't there, above every id.
NOTHING = 1 << 16
#: A stretch of one part leaves a span of at least 1 << DIGIT + TOP - WHOLE, so one digit is enough to fill it up.
DIGIT, TOP, FULL = 28, 28, 1 << 56
LOW = (1 << TOP) - 1
#: Weights and shares are parts of 4096 each, so a stretch is counted in parts of both.
BITS = 12
PARTS = 1 << BITS
WHOLE = 2 * BITS
#: Moves a hash so that it counts even slots; the odd ones beside them are order 2's.
SHIFT, EVEN = np.uint32(32 - SLOTS.bit_length()), np.uint32((1 << 32) - 2)
CERTAIN, SURE = 2, 3
#: Pairs of confidences, with and without agreement. What a miss, a hit of order 1 and a hit of order 2 are called, and
#: where a table keeps the ends of both hits.
STATES, MISS, ONE, TWO, ENDS = 2 * (SURE + 1) ** 2, 0, 1, 2, 3
#: Hits that the first weights stand for.
PRIOR = 24


def _prior() -> np.ndarray:
    """First frequencies of misses and of hits of order 1 and 2, by agreement and the confidences of order 2 and order 1."""
    same, two, one = np.meshgrid([0, 1], np.arange(SURE + 1), np.arange(SURE + 1), indexing="ij")
    chance = lambda sure: np.where(sure > 0, sure / (sure + 3.0), 0.0)
    second = np.where(same > 0, chance(np.maximum(two, one)), chance(two) * 0.8).reshape(-1)
    first = np.where(same > 0, 0.0, chance(one) * 0.3).reshape(-1) * (1 - second)
    return np.rint(np.stack((1 - second - first, first, second, np.zeros(STATES)), axis=1) * PRIOR).astype(np.int32)


class _Model:
    """What all lanes have learnt; prediction and update are the same in coding and decoding."""

    def __init__(self, lanes: int, looks: bool) -> None:
        lane = np.arange(lanes, dtype=np.int64)
        self.slots = lane * (2 * SLOTS)
        self.states, self.rows, self.parts = lane * (4 * STATES), lane * HELD + 1, lane * PARTS
        self.last = np.zeros(lanes, np.uint32)  # hash of the last id
        self.context = np.array([[1], [0]], np.uint32).repeat(lanes, axis=1)  # slots of the last two ids, and of the last
        self.seen = np.full(2 * lanes * SLOTS, NOTHING << CERTAIN, np.int32)  # id and confidence
        self.tally = np.tile(_prior(), (lanes, 1, 1)).reshape(lanes, STATES, 4)
        #: For each outcome of a state its first part of WHOLE, and how often it takes a part of order 0.
        self.weight = np.zeros((lanes, STATES, 4), np.int32)
        #: Order 0 by place: the escape is the first, ids follow in the order in which they came.
        self.known = np.ones(lanes, np.uint16)
        self.counts = np.zeros((lanes, HELD), np.int32)
        self.counts[:, 0] = 1
        self.ids = np.zeros((lanes, HELD), np.uint16)
        #: Where a place's parts begin and how many they are, 16 bits each, and above them its id, if it is looked for. All
        #: parts and no id come before the first.
        self.share = np.zeros(lanes * HELD + 1, np.int64 if looks else np.int32)
        self.share[0] = PARTS
        self.place = np.zeros((lanes if looks else 0, PARTS), np.uint16)  # of each part, if it is looked for
        self.outcomes: list[np.ndarray] = []
        self.coded: list[np.ndarray] = []
        self.escaped: list[np.ndarray] = []
        self.next = FIRST
        self._weigh(lanes)
        self._share(lanes)

    def refresh(self, n: int) -> None:
        """Takes up what was coded since the last refresh."""
        self.tally += np.bincount(np.concatenate(self.outcomes), minlength=self.tally.size).astype(np.int32).reshape(self.tally.shape)
        full = self.tally.sum(axis=2) > RECENT
        self.tally[full] = (self.tally[full] + 1) >> 1
        counts = np.bincount(np.concatenate(self.coded), minlength=self.counts.size + 1)[1:].astype(np.int32).reshape(self.counts.shape)
        counts[:, 0] = 0
        if self.escaped:
            # Lane and id; what came since the last refresh is taken up in the order of ids.
            distinct, times = np.unique(np.concatenate(self.escaped), return_counts=True)
            lane = distinct >> 16
            place = self.known[lane].astype(np.int64) + np.arange(len(lane)) - np.searchsorted(lane, lane)
            fits = place < HELD
            self.ids[lane[fits], place[fits]] = distinct[fits] & 0xFFFF
            counts[lane[fits], place[fits]] = times[fits]
            # What doesn't fit counts for the escape alone, others for both.
            counts[:, 0] = np.bincount(lane, weights=np.where(fits, times, 2 * times), minlength=len(counts))
            self.known = np.minimum(HELD, self.known + np.bincount(lane, minlength=len(self.known))).astype(np.uint16)
        self.outcomes, self.coded, self.escaped = [], [], []
        self.counts += counts
        full = np.flatnonzero(self.counts.sum(axis=1) > MOST)
        self.counts[full] = (self.counts[full] + 1) >> 1
        self._weigh(n)
        self._share(n)

    def _weigh(self, n: int) -> None:
        """Each outcome gets one part, and of the others by its frequency; what is left over goes to misses."""
        tally = self.tally[:n]
        total = tally.sum(axis=2, dtype=np.int32)
        two, one = (tally[:, :, i] * np.int32(PARTS - 3) // total + 1 for i in (TWO, ONE))
        ends = two + one
        weight = self.weight[:n]
        weight[:, :, TWO] = two
        weight[:, :, ONE] = two << BITS | one
        weight[:, :, MISS] = ends << BITS | PARTS - ends
        weight[:, :, ENDS] = two << 16 | ends

    def _share(self, n: int) -> None:
        """Each known place gets one part and its share, by frequency, of the others."""
        most = int(self.known[:n].max())
        known, counts = self.known[:n, None].astype(np.int32), self.counts[:n, :most]
        ends = np.cumsum(counts, axis=1, dtype=np.int32)
        ends *= PARTS - known
        ends //= ends[:, -1:] // (PARTS - known)
        ends += np.minimum(np.arange(1, most + 1, dtype=np.int32), known)
        widths = np.diff(ends, axis=1, prepend=np.int32(0))
        share = self.share[1:].reshape(-1, HELD)[:n, :most]
        np.subtract(ends, widths, out=share)
        share <<= 16
        share |= widths
        if len(self.place):
            share |= self.ids[:n, :most].astype(np.int64) << 32
            places = np.tile(np.arange(most, dtype=np.uint16), n)
            self.place[:n] = np.repeat(places, widths.reshape(-1)).reshape(n, PARTS)

    def due(self, t: int, n: int) -> None:
        if t == self.next:
            self.next = t + min(t, REFRESH)
            self.refresh(n)

    def predict(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of order 2 and of order 1, and where their state's weights are."""
        self.at = self.context[:, :n] + self.slots[:n]
        held = self.seen.take(self.at)
        self.sure = held & SURE
        both = held >> CERTAIN
        state = (both[0] == both[1]).astype(np.int32)
        for sure in self.sure:
            state *= SURE + 1
            state += sure
        state <<= 2
        return both, state + self.states[:n]

    def stretch(self, weight: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first part of an outcome within order 0's share, and how many parts it has."""
        times = weight & PARTS - 1
        start = share >> 16
        start *= times
        start += weight
        start -= times
        times *= share & 0xFFFF
        return start, times

    def update(self, n: int, ids: np.ndarray, hits: np.ndarray) -> None:
        """The ids take the place of what was predicted, surer where that hit."""
        sure = self.sure
        sure *= hits
        sure += 1
        np.minimum(sure, SURE, out=sure)
        sure |= ids << CERTAIN
        self.seen[self.at] = sure
        two, one, last = self.context[0, :n], self.context[1, :n], self.last[:n]
        np.right_shift(last, np.uint32(29), out=two)
        two |= np.uint32(1)
        np.multiply(ids.view(np.uint32), np.uint32(0x9E3779B1), out=last)
        np.right_shift(last, SHIFT, out=one)
        one &= EVEN
        two ^= one  # the same eight slots, so that they are near in memory


def _times(steps: int) -> np.ndarray:
    """The steps before which there is a refresh."""
    doubling = [t for t in (FIRST << i for i in range(32)) if t < min(steps, REFRESH)]
    return np.array([*doubling, *range(REFRESH, steps, REFRESH)], np.int64)


def _order(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lanes from the longest block, and how many are still at work at each step."""
    order = np.argsort(-sizes, kind="stable")
    return order, np.searchsorted(-sizes[order], -np.arange(sizes.max(initial=0)), side="left")


def _divided(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.view(np.uint64) // b.view(np.uint64)).view(np.int64)


def _places(block: np.ndarray, scratch: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The place in order 0 of each id of a block, from 1 in the order in which refreshes take them up."""
    at = np.arange(len(block), dtype=np.int32)
    block = block.astype(np.int64)
    scratch[block[::-1]] = at[::-1]
    first = scratch.take(block)
    fresh = np.flatnonzero(first == at)
    order = np.argsort(np.searchsorted(times, fresh, side="right") << 16 | block[fresh])
    at[fresh[order]] = np.arange(1, len(order) + 1)
    return at.take(first)


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    sizes = np.array([len(b) for b in blocks], np.int64)
    lanes, (order, working) = len(blocks), _order(sizes)
    ids, places = (np.zeros((lanes, sizes.max(initial=0)), np.uint16) for _ in range(2))
    scratch, times = np.zeros(NOTHING, np.int32), _times(len(working))
    for lane, block in enumerate(order):
        ids[lane, : sizes[block]] = blocks[block]
        places[lane, : sizes[block]] = np.minimum(_places(blocks[block], scratch, times), HELD)
    ids, places = np.ascontiguousarray(ids.T), np.ascontiguousarray(places.T)
    if not len(ids):
        return [b""] * lanes
    model = _Model(lanes, looks=False)
    weights = model.weight.reshape(-1)
    low, span = np.zeros(lanes, np.int64), np.full(lanes, FULL, np.int64)
    width = len(ids) + 2  # an id takes a digit at most
    digits, own = np.zeros(lanes * width, np.uint32), np.arange(lanes) * width
    used = own.copy()
    escaped: list[np.ndarray] = []

    def put(n: int) -> None:
        go = np.flatnonzero(span[:n] < 1 << TOP)
        at, lo = used.take(go), low.take(go)
        digits[at] = lo >> TOP
        lo &= LOW
        lo <<= DIGIT
        low[go] = lo
        span[go] = span.take(go) << DIGIT
        at += 1
        used[go] = at

    for t, n in enumerate(working.tolist()):
        model.due(t, n)
        now = ids[t, :n].astype(np.int32)
        both, state = model.predict(n)
        hits = both == now
        hit = hits[0] | hits[1]
        miss = ~hit
        outcome = state + (hits[0].view(np.uint8) + hit.view(np.uint8))
        place = places[t, :n] * (places[t, :n] < model.known[:n])
        at = place + model.rows[:n]
        at *= miss
        start, width = model.stretch(weights.take(outcome), model.share.take(at))
        model.outcomes.append(outcome)
        model.coded.append(at)
        step = span[:n] >> WHOLE
        low[:n] += start * step
        np.multiply(step, width, out=span[:n])
        new = np.flatnonzero((place == 0) & miss)
        if len(new):
            escaped.append((new << 16 | now.take(new)).astype(np.int32))
            model.escaped.append(escaped[-1])
        put(n)
        model.update(n, now, hits)
    for _ in range(FULL.bit_length() // DIGIT):
        digits[used] = low >> TOP
        low = (low & LOW) << DIGIT
        used += 1
    lengths = used - own
    events = np.concatenate(escaped)
    events = events[np.argsort((events >> 16).astype(np.uint16), kind="stable")]
    return _packed(np.ascontiguousarray(digits.reshape(lanes, -1)[:, : lengths.max() + 1].T), lengths, np.split(events.astype("<u2"), np.searchsorted(events >> 16, np.arange(1, lanes))), order)


def _packed(digits: np.ndarray, lengths: np.ndarray, escaped: list[np.ndarray], order: np.ndarray) -> list[bytes]:
    """The bytes of each block: how many ids escaped, these ids, and seven for two digits, once carries are added to the
    digits before."""
    carry = np.zeros(digits.shape[1], np.uint32)
    for row in digits[::-1]:
        row += carry
        carry = row >> np.uint32(DIGIT)
        row &= np.uint32((1 << DIGIT) - 1)
    digits = digits[: len(digits) // 2 * 2].astype(np.int64)
    pairs = np.ascontiguousarray(((digits[::2] << DIGIT) | digits[1::2]).T).astype(">u8")
    data = pairs.view(np.uint8).reshape(*pairs.shape, 8)[:, :, 1:]
    done: list[bytes] = [b""] * len(lengths)
    for lane, block in enumerate(order):
        done[block] = b"".join((len(escaped[lane]).to_bytes(4, "little"), escaped[lane].tobytes(), data[lane, : (lengths[lane] + 1) // 2].tobytes()))
    return done


def _unpacked(coded: list[bytes], order: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, int]:
    """The ids that escaped from each lane, the digits of all lanes, flat, and how many a lane has."""
    escaped = [np.frombuffer(coded[block], "<u2", int.from_bytes(coded[block][:4], "little"), 4) for block in order]
    parts = [np.frombuffer(coded[block], np.uint8, offset=4 + 2 * len(e)).reshape(-1, 7) for block, e in zip(order, escaped, strict=True)]
    pairs = max(map(len, parts), default=0) + 2
    data = np.zeros((len(coded), pairs, 8), np.uint8)
    for lane, part in enumerate(parts):
        data[lane, : len(part), 1:] = part
    both = data.view(">u8")[:, :, 0].astype(np.int64)
    return escaped, np.stack((both >> DIGIT, both & (1 << DIGIT) - 1), axis=2).reshape(-1), 2 * pairs


def decode(coded: list[bytes], sizes: np.ndarray) -> list[np.ndarray]:
    lanes, (order, working) = len(coded), _order(sizes)
    ids = np.zeros((len(working), lanes), np.uint16)
    if not len(ids):
        return [np.zeros(0, np.uint32)] * lanes
    escaped, data, width = _unpacked(coded, order)
    model = _Model(lanes, looks=True)
    weights, parts = model.weight.reshape(-1), model.place.reshape(-1)
    used, span, code = np.arange(lanes) * width, np.full(lanes, FULL, np.int64), np.zeros(lanes, np.int64)
    others, read = np.concatenate(escaped).astype(np.int64), np.cumsum([0, *map(len, escaped[:-1])])
    for _ in range(FULL.bit_length() // DIGIT):
        code = code << DIGIT | data[used]
        used += 1

    def take(n: int) -> None:
        go = np.flatnonzero(span[:n] < 1 << TOP)
        at, x = used.take(go), code.take(go)
        x <<= DIGIT
        x |= data.take(at)
        code[go] = x
        span[go] = span.take(go) << DIGIT
        at += 1
        used[go] = at

    for t, n in enumerate(working.tolist()):
        model.due(t, n)
        both, state = model.predict(n)
        ends = weights.take(state + ENDS)
        step, x = span[:n] >> WHOLE, code[:n]
        part = _divided(x, step)
        flag = part >> BITS
        is_two = flag < ends >> 16
        hit = flag < (ends & 0xFFFF)
        miss = ~hit
        outcome = state + (is_two.view(np.uint8) + hit.view(np.uint8))
        weight = weights.take(outcome)
        times = weight & PARTS - 1
        part -= weight - times  # below zero or of no account for hits
        part = _divided(part, times.astype(np.int64))
        part &= PARTS - 1
        part += model.parts[:n]
        place = parts.take(part)
        at = place + model.rows[:n]
        at *= miss
        share = model.share.take(at)
        start, width = model.stretch(weight, share.astype(np.int32))
        model.outcomes.append(outcome)
        model.coded.append(at)
        x -= start * step
        np.multiply(step, width, out=span[:n])
        now = (share >> 32).astype(np.int32)
        new = np.flatnonzero((place == 0) & miss)
        if len(new):
            at = read.take(new)
            other = others.take(at)
            at += 1
            read[new] = at
            model.escaped.append((new << 16 | other).astype(np.int32))
            now[new] = other
        now += both[0] * is_two
        now += both[1] * (hit ^ is_two)
        take(n)
        model.update(n, now, both == now)
        ids[t, :n] = now
    done: list[np.ndarray] = [np.zeros(0, np.uint32)] * lanes
    ids = np.ascontiguousarray(ids.T)
    for lane, block in enumerate(order):
        done[block] = ids[lane, : sizes[block]].astype(np.uint32)
    return done
