"""Byte ranges of a pcap file: records found from any place in it, exactly as a reader from the start finds them.

A pcap file has no marks between records, so a task that begins in the middle looks for candidate record headers: places
whose captured length (up to a limit) and fraction of a second are possible. They are sought in a stretch as long as the
longest record, so a real header is among them, that ends as far before the given place. A candidate's chain leads from
record to record, and most chains soon meet the real one or break; the real one always holds. If all that hold come to the
same place, it is the real boundary. A chain that reads every header four bytes late often goes on beside it (its captured
length is the original one): it counts for nothing where the original lengths it reads aren't possible, and those of the
other chain are, over at least the length of the longest record. If chains still don't agree (payloads may hold whole
records), the search goes back, at last to the start of the file, and walks the records from there.

The stretches lie on a grid, so ranges that are read one after another and are smaller than a stretch look at the same one: its
chains are followed once, and each range finds its own first record among their places.
"""

from __future__ import annotations

import bisect
import struct
from collections.abc import Iterator

# fixed values: pcap magic numbers -> (byte order, timestamp divisor to µs)
MAGIC = {
    b"\xd4\xc3\xb2\xa1": ("<", 1), b"\xa1\xb2\xc3\xd4": (">", 1),
    b"\x4d\x3c\xb2\xa1": ("<", 1000), b"\xa1\xb2\x3c\x4d": (">", 1000),
}
#: Longest captured record that a search expects, unless the file's snap length is larger.
MAX_RECORD = 262_144
_HEADER, _RECORD = 24, 16
_CHUNK = 1 << 20
#: Longest stretch whose chains are kept for the ranges that follow.
_KEPT = 1 << 20


class _Chain:
    """The places of a chain, and where and how it goes on in another one (``into``) that it met."""

    def __init__(self):
        self.places: list[int] = []
        self.bad: list[int] = []  # unusual headers before each place
        self.into: _Chain | None = None
        self.holds, self.headers, self.unusual = False, 0, 0

    def at(self, start: int) -> _Chain:
        """The chain that holds the first place at or after ``start``."""
        chain = self
        while chain.into is not None and (not chain.places or start > chain.places[-1]):
            chain = chain.into
        return chain


class RecordFile:
    """Records of the first ``size`` bytes of an open random-access file (``read_at(n, at)``)."""

    def __init__(self, file, size: int, max_record: int = MAX_RECORD):
        self.file, self.size, self.at, self.held = file, size, 0, b""
        head = self._bytes(0, _HEADER)
        if head[:4] not in MAGIC:
            raise ValueError("not a pcap file")
        self.empty = len(head) < _HEADER
        self.order, self.div = MAGIC[head[:4]]
        self.record = struct.Struct(self.order + "IIII")
        snap, link = struct.unpack(self.order + "II", head[16:24]) if not self.empty else (0, 0)
        self.link = link & 0x0FFFFFFF
        self.limit = max(max_record, snap if snap <= 1 << 26 else 0)
        self.grid, self.chains = -1, []  # the last stretch that was looked at, and its chains
        self.walked = _HEADER  # a boundary that the walk from the start has come to

    def _bytes(self, at: int, n: int) -> bytes:
        n = max(0, min(n, self.size - at))
        if at < self.at or at + n > self.at + len(self.held):
            self.at, self.held = at, self.file.read_at(min(max(n, _CHUNK), self.size - at), at) if n else b""
        return self.held[at - self.at:at - self.at + n]

    def _plausible(self, sec: int, frac: int, caplen: int) -> bool:
        return caplen <= self.limit and frac < 1_000_000 * self.div and (caplen > 0 or sec > 0)

    def _usual(self, caplen: int, wirelen: int) -> bool:
        """What writers keep to: no more captured than there was, and no longer packet than a record may hold."""
        return caplen <= wirelen <= max(self.limit, MAX_RECORD)

    def _leads(self, at: int, stop: int) -> set[int]:
        """Where the chains of all possible headers in [at, stop) leave it; those that meet are one, those that break are none."""
        import numpy as np

        raw = self._bytes(at, stop - at + _RECORD - 1)
        n = len(raw) - _RECORD + 1
        if n <= 0:
            return set()
        word, here, then = np.dtype(np.uint32).newbyteorder(self.order), [], []
        for k in range(min(4, n)):  # the words at k, k + 4, k + 8, ...
            w = np.frombuffer(raw, word, (len(raw) - k) // 4, k)
            sec, frac, caplen = w[:-3], w[1:-2], w[2:-1]
            hit = np.flatnonzero((caplen <= self.limit) & (frac < 1_000_000 * self.div) & ((caplen > 0) | (sec > 0)))
            here.append(4 * hit + k)
            then.append(here[-1] + _RECORD + caplen[hit].astype(np.int64))
        here, then = np.concatenate(here), np.concatenate(then)
        order = np.argsort(-here)
        leave: dict[int, int] = {}
        for p, q in zip(here[order].tolist(), then[order].tolist()):
            if q >= stop - at:
                leave[p] = q
            elif q in leave:
                leave[p] = leave[q]
        return {at + q for q in leave.values()}

    def _agreed(self, leads: set[int], start: int, stop: int) -> int | None:
        """The one place at or after ``start`` that the chains from ``leads`` come to first, followed up to ``stop``; None if
        they don't agree. Chains that go on beside another one count for nothing if half their headers aren't usual and all of
        the other's are."""
        ways = [[p, p if p >= start else None, 0, 0] for p in sorted(leads)]  # place, first place from start on, headers, unusual ones
        done: list[list] = []
        while ways:
            base = min(w[0] for w in ways)
            end = min(base + _CHUNK, stop)
            raw = self._bytes(base, end - base + _RECORD) if base < stop else b""
            met: dict[int, tuple[list, int]] = {}  # places in this part: the chain that was there, its unusual headers up to there
            going = []
            for way in ways:
                at, found, n, bad = way
                while at < end and at - base + _RECORD <= len(raw):
                    other = met.get(at)
                    if other is not None and (at < start or other[0][1] == found):
                        other[0][3] -= max(0, other[1] - bad)
                        break
                    met[at] = way, bad
                    sec, frac, caplen, wirelen = self.record.unpack_from(raw, at - base)
                    if not self._plausible(sec, frac, caplen):
                        break
                    at, n, bad = at + _RECORD + caplen, n + 1, bad + (not self._usual(caplen, wirelen))
                    if found is None and at >= start:
                        found = at
                        way[1] = at
                else:
                    way[:] = at, found, n, bad
                    (going if at < stop and at + _RECORD <= self.size else done).append(way)
            ways = going
        places = {w[1] if w[1] is not None else self.size for w in done}
        if len(places) > 1:
            usual = {w[1] for w in done if w[2] and not w[3]}
            if len(usual) == 1 and all(w[1] in usual or 0 < w[2] <= 2 * w[3] for w in done):
                places = usual
        return places.pop() if len(places) == 1 else None

    def _follow(self, at: int) -> list[_Chain]:
        """The chains of the stretch at ``at`` that hold for three more."""
        reach = _RECORD + self.limit
        base, stop = at + reach, min(at + 4 * reach, self.size)
        raw = self._bytes(base, stop - base + _RECORD)
        met: dict[int, tuple[_Chain, int]] = {}  # the chain that was at a place, and how many it had before
        out = []
        for place in sorted(self._leads(at, base)):
            chain, bad, tail, tail_bad = _Chain(), 0, 0, 0
            while True:
                if place in met:
                    chain.into, n = met[place]
                    chain.holds = chain.into.holds
                    tail, tail_bad = chain.into.headers - n, chain.into.unusual - chain.into.bad[n]
                    break
                chain.places.append(place)
                chain.bad.append(bad)
                if place >= stop or place + _RECORD > self.size:
                    chain.holds = True
                    break
                met[place] = chain, len(chain.places) - 1
                sec, frac, caplen, wirelen = self.record.unpack_from(raw, place - base)
                if not self._plausible(sec, frac, caplen):
                    break
                place, bad = place + _RECORD + caplen, bad + (not self._usual(caplen, wirelen))
            own = len(chain.places) - (chain.into is None)
            chain.headers, chain.unusual = own + tail, bad + tail_bad
            if chain.holds:
                out.append(chain)
        return out

    def _shared(self, at: int, start: int) -> int | None:
        """:meth:`_agreed` for the stretch at ``at``, whose chains are kept for the next range."""
        if self.grid != at:
            self.grid, self.chains = at, self._follow(at)
        ways: dict[int, list[int]] = {}  # chains that have met before start are one, with the fewest unusual headers
        for chain in self.chains:
            own = chain.at(start)
            i = bisect.bisect_left(own.places, start)
            place = own.places[i] if i < len(own.places) else self.size
            way = ways.setdefault(id(own), [place, chain.headers, chain.unusual])
            if chain.unusual < way[2]:
                way[1:] = chain.headers, chain.unusual
        places = {w[0] for w in ways.values()}
        if len(places) > 1:
            usual = {w[0] for w in ways.values() if w[1] and not w[2]}
            if len(usual) == 1 and all(w[0] in usual or 0 < w[1] <= 2 * w[2] for w in ways.values()):
                places = usual
        return places.pop() if len(places) == 1 else None

    def boundary(self, start: int) -> int:
        """The first record boundary at or after ``start`` (``size`` or more: no record begins there)."""
        reach = _RECORD + self.limit
        # a record begins in any stretch of this length: one of the chains is the real one. Another stretch lies between, so
        # that a false header rarely leads over the place onto a real one
        at, back = min(start, self.size - reach) - 2 * reach, 4 * reach
        if at // reach * reach > _HEADER and reach <= _KEPT:
            found = self._shared(at // reach * reach, start)
            if found is not None:
                return found
        while at > _HEADER:
            found = self._agreed(self._leads(at, at + reach), start, min(max(start, at + reach) + reach, self.size))
            if found is not None:
                return found
            at, back = at - back, 2 * back
        here = self.walked if self.walked <= start else _HEADER
        while here < start:
            h = self._bytes(here, _RECORD)
            if len(h) < _RECORD:
                return self.size
            here += _RECORD + self.record.unpack(h)[2]
        self.walked = here
        return here

    def records(self, start: int, stop: int) -> Iterator[tuple[int, int, int, int, bytes]]:
        """(end, ts_us, caplen, wirelen, frame) of the records that begin in [start, stop); a cut last one is left out."""
        at = self.boundary(start)
        while at < stop and not self.empty:
            h = self._bytes(at, _RECORD)
            if len(h) < _RECORD:
                return
            sec, frac, caplen, wirelen = self.record.unpack(h)
            end = at + _RECORD + caplen
            if end > self.size:
                return
            yield end, sec * 1_000_000 + frac // self.div, caplen, wirelen, self._bytes(at + _RECORD, caplen)
            at = end

    def arrived(self, seen: int, stop: int | None = None) -> Iterator[tuple[int, int, int, int, bytes]]:
        """Records that end beyond the first ``seen`` bytes, and by ``stop``: those that a file has gained since it had that size."""
        stop = self.size if stop is None else min(stop, self.size)
        for r in self.records(max(_HEADER, seen - _RECORD - self.limit), stop):
            if r[0] > stop:
                return
            if r[0] > seen:
                yield r
