"""Capture files (pcap, pcapng) as a Spark data source.

``spark.read.format("pcap").load(path_or_glob)`` returns the ``packets``
schema. Files are listed by Spark (any Hadoop file system) and read through
``pyarrow.fs``; a pcap file is cut into byte ranges of ``split_bytes``, each of
which finds its first record by itself (``sources.records``); a range is a task,
or several are where there are over ``TASKS``; a pcapng file is one task. Rows leave as Arrow batches, so memory per task is one batch,
never a whole file. Equality on protocol, addresses and capture and bounds on
the time are pushed into the scan and tested on header bytes before a row is
built. Decoding keeps IPv4 over Ethernet (with VLAN tags), loopback, Linux
cooked capture v1/v2 and raw IP link types; other frames are skipped.

``spark.readStream.format("pcap")`` (:func:`stream_captures`) finds new files
and what files have gained.

Fields: TCP header = data offset x 4 (0 -> 5 words), UDP / ICMP 8 bytes;
``header_len`` = IHL x 4 (0 -> 5 words) + L4 header; ``length`` = captured
record length (``wire_length`` keeps the original length).

:func:`write_captures` writes a packets table as capture files, several for a
large capture; all files in a folder ``capture_id=<id>`` are one capture.
"""

from __future__ import annotations

import struct
import urllib.parse
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialised
from .records import MAGIC, RecordFile

PCAP_SCHEMA = ("capture_id string, seq bigint, ts_us bigint, length int, wire_length int, proto int, "
               "src_ip string, dst_ip string, src_port int, dst_port int, header_len int, tcp_flags int")

# fixed values: link types
LINK_ETHERNET, LINK_RAW, LINK_RAW_ALT, LINK_SLL, LINK_SLL2 = 1, 101, 12, 113, 276
LINK_NULL, LINK_LOOP = 0, 108
# fixed values: pcapng block types, byte-order magic and option codes
NG_SECTION, NG_INTERFACE, NG_OLD_PACKET, NG_SIMPLE, NG_PACKET = 0x0A0D0D0A, 1, 2, 3, 6
NG_ORDER = {b"\x4d\x3c\x2b\x1a": "<", b"\x1a\x2b\x3c\x4d": ">"}
NG_TSRESOL, NG_TSOFFSET = 9, 14
#: Bytes of records that a writer puts together at once.
_PIECE = 1 << 24


def _ip_offset(link: int, frame: bytes) -> int | None:
    """Byte offset of the IPv4 header in a frame, or None when not IPv4."""
    if link == LINK_ETHERNET:
        off, etype = 14, frame[12:14]
        while etype in (b"\x81\x00", b"\x88\xa8") and len(frame) >= off + 4:
            etype, off = frame[off + 2:off + 4], off + 4
        return off if etype == b"\x08\x00" else None
    if link in (LINK_RAW, LINK_RAW_ALT):
        return 0
    if link in (LINK_NULL, LINK_LOOP):  # address family in the byte order of the capturing host
        return 4 if frame[:4] in (b"\x02\x00\x00\x00", b"\x00\x00\x00\x02") else None
    if link == LINK_SLL:
        return 16 if frame[14:16] == b"\x08\x00" else None
    if link == LINK_SLL2:
        return 20 if frame[0:2] == b"\x08\x00" else None
    return None


def decode_frame(link: int, frame: bytes):
    """One frame -> (proto, src, dst, sport, dport, header_len, flags) or None."""
    off = _ip_offset(link, frame)
    if off is None or len(frame) < off + 20 or frame[off] >> 4 != 4:
        return None
    ihl = (frame[off] & 0x0F) * 4 or 20
    proto = frame[off + 9]
    src = ".".join(str(b) for b in frame[off + 12:off + 16])
    dst = ".".join(str(b) for b in frame[off + 16:off + 20])
    l4 = off + ihl
    sport = dport = flags = l4len = 0
    later = (frame[off + 6] & 0x1F) | frame[off + 7]  # a later fragment has no transport header
    if later:
        return proto, src, dst, 0, 0, ihl, 0
    if proto == 6 and len(frame) >= l4 + 14:
        sport, dport = struct.unpack(">HH", frame[l4:l4 + 4])
        l4len = (frame[l4 + 12] >> 4) * 4 or 20
        flags = ((frame[l4 + 12] & 1) << 8) | frame[l4 + 13]
    elif proto == 17 and len(frame) >= l4 + 4:
        sport, dport = struct.unpack(">HH", frame[l4:l4 + 4])
        l4len = 8
    elif proto == 1:
        l4len = 8
    return proto, src, dst, sport, dport, ihl + l4len, flags


def _dotted(address: np.ndarray) -> pa.Array:
    """Dotted addresses of 32-bit numbers; one that comes again is written once."""
    each, at = np.unique(address, return_inverse=True)
    return pa.array([".".join(map(str, x)) for x in each.astype(">u4").view(np.uint8).reshape(-1, 4).tolist()], pa.string()).take(pa.array(at))


def decode_frames(links: list[int], frames: list[bytes]) -> tuple[np.ndarray, list[pa.Array]]:
    """:func:`decode_frame` of many frames: which of them are IPv4, and their seven columns."""
    link, size = np.array(links, np.int64), np.array([len(f) for f in frames], np.int64)
    start = np.cumsum(size) - size
    raw = np.frombuffer(b"".join([*frames, bytes(64)]), np.uint8)
    one = lambda at: raw[at].astype(np.int64)
    two = lambda at: one(at) << 8 | raw[at + 1]
    off = np.full(len(size), -1)
    eth = np.flatnonzero((link == LINK_ETHERNET) & (size >= 14))
    kind, at = two(start[eth] + 12), np.full(len(eth), 14)
    while len(tag := np.flatnonzero(((kind == 0x8100) | (kind == 0x88A8)) & (size[eth] >= at + 4))):
        kind[tag] = two(start[eth[tag]] + at[tag] + 2)
        at[tag] += 4
    off[eth] = np.where(kind == 0x0800, at, -1)
    off[(link == LINK_RAW) | (link == LINK_RAW_ALT)] = 0
    loop = np.flatnonzero(((link == LINK_NULL) | (link == LINK_LOOP)) & (size >= 4))
    family = two(start[loop]) << 16 | two(start[loop] + 2)
    off[loop] = np.where((family == 2) | (family == 0x02000000), 4, -1)
    for of, where, then in ((LINK_SLL, 14, 16), (LINK_SLL2, 0, 20)):
        sll = np.flatnonzero((link == of) & (size >= where + 2))
        off[sll] = np.where(two(start[sll] + where) == 0x0800, then, -1)
    good = (off >= 0) & (size >= off + 20)
    good[good] = raw[(start + off)[good]] >> 4 == 4
    ip, room = (start + off)[good], (size - off)[good]
    ihl = (one(ip) & 0x0F) * 4
    ihl[ihl == 0] = 20
    proto, whole = one(ip + 9), (raw[ip + 6] & 0x1F | raw[ip + 7]) == 0  # a later fragment has no transport header
    sport, dport, flags, l4len = np.zeros((4, len(ip)), np.int64)
    tcp, udp = whole & (proto == 6) & (room >= ihl + 14), whole & (proto == 17) & (room >= ihl + 4)
    ports, l4 = tcp | udp, ip + ihl
    sport[ports], dport[ports] = two(l4[ports]), two(l4[ports] + 2)
    words = one(l4[tcp] + 12)
    l4len[tcp], flags[tcp] = np.where(words >> 4, words >> 4, 5) * 4, (words & 1) << 8 | raw[l4[tcp] + 13]
    l4len[udp | whole & (proto == 1)] = 8
    src, dst = (two(ip + k) << 16 | two(ip + k + 2) for k in (12, 16))
    columns = [pa.array(c, pa.int32()) for c in (proto, sport, dport, ihl + l4len, flags)]
    return good, [columns[0], _dotted(src), _dotted(dst), *columns[1:]]


def _pcap_frames(head: bytes, stream):
    """(ts_us, caplen, wirelen, link, frame) of each pcap record; stops at a truncated last one."""
    head += stream.read(20)
    if len(head) < 24:
        return
    order, div = MAGIC[head[:4]]
    link = struct.unpack(order + "I", head[20:24])[0] & 0x0FFFFFFF
    rec = struct.Struct(order + "IIII")
    while len(h := stream.read(16)) == 16:
        sec, frac, caplen, wirelen = rec.unpack(h)
        frame = stream.read(caplen)
        if len(frame) < caplen:
            return
        yield sec * 1_000_000 + frac // div, caplen, wirelen, link, frame


def _interface(order: str, body: bytes) -> tuple[int, int, int, int]:
    """(link, snap length, ticks per second, offset in seconds) of an interface description."""
    link, _, snap = struct.unpack(order + "HHI", body[:8])
    ticks, offset, at = 1_000_000, 0, 8
    while at + 4 <= len(body):
        code, size = struct.unpack(order + "HH", body[at:at + 4])
        value = body[at + 4:at + 4 + size]
        if code == 0:
            break
        if code == NG_TSRESOL and size >= 1:
            ticks = 2 ** (value[0] & 0x7F) if value[0] & 0x80 else 10 ** value[0]
        elif code == NG_TSOFFSET and size >= 8:
            offset = struct.unpack(order + "q", value[:8])[0]
        at += 4 + (size + 3) // 4 * 4
    return link, snap, ticks, offset


def _pcapng_frames(head: bytes, stream):
    """As :func:`_pcap_frames` for pcapng. A simple packet block carries no time: its ``ts_us`` is 0."""
    order, faces, start = "<", [], head
    while len(start) == 4 and len(size_bytes := stream.read(4)) == 4:
        body = b""
        if start == b"\x0a\x0d\x0d\x0a":  # a new section sets the byte order and forgets the interfaces
            body = stream.read(4)
            if body not in NG_ORDER:
                return
            order, faces = NG_ORDER[body], []
        kind, size = struct.unpack(order + "I", start)[0], struct.unpack(order + "I", size_bytes)[0]
        want = size - 12 - len(body)
        if want < 0:
            return
        body += stream.read(want)
        if len(body) < size - 12 or len(stream.read(4)) < 4:
            return
        if kind == NG_INTERFACE and len(body) >= 8:
            faces.append(_interface(order, body))
        elif kind in (NG_PACKET, NG_OLD_PACKET) and len(body) >= 20:
            face, high, low, caplen, wirelen = struct.unpack(order + "IIIII", body[:20])
            if kind == NG_OLD_PACKET:
                face = struct.unpack(order + "H", body[:2])[0]
            if face < len(faces):
                link, _, ticks, offset = faces[face]
                ts_us = ((high << 32) | low) * 1_000_000 // ticks + offset * 1_000_000
                yield ts_us, caplen, wirelen, link, body[20:20 + caplen]
        elif kind == NG_SIMPLE and len(body) >= 4 and faces:
            wirelen = struct.unpack(order + "I", body[:4])[0]
            caplen = min(wirelen, faces[0][1] or wirelen, len(body) - 4)
            yield 0, caplen, wirelen, faces[0][0], body[4:4 + caplen]
        start = stream.read(4)


def iter_records(stream, batch_rows: int = 8192):
    """Yield lists of (seq, ts_us, caplen, wirelen, decoded) from a pcap or pcapng byte stream.

    Stops at a truncated last record. Raises ValueError on an unknown magic.
    """
    head = stream.read(4)
    if len(head) < 4:
        return
    if head == b"\x0a\x0d\x0d\x0a":
        frames = _pcapng_frames(head, stream)
    elif head in MAGIC:
        frames = _pcap_frames(head, stream)
    else:
        raise ValueError("neither a pcap nor a pcapng file")
    out = []
    for seq, (ts_us, caplen, wirelen, link, frame) in enumerate(frames):
        d = decode_frame(link, frame)
        if d is not None:
            out.append((seq, ts_us, caplen, wirelen, d))
            if len(out) >= batch_rows:
                yield out
                out = []
    if out:
        yield out


def encode_frame(length: int, proto: int, src: str, dst: str, sport: int, dport: int, header_len: int,
                 flags: int) -> bytes:
    """A raw IPv4 frame of ``length`` bytes that decodes to these fields; the payload is zeros.

    The IP header has no options; what ``header_len`` holds beyond it is the
    TCP header. A frame shorter than its headers is cut, as a snap length does.
    """
    l4 = b""
    if proto == 6:
        words = min(max((header_len - 20) // 4, 5), 15)
        l4 = struct.pack(">HHIIBBHHH", sport, dport, 0, 0, words << 4 | flags >> 8 & 1, flags & 0xFF, 0, 0, 0)
    elif proto == 17:
        l4 = struct.pack(">HHHH", sport, dport, max(length - 20, 8) & 0xFFFF, 0)
    address = bytes(int(x) for x in src.split(".")) + bytes(int(x) for x in dst.split("."))
    ip = struct.pack(">BBHHHBBH", 0x45, 0, min(length, 0xFFFF), 0, 0, 64, proto, 0) + address
    return (ip + l4)[:length].ljust(length, b"\x00")


def _octets(addresses: pa.Array) -> np.ndarray:
    """Four bytes of each dotted address; one that comes again is parsed once."""
    named = addresses.dictionary_encode()
    each = np.frombuffer(b"".join(bytes(int(x) for x in a.split(".")) for a in named.dictionary.to_pylist()), np.uint8)
    return each.reshape(len(named.dictionary), 4)[named.indices.to_numpy()]


def encode_records(batch: pa.RecordBatch) -> Iterator[tuple[memoryview, int, np.ndarray]]:
    """(bytes, first row, where each row's bytes end) of pcap records for rows of ``_WRITE_COLS``: a header of 16 bytes
    and :func:`encode_frame`'s frame for each. A piece has ``_PIECE`` bytes at most, or one row."""
    ts, length, wire, proto, sport, dport, header_len, flags = (
        batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
        for c in ("ts_us", "length", "wire_length", "proto", "src_port", "dst_port", "header_len", "tcp_flags"))
    if any(c.null_count for c in batch.columns):
        raise ValueError("a capture file can't hold nulls")
    sec, l4 = ts // 1_000_000, (proto == 6) | (proto == 17)
    for name, x, most in (("ts_us", sec, 0xFFFFFFFF), ("length", length, 0xFFFFFFFF), ("wire_length", wire, 0xFFFFFFFF), ("proto", proto, 255),
                          ("src_port", sport[l4], 0xFFFF), ("dst_port", dport[l4], 0xFFFF)):
        if len(x) and not (x.min() >= 0 and x.max() <= most):
            raise ValueError(f"a capture file can't hold {name} beyond 0 to {most}")
    head = np.zeros((len(ts), 56), np.uint8)  # of the record 16, IP 20, TCP 20 bytes
    head[:, :16] = np.stack([sec, ts % 1_000_000, length, wire], 1).astype("<u4").view(np.uint8)
    head[:, 16], head[:, 24], head[:, 25] = 0x45, 64, proto
    two = lambda x: x.astype(">u2").view(np.uint8).reshape(-1, 2)
    head[:, 18:20] = two(np.minimum(length, 0xFFFF))
    head[:, 28:32], head[:, 32:36] = _octets(batch.column("src_ip")), _octets(batch.column("dst_ip"))
    head[l4, 36:38], head[l4, 38:40] = two(sport[l4]), two(dport[l4])
    tcp, udp = proto == 6, proto == 17
    head[tcp, 48] = (np.clip((header_len - 20) // 4, 5, 15) << 4 | flags >> 8 & 1)[tcp]
    head[tcp, 49] = (flags & 0xFF)[tcp]
    head[udp, 40:42] = two((np.maximum(length - 20, 8) & 0xFFFF)[udp])
    end = np.cumsum(length + 16)
    first = 0
    while first < len(end):
        start = int(end[first - 1]) if first else 0
        stop = max(first + 1, int(np.searchsorted(end, start + _PIECE, "right")))
        out = np.zeros(int(end[stop - 1]) - start, np.uint8)
        held = np.arange(56) < np.minimum(length[first:stop], 40)[:, None] + 16
        at = (end[first:stop] - length[first:stop] - 16 - start)[:, None] + np.arange(56)
        out[at[held]] = head[first:stop][held]
        yield out.data, first, end[first:stop] - start
        first = stop


def _file_system(path: str):
    import pyarrow.fs as pafs

    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def _capture_of(path: str) -> str:
    """The id in the name of the folder ``capture_id=<id>``, or the file's base name."""
    folder, _, name = path.rpartition("/")
    last = folder.rpartition("/")[2]
    if last.startswith("capture_id="):
        return urllib.parse.unquote(last[len("capture_id="):])
    return name.rsplit(".", 1)[0]


class _Counted:
    """A stream that knows how many bytes were read."""

    def __init__(self, stream):
        self.stream, self.at = stream, 0

    def read(self, n: int) -> bytes:
        out = self.stream.read(n)
        self.at += len(out)
        return out


def file_records(fs, path: str, start: int, stop: int, seen: int = 0, step: int = 0, known: int = 0):
    """(end, ts_us, caplen, wirelen, link, frame) of a capture file's records, ``end`` the byte at which one ends.

    ``start`` and ``stop``: the range of bytes in which records begin (pcapng: the whole file). ``step``: it is read as
    ranges of so many bytes, each from a first record that it finds by itself. ``seen``: only records that end beyond it,
    and by ``stop``; ``known``: of a file that may grow, the bytes that are looked at (else those up to ``stop``).
    """
    with fs.open_input_file(path) as fh:
        size = fh.size()
        magic = fh.read_at(4, 0) if size >= 4 else b""
        if magic in MAGIC and seen:
            part = RecordFile(fh, min(size, known or stop))
            yield from ((e, t, c, w, part.link, f) for e, t, c, w, f in part.arrived(seen, stop))
        elif magic in MAGIC:
            whole = RecordFile(fh, size)
            for at in range(start, stop, step or max(stop - start, 1)):
                yield from ((e, t, c, w, whole.link, f) for e, t, c, w, f in whole.records(at, min(at + step, stop) if step else stop))
        elif magic == b"\x0a\x0d\x0d\x0a" and start == 0:
            stream = _Counted(fs.open_input_stream(path))
            for ts_us, caplen, wirelen, link, frame in _pcapng_frames(stream.read(4), stream):
                if stream.at > stop:
                    return
                if stream.at > seen:
                    yield stream.at, ts_us, caplen, wirelen, link, frame
        elif len(magic) == 4 and magic not in MAGIC and magic != b"\x0a\x0d\x0d\x0a":
            raise ValueError("neither a pcap nor a pcapng file")


class Wanted:
    """Filters of a scan, tested on a record's time and header bytes."""

    def __init__(self):
        self.captures = self.proto = self.src = self.dst = None
        self.low = self.high = None

    def add(self, column: str, kind: str, value) -> bool:
        """Take a filter (``in`` with a set, ``>=`` or ``<=`` with a number); False if it isn't one of ours."""
        sets = {"capture_id": "captures", "proto": "proto", "src_ip": "src", "dst_ip": "dst"}
        if kind == "in" and column in sets:
            name = sets[column]
            found = set(value) if getattr(self, name) is None else getattr(self, name) & set(value)
            setattr(self, name, found)
        elif kind == ">=" and column == "ts_us":
            self.low = value if self.low is None else max(self.low, value)
        elif kind == "<=" and column == "ts_us":
            self.high = value if self.high is None else min(self.high, value)
        else:
            return False
        return True

    def capture(self, capture_id: str) -> bool:
        return self.captures is None or capture_id in self.captures

    def record(self, ts_us: int, link: int, frame: bytes) -> bool:
        if (self.low is not None and ts_us < self.low) or (self.high is not None and ts_us > self.high):
            return False
        if self.proto is None and self.src is None and self.dst is None:
            return True
        off = _ip_offset(link, frame)
        if off is None or len(frame) < off + 20:
            return False
        return ((self.proto is None or frame[off + 9] in self.proto)
                and (self.src is None or ".".join(map(str, frame[off + 12:off + 16])) in self.src)
                and (self.dst is None or ".".join(map(str, frame[off + 16:off + 20])) in self.dst))


try:  # the Python data source API (Spark 4)
    from pyspark.sql.datasource import (
        DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualNullSafe, EqualTo, GreaterThan,
        GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage)

    class _Range(InputPartition):
        """Bytes of a file, in ranges of ``step``; ``seen``: what other ranges or micro-batches read of it, of ``size`` bytes."""

        def __init__(self, path: str, capture_id: str, index: int, start: int, stop: int, seen: int = 0, step: int = 0, size: int = 0):
            super().__init__(path)
            self.size = size
            self.path, self.capture_id, self.index = path, capture_id, index
            self.start, self.stop, self.seen, self.step = start, stop, seen, step

    def _batches(partition: _Range, wanted: Wanted, batch_rows: int = 8192):
        names = ["capture_id", "seq", "ts_us", "length", "wire_length", "proto", "src_ip", "dst_ip",
                 "src_port", "dst_port", "header_len", "tcp_flags"]
        fs, path = _file_system(partition.path)
        base, rows, held = partition.index << 40, [], 0

        def batch(rows):
            end, ts_us, caplen, wirelen, links, frames = zip(*rows)
            good, columns = decode_frames(links, frames)
            kept = lambda c, t: pa.array(np.array(c, np.int64)[good], t)
            return pa.RecordBatch.from_arrays(
                [pa.array([partition.capture_id] * len(columns[0]), pa.string()), pa.array(base + np.array(end, np.int64)[good], pa.int64()),
                 kept(ts_us, pa.int64()), kept(caplen, pa.int32()), kept(wirelen, pa.int32()), *columns], names=names)

        for r in file_records(fs, path, partition.start, partition.stop, partition.seen, partition.step, partition.size):
            if wanted.record(r[1], r[4], r[5]):
                rows.append(r)
                held += len(r[5])
                if len(rows) >= batch_rows or held >= _PIECE:
                    yield batch(rows)
                    rows, held = [], 0
        if rows:
            yield batch(rows)

    class PcapReader(DataSourceReader):
        def __init__(self, options: dict):
            self.files = [f.rsplit("\t", 1) for f in options.get("files", "").split("\n") if f]
            self.capture = options.get("capture_id")
            self.split_bytes = int(options.get("split_bytes", SPLIT_BYTES))
            self.wanted = Wanted()

        def pushFilters(self, filters):
            for f in filters:
                path = getattr(f, "attribute", ())  # a negation has none
                column = path[0] if len(path) == 1 else None
                if isinstance(f, (EqualTo, EqualNullSafe)) and f.value is not None:
                    taken = (self.wanted.add(column, "in", [f.value]) if column != "ts_us" else
                             self.wanted.add(column, ">=", f.value) and self.wanted.add(column, "<=", f.value))
                elif isinstance(f, In):
                    taken = self.wanted.add(column, "in", f.value)
                elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    taken = self.wanted.add(column, ">=", f.value + isinstance(f, GreaterThan))
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    taken = self.wanted.add(column, "<=", f.value - isinstance(f, LessThan))
                else:
                    taken = column is not None and isinstance(f, IsNotNull)  # no column of a record is null
                if not taken:
                    yield f

        def partitions(self):
            # records of a capture are numbered over its files, in the order of their names
            out, count = [], {}
            # beyond TASKS ranges a task reads several that follow each other, of SPLIT_BYTES at most
            split = max(self.split_bytes, 1)
            several = max(1, min(-(-sum(int(n) for _, n in self.files) // split // TASKS), SPLIT_BYTES // split))
            for f, size in self.files:
                cid, size = self.capture or _capture_of(f), int(size)
                index = count.setdefault(cid, 0)
                count[cid] += 1
                whole = self.split_bytes <= 0 or f.endswith("ng")
                step, each = (size, 0) if whole else (several * split, split)
                if self.wanted.capture(cid):
                    out += [_Range(f, cid, index, at, min(at + step, size), step=each) for at in range(0, size, max(step, 1))]
            return out

        def read(self, partition):
            if partition is None:  # Spark's single partition for an empty file list
                return
            yield from _batches(partition, self.wanted)

    class PcapStreamReader(DataSourceStreamReader):
        """Offsets: by file its number within the capture and the bytes that were there.

        A micro-batch reads the records that ended in what files gained since the last one; a record that is written in
        part waits for the rest. What a pcap file gained is cut into ranges of ``split_bytes``, a task each: a record is of
        the range in which it ends.
        """

        def __init__(self, options: dict):
            self.split_bytes = int(options.get("split_bytes", SPLIT_BYTES))
            self.path, self.capture = options["path"], options.get("capture_id")
            self.known: dict[str, list[int]] = {}

        def initialOffset(self):
            return {"files": {}}

        def _listed(self) -> dict[str, int]:
            import pyarrow.fs as pafs

            fs, root = _file_system(self.path)
            prefix = self.path[:len(self.path) - len(root)] if self.path.endswith(root) else ""
            selector = pafs.FileSelector(root, recursive=True, allow_not_found=True)
            hidden = lambda p: any(x[:1] in "._" and x for x in p[len(root):].split("/"))
            return {prefix + i.path: i.size for i in fs.get_file_info(selector) if i.is_file and not hidden(i.path)}

        def latestOffset(self):
            count: dict[str, int] = {}
            for f in self.known:
                cid = self.capture or _capture_of(f)
                count[cid] = count.get(cid, 0) + 1
            for f, size in sorted(self._listed().items()):
                if f in self.known:
                    self.known[f][1] = max(self.known[f][1], size)
                elif size >= 24:
                    cid = self.capture or _capture_of(f)
                    self.known[f] = [count.get(cid, 0), size]
                    count[cid] = self.known[f][0] + 1
            return {"files": {f: list(v) for f, v in self.known.items()}}

        def partitions(self, start, end):
            for f, v in end["files"].items():  # a restarted query takes up the numbers of its checkpoint
                if f not in self.known or self.known[f][1] < v[1]:
                    self.known[f] = list(v)
            out = []
            for f, (index, size) in end["files"].items():
                seen = start["files"].get(f, [0, 0])[1]
                step = size if self.split_bytes <= 0 or f.endswith("ng") else self.split_bytes
                out += [_Range(f, self.capture or _capture_of(f), index, 0, min(at + step, size), max(at, 1), size=size)
                        for at in range(seen, size, max(step, 1))]
            return out

        def read(self, partition):
            yield from _batches(partition, Wanted())

        def commit(self, end):
            pass

        def stop(self):
            pass

    class _Written(WriterCommitMessage):
        def __init__(self, files: list[tuple[str, str]]):
            self.files = files

    class PcapWriter(DataSourceArrowWriter):
        """A task writes its rows, sorted by capture, as one file for each capture under ``_temporary``;
        the files of successful attempts move into place when all tasks are done."""

        def __init__(self, path: str, columns: list[str]):
            self.path, self.columns = path.rstrip("/"), columns

        def write(self, batches):
            from pyspark import TaskContext

            part = TaskContext.get().partitionId()
            fs, root = _file_system(self.path)
            pending = f"{root}/_temporary/{uuid.uuid4().hex}"
            files, current, out = [], None, None
            try:
                for batch in batches:
                    batch = pa.RecordBatch.from_arrays(batch.columns, names=self.columns)
                    cids = batch.column("capture_id").to_pylist()
                    for records, first, ends in encode_records(batch):
                        own = cids[first:first + len(ends)]
                        cuts = [i for i in range(1, len(own)) if own[i] != own[i - 1]]
                        for i, j in zip([0, *cuts], [*cuts, len(own)], strict=True):
                            if out is None or own[i] != current:
                                if out is not None:
                                    out.close()
                                current, name = own[i], f"{pending}-{len(files)}.pcap"
                                folder = "capture_id=" + urllib.parse.quote(current, safe="")
                                files.append((name, f"{root}/{folder}/part-{part:08d}.pcap"))
                                fs.create_dir(f"{root}/_temporary", recursive=True)
                                out = fs.open_output_stream(name)
                                out.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 0x40000, LINK_RAW))
                            out.write(records[int(ends[i - 1]) if i else 0:int(ends[j - 1])])
            finally:
                if out is not None:
                    out.close()
            return _Written(files)

        def commit(self, messages):
            fs, root = _file_system(self.path)
            for name, final in (f for m in messages if m is not None for f in m.files):
                fs.create_dir(final.rpartition("/")[0], recursive=True)
                fs.move(name, final)

        def abort(self, messages):
            fs, root = _file_system(self.path)
            for name, _ in (f for m in messages if m is not None for f in m.files):
                fs.delete_file(name)

    class PcapDataSource(DataSource):
        @classmethod
        def name(cls):
            return "pcap"

        def schema(self):
            return PCAP_SCHEMA

        def reader(self, schema):
            return PcapReader(self.options)

        def streamReader(self, schema):
            return PcapStreamReader(self.options)

        def writer(self, schema, overwrite):
            return PcapWriter(self.options["path"], schema.fieldNames())

    HAVE_DATASOURCE = True
except ImportError:  # pragma: no cover - older Spark
    HAVE_DATASOURCE = False


#: Bytes of a pcap file that a task reads; ranges beyond which a task reads several smaller ones.
SPLIT_BYTES, TASKS = 128 << 20, 1024


def read_captures(spark: SparkSession, path: str, capture_id: str | None = None,
                  split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Decode capture files under ``path`` (file, folder or glob).

    ``capture_id``: one id for all files (one conversion run); default is the
    folder ``capture_id=<id>`` a file lies in, else the file's base name.
    ``seq`` orders the files of a capture by name, and records within a file:
    the file's number times 2^40 and the byte at which the record ends, the
    same for every ``split_bytes`` (0: a file is one task). Files are expected
    to have records of at most 256 KiB, or the file's snap length.

    Turns on Spark's filter pushdown for Python data sources, which is off by
    default, so that :func:`~flowlens.operators.analytics.filter_packets` and
    other predicates on these rows reach the scan.
    """
    if not HAVE_DATASOURCE:
        raise RuntimeError("the capture scan needs the Spark 4 Python data source API")
    # listing only: the binaryFile scan prunes the content column
    files = sorted(map(tuple, spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
                       .select("path", "length").collect()))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PcapDataSource)
    reader = spark.read.format("pcap").option("files", "\n".join(f"{f}\t{n}" for f, n in files)).option("split_bytes", split_bytes)
    if capture_id:
        reader = reader.option("capture_id", capture_id)
    return reader.load()


def stream_captures(spark: SparkSession, path: str, capture_id: str | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """S1 as a stream: the capture files in a folder, those that arrive later, and what they gain while they are written.

    Each micro-batch reads the records completed since the last one, so the rows over all batches are those of
    :func:`read_captures`, ``seq`` too where a capture's files arrive in the order of their names. A pcapng file that grew
    is walked from its start, its older records aren't decoded; of a pcap file a task reads ``split_bytes`` (0: all). Offsets name every file, as Spark's file source does.
    """
    if not HAVE_DATASOURCE:
        raise RuntimeError("the capture stream needs the Spark 4 Python data source API")
    spark.dataSource.register(PcapDataSource)
    reader = spark.readStream.format("pcap").option("split_bytes", split_bytes)
    return (reader.option("capture_id", capture_id) if capture_id else reader).load(path)


_WRITE_COLS = ["capture_id", "ts_us", "length", "wire_length", "proto", "src_ip", "dst_ip", "src_port", "dst_port",
               "header_len", "tcp_flags"]
_DOTTED = r"^((25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(25[0-5]|2[0-4]\d|1?\d?\d)$"


def write_captures(packets: DataFrame, path: str) -> None:
    """Write ``packets`` as pcap files (raw IPv4 frames), the inverse of :func:`read_captures`.

    Rows are ranged by (capture, time, sequence), so a large capture becomes
    several files whose names are in the order of time and no task holds a
    whole one. ``path`` is a new folder that driver and executors share. A
    capture file can't hold rows without time (0 to 2^32 seconds), dotted
    addresses or protocol, or shorter than an IP header: they are left out.
    Null ports, flags and header lengths are written as 0, a null length as
    20, a null capture as ``unknown``.
    """
    if not HAVE_DATASOURCE:
        raise RuntimeError("writing captures needs the Spark 4 Python data source API")
    length = F.coalesce(F.col("length"), F.lit(20))
    wire = F.coalesce(F.col("wire_length"), length) if "wire_length" in packets.columns else length
    cols = {"capture_id": F.coalesce("capture_id", F.lit("unknown")), "length": length.cast("int"),
            "wire_length": wire.cast("int")}
    cols |= {c: F.coalesce(F.col(c), F.lit(0)) for c in ("src_port", "dst_port", "header_len", "tcp_flags")}
    fits = (F.col("src_ip").rlike(_DOTTED) & F.col("dst_ip").rlike(_DOTTED) & F.col("proto").between(0, 255)
            & F.col("ts_us").between(0, (1 << 32) * 1_000_000 - 1) & (length >= 20))
    # a table of its own: ranges are found by a first pass over the rows, and a filter that Spark moves below what makes
    # the packets would work out each of their columns again for every condition
    named = [c for c in (*_WRITE_COLS, "seq") if c in packets.columns]
    rows = materialised(packets.select(*named), "packets").filter(fits).withColumns(cols).select(*_WRITE_COLS, "seq")
    packets.sparkSession.dataSource.register(PcapDataSource)
    (rows.repartitionByRange("capture_id", "ts_us", "seq").sortWithinPartitions("capture_id", "ts_us", "seq")
     .drop("seq").write.format("pcap").mode("append").save(path))
