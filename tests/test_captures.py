"""S1 capture decoding from bytes built in the test."""

import random
import struct

import numpy as np
import pyarrow as pa
import pytest

from flowlens.operators.analytics import filter_packets
import pyarrow.fs

from flowlens.sources.captures import (
    PcapReader, PcapStreamReader, Wanted, decode_frame, decode_frames, encode_frame, encode_records, file_records,
    iter_records, read_captures, stream_captures, write_captures)
from flowlens.sources.records import RecordFile

from helpers import packets, pk


def ipv4(proto, src, dst, payload):
    ver_ihl = bytes([0x45, 0, 0, 40]) + b"\x00\x00\x00\x00" + bytes([64, proto]) + b"\x00\x00"
    return ver_ihl + bytes(src) + bytes(dst) + payload


def tcp(sport, dport, flags, offset_words=5):
    return struct.pack(">HHIIBBHHH", sport, dport, 0, 0, offset_words << 4, flags, 0, 0, 0)


def eth(ip):
    return b"\x00" * 12 + b"\x08\x00" + ip


def pcap(records, order="<", nano=False, link=1, truncate=False):
    magic = 0xA1B23C4D if nano else 0xA1B2C3D4
    out = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, link)
    for ts_s, frac, frame in records:
        out += struct.pack(order + "IIII", ts_s, frac, len(frame), len(frame)) + frame
    if truncate:
        out += struct.pack(order + "IIII", 9, 0, 100, 100) + b"\x00" * 10
    return out


class _Stream:
    def __init__(self, b):
        self.b, self.i = b, 0

    def read(self, n):
        s = self.b[self.i:self.i + n]
        self.i += n
        return s


def test_decode_tcp_udp_and_skip_non_ip():
    t = eth(ipv4(6, [10, 0, 0, 1], [10, 0, 0, 2], tcp(1234, 80, 0x12)))
    u = eth(ipv4(17, [10, 0, 0, 3], [8, 8, 8, 8], struct.pack(">HHHH", 5353, 53, 8, 0)))
    arp = b"\x00" * 12 + b"\x08\x06" + b"\x00" * 28
    assert decode_frame(1, t) == (6, "10.0.0.1", "10.0.0.2", 1234, 80, 40, 0x12)
    assert decode_frame(1, u) == (17, "10.0.0.3", "8.8.8.8", 5353, 53, 28, 0)
    assert decode_frame(1, arp) is None


def test_byte_orders_nanoseconds_and_truncation():
    f = eth(ipv4(6, [10, 0, 0, 1], [10, 0, 0, 2], tcp(1, 2, 0x02)))
    for order in ("<", ">"):
        for nano in (False, True):
            frac = 5_000_000 if nano else 5_000
            data = pcap([(100, frac, f), (101, 0, b"\x00" * 12 + b"\x86\xdd" + b"\x00" * 40)], order, nano,
                        truncate=True)
            rows = [r for batch in iter_records(_Stream(data)) for r in batch]
            assert [(s, t) for s, t, *_ in rows] == [(0, 100_005_000)]


def test_read_captures_as_table(spark, tmp_path):
    f1 = eth(ipv4(6, [10, 0, 0, 1], [10, 0, 0, 2], tcp(1, 80, 0x02)))
    f2 = eth(ipv4(6, [10, 0, 0, 2], [10, 0, 0, 1], tcp(80, 1, 0x12)))
    (tmp_path / "cap.pcap").write_bytes(pcap([(1, 0, f1), (1, 10, f2)]))
    df = read_captures(spark, str(tmp_path / "*.pcap"))
    rows = sorted((r["seq"], r["capture_id"], r["ts_us"], r["src_port"], r["tcp_flags"]) for r in df.collect())
    first = 24 + 16 + len(f1)  # a record's seq is the byte at which it ends
    assert rows == [(first, "cap", 1_000_000, 1, 2), (first + 16 + len(f2), "cap", 1_000_010, 80, 18)]


def block(kind, body, order="<"):
    body += b"\x00" * (-len(body) % 4)
    return struct.pack(order + "II", kind, len(body) + 12) + body + struct.pack(order + "I", len(body) + 12)


def test_pcapng_sections_interfaces_and_time_units():
    f = eth(ipv4(6, [10, 0, 0, 1], [10, 0, 0, 2], tcp(1, 2, 0x02)))
    raw = ipv4(17, [10, 0, 0, 3], [8, 8, 8, 8], struct.pack(">HHHH", 5353, 53, 8, 0))
    for order in ("<", ">"):
        section = block(0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1), order)
        nano = struct.pack(order + "HHB3x", 9, 1, 9) + struct.pack(order + "HHq", 14, 8, 100) + b"\x00" * 4
        faces = (block(1, struct.pack(order + "HHI", 1, 0, 0), order)
                 + block(1, struct.pack(order + "HHI", 101, 0, 0) + nano, order))
        t = 7 << 32 | 5
        packets = (block(6, struct.pack(order + "IIIII", 0, t >> 32, t & 0xFFFFFFFF, len(f), 99) + f, order)
                   + block(5, b"\x00" * 8, order)
                   + block(6, struct.pack(order + "IIIII", 1, 0, 3_000, len(raw), len(raw)) + raw, order)
                   + block(3, struct.pack(order + "I", len(f)) + f, order))
        rows = [r for b in iter_records(_Stream(section + faces + packets + section + packets[:-3])) for r in b]
        assert [(s, ts, w) for s, ts, _, w, _ in rows] == [(0, t, 99), (1, 100_000_003, len(raw)), (2, 0, len(f))]
        assert rows[1][4] == (17, "10.0.0.3", "8.8.8.8", 5353, 53, 28, 0)


def test_records_of_columns_are_those_of_single_frames(monkeypatch):
    rng = np.random.default_rng(5)
    n = 3000
    proto = rng.choice([6, 17, 1, 47], n)
    rows = {"capture_id": ["c"] * n, "ts_us": rng.integers(0, (1 << 32) * 1_000_000, n), "length": rng.integers(1, 400, n),
            "wire_length": rng.integers(0, 1 << 32, n), "proto": proto,
            "src_ip": [f"{a}.0.255.{b}" for a, b in rng.integers(0, 256, (n, 2))], "dst_ip": [f"10.{a}.3.1" for a in rng.integers(0, 256, n)],
            "src_port": rng.integers(0, 65536, n), "dst_port": rng.integers(0, 65536, n), "header_len": rng.integers(0, 120, n),
            "tcp_flags": rng.integers(0, 512, n)}
    rows["length"][:4] = 65535, 65536, 70000, 20
    batch = pa.RecordBatch.from_pydict(rows)
    want = b"".join(struct.pack("<IIII", t // 1_000_000, t % 1_000_000, length, wire) + encode_frame(length, *frame)
                    for _, t, length, wire, *frame in zip(*(batch.column(c).to_pylist() for c in rows)))
    assert b"".join(bytes(b) for b, _, _ in encode_records(batch)) == want
    monkeypatch.setattr("flowlens.sources.captures._PIECE", 5000)
    pieces = [(bytes(b), first, ends) for b, first, ends in encode_records(batch)]
    assert b"".join(b for b, _, _ in pieces) == want and len(pieces) > 100
    assert [p[1] for p in pieces[1:]] == np.cumsum([len(p[2]) for p in pieces])[:-1].tolist() and all(len(b) == e[-1] for b, _, e in pieces)
    with pytest.raises(ValueError):
        list(encode_records(batch.set_column(7, "src_port", pa.array([70000] * n))))


def test_frames_decode_together_as_one_by_one():
    rng = random.Random(8)
    links, frames = [], []
    for _ in range(6000):
        proto = rng.choice([6, 6, 17, 1, 47])
        ip = bytearray(ipv4(proto, [10, 0, rng.randrange(3), rng.randrange(256)], rng.randbytes(4), rng.randbytes(rng.randrange(0, 60))))
        ip[0] = rng.choice([0x45, 0x45, 0x46, 0x4F, 0x40, 0x65])
        ip[6], ip[7] = rng.choice([(0, 0), (0, 0), (0x40, 0), (0x20, 1), (0, 9), (1, 0)])
        tags = b"".join(rng.choice([b"\x81\x00", b"\x88\xa8"]) + rng.randbytes(2) for _ in range(rng.choice([0, 0, 1, 2, 5])))
        kind = rng.choice([b"\x08\x00"] * 4 + [b"\x86\xdd"])
        link = rng.choice([1, 101, 12, 113, 276, 0, 108, 7])
        before = {1: rng.randbytes(12) + tags + kind, 113: rng.randbytes(14) + kind, 276: kind + rng.randbytes(18)}.get(
            link, rng.choice([b"\x02\x00\x00\x00", b"\x00\x00\x00\x02", b"\x1e\x00\x00\x00"]) if link in (0, 108) else b"")
        frame = before + bytes(ip)
        links.append(link), frames.append(frame[:rng.choice([len(frame), len(frame), rng.randrange(len(frame) + 1)])])
    want = [decode_frame(link, f) for link, f in zip(links, frames)]
    good, columns = decode_frames(links, frames)
    assert good.tolist() == [w is not None for w in want] and 2000 < good.sum() < 5000
    assert list(zip(*(c.to_pylist() for c in columns))) == [w for w in want if w is not None]
    none, columns = decode_frames([7, 1], [b"", b"x"])
    assert not none.any() and [len(c) for c in columns] == [0] * 7


def test_a_stream_reads_a_large_file_in_ranges(tmp_path):
    """A task for each range of what a file gained; every record comes from one of them, under the seq of the whole file."""
    path, data = tmp_path / "c.pcap", pcap(planted(90))
    whole = [r[0] for r in ranges_of(data)]
    reader = PcapStreamReader({"path": str(tmp_path), "split_bytes": "1000"})
    last, got, count = reader.initialOffset(), [], []
    for n in (len(data) // 2 + 3, len(data) - 30, len(data)):
        path.write_bytes(data[:n])
        now = reader.latestOffset()
        parts = reader.partitions(last, now)
        path.write_bytes(data)  # what comes later is of a later micro-batch
        got += [s for p in parts for b in reader.read(p) for s in b.column("seq").to_pylist()]
        count.append(len(parts))
        last = now
    assert sorted(got) == whole and len(set(got)) == len(got) == 90 and count[0] > 5
    one = PcapStreamReader({"path": str(tmp_path), "split_bytes": "0"})
    assert len(one.partitions(one.initialOffset(), one.latestOffset())) == 1


def ranges_of(data):
    class At:
        def read_at(self, n, at):
            return data[at:at + n]

    return list(RecordFile(At(), len(data)).records(0, len(data)))


def test_packets_are_made_once_for_their_files(spark, tmp_path):
    """Ranges of the files come from a pass over the rows: it reads the packets from a table."""
    made = spark.sparkContext.accumulator(0)

    def count(rows):
        for b in rows:
            made.add(b.num_rows)
            yield b

    p = packets(spark, [pk(i, i, capture=f"c{i % 3}", length=60 + i) for i in range(200)])
    write_captures(p.mapInArrow(count, p.schema), str(tmp_path / "out"))
    assert read_captures(spark, str(tmp_path / "out")).count() == 200 and made.value == 200


def test_pcapng_with_a_wrong_block_length_stops():
    section = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1))
    assert list(iter_records(_Stream(section + struct.pack("<II", 6, 3) + b"\x00" * 40))) == []


def test_loopback_frames():
    ip = ipv4(17, [127, 0, 0, 1], [127, 0, 0, 1], struct.pack(">HHHH", 1, 2, 8, 0))
    want = (17, "127.0.0.1", "127.0.0.1", 1, 2, 28, 0)
    assert decode_frame(0, b"\x02\x00\x00\x00" + ip) == decode_frame(108, b"\x00\x00\x00\x02" + ip) == want
    assert decode_frame(0, b"\x1e\x00\x00\x00" + ip) is None


def test_encoded_frames_decode_to_their_fields():
    for length, proto, sport, dport, header, flags in [(60, 6, 1, 65535, 52, 0x112), (40, 6, 0, 0, 40, 0),
                                                       (1500, 17, 53, 9, 28, 0), (28, 1, 0, 0, 28, 0),
                                                       (20, 47, 0, 0, 20, 0)]:
        frame = encode_frame(length, proto, "1.2.3.4", "255.0.0.9", sport, dport, header, flags)
        assert len(frame) == length
        assert decode_frame(101, frame) == (proto, "1.2.3.4", "255.0.0.9", sport, dport, header, flags)


def test_written_captures_read_back_in_order(spark, tmp_path):
    schema = ("seq long, capture_id string, ts_us long, length int, proto int, src_ip string, dst_ip string, "
              "src_port int, dst_port int, header_len int, tcp_flags int")
    rows = [(i, "a b/%41=é" if i % 3 else None, 5_000_000 - i // 2, 60, 6, "10.0.0.1", "10.0.0.2", i, 80, 40, 2)
            for i in range(400)]
    lost = [(900, "x", None, 60, 6, "10.0.0.1", "10.0.0.2", 1, 2, 40, 2), (901, "x", 1, 60, 6, None, "1.1.1.1", 1, 2, 40, 2),
            (902, "x", 1, 60, 6, "10.0.0.256", "1.1.1.1", 1, 2, 40, 2)]
    sparse = [(903, "y", 7, None, 17, "10.0.0.1", "10.0.0.2", None, None, None, None)]
    df = spark.createDataFrame(rows + lost + sparse, schema).repartition(7)
    write_captures(df, str(tmp_path / "out"))
    got = {}
    for r in sorted(read_captures(spark, str(tmp_path / "out")).collect(), key=lambda r: r["seq"]):
        got.setdefault(r["capture_id"], []).append((r["ts_us"], r["src_port"], r["length"]))
    want = {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        want.setdefault(r[1] or "unknown", []).append((r[2], r[7], 60))
    want["y"] = [(7, 0, 20)]
    assert got == want


def test_no_packets_write_no_captures(spark, tmp_path):
    schema = ("seq long, capture_id string, ts_us long, length int, proto int, src_ip string, dst_ip string, "
              "src_port int, dst_port int, header_len int, tcp_flags int")
    write_captures(spark.createDataFrame([], schema), str(tmp_path / "none"))
    (tmp_path / "none").mkdir(exist_ok=True)
    assert read_captures(spark, str(tmp_path / "none")).count() == 0


def planted(n=400, seed=1):
    """A capture whose payloads hold zeros, random bytes, single record headers, and whole captures with and without an end
    that meets the real records."""
    rng = random.Random(seed)
    inner = pcap([(5, 5, eth(ipv4(17, [9, 9, 9, 9], [8, 8, 8, 8], struct.pack(">HHHH", 1, 2, 8, 0)))) for _ in range(40)])
    out = []
    for k in range(n):
        pad = {0: b"\x00" * rng.randrange(900), 1: rng.randbytes(rng.randrange(900)), 2: inner[24:], 3: inner + b"xyz",
               4: struct.pack("<IIII", 1, 2, 30, 30) * rng.randrange(30), 5: b""}[rng.randrange(6)]
        out.append((100 + k, k, eth(ipv4(17, [10, 0, k % 7, 1], [10, 0, 0, 2], struct.pack(">HHHH", k, 53, 8, 0) + pad))))
    return out


def ranges(data, step, limit=4096):
    """The records of a file read in ranges of ``step`` bytes."""
    class At:
        def read_at(self, n, at):
            return data[at:at + n]

    return [r for lo in range(0, len(data), step) for r in RecordFile(At(), len(data), limit).records(lo, min(lo + step, len(data)))]


def test_any_split_gives_the_records_of_the_whole():
    data = pcap(planted(40))
    for tail in (data, data[:-5], data + b"\x01" * 9, data[:24], data[:10]):
        whole = ranges(tail, len(tail))
        assert len(whole) >= (39 if len(tail) > 24 else 0)
        for step in (1 << 14, 3000, 777):
            assert ranges(tail, step) == whole
    big = pcap(planted(20), ">", nano=True)
    assert ranges(big, 150) == ranges(big, len(big))


def test_a_range_far_into_a_file_is_found_nearby():
    """The search for a range's first record doesn't walk the file from its start; records without data are no obstacle."""
    frames = [encode_frame(40 + k * 37 % 700, (6, 17)[k % 2], "10.0.0.5", "10.0.2.9", 443, 40_000 + k % 16, 40, 16) for k in range(300)]
    records = [(1 + k // 900, k % 900 * 1100, b"" if k % 5000 == 9 else frames[k % 300]) for k in range(24_000)]
    data = pcap([]) + b"".join(pcap([r])[24:] for r in records)

    class At:
        count = 0

        def read_at(self, n, at):
            At.count += n
            return data[at:at + n]

    whole = ranges(data, len(data), 1 << 18)
    assert len(data) > 9 << 20 and len(whole) == 24_000
    begin = {r[0] - 16 - r[2]: r for r in whole}
    for start in (5 << 20, 7 << 20, (8 << 20) + 123):
        At.count = 0
        got = list(RecordFile(At(), len(data), 1 << 18).records(start, start + (1 << 14)))
        assert got == [r for at, r in begin.items() if start <= at < start + (1 << 14)] and At.count < 5 << 20


def test_many_ranges_are_few_tasks(tmp_path):
    path = tmp_path / "big.pcap"
    path.write_bytes(pcap(planted(150)))
    size = path.stat().st_size
    parts = PcapReader({"files": f"{path}\t{size}", "split_bytes": "20"}).partitions()
    assert 100 < len(parts) <= 1024 < size // 20
    assert [p.start for p in parts[1:]] == [p.stop for p in parts[:-1]] and (parts[0].start, parts[-1].stop) == (0, size)
    fs = pyarrow.fs.LocalFileSystem()
    whole = list(file_records(fs, str(path), 0, size))
    assert list(file_records(fs, str(path), 0, size, step=4000)) == whole and len(whole) == 150


def test_growth_gives_each_record_once():
    data = pcap(planted(60))

    class At:
        def read_at(self, n, at):
            return data[at:at + n]

    sizes = [24, 25, 100, 3000, 3010, 9000, len(data) - 3, len(data)]
    got = [r for seen, size in zip([1, *sizes], sizes) for r in RecordFile(At(), size, 4096).arrived(seen)]
    assert got == ranges(data, len(data))


def test_large_file_in_many_splits(spark, tmp_path):
    (tmp_path / "big.pcap").write_bytes(pcap(planted(), order=">"))
    whole = read_captures(spark, str(tmp_path), split_bytes=0)
    for step in (100_000, 20_000):
        split = read_captures(spark, str(tmp_path), split_bytes=step)
        assert split.rdd.getNumPartitions() > 3 and whole.count() == split.count() == 400
        assert whole.exceptAll(split).isEmpty()


def test_filters_reach_the_scan(spark, tmp_path):
    """Protocol, host, time and capture are tested in the reader; what it can't test stays in the plan."""
    (tmp_path / "one.pcap").write_bytes(pcap(planted(90)))
    (tmp_path / "two.pcap").write_bytes(pcap(planted(90, seed=2)))
    df = read_captures(spark, str(tmp_path))
    want = [r for r in df.collect() if r.src_ip == "10.0.3.1" and r.proto == 17]
    hit = filter_packets(df, "10.0.3.1", "udp")
    plan = spark._jvm.PythonSQLUtils.explainString(hit._jdf.queryExecution(), "formatted")
    assert "EqualTo(proto,17)" in plan and "EqualTo(src_ip,10.0.3.1)" in plan and "Condition" not in plan and len(want) > 10
    assert sorted(hit.collect()) == sorted(want)
    few = df.filter("ts_us >= 150000000 AND ts_us < 160000000 AND capture_id = 'two' AND src_port % 2 = 0")
    assert sorted(few.collect()) == sorted(r for r in df.collect() if 150 <= r.ts_us // 1_000_000 < 160
                                           and r.capture_id == "two" and r.src_port % 2 == 0)
    assert df.filter("src_ip IN ('10.0.1.1', '10.0.2.1') AND proto <> 6").count() == sum(
        r.src_ip in ("10.0.1.1", "10.0.2.1") for r in df.collect())
    assert df.filter("proto = 6 AND proto = 17").isEmpty() and df.filter("src_ip IS NULL").isEmpty()


def test_wanted_reads_fewer_rows():
    w = Wanted()
    assert w.add("src_ip", "in", ["10.0.3.1"]) and w.add("ts_us", "<=", 150_000_000) and not w.add("src_port", "in", [1])
    kept = [t for t, _, f in planted(90) if w.record(t * 1_000_000, 1, f)]
    assert kept == [100 + k for k in range(90) if k % 7 == 3 and k <= 50]


def test_stream_of_arriving_and_growing_files(spark, tmp_path):
    """Files in steps, one cut inside a record, a restart in between: the rows of the batch read, each once."""
    a, b = pcap(planted(80)), pcap(planted(50, seed=3))
    section = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", 1, 0, 0))
    frames = [f for _, _, f in planted(30, seed=4)]
    ng = section + b"".join(block(6, struct.pack("<IIIII", 0, 0, k, len(f), len(f)) + f) for k, f in enumerate(frames))
    src = tmp_path / "in" / "capture_id=c"
    src.mkdir(parents=True)
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")

    def run():
        q = (stream_captures(spark, str(tmp_path / "in")).writeStream.format("parquet").option("checkpointLocation", ck)
             .trigger(availableNow=True).start(out))
        q.awaitTermination()
        return spark.read.parquet(out).count()

    (src / "a.pcap").write_bytes(a[:len(a) // 2 + 7])
    (src / "c.pcapng").write_bytes(ng[:len(ng) // 3])
    first = run()
    (src / "a.pcap").write_bytes(a)
    second = run()
    (src / "d.pcap").write_bytes(b)
    (src / "c.pcapng").write_bytes(ng)
    assert 10 < first < second < run() == 160 == run()
    got = spark.read.parquet(out)
    assert read_captures(spark, str(tmp_path / "in")).exceptAll(got).isEmpty()


def test_ranges_next_to_each_other_share_the_search(monkeypatch):
    """Small ranges read one after another follow the chains of a stretch once, and find the records of the whole file."""
    frames = [encode_frame(40 + k * 37 % 700, (6, 17)[k % 2], "10.0.0.5", "10.0.2.9", 443, 40_000 + k % 16, 40, 16) for k in range(300)]
    data = pcap([]) + b"".join(pcap([(1 + k // 900, k % 900 * 1100, frames[k % 300])])[24:] for k in range(9_000))

    class At:
        def read_at(self, n, at):
            return data[at:at + n]

    whole, searched = ranges(data, len(data), 1 << 18), []
    leads = RecordFile._leads
    monkeypatch.setattr(RecordFile, "_leads", lambda self, at, stop: searched.append(at) or leads(self, at, stop))
    file = RecordFile(At(), len(data), 1 << 18)
    assert [r for at in range(0, len(data), 1 << 14) for r in file.records(at, at + (1 << 14))] == whole and len(whole) == 9_000
    assert 5 < len(searched) < len(data) // (1 << 14) // 8


@pytest.mark.parametrize("seed", range(6))
def test_one_file_in_ranges_of_any_size(seed):
    """As one file object, and as a new one for each range: payloads hold zeros, record headers and whole captures."""
    data = pcap(planted(300, seed), "<>"[seed % 2])
    whole = ranges(data, len(data))
    class At:  # noqa: E306
        def read_at(self, n, at):
            return data[at:at + n]

    for limit, step in ((4096, 500), (1 << 14, 3000), (2048, 97)):
        file = RecordFile(At(), len(data), limit)
        assert [r for at in range(0, len(data), step) for r in file.records(at, at + step)] == whole
        assert ranges(data, 7000, limit) == whole
