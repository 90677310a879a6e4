import math
import random
import socket
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from netsieve.functions.packets import anonymised_prefix, byte_entropy, encode_delta
from netsieve.sources.headers import decode_headers
from netsieve.sources.pcap import CaptureIndex, read_captures, read_packets


def v4(src, dst, proto, l4, fragment=0, options=b""):
    words = 5 + len(options) // 4
    head = struct.pack(
        ">BBHHHBBH4s4s", 0x40 | words, 0, words * 4 + len(l4), 0, fragment, 64, proto, 0, socket.inet_aton(src), socket.inet_aton(dst)
    )
    return head + options + l4


def v6(src, dst, following, rest):
    return struct.pack(">IHBB16s16s", 0x60000000, len(rest), following, 64, src, dst) + rest


def tcp(sport, dport, flags, payload, options=b""):
    return struct.pack(">HHIIBBHHH", sport, dport, 1, 2, (5 + len(options) // 4) << 4, flags, 100, 0, 0) + options + payload


def udp(sport, dport, payload):
    return struct.pack(">HHHH", sport, dport, 8 + len(payload), 0) + payload


def eth(kind, rest, tags=b""):
    return b"\x01" * 6 + b"\x02" * 6 + tags + struct.pack(">H", kind) + rest


def capture_bytes(records, magic=0xA1B2C3D4, order="<"):
    head = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, 1)
    return head + b"".join(struct.pack(order + "IIII", s, u, len(f), len(f)) + f for s, u, f in records)


CASES = [
    (eth(0x800, v4("1.2.3.4", "5.6.7.8", 6, tcp(10, 20, 1, b"hi")) + bytes(6)), ("1.2.3.4", "5.6.7.8", 10, 20, 6, True, b"hi")),
    (eth(0x800, v4("1.2.3.4", "5.6.7.8", 6, tcp(10, 65535, 16, b"x" * 300, b"\1" * 4), options=b"\1" * 8)), ("1.2.3.4", "5.6.7.8", 10, 65535, 6, False, b"x" * 300)),
    (eth(0x800, v4("9.9.9.9", "5.6.7.8", 17, udp(53, 20, b""))), ("9.9.9.9", "5.6.7.8", 53, 20, 17, False, b"")),
    (eth(0x800, v4("9.9.9.9", "5.6.7.8", 17, udp(53, 20, b"q")), b"\x81\0\0\5"), ("9.9.9.9", "5.6.7.8", 53, 20, 17, False, b"q")),
    (eth(0x806, b"arp"), None),
    (eth(0x800, v4("9.9.9.9", "5.6.7.8", 1, b"icmp1234")), None),
    (eth(0x800, v4("9.9.9.9", "5.6.7.8", 17, udp(53, 20, b"q"), fragment=5)), None),
    (b"short", "NeedData: short link header"),
    (eth(0x800, b"\x45\0"), "NeedData: short network header"),
    (eth(0x800, v4("9.9.9.9", "5.6.7.8", 6, b"123")), "NeedData: short transport header"),
]


def ipv6_cases():
    rng = random.Random(5)

    def address():
        words = [rng.choice([0, 0, 0, 1, 0xFFFF, rng.randrange(65536)]) for _ in range(8)]
        if rng.random() < 0.2:
            words[:6] = [0] * 5 + [rng.choice([0, 0xFFFF])]
        return struct.pack(">8H", *words)

    for _ in range(100):
        src, dst = address(), address()
        chain = rng.random() < 0.3
        rest = (b"\x06\x01" + bytes(14) if chain else b"") + tcp(1, 2, 4, b"p")
        names = [socket.inet_ntop(socket.AF_INET6, a) for a in (src, dst)]
        yield eth(0x86DD, v6(src, dst, 60 if chain else 6, rest)), (*names, 1, 2, 6, True, b"p")


def test_decoding(spark):
    cases = CASES + list(ipv6_cases())
    df = spark.createDataFrame([(i, bytearray(f)) for i, (f, _) in enumerate(cases)], "id int, frame binary")
    got = {r.id: r for r in decode_headers(df).collect()}
    for i, (_, want) in enumerate(cases):
        r = got.get(i)
        if want is None:
            assert r is None
        elif isinstance(want, str):
            assert r.decode_error == want
        else:
            assert (r.src_ip, r.dst_ip, r.sport, r.dport, r.proto, r.is_teardown, bytes(r.payload)) == want
            assert r.decode_error is None
    other = {r.id: r for r in decode_headers(df, with_ports_only=False).collect()}
    assert (other[5].proto, other[5].sport, other[5].dport) == (1, 0, 0)
    assert (other[6].proto, other[6].sport, other[6].dport) == (17, 0, 0)


def test_anonymised_prefix(spark):
    frames = [CASES[0][0], CASES[1][0], next(ipv6_cases())[0]]
    df = spark.createDataFrame([(i, bytearray(f)) for i, f in enumerate(frames)], "id int, frame binary")
    out = decode_headers(df, extras=("head",)).select(
        "id", anonymised_prefix(F.col("head"), F.col("ip_offset"), F.col("ip_version")).alias("b")
    )
    for r in out.collect():
        frame = bytearray(frames[r.id])
        frame[:12] = bytes(12)
        lo, hi = (26, 34) if r.id < 2 else (22, 54)
        frame[lo:hi] = bytes(hi - lo)
        assert bytes(r.b) == bytes(frame[:128])


def test_capture_files(spark, tmp_path):
    frames = [(100 + i, 7, f) for i, (f, _) in enumerate(CASES)]
    (tmp_path / "thu-22_A_chunk_00000_20180222000000.pcap").write_bytes(capture_bytes(frames))
    (tmp_path / "thu-22_A_chunk_00001_20180222000100.pcap").write_bytes(capture_bytes(frames)[:-5])
    (tmp_path / "wed-28_B.pcap").write_bytes(capture_bytes([(1, 2500, b"abc")], 0xA1B23C4D, ">"))
    (tmp_path / "fri-02_C.pcap").write_bytes(b"nonsense")
    rows = read_packets(spark, str(tmp_path), "capture").collect()
    by = {}
    for r in rows:
        by.setdefault((r.source_capture, r.chunk_index), []).append(r)
    first = by["thu-22_A", 0]
    assert [bytes(r.frame) for r in sorted(first, key=lambda r: r.packet_no)] == [f for _, _, f in frames]
    assert first[0].ts_us == 100_000_007
    broken = by["thu-22_A", 1]
    assert sum(r.frame is not None for r in broken) == 9 and broken[-1].read_error == "NeedData: truncated record"
    assert by["wed-28_B", 0][0].ts_us == 1_000_002
    assert by["fri-02_C", 0][0].read_error == "ValueError: invalid capture header"


def plain_records(data):
    """(packet_no, ts_us, frame) by one hop through the file, and the error of its tail."""
    out, at = [], 24
    while at < len(data):
        if at + 16 > len(data):
            return out, "NeedData: truncated record header"
        seconds, micros, stored, _ = struct.unpack_from("<IIII", data, at)
        if at + 16 + stored > len(data):
            return out, "NeedData: truncated record"
        out.append((len(out), seconds * 1_000_000 + micros, data[at + 16 : at + 16 + stored]))
        at += 16 + stored
    return out, None


def odd_frames(seed, n):
    """Frames that hold whole chains of records, and some that are longer than a range."""
    rng = random.Random(seed)
    fake = struct.pack("<IIII", 1000, 5, 4, 4) + b"fake"
    kinds = [lambda: rng.randbytes(rng.randint(0, 90)), lambda: fake * rng.randint(1, 30), lambda: b"", lambda: rng.randbytes(5) + fake * 12]
    return [(1000 + i, i % 1_000_000, rng.choice(kinds)() if i % 40 else rng.randbytes(3000)) for i in range(n)]


@pytest.mark.parametrize("cut,size", [(0, 700), (3, 150), (20, 1 << 20)])
def test_ranges_agree_with_one_hop(spark, tmp_path, cut, size):
    data = capture_bytes(odd_frames(cut, 120))
    data = data[: len(data) - cut]
    (tmp_path / "odd.pcap").write_bytes(data)
    (tmp_path / "bad.pcap").write_bytes(b"no capture at all" * 100)
    (tmp_path / "empty.pcap").write_bytes(capture_bytes([]))
    records, error = plain_records(data)
    rows = read_captures(spark, str(tmp_path), range_bytes=size).collect()
    mine = [r for r in rows if r.source_file.endswith("odd.pcap")]
    assert sorted((r.packet_no, r.ts_us, bytes(r.frame)) for r in mine if r.frame is not None) == records
    assert [r.read_error for r in mine if r.read_error] == ([error] if error else [])
    assert [(r.packet_no, r.read_error) for r in rows if r.source_file.endswith("bad.pcap")] == [(0, "ValueError: invalid capture header")]
    assert not [r for r in rows if r.source_file.endswith("empty.pcap")]


def test_most_ranges_are_found_without_mending(spark, tmp_path):
    rng = random.Random(5)
    (tmp_path / "a.pcap").write_bytes(capture_bytes([(1000 + i, 0, rng.randbytes(60)) for i in range(2000)]))
    spark.dataSource.register(CaptureIndex)
    found = spark.read.format("capture_index").option("range_bytes", 5000).load(str(tmp_path)).orderBy("part").collect()
    assert len(found) == -(-(24 + 2000 * 76) // 5000)
    assert sum(a.stop != b.start for a, b in zip(found, found[1:])) <= 1  # the last range may be too short for a chain


def test_entropy_against_numpy(spark):
    rng = np.random.default_rng(1)
    payloads = [b"", b"a", bytes(range(256))] + [rng.integers(0, rng.integers(1, 256), rng.integers(1, 3000), dtype=np.uint8).tobytes() for _ in range(200)]
    df = spark.createDataFrame([(i, bytearray(p)) for i, p in enumerate(payloads)] + [(-1, None)], "id int, p binary")
    for r in df.select("id", byte_entropy("p").alias("h")).collect():
        share = np.bincount(np.frombuffer(payloads[r.id], np.uint8), minlength=256) / max(len(payloads[r.id]), 1) if r.id >= 0 else np.zeros(256)
        share = share[share > 0]
        assert r.h == pytest.approx(float(-(share * np.log2(share)).sum()), abs=1e-12)


def test_delta_encoding(spark):
    got = [r[0] for r in spark.createDataFrame([(-1.0,), (0.0,), (3.5,), (500.0,)], "d double").select(encode_delta(F.col("d"))).collect()]
    assert got == pytest.approx([0.0, 0.0, 255 * math.log1p(3.5) / math.log1p(120), 255.0])
