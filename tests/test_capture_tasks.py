"""Small ranges of a capture share a task, and records are cut out together as they were one by one."""

import io
import struct

import pyarrow as pa
import pytest

from netsieve.sources.pcap import FILE_HEADER, IndexReader, _records, read_range

MAGIC = b"\xd4\xc3\xb2\xa1"


def frames():
    return [bytes([i % 251]) * (i * 37 % 400) for i in range(9000)] + [b"long" * 700_000, b"", b"end"]


def plain(rows):
    return b"".join(struct.pack("<IIII", t // 1_000_000, t % 1_000_000, len(f), len(f)) + f for t, f in rows)


def test_small_ranges_share_a_task(tmp_path):
    path = tmp_path / "one.pcap"
    path.write_bytes(MAGIC + bytes(FILE_HEADER - 4) + plain([(k, b"x" * 84) for k in range(1000)]))
    tasks = IndexReader(str(path), 1000).partitions()
    assert len(tasks) == 1 and [p for p, _, _ in tasks[0].ranges] == list(range(101))
    (found,) = IndexReader(str(path), 1000).read(tasks[0])
    assert found.num_rows == 101 and sum(found.column("packets").to_pylist()) == 1000


@pytest.mark.parametrize("offset", [0, 5])
def test_records_are_written_and_read_as_one_by_one(offset):
    rows = [(1_700_000_000_000_000 + 37 * k, f) for k, f in enumerate(frames())][offset:]
    ts, column = pa.array([0] * offset + [t for t, _ in rows]), pa.array([b"?"] * offset + [f for _, f in rows], pa.binary())
    made = bytes(_records(ts.slice(offset), column.slice(offset)))
    assert made == plain(rows)
    stream = io.BytesIO(bytes(FILE_HEADER) + made)
    got = [(int(t), f) for times, found in read_range(stream, FILE_HEADER, FILE_HEADER + len(made), MAGIC.hex()) for t, f in zip(times, found.to_pylist())]
    assert got == rows


def test_a_frame_without_time_is_refused():
    with pytest.raises(ValueError, match="without time"):
        _records(pa.array([None, 1], pa.int64()), pa.array([b"a", b"b"]))
