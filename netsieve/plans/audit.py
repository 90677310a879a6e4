"""The independent session count, straight from captures."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from netsieve.functions.packets import canonical_tuple
from netsieve.operators.audit import audit_report, audit_sessions
from netsieve.operators.schedule import label_packets
from netsieve.operators.sessions import SEGMENT_PACKETS, packet_segment
from netsieve.session import stage_table
from netsieve.sources.headers import decode_headers


def audit_captures(packets: DataFrame, schedule: DataFrame, segment_packets: int = SEGMENT_PACKETS) -> DataFrame:
    """Counted sessions per label. Every IP protocol counts, files are not stitched together, and the first
    matching rule labels a packet."""
    decoded = decode_headers(packets.where("read_error is null"), with_ports_only=False, extras=())
    key = canonical_tuple(*[F.col(c) for c in ("src_ip", "sport", "dst_ip", "dport", "proto")])
    narrow = decoded.where("decode_error is null").select(
        "source_file", "chunk_index", "packet_no", "ts_us", "src_ip", "dst_ip", "is_teardown", key.alias("canonical_tuple")
    )
    labelled = stage_table(label_packets(narrow, schedule, policy="first"), "audit")
    return audit_report(audit_sessions(labelled, packet_segment(segment_packets)))
