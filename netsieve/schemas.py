"""Table schemas and the fixed values of the data model."""

from __future__ import annotations

# Fixed values of the data model.
MAX_PACKETS = 18
MAX_BYTES = 128
DELTA_COLUMNS = 16
TENSOR_WIDTH = 144
TENSOR_CHANNELS = 3
SESSION_TIMEOUT_S = 120.0
AUDIT_TIMEOUT_S = 600.0
N_MIN = 7
KNOWN_CLASSES = {"Benign": 0, "DoS": 1, "DDoS": 2}
UNKNOWN_CLASSES = {"Botnet": 3, "Web_Attack": 4}
KNOWN_ATTACKS = ("DoS", "DDoS")
UNKNOWN_ATTACKS = ("Botnet", "Web_Attack")
OOD_FOLDERS = ("hold_out_test", "test_ood")
DEFAULT_FOLDER = "stratified_split"
SPLITS = ("train_known", "val_known", "test_known", "test_ood")
SPLIT_RATIOS = {"train": 0.8, "validation": 0.1, "test": 0.1}
RETENTION_RATES = {
    "train_known": {"Benign": 0.015, "DoS": 0.09, "DDoS": 0.09},
    "val_known": {"Benign": 0.05, "DoS": 0.05, "DDoS": 0.05},
    "test_known": {"Benign": 0.05, "DoS": 0.05, "DDoS": 0.05},
    "test_ood": {"Botnet": 1.0, "Web_Attack": 1.0},
}
KNOWN_TRUNCATED_CAPTURES = ("wed-21_UCAP172.31.69.28 part 2",)
LAMBDA_CANDIDATES = (1.0, 1.25, 1.5, 1.75, 2.0, 3.0, 4.5, 7.0)

PACKETS = (
    "source_file STRING, source_capture STRING, chunk_index INT, packet_no BIGINT, "
    "ts_us BIGINT, frame BINARY, read_error STRING"
)

SCHEDULE = (
    "attacker_ip STRING, victim_ip STRING, start_us BIGINT, end_us BIGINT, label STRING, "
    "attack_subtype STRING, target_folder STRING, priority INT, rule_order INT"
)

PACKET_STRUCT = "STRUCT<pos: INT, is_forward: BOOLEAN, delta_enc: FLOAT, entropy: FLOAT, bytes: BINARY>"

SESSIONS = (
    "session_id STRING, session_instance INT, canonical_tuple STRING, split_group_key STRING, "
    "capture_id STRING, capture_day STRING, source_capture STRING, source_files ARRAY<STRING>, "
    "label STRING, attack_subtype STRING, split STRING, start_ts_us BIGINT, end_ts_us BIGINT, "
    f"captured_packets INT, observed_packets BIGINT, source_truncated BOOLEAN, packets ARRAY<{PACKET_STRUCT}>"
)

MANIFEST = "path STRING, size_bytes BIGINT, row_count BIGINT, sha256 STRING"


def check_ratios(ratios: dict[str, float]) -> None:
    if abs(sum(ratios[k] for k in ("train", "validation", "test")) - 1.0) > 1e-9:
        raise ValueError("split ratios must sum to 1")


def check_rates(rates: dict[str, dict[str, float]]) -> None:
    for split, by_label in rates.items():
        for label, rate in by_label.items():
            if not 0.0 <= float(rate) <= 1.0:
                raise ValueError(f"retention rate of {split}/{label} is outside [0,1]: {rate}")
