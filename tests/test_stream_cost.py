"""The stream's work on a key follows its packets: no table for each session."""

import time

import pandas as pd

from netsieve.streaming.sessionizer import Sessionizer


class Held:
    value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


class Handle:
    def __init__(self):
        self.state, self.timers = Held(), []

    def getValueState(self, name, schema):
        return self.state

    def listTimers(self):
        return iter(list(self.timers))

    def registerTimer(self, at):
        self.timers.append(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


def packets(start, n):
    label = ["Benign", "DoS", "Botnet"]
    rows = [
        (i, i * 1_000_000, label[i % 3], f"s{i}" if i % 3 else "Benign", "1.1.1.1", 1, i % 2 == 1, 0.5, b"x") for i in range(start, start + n)
    ]
    return pd.DataFrame(rows, columns=["packet_no", "ts_us", "label", "attack_subtype", "src_ip", "sport", "is_teardown", "entropy", "bytes"])


def test_many_short_sessions_of_a_key():
    handle, sessions = Handle(), Sessionizer(120.0, 18, ["ts_us", "packet_no"])
    sessions.init(handle)
    began = time.process_time()
    first = list(sessions.handleInputRows(("cap", "key"), iter([packets(0, 4000).iloc[::-1], packets(4000, 1001)]), None))
    assert time.process_time() - began < 0.5
    out = pd.concat(first)
    assert len(out) == 2500 and handle.state.exists() and len(handle.timers) == 1
    assert out["observed_packets"].tolist() == [2] * 2500 and out["start_ts_us"].tolist() == [2_000_000 * k for k in range(2500)]
    later = pd.concat(sessions.handleInputRows(("cap", "key"), iter([packets(5001, 1)]), None))
    assert (later["observed_packets"][0], later["start_ts_us"][0], later["end_ts_us"][0]) == (2, 5_000_000_000, 5_001_000_000)
    assert [p["pos"] for p in later["_kept"][0]] == [1, 2]
    assert not handle.state.exists() and handle.timers == []
