"""Packet-by-packet statements of the session rules, written apart from the Spark code."""

from __future__ import annotations

import random
from collections import Counter

UNKNOWN = ("Botnet", "Web_Attack")
COLUMNS = (
    "source_capture canonical_tuple chunk_index packet_no ts_us is_teardown label attack_subtype src_ip sport entropy bytes"
).split()


def packets(n=4000, seed=1, teardown=0.05, backwards=0.02, hot=6):
    rng, t, rows = random.Random(seed), 10_000_000_000, []
    for i in range(n):
        t += rng.choice([0, 1, 5, 20, 60]) * 1_000_000 - (30_000_000 if rng.random() < backwards else 0)
        key = rng.choice(["a"] * hot + ["b", "c", "d"])
        label = rng.choices(["Benign", "DoS", "DDoS", *UNKNOWN], [90, 4, 3, 2, 1])[0]
        subtype = "Benign" if label == "Benign" else f"{label}{rng.randint(0, 3)}"
        src = rng.choice(["1.1.1.1", "2.2.2.2"])
        rows.append(("cap", key, 0, i, t, rng.random() < teardown, label, subtype, src, 80, rng.random(), bytes([i % 256])))
    return rows


def weight(label):
    return 2 if label in UNKNOWN else 0 if label == "Benign" else 1


def sessions(rows, timeout_us=120_000_000):
    """(key, instance, start, end, packets, label, subtype, directions of the first 18)."""
    state, count, out = {}, Counter(), []
    for r in rows:
        key, ts, label, sub = r[1], r[4], r[6], r[7]
        s = state.get(key)
        if s and (ts - s["last"] > timeout_us or s["torn"]):
            out.append(s)
            s = None
        if not s:
            count[key] += 1
            s = state[key] = dict(key=key, i=count[key], start=ts, n=0, label=label, sub=sub, src=r[8], dirs=[])
        s["n"] += 1
        s["last"], s["torn"] = ts, r[5]
        if len(s["dirs"]) < 18:
            s["dirs"].append(r[8] == s["src"])
        if weight(label) > weight(s["label"]) or weight(label) == 2:
            s["label"], s["sub"] = label, sub
        elif label == s["label"] and sub != "Benign":
            s["sub"] = sub
    out += state.values()
    return sorted((s["key"], s["i"], s["start"], s["last"], s["n"], s["label"], s["sub"], s["dirs"]) for s in out)


def audit(rows, cap, timeout_us=600_000_000):
    state, out = {}, []
    for r in rows:
        key, ts, label, torn = r[1], r[4], r[6], r[5]
        s = state.get(key)
        if s and ts - s["last"] > timeout_us:
            if s["capturing"]:
                out.append(s["label"])
            s = None
        if not s:
            s = state[key] = dict(n=0, label=label, capturing=True)
        s["last"] = ts
        if label != "Benign":
            s["label"] = label
        if s["capturing"]:
            s["n"] += 1
            if s["n"] == cap:
                out.append(s["label"])
                s["capturing"] = False
            elif torn:
                out.append(s["label"])
                del state[key]
        elif torn:
            del state[key]
    out += [s["label"] for s in state.values() if s["capturing"]]
    return dict(Counter(out))
