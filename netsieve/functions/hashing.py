"""Deterministic hashing: fractions, split routing, retention and identifiers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from netsieve.schemas import OOD_FOLDERS, SPLIT_RATIOS, check_rates, check_ratios


def stable_fraction(text: Column) -> Column:
    """First 8 bytes of SHA-256, read big-endian, scaled to [0, 1)."""
    head = F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10)
    return head.cast("decimal(20,0)").cast("double") / F.lit(float(2**64))


def route_split(key: Column, folder: Column, ratios: dict[str, float] = SPLIT_RATIOS) -> Column:
    """Quarantine folders go to `test_ood`; everything else by the stable fraction of its key."""
    check_ratios(ratios)
    fraction = stable_fraction(F.concat(F.lit("split|"), key))
    train = float(ratios["train"])
    return (
        F.when(folder.isin(*OOD_FOLDERS), "test_ood")
        .when(fraction < train, "train_known")
        .when(fraction < train + float(ratios["validation"]), "val_known")
        .otherwise("test_known")
    )


def retention_rate(split: Column, label: Column, rates: dict[str, dict[str, float]]) -> Column:
    """Configured rate of (split, label); pairs without an entry are kept whole."""
    check_rates(rates)
    pairs = [(f"{s}|{l}", float(r)) for s, by_label in rates.items() for l, r in by_label.items()]
    if not pairs:
        return F.lit(1.0)
    table = F.create_map(*[F.lit(v) for pair in pairs for v in pair])
    return F.coalesce(F.try_element_at(table, F.concat_ws("|", split, label)), F.lit(1.0))


def is_retained(split: Column, label: Column, group_key: Column, rates: dict[str, dict[str, float]]) -> Column:
    """One decision per group key, so sibling sessions stay or go together."""
    fraction = stable_fraction(F.concat_ws("|", F.lit("retention"), split, label, group_key))
    return fraction < retention_rate(split, label, rates)


def capture_id(source_capture: Column) -> Column:
    return F.substring(F.sha2(source_capture, 256), 1, 16)


def capture_day(source_capture: Column) -> Column:
    return F.substring_index(source_capture, "_", 1)


def split_group_key(day: Column, canonical: Column) -> Column:
    return F.sha2(F.concat_ws("|", day, canonical), 256)


def session_id(source_capture: Column, canonical: Column, first_us: Column, instance: Column) -> Column:
    material = F.concat_ws("|", source_capture, canonical, first_us.cast("string"), instance.cast("string"))
    return F.substring(F.sha2(material, 256), 1, 24)
