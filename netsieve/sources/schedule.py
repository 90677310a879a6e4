"""The attack schedule: a nested document exploded to one row per pair and window."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from netsieve.schemas import OOD_FOLDERS, UNKNOWN_ATTACKS

# Fixed by the data: schedule times are local at this offset all year; unknown attacks outrank known ones.
UTC_OFFSET = "-04:00"
CATEGORIES = {"zero_day": 2, "closed_set": 1}

ATTACK = (
    "priority int, entry int, attack_name string, date string, attacker_ips array<string>, "
    "victim_ips array<string>, time_windows array<array<string>>, target_folder string, label string"
)


def schedule_from(spark: SparkSession, config: Mapping, target_date: str | None = None) -> DataFrame:
    """Schedule rows of a parsed document, optionally of one date only."""
    attacks = config.get("attacks", {})
    entries = []
    for category, priority in CATEGORIES.items():
        for attack in attacks.get(category) or []:
            windows = [[str(edge) for edge in window] for window in attack["time_windows"]]
            addresses = [[str(ip) for ip in attack[k]] for k in ("attacker_ips", "victim_ips")]
            text = {k: str(attack[k]).strip() for k in ("attack_name", "date", "target_folder", "label")}
            if text["target_folder"] in OOD_FOLDERS and text["label"] not in UNKNOWN_ATTACKS:
                raise ValueError(f"known label {text['label']!r} in a quarantine folder")
            entries.append(
                (priority, len(entries), text["attack_name"], text["date"], *addresses, windows, text["target_folder"], text["label"])
            )
    rows = spark.createDataFrame(entries, ATTACK)
    if target_date is not None:
        rows = rows.where(F.col("date") == target_date)

    def instant(edge: int):
        text = F.concat_ws(" ", "date", F.trim(F.col("window")[edge]))
        stamp = F.to_timestamp(F.concat(text, F.lit(UTC_OFFSET)), "yyyy-MM-dd HH:mmXXX")
        return F.unix_micros(stamp)

    return (
        rows.withColumn("attacker_ip", F.explode(F.transform("attacker_ips", lambda ip: F.trim(ip))))
        .withColumn("victim_ip", F.explode(F.transform("victim_ips", lambda ip: F.trim(ip))))
        .withColumn("window", F.explode("time_windows"))
        .select(
            "attacker_ip",
            "victim_ip",
            instant(0).alias("start_us"),
            instant(1).alias("end_us"),
            "label",
            F.col("attack_name").alias("attack_subtype"),
            "target_folder",
            "priority",
            F.col("entry").alias("rule_order"),
        )
    )


def load_schedule(spark: SparkSession, path: str, target_date: str | None = None) -> DataFrame:
    """Schedule rows of a YAML file."""
    import yaml

    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    return schedule_from(spark, yaml.safe_load(text), target_date)
