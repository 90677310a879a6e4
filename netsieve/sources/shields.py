"""Fitted shields as versions of one Parquet table.

A version is written by one job, which Spark commits as a whole, and holds every parameter as a row (part, class, place, values)
beside a header with the settings, the fingerprint of the training rows and a digest of all values. A reader takes the newest
version, or a given one, and refuses it if rows or digest differ from what the header says. Versions are never changed.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from netsieve.operators.integrity import fingerprint
from netsieve.operators.mahalanobis import Calibration, Profiles, thresholds_for
from netsieve.operators.pca import Pca
from netsieve.plans.open_set import Shield, ShieldSettings

FORMAT = 1
_SCHEMA = "format int, version long, run string, part string, class int, place int, values array<double>, note string"
Rows = list[tuple[str, int, int, np.ndarray]]


@dataclass
class StoredShield:
    shield: Shield
    settings: ShieldSettings
    version: int
    trained_on: str | None
    trained_rows: int | None


def _parameters(shield: Shield, settings: ShieldSettings) -> Rows:
    """Every parameter as (part, class or -1, place, values)."""
    rows: Rows = [("mean", -1, 0, shield.pca.mean), ("eigenvalues", -1, 0, shield.pca.eigenvalues), ("explained", -1, 0, shield.pca.explained)]
    rows += [("component", -1, i, shield.pca.components[:, i]) for i in range(shield.pca.k)]
    rows += [("marks", -1, i, marks) for i, marks in enumerate(shield.marks)]
    for c in shield.profiles.classes:
        rows.append(("centroid", c, 0, shield.profiles.centroids[c]))
        rows += [("inverse", c, i, row) for i, row in enumerate(shield.profiles.inverses[c])]
        rows.append(("count", c, 0, np.array([shield.profiles.counts[c]])))
    for c, v in shield.calibration.items():
        rows.append(("calibration", c, 0, np.array([v.count, v.median, v.mad])))
    if settings.selected is not None and shield.calibration:
        rows += [("threshold", c, 0, np.array([tau])) for c, tau in thresholds_for(shield.calibration, settings.selected).items()]
    return [(part, int(c), i, np.asarray(values, np.float64)) for part, c, i, values in rows]


def _digest(rows: Rows) -> str:
    whole = hashlib.sha256()
    for part, c, place, values in sorted(rows, key=lambda r: r[:3]):
        whole.update(f"{part}|{c}|{place}|{len(values)}|".encode() + values.astype("<f8").tobytes())
    return whole.hexdigest()


def stored_versions(spark: SparkSession, path: str) -> DataFrame:
    """(version, run, note) of the headers; none where nothing is stored."""
    try:
        found = spark.read.schema(_SCHEMA).parquet(path)
    except AnalysisException as absent:
        if "PATH_NOT_FOUND" not in str(absent):
            raise
        found = spark.createDataFrame([], _SCHEMA)
    return found.where("part = 'header'").select("version", "run", "note")


def save_shield(shield: Shield, settings: ShieldSettings, path: str, train: DataFrame, id_column: str = "id", vector: str = "embedding") -> int:
    """Write a new version and return its number.

    `train` holds the rows that the shield was fitted on: their ids, labels and vectors are fingerprinted. Of two writers that
    take the same number at a time, readers see the one whose run sorts last.
    """
    spark = train.sparkSession
    # Array elements as text, so that the fingerprint is that of the exact values.
    texts = train.select(id_column, "label", F.to_json(F.struct(vector)).alias("vector"))
    trained_on = fingerprint(texts, [id_column, "label", "vector"]).first()
    last = stored_versions(spark, path).agg(F.max("version")).first()[0]
    rows = _parameters(shield, settings)
    header = {
        "settings": asdict(settings),
        "trained_on": trained_on["fingerprint"],
        "trained_rows": trained_on["rows"],
        "parameters": len(rows),
        "digest": _digest(rows),
    }
    version, run = (last or 0) + 1, uuid.uuid4().hex
    rows.append(("header", -1, 0, np.zeros(0)))
    whole = pa.table(
        {
            "format": pa.array([FORMAT] * len(rows), pa.int32()),
            "version": pa.array([version] * len(rows), pa.int64()),
            "run": [run] * len(rows),
            "part": [r[0] for r in rows],
            "class": pa.array([r[1] for r in rows], pa.int32()),
            "place": pa.array([r[2] for r in rows], pa.int32()),
            "values": pa.array([r[3] for r in rows], pa.list_(pa.float64())),
            "note": pa.array([json.dumps(header) if r[0] == "header" else None for r in rows], pa.string()),
        }
    )
    spark.createDataFrame(whole).write.mode("append").parquet(path)
    return version


def load_shield(spark: SparkSession, path: str, version: int | None = None) -> StoredShield:
    """The newest version, or the given one. A version that is absent, of another format or not whole is an error."""
    headers = stored_versions(spark, path)
    wanted = headers if version is None else headers.where(F.col("version") == version)
    newest = wanted.orderBy(F.desc("version"), F.desc("run")).first()
    if newest is None:
        raise ValueError(f"no shield {'' if version is None else f'of version {version} '}in {path}")
    header = json.loads(newest["note"])
    # As many rows as the fit has parameters, which its own limits bound.
    own = spark.read.schema(_SCHEMA).parquet(path).where((F.col("run") == newest["run"]) & (F.col("part") != "header"))
    table = own.toArrow().to_pylist()
    if any(r["format"] != FORMAT for r in table):
        raise ValueError(f"version {newest['version']} has another format than {FORMAT}")
    rows: Rows = [(r["part"], r["class"], r["place"], np.array(r["values"], np.float64)) for r in table]
    if len(rows) != header["parameters"] or _digest(rows) != header["digest"]:
        raise ValueError(f"version {newest['version']} is not whole")
    by_part: dict[str, dict[tuple[int, int], np.ndarray]] = {}
    for part, c, place, values in rows:
        by_part.setdefault(part, {})[c, place] = values

    def stacked(part: str, c: int = -1) -> np.ndarray:
        return np.stack([values for (own_class, _), values in sorted(by_part[part].items()) if own_class == c])

    classes = sorted(c for c, _ in by_part["centroid"])
    profiles = Profiles(
        {c: int(by_part["count"][c, 0][0]) for c in classes},
        {c: by_part["centroid"][c, 0] for c in classes},
        {c: stacked("inverse", c) for c in classes},
    )
    pca = Pca(by_part["mean"][-1, 0], stacked("component").T, by_part["eigenvalues"][-1, 0], by_part["explained"][-1, 0])
    calibration = {c: Calibration(int(v[0]), float(v[1]), float(v[2])) for (c, _), v in sorted(by_part.get("calibration", {}).items())}
    shield = Shield(pca, stacked("marks"), profiles, calibration)
    return StoredShield(shield, ShieldSettings(**header["settings"]), newest["version"], header["trained_on"], header["trained_rows"])
