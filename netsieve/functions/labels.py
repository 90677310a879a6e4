"""Label dictionaries and clean-up."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from netsieve.schemas import KNOWN_CLASSES, N_MIN, UNKNOWN_CLASSES


def encode_label(label: Column, split: str, classes: dict[str, int] | None = None) -> Column:
    """Class index of a label; a label the split does not allow stops the query."""
    if classes is None:
        classes = UNKNOWN_CLASSES if split == "test_ood" else KNOWN_CLASSES
    index = F.try_element_at(F.create_map(*[F.lit(v) for kv in classes.items() for v in kv]), label)
    problem = F.concat(F.lit(f"label not allowed in {split}: "), F.coalesce(label, F.lit("null")))
    return F.coalesce(index, F.raise_error(problem).cast("int"))


def normalise_label(raw: Column, default: str = "Benign") -> Column:
    """Text of a stored label: UTF-8 bytes decoded, blanks stripped, missing replaced."""
    return F.coalesce(F.trim(F.decode(raw.cast("binary"), "UTF-8")), F.lit(default))


def long_enough(captured_packets: Column, n_min: int = N_MIN) -> Column:
    return captured_packets >= n_min
