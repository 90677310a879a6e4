"""Batch inference with a function the caller supplies."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, FloatType, IntegerType, StructType

from netsieve.operators.pca import list_array

ModelFn = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]


def score(
    df: DataFrame, make_model: Callable[[], ModelFn], shape: tuple[int, ...], image: str = "image", batch_rows: int = 256
) -> DataFrame:
    """Replace `image` by logits, embedding and pred.

    `make_model` runs once per task and returns a function from an (n, *shape) float32 array to
    (logits, embeddings). Row counts must agree and all outputs must be finite.
    """
    at = df.columns.index(image)
    kept = [c for c in df.columns if c != image]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make_model()
        for batch in batches:
            for start in range(0, batch.num_rows, batch_rows):
                part = batch.slice(start, batch_rows)
                flat = np.asarray(part.column(at).flatten(), dtype=np.float32)
                logits, embeddings = (np.asarray(a, dtype=np.float32) for a in model(flat.reshape(-1, *shape)))
                if len(logits) != part.num_rows or len(embeddings) != part.num_rows:
                    raise ValueError("the model returned another number of rows")
                if not (np.isfinite(logits).all() and np.isfinite(embeddings).all()):
                    raise FloatingPointError("the model returned a non-finite value")
                pred = pa.array(logits.argmax(axis=1).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in kept] + [list_array(logits), list_array(embeddings), pred],
                    names=[*kept, "logits", "embedding", "pred"],
                )

    schema = StructType([df.schema[c] for c in kept])
    schema = schema.add("logits", ArrayType(FloatType())).add("embedding", ArrayType(FloatType()))
    return df.mapInArrow(run, schema.add("pred", IntegerType()))
