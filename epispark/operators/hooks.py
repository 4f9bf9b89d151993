"""Model hooks: a caller's model runs in Arrow batches inside Spark tasks.

Without a model the output is zeros of the right shape.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epispark.operators.quality import keep_tokens, rate_stride

Model = Callable[[], Callable[[np.ndarray], np.ndarray]]


def predict(x: Column, width: int, out_width: int, model: Model | None, batch: int = 64) -> Column:
    """``model()`` is called once per Python worker and must return a batch function
    ``(n, width) -> (n, out_width)``."""
    if model is None:
        return F.array_repeat(F.lit(0.0).cast("float"), out_width)

    run = predict_batch_udf(
        model,
        return_type=T.ArrayType(T.FloatType()),
        batch_size=batch,
        input_tensor_shapes=[[width]],
    )
    return run(x)


def encode_features(
    frames: DataFrame, index: str, x: str, width: int, tokens: int, token_dim: int,
    src_fps: float, dst_fps: float, patches: int = 64, model: Model | None = None, batch: int = 128,
) -> DataFrame:
    """Features at the cache rate: keep every stride-th frame, run the model, keep the class token
    and the first patches. The subsampling happens before any data reaches Python."""
    stride = rate_stride(F.lit(float(src_fps)), F.lit(float(dst_fps)))
    kept = frames.where(F.col(index) % stride == 0)
    flat = predict(F.col(x), width, tokens * token_dim, model, batch)
    rows = kept.withColumn("feat_idx", F.floor(F.col(index) / stride)).withColumn("__flat", flat)
    grid = F.transform(
        F.sequence(F.lit(0), F.lit(tokens - 1)),
        lambda i: F.slice("__flat", i * token_dim + 1, token_dim),
    )
    return rows.withColumn("tokens", keep_tokens(grid, patches)).drop("__flat", x)
