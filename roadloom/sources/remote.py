"""Sources behind functions of the caller: map tiles, road networks, predictors. Nothing here opens a connection itself."""

from __future__ import annotations

import hashlib
import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fetched_tiles(tiles: DataFrame, fetch, tries: int = 4, backoff: float = 1.5) -> DataFrame:
    """``tiles`` with a column data: ``fetch(zoom, tx, ty)`` as bytes.

    A call that raises is repeated up to ``tries`` times, ``backoff`` * n seconds after
    the n-th failure; the last error stands. Runs on executors, a batch of rows at a time.
    """
    schema = tiles.schema.simpleString()[len("struct<") : -1]

    def run(batches):
        for batch in batches:
            found = []
            for z, x, y in zip(batch["zoom"], batch["tx"], batch["ty"]):
                for turn in range(1, tries + 1):
                    try:
                        found.append(bytes(fetch(int(z), int(x), int(y))))
                        break
                    except Exception:
                        if turn == tries:
                            raise
                        time.sleep(backoff * turn)
            yield batch.assign(data=found)

    return tiles.mapInPandas(run, schema + ",data:binary")


def bbox_signature(bbox: tuple, network_type: str = "drive") -> str:
    """What a cached network was asked for: the box to 6 decimals and the kind of roads."""
    text = json.dumps([[round(float(v), 6) for v in bbox], network_type])
    return hashlib.sha1(text.encode()).hexdigest()


def cached_roads(spark: SparkSession, bbox: tuple, fetch, cache: str | None = None, network_type: str = "drive") -> DataFrame:
    """``fetch(spark, bbox, network_type)``, kept as Parquet under ``cache`` in a folder named by the signature.

    Another box or kind of roads has another folder, so a stale cache is never read.
    """
    if cache is None:
        return fetch(spark, bbox, network_type)
    path = f"{cache.rstrip('/')}/{bbox_signature(bbox, network_type)}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        fetch(spark, bbox, network_type).write.parquet(path, mode="overwrite")
    return spark.read.parquet(path)


def luminance_mask(threshold: float = 0.5):
    """The predictor used without a model: bright pixels, whatever the scale of the image."""

    def predict(tile):
        import numpy as np

        grey = np.asarray(tile, dtype=np.float64)
        grey = grey if grey.ndim == 2 else grey @ np.array([0.299, 0.587, 0.114])
        return grey >= threshold * (255.0 if grey.size and grey.max() > 1.0 else 1.0)

    return predict


def predicted_masks(values: DataFrame, size: int, predict=None) -> DataFrame:
    """(mask_id, row, col) of the road pixels that ``predict(tile)`` finds in ``values(mask_id, row, col, v)``.

    The image is cut into size x size tiles, padded with 0; each goes to ``predict`` as an
    array and its mask back to its place. Padding is dropped: only pixels of ``values`` are kept.
    A task holds one tile at a time.
    """
    if size <= 0:
        raise ValueError("tile size must be positive")
    predict = predict or luminance_mask()
    tile = lambda c: F.floor(F.col(c) / size).cast("int")

    def run(key, rows):
        import numpy as np

        r, c = rows["row"].to_numpy(np.int64) - key[1] * size, rows["col"].to_numpy(np.int64) - key[2] * size
        grid = np.zeros((size, size))
        grid[r, c] = rows["v"].to_numpy(np.float64)
        hit = np.asarray(predict(grid)).astype(bool)[r, c]
        return rows.loc[hit, ["mask_id", "row", "col"]]

    cells = values.select(F.col("mask_id").cast("string").alias("mask_id"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("v").cast("double").alias("v"))
    return cells.groupBy("mask_id", tile("row").alias("tr"), tile("col").alias("tc")).applyInPandas(run, "mask_id string, row int, col int")
