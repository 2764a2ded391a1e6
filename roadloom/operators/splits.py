"""Sampling, splits, pairing and file-name keys."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def stem(path: Column) -> Column:
    """File name without folder and last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")


def chip_key(name: Column) -> Column:
    """``chipN`` in a name, else its trailing digits, else the stem."""
    own = stem(name)
    some = lambda pattern: F.nullif(F.regexp_extract(own, pattern, 0), F.lit(""))
    return F.coalesce(some(r"chip\d+"), some(r"\d+$"), own)


def chip_name(name: Column) -> Column:
    """``chipN`` in a name; an error without one."""
    found = F.regexp_extract(name, r"(chip\d+)", 1)
    return F.when(found != "", found).otherwise(F.raise_error(F.concat(F.lit("no chip in "), name)))


def bounding_box(text: Column) -> Column:
    """``"west,south,east,north"`` as four doubles; an error for any other number of parts."""
    parts = F.split(text, ",")
    return F.when(F.size(parts) == 4, F.transform(parts, lambda x: F.trim(x).cast("double"))).otherwise(F.raise_error(F.lit("a box has four numbers")))


def truthy(value: Column) -> Column:
    """Flags written as booleans, numbers or words."""
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin("true", "1", "yes", "1.0"), F.lit(False))


def image_pairs(paths: DataFrame, image: str = "_sat.jpg", mask: str = "_mask.png") -> DataFrame:
    """(dir, stem, image, mask) of files in ``paths(path)`` that have both."""
    at = lambda suffix, name: paths.where(F.col("path").endswith(suffix)).select(F.regexp_extract("path", r"^(.*?)[^/]*$", 1).alias("dir"), F.expr(f"substring(path, length(regexp_extract(path, '^(.*?)[^/]*$', 1)) + 1, length(path) - length(regexp_extract(path, '^(.*?)[^/]*$', 1)) - {len(suffix)})").alias("stem"), F.col("path").alias(name))
    return at(image, "image").join(at(mask, "mask"), ["dir", "stem"])


def fullest_folder(pairs: DataFrame) -> DataFrame:
    """The folder with the most pairs, of equal ones the first."""
    return pairs.groupBy("dir").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dir").limit(1)


def first_match(left: DataFrame, right: DataFrame, key: str, order: str) -> DataFrame:
    """Equi-join that keeps the first right row of each key."""
    first = right.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_r = 1").drop("_r")
    return left.join(first, key)


def shuffled(items: DataFrame, column: str, seed: int) -> DataFrame:
    """(column, place): the distinct sorted items in the order of ``random.Random(seed).shuffle``.

    The driver draws places for the number of items only; the items stay where they are.
    """
    ranked = items.select(column).distinct().withColumn("i", F.row_number().over(Window.orderBy(column)) - 1)
    n = ranked.count()
    places = list(range(n))
    random.Random(seed).shuffle(places)
    drawn = items.sparkSession.createDataFrame(list(enumerate(places)), "place int, i int")
    return ranked.join(drawn, "i").select(column, "place")


def holdout(items: DataFrame, column: str, fraction: float = 0.2, seed: int = 17) -> DataFrame:
    """(column, split): max(1, round(n * fraction)) distinct items are ``test``, the others ``train``; disjoint by item."""
    order = shuffled(items, column, seed)
    n = order.count()
    take = max(1, round(n * fraction)) if n else 0
    return order.select(column, F.when(F.col("place") < take, "test").otherwise("train").alias("split"))


def oversampled(rows: DataFrame, times: int) -> DataFrame:
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times))))


def capped(rows: DataFrame, group: str, order: str, most: int) -> DataFrame:
    """The first ``most`` rows of each group: a sampling operator."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("_r") <= most).drop("_r")


def stratified_validation(rows: DataFrame, key: str, value: str, bins: int = 5, fraction: float = 0.1, seed: int = 7) -> DataFrame:
    """Rows with bin and split: max(1, round(n * fraction)) of each quantile bin, drawn by a seeded hash, are ``val``."""
    cuts = rows.agg(F.percentile(value, F.array(*(F.lit(i / bins) for i in range(1, bins)))).alias("cuts"))
    binned = rows.crossJoin(F.broadcast(cuts)).withColumn("bin", F.size(F.filter("cuts", lambda c: F.col(value) > c))).drop("cuts")
    whole = Window.partitionBy("bin")
    drawn = Window.partitionBy("bin").orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))), key)
    placed = binned.withColumn("_r", F.row_number().over(drawn)).withColumn("_n", F.count("*").over(whole))
    take = F.greatest(F.lit(1), F.bround(F.col("_n") * fraction))
    return placed.withColumn("split", F.when(F.col("_r") <= take, "val").otherwise("train")).drop("_r", "_n")


def frozen(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at ``path``; made by ``make()`` and written the first time only."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        make().write.parquet(path, mode="errorifexists")
    return spark.read.parquet(path)


def running_best(values: DataFrame, order: str, value: str, by: str) -> DataFrame:
    """Flags the rows that beat all earlier ones of their group."""
    earlier = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    best = F.max(value).over(earlier)
    return values.withColumn("is_best", best.isNull() | (F.col(value) > best))


def moving_average(values: DataFrame, order: str, value: str, by: str, decay: float) -> DataFrame:
    """(by, order, ema): the exponential moving average after each row of a group in order, started at its first value; ties by value."""
    step = F.struct(F.col(order).alias("at"), F.col(value).cast("double").alias("x"))
    first = F.struct(F.lit(None).cast("double").alias("ema"), F.array().cast(f"array<struct<at:{dict(values.dtypes)[order]},ema:double>>").alias("done"))

    def follow(acc, s):
        ema = F.when(acc["ema"].isNull(), s["x"]).otherwise(acc["ema"] * decay + s["x"] * (1 - decay))
        return F.struct(ema.alias("ema"), F.concat(acc["done"], F.array(F.struct(s["at"].alias("at"), ema.alias("ema")))).alias("done"))

    folded = values.groupBy(by).agg(F.aggregate(F.sort_array(F.collect_list(step)), first, follow)["done"].alias("done"))
    return folded.select(by, F.explode("done").alias("s")).select(by, F.col("s.at").alias(order), F.col("s.ema").alias("ema"))


def learning_rate(step: Column, warmup: int, total: int) -> Column:
    """Linear warm-up, then a cosine to zero."""
    part = (step - warmup) / F.lit(float(max(1, total - warmup)))
    return F.when(step < warmup, (step + 1) / F.lit(float(max(1, warmup)))).otherwise(0.5 * (1 + F.cos(F.pi() * F.least(F.lit(1.0), part))))


def random_boxes(spark: SparkSession, height: int, width: int, seed: int, most: int = 6, fraction: tuple = (1 / 16, 1 / 7)) -> DataFrame:
    """(row0, col0, row1, col1) of seeded boxes to black out."""
    rng = random.Random(seed)
    boxes = []
    for _ in range(rng.randint(1, most)):
        h, w = (max(1, int(rng.uniform(*fraction) * n)) for n in (height, width))
        r, c = rng.randint(0, height - h), rng.randint(0, width - w)
        boxes.append((r, c, r + h, c + w))
    return spark.createDataFrame(boxes, "row0 int, col0 int, row1 int, col1 int")


def road_boxes(pixels: DataFrame, height: int, width: int, patches: int, size: int, seed: int = 42) -> DataFrame:
    """Boxes of exactly ``size`` around seeded road pixels, moved inward at the rim."""
    ranked = pixels.select("row", "col").distinct().withColumn("i", F.row_number().over(Window.orderBy("row", "col")) - 1)
    n = ranked.count()
    rng = random.Random(seed)
    drawn = pixels.sparkSession.createDataFrame([(rng.randrange(n),) for _ in range(patches)] if n else [], "i int")
    start = lambda c, length: F.greatest(F.lit(0), F.least(F.col(c) - size // 2, F.lit(length - size)))
    boxes = ranked.join(drawn, "i").select(start("row", height).alias("row0"), start("col", width).alias("col0"))
    return boxes.select("row0", "col0", (F.col("row0") + size).alias("row1"), (F.col("col0") + size).alias("col1"))


def blacked_out(pixels: DataFrame, boxes: DataFrame) -> DataFrame:
    """Pixels outside all boxes; boxes are turned into pixels first, so it is an equi-anti-join."""
    cells = boxes.withColumn("row", F.explode(F.sequence("row0", F.col("row1") - 1))).withColumn("col", F.explode(F.sequence("col0", F.col("col1") - 1)))
    return pixels.join(cells.select("row", "col").distinct(), ["row", "col"], "left_anti")


def listed(folders: list[DataFrame]) -> DataFrame:
    """(folder, path): the listings ``folders[i](path)`` one after the other, each in order of its paths."""
    out = None
    for i, paths in enumerate(folders):
        rows = paths.select(F.lit(i).alias("folder"), "path")
        out = rows if out is None else out.unionByName(rows)
    return out.orderBy("folder", "path")


def pooled(lists: list[DataFrame]) -> DataFrame:
    """Pair lists as one bag: repeated pairs stay."""
    out = lists[0]
    for more in lists[1:]:
        out = out.unionByName(more)
    return out


def image_labels(images: DataFrame, labels: DataFrame) -> DataFrame:
    """(chip, image, label) of ``images(path)`` and ``labels(path)`` whose names have the same chip key."""
    keyed = lambda df, name: df.select(chip_key(F.col("path")).alias("chip"), F.col("path").alias(name))
    return keyed(images, "image").join(keyed(labels, "label"), "chip")
