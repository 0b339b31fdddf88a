"""Sources: label bundles, logs, metrics, tables and file trees."""

from __future__ import annotations

from collections import defaultdict
from itertools import pairwise

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialise, settings, ship

IMAGES = "id BIGINT, file_name STRING, width INT, height INT, date_captured STRING, license INT, coco_url STRING, flickr_url STRING"
ANNOTATIONS = "id BIGINT, image_id BIGINT, category_id INT, iscrowd INT, area DOUBLE, bbox ARRAY<DOUBLE>, segmentation STRUCT<size: ARRAY<INT>, counts: STRING>, width INT, height INT"
CATEGORIES = "id INT, name STRING, supercategory STRING"
BUNDLE = (
    "info STRUCT<description: STRING, version: STRING, year: INT, date_created: STRING>, licenses ARRAY<STRUCT<id: INT, name: STRING, url: STRING>>, "
    f"images ARRAY<STRUCT<{IMAGES.replace(' BIGINT', ': BIGINT').replace(' STRING', ': STRING').replace(' INT', ': INT')}>>, "
    "annotations ARRAY<STRUCT<id: BIGINT, image_id: BIGINT, category_id: INT, iscrowd: INT, area: DOUBLE, bbox: ARRAY<DOUBLE>, segmentation: STRUCT<size: ARRAY<INT>, counts: STRING>, width: INT, height: INT>>, "
    "categories ARRAY<STRUCT<id: INT, name: STRING, supercategory: STRING>>"
)
ABLATION = "variant STRING, images INT, full_masks INT, windows INT, rescue INT, generated INT, crop_candidates INT, scored INT, crop_merged INT, merged INT, final_annotations INT"
DETECTOR = "variant STRING, bbox_ap DOUBLE, ap50 DOUBLE, ap75 DOUBLE, aps DOUBLE, apm DOUBLE, apl DOUBLE, segm_ap DOUBLE, segm_ap50 DOUBLE, segm_ap75 DOUBLE"
DIRECT_EVAL = "method STRING, annotations INT, recall_small DOUBLE, recall_medium DOUBLE, recall_large DOUBLE, recall_all DOUBLE, miou_small DOUBLE, miou_medium DOUBLE, miou_large DOUBLE, miou_all DOUBLE"
#: Fixed values of the log format: the metrics' names in their order.
METRICS = ("AP", "AP50", "AP75", "APs", "APm", "APl")


def coco(spark: SparkSession, path: str, swap_wh: bool = False) -> dict[str, DataFrame]:
    """A label bundle as frames: images, annotations, categories. A missing ``area`` stays null.

    ``swap_wh`` mends writers that exchange an image's width and height.
    """
    doc = spark.read.schema(BUNDLE).json(path, multiLine=True)
    out = {k: doc.select(F.inline(k)) for k in ("images", "annotations", "categories")}
    if swap_wh:
        out["images"] = out["images"].withColumns({"width": F.col("height"), "height": F.col("width")})
    return out


def _stretches(batches):
    """(file, split), bytes: rows of one split that follow each other, at most a batch at a time."""
    import pyarrow as pa

    for batch in batches:
        file, split = (batch.column(c).to_numpy() for c in ("file", "split"))
        borders = np.flatnonzero((np.diff(file) != 0) | (np.diff(split) != 0)) + 1
        value = batch.column("value").cast(pa.large_binary())
        for lo, hi in pairwise([0, *borders, len(file)] if len(file) else []):
            at = np.frombuffer(value.buffers()[1], np.int64)[value.offset + lo : value.offset + hi + 1]
            yield (int(file[lo]), int(split[lo])), np.frombuffer(value.buffers()[2], np.uint8)[at[0] : at[-1]]


def _marks(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of quotes and of braces, and how many quotes lie before each brace. No escape reaches over a piece's border, as ``\\}`` is none."""
    quotes, slashes = np.flatnonzero(text == ord('"')), np.flatnonzero(text == ord("\\"))
    if len(slashes):
        # Behind an odd run of backslashes a quote is a character.
        last = np.flatnonzero(np.diff(slashes, append=-2) != 1)
        quotes = np.setdiff1d(quotes, slashes[last[np.diff(last, prepend=-1) % 2 == 1]] + 1, assume_unique=True)
    braces = np.flatnonzero((text == ord("{")) | (text == ord("}")))
    return quotes, braces, np.searchsorted(quotes, braces)


def _turns(batches):
    """Of every split its quotes, and how it changes the depth if it starts outside a string and if inside."""
    import pyarrow as pa

    turns = defaultdict(lambda: [0, 0, 0])
    for key, text in _stretches(batches):
        quotes, braces, before = _marks(text)
        turn, step = turns[key], np.where(text[braces] == ord("{"), 1, -1)
        odd = (before + turn[0]) % 2
        turn[:] = turn[0] + len(quotes), turn[1] + int(step[odd == 0].sum()), turn[2] + int(step[odd == 1].sum())
    names = ("file", "split", "quotes", "outside", "inside")
    yield pa.RecordBatch.from_pylist([dict(zip(names, (*key, *turn))) for key, turn in turns.items()], pa.schema([(c, pa.int64()) for c in names]))


def _cut(batches, starts: dict):
    """The records of splits, of which ``starts`` tells whether they start in a string and how deep.

    What other splits hold the rest of comes with its file and split, n (0: begun in an earlier split, 1: begun in this one) and whether it ends here.
    """
    import pyarrow as pa

    def rows(value, file=None, split=None, n=None, ends=None):
        columns = [pa.array([x] * len(value), kind) for x, kind in ((file, pa.int64()), (split, pa.int64()), (n, pa.int32()), (ends, pa.int32()))]
        return pa.RecordBatch.from_arrays([*columns, value.cast(pa.binary())], ["file", "split", "n", "ends", "value"])

    def piece(ends):
        value = pa.array([b"".join(held)], pa.binary())
        return rows(value) if begun and ends else rows(value, *now, int(begun), int(ends))

    now, held = None, []
    for key, text in _stretches(batches):
        if key != now:
            if held:
                yield piece(False)
            now, held, begun = key, [], False
            if key not in starts:
                raise ValueError(f"the file was cut elsewhere in the first pass: {key}")
            odd, depth = starts[key]
        quotes, braces, before = _marks(text)
        braces = braces[(before + odd) % 2 == 0]
        step = np.where(text[braces] == ord("{"), 1, -1)
        deep = depth + np.cumsum(step)
        # Depth changes by one, so the two take turns.
        first, last = braces[(step == 1) & (deep == 2)], braces[(step == -1) & (deep == 1)] + 1
        if depth > 1:
            held.append(text[: last[0] if len(last) else len(text)].tobytes())
            if len(last):
                yield piece(True)
                held, last = [], last[1:]
        if len(first) > len(last):
            held, begun, first = [text[first[-1] :].tobytes()], True, first[:-1]
        odd, depth = (odd + len(quotes)) % 2, int(deep[-1]) if len(deep) else depth
        if len(first):
            # Records and what lies between them, by turns.
            at = np.stack([first, last], 1).astype(np.int64).ravel()
            both = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(text)])
            yield rows(both.take(pa.array(np.arange(0, len(at), 2))))
    if held:
        yield piece(False)


def coco_split(spark: SparkSession, path: str, swap_wh: bool = False) -> dict[str, DataFrame]:
    """As :func:`coco`, for one file of any size: read in splits, each by a task of its own.

    The file is cut at every closing brace, which Hadoop's line reader does at any split's border. A first pass tells of each split how many quotes it holds and
    how it changes the depth; running sums over splits tell in what state each starts. A second pass cuts out the objects that end at depth 1, the records. No text
    is shuffled but that of records which lie in several splits; they are put together again. A record's keys tell what it is, as in :func:`bundle`; others are left out.
    """
    ship(spark)
    raw = spark.read.option("lineSep", "}").text(path)
    raw = raw.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.concat("value", F.lit("}")).cast("binary").alias("value"))
    least = "spark.sql.files.minPartitionNum"
    # Both passes have to cut the file at the same places, also if executors come or go in between.
    with settings(spark, {least: spark.conf.get(least, None) or spark.conf.get("spark.sql.leafNodeDefaultParallelism", None) or str(spark.sparkContext.defaultParallelism)}):
        # A row a split.
        turns = raw.mapInArrow(_turns, "file long, split long, quotes long, outside long, inside long").collect()
        starts, state = {}, {}
        for t in sorted(turns):
            odd, depth = starts[t.file, t.split] = state.get(t.file, (0, 0))
            state[t.file] = (odd + t.quotes) % 2, depth + (t.inside if odd else t.outside)
        found = raw.mapInArrow(lambda b: _cut(b, starts), "file long, split long, n int, ends int, value binary")
        found = materialise(found.withColumn("value", F.col("value").cast("string")), "records")
    pieces = found.filter("n IS NOT NULL")
    # Two rows a split at most.
    over = Window.partitionBy("file").orderBy("split", "n").rowsBetween(Window.unboundedPreceding, -1)
    numbered = pieces.select("file", "split", "n", F.coalesce(F.sum("ends").over(over), F.lit(0)).alias("record"))
    whole = pieces.join(numbered, ["file", "split", "n"]).groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("split", "n", "value"))).alias("p"), F.max("ends").alias("ends")).filter("ends = 1")
    whole = materialise(whole.select(F.array_join(F.transform("p", lambda x: x["value"]), "").alias("value")), "records")
    return _records(found.filter("n IS NULL").select("value").unionByName(whole), swap_wh, False)


def _records(lines: DataFrame, swap_wh: bool, strict: bool) -> dict[str, DataFrame]:
    """Images, annotations and categories of JSON objects; one of another kind raises an error if ``strict``."""

    def kind(keys: Column) -> Column:
        found = F.when(keys.isNull(), None)
        for key, name in (("supercategory", "categories"), ("image_id", "annotations"), ("file_name", "images")):
            found = found.when(F.array_contains(keys, key), name)
        return found.otherwise(F.raise_error(F.concat(F.lit("no record of a bundle: "), "value"))) if strict else found

    # Keys are bound by a lambda: a filter on a column of them would parse the line anew for every test.
    found = lines.withColumn("kind", F.element_at(F.transform(F.array(F.json_object_keys("value")), kind), 1))
    schema = lines.sparkSession.range(0).select(F.from_json(F.lit("{}"), BUNDLE).alias("b")).schema["b"].dataType
    out = {k: found.filter(F.col("kind") == k).select(F.from_json("value", schema[k].dataType.elementType).alias("r")).select("r.*") for k in ("images", "annotations", "categories")}
    if swap_wh:
        out["images"] = out["images"].withColumns({"width": F.col("height"), "height": F.col("width")})
    return out


def bundle(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A bundle written a record to a line (``sinks.write_bundle``), read line by line: images, annotations, categories.

    A record's keys, in any order, tell what it is; a record of no kind raises an error.
    """
    bare = F.when(F.startswith("value", F.lit(",")), F.substr("value", F.lit(2))).otherwise(F.regexp_replace("value", r"^\s*,", ""))
    lines = spark.read.text(path).select(bare.alias("value"))
    return _records(lines, False, True)


def image_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, class, name, length, modified) of root/class[/images]/file, sorted by path; the bytes aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    parts = F.split("path", "/")
    folder = F.element_at(parts, -2)
    return files.select("path", F.when(folder == "images", F.element_at(parts, -3)).otherwise(folder).alias("class"), F.element_at(parts, -1).alias("name"), "length", "modificationTime").orderBy("path")


def hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, size_bytes, mtime, sha256) of files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").cast("double").alias("mtime"), F.sha2("content", 256).alias("sha256"))


def csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def jsonl(spark: SparkSession, path: str, metric: str = "total_loss") -> DataFrame:
    """(iteration, value) of lines that are JSON, have an iteration and a numeric metric."""
    return metric_points(spark.read.text(path), metric)


def metric_points(lines: DataFrame, metric: str = "total_loss", value: str = "value") -> DataFrame:
    """As :func:`jsonl`, of a frame of lines. Works on streams too."""
    doc = F.try_parse_json(value)
    typed = F.schema_of_variant(F.try_variant_get(doc, f"$.{metric}", "variant"))
    iteration = F.try_variant_get(doc, "$.iteration", "bigint")
    number = F.when(typed.isin("BIGINT", "DOUBLE") | typed.startswith("DECIMAL"), F.try_variant_get(doc, f"$.{metric}", "double"))
    return lines.select(*[c for c in lines.columns if c != value], iteration.alias("iteration"), number.alias("value")).filter("iteration IS NOT NULL AND value IS NOT NULL")


def log_lines(spark: SparkSession, root: str, name: str = "eval.log") -> DataFrame:
    """(run, line_no, line) of all files of a name below a folder. Each file is one row first, so lines keep their order."""
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name).text(root, wholetext=True)
    lines = text.select(F.col("_metadata.file_path").alias("log"), F.posexplode(F.split("value", r"\r\n|\n|\r")).alias("line_no", "line"))
    return lines.select(F.element_at(F.split("log", "/"), -2).alias("run"), "log", F.col("line_no").cast("long").alias("line_no"), "line")


def eval_metrics(lines: DataFrame) -> DataFrame:
    """(run, task, AP ... APl) by the payload behind ``copypaste:``.

    A task line opens a task; the header's next line gives its values if it has six numbers; then the
    task is closed until the next task line. The last block of a task counts.
    """
    w = Window.partitionBy("run").orderBy("line_no")
    payload = F.trim(F.when(F.contains("line", F.lit("copypaste:")), F.element_at(F.split("line", "copypaste:", 2), 2)))
    is_task = F.contains("line", F.lit("copypaste: Task:"))
    p = lines.withColumns({
        "payload": payload, "next": F.lead(payload).over(w),
        "task": F.when(is_task, F.lower(F.trim(F.element_at(F.split("line", "Task:", 2), 2)))), "block": F.sum(is_task.cast("int")).over(w),
    })
    p = p.withColumn("task", F.last("task", ignorenulls=True).over(w))
    values = F.transform(F.split("next", ","), lambda x: F.trim(x).try_cast("double"))
    rows = p.filter(F.col("task").isNotNull() & ~is_task & F.startswith("payload", F.lit("AP,AP50,AP75,APs,APm,APl"))).withColumn("v", values)
    rows = rows.filter((F.size("v") == 6) & ~F.exists("v", lambda x: x.isNull()))
    # The first good block after a task line closes it.
    first = rows.groupBy("run", "task", "block").agg(F.min_by("v", "line_no").alias("v"), F.min("line_no").alias("at"))
    last = first.groupBy("run", "task").agg(F.max_by("v", "at").alias("v"))
    return last.select("run", "task", *[F.col("v")[i].alias(m) for i, m in enumerate(METRICS)])


def eval_metrics_regex(lines: DataFrame) -> DataFrame:
    """Compatibility mode, whose pattern is a fixed value: any number after a metric's name, the last line wins, then blocks of header and values override.

    It also reads the 50 of ``AP50`` as a value behind ``AP,``; use :func:`eval_metrics` unless that is wanted.
    """
    w = Window.partitionBy("run").orderBy("line_no")
    p = lines.withColumns({"head": F.lead("line", 1).over(w), "vals": F.lead("line", 2).over(w)})
    out = []
    for m in METRICS:
        hit = F.regexp_extract("line", rf"\b{m}\b[^0-9\-]*([0-9]+(?:\.[0-9]+)?)", 1)
        block = F.contains("line", F.lit("copypaste:")) & (F.size(F.split("head", ",")) == F.size(F.split("vals", ",")))
        at = F.array_position(F.transform(F.split("head", ","), lambda x: F.trim(x)), m)
        value = F.when(block & (at > 0), F.trim(F.get(F.split("vals", ","), (at - 1).cast("int"))).try_cast("double"))
        seen = F.when(hit != "", hit.cast("double"))
        out.append(F.coalesce(F.max_by(value, F.when(value.isNotNull(), F.col("line_no"))), F.max_by(seen, F.when(seen.isNotNull(), F.col("line_no")))).alias(m))
    return p.groupBy("run").agg(*out)


def rank_runs(metrics: DataFrame) -> DataFrame:
    """Runs that have APs, highest first, ties by name. Ranks come from ranges that are counted and then numbered inside, so no task holds all runs."""
    from ..operators.merge import renumber

    good = metrics.filter("APs IS NOT NULL")
    return renumber(good, [F.desc("APs"), "run"], "rank", _parts(good)).withColumn("rank", F.col("rank").cast("int"))


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def id_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("v")).filter("v <> ''").select(F.col("v").cast("bigint").alias("id"))


def number_list(c: Column, default: list[float]) -> Column:
    """A comma-separated list of numbers; ``default`` if it holds none."""
    parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    numbers = F.transform(parts, lambda x: x.cast("double"))
    return F.when(F.size(numbers) > 0, numbers).otherwise(F.array(*[F.lit(float(v)) for v in default]))


def enum_list(text: str, allowed: list[str]) -> list[str]:
    """A comma-separated list; ValueError where it holds what isn't allowed."""
    found = [x.strip() for x in text.split(",") if x.strip()]
    if bad := [x for x in found if x not in allowed]:
        raise ValueError(f"unknown: {', '.join(bad)}; allowed: {', '.join(allowed)}")
    return found


def set_sides(left: DataFrame, right: DataFrame) -> DataFrame:
    """(id, side): the distinct ids of two sets, in both, left only or right only."""
    sides = left.select("id", F.lit(1).alias("s")).unionByName(right.select("id", F.lit(2).alias("s"))).groupBy("id").agg(F.bit_or("s").alias("s"))
    return sides.select("id", F.element_at(F.array(F.lit("left"), F.lit("right"), F.lit("both")), F.col("s").cast("int")).alias("side"))


def resolve_paths(images: DataFrame, files: DataFrame) -> DataFrame:
    """file_name -> path: as it is below the root, or as class/images/file, or the first of its base name.

    ``files`` has ``rel``, paths below the root. Both sides of every join are dealt by the number of rows, so that a task's sorts don't grow with the tables.
    """
    parts = max(images.sparkSession.sparkContext.defaultParallelism, -(-max(images.count(), files.count()) // 100_000))
    norm = F.replace("file_name", F.lit("\\"), F.lit("/"))
    base = F.element_at(F.split(norm, "/"), -1)
    inner = F.concat(F.element_at(F.split(norm, "/"), 1), F.lit("/images/"), base)
    i = images.select("*", norm.alias("__n"), inner.alias("__i"), base.alias("__b"))
    direct = files.select(F.col("rel").alias("__n"), F.col("rel").alias("p1"))
    nested = files.select(F.col("rel").alias("__i"), F.col("rel").alias("p2"))
    named = files.select(F.element_at(F.split("rel", "/"), -1).alias("__b"), "rel")
    first = named.repartition(parts, "__b").groupBy("__b").agg(F.min("rel").alias("p3"))
    out = i
    for key, side in (("__n", direct.repartition(parts, "__n")), ("__i", nested.repartition(parts, "__i")), ("__b", first)):
        out = out.repartition(parts, key).join(side, key, "left")
    return out.withColumn("path", F.coalesce("p1", "p2", "p3")).drop("__n", "__i", "__b", "p1", "p2", "p3")


def pick_file(paths: DataFrame, suffix: str, without: tuple[str, ...] = (), last: bool = True) -> str | None:
    """The last (or first) path by name with an ending, leaving out other endings.

    Asking for ``_multiscale.json`` without leaving out ``_raw_multiscale.json`` can give the latter.
    """
    p = paths.filter(F.endswith("path", F.lit(suffix)))
    for x in without:
        p = p.filter(~F.endswith("path", F.lit(x)))
    return p.agg((F.max if last else F.min)("path")).first()[0]
