"""Sinks: label bundles, splits, summaries and markdown."""

from __future__ import annotations

import hashlib
import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise, release, settings
from .readers import hashes

#: Shuffle files go when the query that wrote them is done, not when the driver happens to collect garbage.
DROP_SHUFFLES = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def coco_document(images: DataFrame, anns: DataFrame, categories: DataFrame, info: str = "") -> DataFrame:
    """One row with the whole bundle as JSON. For bundles that one reader takes whole; tables go out by :func:`write_split`."""
    pack = lambda df, name: df.agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias(name))
    one = pack(images, "images").crossJoin(pack(anns, "annotations")).crossJoin(pack(categories, "categories"))
    one = one.select(F.struct(F.lit(info).alias("description")).alias("info"), F.array().cast("array<string>").alias("licenses"), "images", "annotations", "categories")
    return one.select(F.to_json(F.struct(*one.columns)).alias("value"))


def write_coco(path: str, images: DataFrame, anns: DataFrame, categories: DataFrame, info: str = "") -> None:
    """A bundle of any size as a folder with one JSON file. Tasks write its parts (:func:`write_bundle`), whose bytes are then put one after the other, a megabyte at a time.

    The parts are compressed, and each is deleted when it is copied, so the disk holds little more than the file.
    """
    spark = images.sparkSession
    parts = f"{path.rstrip('/')}-parts-{uuid.uuid4().hex}"
    write_bundle(parts, images, anns, categories, info, compression="gzip")
    jvm, at, conf = spark.sparkContext._jvm, spark._jvm.org.apache.hadoop.fs.Path, spark._jsparkSession.sessionState().newHadoopConf()
    system, codecs = at(path).getFileSystem(conf), jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)
    system.delete(at(path), True)
    out = system.create(at(f"{path}/part-00000.json"))
    for name in sorted(f.getPath().getName() for f in system.listStatus(at(parts)) if f.getPath().getName().startswith("part-")):
        file = at(f"{parts}/{name}")
        part = codecs.getCodec(file).createInputStream(system.open(file))
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
        part.close()
        system.delete(file, False)
    out.close()
    system.delete(at(parts), True)


def write_bundle(path: str, images: DataFrame, anns: DataFrame, categories: DataFrame, info: str = "", parts: int = 0, compression: str = "none") -> None:
    """A bundle of any size as a folder of text parts, a record to a line; the parts in the order of their names are one JSON document.

    Lines are sorted by ranges of (section, id, row), nulls first, so no task holds more than its part. Null fields are written as null; repeated and null ids
    are records like others.
    """
    spark = images.sparkSession
    # Fixed values of the format: the sections' names in their order.
    sections = (("images", images), ("annotations", anns), ("categories", categories))
    records, marks = [], []
    for k, (name, df) in enumerate(sections):
        value = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
        records.append(df.select(F.lit(k).alias("k"), F.col("id").cast("long").alias("id"), value.alias("value")))
        marks.append("{" + f'"info":{{"description":{json.dumps(info)}}},"licenses":[],"images":[' if not k else f'],"{name}":[')
    # Rows get numbers of their own, as ids may be null or repeated: just one record of a section is its first.
    with settings(spark, DROP_SHUFFLES):
        written = materialise(reduce(DataFrame.unionByName, records).withColumn("n", F.monotonically_increasing_id()), "bundle")
    first = written.groupBy("k").agg(F.min(F.struct(F.col("id").isNotNull().alias("known"), "id", "n"))["n"].alias("first"))
    rows = written.join(F.broadcast(first), "k").select("k", F.lit(1).alias("o"), "id", "n", F.when(F.col("n") == F.col("first"), F.col("value")).otherwise(F.concat(F.lit(","), "value")).alias("value"))
    lead = spark.createDataFrame([(k, 0, None, None, text) for k, text in enumerate([*marks, "]}"])], "k int, o int, id long, n long, value string")
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["k", "o", F.asc_nulls_first("id"), "n"]
    with settings(spark, DROP_SHUFFLES):
        rows.unionByName(lead).repartitionByRange(parts, *order).sortWithinPartitions(*order).select("value").write.mode("overwrite").text(path, compression=compression)
    release(written)


def _store(batches, target: str):
    """Writes each file below ``target`` under a name of its own first, so that a lost task leaves no half file, and tells the hash of what it read."""
    import posixpath
    import uuid

    import pyarrow as pa
    from pyarrow import fs

    for batch in batches:
        names, contents = batch.column("name").to_pylist(), batch.column("content").to_pylist()
        for name, content in zip(names, contents):
            system, path = fs.FileSystem.from_uri(f"{target}/{name}" if "://" in target else f"file://{target}/{name}")
            system.create_dir(posixpath.dirname(path), recursive=True)
            part = f"{posixpath.dirname(path)}/.{uuid.uuid4().hex}"
            with system.open_output_stream(part) as f:
                f.write(content)
            system.move(part, path)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([hashlib.sha256(c).hexdigest() for c in contents], pa.string())], ["name", "source_sha256"])


def snapshot_copy(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Copies the files below ``source`` (any store Spark reads), tasks at a time, to ``target`` (a folder that executors share, or a store that pyarrow writes).

    (name, path, size_bytes, mtime, sha256, intact): what is at the target now, read anew, and whether it is what was read. A file has to fit in a row.
    """
    jpath, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsparkSession.sessionState().newHadoopConf()
    at = jpath(source)
    system = at.getFileSystem(conf)
    root = system.makeQualified(at).toString()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source)
    named = files.select(F.expr(f"substring(path, {len(root) + 2})").alias("name"), "content")
    copied = materialise(named.mapInArrow(lambda b: _store(b, target), "name string, source_sha256 string"), "snapshot")
    mark = target.rstrip("/").rsplit("/", 1)[-1]
    there = hashes(spark, target).withColumn("name", F.element_at(F.split("path", f"/{mark}/", 2), 2))
    found = materialise(copied.join(there, "name", "left"), "manifest")
    release(copied)
    out = found.select("name", "path", "size_bytes", "mtime", "sha256", F.coalesce(F.col("sha256") == F.col("source_sha256"), F.lit(False)).alias("intact"))
    # Spark's reader passes over empty files; their names are all there is to copy.
    empty, listed = [], system.listFiles(at, True)
    while listed.hasNext():
        f = listed.next()
        if not f.getLen():
            name = f.getPath().toString()[len(root) + 1 :]
            to = jpath(f"{target}/{name}")
            there_fs = to.getFileSystem(conf)
            there_fs.create(to, True).close()
            status = there_fs.getFileStatus(to)
            empty.append((name, status.getPath().toString(), status.getLen(), status.getModificationTime() / 1000.0, hashlib.sha256(b"").hexdigest(), status.getLen() == 0))
    return out.unionByName(spark.createDataFrame(empty, out.schema)) if empty else out


def write_split(path: str, anns: DataFrame) -> None:
    """A folder of Parquet per split."""
    anns.write.mode("overwrite").partitionBy("split").parquet(path)


def append_checkpoint(path: str, anns: DataFrame, by: str = "class") -> None:
    """Writes finished classes: those in ``anns`` replace what the folder has of them, others stay. Writing a class again, or a run's repeat, doubles nothing."""
    anns.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def finished(spark: SparkSession, path: str, by: str = "class") -> DataFrame:
    """The classes that a checkpoint folder holds; none if it isn't there yet."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path).select(F.col(by).cast("string").alias(by)).distinct()
    except AnalysisException:
        return spark.createDataFrame([], f"{by} string")


def resume(path: str, anns: DataFrame, by: str = "class") -> DataFrame:
    """The rows of classes that aren't finished: what a run that stopped has still to do."""
    done = finished(anns.sparkSession, path, by).withColumnRenamed(by, "__done")
    return anns.join(F.broadcast(done), F.col(by).cast("string").eqNullSafe(F.col("__done")), "left_anti")


def debug_records(candidates: DataFrame) -> DataFrame:
    """(image_id, value): a JSON of each image's splits with ranked candidates. Expects split and rank."""
    meta = [c for c in candidates.columns if c not in ("image_id", "split")]
    per = candidates.groupBy("image_id", "split").agg(F.array_sort(F.collect_list(F.struct("rank", *[c for c in meta if c != "rank"]))).alias("records"))
    maps = per.groupBy("image_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("split", "records")))).alias("splits"))
    return maps.select("image_id", F.to_json(F.struct("image_id", "splits")).alias("value"))


def ranked_csv(path: str, ranked: DataFrame) -> None:
    """A folder of CSV parts, each with a header; their names' order is the ranks'."""
    ranked.orderBy("rank").write.mode("overwrite").csv(path, header=True)


def number(c: Column, decimals: int = 2) -> Column:
    """With thousands separators."""
    return F.format_number(c, decimals)


def stats_table(base: DataFrame, hybrid: DataFrame, base_hist: DataFrame | None = None, hybrid_hist: DataFrame | None = None) -> DataFrame:
    """(n, line): the comparison of two label_stats rows, and of two mask_histogram tables, as a markdown table."""
    b, h = (df.select(F.struct(*df.columns).alias(name)) for df, name in ((base, "b"), (hybrid, "h")))
    row = lambda label, col, d: F.concat(F.lit(f"| {label} | "), number(F.col(f"b.{col}"), d), F.lit(" | "), number(F.col(f"h.{col}"), d), F.lit(" |"))

    def share(label: str, name: str) -> Column:
        cell = lambda s: F.concat(number(F.col(f"{s}.{name}_count"), 0), F.lit(" ("), number(F.col(f"{s}.{name}_pct"), 1), F.lit("%)"))
        return F.concat(F.lit(f"| {label} | "), cell("b"), F.lit(" | "), cell("h"), F.lit(" |"))

    # The published table's labels, headings and rules.
    rule = F.lit("|--------|----------|--------|")
    lines = [
        F.lit("| Metric | Baseline | Hybrid |"), rule, row("Total images", "total_images", 0),
        row("Total annotations (masks)", "total_anns", 0), row("Avg masks / image", "avg_masks", 2), row("Median masks / image", "med_masks", 2),
        row("Mean mask area (px²)", "mean_area", 2), row("Median mask area (px²)", "med_area", 2),
        rule, F.lit("| **Size bin** | | |"), share("Small (<32² px)", "small"), share("Medium (32²–96² px)", "medium"), share("Large (>96² px)", "large"),
    ]
    both = b.crossJoin(h)
    if base_hist is not None and hybrid_hist is not None:
        pack = lambda df, name: df.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("n_masks", "images")))).alias(name))
        both = both.crossJoin(pack(base_hist, "bd")).crossJoin(pack(hybrid_hist, "hd"))
        lines += [rule, F.lit("| **Masks-per-image distribution** | | |")]
        cell = lambda m, k: number(F.coalesce(F.try_element_at(m, F.lit(k)), F.lit(0)), 0)
        for k in range(6):
            label = f"Images with {k} masks" if k < 5 else "Images with 5+ masks"
            lines.append(F.concat(F.lit(f"| {label} | "), cell(F.col("bd"), k), F.lit(" | "), cell(F.col("hd"), k), F.lit(" |")))
    return both.select(F.posexplode(F.array(*lines)).alias("n", "line"))


def summary(pseudo: DataFrame, evals: DataFrame) -> dict[str, DataFrame]:
    """The variants' table in three forms: csv (empty where unknown), json and markdown rows."""
    both = pseudo.join(evals, "variant", "full_outer").orderBy("variant")
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in both.columns]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    return {"csv": both.select(*cells), "json": both.select(F.to_json(F.struct(*both.columns)).alias("value")), "md": both.select(line.alias("value"))}


def class_manifest(files: DataFrame) -> DataFrame:
    return files.groupBy("class").agg(F.count(F.lit(1)).alias("files"))


def output_name(stem: str, params: dict[str, object], shard: tuple[int, int] | None = None) -> str:
    """A file name that tells its parameters, and the shard's range where it isn't the whole."""
    name = "_".join([stem, *(f"{k}{v}" for k, v in params.items())])
    return f"{name}_{shard[0]}_{shard[1]}" if shard else name
