"""Further driver queries: readers and sinks through written files, mask codecs, and small operators, with SQL that says the same."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import masks as mk
from ..functions import scoring as sc
from ..operators import candidates as cd
from ..operators import evaluate as ev
from ..operators import graph as gr
from ..operators import runs as rn
from ..operators import stats as st
from ..operators import windows as wn
from ..session import dealt, shared_dir, ship, table
from ..sources import readers as rd
from ..sources import sinks as sk
from . import fixtures as fx
from . import presets as ps
from .queries import _GRID, _METRICS, _STATS, _gt_pred, _rounded, query, r6


def _path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/segmill/{label}-{uuid.uuid4().hex}"


# Readers and sinks


@query("SELECT event_id AS iteration, value FROM events WHERE value IS NOT NULL")
def q_scan_jsonl(spark, d):
    """Metrics of JSON lines, among lines that are broken, have no iteration, or a metric that is no number."""
    e = table(spark, d, "events")
    good = e.select(F.to_json(F.struct(F.col("event_id").alias("iteration"), F.col("value").alias("total_loss"), F.col("event_type").alias("kind"))).alias("value"))
    bad = e.select(F.explode(F.array(F.lit("{broken"), F.to_json(F.struct(F.col("value").alias("total_loss"))), F.to_json(F.struct(F.col("event_id").alias("iteration"), F.col("event_type").alias("total_loss"))), F.lit(""))).alias("value"))
    path = _path(spark, "metrics")
    good.unionByName(bad).write.text(path)
    return rd.jsonl(spark, path)


@query(f"SELECT 'run=run' || s_suppkey AS run, 'bbox' AS task, {_METRICS} FROM supplier")
def q_scan_log_tree(spark, d):
    """Logs in a folder a run, read as whole files.

    A file a run makes small data many files: they are dealt to tasks by their number, and each task puts its own in place.
    """
    path = _path(spark, "logs")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    logs = dealt(fx.log_lines(spark, d).groupBy("run").agg(whole.alias("value")), 500, "run", "value")
    logs.write.partitionBy("run").option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)
    return rd.eval_metrics(rd.log_lines(spark, path, "part-*"))


@query(f"WITH m AS (SELECT 'run' || s_suppkey AS run, {_METRICS} FROM supplier) SELECT run, 50.0::DOUBLE AS AP, AP50, AP75, APs, APm, APl FROM m")
def q_log_metrics_regex(spark, d):
    """The lenient parser; it takes the 50 of the header's AP50 for AP, whose own column starts with the log's prefix."""
    return rd.eval_metrics_regex(fx.log_lines(spark, d))


@query("SELECT o_orderkey AS id FROM orders")
def q_scan_text_ids(spark, d):
    path = _path(spark, "ids")
    o = table(spark, d, "orders").select(F.explode(F.array(F.concat(F.lit("  "), F.col("o_orderkey").cast("string"), F.lit(" ")), F.lit(""), F.lit("   "))).alias("value"))
    o.write.text(path)
    return rd.id_list(spark, path)


@query("SELECT n_name AS variant, CAST(n_nationkey AS INTEGER) AS images, CAST(n_regionkey AS INTEGER) AS merged FROM nation")
def q_scan_csv_int(spark, d):
    path = _path(spark, "csv")
    table(spark, d, "nation").select(F.col("n_name").alias("variant"), F.col("n_nationkey").alias("images"), F.col("n_regionkey").alias("merged")).write.csv(path, header=True)
    return rd.csv_table(spark, path, "variant STRING, images INT, merged INT")


@query("SELECT s_name AS method, CAST(s_nationkey AS VARCHAR) AS annotations FROM supplier")
def q_scan_csv_str(spark, d):
    path = _path(spark, "csv")
    table(spark, d, "supplier").select(F.col("s_name").alias("method"), F.col("s_nationkey").alias("annotations")).write.csv(path, header=True)
    return rd.csv_table(spark, path, "method STRING, annotations STRING")


@query(f"WITH m AS (SELECT 'run' || s_suppkey AS run, {_METRICS} FROM supplier) SELECT run, APs, CAST(row_number() OVER (ORDER BY APs DESC, run) AS INTEGER) AS rank FROM m")
def q_csv_ranked(spark, d):
    """Ranked runs through a CSV file."""
    path = _path(spark, "ranked")
    sk.ranked_csv(path, rd.rank_runs(rd.eval_metrics(fx.log_lines(spark, d)).filter("task = 'bbox'")).select("run", "APs", "rank"))
    return rd.csv_table(spark, path, "run STRING, APs DOUBLE, rank INT")


@query(f"WITH {fx.ANN} SELECT ann_id AS id, image_id, CAST(area AS DOUBLE) AS area, CAST(l AS DOUBLE) AS x, CAST(t AS DOUBLE) AS y, CAST(r - l AS DOUBLE) AS w, CAST(b - t AS DOUBLE) AS h FROM ann")
def q_scan_coco(spark, d):
    """A label bundle, written line by line and read back."""
    a = fx.annotations(spark, d)
    path = _path(spark, "bundle")
    box = F.array(*[c.cast("double") for c in (F.col("l"), F.col("t"), F.col("r") - F.col("l"), F.col("b") - F.col("t"))])
    anns = a.select(F.col("ann_id").alias("id"), "image_id", F.lit(1).alias("category_id"), F.lit(0).alias("iscrowd"), F.col("area").cast("double").alias("area"), box.alias("bbox"))
    cats = spark.range(1).select(F.lit(1).alias("id"), F.lit("object").alias("name"), F.lit("object").alias("supercategory"))
    sk.write_bundle(path, fx.images(spark, d), anns, cats)
    found = rd.bundle(spark, path)["annotations"]
    return found.select("id", "image_id", "area", *[F.col("bbox")[i].alias(n) for i, n in enumerate("xywh")])


@query("SELECT 'class=' || n_name AS class, 1::BIGINT AS files FROM nation")
def q_image_tree(spark, d):
    """Files by class folder, and their manifest."""
    path = _path(spark, "tree")
    table(spark, d, "nation").select(F.col("n_name").alias("class"), F.col("n_name").alias("value")).repartition("class").write.partitionBy("class").text(path)
    return sk.class_manifest(rd.image_tree(spark, path).filter(~F.startswith("name", F.lit("_"))))


@query("SELECT sha256(n_name || chr(10)) AS sha256, CAST(length(n_name) + 1 AS BIGINT) AS size_bytes FROM nation")
def q_hash_scan(spark, d):
    path = _path(spark, "hashed")
    table(spark, d, "nation").select(F.col("n_name").alias("class"), F.col("n_name").alias("value")).repartition("class").write.partitionBy("class").text(path)
    return rd.hashes(spark, path).filter(F.contains("path", F.lit("class="))).select("sha256", "size_bytes")


@query("SELECT n_regionkey AS folder, sha256(string_agg(n_name || chr(10), '' ORDER BY n_name)) AS sha256, CAST(sum(length(n_name) + 1) AS BIGINT) AS size_bytes, true AS intact FROM nation GROUP BY 1")
def q_snapshot_copy(spark, d):
    """Files copied by tasks, their hashes read from the copies."""
    path, target = _path(spark, "artifacts"), _path(spark, "snapshot")
    table(spark, d, "nation").select(F.col("n_regionkey").alias("folder"), F.col("n_name").alias("value")).repartition(1).sortWithinPartitions("folder", "value").write.partitionBy("folder").text(path)
    found = sk.snapshot_copy(spark, path, target).filter(F.startswith("name", F.lit("folder=")))
    return found.select(F.regexp_extract("name", r"folder=(\d+)", 1).cast("int").alias("folder"), "sha256", "size_bytes", "intact")


@query(f"WITH {fx.ANN} SELECT 'annotations' AS section, count(*) AS records, CAST(sum(area) AS DOUBLE) AS total FROM ann UNION ALL SELECT 'images', count(*), CAST(sum(o_orderkey % 1000) AS DOUBLE) FROM orders UNION ALL SELECT 'categories', 1, 1.0")
def q_scan_coco_split(spark, d):
    """One JSON file of all labels, read in splits."""
    a, images = fx.annotations(spark, d), fx.images(spark, d)
    box = F.array(*[c.cast("double") for c in (F.col("l"), F.col("t"), F.col("r") - F.col("l"), F.col("b") - F.col("t"))])
    rle = F.struct(F.array(F.lit(fx.SIZE), F.lit(fx.SIZE)).alias("size"), F.concat(F.lit('}"{\\'), F.col("ord").cast("string")).alias("counts"))
    anns = a.select(F.col("ann_id").alias("id"), "image_id", F.lit(1).alias("category_id"), F.col("area").cast("double").alias("area"), box.alias("bbox"), rle.alias("segmentation"))
    cats = spark.range(1).select(F.lit(1).alias("id"), F.lit("object").alias("name"), F.lit("object").alias("supercategory"))
    path = _path(spark, "coco")
    sk.write_coco(path, images, anns, cats)
    found = rd.coco_split(spark, path)
    one = lambda k, v: found[k].agg(F.lit(k).alias("section"), F.count(F.lit(1)).alias("records"), F.sum(v).cast("double").alias("total"))
    return one("annotations", F.col("area")).unionByName(one("images", F.col("id") % 1000)).unionByName(one("categories", F.col("id")))


@query(f"WITH {fx.ANN} SELECT source AS split, count(*) AS anns, CAST(sum(area) AS BIGINT) AS area FROM ann GROUP BY 1")
def q_split_write(spark, d):
    path = _path(spark, "splits")
    sk.write_split(path, fx.annotations(spark, d).withColumnRenamed("source", "split"))
    return spark.read.parquet(path).groupBy("split").agg(F.count(F.lit(1)).alias("anns"), F.sum("area").alias("area"))


@query(f"WITH {fx.ANN} SELECT flag, count(*) AS anns, count(DISTINCT ann_id) AS ids FROM ann GROUP BY 1")
def q_checkpoint_write(spark, d):
    """A run that stops after its first class; another that does what is left; and the first class once more, which doubles nothing."""
    path = _path(spark, "finished")
    a = fx.annotations(spark, d).select("ann_id", "flag")
    sk.append_checkpoint(path, a.filter("flag = 'A'"), "flag")
    sk.append_checkpoint(path, sk.resume(path, a, "flag"), "flag")
    sk.append_checkpoint(path, a.filter("flag = 'A'"), "flag")
    return spark.read.parquet(path).groupBy("flag").agg(F.count(F.lit(1)).alias("anns"), F.countDistinct("ann_id").alias("ids"))


@query(f"""WITH {fx.ANN}, r AS (SELECT image_id, source, ann_id, row_number() OVER (PARTITION BY image_id, source ORDER BY ord) AS rank FROM ann),
s AS (SELECT image_id, source, '"' || source || '":[' || string_agg('{{"rank":' || rank || ',"ann_id":' || ann_id || '}}', ',' ORDER BY rank) || ']' AS part FROM r GROUP BY 1, 2)
SELECT image_id, '{{"image_id":' || image_id || ',"splits":{{' || string_agg(part, ',' ORDER BY source) || '}}}}' AS value FROM s GROUP BY 1""")
def q_debug_records(spark, d):
    a = fx.annotations(spark, d)
    ranked = cd.top_per_group(a, ["image_id", "source"], [F.col("ord")], 0).select("image_id", F.col("source").alias("split"), "rank", "ann_id")
    return sk.debug_records(ranked)


def _side(name: str, source: str) -> str:
    return f"{name} AS ({_STATS.replace('SRC', repr_source(source))}), {name}d AS (SELECT least(n, 5) AS k, count(*) AS n FROM (SELECT o_orderkey, (SELECT count(*) FROM ann0 WHERE image_id = o_orderkey AND {repr_source(source)}) AS n FROM orders) GROUP BY 1)"


def repr_source(source: str) -> str:
    return f"source = '{source}'"


def _pair(label: str, column: str, form: str) -> str:
    return f"'| {label} | ' || format('{form}', b.{column}) || ' | ' || format('{form}', h.{column}) || ' |'"


def _share(label: str, name: str) -> str:
    side = lambda s: f"format('{{:,}}', {s}.{name}_count) || ' (' || format('{{:.1f}}', {s}.{name}_pct) || '%)'"
    return f"'| {label} | ' || {side('b')} || ' | ' || {side('h')} || ' |'"


def _images(k: int) -> str:
    side = lambda s: f"format('{{:,}}', coalesce((SELECT n FROM {s}d WHERE k = {k}), 0))"
    return f"'| Images with {k}{'+' if k == 5 else ''} masks | ' || {side('b')} || ' | ' || {side('h')} || ' |'"


_RULE = "'|--------|----------|--------|'"
_LINES = [
    "'| Metric | Baseline | Hybrid |'", _RULE, _pair("Total images", "total_images", "{:,}"), _pair("Total annotations (masks)", "total_anns", "{:,}"), _pair("Avg masks / image", "avg_masks", "{:,.2f}"),
    _pair("Median masks / image", "med_masks", "{:,.2f}"), _pair("Mean mask area (px²)", "mean_area", "{:,.2f}"), _pair("Median mask area (px²)", "med_area", "{:,.2f}"), _RULE, "'| **Size bin** | | |'",
    _share("Small (<32² px)", "small"), _share("Medium (32²–96² px)", "medium"), _share("Large (>96² px)", "large"), _RULE, "'| **Masks-per-image distribution** | | |'", *map(_images, range(6)),
]


@query(f"WITH {fx.ANN.replace('ann AS', 'ann0 AS')}, {_side('b', 'baseline')}, {_side('h', 'crop')}, l AS (SELECT [{', '.join(_LINES)}] AS lines FROM b, h) SELECT CAST(n AS INTEGER) AS n, lines[n + 1] AS line FROM l, range({len(_LINES)}) s(n)")
def q_md_table(spark, d):
    a, i = fx.annotations(spark, d), fx.images(spark, d)
    sides = [st.label_stats(i, a.filter(F.col("source") == s)) for s in ("baseline", "crop")]
    return sk.stats_table(*sides, *[st.mask_histogram(i, a.filter(F.col("source") == s)) for s in ("baseline", "crop")])


@query("""WITH p AS (SELECT l_returnflag AS variant, count(*) AS annotations FROM lineitem GROUP BY 1), e AS (SELECT o_orderstatus AS variant, count(*) AS ap FROM orders GROUP BY 1)
SELECT '| ' || variant || ' | ' || coalesce(CAST(annotations AS VARCHAR), '') || ' | ' || coalesce(CAST(ap AS VARCHAR), '') || ' |' AS value FROM p FULL JOIN e USING (variant)""")
def q_summary_sinks(spark, d):
    p = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("variant")).agg(F.count(F.lit(1)).alias("annotations"))
    e = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("variant")).agg(F.count(F.lit(1)).alias("ap"))
    return sk.summary(p, e)["md"]


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 4 THEN NULL ELSE 'c' || p_size || '/images/p' || p_partkey || '.jpg' END AS path FROM part""")
def q_resolve_path(spark, d):
    """Names as they are, without the inner folder, with backslashes, by base name alone, and of no file."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("c"), "p_size").alias("c"), F.concat(F.lit("p"), "p_partkey", F.lit(".jpg")).alias("f"))
    rel = F.concat("c", F.lit("/images/"), "f")
    kind = F.col("id") % 5
    name = F.when(kind == 0, rel).when(kind == 1, F.concat("c", F.lit("/"), "f")).when(kind == 2, F.concat("c", F.lit("\\images\\"), "f")).when(kind == 3, F.concat(F.lit("elsewhere/"), "f")).otherwise(F.concat(F.lit("none/x"), "f"))
    return rd.resolve_paths(p.select("id", name.alias("file_name")), p.select(rel.alias("rel"))).select("id", "path")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 3 END AS n, round(CASE WHEN o_orderkey % 3 = 0 THEN 1.75 ELSE o_custkey % 7 + 0.5 + 2 * (o_orderkey % 11) END, 6)::DOUBLE AS total FROM orders""")
def q_parse_list(spark, d):
    """Lists of numbers with blanks and empty parts; the default where there is none."""
    o = table(spark, d, "orders")
    text = F.when(F.col("o_orderkey") % 6 == 0, F.lit(" , ,")).when(F.col("o_orderkey") % 6 == 3, F.lit(None)).otherwise(F.concat((F.col("o_custkey") % 7).cast("string"), F.lit(" , ,.5,"), (F.col("o_orderkey") % 11 * 2).cast("string")))
    n = rd.number_list(text, [1.0, 0.75])
    return o.select(F.col("o_orderkey").alias("id"), F.size(n).alias("n"), F.aggregate(n, F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("""SELECT n_name AS name, CAST(CASE WHEN n_regionkey = 0 THEN n_nationkey * 3 WHEN n_regionkey = 1 THEN n_nationkey * 2 ELSE n_nationkey END AS BIGINT) AS value FROM nation""")
def q_preset_resolve(spark, d):
    """A typed value goes before a preset's, and that before the default."""
    n = table(spark, d, "nation")
    of = lambda k, most: n.filter(F.col("n_regionkey") <= most).select(F.col("n_name").alias("name"), (F.col("n_nationkey").cast("long") * k).alias("value"))
    return ps.resolve_table(of(3, 0), of(2, 1), of(1, 9))


@query("SELECT p_partkey AS id, p_brand AS class FROM part WHERE p_brand IN ('Brand#11', 'Brand#23', 'Brand#45')")
def q_class_subset(spark, d):
    files = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("class"))
    return ps.class_subset(files, "class", ["Brand#11", "Brand#23", "Brand#45"])


@query("SELECT c_custkey AS id, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'both' ELSE 'left' END AS side FROM customer")
def q_set_operations(spark, d):
    """Intersection and difference of two sets of ids."""
    return rd.set_sides(table(spark, d, "customer").select(F.col("c_custkey").alias("id")), table(spark, d, "orders").select(F.col("o_custkey").alias("id"))).filter("side <> 'right'")


# Filters and scores


@query(f"WITH {fx.MASKS}, a AS (SELECT mask_id, list_sum(bits) / 64.0 AS area_ratio, mask_id % 3 = 0 AS protected FROM m) SELECT mask_id, round(area_ratio, 6)::DOUBLE AS area_ratio FROM a WHERE area_ratio >= 0.1 AND area_ratio <= CASE WHEN protected THEN 1.0 ELSE 0.5 END")
def q_area_ratio_filter(spark, d):
    m = fx.masks(spark, d).select("mask_id", mk.area_ratio(F.col("bits")).alias("area_ratio"), (F.col("mask_id") % 3 == 0).alias("protected"))
    return _rounded(cd.area_ratio_filter(m, 0.1, 0.5).select("mask_id", "area_ratio"))


@query(f"WITH {fx.ANN} SELECT ann_id, area FROM ann WHERE area >= 400")
def q_min_area_drop(spark, d):
    return cd.drop_small(fx.annotations(spark, d), 400).select("ann_id", "area")


@query(f"WITH {fx.ANN} SELECT count(*) FILTER (discount > 0.02) AS kept, count(*) FILTER (NOT discount > 0.02) AS failed FROM ann")
def q_error_skip(spark, d):
    """Rows whose step gave nothing are left out and counted."""
    good, failed = cd.skip_errors(fx.annotations(spark, d).withColumn("result", F.when(F.col("discount") > 0.02, F.col("area"))), "result")
    return good.agg(F.count(F.lit(1)).alias("kept")).crossJoin(failed)


@query(f"""WITH {fx.ANN} SELECT ann_id, area > 0 AND area / 25600.0 <= 0.05 AND greatest(r - l, b - t)::DOUBLE / least(r - l, b - t) <= 2.8 AND 1 - discount * 9 >= 0.18 AS valid,
  round((1 - discount * 5) * (1.0 + score / 1000 / 128.0) + 1e-9, 5)::DOUBLE AS grid_score, round(score / 20000.0 - 0.03 * (line - 1) + 1e-9, 5)::DOUBLE AS merged,
  round(0.45 * (1 - discount) + 0.25 * (1 - tax) + 0.20 * (1 - least(1.0, abs(l - t) / (0.25 * 160))) + 0.10 * discount, 6)::DOUBLE AS alignment FROM ann""")
def q_small_scores(spark, d):
    """Validity of unions, ranking of grid windows, scores of merged candidates, alignment with proposals."""
    a = fx.annotations(spark, d)
    w, h = F.col("r") - F.col("l"), F.col("b") - F.col("t")
    return _rounded(a.select(
        "ann_id", sc.union_valid(F.col("area"), F.col("area") / 25600.0, F.greatest(w, h) / F.least(w, h), 1 - F.col("discount") * 9, 0.05).alias("valid"),
        F.round(sc.grid_crop_score(F.col("discount") * 5, F.col("score") / 1000).cast("double") + 1e-9, 5).alias("grid_score"), F.round(sc.merged_score(F.col("score") / 20000.0, F.col("line")).cast("double") + 1e-9, 5).alias("merged"),
        sc.proposal_alignment(F.col("discount"), 1 - F.col("discount"), 1 - F.col("tax"), F.abs(F.col("l") - F.col("t")), F.lit(160.0)).cast("double").alias("alignment"),
    ))


@query("SELECT n_nationkey AS id, coalesce(CASE WHEN n_regionkey = 1 THEN n_name END, 'none') AS found FROM nation")
def q_map_get_default(spark, d):
    n = table(spark, d, "nation")
    m = F.create_map(F.concat(F.lit("r"), "n_regionkey"), "n_name")
    return n.select(F.col("n_nationkey").alias("id"), cd.get_or(m, "r1", "none").alias("found"))


@query("""WITH s AS (SELECT o_orderstatus, avg(o_totalprice) AS recall, avg((o_orderpriority = '1-URGENT')::INT) AS duplicate_rate, avg((o_orderpriority = '2-HIGH')::INT) AS fragment_rate FROM orders GROUP BY 1)
SELECT n.o_orderstatus AS variant, n.recall >= b.recall * 1.1 AND n.duplicate_rate < 2.0 * greatest(b.duplicate_rate, 1e-9) AND n.fragment_rate < 2.0 * greatest(b.fragment_rate, 1e-9) AS adopt FROM s n, s b WHERE b.o_orderstatus = 'O'""")
def q_decision_rule(spark, d):
    o = table(spark, d, "orders")
    urgent = lambda p: F.avg((F.col("o_orderpriority") == p).cast("int"))
    s = o.groupBy(F.col("o_orderstatus").alias("variant")).agg(F.avg("o_totalprice").alias("recall"), urgent("1-URGENT").alias("duplicate_rate"), urgent("2-HIGH").alias("fragment_rate"))
    return ev.decision(s.filter("variant = 'O'"), s).select("variant", "adopt")


# Boxes


@query("""WITH o AS (SELECT o_orderkey AS id, 50 + o_orderkey % 700 AS ww, 50 + o_custkey % 500 AS hh FROM orders), s AS (SELECT *, least(ww, hh) AS sh FROM o),
z AS (SELECT id, ww, list_sort([CAST(round_even(0.25 * sh, 0) AS INTEGER), CAST(round_even(0.5 * sh, 0) AS INTEGER), CAST(round_even(0.75 * sh, 0) AS INTEGER)]) AS px FROM s)
SELECT id, coalesce(list_filter(px, lambda v: v >= ww / 10.0 * 2.4)[1], px[-1]) AS size FROM z""")
def q_pick_crop_size(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (50 + F.col("o_orderkey") % 700).cast("int").alias("ww"), (50 + F.col("o_custkey") % 500).cast("int").alias("hh"))
    return o.select("id", g.pick_crop_size(g.crop_sizes_px([0.25, 0.5, 0.75], F.col("ww"), F.col("hh")), F.col("ww") / 10.0).alias("size"))


@query("""WITH o AS (SELECT o_orderkey AS id, CAST(50 + o_orderkey % 700 AS INTEGER) AS ww, CAST(50 + o_custkey % 500 AS INTEGER) AS hh, o_orderkey % 20 AS y0, o_custkey % 25 AS x0 FROM orders),
e AS (SELECT *, least(ww - 1, floor(x0 / 30.0 * ww)) AS l, least(hh - 1, floor(y0 / 30.0 * hh)) AS t FROM o)
SELECT id, CAST(l AS INTEGER) AS l, CAST(t AS INTEGER) AS t, CAST(greatest(l + 1, least(ww, ceil((x0 + 5) / 30.0 * ww))) AS INTEGER) AS r, CAST(greatest(t + 1, least(hh, ceil((y0 + 3) / 30.0 * hh))) AS INTEGER) AS b FROM e""")
def q_component_box(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (50 + F.col("o_orderkey") % 700).cast("int").alias("ww"), (50 + F.col("o_custkey") % 500).cast("int").alias("hh"), (F.col("o_orderkey") % 20).alias("y0"), (F.col("o_custkey") % 25).alias("x0"))
    box = g.component_box(F.col("y0"), F.col("x0"), F.col("y0") + 3, F.col("x0") + 5, F.lit(30.0), F.lit(30.0), F.col("ww"), F.col("hh"))
    return o.select("id", box.alias("b")).select("id", "b.*")


_CELLS = """ex AS (SELECT DISTINCT k, unnest([l, r]) AS v FROM bx), ey AS (SELECT DISTINCT k, unnest([t, b]) AS v FROM bx),
cx AS (SELECT k, v AS x0, lead(v) OVER (PARTITION BY k ORDER BY v) AS x1 FROM ex), cy AS (SELECT k, v AS y0, lead(v) OVER (PARTITION BY k ORDER BY v) AS y1 FROM ey),
cov_cells AS (SELECT DISTINCT cx.k, x0, x1, y0, y1 FROM cx JOIN cy ON cx.k = cy.k JOIN bx ON bx.k = cx.k AND x0 >= bx.l AND x1 <= bx.r AND y0 >= bx.t AND y1 <= bx.b WHERE x1 IS NOT NULL AND y1 IS NOT NULL)"""


@query(f"""WITH {fx.ANN}, {_GRID}, bx AS (SELECT image_id AS k, l, t, r, b FROM ann WHERE source = 'baseline'), {_CELLS},
cv AS (SELECT k, ord, sum((least(x1, w.x + w.w) - greatest(x0, w.x)) * (least(y1, w.y + w.w) - greatest(y0, w.y))) AS n FROM cov_cells JOIN win w ON x0 < w.x + w.w AND x1 > w.x AND y0 < w.y + w.w AND y1 > w.y GROUP BY 1, 2),
ev AS (SELECT o_orderkey AS image_id, w.ord, CAST(coalesce(n, 0) AS BIGINT) AS covered_pixels, CAST(w.w * w.w AS BIGINT) AS area FROM orders CROSS JOIN win w LEFT JOIN cv ON k = o_orderkey AND cv.ord = w.ord WHERE w.w < 160)
SELECT image_id, ord, covered_pixels, area FROM ev WHERE 2 * covered_pixels < area""")
def q_coverage_skip(spark, d):
    """Windows covered less than half by their image's baseline boxes."""
    ship(spark)
    a = fx.annotations(spark, d)
    win = wn.grid_windows(spark, fx.SIZE, [1.0, 0.75, 0.5]).select("ord", F.col("x").alias("l"), F.col("y").alias("t"), (F.col("x") + F.col("w")).alias("r"), (F.col("y") + F.col("h")).alias("b"))
    # Dealt before the windows come, so that an image's windows are made where they are gathered.
    every = dealt(fx.images(spark, d).select(F.col("id").alias("image_id")), 50_000, "image_id").crossJoin(F.broadcast(win))
    area = ((F.col("r") - F.col("l")) * (F.col("b") - F.col("t"))).cast("long").alias("area")
    return wn.coverage_skip(every, a.filter("source = 'baseline'"), fx.SIZE, fx.SIZE, 0.5).select("image_id", "ord", "covered_pixels", area)


_MEET = "x.l < y.r AND y.l < x.r AND x.t < y.b AND y.t < x.b"


@query(f"""WITH {fx.ANN}, gt AS (SELECT * FROM ann WHERE flag = 'N'), pr AS (SELECT * FROM ann WHERE flag = 'R'),
pair AS (SELECT x.ann_id AS k, x.l AS gl, x.t AS gt_, x.r AS gr, x.b AS gb, y.l, y.t, y.r, y.b, CAST((least(x.r, y.r) - greatest(x.l, y.l)) * (least(x.b, y.b) - greatest(x.t, y.t)) AS DOUBLE) AS i, x.area AS xa, y.area AS ya FROM gt x JOIN pr y ON x.image_id = y.image_id AND {_MEET}),
low AS (SELECT k FROM pair GROUP BY 1 HAVING max(i / (xa + ya - i)) < 0.5), bx AS (SELECT pair.* FROM pair JOIN low USING (k)), {_CELLS},
gb AS (SELECT DISTINCT k, gl, gt_, gr, gb, xa FROM bx),
u AS (SELECT cov_cells.k, xa, sum((x1 - x0) * (y1 - y0)) AS n, sum(greatest(0, least(x1, gr) - greatest(x0, gl)) * greatest(0, least(y1, gb.gb) - greatest(y0, gt_))) AS shared FROM cov_cells JOIN gb ON gb.k = cov_cells.k GROUP BY 1, 2)
SELECT count(*) FILTER (shared / CAST(xa + n - shared AS DOUBLE) >= 0.5) AS fragmented, (SELECT count(*) FROM gt) AS n_gt, round(count(*) FILTER (shared / CAST(xa + n - shared AS DOUBLE) >= 0.5) / (SELECT count(*) FROM gt), 6) AS fragment_rate FROM u""")
def q_fragment_rate(spark, d):
    ship(spark)
    return _rounded(ev.fragment_rate(*_gt_pred(spark, d)))


def _canvas(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Boxes, covering boxes and pixels of 20 x 20 images, one of every embedding."""
    e = table(spark, d, "embeddings").withColumnRenamed("vec_id", "image_id")
    i, v = F.sequence(F.lit(0), F.lit(399)), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.get("embedding", i).cast("double"))
    v = F.slice(F.flatten(F.array_repeat(v, 7)), 1, 400)
    places = F.arrays_zip(F.transform(i, lambda i: (i / 20).cast("int")).alias("y"), F.transform(i, lambda i: i % 20).alias("x"), v.alias("v"))
    pixels = e.select("image_id", places.alias("pixels"))
    covering = e.select("image_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k"))
    covering = covering.select("image_id", ((F.col("image_id") * 7 + F.col("k") * 3) % 13).cast("int").alias("l"), ((F.col("image_id") * 5 + F.col("k") * 4) % 11).cast("int").alias("t"), "k")
    covering = covering.select("image_id", "l", "t", (F.col("l") + 2 + F.col("k")).cast("int").alias("r"), (F.col("t") + 3).cast("int").alias("b"))
    box = F.struct(*[F.element_at("w", i + 1).alias(c) for i, c in enumerate(("ord", "l", "t", "r", "b"))])
    wins = F.array(*[F.array(*map(F.lit, w)) for w in _WINDOWS])
    boxes = e.select("image_id", F.explode(wins).alias("w")).select("image_id", box.alias("b")).select("image_id", "b.*")
    return boxes, covering, pixels


_WINDOWS = ((1, 0, 0, 10, 10), (2, 5, 5, 15, 15), (3, 10, 0, 20, 10), (4, 0, 10, 10, 20), (5, 0, 0, 20, 20), (6, 10, 10, 20, 20))


@query(f"""WITH one AS (SELECT vec_id AS image_id, embedding FROM embeddings), w AS (SELECT * FROM (VALUES {', '.join(map(str, _WINDOWS))}) v(ord, l, t, r, b)),
cvr AS (SELECT image_id, (image_id * 7 + k * 3) % 13 AS l, (image_id * 5 + k * 4) % 11 AS t, (image_id * 7 + k * 3) % 13 + 2 + k AS r, (image_id * 5 + k * 4) % 11 + 3 AS b FROM one, range(6) s(k)),
pix AS (SELECT image_id, i // 20 AS y, i % 20 AS x, CAST(embedding[i % 64 + 1] AS DOUBLE) AS v FROM one, range(400) s(i)),
cov AS (SELECT image_id, ord, count(*) AS n FROM (SELECT DISTINCT p.image_id, ord, p.y, p.x FROM pix p JOIN w ON p.x >= w.l AND p.x < w.r AND p.y >= w.t AND p.y < w.b JOIN cvr c ON c.image_id = p.image_id AND p.x >= c.l AND p.x < c.r AND p.y >= c.t AND p.y < c.b) GROUP BY 1, 2),
gg AS (SELECT image_id, ord, v, lag(v) OVER wy AS uy, lead(v) OVER wy AS dy, lag(v) OVER wx AS ux, lead(v) OVER wx AS dx FROM pix p JOIN w ON p.x >= w.l AND p.x < w.r AND p.y >= w.t AND p.y < w.b
 WINDOW wy AS (PARTITION BY image_id, ord, x ORDER BY y), wx AS (PARTITION BY image_id, ord, y ORDER BY x)),
ed AS (SELECT image_id, ord, avg(sqrt(pow(CASE WHEN uy IS NULL THEN dy - v WHEN dy IS NULL THEN v - uy ELSE (dy - uy) / 2 END, 2) + pow(CASE WHEN ux IS NULL THEN dx - v WHEN dx IS NULL THEN v - ux ELSE (dx - ux) / 2 END, 2))) AS edge FROM gg GROUP BY 1, 2),
sc AS (SELECT image_id, ord, coalesce(n, 0) / CAST((r - l) * (b - t) AS DOUBLE) AS cover, edge FROM ed JOIN w USING (ord) LEFT JOIN cov USING (image_id, ord) WHERE ord <> 5),
rk AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY (1 - cover) * (1 + edge / 128) DESC, ord) AS rank FROM sc WHERE cover < 0.9)
SELECT image_id, ord, round(cover, 6) AS cover, round(edge, 6) AS edge, round((1 - cover) * (1 + edge / 128), 6) AS score, CAST(rank AS INTEGER) AS rank FROM rk WHERE rank <= 4""")
def q_ranked_grid(spark, d):
    """Grid windows with coverage and edge detail, the best four of each image."""
    ship(spark)
    boxes, covering, pixels = _canvas(spark, d)
    return _rounded(wn.ranked_grid(boxes, covering, pixels, 20, 20, 4, 0.9).select("image_id", "ord", "cover", "edge", "score", "rank"))


# Masks


@query(f"WITH {fx.PIXELS} SELECT mask_id, CAST(min(x) AS INTEGER) AS x, CAST(min(y) AS INTEGER) AS y, CAST(max(x) - min(x) + 1 AS INTEGER) AS w, CAST(max(y) - min(y) + 1 AS INTEGER) AS h FROM p WHERE v = 1 GROUP BY 1")
def q_bbox_xywh(spark, d):
    m = fx.masks(spark, d).withColumn("bb", mk.bbox(F.col("bits"), 8)).filter("bb IS NOT NULL")
    return m.select("mask_id", mk.bbox_xywh(F.col("bb")).alias("q")).select("mask_id", *[F.col("q")[i].alias(n) if isinstance(n, str) else n for i, n in enumerate("xywh")])


@query("SELECT vec_id AS mask_id, CAST(len(list_filter(embedding, lambda v: v > list_max(embedding) / 2)) AS INTEGER) AS area FROM embeddings")
def q_mask_threshold(spark, d):
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("mask_id"), mk.area(mk.threshold(F.col("embedding"))).alias("area"))


def _next_masks(spark, d) -> DataFrame:
    m = fx.masks(spark, d)
    o = m.select((F.col("mask_id") - 1).alias("mask_id"), F.col("bits").alias("other"))
    return m.select("mask_id", "bits").join(o, "mask_id")


@query(f"""WITH {fx.MASKS}, q AS (SELECT a.mask_id, list_sum(list_transform(list_zip(a.bits, b.bits), lambda z: z[1] * z[2])) AS i, list_sum(a.bits) AS na, list_sum(b.bits) AS nb FROM m a JOIN m b ON b.mask_id = a.mask_id + 1)
SELECT mask_id, round(i / (na + nb - i), 6) AS iou, round(i / na, 6) AS a_inside, round(i / nb, 6) AS b_inside, CAST(na - i AS INTEGER) AS unpainted FROM q""")
def q_iou_and_inside(spark, d):
    """Each mask against the next: IoU, shares inside, and what is left of it where the other is painted."""
    n = _next_masks(spark, d).withColumn("m", mk.iou_and_inside(F.col("bits"), F.col("other")))
    return _rounded(n.select("mask_id", "m.iou", "m.a_inside", "m.b_inside", mk.area(mk.without(F.col("bits"), F.col("other"))).alias("unpainted")))


@query(f"""WITH {fx.PIXELS}, t AS (SELECT i // 12 AS y, i % 12 AS x FROM range(72) s(i)), z AS (SELECT mask_id, t.y * 12 + t.x AS place, v FROM t JOIN p ON p.y = floor((t.y + 0.5) * 8 / 6) AND p.x = floor((t.x + 0.5) * 8 / 12))
SELECT mask_id, string_agg(v, '' ORDER BY place) AS bits FROM z GROUP BY 1""")
def q_resize_nearest(spark, d):
    m = fx.masks(spark, d)
    return m.select("mask_id", F.array_join(F.transform(mk.resize_nearest(F.col("bits"), 8, 8, 12, 6), lambda v: v.cast("string")), "").alias("bits"))


_RUNS = f"""{fx.PIXELS}, o AS (SELECT mask_id, v, x * 8 + y AS k FROM p), c AS (SELECT *, CASE WHEN v <> coalesce(lag(v) OVER (PARTITION BY mask_id ORDER BY k), 0) THEN 1 ELSE 0 END AS step FROM o),
rn AS (SELECT mask_id, sum(step) OVER (PARTITION BY mask_id ORDER BY k) AS run FROM c), ln AS (SELECT mask_id, run, count(*) AS n FROM rn GROUP BY 1, 2),
al AS (SELECT mask_id, r.run, coalesce(n, 0) AS n FROM (SELECT mask_id, max(run) AS last FROM ln GROUP BY 1) q JOIN (SELECT unnest(range(0, 65)) AS run) r ON r.run <= last LEFT JOIN ln USING (mask_id, run))"""


@query(f"""WITH {_RUNS}, df AS (SELECT mask_id, run, n - CASE WHEN run > 2 THEN lag(n, 2) OVER (PARTITION BY mask_id ORDER BY run) ELSE 0 END AS x FROM al),
sz AS (SELECT *, CASE WHEN x BETWEEN -16 AND 15 THEN 1 WHEN x BETWEEN -512 AND 511 THEN 2 ELSE 3 END AS k FROM df),
ch AS (SELECT mask_id, run, g, chr(CAST(48 + ((x >> (5 * g)) & 31) + CASE WHEN g < k - 1 THEN 32 ELSE 0 END AS INTEGER)) AS c FROM sz, range(3) s(g) WHERE g < k)
SELECT mask_id, string_agg(c, '' ORDER BY run, g) AS packed, (SELECT string_agg(v, '' ORDER BY y, x) FROM p WHERE p.mask_id = ch.mask_id) AS bits FROM ch GROUP BY 1""")
def q_rle_packed(spark, d):
    """Packed run lengths, and the mask that unpacking and decoding them gives."""
    ship(spark)
    m = fx.masks(spark, d).select("mask_id", rn.pack(rn.of_bits("bits", 8)).alias("packed"))
    back = rn.to_bits(rn.unpack("packed"), 8)
    return m.select("mask_id", "packed", F.array_join(F.transform(back, lambda v: v.cast("string")), "").alias("bits"))


@query(f"WITH {fx.MASKS} SELECT mask_id, CASE WHEN mask_id % 2 = 0 THEN 5.5::DOUBLE ELSE CAST(list_sum(bits) AS DOUBLE) END AS area FROM m")
def q_ann_area(spark, d):
    """The given area, else that of the run lengths."""
    ship(spark)
    m = fx.masks(spark, d)
    return m.select("mask_id", cd.ann_area(F.when(F.col("mask_id") % 2 == 0, 5.5), rn.of_bits("bits", 8)).alias("area"))


@query(f"""WITH RECURSIVE {fx.PIXELS}, bg AS (SELECT mask_id, y, x FROM p WHERE v = 0),
fl AS (SELECT mask_id, y, x FROM bg WHERE y IN (0, 7) OR x IN (0, 7) UNION SELECT bg.mask_id, bg.y, bg.x FROM fl JOIN bg ON bg.mask_id = fl.mask_id AND abs(bg.y - fl.y) + abs(bg.x - fl.x) = 1)
SELECT vec_id AS mask_id, CAST(64 - coalesce(n, 0) AS INTEGER) AS area FROM embeddings LEFT JOIN (SELECT mask_id, count(*) AS n FROM fl GROUP BY 1) ON mask_id = vec_id""")
def q_fill_holes(spark, d):
    ship(spark)
    return gr.filled(fx.masks(spark, d).select("mask_id", "bits"), 8).select("mask_id", mk.area(F.col("bits")).alias("area"))


@query("SELECT o_orderkey AS id, 'c' || o_custkey || '/' || o_orderkey || '.jpg' AS file_name, 160 AS width, 160 AS height FROM orders ORDER BY md5('42:' || o_orderkey), o_orderkey LIMIT 100")
def q_sample(spark, d):
    """A seeded sample: the operator's own limit."""
    return st.sample(fx.images(spark, d), "id", 100)
