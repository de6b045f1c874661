"""Numbered lines, strict edge lists, mappings, index maps, components, run folders and metadata from files.

A row's place is that of its line in the file, however many tasks read it: lines are numbered by the file's blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SOURCE, TARGET = "source neuron id", "target neuron id"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value): lines of each text file, from 1 on. Blocks are counted first; no task holds more than a block."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    counts = raw.groupBy("file", "block").agg(F.count("*").alias("n"))  # a row a block
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("file", "block", F.coalesce(before, F.lit(0)).alias("start"))
    turn = F.row_number().over(Window.partitionBy("file", "block").orderBy("at"))
    return raw.join(F.broadcast(starts), ["file", "block"]).select("file", (F.col("start") + turn).cast("long").alias("line_no"), "value")


def cells_of(line: Column) -> Column:
    """Cells of a comma-separated line without quotes, trimmed."""
    return F.transform(F.split(line, ","), lambda x: F.trim(x))


def graph_name(file: Column) -> Column:
    """A graph's name: its file's, without folders, ending and "_edge_list"."""
    return F.regexp_replace(F.regexp_extract(file, r"([^/]+?)(?:\.[^./]*)?$", 1), "_edge_list$", "")


def _whole(cell: Column, file: Column, line_no: Column) -> Column:
    """A cell as a long; what isn't one fails with file and line."""
    found = cell.try_cast("bigint")
    return F.when(found.isNull(), F.raise_error(F.concat(F.lit("not an integer: '"), cell, F.lit("' in line "), line_no.cast("string"), F.lit(" of "), file)).cast("bigint")).otherwise(found)


def strict_edges(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst) of a file whose header has the two expected names and no others; anything else raises."""
    header = spark.read.option("header", True).csv(path).columns
    if set(header) != {SOURCE, TARGET} or len(header) != 2:
        raise ValueError(f"header {header} instead of {[SOURCE, TARGET]}")
    return spark.read.option("header", True).option("mode", "FAILFAST").csv(path).select(F.col(SOURCE).cast("bigint").alias("src"), F.col(TARGET).cast("bigint").alias("dst"))


def tolerant_edges(spark: SparkSession, path: str) -> DataFrame:
    """(graph, row_idx, src, dst) from the first two cells of every line but a file's first; shorter lines are skipped, other text than integers raises with its line."""
    rows = numbered_lines(spark, path).where("line_no > 1").withColumn("cells", cells_of(F.col("value"))).where(F.size("cells") >= 2)
    at = (F.col("file"), F.col("line_no"))
    return rows.select(graph_name(F.col("file")).alias("graph"), (F.col("line_no") - 2).alias("row_idx"), _whole(F.col("cells")[0], *at).alias("src"), _whole(F.col("cells")[1], *at).alias("dst"))


def both_ways(edges: DataFrame) -> DataFrame:
    """(src, dst, forward): each edge and its reverse, for walks against the direction."""
    return edges.select("src", "dst", F.lit(True).alias("forward")).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(False).alias("forward")))


def mapping_places(spark: SparkSession, path: str, graphs: int = 2) -> DataFrame:
    """(pos, graph, node): the first columns of a mapping file, whose header names the graphs; pos counts rows from 0. Cells that are no integers give null."""
    lines = numbered_lines(spark, path).withColumn("cells", cells_of(F.col("value")))
    names = lines.where("line_no = 1").first()
    if names is None or len(names["cells"]) < graphs:
        raise ValueError(f"mapping without {graphs} named columns: {path}")
    sides = F.array(*[F.struct(F.lit(n).alias("graph"), F.get("cells", F.lit(i)).try_cast("bigint").alias("node")) for i, n in enumerate(names["cells"][:graphs])])
    rows = lines.where("line_no > 1 and trim(value) <> ''")
    return rows.select((F.col("line_no") - 2).alias("pos"), F.explode(sides).alias("x")).select("pos", "x.graph", "x.node")


def one_side(mapping: DataFrame, side: str) -> DataFrame:
    return mapping.where(F.col("graph") == side).select("pos", "node")


def index_map(spark: SparkSession, path: str) -> DataFrame:
    """(idx, node) of a map file with columns symsplit_index and node_id."""
    rows = spark.read.option("header", True).option("mode", "FAILFAST").csv(path)
    return rows.select(F.col("symsplit_index").cast("bigint").alias("idx"), F.col("node_id").cast("bigint").alias("node"))


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """The one row of a JSON object that may span lines."""
    return spark.read.option("multiLine", True).option("mode", "FAILFAST").json(path)


def found_files(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """(file, rows): files below ``path`` whose name ends so, with their data rows (all lines but the header)."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").text(path)
    return lines.groupBy(F.col("_metadata.file_path").alias("file")).agg((F.count("*") - 1).alias("rows"))


def large_components(spark: SparkSession, path: str, least: int = 141) -> DataFrame:
    """(graph, component_id, size) of component files or folders "<graph>.wcc_components.csv" below ``path``, from ``least`` nodes on."""
    rows = spark.read.option("header", True).option("recursiveFileLookup", True).csv(path).select("*", F.col("_metadata.file_path").alias("file"))
    named = rows.select(F.regexp_extract("file", r"([^/]+)\.wcc_components\.csv", 1).alias("graph"), F.col("component_id").cast("bigint").alias("component_id"), F.col("size").cast("bigint").alias("size"))
    return named.where((F.col("size") >= least) & (F.col("graph") != ""))


def component_nodes(assignments: DataFrame, component: int) -> DataFrame:
    return assignments.where(F.col("component_id") == component).select(F.col("node_id").alias("node"))


def annotated(nodes: DataFrame, *tables: DataFrame) -> DataFrame:
    """``nodes`` with the columns of each annotation table by node, a left join after the other; repeated keys repeat rows."""
    for table in tables:
        nodes = nodes.join(table, "node", "left")
    return nodes


def run_bundle(spark: SparkSession, path: str, tables: dict[str, str]) -> dict[str, DataFrame]:
    """Tables of a run's folder by name (CSV and JSON files), each with run_name and output_dir; a missing file raises."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    found = {}
    for key, file in tables.items():
        at = f"{path.rstrip('/')}/{file}"
        rows = metadata(spark, at) if file.endswith(".json") else spark.read.option("header", True).csv(at)
        found[key] = rows.withColumns({"run_name": F.lit(name), "output_dir": F.lit(path)})
    return found


def header_numbers(lines: DataFrame) -> DataFrame:
    """(nodes, edges) of a KaHIP file's first line (line_no, value)."""
    first = lines.where("line_no = 1").select(F.split(F.trim("value"), r"\s+").alias("x"))
    return first.select(F.col("x")[0].cast("bigint").alias("nodes"), F.col("x")[1].cast("bigint").alias("edges"))


def selected(lines: DataFrame, index: DataFrame) -> DataFrame:
    """(node): nodes (idx from 0) whose line of a membership vector (line_no from 1) is 1 or true."""
    chosen = lines.where(F.lower(F.trim("value")).isin("1", "true")).select((F.col("line_no") - 1).alias("idx"))
    return index.join(chosen, "idx", "left_semi").select("node")


def catalogued(jobs: DataFrame, samples: DataFrame, *keys: str) -> DataFrame:
    """``jobs`` with the columns of the sample that their keys name; a job without one raises."""
    met = jobs.join(samples.withColumn("found", F.lit(True)), list(keys), "left")
    missing = F.raise_error(F.concat_ws(" ", F.lit("no sample for"), *[F.col(k).cast("string") for k in keys])).cast("boolean")
    return met.withColumn("found", F.when(F.col("found"), True).otherwise(missing)).where("found").drop("found")
