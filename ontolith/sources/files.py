"""Reading documents, scenes, datasets and paged text; writing triples and reports. Paths may be of any file system Spark reads."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ontolith.functions import text as T
from ontolith.functions.normal import nfkc

#: Fixed value: the documents that are read.
DOCUMENTS = r"(?i)\.(md|txt|json)$"
SCENE = """id string, name string, desc string, types map<string,struct<label:string,color:string>>, relKeywords map<string,array<string>>,
    propMap map<string,array<string>>, nodes array<struct<id:string,type:string,name:string,props:map<string,string>>>,
    edges array<struct<source:string,target:string,rel:string,label:string>>"""


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, text) of the .md, .txt and .json files under the path, whole."""
    found = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path)
    named = found.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))
    return named.where(F.col("name").rlike(DOCUMENTS))


def skipped_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path) of the files that documents() leaves out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    return found.where(~F.col("path").rlike(DOCUMENTS))


def scene(spark: SparkSession, path: str, scenario: str | None = None) -> DataFrame:
    """One row of a scene file; its id must be the scenario's, if one is named."""
    read = spark.read.schema(SCENE).json(path, multiLine=True)
    if scenario is not None and (other := read.where(~F.col("id").eqNullSafe(scenario)).select("id").first()):
        raise ValueError(f"scene {other[0]!r} is not {scenario!r}")
    return read


def scene_nodes(read: DataFrame) -> DataFrame:
    """(id, object_type, name, text, properties, ord); nodes without an id are left out. Spark's JSON reader keeps the order of map
    entries, which the text follows."""
    rows = read.select("types", F.posexplode("nodes").alias("ord", "n"))
    label = F.coalesce(F.element_at("types", F.col("n.type"))["label"], F.col("n.type"), F.lit(""))
    props = F.coalesce("n.props", F.create_map().cast("map<string,string>"))
    text = T.node_text(label, F.coalesce("n.name", F.lit("")), F.map_entries(props))
    out = rows.select(F.col("n.id").alias("id"), F.coalesce("n.type", F.lit("")).alias("object_type"), F.coalesce("n.name", F.lit("")).alias("name"), text.alias("text"), props.alias("properties"), F.col("ord").cast("long").alias("ord"))
    return out.where(F.coalesce("id", F.lit("")) != "")


def scene_links(read: DataFrame) -> DataFrame:
    """(link_type, source_id, target_id, label, ord)."""
    rows = read.select(F.posexplode("edges").alias("ord", "e"))
    return rows.select(F.col("e.rel").alias("link_type"), F.col("e.source").alias("source_id"), F.col("e.target").alias("target_id"), F.col("e.label").alias("label"), F.col("ord").cast("long").alias("ord"))


def scene_types(read: DataFrame) -> DataFrame:
    """(object_type, label, ord); a type without a label has its name for one."""
    rows = read.select(F.posexplode(F.map_entries("types")).alias("ord", "t"))
    return rows.select(F.col("t.key").alias("object_type"), F.coalesce("t.value.label", "t.key").alias("label"), F.col("ord").cast("long").alias("ord"))


def scene_keywords(read: DataFrame) -> DataFrame:
    """(rel, keyword, ord): ord is the relation's."""
    rows = read.select(F.posexplode(F.map_entries("relKeywords")).alias("ord", "k"))
    return rows.select(F.col("k.key").alias("rel"), F.explode("k.value").alias("keyword"), F.col("ord").cast("long").alias("ord"))


def scene_counts(scenes: DataFrame) -> DataFrame:
    """(id, nodes, edges) of each scene."""
    return scenes.select("id", F.size("nodes").alias("nodes"), F.size("edges").alias("edges"))


def dataset(spark: SparkSession, path: str, scenario: str) -> DataFrame:
    """(item_id, question, golden, keywords, ord) of an evaluation dataset in YAML: one item at least, one golden id each at least."""
    import yaml

    read = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    if read.get("scenario") != scenario:
        raise ValueError(f"dataset of {read.get('scenario')!r} is not of {scenario!r}")
    items = read.get("items") or []
    if not items or any(not x.get("golden_object_ids") for x in items):
        raise ValueError("a dataset needs items with golden ids")
    rows = [(x["id"], x["question"], [str(g) for g in x["golden_object_ids"]], [str(k) for k in x.get("golden_answer_keywords") or []], k + 1) for k, x in enumerate(items)]
    return spark.createDataFrame(rows, "item_id string, question string, golden array<string>, keywords array<string>, ord int")


def page_lines(spark: SparkSession, path: str, header: str | None = None, footer: str | None = None, pages: int | None = None) -> DataFrame:
    """(page, line_no, line, markdown) of page_*.txt files: normalised, trimmed lines without page marks; trailing blanks go."""
    read = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_name").alias("page"), F.col("value").alias("text"))
    return clean_lines(read, "page", "text", header, footer, pages)


def joined_document(read: DataFrame, lines: DataFrame, page: str) -> DataFrame:
    """(page, line_no, markdown) of the whole document, to be ordered by both: the lines of each page, and after each page but the
    last a blank line, a mark with its number from 1 on, and a blank line. One task counts the pages, not their lines."""
    order = Window.orderBy("page")
    numbered = read.select(F.col(page).alias("page")).distinct().withColumn("n", F.row_number().over(order)).withColumn("next", F.lead("page").over(order))
    end = F.coalesce(F.col("last"), F.lit(-1))
    last = lines.groupBy("page").agg(F.max("line_no").alias("last"))
    mark = F.posexplode(F.array(F.lit(""), F.format_string("<!-- page %d -->", "n"), F.lit(""))).alias("k", "markdown")
    marks = numbered.where("next is not null").join(last, "page", "left").select("page", end.alias("end"), mark).select("page", (F.col("end") + 1 + F.col("k")).alias("line_no"), "markdown")
    return lines.select("page", "line_no", "markdown").unionByName(marks)


def clean_lines(read: DataFrame, page: str, text: str, header: str | None = None, footer: str | None = None, pages: int | None = None) -> DataFrame:
    lines = read.select(F.col(page).alias("page"), F.posexplode(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n")).alias("line_no", "raw"))
    # normal forms only change what is not ASCII
    normal: Column = F.when(F.col("raw").rlike(r"^[\x00-\x7F]*$"), F.col("raw")).otherwise(nfkc("raw"))
    lines = lines.select("page", "line_no", T.strip(normal).alias("line")).where(~T.is_page_mark(F.col("line"), header, footer, pages))
    last = lines.where("line != ''").groupBy("page").agg(F.max("line_no").alias("last"))
    kept = lines.join(last, "page").where("line_no <= last").drop("last")
    return kept.withColumn("markdown", T.heading(F.col("line")))


def write_lines(lines: DataFrame, path: str) -> None:
    """A text file a partition, from a column `value`."""
    lines.select("value").write.mode("overwrite").text(path)


def write_report(markdown: str, html: str, folder: str, name: str) -> tuple[Path, Path]:
    """Writes name.md and name.html on the driver."""
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    paths = out / f"{name}.md", out / f"{name}.html"
    for path, content in zip(paths, (markdown, html), strict=True):
        path.write_text(content, encoding="utf-8")
    return paths


def jdbc_table(spark: SparkSession, url: str | None, table: str, schema: str, **options: str) -> DataFrame:
    """A table by JDBC; an empty one of the given schema without a URL."""
    if not url:
        return spark.createDataFrame([], schema)
    return spark.read.jdbc(url, table, properties=options)


def write_jdbc(df: DataFrame, url: str | None, table: str, mode: str = "append", **options: str) -> bool:
    """Writes a table by JDBC; without a URL nothing is written and the answer is no."""
    if url:
        df.write.jdbc(url, table, mode=mode, properties=options)
    return bool(url)
