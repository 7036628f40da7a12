"""Reading exports, repair files, map dumps and lexicons; writing catalogs and reports."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placewright.tables import written

#: An element of a map dump: nodes carry lat and lon, ways a centre; tags are free.
ELEMENT = T.StructType([
    T.StructField("type", T.StringType()), T.StructField("id", T.LongType()), T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType()),
    T.StructField("center", T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())])), T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
])
#: Versions of a catalog that stay, so that whoever reads the one before the last can end.
KEPT_VERSIONS = 2


def _strings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False, encoding="UTF-8")


def numbered(df: DataFrame) -> DataFrame:
    """__file, and row_id: the rows' order in their file, gapless. Rows are counted for each stretch of a file that one task reads, and numbered from
    where it starts, so only those counts are gathered."""
    keyed = df.withColumns({"__file": F.input_file_name(), "__at": F.monotonically_increasing_id()}).withColumn("__part", F.shiftright("__at", 33))
    counts = keyed.groupBy("__file", "__part").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__file").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__file", "__part", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    out = keyed.join(starts.hint("merge"), ["__file", "__part"]).withColumn("row_id", F.col("__at") - F.col("__first") + F.col("__before"))
    return out.drop("__at", "__part", "__first", "__before")


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """A places export, every column a string and nulls empty, with row_id in file order. Files are numbered after one another."""
    rows = numbered(_strings(spark, path))
    sizes = rows.groupBy("__file").agg(F.count(F.lit(1)).alias("__n"))
    starts = sizes.select("__file", F.coalesce(F.sum("__n").over(Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    out = rows.join(starts.hint("merge"), "__file").withColumn("row_id", F.col("row_id") + F.col("__start"))
    names = [c for c in out.columns if not c.startswith("__") and c != "row_id"]
    return out.select("row_id", *[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in names])


def clean_repairs(rows: DataFrame) -> DataFrame:
    """(place_id, title): the first clean title of each id, by file and row."""
    from placewright.functions.text import garbled

    clean = rows.withColumn("title", F.trim("title")).where((F.col("place_id") != "") & (F.col("title") != "") & ~garbled(F.col("title")))
    return clean.groupBy("place_id").agg(F.min_by("title", F.struct("file", "row_id")).alias("title"))


def read_repairs(spark: SparkSession, folder: str) -> DataFrame:
    """Clean titles by id from all CSV files of a folder; files without placeId and title are skipped."""
    parts = None
    pattern = spark._jvm.org.apache.hadoop.fs.Path(folder.rstrip("/") + "/*.csv")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    for file in sorted(str(f.getPath()) for f in (found or [])):
        df = _strings(spark, file)
        if {"placeId", "title"} <= set(df.columns):
            part = numbered(df.select("placeId", "title")).select(F.col("__file").alias("file"), "row_id", F.col("placeId").alias("place_id"), "title")
            parts = part if parts is None else parts.unionByName(part)
    return clean_repairs(parts) if parts is not None else spark.createDataFrame([], "place_id string, title string")


MARK = re.compile(r'\\.|["{}\[\]]', re.S)
#: Where a stretch of a dump may begin: in a string or not, and how deep in braces and brackets.
START = (False, 0, 0)


def walked(body: str, state: tuple[bool, int, int]) -> Iterator[tuple[int, str, bool, int, int]]:
    """(place, mark, in a string?, braces, brackets) after each brace outside strings, and once at the end with no mark."""
    quoted, braces, brackets = state
    for found in MARK.finditer(body):
        mark = found[0]
        if mark == '"':
            quoted = not quoted
        elif not quoted and len(mark) == 1:
            braces += (mark == "{") - (mark == "}")
            brackets += (mark == "[") - (mark == "]")
            if mark in "{}":
                yield found.start(), mark, quoted, braces, brackets
    yield len(body), "", quoted, braces, brackets


def _moves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each stretch of a file, how it changes the state if it begins outside (0) or inside (1) a string."""
    now: dict[tuple[str, int], list[list]] = {}
    for batch in batches:
        for file, block, body in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            for state in now.setdefault((file, block), [[False, 0, 0], [True, 0, 0]]):
                *_, (_, _, state[0], state[1], state[2]) = walked(body + "}", tuple(state))
    rows = [(file, block, begin, *state) for (file, block), both in now.items() for begin, state in enumerate(both)]
    columns = list(zip(*rows, strict=True)) if rows else [()] * 6
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["file", "block", "begin", "quoted", "braces", "brackets"])


def read_map_dump(spark: SparkSession, path: str) -> DataFrame:
    """One row for each element of a map dump: seq (its place in the dump), type, id, lat, lon, center, tags.

    A dump is one JSON document, often on few lines, and is still read by many tasks: Spark cuts it at closing braces, by byte range. One
    pass tells how each stretch changes the depth of braces and brackets and whether a string is open, from which follows how each begins; a
    second one cuts out the objects of the dump's array of elements. Only the one that runs over the end of a stretch is put together from pieces.
    Files are read one after the other in order of name."""
    pieces = spark.read.text(path, lineSep="}").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    moves: dict[tuple[str, int], dict] = {}
    for r in pieces.mapInArrow(_moves, "file string, block long, begin int, quoted boolean, braces long, brackets long").collect():  # two rows for each stretch
        moves.setdefault((r.file, r.block), {})[r.begin] = r
    begins, file, state = {}, None, START
    for at in sorted(moves):
        state = START if at[0] != file else state
        file, begins[at] = at[0], (len(begins), state)
        move = moves[at][int(state[0])]
        state = move.quoted, state[1] + move.braces, state[2] + move.brackets
    shared = spark.sparkContext.broadcast(begins)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[tuple[str, int], list] = {}  # of each stretch: its number, state, elements begun, text since the last began
        names, kinds = ["stretch", "k", "whole", "body"], (pa.int64(), pa.int64(), pa.bool_(), pa.string())
        for batch in batches:
            rows = []
            for file, block, body in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if (file, block) not in open_:
                    number, state = shared.value[file, block]
                    open_[file, block] = [number, state, 0, [] if state[1] >= 2 and state[2] else None]
                held, body = open_[file, block], body + "}"
                since, depth = 0, held[1][1]
                for place, mark, quoted, braces, brackets in walked(body, held[1]):
                    if mark == "{" and braces == 2 and brackets == 1:
                        since, held[3] = place, []
                        held[2] += 1
                    elif mark == "}" and braces == 1 and depth == 2 and brackets == 1 and held[3] is not None:
                        rows.append((held[0], held[2], held[2] > 0, "".join([*held[3], body[since : place + 1]])))
                        held[3] = None
                    depth = braces
                held[1] = quoted, braces, brackets
                if held[3] is not None:
                    held[3].append(body[since:])
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * 4, kinds, strict=True)], names)
        rows = [(number, k, False, "".join(parts)) for number, _, k, parts in open_.values() if parts is not None]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * 4, kinds, strict=True)], names)

    found = written(pieces.mapInArrow(cut, "stretch long, k long, whole boolean, body string"), "elements")
    # an element that runs over an end has its head last in one stretch, with k elements begun there, and its tail, k = 0, in the next; a head may be followed by whole stretches
    heads = found.where("not whole").withColumn("run", F.sum((F.col("k") > 0).cast("long")).over(Window.orderBy("stretch", F.desc(F.col("k") == 0))))
    joined = heads.groupBy("run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("stretch", F.when(F.col("k") > 0, 1).otherwise(0).alias("head"), "body"))), lambda p: p["body"]), "").alias("body"), F.min(F.when(F.col("k") > 0, F.struct("stretch", "k"))).alias("at"))
    elements = found.where("whole").select("stretch", "k", "body").unionByName(joined.select("at.stretch", "at.k", "body"))
    counts = elements.groupBy("stretch").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select("stretch", F.coalesce(F.sum("n").over(Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    parsed = elements.join(starts.hint("merge"), "stretch").withColumn("e", F.from_json("body", ELEMENT))
    return parsed.select((F.col("start") + F.col("k") - 1).cast("int").alias("seq"), "e.*")


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(lang, category, phrase) of a phrase file; keys that begin with _ and values that aren't lists are skipped."""
    text = spark.read.text(path, wholetext=True)
    langs = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("lang", "body")).where(~F.col("lang").startswith("_"))
    categories = langs.select("lang", F.explode(F.from_json("body", "map<string,string>")).alias("category", "list")).where(~F.col("category").startswith("_"))
    return categories.select("lang", "category", F.explode(F.from_json("list", "array<string>")).alias("phrase"))


def versions(spark: SparkSession, path: str) -> list[str]:
    """The complete versions of a catalog, the newest last."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f"{path}/{f.getPath().getName()}" for f in fs.listStatus(folder) if f.getPath().getName().startswith("v-")) if fs.exists(folder) else []


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete version of a written catalog (or a folder of Parquet files itself), as the search takes it."""
    from placewright.operators.catalog import serving

    return serving(spark.read.parquet((versions(spark, path) or [path])[-1]))


def write_catalog(catalog: DataFrame, path: str, kept: int = KEPT_VERSIONS) -> None:
    """The catalog as a new version in the folder. It is written under a name that readers pass over and becomes the newest by one rename, so there is always a
    whole catalog to read and a failure leaves the one before. The last `kept` versions stay."""
    spark = catalog.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    before = versions(spark, path)
    number = int(before[-1].rsplit("/", 1)[-1].split("-")[1]) + 1 if before else 1
    name = f"v-{number:012d}-{uuid.uuid4().hex}"
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    catalog.write.parquet(f"{path}/.{name}")
    if not fs.rename(hadoop(f"{path}/.{name}"), hadoop(f"{path}/{name}")):
        raise OSError(f"{path}/.{name} can't be renamed; the catalog is as it was")
    for old in versions(spark, path)[: -max(1, kept)]:
        fs.delete(hadoop(old), True)


def write_report(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("overwrite").json(path)


def map_features_to_csv(features: DataFrame) -> DataFrame:
    """Features as flat text rows: subcategories joined by ;, nulls empty."""
    flat = features.withColumn("subcategories", F.concat_ws(";", "subcategories"))
    return flat.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in flat.columns])
