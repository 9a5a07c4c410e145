"""File sources: delimited text with damaged rows, nested documents, feature collections, dated snapshots, pages, rasters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType, columns: Sequence[str] | None = None) -> DataFrame:
    """A CSV with header and declared types; only the asked columns are parsed. A row that doesn't fit gives nulls."""
    df = spark.read.schema(schema).csv(path, header=True, mode="PERMISSIVE")
    return df.select(*columns) if columns else df


def read_csv_checked(spark: SparkSession, path: str, schema: T.StructType, header: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The good rows, and the lines that don't fit the schema (such as an unquoted comma in a text) as ``line``.

    Lines are parsed whole: with the CSV reader, a row is only checked in the columns a query asks for. Empty lines and
    the ``header`` line are left out. A field may not hold a line break.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    lines = lines.where(F.col("value") != header) if header else lines
    ddl = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields], "`__line` string"])
    parsed = lines.select(F.from_csv("value", ddl, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__line"}).alias("r")).select("r.*")
    damaged = F.col("__line").isNotNull()
    return parsed.where(~damaged).drop("__line"), parsed.where(damaged).select(F.col("__line").alias("line"))


def schema_difference(found: T.StructType, declared: T.StructType) -> list[str]:
    """How an inferred schema differs from the declared one, as short sentences."""
    have, want = {f.name: f.dataType for f in found}, {f.name: f.dataType for f in declared}
    out = [f"{n} is missing" for n in want if n not in have] + [f"{n} is new" for n in have if n not in want]
    return out + [f"{n} is {have[n].simpleString()}, not {t.simpleString()}" for n, t in want.items() if n in have and have[n] != t]


def flatten_lists(df: DataFrame, path: Sequence[tuple[str, str]], leaf: Sequence[str]) -> DataFrame:
    """Rows of a document of lists within lists: ``path`` has (array field, name to keep) from the outside in.

    Each level's ``name`` becomes a column called after the array's field; empty and null lists have no rows. The last
    array's elements give the ``leaf`` fields.
    """
    out, kept = df, []
    for i, (field, label) in enumerate(path):
        source = F.col(field) if i == 0 else F.col(f"__e{i - 1}.{field}")
        out = out.withColumn(f"__e{i}", F.explode(source))
        if label:
            kept.append(F.col(f"__e{i}.{label}").alias(f"{field}_{label}"))
    return out.select(*kept, *[F.col(f"__e{len(path) - 1}.{x}").alias(x) for x in leaf])


def flatten_maps(df: DataFrame, column: str, names: Sequence[str]) -> DataFrame:
    """Rows of a document of maps within maps: the keys of each level become a column of ``names``; the rest is ``value``."""
    out = df.select(F.explode(column).alias(names[0], "value"))
    for i, name in enumerate(names[1:], 1):
        out = out.select(*names[:i], F.explode("value").alias(name, "value"))
    return out


def labelled_values(pairs: Column, labels: Sequence[str]) -> list[Column]:
    """Columns from a list of (label, value) structs; the last of a repeated label counts, a missing one is null."""
    found = F.map_from_entries(F.transform(F.array_distinct(F.transform(pairs, lambda p: p["label"])), lambda x: F.struct(x.alias("k"), F.element_at(F.filter(pairs, lambda p: p["label"] == x), -1)["value"].alias("v"))))
    return [F.try_element_at(found, F.lit(n)).alias(n) for n in labels]


def metric_rows(df: DataFrame, column: str, prefix: str = "") -> DataFrame:
    """``metric, value`` rows of a map column, names prefixed."""
    return df.select(F.explode(column).alias("metric", "value")).select(F.concat(F.lit(prefix), "metric").alias("metric"), F.col("value").cast("string").alias("value"))


def flatten_struct(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """The other columns and the struct's fields as ``<prefix><field>``."""
    fields = df.schema[column].dataType.names
    return df.select(*[c for c in df.columns if c != column], *[F.col(f"{column}.{f}").alias(f"{prefix}{f}") for f in fields])


def read_features(spark: SparkSession, path: str, properties: T.StructType, coordinates: T.DataType | None = None) -> DataFrame:
    """Features of a GeoJSON FeatureCollection: its properties, ``geometry_type`` and ``coordinates`` (points by default)."""
    feature = T.StructType([T.StructField("properties", properties), T.StructField("geometry", T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", coordinates or T.ArrayType(T.DoubleType()))]))])
    raw = spark.read.schema(T.StructType([T.StructField("features", T.ArrayType(feature))])).json(path, multiLine=True)
    return raw.select(F.explode("features").alias("f")).select("f.properties.*", F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("coordinates"))


def read_snapshots(spark: SparkSession, folder: str, name: str, dates: Sequence[str] | None = None) -> DataFrame:
    """A table kept as ``folder/snapshot_date=.../name`` parquet directories; only the asked dates are read."""
    df = spark.read.option("basePath", folder).parquet(f"{folder}/snapshot_date=*/{name}")
    return df.where(F.col("snapshot_date").cast("string").isin(list(dates))) if dates else df


def read_pages(spark: SparkSession, folder: str, pattern: str = "*.html", excluded: Sequence[str] = ()) -> DataFrame:
    """``path, text`` of whole files below a folder, without those whose path holds an excluded part."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(folder, wholetext=True)
    df = raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    for part in excluded:
        df = df.where(~F.col("path").contains(part))
    return df


def file_manifest(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``file, bytes, sha256`` of every file below a folder, hashed by the executors."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return raw.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def vertex_centroid(ring: Column) -> tuple[Column, Column]:
    """Mean of a ring's vertices (longitude, latitude); null for fewer than three."""
    n = F.size(ring)
    mean = lambda axis: F.when(n >= 3, F.aggregate(ring, F.lit(0.0), lambda s, p: s + p[axis]) / n)
    return mean("x"), mean("y")


def tile_name(lat: Column, lon: Column, size: int = 1) -> Column:
    """Name of the tile that holds a point by its south-west corner, such as ``S03E117``; also right between -size and 0."""
    south, west = F.floor(lat / size) * size, F.floor(lon / size) * size
    return F.concat(F.when(south < 0, "S").otherwise("N"), F.lpad(F.abs(south).cast("string"), 2, "0"), F.when(west < 0, "W").otherwise("E"), F.lpad(F.abs(west).cast("string"), 3, "0"))


def page_of_path(path: Column) -> Column:
    """The page a file made by :func:`sitegrid.sources.sinks.write_pages` holds."""
    return F.url_decode(F.regexp_replace(F.regexp_extract(path, "/page=([^/]+)/", 1), "%25", "%"))


def read_site(spark: SparkSession, folder: str, excluded: Sequence[str] = ()) -> DataFrame:
    """``page, html`` of the pages that :func:`sitegrid.sources.sinks.write_pages` wrote below a folder."""
    files = read_pages(spark, folder, "*.txt", excluded)
    return files.select(page_of_path(F.col("path")).alias("page"), F.regexp_replace("text", "\n$", "").alias("html"))


def decrypted(df: DataFrame, payload: str, key: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Records of base64 payloads encrypted by AES in CBC mode with padding, and the payloads that can't be read.

    A payload is damaged if it isn't base64, doesn't decrypt with the key, or isn't a JSON record.
    """
    plain = F.try_aes_decrypt(F.try_to_binary(payload, F.lit("base64")), F.lit(key), F.lit("CBC"), F.lit("PKCS")).cast("string")
    marked = df.withColumn("__record", F.from_json(plain, schema, {"mode": "PERMISSIVE"}))
    first = schema.split()[0]
    good = F.col(f"__record.{first}").isNotNull()
    return marked.where(good).select("__record.*"), marked.where(~good).select(payload)


def decoded_point(text: Column) -> list[Column]:
    """``lon, lat, flags`` of a compact point ``[lon,lat,flags]``; nulls where it isn't one."""
    parts = F.from_json(text, "array<double>")
    return [F.get(parts, F.lit(0)).alias("lon"), F.get(parts, F.lit(1)).alias("lat"), F.get(parts, F.lit(2)).cast("int").alias("flags")]


def flatten_level(df: DataFrame, separator: str = "_") -> DataFrame:
    """The columns with each struct replaced by its fields, named after both; structs within them stay as they are."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StructType):
            out += [F.col(f"{f.name}.{inner}").alias(f"{f.name}{separator}{inner}") for inner in f.dataType.names]
        else:
            out.append(F.col(f.name))
    return df.select(*out)
