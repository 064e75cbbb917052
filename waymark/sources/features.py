"""Feature tables: GeoJSON and Esri JSON in, GeoJSON out.

A feature table has id, id_long (null where the id is no integer), geom_type, parts (arrays of points), lon and lat,
geometry_json, properties (text to text), properties_json and seq (the order of arrival).
"""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import POINT, boxes_meet, feature_bbox
from ..functions.values import number
from ..plans.steps import Files, kept
from .collections import collection_texts

PARTS = f"array<array<{POINT}>>"
#: Where ids and coordinates are looked for, first match first. Fixed values.
ESRI_IDS = ("OBJECTID", "ObjectId", "objectid", "FID", "fid", "ID", "id")
LON, LAT = ("lon", "lng", "longitude", "x"), ("lat", "latitude", "y")
_FEATURE = "struct<type:string,id:string,geometry:string,properties:string,attributes:string>"


def _points(text: Column, path: str, depth: int) -> Column:
    """Coordinates at a JSON path, nested ``depth`` deep in arrays of points (0: one point), as parts."""
    raw = F.from_json(F.get_json_object(text, path), "array<" * (depth + 1) + "double" + ">" * (depth + 1))
    point = lambda p: F.struct(F.get(p, 0).alias("x"), F.get(p, 1).alias("y"))
    line = lambda ps: F.transform(ps, point)
    if depth == 0:
        return F.when(raw.isNotNull(), F.array(F.array(point(raw))))
    if depth == 1:
        return F.when(raw.isNotNull(), F.array(line(raw)))
    return F.transform(raw if depth == 2 else F.flatten(raw), line)


def geojson_parts(kind: Column, geometry: Column) -> Column:
    depth = {"Point": 0, "MultiPoint": 1, "LineString": 1, "Polygon": 2, "MultiLineString": 2, "MultiPolygon": 3}
    out = None
    for name, d in depth.items():
        value = _points(geometry, "$.coordinates", d)
        out = F.when(kind == name, value) if out is None else out.when(kind == name, value)
    return out


def _closed(ring: Column) -> Column:
    return F.when((F.size(ring) >= 3) & (F.element_at(ring, 1) != F.element_at(ring, -1)), F.concat(ring, F.slice(ring, 1, 1))).otherwise(ring)


def _esri(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Features of Esri JSON as GeoJSON features; those without a geometry are left out."""
    g = F.col("f.geometry")
    has = lambda key: F.get_json_object(g, f"$.{key}").isNotNull()
    paths = F.from_json(F.get_json_object(g, "$.paths"), "array<array<array<double>>>")
    rings = F.from_json(F.get_json_object(g, "$.rings"), "array<array<array<double>>>")
    shape = (
        F.when(has("x") & has("y"), F.to_json(F.struct(F.lit("Point").alias("type"), F.array(F.get_json_object(g, "$.x").cast("double"), F.get_json_object(g, "$.y").cast("double")).alias("coordinates"))))
        .when(has("points"), F.concat(F.lit('{"type":"MultiPoint","coordinates":'), F.get_json_object(g, "$.points"), F.lit("}")))
        .when(has("paths") & (F.size(paths) == 1), F.to_json(F.struct(F.lit("LineString").alias("type"), F.element_at(paths, 1).alias("coordinates"))))
        .when(has("paths") & (F.size(paths) > 1), F.to_json(F.struct(F.lit("MultiLineString").alias("type"), paths.alias("coordinates"))))
        .when(has("rings"), F.to_json(F.struct(F.lit("Polygon").alias("type"), F.transform(rings, _closed).alias("coordinates"))))
    )
    own = F.coalesce(*[F.get_json_object("f.attributes", f"$.{k}") for k in ESRI_IDS], F.col("seq").cast("string"))
    return rows.select(*keep, "seq", own.alias("id"), shape.alias("geometry_json"), F.coalesce("f.attributes", F.lit("{}")).alias("properties_json")).where("geometry_json is not null")


def parse_documents(docs: DataFrame, column: str = "value", keep: str | None = None) -> DataFrame:
    """Feature rows of JSON documents: a FeatureCollection, a Feature, a bare geometry, or Esri JSON.

    Features of one document come in its order; a feature without an id gets its place as id. A null geometry stays
    null. A document of another kind raises. Parsing runs in the JVM, one document to a row: for documents that are
    rows of a table. Large files are read by ``read_features``. ``keep`` names a column of the documents that goes along.
    """
    text = F.col(column)
    kind = F.get_json_object(text, "$.type")
    listed = F.from_json(F.get_json_object(text, "$.features"), f"array<{_FEATURE}>")
    single = F.array(F.from_json(text, _FEATURE))
    geometry = F.array(F.from_json(F.to_json(F.struct(F.lit("Feature").alias("type"), F.lit(None).cast("string").alias("id"), text.alias("geometry"), F.lit("{}").alias("properties"), F.lit(None).cast("string").alias("attributes"))), _FEATURE))
    shapes = ("Point", "MultiPoint", "LineString", "MultiLineString", "Polygon", "MultiPolygon")
    esri = kind.isNull() & F.get_json_object(text, "$.features").isNotNull()
    chosen = F.when(kind == "FeatureCollection", listed).when(kind == "Feature", single).when(kind.isin(*shapes), geometry).when(esri, listed).otherwise(F.raise_error(F.lit("neither GeoJSON nor Esri JSON")).cast(f"array<{_FEATURE}>"))
    rows = docs.select(*([keep] if keep else []), esri.alias("esri"), F.posexplode(chosen).alias("seq", "f")).withColumn("seq", F.col("seq").cast("long"))
    return _rows_of(rows, [keep] if keep else [])


def _rows_of(rows: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The feature table of parsed features (esri, seq, f), with the columns of ``keep``."""
    keep = keep or []
    plain = rows.where("not esri").select(*keep, "seq", F.coalesce("f.id", F.col("seq").cast("string")).alias("id"), F.col("f.geometry").alias("geometry_json"), F.coalesce("f.properties", F.lit("{}")).alias("properties_json"))
    return shaped(plain.unionByName(_esri(rows.where("esri"), keep)), keep)


def _lookup(properties: Column, names: tuple[str, ...]) -> Column:
    lower = F.transform_keys(properties, lambda k, v: F.lower(k))
    return F.coalesce(*[F.try_element_at(lower, F.lit(n)) for n in names])


def with_lon_lat(table: DataFrame) -> DataFrame:
    """Adds lon and lat: both from properties where both are numbers, else the geometry's first point.

    The first point is looked for only where every level of nesting above a point has two members or more.
    """
    px, py = number(_lookup(F.col("properties"), LON)), number(_lookup(F.col("properties"), LAT))
    lists = F.size("parts")
    first = F.get(F.get(F.col("parts"), 0), 0)
    plain = (F.col("geom_type") == "Point") | ((F.col("geom_type").isin("LineString", "MultiPoint")) & (F.size(F.get(F.col("parts"), 0)) >= 2)) | ((lists >= 2) & (F.size(F.get(F.col("parts"), 0)) >= 2))
    both = px.isNotNull() & py.isNotNull()
    return table.withColumns({"lon": F.when(both, px).when(plain, first["x"]), "lat": F.when(both, py).when(plain, first["y"])})


def upgraded(table: DataFrame) -> DataFrame:
    """A feature table of before lon and lat were kept, with both; others as they are."""
    return table if {"lon", "lat"} <= set(table.columns) or not {"geom_type", "parts", "properties"} <= set(table.columns) else with_lon_lat(table)


def shaped(rows: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The feature table of rows (seq, id, geometry_json, properties_json), with the columns of ``keep``."""
    kind = F.get_json_object("geometry_json", "$.type")
    out = rows.withColumns({"geom_type": kind, "parts": geojson_parts(kind, F.col("geometry_json")), "properties": F.coalesce(F.from_json("properties_json", "map<string,string>"), F.create_map().cast("map<string,string>")), "id_long": F.expr("try_cast(id as bigint)")})
    return with_lon_lat(out).select("id", "id_long", "geom_type", "parts", "geometry_json", "properties", "properties_json", "lon", "lat", "seq", *(keep or []))


#: Files of one document, and of one feature a line.
SUFFIXES, LINES = (".json", ".geojson"), (".ndjson", ".jsonl", ".geojsonl")


def read_features(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """.json or .geojson files (UTF-8), or files of one feature a line, as a feature table.

    A path may be a file, a folder or a pattern. Collections of any size are read by many tasks each, a range of bytes to a task (see
    ``sources.collections``); default ids and ``seq`` run through all files, by path and place.
    """
    paths = [path] if isinstance(path, str) else list(path)
    if all(p.lower().endswith(LINES) for p in paths):
        return _read_lines(spark, paths)
    if not all(p.lower().endswith(SUFFIXES) for p in paths):
        raise ValueError("only .json and .geojson files, or files of lines, are read")
    return read_collections(spark, paths)


def read_collections(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``read_features`` for files, folders or patterns of documents, whatever their names."""
    texts, single = collection_texts(spark, paths)
    rows = texts.select("esri", "seq", F.from_json("value", _FEATURE).alias("f"))
    alone = {r.file: r.seq for r in single.collect()}  # names of files of one feature each, as many as Spark lists
    out = _rows_of(rows)
    if alone:
        docs = spark.read.text([unquote(f) for f in alone], wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
        places = spark.createDataFrame(list(alone.items()), "file string, place long")
        own = parse_documents(docs.join(F.broadcast(places), "file"), keep="place")
        out = out.unionByName(own.withColumns({"id": F.when(F.col("id") == F.col("seq").cast("string"), F.col("place").cast("string")).otherwise(F.col("id")), "seq": F.col("place")}).withColumn("id_long", F.expr("try_cast(id as bigint)")).drop("place"))
    return out


def _read_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    text = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value").where(F.trim("value") != "")
    rows = kept(text.withColumn("task", F.spark_partition_id()), "lines")
    # within a range the running number grows; ranges are counted, and shifted by the counts of those before
    ranges = rows.groupBy("file", "block", "task").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.join(F.broadcast(ranges.select("file", "block", "task", before.alias("before"))), ["file", "block", "task"])
    place = F.col("before") + F.row_number().over(Window.partitionBy("file", "block", "task").orderBy("at")) - 1
    own = parse_documents(placed.select("value", place.alias("place")), keep="place")
    own = own.withColumn("id", F.when(F.col("id") == F.col("seq").cast("string"), F.col("place").cast("string")).otherwise(F.col("id")))
    return own.withColumns({"seq": F.col("place"), "id_long": F.expr("try_cast(id as bigint)")}).drop("place")


def import_features(spark: SparkSession, path: str, table: str, keep_source: bool = False) -> DataFrame:
    """Read a file into a new table of the catalog, which must not exist; nothing is left of an import that fails.

    Rows are written to a folder of their own first, and become the table when all are there. ``keep_source`` copies the file next to them.
    """
    if spark.catalog.tableExists(table):
        raise ValueError(f"{table} exists")
    folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/imported/{table}-{uuid.uuid4().hex}"
    files = Files(spark, folder)
    try:
        rows = read_features(spark, path)
        rows.write.parquet(f"{folder}/rows")
        if keep_source:
            files.copy(path, f"{folder}/{path.rsplit('/', 1)[-1]}")
        spark.catalog.createTable(table, path=f"{folder}/rows", source="parquet", schema=rows.schema)
    except Exception:
        files.remove(folder)
        raise
    return spark.table(table)


def geojson(table: DataFrame, box: Column | None = None, limit: int | None = None, lon: str | None = None, lat: str | None = None) -> DataFrame:
    """One GeoJSON feature a row (``feature``), in order; ``box`` keeps the features that meet it.

    ``lon`` and ``lat`` name columns that override the geometry, but only a null one or a point.
    """
    out = table
    geometry = F.col("geometry_json")
    if lon and lat:
        x, y = number(F.col(lon)), number(F.col(lat))
        own = F.to_json(F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates")))
        override = x.isNotNull() & y.isNotNull() & (F.col("geom_type").isNull() | (F.col("geom_type") == "Point"))
        geometry = F.when(override, own).otherwise(geometry)
        out = out.withColumn("parts", F.when(override, F.array(F.array(F.struct(x.alias("x"), y.alias("y"))))).otherwise(F.col("parts")))
    if box is not None:
        out = out.where(boxes_meet(feature_bbox(F.col("parts")), box))
    text = F.concat(F.lit('{"type":"Feature","id":'), F.to_json(F.array("id")).substr(F.lit(2), F.length(F.to_json(F.array("id"))) - 2), F.lit(',"geometry":'), F.coalesce(geometry, F.lit("null")), F.lit(',"properties":'), F.coalesce("properties_json", F.lit("{}")), F.lit("}"))
    out = out.select("id", "seq", text.alias("feature")).orderBy("seq")
    return out.limit(limit) if limit and limit > 0 else out


def export_selected(table: DataFrame, ids: DataFrame) -> DataFrame:
    """GeoJSON features of the rows whose id, as text, is among ``ids`` (id); null geometries are left out.

    Properties gain id and geom_type where they lack them.
    """
    kept = table.where("geometry_json is not null").join(ids.select(F.col("id").cast("string").alias("id")).distinct(), "id", "left_semi")
    missing = F.map_from_arrays(F.array(F.lit("id"), F.lit("geom_type")), F.array("id", "geom_type"))
    whole = F.map_concat(F.map_filter(missing, lambda k, v: ~F.map_contains_key("properties", k)), "properties")
    return geojson(kept.withColumn("properties_json", F.to_json(whole)))


#: Where a client's feature keeps its id, first match first. Fixed values.
CLIENT_IDS = ("id", "ID", "fid", "FID", "objectid", "OBJECTID")


def client_key(feature: Column) -> Column:
    """The key of a client's feature (its JSON text): its own mark, else an id among its properties, else the feature's id."""
    own = F.get_json_object(feature, "$.properties.__client_id")
    marked = F.when(~own.isin("", "0", "0.0", "false"), own)  # what counts as no mark
    plain = F.get_json_object(feature, "$.id")
    return F.coalesce(marked, *[F.get_json_object(feature, f"$.properties.{k}") for k in CLIENT_IDS], F.when(~plain.rlike(r"^\s*[\[{]"), plain))


def export_client(features: DataFrame, ids: DataFrame, column: str = "feature") -> DataFrame:
    """id and feature of those of a client's ``features`` (JSON text, one a row) whose key is among ``ids`` (id, as text); as they came.

    A feature without a key is none of them. A collection's text gives such rows by ``sources.collections``.
    """
    keyed = features.select(client_key(F.col(column)).alias("id"), F.col(column).alias("feature"))
    return keyed.join(ids.select(F.col("id").cast("string").alias("id")).distinct(), "id", "left_semi")


def write_geojson(features: DataFrame, path: str) -> None:
    """Features as lines of text files: one feature a line, in as many files as there are partitions."""
    features.select("feature").write.text(path)


def fields(table: DataFrame, most: int | None = None) -> DataFrame:
    """``field``: the columns, and a properties.* field for each different key (one nested level too), by name, the first ``most`` if given."""
    keys = table.select(F.explode(F.map_keys("properties")).alias("k"))
    nested = table.select(F.explode(F.map_keys(F.from_json(F.try_element_at("properties", F.lit("properties")), "map<string,string>"))).alias("k"))
    names = keys.unionByName(nested).distinct().select(F.concat(F.lit("properties."), "k").alias("field"))
    columns = table.sparkSession.createDataFrame([(c,) for c in table.columns], "field string")
    out = columns.unionByName(names).distinct().orderBy(F.lower("field"), "field")
    return out if most is None else out.limit(most)
