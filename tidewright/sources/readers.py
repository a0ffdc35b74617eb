"""Scans (SRC-*): batch and streaming readers over one interface, so a transform serves both."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names and types of an observation as the feed sends it.
OBSERVATION = (
    "event_id string, event_type string, location_id string, city string, latitude double, longitude double, "
    "event_time string, ingestion_time string, temperature_c double, humidity_pct double, precipitation_mm double, "
    "pressure_hpa double, wind_speed_kmh double, wind_gust_kmh double, weather_code double, "
    "source string, simulation_run_id string, simulation_fault string"
)
LOG = "message_key string, payload string, topic string, partition int, offset long, kafka_timestamp timestamp, spark_processing_time timestamp"


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """SRC-07; NTZ timestamps become instants in the session's zone."""
    df = spark.read.parquet(f"{directory}/{name}.parquet")
    return df.select(*(F.col(f.name).cast("timestamp").alias(f.name) if isinstance(f.dataType, T.TimestampNTZType) else F.col(f.name) for f in df.schema))


def file_stream(spark: SparkSession, path: str, schema: str | T.StructType, files_per_trigger: int | None = None, kind: str = "parquet") -> DataFrame:
    """SRC-02/05/06: files of a folder, oldest first, so many a micro-batch."""
    reader = spark.readStream.format(kind).schema(schema).option("latestFirst", "false")
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).load(path)


def log_stream(spark: SparkSession, servers: str, topic: str, starting: str = "earliest", most_offsets: int | None = None) -> DataFrame:
    """SRC-01/03: a Kafka topic, where the connector is on the class path."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", starting).option("failOnDataLoss", "true")
    return (reader.option("maxOffsetsPerTrigger", most_offsets) if most_offsets else reader).load()


def log_batch(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """SRC-04: a Kafka topic from its earliest to its latest offsets, as a batch."""
    return spark.read.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").option("endingOffsets", "latest").load()


def rate_stream(spark: SparkSession, rows_per_second: int) -> DataFrame:
    """STR-16: Spark's paced source."""
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()


def bronze(log: DataFrame) -> DataFrame:
    """PRJ-01: the raw record, with lineage and processing time."""
    return log.select(F.col("key").cast("string").alias("message_key"), F.col("value").cast("string").alias("payload"), "topic", "partition", "offset", F.col("timestamp").alias("kafka_timestamp"), F.current_timestamp().alias("spark_processing_time"))


def json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """SRC-09/14: JSON lines, plain or gzip; a line that doesn't parse is kept in _corrupt_record."""
    reader = spark.read.option("columnNameOfCorruptRecord", "_corrupt_record").option("mode", "PERMISSIVE")
    return (reader.schema(f"{schema}, _corrupt_record string") if schema else reader).json(path)


def json_errors(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-14: file, line (from 1, blank lines counted) and text of each line that is neither blank nor parses by ``schema``.

    Rows of a file's block are read in order, so a line's number is its place in its block after the lines of the blocks
    before; only a row for each block is shuffled beside the faulty lines.
    """
    from pyspark.sql import Window

    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    before = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy("file", "_block").agg(F.count("*").alias("_lines"), F.min("_id").alias("_first"))
    blocks = blocks.select("file", "_block", "_first", F.coalesce(F.sum("_lines").over(before), F.lit(0)).alias("_before"))
    parsed = F.from_json("value", f"{schema}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"})
    bad = lines.filter(F.trim("value") != "").filter(parsed["_corrupt_record"].isNotNull())
    return bad.join(blocks, ["file", "_block"]).select("file", (F.col("_id") - F.col("_first") + F.col("_before") + 1).alias("line"), F.col("value").alias("text"))


def parquet_tree(spark: SparkSession, path: str, condition: Column | None = None) -> DataFrame:
    """SRC-10: all Parquet files below a folder, filtered at the scan."""
    df = spark.read.option("recursiveFileLookup", "true").parquet(path)
    return df if condition is None else df.filter(condition)


def partitioned(spark: SparkSession, path: str, columns: list[str] | None = None, **partition: str) -> DataFrame:
    """SRC-11/13: a Hive-partitioned dataset, pruned to partitions and columns."""
    df = spark.read.parquet(path)
    for name, value in partition.items():
        df = df.filter(F.col(name) == value)
    return df.select(*columns) if columns else df


@contextmanager
def footers(spark: SparkSession) -> Iterator[None]:
    """Counts, minima and maxima that are computed inside come from Parquet footers where these have them; settings are as before afterwards."""
    sources = "spark.sql.sources.useV1SourceList"
    wanted = {sources: ",".join(x for x in spark.conf.get(sources).split(",") if x.strip() != "parquet"), "spark.sql.parquet.aggregatePushdown": "true"}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _inventory(df: DataFrame, by: list[str], ends: list[str]) -> DataFrame:
    """by, rows, n_ and, for ``ends``, least_ and most_ of each column; inside ``footers`` all is pushed into the scan."""
    counts = [F.count(c).alias(f"n_{c}") for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.count("*").alias("rows"), *counts, *(f(c).alias(f"{name}_{c}") for c in ends for name, f in (("least", F.min), ("most", F.max))))


def _found(df: DataFrame, by: list[str], ends: list[str]) -> DataFrame | None:
    """``_inventory`` computed from footers, None where a file's footer has no ends of a column (one without values)."""
    try:
        with footers(df.sparkSession):
            plan = _inventory(df, by, ends)
            found = plan.collect()
    except Exception as error:  # the job's error names what its executors met
        if "No min/max found" not in str(error):
            raise
        return None
    told = df.sparkSession.createDataFrame(found, T.StructType([T.StructField(f.name, f.dataType) for f in plan.schema]))
    return told.fillna(0, [c for c in plan.columns if c == "rows" or c.startswith("n_")])  # no file, no footer, no count


def inventory(spark: SparkSession, path: str, by: list[str] | None = None) -> DataFrame:
    """SRC-12: of each partition (``by``: all partition columns) rows, and of each column nulls, least and most value, from footers.

    A row (by, rows, column, nulls, least, most) for each column; least and most are text, null for types whose footers
    have no exact ends (text, times) and for columns without values.  No value is read, but for the ends of a column that
    has no value in some file: such a file's footer has none.  The result has a row a partition and column; the listing
    of files on the driver is larger anyway.
    """
    by = by or []
    with footers(spark):
        df = spark.read.parquet(path)
    exact = (T.IntegralType, T.FloatType, T.DoubleType, T.DateType, T.BooleanType)
    ends = [f.name for f in df.schema if f.name not in by and isinstance(f.dataType, exact)]
    rows = _found(df, by, ends)
    if rows is None:
        rows = _found(df, by, [])
        for c in ends:
            one = _found(df.select(*by, c), by, [c])
            if one is None:
                one = _inventory(spark.read.parquet(path).select(*by, c), by, [c])
            one = one.select(F.struct(*by, F.lit(0)).alias("_of"), f"least_{c}", f"most_{c}")
            rows = rows.withColumn("_by", F.struct(*by, F.lit(0))).join(one, F.col("_by").eqNullSafe(F.col("_of"))).drop("_of", "_by")
    end = lambda kind, c: F.col(f"{kind}_{c}").cast("string") if c in ends else F.lit(None).cast("string")
    names = [c for c in df.columns if c not in by]
    cells = [F.struct(F.lit(c).alias("column"), (F.col("rows") - F.col(f"n_{c}")).alias("nulls"), end("least", c).alias("least"), end("most", c).alias("most")) for c in names]
    return rows.select(*by, "rows", F.inline(F.array(*cells)))


def from_version(start: int) -> str:
    """A path pattern of the folder names ``batch=N`` with N of ``start`` or more, however long the log becomes."""
    digits, found = str(max(start, 0)), []
    for i, d in enumerate(digits):  # the same digits so far, then a larger one
        if d != "9":
            found.append(digits[:i] + f"[{int(d) + 1}-9]" + "[0-9]" * (len(digits) - i - 1))
    found += [digits, "[1-9]" + "[0-9]" * len(digits) + "*"]
    return "batch={" + ",".join(found) + "}"


def change_stream(spark: SparkSession, path: str, schema: str | T.StructType, start: int = 0, files_per_trigger: int | None = None) -> DataFrame:
    """SRC-06: a log of change folders (``batch=N``, as ``merge.write_changes`` makes them) as a stream from version ``start`` on.

    Earlier versions are not even listed.  ``batch`` is the version of a row; a restart from a checkpoint goes on after
    what it has seen, whatever ``start`` says then.
    """
    wanted = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    reader = spark.readStream.format("parquet").schema(T.StructType([*wanted.fields, T.StructField("batch", T.LongType())])).option("basePath", path)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).load(f"{path}/{from_version(start)}")


def snapshot(spark: SparkSession, path: str) -> str:
    """SRC-08: a digest of a folder's file names, sizes and times, to see whether it changed between two reads."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    first = rows.select(F.count("*"), F.bit_xor(F.xxhash64("path", "length", "modificationTime"))).first()
    return f"{first[0]}-{first[1] or 0}"


def catalog(spark: SparkSession, path: str, membership: str | None = None, expected: int | None = None) -> DataFrame:
    """SRC-15: the location catalog (a JSON list), validated; optionally those of one dataset."""
    df = spark.read.option("multiLine", "true").json(path)
    bad = df.agg((F.count("*") - F.countDistinct("location_id")).alias("repeated"), F.count_if(~F.col("latitude").between(-90, 90) | ~F.col("longitude").between(-180, 180) | F.col("location_id").isNull()).alias("invalid")).first()
    if bad.repeated or bad.invalid:
        raise ValueError(f"catalog: {bad.repeated} repeated and {bad.invalid} invalid locations")
    df = df.filter(F.array_contains("dataset_memberships", membership)) if membership else df
    if expected is not None and df.count() != expected:
        raise ValueError(f"catalog: {df.count()} locations instead of {expected}")
    return df


@dataclass(frozen=True)
class CatalogRules:
    """What a catalog of places must be: fields, names by kind, fixed values, bounds of coordinates and members of datasets."""

    required: tuple[str, ...]
    kinds: dict[str, int]
    fixed: dict[str, str]
    latitude: tuple[float, float]
    longitude: tuple[float, float]
    whole_set: str
    subset: str
    subset_ids: tuple[str, ...]
    prefix: str = ""
    id_col: str = "location_id"
    name_col: str = "province_name"
    kind_col: str = "admin_type"


def catalog_errors(df: DataFrame, rules: CatalogRules) -> DataFrame:
    """SRC-15: (location_id, code) of each rule that a record breaks, and (null, code) of each that the catalog breaks as a whole.

    The catalog is valid where this is empty.  Ids, names and coordinates are unique; each kind has its number of places;
    each record has the required fields, fixed values and plausible coordinates and belongs to the whole set; the subset
    has exactly its ids.
    """
    place, lat, lon = F.col(rules.id_col), F.col("latitude").cast("double"), F.col("longitude").cast("double")
    within = lambda x, ends: F.coalesce(x.between(*ends), F.lit(False))
    member = lambda name: F.coalesce(F.array_contains("dataset_memberships", name), F.lit(False))
    checks = {f"MISSING_{c.upper()}": F.col(c).isNull() | (F.col(c).cast("string") == "") for c in rules.required}
    checks |= {f"INVALID_{c.upper()}": F.coalesce(F.col(c) != v, F.lit(False)) for c, v in rules.fixed.items()}
    checks["INVALID_LOCATION_ID"] = ~F.coalesce(place.startswith(rules.prefix), F.lit(False))
    checks[f"INVALID_{rules.kind_col.upper()}"] = ~F.coalesce(F.col(rules.kind_col).isin(*rules.kinds), F.lit(False))
    checks["COORDINATE_NOT_NUMERIC"] = lat.isNull() | lon.isNull()
    checks["COORDINATE_OUT_OF_RANGE"] = lat.isNotNull() & lon.isNotNull() & ~(within(lat, (-90, 90)) & within(lon, (-180, 180)))
    checks["COORDINATE_OUT_OF_ENVELOPE"] = lat.isNotNull() & lon.isNotNull() & ~(within(lat, rules.latitude) & within(lon, rules.longitude))
    checks["NOT_IN_WHOLE_SET"] = ~member(rules.whole_set)
    checks["WRONG_SUBSET"] = member(rules.subset) != F.coalesce(place.isin(*rules.subset_ids), F.lit(False))
    codes = F.array_compact(F.array(*(F.when(broken, code) for code, broken in checks.items())))
    records = df.select(place.alias(rules.id_col), F.explode(codes).alias("code"))
    whole = {
        "WRONG_COUNT": F.count("*") != sum(rules.kinds.values()),
        "REPEATED_LOCATION_ID": F.countDistinct(place) != F.count("*"),
        "REPEATED_NAME": F.countDistinct(rules.name_col) != F.count("*"),
        "REPEATED_COORDINATE": F.countDistinct(F.when(lat.isNotNull() & lon.isNotNull(), F.struct(lat, lon))) != F.count(F.when(lat.isNotNull() & lon.isNotNull(), 1)),
        "SUBSET_INCOMPLETE": F.countDistinct(F.when(place.isin(*rules.subset_ids), place)) != len(set(rules.subset_ids)),
        **{f"WRONG_COUNT_{kind}": F.count_if(F.col(rules.kind_col) == kind) != n for kind, n in rules.kinds.items()},
    }
    one = df.agg(F.array_compact(F.array(*(F.when(broken, code) for code, broken in whole.items()))).alias("_codes"))
    return records.unionByName(one.select(F.lit(None).cast("string").alias(rules.id_col), F.explode("_codes").alias("code")))


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """SRC-16."""
    return spark.createDataFrame(rows, schema)


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """PRJ-05: ``df`` if it has the columns, else an error that names what lacks."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df


def call_units(requests: DataFrame, time: str, units: str, spans: dict[str, int]) -> DataFrame:
    """SRC-18: units spent in the trailing spans (seconds) of each request of a quota ledger, by range and not by rows.

    Requests of a second are added up first.  Seconds are bucketed by day (by the longest span, if that is more), and
    each is carried into the bucket after it while it is in reach.  Requests without a time see each other alone.
    """
    longest = max(spans.values())
    width = max(86400, longest)
    requests = requests.withColumn("_s", F.unix_seconds(time))
    spent = requests.groupBy("_s").agg(F.sum(units).alias("_sum"), F.count(units).alias("_n"))
    own = F.floor(F.col("_s") / width)
    carried = spent.select("*", F.explode_outer(F.sequence(own, F.floor((F.col("_s") + longest) / width))).alias("_bucket"))
    carried = carried.withColumn("_own", F.col("_s").isNull() | (F.col("_bucket") == own))
    told = _trailing(carried, spans).filter("_own").select(F.col("_s").alias("_at"), *spans)
    return requests.join(told, F.col("_s").eqNullSafe(F.col("_at")), "left").drop("_s", "_at")


def _trailing(seconds: DataFrame, spans: dict[str, int]) -> DataFrame:
    """_s, _own and the trailing sums of ``seconds`` (_bucket, _s, _own, _sum, _n: values that are not null).

    A second's sum counts from then on and is taken off when it falls out of a span, so one running sum gives a span
    in one pass, however many seconds it holds.  Sums with fractions would be rounded by that; they are added up by window.
    """
    kind, bucket = seconds.schema["_sum"].dataType, Window.partitionBy("_bucket").orderBy("_s")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return seconds.select("_s", "_own", *(F.sum("_sum").over(bucket.rangeBetween(-(n - 1), 0)).alias(name) for name, n in spans.items()))
    zero = F.lit(0).cast(kind)
    total = F.coalesce("_sum", zero)
    sums, counts = {1: total, 0: zero, -1: -total}, {1: F.col("_n"), 0: F.lit(0).cast("long"), -1: -F.col("_n")}

    def change(at: Column, own: Column, signs: dict[str, int]) -> Column:
        return F.struct(at.alias("_s"), own.alias("_own"), *(x for name, sign in signs.items() for x in (sums[sign].alias(f"_sum_{name}"), counts[sign].alias(f"_n_{name}"))))

    spend = change(F.col("_s"), F.col("_own"), dict.fromkeys(spans, 1))
    expire = [change(F.col("_s") + n, F.lit(False), {other: -(other == name) for other in spans}) for name, n in spans.items()]
    changes = seconds.select("_bucket", F.inline(F.when(F.col("_s").isNull(), F.array(spend)).otherwise(F.array(spend, *expire))))
    so_far = bucket.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    found = {name: F.when(F.sum(f"_n_{name}").over(so_far) > 0, F.sum(f"_sum_{name}").over(so_far)).cast(kind) for name in spans}
    return changes.select("_s", "_own", *(c.alias(name) for name, c in found.items()))
