"""File inventory, encodings, delimited text and content checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.functions import columns as C
from loamgrid.functions import fixed_values as V
from loamgrid.session import write_and_read

PROBE_ROWS = 200
#: Characters of a line that the probe scores: read with a foreign line end, a whole file is one line.
PROBE_CHARS = 1 << 18
# Names of the encodings as the JVM knows them; the byte-order-marked form is read as plain UTF-8.
JVM_NAME = {"utf-8-sig": "UTF-8", "cp936": "GBK", "cp950": "Big5", "latin1": "ISO-8859-1", "utf-16-le": "UTF-16LE", "utf-16-be": "UTF-16BE"}


def csv_options(encoding: str, sep: str) -> dict[str, str]:
    """Reader options of one parse; two-byte encodings need their line end named."""
    opts = {"encoding": JVM_NAME.get(encoding, encoding.upper()), "sep": sep}
    return {**opts, "lineSep": "\n"} if encoding.startswith("utf-16") else opts


def list_files(spark: SparkSession, roots: list[str], glob: str = "*") -> DataFrame:
    """path, length, modificationTime of every file below the roots, once per path; contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(roots)
    return f.select("path", "length", "modificationTime").dropDuplicates(["path"])


def encoding_candidates(content: Column) -> Column:
    """Ordered encodings to try: what the byte order mark says, then the fixed list without repeats."""
    plain = list(dict.fromkeys(V.ENCODING_ALIAS.get(e, e) for e in V.ENCODINGS))
    lit = lambda xs: F.array(*[F.lit(x) for x in xs])
    h3, h2 = F.substring(content, 1, 3), F.substring(content, 1, 2)
    first = (
        F.when(h3 == F.lit(b"\xef\xbb\xbf"), lit(["utf-8-sig"]))
        .when((h2 == F.lit(b"\xff\xfe")) | (h2 == F.lit(b"\xfe\xff")), lit(["utf-16", "utf-16-le", "utf-16-be"]))
        .otherwise(F.array().cast("array<string>"))
    )
    return F.array_distinct(F.concat(first, lit(plain)))


def field_position(cols: Column, field: str) -> Column:
    """1-based position of the column that means the field: exact alias first, then containment; 0 for none."""
    keys = [C.normalize_name(a) for a in V.FIELD_ALIASES[field]]
    norm = F.transform(cols, C.normalize_header)
    exact = F.array(*[F.lit(k) for k in keys])
    hit = F.get(F.filter(exact, lambda k: F.array_contains(norm, k)), F.lit(0))
    part = F.get(F.filter(norm, lambda n: F.exists(F.array(*[F.lit(k) for k in keys if len(k) > 2]), lambda k: F.contains(n, k))), F.lit(0))
    return F.coalesce(F.nullif(F.array_position(norm, hit), F.lit(0)), F.array_position(norm, part), F.lit(0)).cast("int")


def csv_parse_score(cols: Column, encoding: Column, valid: dict[str, Column], at: dict[str, Column] | None = None) -> Column:
    """How plausible one parse of a table is; ``valid`` holds numeric rows per core field, ``at`` known field positions."""
    has = {k: (at[k] if at else field_position(cols, k)) > 0 for k in V.REQUIRED_FIELDS}
    hits = reduce(lambda a, b: a + b, [h.cast("int") for h in has.values()])
    header = F.concat_ws("|", cols)
    n = F.size(cols)
    cjk = F.length(header) - F.length(F.regexp_replace(header, r"[一-鿿]", ""))
    one = n <= 1
    s = F.least(n, F.lit(20)) * 0.8 + hits * 40.0
    s = s + F.when(has["lon"] & has["lat"], 30.0).otherwise(0.0) + F.when(has["som"], 40.0).otherwise(0.0)
    s = s + F.least(cjk, F.lit(30)) * 2.5 - C.mojibake_penalty(header)
    s = s - F.when(one, 80.0).otherwise(0.0) - F.when((n == 1) & F.get(cols, F.lit(0)).rlike("[,\t;|]"), 120.0).otherwise(0.0)
    for k in V.REQUIRED_FIELDS:
        s = s + F.when(has[k], F.least(valid[k], F.lit(50)) * 0.25).otherwise(0.0)
    return s - F.when((encoding == "latin1") & (hits < 3), 100.0).otherwise(0.0)


def allow_all_charsets(spark: SparkSession) -> None:
    """Lets the CSV source use every charset of the JVM; by default Spark 4 takes the Unicode ones and Latin-1."""
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")


def probe_candidates(spark: SparkSession, path: str) -> DataFrame:
    """One row per (encoding, separator): header columns, numeric counts and score from a 200-row probe."""
    allow_all_charsets(spark)
    lines = None
    for e in dict.fromkeys(V.ENCODING_ALIAS.get(e, e) for e in V.ENCODINGS):
        raw = spark.read.options(quote="", **csv_options(e, "\u0001")).schema("line string").csv(path).limit(PROBE_ROWS + 1)
        part = raw.select(F.lit(e).alias("encoding"), F.monotonically_increasing_id().alias("pos"), F.regexp_replace(F.left("line", F.lit(PROBE_CHARS)), "^﻿", "").alias("line"))
        lines = part if lines is None else lines.unionByName(part)
    lines = write_and_read(lines, "csv-probe")  # at most 201 lines per encoding, scanned once
    by_sep = lines.select("*", F.explode(F.array(*[F.lit(s) for s in V.SEPARATORS])).alias("sep"))
    cells = by_sep.withColumn("cells", F.transform(F.split("line", F.concat(F.lit("\\Q"), F.col("sep"), F.lit("\\E"))), lambda c: F.btrim(c, F.lit(' "'))))
    head = cells.groupBy("encoding", "sep").agg(F.min_by("cells", "pos").alias("cols"), F.min("pos").alias("first"))
    at = head.select("encoding", "sep", "cols", "first", *[field_position(F.col("cols"), k).alias(f"at_{k}") for k in V.REQUIRED_FIELDS])
    at = write_and_read(at, "csv-heads")  # one row per candidate
    rows = cells.join(at.drop("cols"), ["encoding", "sep"]).filter(F.col("pos") > F.col("first"))
    num = lambda k: F.count_if(C.extract_numeric(F.get("cells", F.col(f"at_{k}") - 1)).isNotNull() & (F.col(f"at_{k}") > 0))
    got = rows.groupBy("encoding", "sep").agg(*[num(k).alias(f"n_{k}") for k in V.REQUIRED_FIELDS])
    t = at.join(got, ["encoding", "sep"], "left")
    val = {k: F.coalesce(f"n_{k}", F.lit(0)) for k in V.REQUIRED_FIELDS}
    return t.select("encoding", "sep", "cols", csv_parse_score(F.col("cols"), F.col("encoding"), val, {k: F.col(f"at_{k}") for k in V.REQUIRED_FIELDS}).alias("score"))


def scan_csv_best(spark: SparkSession, path: str) -> tuple[DataFrame, str, str]:
    """The table read with the best (encoding, separator), and these two. The score of the first 200 rows proposes an
    encoding; it is taken only if every line of the file decodes with it, else the next best is tried."""
    order = {e: i for i, e in enumerate(V.ENCODINGS)}
    cands = probe_candidates(spark, path).select("encoding", "sep", "score").collect()  # at most 44 rows
    cands.sort(key=lambda r: (-r["score"], order[r["encoding"]], V.SEPARATORS.index(r["sep"])))
    clean: dict[str, bool] = {}
    for best in cands:
        e = best["encoding"]
        if clean.setdefault(e, clean[e] if e in clean else decodes(spark, path, e)):
            break
    else:
        best = cands[0]
    df = spark.read.options(header=True, **csv_options(best["encoding"], best["sep"])).csv(path)
    return df, best["encoding"], best["sep"]


def decodes(spark: SparkSession, path: str, encoding: str) -> bool:
    """Whether every line of the file decodes: one distributed pass for replacement characters."""
    allow_all_charsets(spark)
    lines = spark.read.options(quote="", **csv_options(encoding, "\u0001")).schema("line string").csv(path)
    return lines.filter(F.contains("line", F.lit("�"))).isEmpty()


def read_table_simple(spark: SparkSession, path: str, sep: str | None = None, schema: str | None = None) -> DataFrame:
    """First encoding of a short list with which every line decodes; the separator that the header holds most often."""
    allow_all_charsets(spark)
    e = next((e for e in V.SIMPLE_ENCODINGS if decodes(spark, path, e)), V.SIMPLE_ENCODINGS[-1])
    if sep is None:
        head = spark.read.options(quote="", **csv_options(e, "\u0001")).schema("line string").csv(path).first()
        sep = max(V.SEPARATORS, key=lambda s: ((head["line"] or "") if head else "").count(s))
    r = spark.read.option("header", True).option("sep", sep).option("encoding", JVM_NAME.get(e, e.upper()))
    return (r.schema(schema) if schema else r).csv(path)


def table_shape(df: DataFrame, rows: int = PROBE_ROWS) -> DataFrame:
    """Rows of a preview of at most ``rows``, all rows, and number of columns."""
    n = F.count("*")
    return df.agg(F.least(n, F.lit(rows)).alias("probe_rows"), n.alias("all_rows")).withColumn("columns", F.lit(len(df.columns)))


def extension(path: Column) -> Column:
    return F.regexp_extract(F.lower(F.element_at(F.split(path, "/"), -1)), r"(\.[^.]*)$", 1)


def classify_header(path: Column, content: Column, content_type: Column) -> Column:
    """Kind of a downloaded file from its first bytes, extension and content type; a web page is never data."""
    head = F.substring(content, 1, 4096)
    text = F.lower(F.trim(F.try_validate_utf8(F.substring(content, 1, 1024).cast("string"))))
    text = F.coalesce(text, F.lower(F.decode(F.substring(content, 1, 1024), "ISO-8859-1")))
    ext, ct = extension(path), F.lower(F.coalesce(content_type, F.lit("")))
    magic = lambda *b: F.substring(head, 1, len(b[0])).isin([F.lit(x) for x in b]) if len(b) > 1 else F.substring(head, 1, len(b[0])) == F.lit(b[0])
    body = F.lower(F.coalesce(F.try_validate_utf8(content.cast("string")), F.lit("")))
    geo = body.rlike(r'"type"\s*:\s*"feature(collection)?"')
    asset = body.rlike(r'"(assets|bbox|geometry|links|features)"\s*:') | F.left(body, F.lit(8000)).rlike(r"geotiff|\.tif|\.tiff|\.hdf|\.nc|downloadurl|download_url|spatial|extent")
    is_json = ext.isin(".json", ".geojson") | ct.contains("application/json")
    return (
        F.when(ct.contains("text/html") | text.startswith("<!doctype html") | F.left(text, F.lit(300)).contains("<html"), "html")
        .when(magic(b"PK\x03\x04") | (ext == ".zip"), "zip")
        .when(magic(b"II*\x00") | magic(b"MM\x00*") | ext.isin(".tif", ".tiff"), "geotiff")
        .when(magic(b"\x89HDF") | ext.isin(".hdf", ".h5", ".hdf5"), "hdf")
        .when(magic(b"CDF") | (ext == ".nc"), "netcdf")
        .when(ext.isin(".csv", ".xls", ".xlsx") | ct.rlike("spreadsheet|excel|csv"), "table")
        .when(is_json & geo, "geojson")
        .when(is_json & asset, "json")
        .when(is_json, "json_site_resource")
        .when(ct.contains("application/octet-stream") & (F.length(content) > 1024), "binary")
        .otherwise("unknown")
    )


def download_verdict(path: Column, size: Column, content: Column) -> Column:
    """Why a file is accepted or rejected as real data."""
    ext = extension(path)
    head = F.lower(F.decode(F.substring(content, 1, 512), "ISO-8859-1"))
    return (
        F.when(ext.isin(V.WEB_FILE_EXTS), "web_or_preview_file")
        .when(size < V.MIN_REAL_FILE_BYTES, "too_small")
        .when(~ext.isin(V.REAL_FILE_EXTS), "unsupported_extension")
        .when(head.rlike("<html|<!doctype html|login|javascript"), "html_or_web_content")
        .otherwise("accepted")
    )


def choose_sample_file(files: DataFrame, by: str, order: str) -> DataFrame:
    """One table per session: the cleaned file, then the role, then the suffix, then the newest."""
    ext = extension(F.col("path"))
    suffix = F.array_position(F.array(*[F.lit(s) for s in (".csv", ".xlsx", ".xls", ".tif")]), ext)
    rank = F.when(F.contains("path", F.lit("cleaned")), 0).when(F.col("role") == "sample_points", 1).otherwise(2)
    ok = files.filter(suffix > 0)
    b = ok.groupBy(by).agg(F.min_by(F.struct("path", order), F.struct(rank.alias("r"), suffix.alias("s"), (-F.col(order)).alias("o"))).alias("b"))
    return b.select(by, "b.path", f"b.{order}")
