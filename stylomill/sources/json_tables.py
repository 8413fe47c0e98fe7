"""JSON tables: one record a line, or one array; with explicit schemas and three ways with bad lines."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F

BAD = "_bad_line"


def _head(spark: SparkSession, path: str) -> str:
    """The first line of a file that isn't blank; only its head is read."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(conf).open(p)
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(p)
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8"))
    try:
        while (line := reader.readLine()) is not None:
            if line := line.lstrip("\ufeff \t\r"):
                return line
    finally:
        reader.close()
    return ""


def _forms(spark: SparkSession, path: str | list[str]) -> tuple[list[str], list[str]]:
    """Files of lines, and files that hold one array: every file is told by its own first sign."""
    files = [unquote(f) for f in spark.read.text([path] if isinstance(path, str) else path).inputFiles()]
    arrays = [f for f in files if _head(spark, f).startswith("[")]
    return [f for f in files if f not in set(arrays)], arrays


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of the paths (or globs) that there is something at."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def there(path: str) -> bool:
        p = jvm.org.apache.hadoop.fs.Path(path)
        return bool(p.getFileSystem(conf).globStatus(p))

    return [p for p in paths if there(p)]


def done_ids_at(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Distinct ids of the result files at the paths, with their errors (NULL: none); paths that aren't there yet give no row."""
    schema, found = "id BIGINT, error STRING", existing(spark, paths)
    return read_json(spark, found, schema).where("id IS NOT NULL").distinct() if found else spark.createDataFrame([], schema)


def read_json(spark: SparkSession, path: str | list[str], schema: str, bad: str = "drop") -> DataFrame:
    """A table from JSON lines or from files that hold one array (pretty-printed or not); each file is told by its first sign.

    bad: 'drop' leaves out lines that can't be read, 'raise' fails at them, 'report' keeps them in the column _bad_line (NULL
    otherwise) with the other columns NULL. Blank lines and a byte-order mark are ignored; files without a byte give no row.
    """
    if bad not in ("drop", "raise", "report"):
        raise ValueError(f"bad is {bad!r}")
    lines, arrays = _forms(spark, path)
    tables = [read(spark, files, schema, bad) for read, files in ((_from_lines, lines), (_from_arrays, arrays)) if files]
    if not tables:
        return spark.createDataFrame([], f"{_ddl(spark, schema)}, {BAD} STRING" if bad == "report" else schema)
    return tables[0] if len(tables) == 1 else tables[0].unionByName(tables[1])


def _from_arrays(spark: SparkSession, files: list[str], schema: str, bad: str) -> DataFrame:
    whole = spark.read.text(files, wholetext=True)
    body = F.from_json(F.regexp_replace("value", "^\\x{FEFF}", ""), f"array<struct<{_struct(spark, schema)}>>", {"mode": "FAILFAST" if bad == "raise" else "PERMISSIVE"})
    rows = whole.select(F.inline(body))
    return rows.withColumn(BAD, F.lit(None).cast("string")) if bad == "report" else rows


def _from_lines(spark: SparkSession, files: list[str], schema: str, bad: str) -> DataFrame:
    text = spark.read.text(files).select(F.regexp_replace("value", "^\\x{FEFF}", "").alias("v")).where("trim(v) <> ''")
    if bad == "raise":
        return text.select(F.from_json("v", _ddl(spark, schema), {"mode": "FAILFAST"}).alias("r")).select("r.*")
    parsed = text.select("v", F.from_json("v", f"{_ddl(spark, schema)}, {BAD} STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}).alias("r")).select("r.*")
    return parsed if bad == "report" else parsed.where(f"{BAD} IS NULL").drop(BAD)


def _ddl(spark: SparkSession, schema: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.createDataFrame([], schema).schema)


def _struct(spark: SparkSession, schema: str) -> str:
    return ", ".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in spark.createDataFrame([], schema).schema)


# Fixed value: names of pair files.
PAIR_FILE = r"(silver|gold)_(AA|TT|AT)_(train|val|test)\.jsonl"


def read_pair_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Pair files of a folder or glob, with dataset, mode and split from their names; files of other names are left out."""
    rows = spark.read.schema(schema).json(path).withColumn("_f", F.col("_metadata.file_name"))
    got = rows.select(*[F.col(f"`{f}`") for f in rows.columns if f != "_f"], *[F.regexp_extract("_f", PAIR_FILE, i).alias(n) for i, n in ((1, "dataset"), (2, "mode"), (3, "split"))])
    return got.where("dataset <> ''")


def read_results(spark: SparkSession, path: str, schema: str, model_parts: int = 1) -> DataFrame:
    """Result files named model_testset.json: their fields, with model (the first parts of the name) and test_set (the rest)."""
    rows = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("_n", F.split(F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", ""), "_"))
    return rows.select(*[c for c in rows.columns if c != "_n"], F.array_join(F.slice("_n", 1, model_parts), "_").alias("model"), F.array_join(F.expr(f"slice(_n, {model_parts + 1}, size(_n))"), "_").alias("test_set"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value): the lines of text files in their order, numbered from 1."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.regexp_replace("value", "\r\n?", "\n").alias("v"))
    return whole.select("file", F.posexplode(F.split(F.regexp_replace("v", "\n$", ""), "\n")).alias("p", "value")).select("file", (F.col("p") + 1).cast("bigint").alias("line_no"), "value")


def attributions_from_npz(spark: SparkSession, path: str, model: str, trusted: bool = False) -> DataFrame:
    """(model, sample, pos, token, s0, s1) from a small NPZ file of attributions: values (samples, tokens, 2) and the tokens.

    Tokens are plain strings (array `tokens`, with `lengths`), as sinks.write_attributions writes them, or objects (array `data`,
    a list of tokens for each sample, values likewise). Objects have to be unpickled, which can run code: only if `trusted`.
    """
    import numpy as np

    with np.load(path, allow_pickle=trusted) as z:
        try:
            values = z["values"]
            tokens = z["tokens"] if "tokens" in z else z["data"]
        except ValueError as e:
            raise ValueError(f"{path} holds objects: read it as trusted, or write it with sinks.write_attributions") from e
        lengths = z["lengths"] if "lengths" in z else [min(len(t), len(v)) for t, v in zip(tokens, values)]
    rows = [(model, i, j, str(tokens[i][j]), float(values[i][j][0]), float(values[i][j][1])) for i in range(len(lengths)) for j in range(int(lengths[i]))]
    return spark.createDataFrame(rows, "model string, sample int, pos int, token string, s0 double, s1 double")
