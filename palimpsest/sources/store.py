"""Where results go and come back from."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's own
    checkpoint folder; only on one machine, where neither is set, is one made."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if spark.sparkContext.getCheckpointDir() is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="palimpsest-"))
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def fresh(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write as Parquet to the shared folder and read back: cuts lineage, survives lost executors."""
    path = fresh(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that a task gets where rows are dealt out to as many tasks as they need.
TASK_ROWS = 500_000


def tasks_for(rows: DataFrame) -> int:
    """How many partitions rows need, by their number. Those given to repartition stay as they are, so that tasks don't grow with the
    input as those of a fixed or merged number do."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS))


def dealt_out(df: DataFrame, *columns: str, buckets: int = 0, placed: bool = False) -> DataFrame:
    """df, written to the shared folder in buckets of columns and read back: windows, groups and joins by these columns shuffle it no more.
    There are as many buckets as shuffle partitions, or buckets if that is more. placed: df comes of such a table and its rows are still where
    they were, so that they are written without a shuffle. The catalog names the table only until it is read here; the files stay."""
    spark, name = df.sparkSession, f"palimpsest_dealt_{uuid.uuid4().hex}"
    n = max(buckets, int(spark.conf.get("spark.sql.shuffle.partitions")))
    (df if placed else df.repartition(n, *columns)).write.bucketBy(n, *columns).option("path", fresh(spark, "dealt")).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return out


class Dealt:
    """Tables written in buckets of a column, each file holding one, so that joins and groups by that column read them without a shuffle.
    They are named in the session's catalog as long as they are needed; drop() takes them out and deletes their files."""

    def __init__(self, spark: SparkSession, buckets: int | None = None) -> None:
        self.spark, self.paths = spark, {}
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(self, df: DataFrame, column: str) -> DataFrame:
        name = f"palimpsest_dealt_{uuid.uuid4().hex}"
        self.paths[name] = fresh(self.spark, "dealt")
        df.repartition(self.buckets, column).write.bucketBy(self.buckets, column).sortBy(column).option("path", self.paths[name]).saveAsTable(name)
        return self.spark.table(name)

    def drop(self) -> None:
        for name, path in self.paths.items():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        self.paths = {}


def read_jsonl(spark: SparkSession, path: str, fields: dict[str, str], required: tuple[str, ...], kinds: tuple[str, ...]) -> DataFrame:
    """The fields (name: string, int or long), has_<name> for those that aren't required, reject and line: a row for each record of one of the
    kinds. Lines that are no JSON object, lack a required field or have a number that is none are rows too, with the reason in
    reject (the first, in the order of fields) and the line as it is; their fields are null. Records without a kind or of another are
    skipped."""
    schema = ", ".join(f"`{name}` string" for name in fields)
    lines = spark.read.text(path).where("trim(value) <> ''")
    rows = lines.withColumn("r", F.from_json("value", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
    fault = F.when(F.col("r").isNull() | F.col("r._corrupt").isNotNull() | ~F.ltrim("value").startswith("{"), "no record")
    for name, kind in fields.items():
        given = F.col(f"r.`{name}`")
        if name in required:
            fault = fault.when(given.isNull(), f"missing field {name}")
        if kind != "string":
            fault = fault.when(given.isNotNull() & given.try_cast(kind).isNull(), f"invalid integer field {name}")
    rows = rows.withColumn("reject", fault).where((F.col("reject") == "no record") | F.col("r.kind").isin(*kinds))
    sound = F.col("reject").isNull()
    out = [F.when(sound, F.col(f"r.`{name}`").try_cast(kind)).alias(name) for name, kind in fields.items()]
    out += [F.when(sound, F.col(f"r.`{name}`").isNotNull()).alias(f"has_{name}") for name in fields if name not in required]
    return rows.select(*out, "reject", F.when(~sound, F.col("value")).alias("line"))


def read_tsv_checked(spark: SparkSession, path: str, names: list[str], required: tuple[str, ...], domains: dict[str, tuple[str, ...]], leading: int = 2) -> DataFrame:
    """names, reject and line: a row for each line of tab-separated files that begin with a header, of which the first leading names and the
    number are checked. Lines with another number of fields, without a required field or with a value outside its domain are rows
    with the reason in reject and the line as it is; a file without its header is one row, the path being its line. Blank
    lines are skipped; empty fields are null."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).where("trim(value) <> ''")
    f = F.split("value", "\t", -1)
    head = F.size(f) == len(names)
    for i, n in enumerate(names[:leading]):
        head = head & (F.get(f, i) == n)
    lines = lines.withColumns({"f": f, "head": head})
    fields = {n: F.nullif(F.trim(F.get("f", i)), F.lit("")) for i, n in enumerate(names)}
    fault = F.when(F.size("f") != len(names), F.concat(F.lit("fields: "), F.size("f")))
    for n in required:
        fault = fault.when(fields[n].isNull(), "empty required field")
    for n, domain in domains.items():
        fault = fault.when(~fields[n].isin(*domain), f"unknown {n}")
    rows = lines.where("NOT head").withColumn("reject", fault)
    good = rows.select(*(F.when(F.col("reject").isNull(), c).alias(n) for n, c in fields.items()), "reject", F.when(F.col("reject").isNotNull(), F.col("value")).alias("line"))
    bare = lines.groupBy("file").agg(F.bool_or("head").alias("head")).where("NOT head").select(F.lit("invalid header").alias("reject"), F.col("file").alias("line"))
    return good.unionByName(bare, True)


def read_page_index(spark: SparkSession, path: str) -> DataFrame:
    """(source, page, start, length, fault) of an index: its pages; lines that are no pages, with the fault `malformed page` and what
    can be read of them; and sources that declare other numbers of pages or bytes than they have, without a page."""
    page, head, any_ = r"^source (.*) page (\d+) start (\d+) length (\d+)$", r"^source (.*) pages (\d+) bytes (\d+)$", r"^source (.*?)(?: page (\d+)\b.*)?$"
    lines = spark.read.text(path)

    def part(pattern: str, i: int, kind: str) -> Column:
        return F.nullif(F.regexp_extract("value", pattern, i), F.lit("")).cast(kind)

    good, declares = F.col("value").rlike(page), F.col("value").rlike(head)
    none = F.lit(None).cast("string")
    pages = lines.where(good).select(part(page, 1, "string").alias("source"), *(part(page, i, "long").alias(n) for i, n in ((2, "page"), (3, "start"), (4, "length"))), none.alias("fault"))
    bad = lines.where(~good & ~declares).select(part(any_, 1, "string").alias("source"), part(any_, 2, "long").alias("page"), F.lit("malformed page").alias("fault"))
    declared = lines.where(declares).select(part(head, 1, "string").alias("source"), part(head, 2, "long").alias("n"), part(head, 3, "long").alias("total"))
    found = pages.groupBy("source").agg(F.count("*").alias("found"), F.max(F.col("start") + F.col("length")).alias("bytes"))
    both = declared.join(found, "source", "full")
    wrong = F.array_compact(F.array(F.when(~F.col("n").eqNullSafe(F.col("found")), "declared pages"), F.when(~F.col("total").eqNullSafe(F.col("bytes")), "declared bytes")))
    return pages.unionByName(bad, True).unionByName(both.select("source", F.explode(wrong).alias("fault")), True)


def write_jsonl(rows: DataFrame, path: str, header: str | None = None) -> None:
    """One object a row, in gzip files, as records repeat their fields' names; the header goes to a sidecar beside the rows, as rows have no
    order on a cluster."""
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.text(path, compression="gzip")
    if header is not None:
        rows.sparkSession.range(1).select(F.lit(header).alias("value")).coalesce(1).write.text(path + ".header")


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated rows with a header whose names must be the schema's; blank lines are skipped, empty
    fields are null."""
    return spark.read.schema(schema).option("enforceSchema", False).csv(path, sep="\t", header=True)


def write_tsv(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """errorifexists refuses an existing output; overwrite replaces it. A failed job leaves no part files. Files are gzip files."""
    rows.write.mode(mode).csv(path, sep="\t", header=True, compression="gzip")
