"""The chunk store: Parquet tables with idempotent appends, metadata, and resumable batches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNKS = T.StructType([
    T.StructField("rowid", T.LongType()), T.StructField("chunk_id", T.StringType()), T.StructField("doc_id", T.StringType()), T.StructField("ord", T.IntegerType()),
    T.StructField("char_start", T.IntegerType()), T.StructField("char_end", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("prefix", T.StringType()),
    T.StructField("sec_id", T.StringType()), T.StructField("tag", T.StringType()), T.StructField("domain", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
])
VECTORS = "chunk_id string, batch long, embedding array<float>"
#: What a reader gets for a column that an older table lacks.
DEFAULTS = {"domain": "linux", "sec_id": "", "tag": "", "prefix": ""}


def with_defaults(df: DataFrame, schema: T.StructType = CHUNKS) -> DataFrame:
    """``df`` in the given schema; columns that it lacks get their default or null, others are dropped."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(DEFAULTS.get(f.name))).cast(f.dataType).alias(f.name) for f in schema])


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One JSON object a line; the schema is stated, never inferred."""
    return spark.read.schema(schema).json(path)


def read_texts(spark: SparkSession, root: str, suffixes: tuple[str, ...] = ("md", "txt", "html")) -> DataFrame:
    """(path, text): all files below a folder with one of the suffixes, a row each."""
    return spark.read.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}").load(root).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


class ChunkStore:
    """Tables of one index below a folder: chunks, vectors, questions, meta.

    Appends are files of their own; a chunk is added once (by chunk_id). Vectors are kept by batch, and a
    later vector of a chunk replaces the earlier one on reading. A job that is repeated adds nothing new.
    A table that was replaced lies in a folder of its own, which a pointer file names.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _hadoop(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, name: str) -> str:
        pointer = f"{self.root}/{name}.current"
        p, fs = self._hadoop(pointer)
        return f"{self.root}/{self.spark.read.text(pointer).first()[0]}" if fs.exists(p) else f"{self.root}/{name}"

    def _exists(self, name: str) -> bool:
        p, fs = self._hadoop(self._path(name))
        return bool(fs.exists(p))

    def _read(self, name: str, schema: T.StructType | str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self._path(name)) if self._exists(name) else self.spark.createDataFrame([], schema)

    def _added(self) -> DataFrame:
        """The chunks without their vectors."""
        return self._read("chunks", CHUNKS).drop("embedding")

    def chunks(self, domain: str | None = None) -> DataFrame:
        """All chunks, or those of a domain, each with its latest vector."""
        v = self._read("vectors", VECTORS).groupBy("chunk_id").agg(F.max_by("embedding", F.struct("batch", "embedding")).alias("embedding"))
        c = self._added()
        return (c.where(F.col("domain") == domain) if domain else c).join(v, "chunk_id", "left").select(*CHUNKS.names)

    def add(self, new: DataFrame) -> None:
        """Append the chunks that the store lacks, one for each chunk_id (the least rowid), partitioned by domain; and the vectors of all that have one, as a batch.

        Of several vectors of a chunk in one batch that of the greatest rowid counts. Rows without a chunk_id are left out.
        """
        new = with_defaults(new).where("chunk_id is not null")
        rest = [c for c in CHUNKS.names if c not in ("chunk_id", "embedding")]
        first = new.groupBy("chunk_id").agg(F.min_by(F.struct(*rest), "rowid").alias("c")).select("chunk_id", "c.*")
        first.join(self._added().select("chunk_id"), "chunk_id", "left_anti").withColumn("embedding", F.lit(None).cast("array<float>")).select(*CHUNKS.names).write.mode("append").partitionBy("domain").parquet(f"{self._path('chunks')}")
        batch = (self._read("vectors", VECTORS).agg(F.max("batch")).first()[0] or 0) + 1
        vectors = new.where("embedding is not null").groupBy("chunk_id").agg(F.max_by("embedding", "rowid").alias("embedding"))
        vectors.select("chunk_id", F.lit(batch).cast("long").alias("batch"), "embedding").write.mode("append").parquet(self._path("vectors"))

    def add_questions(self, new: DataFrame) -> None:
        """Append (chunk_id, question, embedding) of known chunks; repeats are left out."""
        schema = "chunk_id string, question string, embedding array<float>"
        have = self._read("questions", schema)
        new = new.select("chunk_id", "question", "embedding").dropDuplicates(["chunk_id", "question"])
        new = new.join(self._added().select("chunk_id"), "chunk_id", "left_semi").join(have.select("chunk_id", "question"), ["chunk_id", "question"], "left_anti")
        new.write.mode("append").parquet(self._path("questions"))

    def questions(self) -> DataFrame:
        return self._read("questions", "chunk_id string, question string, embedding array<float>")

    def todo(self, ids: DataFrame) -> DataFrame:
        """Of (chunk_id) those that the store lacks."""
        return ids.select("chunk_id").distinct().join(self._added().select("chunk_id"), "chunk_id", "left_anti")

    def set_meta(self, **values: str) -> None:
        n = self._read("meta", "seq long, key string, value string").agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
        rows = [(n + 1, k, str(v)) for k, v in values.items()]
        self.spark.createDataFrame(rows, "seq long, key string, value string").coalesce(1).write.mode("append").parquet(self._path("meta"))

    def meta(self) -> dict[str, str]:
        """The last value of each key; keys are few."""
        m = self._read("meta", "seq long, key string, value string").groupBy("key").agg(F.max_by("value", "seq").alias("value"))
        return {r["key"]: r["value"] for r in m.limit(10_000).collect()}

    def domains(self) -> DataFrame:
        return self._added().groupBy(F.coalesce("domain", F.lit("linux")).alias("domain")).agg(F.count("*").alias("n"))

    def documents(self) -> DataFrame:
        return self._added().select("doc_id").distinct()

    def copy_to(self, other: str) -> None:
        """Copy the tables to another folder unless they are there; the same folder is an error."""
        if other.rstrip("/") == self.root:
            raise ValueError("source and target are the same")
        for name in ("chunks", "vectors", "questions", "meta"):
            if self._exists(name):
                w = self.spark.read.parquet(self._path(name)).write.mode("ignore")
                (w.partitionBy("domain") if name == "chunks" else w).parquet(f"{other.rstrip('/')}/{name}")

    def replace_table(self, name: str, df: DataFrame) -> None:
        """Put ``df`` in the place of a table: written to a folder of its own, then named by the pointer in one rename; the old folder goes last.

        Whenever the job ends, readers find the old table or the new one, whole.
        """
        old, folder = self._path(name), f"{name}-{uuid.uuid4().hex}"
        (df.write.partitionBy("domain") if name == "chunks" else df.write).parquet(f"{self.root}/{folder}")
        new, fs = self._hadoop(f"{self.root}/{folder}.pointer")
        out = fs.create(new, True)
        out.write(folder.encode())
        out.close()
        at, _ = self._hadoop(f"{self.root}/{name}.current")
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        modes = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        modes[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(new, at, modes)
        fs.delete(self._hadoop(old)[0], True)
