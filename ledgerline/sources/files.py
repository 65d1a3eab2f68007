"""Files: labels in zip archives, strict JSON lines, ranking files; guarded writes and fingerprints.

Scans return DataFrames with declared schemas. Guards look at paths through Hadoop's file system, so
they hold for any store that Spark writes to.
"""

from __future__ import annotations

import csv
import hashlib
import json
import zipfile
from collections.abc import Iterator
from io import BytesIO, StringIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_SCHEMA = "qid string, rank int, doc_id string"
#: Partition folders of raw labels and the prefixes of their archives (fixed names of the source).
SPLITS = {"Training": "TL_", "Validation": "VL_"}
MEMBER_PREFIX = "LAB_"


def labels(spark: SparkSession, root: str, schema: str, splits: dict[str, str] = SPLITS) -> DataFrame:
    """(split, record): JSON members of label archives, read without unpacking to disk; an archive is one task's unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for split, content in zip(b.column("split").to_pylist(), b.column("content").to_pylist()):
                with zipfile.ZipFile(BytesIO(content)) as z:
                    for name in z.namelist():
                        base = name.rsplit("/", 1)[-1]
                        if base.startswith(MEMBER_PREFIX) and base.endswith(".json"):
                            yield pa.RecordBatch.from_arrays([pa.array([split]), pa.array([z.read(name).decode("utf-8")])], names=["split", "json"])

    out = None
    for split, prefix in splits.items():
        files = spark.read.format("binaryFile").option("pathGlobFilter", f"{prefix}*.zip").option("recursiveFileLookup", "true").load(f"{root}/{split}")
        part = files.select(F.lit(split).alias("split"), "content")
        out = part if out is None else out.unionByName(part)
    return out.mapInArrow(run, "split string, json string").select("split", F.from_json("json", schema).alias("record"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped, a broken one fails the query that reads it."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def run_file(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_SCHEMA).option("header", True).csv(path)


def write_run(run: DataFrame, path: str) -> None:
    run.select("qid", F.col("rank").cast("int"), "doc_id").orderBy("qid", "rank").write.option("header", True).csv(path)


def pairs(run: DataFrame, queries: DataFrame, texts: DataFrame, depth: int) -> DataFrame:
    """(qid, doc_id, query, text): candidates for a reranker."""
    return run.where(F.col("rank") <= depth).join(queries, "qid").join(texts, "doc_id").select("qid", "doc_id", "query", "text")


def _fs(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def refuse_existing(spark: SparkSession, path: str, overwrite: bool = False) -> None:
    """Fails before expensive work."""
    if not overwrite and exists(spark, path):
        raise FileExistsError(path)


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def write_guarded(spark: SparkSession, path: str, text: str, overwrite: bool = False) -> bool:
    """Writes a text; equal content is left as it is (False), other content stops unless overwrite."""
    if exists(spark, path):
        if read_text(spark, path) == text:
            return False
        if not overwrite:
            raise FileExistsError(f"{path} has other content")
    write_text(spark, path, text)
    return True


def write_new(spark: SparkSession, path: str, text: str) -> bool:
    """Writes only where nothing is."""
    if exists(spark, path):
        return False
    write_text(spark, path, text)
    return True


def digest(value) -> str:
    """SHA-256 of bytes, or of a value's canonical JSON."""
    data = value if isinstance(value, bytes) else json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode("utf-8")
    return hashlib.sha256(data).hexdigest()


def table_digest(df: DataFrame) -> str:
    """A digest of a table's rows that does not depend on their order; sums of row hashes, one row to the driver."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    part = lambda i: F.sum(F.conv(F.substring(row, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).cast("string")
    return digest(list(df.agg(F.count("*").cast("string"), part(0), part(1), part(2), part(3)).first()))


def check_basis(saved: dict, expected: dict) -> None:
    """Stops where an artifact was made with other settings; only expected keys count."""
    other = [k for k, v in expected.items() if saved.get(k) != v]
    if other:
        raise ValueError("made with other settings: " + ", ".join(f"{k}={saved.get(k)!r}, not {expected[k]!r}" for k in other))


def stable(recipe: dict, volatile=("git", "time", "host")) -> dict:
    """A recipe without what changes from run to run."""
    return {k: v for k, v in recipe.items() if k not in volatile}


def with_basis(df: DataFrame, path: str, basis: dict, overwrite: bool = False) -> None:
    """Writes a table and beside it the settings that made it."""
    spark = df.sparkSession
    refuse_existing(spark, path, overwrite)
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)
    write_text(spark, f"{path}.basis.json", json.dumps(basis, sort_keys=True, ensure_ascii=False))


def read_basis(spark: SparkSession, path: str, expected: dict) -> DataFrame:
    """A table whose settings are the expected ones."""
    check_basis(json.loads(read_text(spark, f"{path}.basis.json")), expected)
    return spark.read.parquet(path)


def append_missing(spark: SparkSession, df: DataFrame, path: str, key: str, recipe: dict | None = None) -> int:
    """Appends rows whose key the table lacks and says how many; stops where the table has another recipe."""
    side = f"{path}.basis.json"
    if exists(spark, path):
        if recipe is not None:
            check_basis(json.loads(read_text(spark, side)), stable(recipe))
        df = df.join(spark.read.parquet(path).select(key), key, "left_anti")
    elif recipe is not None:
        write_text(spark, side, json.dumps(stable(recipe), sort_keys=True))
    seen = df.cache()
    n = seen.count()
    if n:
        seen.write.mode("append").parquet(path)
    seen.unpersist()
    return n


def _absent(names: DataFrame, df: DataFrame, key: str) -> str:
    """How many names a table lacks and the first ten of them; empty if none."""
    lacking = names.select(key).join(df.select(key), key, "left_anti")
    first = [str(r[0]) for r in lacking.orderBy(key).limit(10).collect()]
    return f"{lacking.count()} missing, such as {', '.join(first)}" if first else ""


def check_frozen(df: DataFrame, expected: str) -> None:
    """Stops where a table's rows are not those that were frozen."""
    if (found := table_digest(df)) != expected:
        raise ValueError(f"the frozen table has digest {expected}, this one {found}")


def freeze(df: DataFrame, key: str, excluded: list[str]) -> tuple[DataFrame, str]:
    """Rows whose key is not excluded, and their digest; every exclusion has to be there."""
    names = df.sparkSession.createDataFrame([(x,) for x in excluded], f"{key} string")
    if absent := _absent(names, df, key):
        raise KeyError(f"not in the table: {absent}")
    kept = df.join(names, key, "left_anti")
    return kept, table_digest(kept)


def in_order(df: DataFrame, ids: list[str], key: str = "qid") -> DataFrame:
    """Rows of ids in their order; fails where one is missing."""
    named = df.sparkSession.createDataFrame(list(enumerate(ids)), f"ord int, {key} string")
    if absent := _absent(named, df, key):
        raise KeyError(f"no row for keys: {absent}")
    return named.join(df, key).orderBy("ord").drop("ord")


def query_set(sets: dict[str, DataFrame], name: str, ids: list[str] | None = None, key: str = "qid") -> DataFrame:
    """A query set by name (such as dev, multi or test), in the order of ids if these are given."""
    if name not in sets:
        raise ValueError(f"no query set {name!r}; there are {', '.join(sorted(sets))}")
    return sets[name] if ids is None else in_order(sets[name], ids, key)


def references(queries: DataFrame, ids: list[str], excluded: list[str] = (), key: str = "qid") -> DataFrame:
    """Reference answers of chosen queries but the excluded ones."""
    return in_order(queries, [i for i in ids if i not in set(excluded)], key)


def export(df: DataFrame, path: str, columns: list[str], basis: dict | None = None, overwrite: bool = False) -> None:
    """Chosen columns as JSON lines, with the settings beside them if given."""
    refuse_existing(df.sparkSession, path, overwrite)
    df.select(*columns).write.mode("overwrite" if overwrite else "errorifexists").json(path)
    if basis is not None:
        write_text(df.sparkSession, f"{path}.basis.json", json.dumps(basis, sort_keys=True, ensure_ascii=False))


def review_csv(spark: SparkSession, path: str, header: list[str], rows: list, overwrite: bool = False) -> bool:
    """A small table for people, as CSV with a byte order mark, so that spreadsheets read its letters."""
    out = StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerows([header, *rows])
    return write_guarded(spark, path, "\ufeff" + out.getvalue(), overwrite)


def markdown(df: DataFrame, digits: int = 4) -> str:
    """A small table for people, in Markdown."""
    shown = lambda v: f"{v:.{digits}f}" if isinstance(v, float) else "" if v is None else str(v)
    lines = [df.columns, ["---"] * len(df.columns), *([shown(v) for v in r] for r in df.collect())]
    return "".join(f"| {' | '.join(line)} |\n" for line in lines)


def save_record(spark: SparkSession, folder: str, record: dict) -> str:
    """One record as a JSON file named by its digest; a record that is there stays."""
    path = f"{folder}/{digest(record)[:16]}.json"
    write_new(spark, path, json.dumps(record, ensure_ascii=False, indent=1, sort_keys=True))
    return path
