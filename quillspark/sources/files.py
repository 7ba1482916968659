"""Files: JSON lines, sidecars, manifests, sharded parts and atomic publishing."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillspark.operators.ordering import numbered


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, fold: int | None = None) -> DataFrame:
    """JSON lines under a schema; blank lines are skipped; with ``fold`` only its rows."""
    df = spark.read.schema(schema).json(path)
    return df if fold is None else df.where(F.col("fold") == fold)


def read_sheet(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A raw sheet as Parquet, CSV or JSON lines under a schema; the columns it holds must be exactly these, in any format."""
    kind = path.rsplit(".", 1)[-1]
    want = spark.createDataFrame([], schema).columns
    if kind == "parquet":
        have = spark.read.parquet(path).columns
    elif kind == "csv":
        have = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).columns
    else:
        have = sorted(spark.read.json(path).columns)
    if have != (want if kind in ("parquet", "csv") else sorted(want)):
        raise ValueError(f"columns {have}, not {want}")
    r = spark.read.schema(schema)
    return r.parquet(path) if kind == "parquet" else r.option("header", True).option("multiLine", True).option("escape", '"').csv(path) if kind == "csv" else r.json(path)


def result_rows(raw: DataFrame) -> DataFrame:
    """Rows of a batch writer's results as the outputs table: (draft_id, arm, model, text, status, stop_reason).

    ``raw``: custom_id, arm, model, type, stop_reason, text.  A result that did not succeed has an empty text and its type as
    status; of the others the stop reason names the status.
    """
    named = F.create_map(F.lit("end_turn"), F.lit("ok"), F.lit("refusal"), F.lit("refusal"), F.lit("max_tokens"), F.lit("max_tokens"))
    done = F.col("type") == "succeeded"
    status = F.when(done, F.coalesce(F.try_element_at(named, "stop_reason"), "stop_reason")).otherwise(F.concat(F.lit("batch_"), "type"))
    return raw.select(F.col("custom_id").alias("draft_id"), "arm", "model", F.when(done, F.coalesce("text", F.lit(""))).otherwise("").alias("text"), status.alias("status"), F.when(done, F.col("stop_reason")).alias("stop_reason"))


def write_parquet(df: DataFrame, path: str, *partition: str) -> None:
    """Parquet, by partition columns so that readers of one fold prune the rest."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition) if partition else w).parquet(path)


def write_jsonl(df: DataFrame, path: str, *order: str) -> None:
    """JSON lines in a folder, ranged and sorted by ``order``: parts read in name order give the whole order."""
    d = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    d.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_json(path: str, value: object) -> None:
    """A small JSON sidecar, written beside and moved into place."""
    p = Path(path)
    tmp = p.with_suffix(p.suffix + ".tmp")
    tmp.write_text(json.dumps(canonical(value), indent=2, ensure_ascii=False) + "\n", encoding="utf-8")
    os.replace(tmp, p)


def canonical(x: object) -> object:
    """Numbers to plain ones, floats to 8 places without negative zero, inside lists and maps."""
    if isinstance(x, dict):
        return {str(k): canonical(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [canonical(v) for v in x]
    if hasattr(x, "item"):
        x = x.item()
    return round(x, 8) + 0.0 if isinstance(x, float) else x


def file_hash(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(1 << 20):
            h.update(part)
    return h.hexdigest()


def folder_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(file, sha256) of all files below a folder, hashed on the executors."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return df.select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), F.sha2("content", 256).alias("sha256"))


def shard(df: DataFrame, order: list[str], index: int, shards: int) -> DataFrame:
    """The rows of one of several shards: every ``shards``-th row in the order, from ``index``."""
    return numbered(df, order, "_i").where(F.col("_i") % shards == index).drop("_i")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def merge_parts(spark: SparkSession, paths: list[str], schema: StructType | str) -> DataFrame | None:
    """All parts as one table, or None while one is missing, on any file system that Spark reads."""
    if not all(_exists(spark, p) for p in paths):
        return None
    return spark.read.schema(schema).json(paths)


def publish(staging: str, final: str, frozen: bool = False) -> None:
    """Move a finished folder into place; what was there is set aside first and removed last, so a reader finds one or the
    other at any time but the moment between two renames.  With ``frozen`` nothing may be there."""
    old = None
    if Path(final).exists():
        if frozen:
            raise FileExistsError(final)
        old = f"{final}.old"
        shutil.rmtree(old, ignore_errors=True)
        os.replace(final, old)
    os.replace(staging, final)
    if old:
        shutil.rmtree(old)


def unchanged_folds(new: DataFrame, frozen: DataFrame) -> bool:
    """Whether two assignments of folds hold the same rows, repeated ones as often."""
    cols = sorted(new.columns)
    a, b = new.select(*cols), frozen.select(*cols)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


class Manifest:
    """Stage to config and hashes of its inputs and outputs, kept as a JSON sidecar."""

    def __init__(self, path: str) -> None:
        self.path = path
        self.stages = json.loads(Path(path).read_text()) if Path(path).exists() else {}

    def _hashes(self, paths: list[str]) -> dict[str, str]:
        """Path, relative to the manifest's folder, to hash; a folder can be moved with its manifest."""
        home = Path(self.path).resolve().parent
        full = {os.path.relpath(home / p, home): home / p for p in paths}
        return {p: file_hash(str(q)) for p, q in full.items() if q.is_file()}

    def check_upstream(self, *names: str) -> None:
        """Raises if one of the stages never ran or the files it left are not those that it recorded."""
        for n in names:
            s = self.stages.get(n)
            if s is None or s["outputs"] != self._hashes(list(s["outputs"])):
                raise RuntimeError(f"stage {n} is missing or its outputs changed")

    def record(self, name: str, config: dict, inputs: list[str], outputs: list[str]) -> None:
        self.stages[name] = {"config": canonical(config), "inputs": self._hashes(inputs), "outputs": self._hashes(outputs)}
        write_json(self.path, self.stages)

    def unchanged(self, name: str, config: dict, inputs: list[str]) -> bool:
        """Whether the stage ran with this config on these inputs and its outputs still are what it wrote."""
        s = self.stages.get(name)
        return bool(s) and s["config"] == canonical(config) and s["inputs"] == self._hashes(inputs) and s["outputs"] == self._hashes(list(s["outputs"]))

    def stale_inputs(self, name: str) -> list[str]:
        """Inputs of the stage that changed or vanished since."""
        s = self.stages.get(name, {"inputs": {}})
        now = self._hashes(list(s["inputs"]))
        return [p for p, h in s["inputs"].items() if now.get(p) != h]


def markdown(df: DataFrame, title: str, path: str) -> None:
    """A report table of any length as a Markdown file, one row a line in the order of its rows."""
    plain = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    tmp = Path(f"{path}.tmp")
    with open(tmp, "w", encoding="utf-8") as f:
        f.write(f"# {title}\n\n| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns) + "\n")
        for r in df.toLocalIterator():
            f.write("| " + " | ".join(map(plain, r)) + " |\n")
    os.replace(tmp, path)
