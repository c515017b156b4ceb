"""Sinks (B1-B6): parquet tables, gzip text lines, JSON metrics, job counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from readpaths.operators.text import vector_text_line


ALL_WIKIS = "allwikis"  # in file names, when no wiki is selected


def output_name(kind: str, wiki_db: str, *parts: str) -> str:
    """File names of the reference's outputs.

    ``output_name('sessions', 'enwiki', '2020-04-01-00', '2020-04-09-00')``
    -> ``reading-sessions-actors_enwiki_2020-04-01-00_2020-04-09-00``;
    ``output_name('edges', 'enwiki', '2020-07')`` -> ``graph_enwiki_2020-07_edges.parquet``.
    """
    if kind == "sessions":
        return "reading-sessions-actors_" + "_".join([wiki_db, *parts])
    if kind in ("edges", "nodes"):
        return f"graph_{wiki_db}_{'_'.join(parts)}_{kind}.parquet"
    if kind == "vectors":  # parts: snapshot and number of dimensions
        return "embedding-text_fasttext_" + "_".join([wiki_db, *parts]) + ".vec.gz"
    raise ValueError(f"unknown output kind {kind!r}")


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Overwrite a parquet table (B1)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


PARTITIONS = ("wiki_db", "snapshot")


def write_partition(df: DataFrame, path: str, wiki_db: str, snapshot: str) -> None:
    """Write one wiki's snapshot into a table partitioned by both.

    Dynamic partition overwrite: a rerun replaces its own partition and leaves
    the others of the table as they are.
    """
    marked = df.withColumns({"wiki_db": F.lit(wiki_db), "snapshot": F.lit(snapshot)})
    marked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(path)


def write_lines(df: DataFrame, path: str, col: str = "line", compression: str = "gzip") -> None:
    """One text line per row, gzip-compressed, no order (B2)."""
    df.select(F.col(col).alias("value")).write.mode("overwrite").option("compression", compression).text(path)


def write_vector_lines(vectors: DataFrame, path: str, id_col: str = "page_id", vec_col: str = "vector",
                       fmt: str = "%.5f") -> None:
    """``page_id v1 ... vN`` lines, gzip, no header."""
    write_lines(vectors.select(vector_text_line(id_col, vec_col, fmt).alias("line")), path)


def write_metrics_json(metrics_json: DataFrame, path: str) -> None:
    """The JSON metrics line(s) as a text file (B4); the frame is one row per split."""
    write_lines(metrics_json.select("json"), path, col="json", compression="none")


def counted(df: DataFrame, name: str = "rows") -> tuple[DataFrame, Observation]:
    """Attach a row counter that fills in when the frame is written.

    ``out, obs = counted(df); out.write...; obs.get['n_rows']`` -- the
    count rides along the write instead of running a second job.
    """
    obs = Observation(name)
    return df.observe(obs, F.count(F.lit(1)).alias("n_rows")), obs
