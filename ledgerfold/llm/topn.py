"""Top N items within every group by statistics-guided skipping.

Method: groups that hold more than their share of a task are found by counting (at most a few a task); the rows are
exchanged once, clustered by group, such groups spread by item over several tasks; there the last row of every item is
taken, and what counts is written by size of group (in powers of two) and descending score, in small row groups with
statistics. Every file is then read by row groups in descending order of their maximum score. Of a row group
the groups it holds are read first; it is skipped if its maximum lies strictly below the current N-th score of every one of
them, so its items and scores are never read. A group spread over several files starts anew in each, which costs N rows a
file. What is left, hardly more than N rows a group and file, is ranked once more.

Tie rule: score descending, year descending (null last), item ascending (null first). Defined results: a row without a
group belongs to none and is dropped; of the rows of one (group, item, year) only the last by time counts (null time first;
then the greatest score, NaN above all and null below); scores that are null, NaN or outside 0..1 don't count; repeated
rows count once; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerfold.session import scratch_path

MIN_GROUP_BYTES, MAX_GROUP_BYTES, GROUPS, ROW_BYTES = 8 << 10, 1 << 20, 100, 8  # row groups: about so many a file
MIN_ROWS, MAX_ROWS = 10_000, 8_000_000  # rows a task
_CANDIDATES = "grp string, item string, year int, score double, row_groups bigint, skipped bigint"


def open_file(path: str):
    """A parquet file of the shared folder, whatever file system that is on (s3a is pyarrow's s3)."""
    path = re.sub(r"^s3[an]://", "s3://", path)
    system, name = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    return pq.ParquetFile(name, filesystem=system)


def list_files(spark, path: str) -> list[str]:
    """Data files of a written table (names only; as many as the table has partitions)."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(jpath)
    names = [s.getPath().toString() for s in found if s.getLen() > 0]
    return sorted(("file://" + n[5:] if n.startswith("file:/") and not n.startswith("file://") else n) for n in names if n.endswith(".parquet"))


def _merge(nth: dict, counts: dict, group, scores: np.ndarray, n: int) -> None:
    """Take a group's scores of one row group (descending, at most *n*) into its best ones so far."""
    best = scores if group not in counts else np.sort(np.r_[counts[group], scores])[::-1][:n]
    counts[group] = best
    if len(best) == n:
        nth[group] = best[-1]


def _read_file(path: str, n: int) -> tuple[pa.Table | None, int, int]:
    """Candidates of one file; row groups read and skipped."""
    source = open_file(path)
    meta = source.metadata
    if not meta.num_rows:
        return None, 0, 0
    at = {meta.schema.column(i).name: i for i in range(meta.num_columns)}
    tops = []
    for i in range(meta.num_row_groups):
        score = meta.row_group(i).column(at["score"]).statistics
        tops.append((score.max if score is not None and score.has_min_max else np.inf, i))
    nth: dict[str, float] = {}  # the N-th score of a group so far, once it has N rows
    counts: dict[str, np.ndarray] = {}
    held: list[pa.Table] = []
    skipped = 0
    for top, i in sorted(tops, key=lambda s: -s[0]):
        # groups are stored by dictionary, so those of a row group cost little to read
        code = source.read_row_group(i, columns=["grp"])["grp"].combine_chunks().dictionary_encode()
        if isinstance(code, pa.ChunkedArray):
            code = code.combine_chunks()
        names = code.dictionary.to_pylist()
        if all(top < nth.get(g, -1.0) for g in names):
            skipped += 1
            continue
        rows = source.read_row_group(i)
        group, score = code.indices.to_numpy(zero_copy_only=False), rows["score"].to_numpy()
        order = np.lexsort((-score, group))
        g, s = group[order], score[order]
        first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        sizes = np.diff(np.r_[first, len(g)])
        for a, size in zip(first.tolist(), sizes.tolist()):
            _merge(nth, counts, names[g[a]], s[a : a + min(size, n)], n)
        limit = np.array([nth.get(x, -1.0) for x in names])[g]
        held.append(rows.take(pa.array(np.sort(order[s >= limit]))))  # ties at the N-th score stay: the tie rule decides among them
    return pa.concat_tables(held), len(tops) - skipped, skipped


def _candidates(n: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path in frame["path"]:
                table, read, skipped = _read_file(path, n)
                if table is not None:
                    f = table.to_pandas()
                    f["year"] = f["year"].astype("Int32")
                    # once more over the whole file, ties at the N-th score kept
                    rank = f.groupby("grp")["score"].rank(method="min", ascending=False)
                    out = f[rank <= n][["grp", "item", "year", "score"]]
                    yield out.assign(row_groups=np.r_[read, np.zeros(len(out) - 1, int)], skipped=np.r_[skipped, np.zeros(len(out) - 1, int)])

    return run


def clustered(rows: DataFrame, n_rows: int, parts: int) -> DataFrame:
    """(grp, item, year, score) of the rows that count, in one exchange by group and, of hot groups, by piece."""
    fair = max(1, n_rows // (4 * parts))
    hot = rows.groupBy("grp").count().where(F.col("count") > fair).select("grp", F.ceil(F.col("count") / fair).cast("int").alias("pieces"))  # at most 4 * parts rows
    piece = F.pmod(F.xxhash64("item", "year"), F.coalesce("pieces", F.lit(1))).cast("int")
    placed = rows.join(F.broadcast(hot), "grp", "left").withColumn("piece", piece).drop("pieces").repartition(parts, "grp", "piece")
    last = placed.groupBy("grp", "piece", "item", "year").agg(F.max(F.struct("v", "score"))["score"].alias("score"))
    valid = last.where("score IS NOT NULL AND NOT isnan(score) AND score BETWEEN 0 AND 1").withColumn("score", F.col("score") + F.lit(0.0))
    size = F.count(F.lit(1)).over(Window.partitionBy("grp", "piece"))
    return valid.select("grp", "item", "year", "score", F.floor(F.log2(size)).alias("size"))


def top_n(rows: DataFrame, group: str, item: str, year: str, score: str, version: str, n: int, row_group_bytes: int | None = None) -> DataFrame:
    """(grp, item, year, score, rank) of the n best entries of every group."""
    return rank_candidates(candidates(rows, group, item, year, score, version, n, row_group_bytes), n)


def candidates(rows: DataFrame, group: str, item: str, year: str, score: str, version: str, n: int, row_group_bytes: int | None = None) -> DataFrame:
    """(grp, item, year, score) that may be among the n best, with the numbers of row groups read and skipped for them."""
    spark = rows.sparkSession
    r = rows.select(F.col(group).alias("grp"), F.col(item).alias("item"), F.col(year).cast("int").alias("year"), F.col(score).cast("double").alias("score"), F.col(version).alias("v")).where("grp IS NOT NULL")
    n_rows, least = rows.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(least, n_rows // MIN_ROWS), n_rows // MAX_ROWS)
    row_group_bytes = row_group_bytes or min(MAX_GROUP_BYTES, max(MIN_GROUP_BYTES, n_rows // parts * ROW_BYTES // GROUPS))
    path = scratch_path(spark, "topn")
    clustered(r, n_rows, parts).sortWithinPartitions("size", F.desc("score")).select("grp", "item", "year", "score").write.option("parquet.block.size", str(row_group_bytes)).parquet(path)
    files = list_files(spark, path)
    if not files:
        return spark.createDataFrame([], _CANDIDATES)
    names = spark.createDataFrame([(f,) for f in files], "path string").repartition(len(files))
    return names.mapInPandas(_candidates(n), _CANDIDATES)


def rank_candidates(found: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("grp").orderBy(F.desc("score"), F.col("year").desc_nulls_last(), F.col("item").asc_nulls_first())
    return found.select("grp", "item", "year", "score").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
