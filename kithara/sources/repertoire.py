"""Reading and writing repertoires, embeddings, truth tables and run tables."""

from __future__ import annotations

import tarfile
from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithara.functions.text import chain_of_columns, normalize_gene, resolve_column, tagged_run
from kithara.session import written

#: Bytes of an archive's member that are read at once, and tasks that unpack archives at most.
PIECE, UNPACKERS = 8 << 20, 10_000

#: Column names under which repertoire tables give a value, best first (fixed values).
CANDIDATES = {
    "cdr3": ("junction_aa", "cdr3", "cdr3aa", "cdr3aa_TRB", "cdr3aa_TRA", "cdr3aa_beta", "cdr3aa_alpha", "cdr3_beta_aa", "cdr3_alpha_aa", "cdr3_aa", "CDR3", "cdr3_b_aa"),
    "v_gene": ("v_call", "v_gene", "v.segm", "v_TRB", "v_TRA", "v_beta", "v_alpha", "TRBV", "TRAV", "TRBV_IMGT", "TRAV_IMGT", "v", "v_b_gene"),
    "j_gene": ("j_call", "j_gene", "j.segm", "j_TRB", "j_TRA", "j_beta", "j_alpha", "TRBJ", "TRAJ", "TRBJ_IMGT", "TRAJ_IMGT", "j", "j_b_gene"),
    "clone_id": ("clone_id", "clonotype_id", "cloneId", "sequence_id", "id"),
    "count": ("count", "duplicate_count", "cloneCount", "reads"),
}


def read_tsv(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Tab-separated text with a header, compressed or not; all columns text."""
    return spark.read.csv(path, sep="\t", header=True)


def read_csv(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    df = spark.read.csv(path, header=True)
    return df.drop(*[c for c in df.columns if c.startswith(("Unnamed:", "_c"))])


def read_columns(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A parquet scan of those of the columns that the table has."""
    df = spark.read.parquet(path)
    return df.select(*[c for c in columns if c in df.columns])


def read_metadata(spark: SparkSession, path: str, tokens: Sequence[str] = ("cdr3", "junction", "_call", "gene", "clone", "chain", "locus", "source")) -> DataFrame:
    """A parquet scan of the columns whose names hold one of the tokens, in any case; embeddings are not read."""
    df = spark.read.parquet(path)
    return df.select(*[f"`{c}`" for c in df.columns if any(t in c.lower() for t in tokens)])


def _in_folders(df: DataFrame) -> DataFrame:
    """df with patient and run_id, the two folders that a row's file lies in."""
    folders = F.split(F.col("_metadata.file_path"), "/")
    return df.select("*", F.element_at(folders, -3).alias("patient"), F.element_at(folders, -2).alias("run_id"))


def run_summaries(spark: SparkSession, path: str, prefix: str = "", parse=tagged_run) -> DataFrame:
    """The summaries of all run folders below `path` (`path/patient/run`), with patient, run_id and the run's parameters.

    Each run is a folder of tab-separated files `summary*`. Runs may differ in their columns: files are told apart by
    their first lines, those of one layout are one scan, and columns that a layout lacks are null. A column that is
    text in one layout and not in another is text.
    """
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "summary*").text(path)
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    first = lines.filter("start = 0").groupBy("file").agg(F.min_by("value", "at").alias("header"))
    layouts = first.groupBy("header").agg(F.array_sort(F.collect_list("file")).alias("files")).orderBy("header").collect()  # names of files only
    if not layouts:
        raise ValueError(f"no summary in {path}")
    tables = [_in_folders(spark.read.csv(x["files"], sep="\t", header=True, inferSchema=True, enforceSchema=False)) for x in layouts]
    kinds: dict[str, set[str]] = {}
    for t in tables:
        for c, kind in t.dtypes:
            kinds.setdefault(c, set()).add(kind)
    mixed = {c for c, k in kinds.items() if len(k) > 1 and not k <= {"int", "bigint", "double"}}
    df = tables[0].withColumns({c: F.col(c).cast("string") for c in tables[0].columns if c in mixed})
    for t in tables[1:]:
        df = df.unionByName(t.withColumns({c: F.col(c).cast("string") for c in t.columns if c in mixed}), allowMissingColumns=True)
    df = df.filter(F.col("run_id").startswith(prefix))
    return df.withColumns({c: v for c, v in parse(F.col("run_id")).items() if c not in df.columns})


def runs_table(spark: SparkSession, path: str, metadata: DataFrame, status: str = "ok", **match) -> DataFrame:
    """Assignments of the runs whose metadata match; the table is partitioned by run_id, so other runs are not read."""
    wanted = metadata.filter(F.col("status") == status)
    for c, v in match.items():
        wanted = wanted.filter(F.col(c) == v)
    return spark.read.parquet(path).join(F.broadcast(wanted.select("run_id").distinct()) if wanted.count() < 10_000 else wanted.select("run_id").distinct(), "run_id", "left_semi")


def standardized_clonotypes(df: DataFrame, chain: str | None = None) -> DataFrame:
    """clone_id, cdr3, v_gene, j_gene, chain, count from whatever columns a table has.

    The sequence and both genes must have a column; an empty value in one of them is an error that says
    how many there are. The chain is the given one, or else that of `chain_of_columns`.
    """
    own = {c: resolve_column(df, CANDIDATES[c], c in ("cdr3", "v_gene", "j_gene")) for c in CANDIDATES}
    col = lambda c: F.col(f"`{own[c]}`")
    cdr3 = F.trim(col("cdr3"))
    values = {"cdr3": cdr3, "v_gene": F.trim(col("v_gene")), "j_gene": F.trim(col("j_gene"))}
    bad = df.agg(*[F.count_if(F.coalesce(v, F.lit("")) == "").alias(c) for c, v in values.items()]).first()
    if any(bad):
        raise ValueError("empty values: " + ", ".join(f"{n} of {own[c]}" for c, n in bad.asDict().items() if n))
    gene = lambda c: normalize_gene(col(c))
    named = F.lit(chain) if chain else chain_of_columns(df)
    count = F.expr(f"try_cast(`{own['count']}` as long)") if own["count"] else F.lit(1).cast("long")
    clone = col("clone_id").cast("string") if own["clone_id"] else F.sha1(F.concat_ws("|", cdr3, gene("v_gene"), gene("j_gene")))
    return df.select(clone.alias("clone_id"), cdr3.alias("cdr3"), gene("v_gene").alias("v_gene"), gene("j_gene").alias("j_gene"), named.alias("chain"), count.alias("count"))


def _opened(path: str) -> pa.NativeFile:
    """A file by the path that Spark lists it with, open for reading and seeking."""
    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path[len("file:") :].lstrip("/"))
    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


def _pieces(archive: str, member: str, read: Callable[[int], bytes], size: int, most: int) -> Iterator[pa.RecordBatch]:
    """A member as rows of whole lines; the first line that is not empty is the header of all."""
    header, rest, nth, left = None, b"", 0, size
    while left or rest:
        data = read(min(most, left))
        if left and not data:
            raise ValueError(f"{archive} ends inside {member}")
        left -= len(data)
        end = data.rfind(b"\n") + 1 if left else len(data)
        if not end and left:
            rest += data
            continue
        lines, rest = rest + data[:end], data[end:]
        while header is None and lines:
            first, _, lines = lines.partition(b"\n")
            header = first.rstrip(b"\r") or None
        if header is not None and (lines or not nth):
            yield pa.RecordBatch.from_pydict({"archive": [archive], "member": [member], "piece": pa.array([nth], pa.int32()), "header": [header.decode()], "content": [lines.decode()]})
            nth += 1


def archived_tables(spark: SparkSession, path: str, suffix: str = ".tsv", piece: int = PIECE) -> DataFrame:
    """(archive, member, piece, header, content) of the members of tar archives, compressed or not, whose names end in `suffix`.

    Content is a run of whole lines below the header, about `piece` bytes, so neither an archive nor a member is ever
    held. An archive that is not compressed is read by as many tasks as it has members, each from the member's place
    on; a compressed one can only be read from its beginning, by one task. Files are opened by Arrow's file systems
    (local, HDFS, S3, GCS) on the executors. An empty member gives no row; a member with a header only one without content.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                with _opened(name) as file:
                    try:
                        with tarfile.open(fileobj=file, mode="r:") as tar:
                            own = [m for m in tar if m.isfile() and m.name.endswith(suffix)]
                    except tarfile.ReadError:
                        found = [(name, None, None, None)]
                    else:
                        if any(m.issparse() for m in own):
                            raise ValueError(f"{name} has sparse members")
                        found = [(name, m.name, m.offset_data, m.size) for m in own]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["archive", "member", "begin", "size"])

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                with _opened(row["archive"]) as file:
                    if row["member"] is not None:
                        file.seek(row["begin"])
                        yield from _pieces(row["archive"], row["member"], file.read, row["size"], piece)
                        continue
                    with tarfile.open(fileobj=file, mode="r|*") as tar:
                        for m in tar:
                            if m.isfile() and m.name.endswith(suffix):
                                yield from _pieces(row["archive"], m.name, tar.extractfile(m).read, m.size, piece)

    tasks = lambda df: max(1, min(UNPACKERS, df.count()))
    files = spark.read.format("binaryFile").load(path).select("path")  # names only: contents are not read here
    members = written(files.repartition(tasks(files), "path").mapInArrow(listed, "archive string, member string, begin long, size long"), "members")
    return members.repartition(tasks(members), "archive", "member").mapInArrow(unpacked, "archive string, member string, piece int, header string, content string")


def archived_rows(archived: DataFrame, schema: str) -> DataFrame:
    """archive, member and the rows of tab-separated members with a header; columns by name, those that are missing null."""
    lines = F.filter(F.split("content", "\r?\n"), lambda x: x != "")
    rows = archived.select("archive", "member", F.split("header", "\t").alias("_head"), F.explode(lines).alias("_line"))
    cells = F.map_from_arrays("_head", F.slice(F.concat(F.split("_line", "\t"), F.array_repeat(F.lit(""), F.size("_head"))), 1, F.size("_head")))
    fields = [x.split() for x in schema.split(",")]
    return rows.select("archive", "member", *[F.nullif(F.try_element_at(cells, F.lit(n)), F.lit("")).try_cast(t).alias(n) for n, t in fields])


def wide_to_vector(df: DataFrame, columns: Sequence[str], vector: str = "embedding") -> DataFrame:
    """Numeric columns as one array; nulls and NaN stay null inside."""
    return df.select(*[c for c in df.columns if c not in columns], F.array(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in columns]).alias(vector))


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=True)


def write_runs(df: DataFrame, path: str) -> None:
    """Run tables partitioned by run_id; only the runs in the frame are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def write_by_group(df: DataFrame, path: str, group: str) -> None:
    df.write.mode("overwrite").partitionBy(group).parquet(path)


def write_tables(path: str, tables: Mapping[str, DataFrame]) -> None:
    """Intermediate tables for inspection, one parquet folder each."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def write_outputs(path: str, members: DataFrame, summary: DataFrame, enriched: DataFrame) -> None:
    """The three result tables of a comparison."""
    for name, df in (("clusters", members), ("summary", summary), ("enriched_clonotypes", enriched)):
        write_tsv(df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes]), f"{path}/{name}")
