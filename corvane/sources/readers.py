"""Readers of source trees, asset listings, configuration, build files and logs, and the index on disk.

All reading goes through Spark's data sources, so paths may be in any store that Spark reads. Files that can't be read are
skipped where the session says so (`spark.sql.files.ignoreCorruptFiles`, `ignoreMissingFiles`); `unreadable` reports them.
"""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions.text import path_stem, unix_path
from corvane.operators.scans import line_block, scan
from corvane.operators.tables import saved
from corvane.schemas import SCHEMAS


def _decoded_path() -> Column:
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def read_sources(spark: SparkSession, roots: list[tuple[str, str]], pattern: str = "*.{h,cpp,inl,cs}") -> DataFrame:
    """(path, scope, kind, content, content_hash, mtime) of the files below each (scope, folder)."""
    parts = []
    for scope, root in roots:
        files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
        parts.append(files.select(_decoded_path().alias("path"), F.lit(scope).alias("scope"), F.col("value").alias("content"), F.col("_metadata.file_modification_time").alias("mtime")))
    out = reduce(DataFrame.unionByName, parts)
    kind = F.when(F.lower("path").rlike(r"\.(h|inl)$"), "header").when(F.lower("path").endswith(".cs"), "build").otherwise("source")
    return out.select("path", "scope", kind.alias("kind"), "content", F.sha2("content", 256).alias("content_hash"), "mtime")


#: Stores that tasks can list by themselves.
LISTED_BY_TASKS = ("file", "hdfs", "s3", "gs", "abfs", "abfss")


def _glob(pattern: str) -> str:
    """A pattern with *, ? and one level of {a,b} as a regular expression."""
    parts = re.split(r"\{([^}]*)\}", pattern)
    made = [fnmatch.translate(x)[4:-3] if i % 2 == 0 else f"(?:{'|'.join(fnmatch.translate(y)[4:-3] for y in x.split(','))})" for i, x in enumerate(parts)]
    return "".join(made)


def list_files(spark: SparkSession, roots: list[str], pattern: str = "*") -> DataFrame:
    """(path, size, mtime) of files as they are now; contents aren't read. As in Spark's own listing, names that begin with a dot or an underscore are left out.

    Folders are a table: tasks list its folders through the store's own file system, and the folders that they find are the table of the next round, so rounds are
    as many as folders lie in one another, and names are never on the driver. A folder that vanishes meanwhile has no files.
    """
    roots = [r if "://" in r else f"file://{r.removeprefix('file:')}" for r in roots]
    other = sorted({r.partition("://")[0] for r in roots} - set(LISTED_BY_TASKS))
    if other:
        raise ValueError(f"tasks can't list {', '.join(other)}; the stores are {', '.join(LISTED_BY_TASKS)}")
    wanted = re.compile(_glob(pattern))
    schema = "root string, folder string, is_file boolean, path string, size long, mtime timestamp"

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for root, folder in zip(batch.column("root").to_pylist(), batch.column("folder").to_pylist(), strict=True):
                store, base = pyarrow.fs.FileSystem.from_uri(root.rstrip("/") or root)
                seen = store.get_file_info(pyarrow.fs.FileSelector(base + folder, allow_not_found=True))
                seen = [i for i in seen if not i.base_name.startswith((".", "_")) and (not i.is_file or wanted.fullmatch(i.base_name))]
                start = root.rstrip("/").removesuffix(base) if root.rstrip("/").endswith(base) else root.partition("://")[0] + "://"
                columns = [[root] * len(seen), [i.path[len(base) :] for i in seen], [i.is_file for i in seen], [start + i.path for i in seen], [i.size if i.is_file else 0 for i in seen]]
                times = pa.array([i.mtime_ns // 1000 if i.mtime_ns is not None else None for i in seen], pa.timestamp("us", "UTC"))
                kinds = (pa.string(), pa.string(), pa.bool_(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), times], ["root", "folder", "is_file", "path", "size", "mtime"])

    rows = spark.createDataFrame([(r, "") for r in dict.fromkeys(roots)], "root string, folder string")
    found = []
    while True:
        listed = saved(rows.repartition("root", "folder").mapInArrow(visit, schema), "listing")
        found.append(listed.where("is_file").select("path", "size", "mtime"))
        rows = listed.where("not is_file").select("root", "folder")
        if rows.isEmpty():
            return reduce(DataFrame.unionByName, found)


def list_assets(spark: SparkSession, roots: list[str], pattern: str = "*.{uasset,umap}") -> DataFrame:
    """(asset_path, size, mtime); contents aren't read."""
    return list_files(spark, roots, pattern).withColumnRenamed("path", "asset_path")


def read_facts(spark: SparkSession, path: str, name: str, form: str = "parquet") -> DataFrame:
    """A core table by name, with its fixed schema, from Parquet or JSON."""
    return spark.read.schema(SCHEMAS[name]).format(form).load(path)


def explode_asset_facts(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """asset_refs and asset_texts from one nested row per asset: asset_path, asset_kind, refs, texts (arrays of structs)."""
    refs = raw.select("asset_path", F.explode("refs").alias("r")).select("asset_path", "r.*")
    texts = raw.select("asset_path", "asset_kind", F.explode("texts").alias("t")).select("asset_path", "asset_kind", "t.*")
    return refs, texts


def read_asset_facts(spark: SparkSession, path: str, form: str = "json") -> tuple[DataFrame, DataFrame]:
    """asset_refs and asset_texts out of files with one nested record per asset."""
    refs = "array<struct<ref_kind:string,target_path:string,target_name:string>>"
    texts = "array<struct<text_kind:string,breadcrumb:array<string>,text:string,is_name:boolean,is_editor_cache:boolean,loc:struct<namespace:string,key:string>>>"
    return explode_asset_facts(spark.read.schema(f"asset_path string, asset_kind string, refs {refs}, texts {texts}").format(form).load(path))


def read_specifier_catalog(spark: SparkSession, path: str, engine_version: str, form: str = "parquet") -> DataFrame:
    """The specifiers of one engine version."""
    return read_facts(spark, path, "specifier_catalog", form).where(F.col("engine_version") == engine_version)


def ini_rows(lines: DataFrame) -> DataFrame:
    """(file, line, section, key, value) of numbered lines (file, line, text): the section carries forward; before any it is null."""
    text = F.trim(F.regexp_replace("text", r"\r$", ""))
    section = F.nullif(F.regexp_extract(text, r"^\[(.*)\]$", 1), F.lit(""))
    rows = scan(lines.withColumn("section", section).withColumn("text", text), ["file"], ["line"], line_block("line"), lasts={"section": F.col("section")})
    rows = rows.where(F.col("text").rlike(r"^[^;#\[].*="))
    key = F.trim(F.regexp_replace(F.regexp_extract("text", r"^([^=]*)=", 1), r"^[+\-.!]", ""))
    return rows.select("file", "line", "section", key.alias("key"), F.trim(F.regexp_extract("text", r"^[^=]*=(.*)$", 1)).alias("value"))


def numbered_lines(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    return files.select(F.col(path).alias("file"), F.posexplode(F.split(content, "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)


def read_ini(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    files = spark.read.text(paths, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.ini").select(_decoded_path().alias("path"), F.col("value").alias("content"))
    return ini_rows(numbered_lines(files))


def extract_redirects(ini: DataFrame) -> DataFrame:
    """(kind, old_name, new_name, file, line) of the three families of redirects."""
    active = F.col("key").isin("ActiveGameNameRedirects", "ActiveClassRedirects")
    core = F.col("section") == "CoreRedirects"
    grab = lambda names: F.nullif(F.regexp_extract("value", rf'(?:{names})\s*=\s*"?([^",)]*)"?', 1), F.lit(""))
    rows = ini.where(active | core).select("key", "file", "line", grab("OldGameName|OldClassName|OldName").alias("old_name"), grab("NewGameName|NewClassName|NewName").alias("new_name"))
    return rows.where("old_name is not null and new_name is not null").select(F.regexp_replace("key", "^Active|Redirects$", "").alias("kind"), "old_name", "new_name", "file", "line")


def module_rows(build_files: DataFrame) -> DataFrame:
    """(module, dir, deps) of build files (path, content): the string literals of their dependency lists."""
    lists = F.regexp_extract_all("content", F.lit(r"(?s)DependencyModuleNames\s*\.\s*Add(?:Range)?\s*\((.*?)\)\s*;"), 1)
    names = F.flatten(F.transform(lists, lambda x: F.regexp_extract_all(x, F.lit(r'"([^"]+)"'), 1)))
    module = F.regexp_replace(path_stem("path"), r"\.(Build|Target)$", "")
    return build_files.select(module.alias("module"), F.regexp_replace(unix_path("path"), "/[^/]*$", "").alias("dir"), F.array_sort(F.array_distinct(names)).alias("deps"))


def read_modules(spark: SparkSession, roots: list[str]) -> DataFrame:
    files = spark.read.text(roots, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{Build,Target}.cs")
    return module_rows(files.select(_decoded_path().alias("path"), F.col("value").alias("content")))


def read_uprojects(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(project, dir, engine_association, additional_plugin_directories, enabled_plugins)."""
    schema = "EngineAssociation string, AdditionalPluginDirectories array<string>, Plugins array<struct<Name:string,Enabled:boolean>>"
    j = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.uproject").json(paths).withColumn("path", _decoded_path())
    on = F.transform(F.filter(F.coalesce("Plugins", F.array().cast("array<struct<Name:string,Enabled:boolean>>")), lambda p: p["Enabled"]), lambda p: p["Name"])
    return j.select(path_stem("path").alias("project"), F.regexp_replace("path", "/[^/]*$", "").alias("dir"), F.col("EngineAssociation").alias("engine_association"), F.col("AdditionalPluginDirectories").alias("additional_plugin_directories"), on.alias("enabled_plugins"))


def compile_rows(commands: DataFrame) -> DataFrame:
    """(file, directory, include_paths, definitions) of rows (file, directory, command)."""
    flag = lambda f: F.transform(F.regexp_extract_all("command", F.lit(rf'(?:^|\s)[-/]{f}\s*("[^"]*"|\S+)'), 1), lambda x: F.replace(x, F.lit('"'), F.lit("")))
    return commands.select("file", "directory", flag("I").alias("include_paths"), flag("D").alias("definitions"))


def read_compile_db(spark: SparkSession, path: str) -> DataFrame:
    return compile_rows(spark.read.schema("directory string, file string, command string").option("multiLine", True).json(path))


def session_of(file_name: Column) -> list[Column]:
    """session_date, session_time and pid out of a log's file name."""
    part = lambda i: F.nullif(F.regexp_extract(file_name, r"_(\d{4}-?\d{2}-?\d{2})_(\d{2}[-:.]?\d{2}[-:.]?\d{2})_pid(\d+)\.log$", i), F.lit(""))
    return [part(1).alias("session_date"), part(2).alias("session_time"), part(3).cast("int").alias("pid")]


def read_logs(spark: SparkSession, folder: str) -> DataFrame:
    """(session_date, session_time, pid, n, ts, category, message) of log lines `<time> [<category>] <message>`."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.log")
    rows = files.select(*session_of(F.col("_metadata.file_name")), F.posexplode(F.split("value", "\r?\n")).alias("n", "line")).where("line <> ''")
    grab = lambda i: F.nullif(F.regexp_extract("line", r"^(\S+[T ]\S+)\s+\[([^\]]*)\]\s*(.*)$", i), F.lit(""))
    return rows.select("session_date", "session_time", "pid", (F.col("n") + 1).cast("long").alias("n"), F.try_to_timestamp(grab(1)).alias("ts"), grab(2).alias("category"), F.coalesce(grab(3), F.col("line")).alias("message"))


def unreadable(expected: DataFrame, read: DataFrame, now: DataFrame | None = None) -> DataFrame:
    """(path, cause): files that were listed (path) but of which a skipping read gave nothing.

    now: a later listing (path, size) tells why: the file has vanished, has become or was empty, or is there but can't be read. Without it the cause is
    unknown.
    """
    gone = expected.select("path").distinct().join(read.select("path"), "path", "left_anti")
    if now is None:
        return gone.withColumn("cause", F.lit("unknown"))
    cause = F.when(F.col("size").isNull(), "vanished").when(F.col("size") == 0, "empty").otherwise("unreadable")
    return gone.join(now.select("path", "size"), "path", "left").select("path", cause.alias("cause"))
