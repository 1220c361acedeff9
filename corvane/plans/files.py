"""Queries of readers and extraction: files made from the driver's tables are written to the shared folder and read back.

A supplier k of nation n gives one file of each kind, a part k of size s one header; what is in them follows from k, n and s.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as fn
from corvane.operators import extract, hierarchy, resolve, updates, usages
from corvane.operators.tables import new_folder
from corvane.plans import standins as v
from corvane.plans.registry import query
from corvane.sources import readers
from corvane.streaming import jobs


def write_files(files: DataFrame, folder: str) -> str:
    """Write each row (path, content) as a file below folder; gives the folder. A repeated task writes the same files once more."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                store.create_dir(f"{root}/{path}".rpartition("/")[0], recursive=True)
                with store.open_output_stream(f"{root}/{path}", compression=None) as out:
                    out.write(content.encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    files.select("path", "content").mapInArrow(put, "n long").agg(F.sum("n")).collect()
    return folder


def _supplier_files(spark, sf, path: str, content: str, where: str = "true") -> str:
    """A folder with a file of each supplier (k, n, name); path and content are SQL."""
    s = v.table(spark, sf, "supplier").selectExpr("s_suppkey as k", "s_nationkey as n", "s_name as name").where(where)
    return write_files(s.selectExpr(f"{path} as path", f"{content} as content"), new_folder(spark, "files"))


def base(path: str = "path"):
    return F.regexp_extract(path, "([^/]*)$", 1)


S = "s AS (SELECT s_suppkey AS k, s_nationkey AS n, s_name AS name FROM supplier)"


@query(f"""WITH {S} SELECT 'u' || k || CASE k % 3 WHEN 0 THEN '.h' WHEN 1 THEN '.cpp' ELSE '.Build.cs' END AS file, CASE n % 2 WHEN 0 THEN 'engine' ELSE 'project' END AS scope,
CASE k % 3 WHEN 0 THEN 'header' WHEN 1 THEN 'source' ELSE 'build' END AS kind, sha256('class U' || k || chr(59) || chr(10) || '// ' || name || ' é') AS content_hash FROM s""")
def read_sources(spark, sf) -> DataFrame:
    root = _supplier_files(spark, sf, "concat(if(n % 2 = 0, 'engine', 'project'), '/d ', n, '/u', k, case k % 3 when 0 then '.h' when 1 then '.cpp' else '.Build.cs' end)", "concat('class U', k, ';\\n// ', name, ' é')")
    write_files(v.table(spark, sf, "region").selectExpr("concat('engine/r', r_regionkey, '.txt') as path", "'no source' as content"), root)
    write_files(v.table(spark, sf, "region").selectExpr("concat('project/r', r_regionkey, '.txt') as path", "'no source' as content"), root)
    return readers.read_sources(spark, [("engine", f"{root}/engine"), ("project", f"{root}/project")]).select(base().alias("file"), "scope", "kind", "content_hash")


@query(f"WITH {S} SELECT 'a' || k || CASE k % 2 WHEN 0 THEN '.uasset' ELSE '.umap' END AS asset, n::BIGINT AS size FROM s")
def list_assets(spark, sf) -> DataFrame:
    root = _supplier_files(spark, sf, "concat('x/', n, '/a', k, if(k % 2 = 0, '.uasset', '.umap'))", "repeat('b', n)")
    write_files(v.table(spark, sf, "region").selectExpr("concat('r', r_regionkey, '.txt') as path", "'none' as content"), root)
    return readers.list_assets(spark, [root]).select(base("asset_path").alias("asset"), "size")


ASSET_FACTS = """SELECT 'ref' AS fact, 'o' || o_orderkey AS asset, l_returnflag AS kind, 'P' || l_partkey AS value, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL
UNION ALL SELECT 'text', 'o' || o_orderkey, 'state', 'Order › ' || o_orderstatus || ': ' || o_orderpriority, 1 FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)"""


@query(ASSET_FACTS)
def asset_facts(spark, sf) -> DataFrame:
    """Nested records of orders with their lines, written as JSON and read back."""
    refs = v.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_returnflag").alias("ref_kind"), F.lit(None).cast("string").alias("target_path"), F.concat(F.lit("P"), "l_partkey").alias("target_name"))).alias("refs"))
    text = F.struct(F.lit("state").alias("text_kind"), F.array(F.lit("Order"), "o_orderstatus").alias("breadcrumb"), F.col("o_orderpriority").alias("text"), F.lit(False).alias("is_name"), F.lit(False).alias("is_editor_cache"))
    rows = v.table(spark, sf, "orders").join(refs, F.col("o_orderkey") == F.col("l_orderkey")).select(F.concat(F.lit("o"), "o_orderkey").alias("asset_path"), F.lit("order").alias("asset_kind"), "refs", F.array(text).alias("texts"))
    folder = new_folder(spark, "facts")
    rows.write.json(folder)
    refs, texts = readers.read_asset_facts(spark, folder)
    told = refs.groupBy(F.lit("ref").alias("fact"), F.col("asset_path").alias("asset"), F.col("ref_kind").alias("kind"), F.col("target_name").alias("value")).agg(F.count("*").alias("n"))
    return told.unionByName(texts.select(F.lit("text").alias("fact"), F.col("asset_path").alias("asset"), F.col("text_kind").alias("kind"), F.concat(fn.breadcrumb("breadcrumb"), F.lit(": "), "text").alias("value"), F.lit(1).cast("long").alias("n")))


@query("SELECT o_orderkey AS asset_path, 'Order › ' || o_orderstatus || ' › ' || o_orderpriority AS place FROM orders")
def breadcrumbs(spark, sf) -> DataFrame:
    return v.table(spark, sf, "orders").select(F.col("o_orderkey").alias("asset_path"), fn.breadcrumb(F.array(F.lit("Order"), "o_orderstatus", "o_orderpriority")).alias("place"))


_INI = """concat('a = ', n, '\\n[CoreRedirects]\\r\\n+ClassRedirects=(OldName="/Script/Old.U', k, '",NewName="/Script/New.U', k, '")\\n; c=1\\n[Engine.', n, ']\\n+ActiveGameNameRedirects=(OldGameName="G', k, '",NewGameName="H', n,
'")\\n-ActiveClassRedirects=(OldClassName="C', k, '",NewClassName="D', k, '")\\nOther=(OldName="x",NewName="y")')"""


def _ini(spark, sf) -> DataFrame:
    return readers.read_ini(spark, _supplier_files(spark, sf, "concat('c/i', k, '.ini')", _INI))


@query(f"""WITH {S}, r AS (SELECT k, n, unnest([1, 3, 6, 7, 8]) AS line FROM s) SELECT 'i' || k || '.ini' AS file, line, CASE WHEN line = 3 THEN 'CoreRedirects' WHEN line > 3 THEN 'Engine.' || n END AS section,
CASE line WHEN 1 THEN 'a' WHEN 3 THEN 'ClassRedirects' WHEN 6 THEN 'ActiveGameNameRedirects' WHEN 7 THEN 'ActiveClassRedirects' ELSE 'Other' END AS key,
CASE line WHEN 1 THEN n::VARCHAR WHEN 3 THEN '(OldName="/Script/Old.U' || k || '",NewName="/Script/New.U' || k || '")' WHEN 6 THEN '(OldGameName="G' || k || '",NewGameName="H' || n || '")'
WHEN 7 THEN '(OldClassName="C' || k || '",NewClassName="D' || k || '")' ELSE '(OldName="x",NewName="y")' END AS value FROM r""")
def ini_rows(spark, sf) -> DataFrame:
    return _ini(spark, sf).withColumn("file", base("file"))


@query(f"""WITH {S}, r AS (SELECT k, n, unnest([3, 6, 7]) AS line FROM s) SELECT CASE line WHEN 6 THEN 'GameName' ELSE 'Class' END AS kind, 'i' || k || '.ini' AS file, line,
CASE line WHEN 3 THEN '/Script/Old.U' WHEN 6 THEN 'G' ELSE 'C' END || k AS old_name, CASE line WHEN 3 THEN '/Script/New.U' || k WHEN 6 THEN 'H' || n ELSE 'D' || k END AS new_name FROM r""")
def ini_redirects(spark, sf) -> DataFrame:
    return readers.extract_redirects(_ini(spark, sf)).withColumn("file", base("file"))


@query(f"WITH {S} SELECT 'M' || k AS module, 'd' || n AS dir, array_to_string(list_sort(['Core', 'N' || n, 'UMG']), ',') AS deps FROM s")
def build_modules(spark, sf) -> DataFrame:
    code = """concat('public class M : ModuleRules {\\nPublicDependencyModuleNames.AddRange(new string[] { "Core",\\n "N', n, '" });\\nPrivateDependencyModuleNames.Add("UMG");\\nPrivateDependencyModuleNames.Add("Core"); }')"""
    root = _supplier_files(spark, sf, "concat('d', n, '/M', k, '.Build.cs')", code)
    return readers.read_modules(spark, [root]).select("module", base("dir").alias("dir"), F.array_join("deps", ",").alias("deps"))


@query(f"WITH {S} SELECT 'P' || k AS project, 'd' || n AS dir, '5.' || n AS engine, 'x' || k || '|y' AS plugin_dirs, CASE WHEN k % 2 = 0 THEN 'A' || k ELSE '' END AS enabled FROM s")
def project_files(spark, sf) -> DataFrame:
    told = """concat('{\\n "EngineAssociation": "5.', n, '", "AdditionalPluginDirectories": ["x', k, '", "y"],\\n "Plugins": [{"Name": "A', k, '", "Enabled": ', k % 2 = 0, '}, {"Name": "B", "Enabled": false}]}')"""
    p = readers.read_uprojects(spark, _supplier_files(spark, sf, "concat('d', n, '/P', k, '.uproject')", told))
    return p.select("project", base("dir").alias("dir"), F.col("engine_association").alias("engine"), F.array_join("additional_plugin_directories", "|").alias("plugin_dirs"), F.array_join("enabled_plugins", "|").alias("enabled"))


@query(f"WITH {S} SELECT 'f' || k || '.cpp' AS file, '/b' || n AS directory, 'inc dir' || n || '|/usr/i' AS include_paths, 'X=' || k || '|NDEBUG' AS definitions FROM s")
def compile_database(spark, sf) -> DataFrame:
    """A database per nation."""
    s = v.table(spark, sf, "supplier").selectExpr("s_suppkey as k", "s_nationkey as n")
    command = F.concat(F.lit('cl /I "inc dir'), "n", F.lit('" -DX='), "k", F.lit(" -I/usr/i /DNDEBUG f.cpp"))
    row = F.struct(F.concat(F.lit("/b"), "n").alias("directory"), F.concat(F.lit("f"), "k", F.lit(".cpp")).alias("file"), command.alias("command"))
    files = s.groupBy("n").agg(F.to_json(F.collect_list(row)).alias("content")).select(F.concat("n", F.lit(".json")).alias("path"), "content")
    c = readers.read_compile_db(spark, write_files(files, new_folder(spark, "compile")))
    return c.select("file", "directory", F.array_join("include_paths", "|").alias("include_paths"), F.array_join("definitions", "|").alias("definitions"))


@query("""SELECT '2024-01-0' || (user_id % 7 + 1) AS session_date, (user_id % 40)::INT AS pid, row_number() OVER (PARTITION BY user_id % 40, user_id % 7 ORDER BY event_id) AS n, epoch_us(ts) AS ts_us, event_type AS category, 'value ' || event_id AS message FROM events""")
def session_logs(spark, sf) -> DataFrame:
    """Events as log lines, a file per process and day."""
    e = v.events(spark, sf).selectExpr("user_id % 40 as pid", "user_id % 7 as day", "event_id", "concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSSSSS'), ' [', event_type, '] value ', event_id) as line")
    logs = e.groupBy("pid", "day").agg(F.sort_array(F.collect_list(F.struct("event_id", "line"))).alias("x"))
    files = logs.selectExpr("concat('Session_2024-01-0', day + 1, '_12-30-0', pid % 10, '_pid', pid, '.log') as path", "concat_ws('\\r\\n', transform(x, r -> r.line)) as content")
    return readers.read_logs(spark, write_files(files, new_folder(spark, "logs"))).select("session_date", "pid", "n", F.unix_micros("ts").alias("ts_us"), "category", "message")


@query("SELECT p_partkey AS symbol_id, CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN upper(p_name) ELSE p_name END AS name, p_brand AS module FROM part")
def index_on_disk(spark, sf) -> DataFrame:
    """All modules are written, then two of them again."""
    s, path = v.symbols(spark, sf).select("symbol_id", "name", "module"), new_folder(spark, "index")
    updates.write_index(s, path, "module")
    updates.write_index(s.where("module in ('Brand#1', 'Brand#2')").withColumn("name", F.upper("name")), path, "module")
    return updates.read_index(spark, path).select("symbol_id", "name", "module")


@query("SELECT DISTINCT p_type AS macro, p_name AS specifier FROM part WHERE p_size % 3 = 1")
def specifier_catalog(spark, sf) -> DataFrame:
    folder = new_folder(spark, "catalog")
    s = v.symbols(spark, sf).select(F.concat(F.lit("5."), F.col("size") % 3).alias("engine_version"), F.col("kind").alias("macro"), F.col("name").alias("specifier"), F.lit(False).alias("needs_value"), F.array().cast("array<string>").alias("conflicts_with"), F.lit("").alias("doc"))
    s.distinct().write.parquet(folder)
    return readers.read_specifier_catalog(spark, folder, "5.1").select("macro", "specifier")


@query(f"WITH {S} SELECT 'u' || k || '.h' AS file, CASE k % 5 WHEN 0 THEN 'vanished' ELSE 'empty' END AS cause FROM s WHERE k % 5 < 2")
def unreadable_files(spark, sf) -> DataFrame:
    """Files that were listed (k % 5 = 0: gone since, 1: without content) and gave nothing."""
    root = _supplier_files(spark, sf, "concat('d', n, '/u', k, '.h')", "if(k % 5 = 1, '', 'class X;')", "k % 5 > 0")
    now = readers.list_files(spark, [root], "*.h")
    listed = v.table(spark, sf, "supplier").selectExpr("concat('u', s_suppkey, '.h') as path")
    read = readers.read_sources(spark, [("project", root)]).where("content <> ''").select(base().alias("path"))
    return readers.unreadable(listed, read, now.select(base().alias("path"), "size")).select(F.col("path").alias("file"), "cause")


# Extraction

_HEADER = """concat('#pragma once\\n#include "CoreMinimal.h" // base\\n', if(s % 2 = 0, concat('#include <', a, '/', b, '.h>'), '// #include "no.h"'), '\\n/* UCLASS()\\n */\\nDECLARE_DYNAMIC_MULTICAST_DELEGATE_OneParam(FOn', k, ', int32, Score);\\n',
'DECLARE_DELEGATE_OneParam(FMap', k, ', TMap<int32, FString>);\\nDECLARE_DELEGATE_RetVal_OneParam(bool, FAsk', k, if(s % 3 = 0, '', ', int32'), ');\\nUCLASS(Blueprintable, meta = (DisplayName = "', b, ', (', s, ')"))\\nclass GAME_API U', k, ' : public UBase', k div 3, ', public IThing\\n{\\n',
'\\tGENERATED_BODY()\\nprivate:\\n\\tUPROPERTY(EditAnywhere', if(s % 7 = 0, ',\\n\\t\\tReplicated', ''), ', Category = F((', s, ')))\\n\\tfloat Health = ', s, '.f;\\n\\tUFUNCTION(BlueprintPure)\\n\\tvirtual int32 Get', k, '(int32 Count', if(s % 2 = 1, ', bool bNow = false', ''), ') const;\\n\\tUMesh* Raw;\\n};\\n')"""


def headers(spark, sf) -> DataFrame:
    """A header per part (path, content)."""
    p = v.table(spark, sf, "part").selectExpr("p_partkey as k", "p_size as s", "split(p_name, ' ')[0] as a", "split(p_name, ' ')[1] as b")
    return p.selectExpr("concat('m/', k, '.h') as path", f"{_HEADER} as content")


P = "p AS (SELECT p_partkey AS k, p_size AS s, 'm/' || p_partkey || '.h' AS path, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, (p_size % 7 = 0)::INT AS more FROM part)"


@query(f"""WITH {P} SELECT path, 9 AS line, 'UCLASS' AS macro, 'Blueprintable' AS specifiers, b || ', (' || s || ')' AS display_name, 'class GAME_API U' || k || ' : public UBase' || (k // 3) || ', public IThing' AS declaration FROM p
UNION ALL SELECT path, 14, 'UPROPERTY', 'EditAnywhere|' || CASE more WHEN 1 THEN 'Replicated|' ELSE '' END || 'Category = F((' || s || '))', NULL, 'float Health = ' || s || '.f' FROM p
UNION ALL SELECT path, 16 + more, 'UFUNCTION', 'BlueprintPure', NULL, 'virtual int32 Get' || k || '(int32 Count' || CASE s % 2 WHEN 1 THEN ', bool bNow = false' ELSE '' END || ') const' FROM p""")
def reflection_macros(spark, sf) -> DataFrame:
    r = extract.extract_reflection(headers(spark, sf))
    return r.select("path", "line", "macro", F.array_join("specifiers", "|").alias("specifiers"), F.element_at("meta", "DisplayName").alias("display_name"), "declaration")


@query(f"WITH {P} SELECT path, 2 AS line, 'CoreMinimal.h' AS target_text FROM p UNION ALL SELECT path, 3, a || '/' || b || '.h' FROM p WHERE s % 2 = 0")
def include_lines(spark, sf) -> DataFrame:
    return extract.extract_includes(headers(spark, sf))


@query(f"""WITH {P} SELECT path, 'class' AS kind, 'U' || k AS name, NULL AS container, 'UBase' || (k // 3) || '|IThing' AS bases, NULL::INT AS n_params, NULL AS type_text, false AS is_virtual, false AS is_const FROM p
UNION ALL SELECT path, 'field', 'Health', 'U' || k, NULL, NULL, 'float', false, false FROM p UNION ALL SELECT path, 'field', 'Raw', 'U' || k, NULL, NULL, 'UMesh*', false, false FROM p
UNION ALL SELECT path, 'function', 'Get' || k, 'U' || k, NULL, (1 + s % 2)::INT, 'int32', true, true FROM p""")
def declarations(spark, sf) -> DataFrame:
    d = extract.extract_declarations(headers(spark, sf))
    return d.select("path", "kind", "name", "container", F.array_join("bases", "|").alias("bases"), F.when(F.col("params").isNotNull(), F.size("params")).alias("n_params"), "type_text", "is_virtual", "is_const")


@query(f"""WITH {P} SELECT path, 6 AS line, 'FOn' || k AS type_name, 'int32|Score' AS params, true AS is_dynamic, true AS is_multicast, '' AS errors FROM p
UNION ALL SELECT path, 7, 'FMap' || k, 'TMap<int32|FString>', false, false, 'comma in a type' FROM p
UNION ALL SELECT path, 8, 'FAsk' || k, CASE s % 3 WHEN 0 THEN '' ELSE 'int32' END, false, false, CASE s % 3 WHEN 0 THEN 'wrong number of parameters' ELSE '' END FROM p""")
def delegates(spark, sf) -> DataFrame:
    d = extract.extract_delegates(headers(spark, sf))
    return d.select("path", "line", "type_name", F.array_join("params", "|").alias("params"), "is_dynamic", "is_multicast", F.array_join("errors", "|").alias("errors"))


@query("""WITH p AS (SELECT *, ['Alpha', 'AThing', 'FValue', 'UThing', 'EMode'][(p_size % 5 + 1)::INT] || p_partkey AS name FROM part), q AS (SELECT p_partkey AS k, name, unnest([name, name || 'x']) AS token FROM p)
SELECT q.k AS path, token, CASE WHEN token = q.name AND k % 4 = 0 THEN 'actor' WHEN token = q.name AND k % 2 = 0 THEN 'object' WHEN token = q.name THEN lower(p_type)
WHEN regexp_matches(token, '^[AU][A-Z]') THEN 'object' WHEN regexp_matches(token, '^F[A-Z]') THEN 'value' WHEN regexp_matches(token, '^E[A-Z]') THEN 'enum' ELSE 'unknown' END AS class, token = q.name AND p_size % 3 = 0 AS exposed FROM q JOIN p ON p_partkey = k""")
def token_classes(spark, sf) -> DataFrame:
    """Each part's name is a symbol; the same name with an x more is none."""
    s = v.symbols(spark, sf).withColumn("name", F.concat(F.element_at(F.array(*[F.lit(x) for x in ("Alpha", "AThing", "FValue", "UThing", "EMode")]), (F.col("size") % 5 + 1).cast("int")), F.col("symbol_id").cast("string")))
    tokens = extract.tokenize(s.select(F.col("symbol_id").alias("path"), F.concat("name", F.lit(' = "text" + '), "name", F.lit("x; // "), "name").alias("content")))
    spec = F.when(F.col("size") % 3 == 0, F.array(F.lit("EditAnywhere"), F.lit("BlueprintReadOnly"))).otherwise(F.array(F.lit("EditAnywhere")))
    roots = v.table(spark, sf, "region").where("r_regionkey < 2").select((-1 - F.col("r_regionkey")).cast("long").alias("symbol_id"), F.when(F.col("r_regionkey") == 0, "AActor").otherwise("UObject").alias("name"), F.lit("class").alias("kind"), F.array().cast("array<string>").alias("specifiers"))
    known = s.select("symbol_id", "name", F.lower("kind").alias("kind"), spec.alias("specifiers")).unionByName(roots)
    up = s.where("symbol_id % 2 = 0").select(F.col("symbol_id").alias("type_id"), F.explode(F.when(F.col("symbol_id") % 4 == 0, F.expr("array(-1L, -2L)")).otherwise(F.expr("array(-2L)"))).alias("ancestor_id"))
    return extract.classify_tokens(tokens, known, up).select("path", "token", "class", "exposed")


@query("SELECT p_partkey AS symbol_id, p_size % 3 = 0 AS exposed FROM part")
def exposed_symbols(spark, sf) -> DataFrame:
    s = v.symbols(spark, sf)
    spec = F.when(F.col("size") % 3 == 0, F.array(F.lit("EditAnywhere"), F.lit("BlueprintCallable"))).when(F.col("size") % 3 == 1, F.array(F.lit("EditAnywhere")))
    return s.select("symbol_id", fn.is_exposed(spec).alias("exposed"))


@query(r"""WITH f AS (SELECT DISTINCT regexp_extract(url, '^(https?://[^/]+)', 1) AS dir, regexp_extract(url, '^https?://([^/]+)', 1) AS project FROM pages),
g AS (SELECT dir, project FROM f UNION SELECT dir || '/fr', project || ':fr' FROM f)
SELECT page_id, arg_max(project, length(dir)) AS project FROM pages JOIN g ON starts_with(regexp_replace(url, '/[^/]*$', '') || '/', dir || '/') GROUP BY page_id""")
def page_projects(spark, sf) -> DataFrame:
    p = v.table(spark, sf, "pages").select("page_id", F.col("url").alias("path"))
    host = p.select(F.regexp_extract("path", "^(https?://[^/]+)", 1).alias("dir"), F.regexp_extract("path", "^https?://([^/]+)", 1).alias("project")).distinct()
    folders = host.unionByName(host.select(F.concat("dir", F.lit("/fr")).alias("dir"), F.concat("project", F.lit(":fr")).alias("project")))
    return resolve.assign_project(p, folders).select("page_id", "project")


UP = "up(type_id, ancestor_id, depth) AS (SELECT p_partkey, p_partkey // 3, 1 FROM part WHERE p_partkey > 0 UNION ALL SELECT type_id, ancestor_id // 3, depth + 1 FROM up WHERE ancestor_id > 0)"
SEEN = f"""{UP}, su AS (SELECT p_partkey AS type_id, p_partkey AS ancestor_id, 0 AS depth FROM part UNION ALL SELECT * FROM up),
m AS (SELECT type_id, p_partkey AS member_id, p_type AS name, p_size FROM su JOIN part ON p_partkey = ancestor_id QUALIFY row_number() OVER (PARTITION BY type_id, p_type ORDER BY depth) = 1)"""


@query(f"""WITH RECURSIVE {SEEN} SELECT o_orderkey AS field_id, member_id, name, '->' AS via FROM orders JOIN m ON type_id = o_custkey WHERE o_orderkey % 3 < 2
UNION ALL SELECT o_orderkey, r_regionkey::BIGINT, r_name, '.' FROM orders, region WHERE o_orderkey % 3 = 0""")
def pointee_members(spark, sf) -> DataFrame:
    """Orders as fields: smart pointers, raw pointers and values of their customers' types."""
    seen = hierarchy.effective_members(v.members(spark, sf), v.type_ancestors(spark, sf), v.types(spark, sf)).withColumn("type_name", F.concat(F.lit("UType"), "type_id"))
    name = F.concat(F.lit("UType"), "o_custkey")
    kind = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("TObjectPtr<"), name, F.lit(">"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("const "), name, F.lit("*"))).otherwise(name)
    fields = v.table(spark, sf, "orders").select(F.col("o_orderkey").alias("field_id"), kind.alias("type_text"))
    wrappers = v.table(spark, sf, "region").select(F.lit("TObjectPtr").alias("type_name"), F.col("r_regionkey").cast("long").alias("member_id"), F.col("r_name").alias("name"))
    return hierarchy.pointee_members(fields, seen, wrappers)


@query(f"WITH RECURSIVE {SEEN} SELECT type_id, member_id, name FROM m WHERE p_size % 4 = 0")
def static_members(spark, sf) -> DataFrame:
    m = v.members(spark, sf).join(v.symbols(spark, sf).select(F.col("symbol_id").alias("member_id"), (F.col("size") % 4 == 0).alias("is_static")), "member_id")
    return hierarchy.static_members(m, v.type_ancestors(spark, sf), v.types(spark, sf)).select("type_id", "member_id", "name")


@query("""WITH w AS (SELECT DISTINCT 'Old' || p_brand AS old_module, p_name FROM part), s AS (SELECT DISTINCT p_brand, p_name FROM part),
n AS (SELECT old_module, p_brand AS new_module, count(*) AS n_classes FROM w JOIN s USING (p_name) GROUP BY ALL)
SELECT p_brand AS module, l_returnflag AS ref_kind, count(*) AS n_refs, count(DISTINCT l_orderkey) AS n_assets, NULL AS alias_of FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ROLLUP (p_brand, l_returnflag)
UNION ALL SELECT old_module, 'alias', n_classes, 0, new_module FROM (FROM n QUALIFY row_number() OVER (PARTITION BY old_module ORDER BY n_classes DESC, new_module) = 1)""")
def index_overview(spark, sf) -> DataFrame:
    s = v.symbols(spark, sf)
    lost = s.select(F.concat(F.lit("Old"), "module").alias("target_module"), F.col("name").alias("target_name"))
    return usages.index_overview(resolve.resolve_asset_refs(v.asset_refs(spark, sf), s), resolve.detect_module_aliases(lost, s))


@query("SELECT o_custkey AS parent_path, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INT AS position, o_orderkey AS asset_path FROM orders")
def ranked_assets(spark, sf) -> DataFrame:
    return usages.ranked_assets(v.assets(spark, sf))


@query("""SELECT 'm/' || p_partkey || '.h' AS path, CASE WHEN p_partkey % 3 = 0 THEN 'V' ELSE 'U' END || p_partkey AS name FROM part WHERE p_partkey % 5 <> 0""")
def streamed_index(spark, sf) -> DataFrame:
    """Three batches of files: all of them; those with k % 3 = 0 anew, with older versions of k % 7 = 0 that come late; k % 5 = 0 deleted."""
    p = v.table(spark, sf, "part").selectExpr("p_partkey as k", "concat('m/', p_partkey, '.h') as path")
    made = lambda where, name, version, deleted="false": p.where(where).selectExpr("path", f"concat('class {name}', k, '\\n{{\\n}};\\n') as content", f"cast({version} as long) as version", f"{deleted} as deleted")
    folder, out = new_folder(spark, "stream-in"), new_folder(spark, "stream-index")
    for i, batch in enumerate((made("true", "U", 2), made("k % 3 = 0", "V", 3).unionByName(made("k % 7 = 0", "W", 1)), made("k % 5 = 0", "U", 4, "true"))):
        batch.coalesce(1).write.parquet(f"{folder}/{i}")
    stream = spark.readStream.schema("path string, content string, version long, deleted boolean").option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    told = lambda files: extract.extract_declarations(files).select("path", "name", F.concat_ws(" ", "kind", "name").alias("declaration"))
    jobs.stream_index(stream, f"{out}/index", told, f"{out}/checkpoint", partitions=4).awaitTermination()
    return jobs.read_declarations(spark, f"{out}/index").select("path", "name")
