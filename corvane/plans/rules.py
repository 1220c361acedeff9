"""Queries of the inspections: their tables are made from the driver's parts and order lines.

Every part k of size s stands for a header `m/k.h` with one type (t<k>), one field (f<k>) and one function (g<k>); what they are follows from k
and s, so SQL can say which of them a rule must find. Order lines are uses.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators import inspections
from corvane.plans import standins as v
from corvane.plans.registry import query

_SYMBOLS = (
    "symbol_id string, name string, kind string, container_id string, path string, line int, end_line int, access string, is_static boolean, is_pure boolean, is_const boolean, has_body boolean, "
    "type_text string, params array<struct<type:string,name:string,has_default:boolean>>, macro string, specifiers array<string>, meta map<string,string>"
)


def _rows(spark, sf, where: str = "true", **columns: str) -> DataFrame:
    """Symbols made from parts (k, s), with null where nothing is said."""
    parts = v.table(spark, sf, "part").selectExpr("p_partkey as k", "p_size as s").where(where)
    told = [x.split(" ", 1) for x in _SYMBOLS.split(", ")]
    return parts.selectExpr(*[f"cast({columns.get(name, 'null')} as {kind}) as {name}" for name, kind in told])


def symbols(spark, sf) -> DataFrame:
    path = "concat('m/', k, '.h')"
    types = _rows(
        spark, sf, symbol_id="concat('t', k)", name="concat(substring('AUFEI', cast(k % 5 + 1 as int), 1), 'Thing', k)", kind="'class'", path=path, line="10", end_line="20", access="'public'",
        macro="case s % 4 when 0 then 'UCLASS' when 1 then 'USTRUCT' when 2 then 'UENUM' end",
    )
    fields = _rows(
        spark, sf, symbol_id="concat('f', k)", name="concat('p', k)", kind="'field'", container_id="concat('t', k)", path=path, line="12", end_line="12", access="if(s % 3 = 0, 'private', 'public')", is_const="s % 13 = 0",
        macro="if(s % 2 = 1, 'UPROPERTY', null)", type_text="case k % 3 when 0 then 'UObject*' when 1 then concat('UThing', k, ' *') else concat('FDone', k % 4) end",
        specifiers="case s % 4 when 0 then array('BlueprintReadWrite') when 1 then array(concat('ReplicatedUsing = OnRep_', k % 7)) when 2 then array('BlueprintAssignable', 'EditAnywhere') else array('EditAnywhere', 'VisibleAnywhere') end",
        meta="if(s % 5 = 0, map('AllowPrivateAccess', 'true'), map())",
    )
    functions = _rows(
        spark, sf, symbol_id="concat('g', k)", name="concat('OnRep_', k % 5)", kind="'function'", container_id="concat('t', k)", path=path, line="14", end_line="14", access="'public'", is_static="s % 11 = 0", is_pure="false",
        is_const="s % 7 = 0", has_body="false", type_text="'void'", macro="if(s % 5 < 3, 'UFUNCTION', null)", params="array(named_struct('type', if(k % 2 = 0, 'int32', 'int32&'), 'name', 'n', 'has_default', s % 2 = 0))",
        specifiers="case s % 3 when 0 then array('BlueprintPure') when 1 then array('BlueprintNativeEvent') else array('Server', 'WithValidation') end",
    )
    bodies = _rows(
        spark, sf, "k % 2 = 0", symbol_id="concat('d', k)", name="concat('OnRep_', k % 5, '_Implementation')", kind="'function'", container_id="concat('t', k)", path="concat('m/', k, '.cpp')", line="3", end_line="9", is_static="false",
        is_const="false", has_body="true", type_text="'void'", specifiers="array()",
    )
    roots = [_rows(spark, sf, "k = 0", symbol_id=f"'{i}'", name=f"'{n}'", kind="'class'", path="'engine.h'", line="1", end_line="2", specifiers="array()") for i, n in (("object", "UObject"), ("actor", "AActor"))]
    return reduce(DataFrame.unionByName, [types, fields, functions, bodies, *roots])


def tables(spark, sf) -> dict[str, DataFrame]:
    """The tables of all rules."""
    p = v.table(spark, sf, "part").selectExpr("p_partkey as k", "p_size as s", "concat('m/', p_partkey, '.h') as path", "concat('t', p_partkey) as t")
    li = v.table(spark, sf, "lineitem").selectExpr("concat('c/', l_orderkey) as path", "l_linenumber as line", "l_partkey as k", "l_suppkey as f", "l_returnflag as flag", "l_linestatus as status", "cast(l_quantity as int) % 3 as argc")
    generated = "case s % 3 when 0 then concat(k, '.generated.h') when 1 then 'wrong.generated.h' else 'Other.h' end"
    includes = p.selectExpr("path", f"inline(array(named_struct('line', 1, 'target_text', 'CoreMinimal.h'), named_struct('line', 3, 'target_text', {generated}), named_struct('line', if(s % 2 = 0, 4, 2), 'target_text', 'Last.h')))")
    above = p.selectExpr("t as type_id", "inline(array(named_struct('ancestor_id', concat('t', k + 1), 'depth', 1), named_struct('ancestor_id', if(k % 2 = 0, 'object', null), 'depth', 2), named_struct('ancestor_id', if(k % 4 = 0, 'actor', null), 'depth', 1)))").where("ancestor_id is not null")
    catalog = spark.createDataFrame(
        [("UPROPERTY", x, x == "ReplicatedUsing", ["VisibleAnywhere"] if x == "EditAnywhere" else []) for x in ("BlueprintReadWrite", "ReplicatedUsing", "EditAnywhere", "VisibleAnywhere")]
        + [("UFUNCTION", x, x == "WithValidation", []) for x in ("BlueprintPure", "BlueprintNativeEvent", "WithValidation")],
        "macro string, specifier string, needs_value boolean, conflicts_with array<string>",
    )
    use_kind = "case flag when 'A' then 'write' when 'N' then 'call' else 'read' end"
    uses = li.selectExpr(
        "path", "line", "0 as col", f"{use_kind} as use_kind", f"concat(if({use_kind} = 'call', 'g', 'f'), k) as symbol_id", "concat('t', k) as receiver_type", "status = 'O' as receiver_const", "concat('g', f) as in_function_id",
        "concat('OnRep_', line % 5) as name", "argc",
    )
    code = "concat('void f() {\\n  if (x ', if(s % 2 = 1, '=', '=='), ' ', s, ') { a = b; }\\n  if (y)', if(s % 3 = 0, ';', ' { z(); }'), '\\n  total = ', if(s % 5 = 0, 'total', 'other'), ';\\n  UE_LOG(LogTemp, Warning, TEXT(\"%d of %s (100%%)\"), n', if(s % 7 = 0, '', ', g(m, 2)'), ');\\n}\\n')"
    return {
        "symbols": symbols(spark, sf),
        "ancestors": above,
        "includes": includes,
        "macro_uses": p.where("s % 5 <> 0").selectExpr("path", "'GENERATED_BODY' as macro", "if(s % 5 = 1, 30, 11) as line"),
        "specifier_catalog": catalog,
        "delegates": p.selectExpr("concat('FDone', k % 4) as type_name", "k % 2 = 0 as is_dynamic").distinct(),
        "uses": uses,
        "members": p.where("k % 2 = 0").selectExpr("t as type_id", "concat('OnRep_', s % 3) as name"),
        "access_checks": li.selectExpr("path", "line", "case k % 3 when 0 then 'private' when 1 then 'protected' else 'public' end as access", "k % 3 = 2 or flag = 'A' as accessible"),
        "source_files": p.selectExpr("concat('m/', k, '.cpp') as path", f"{code} as content"),
    }


def _inspected(spark, sf, rule: str, *more: str) -> DataFrame:
    return inspections.RULES[rule](tables(spark, sf)).select("path", "line", "symbol", *more)


#: Parts as k and s, for the SQL below.
P = "p AS (SELECT p_partkey AS k, p_size AS s, 'm/' || p_partkey || '.h' AS path FROM part), c AS (SELECT *, 'm/' || k || '.cpp' AS file FROM p), o AS (SELECT 'OnRep_' || (k % 5) AS f, * FROM p)"
U = f"WITH {P}, u AS (SELECT 'c/' || l_orderkey AS path, l_linenumber AS line, l_partkey AS k, l_suppkey AS f, l_returnflag AS flag, l_linestatus = 'O' AS const, l_quantity::INT % 3 AS argc FROM lineitem)"
NAME = "substr('AUFEI', (k % 5 + 1)::INT, 1) || 'Thing' || k"


@query(f"WITH {P} SELECT path, 10 AS line, NULL::VARCHAR AS symbol, '#include \"' || k || '.generated.h\"' AS fix FROM p WHERE s % 4 < 3 AND s % 3 = 2")
def inspection_generated_missing(spark, sf) -> DataFrame:
    return _inspected(spark, sf, "generated_missing", "fix")


@query(f"WITH {P} SELECT path, 3 AS line, 'wrong.generated.h' AS symbol, k || '.generated.h' AS fix FROM p WHERE s % 3 = 1")
def inspection_generated_name(spark, sf) -> DataFrame:
    return _inspected(spark, sf, "generated_name", "fix")


@query(f"WITH {P} SELECT path, 10 AS line, {NAME} AS symbol FROM p WHERE s % 4 < 2 AND s % 5 < 2")
def inspection_generated_body(spark, sf) -> DataFrame:
    return _inspected(spark, sf, "generated_body")


@query(f"""WITH {P}, w AS (SELECT *, {NAME} AS symbol, CASE WHEN s % 4 = 1 THEN 'F' WHEN s % 4 = 2 THEN 'E' WHEN k % 4 = 0 THEN 'A' ELSE 'U' END AS want FROM p WHERE s % 4 < 3)
SELECT path, 10 AS line, symbol, want || substr(symbol, 2) AS fix FROM w WHERE substr(symbol, 1, 1) <> want""")
def inspection_prefix(spark, sf) -> DataFrame:
    return _inspected(spark, sf, "prefix", "fix")


@query(f"WITH {P} SELECT path, 12 AS line, 'p' || k AS symbol FROM p WHERE s % 12 = 0 AND s % 5 <> 0")
def inspection_private_exposed(spark, sf) -> DataFrame:
    return _inspected(spark, sf, "private_exposed")


@query(f"WITH {P} SELECT path, 12 AS line, 'p' || k AS symbol, 'EditAnywhere excludes VisibleAnywhere' AS message FROM p WHERE s % 4 = 3")
def inspection_conflicts(spark, sf) -> DataFrame:
    return _inspected(spark, sf, "conflicts", "message")


@query(f"WITH {P} SELECT path, 14 AS line, f AS symbol FROM o WHERE s % 3 = 0 AND k % 2 = 0")
def inspection_pure_without_output(spark, sf) -> DataFrame:
    return _inspected(spark, sf, "pure_without_output")


@query(f"WITH {P} SELECT path, 14 AS line, f AS symbol FROM o WHERE s % 5 < 3 AND s % 4 = 1")
def inspection_function_in_struct(spark, sf) -> DataFrame:
    return _inspected(spark, sf, "function_in_struct")


@query(f"""WITH {P} SELECT p.path, 12 AS line, 'p' || p.k AS symbol, 'OnRep_p' || p.k AS fix FROM p LEFT JOIN p q ON q.k = p.k + 1
WHERE p.s % 4 = 1 AND NOT (p.s % 5 < 3 AND p.k % 7 = p.k % 5) AND NOT coalesce(q.s % 5 < 3 AND p.k % 7 = q.k % 5, false)""")
def inspection_replicated_using(spark, sf) -> DataFrame:
    """Bases count: the next part is each part's base."""
    return _inspected(spark, sf, "replicated_using", "fix")


@query(f"""WITH {P}, w AS (SELECT *, unnest(CASE s % 3 WHEN 1 THEN ['_Implementation'] WHEN 2 THEN ['_Implementation', '_Validate'] ELSE [] END) AS e FROM o)
SELECT path, 14 AS line, f AS symbol, f || e || ' isn''t defined' AS message FROM w WHERE e = '_Validate' OR k % 2 = 1""")
def inspection_missing_definitions(spark, sf) -> DataFrame:
    return _inspected(spark, sf, "missing_definitions", "message")


@query(f"""WITH {P}, x AS (SELECT path, 12 AS line, 'p' || k AS symbol, s % 2 = 1 AS known, unnest(CASE s % 4 WHEN 0 THEN ['BlueprintReadWrite'] WHEN 1 THEN ['ReplicatedUsing'] WHEN 2 THEN ['BlueprintAssignable', 'EditAnywhere'] ELSE ['EditAnywhere', 'VisibleAnywhere'] END) AS w FROM p),
y AS (SELECT path, 14 AS line, f AS symbol, s % 5 < 3 AS known, unnest(CASE s % 3 WHEN 0 THEN ['BlueprintPure'] WHEN 1 THEN ['BlueprintNativeEvent'] ELSE ['Server', 'WithValidation'] END) AS w FROM o)
SELECT path, line, symbol, w || ' is unknown' AS message FROM (FROM x UNION ALL FROM y) WHERE NOT known OR w IN ('BlueprintAssignable', 'Server')
UNION ALL SELECT path, line, symbol, w || ' lacks its value' FROM y WHERE known AND w = 'WithValidation'""")
def inspection_specifiers(spark, sf) -> DataFrame:
    return _inspected(spark, sf, "specifiers", "message")


OBJECT_POINTER = "(k % 3 = 0 OR (k % 3 = 1 AND k % 5 = 1 AND k % 2 = 0))"


@query(f"WITH {P} SELECT path, 12 AS line, 'p' || k AS symbol, CASE k % 3 WHEN 0 THEN 'TObjectPtr<UObject>' ELSE 'TObjectPtr<UThing' || k || '>' END AS fix FROM p WHERE s % 2 = 1 AND {OBJECT_POINTER}")
def inspection_object_ptr(spark, sf) -> DataFrame:
    return _inspected(spark, sf, "object_ptr", "fix")


@query(f"WITH {P} SELECT path, 12 AS line, 'p' || k AS symbol FROM p WHERE s % 2 = 0 AND {OBJECT_POINTER}")
def inspection_untracked_pointer(spark, sf) -> DataFrame:
    return _inspected(spark, sf, "untracked_pointer")


@query(f"WITH {P} SELECT path, 12 AS line, 'p' || k AS symbol FROM p WHERE s % 4 = 2 AND k % 3 = 2 AND k % 2 = 1")
def inspection_assignable(spark, sf) -> DataFrame:
    return _inspected(spark, sf, "assignable")


@query(f"""{U} SELECT u.path, line, 'OnRep_' || (line % 5) AS symbol FROM u JOIN p ON p.k = u.k LEFT JOIN p w ON w.k = u.f
WHERE flag = 'A' AND (p.s % 13 = 0 OR const OR coalesce(w.s % 7 = 0 AND u.f = u.k, false))""")
def inspection_const_writes(spark, sf) -> DataFrame:
    return _inspected(spark, sf, "const_writes")


@query(f"{U} SELECT u.path, line, 'OnRep_' || (line % 5) AS symbol FROM u JOIN p ON p.k = u.k WHERE flag = 'N' AND const AND p.s % 7 <> 0 AND p.s % 11 <> 0")
def inspection_const_calls(spark, sf) -> DataFrame:
    return _inspected(spark, sf, "const_calls")


@query(f"{U} SELECT u.path, line, 'OnRep_' || (line % 5) AS symbol FROM u JOIN p ON p.k = u.k WHERE u.k % 2 = 0 AND line % 5 <> p.s % 3")
def inspection_unknown_member(spark, sf) -> DataFrame:
    return _inspected(spark, sf, "unknown_member")


@query(f"{U} SELECT u.path, line, 'OnRep_' || (line % 5) AS symbol FROM u JOIN p ON p.k = u.k WHERE flag = 'N' AND line % 5 = u.k % 5 AND NOT (argc = 1 OR (argc = 0 AND p.s % 2 = 0))")
def inspection_argument_count(spark, sf) -> DataFrame:
    return _inspected(spark, sf, "argument_count")


@query(f"{U} SELECT path, line, NULL::VARCHAR AS symbol, 'the member is ' || CASE k % 3 WHEN 0 THEN 'private' ELSE 'protected' END AS message FROM u WHERE k % 3 < 2 AND flag <> 'A'")
def inspection_access(spark, sf) -> DataFrame:
    return _inspected(spark, sf, "access", "message")


@query(f"WITH {P} SELECT file AS path, 2 AS line, NULL::VARCHAR AS symbol FROM c WHERE s % 2 = 1")
def inspection_assignment_in_condition(spark, sf) -> DataFrame:
    return _inspected(spark, sf, "assignment_in_condition")


@query(f"WITH {P} SELECT file AS path, 3 AS line, NULL::VARCHAR AS symbol FROM c WHERE s % 3 = 0")
def inspection_empty_statement(spark, sf) -> DataFrame:
    return _inspected(spark, sf, "empty_statement")


@query(f"WITH {P} SELECT file AS path, 4 AS line, NULL::VARCHAR AS symbol FROM c WHERE s % 5 = 0")
def inspection_self_assignment(spark, sf) -> DataFrame:
    return _inspected(spark, sf, "self_assignment")


@query(f"WITH {P} SELECT file AS path, 5 AS line, NULL::VARCHAR AS symbol FROM c WHERE s % 7 = 0")
def inspection_format_arguments(spark, sf) -> DataFrame:
    return _inspected(spark, sf, "format_arguments")
