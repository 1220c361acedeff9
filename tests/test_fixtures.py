"""Hand-made rows: worked examples and edge cases of the core operators."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.functions import text as fn
from corvane.operators import cycles, extract, hierarchy, inspections, logs, postings, resolve, scans, search, updates, usages
from corvane.sources import readers
from corvane.streaming import generations, jobs

HEADER = '''#pragma once
#include "CoreMinimal.h"
#include "GameFramework/Actor.h" // base
/* block "comment"
 UCLASS() */
#include "Menu.generated.h"

namespace ESearchCase { enum Type { CaseSensitive, IgnoreCase }; }
DECLARE_DYNAMIC_MULTICAST_DELEGATE_OneParam(FOnScoreChangedSignature, int32, Score);
DECLARE_DYNAMIC_DELEGATE_OneParam(FBad, int32);
DECLARE_DELEGATE_OneParam(FMap, TMap<int32, FString>);

UCLASS(Blueprintable, meta = (DisplayName = "A, (B)", ToolTip="x"))
class GAME_API AHero : public AActor, public IThing
{
	GENERATED_BODY()
public:
	UPROPERTY(EditAnywhere, BlueprintReadWrite,
		Category = "Stats|Base", meta=(AllowPrivateAccess="true"))
	float Health = 100.f;
	UFUNCTION(BlueprintNativeEvent)
	void Fire(int32 Count, TMap<int32, FString> Names, bool bNow = false);
	virtual void BeginPlay() override;
private:
	TObjectPtr<UMesh> Mesh;
	UMesh* Raw;
};
'''


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def one(spark, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema)


def test_names(spark):
    row = lambda c, v: one(spark, v).select(c).first()[0]
    assert row(fn.initials("x"), "GetActorLocation") == "GAL"
    assert row(fn.subsequence("x", "shchar"), "ShooterCharacter") and row(fn.typo("x", "charcter"), "Shooter character")
    assert row(fn.pointee_type("x"), "TObjectPtr<UMyComponent>") == "UMyComponent" and row(fn.pointee_type("x"), "const UMesh *") == "UMesh" and row(fn.pointee_type("x"), "int32") is None
    assert row(fn.include_text("x"), "/e/Engine/Classes/GameFramework/Actor.h") == "GameFramework/Actor.h"
    assert row(fn.include_text("x", F.lit("/p/a")), "/p/a/b/c.h") == "b/c.h" and row(fn.include_text("x", F.lit("/q")), "/p/c.h") == "/p/c.h"
    assert [row(fn.prefix_kind("x"), n) for n in ("AActor", "FVector", "EMode", "IThing", "actor")] == ["object", "value", "enum", "interface", "unknown"]
    assert row(fn.format_arity("x"), "%d %% %s") == 2
    assert one(spark, ["Widget QuitButton", "ButtonText"], "x array<string>").select(fn.breadcrumb("x")).first()[0] == "Widget QuitButton › ButtonText"


def test_header_extraction(spark):
    f = frame(spark, "path string, content string", ("a/Menu.h", HEADER), ("empty.h", ""), ("odd.h", 'x = "un/*closed\n// UCLASS(\n'))
    got = {(r.line, r.macro): r for r in extract.extract_reflection(f).collect()}
    assert set(got) == {(13, "UCLASS"), (18, "UPROPERTY"), (21, "UFUNCTION")}
    assert got[13, "UCLASS"].meta == {"DisplayName": "A, (B)", "ToolTip": "x"} and got[13, "UCLASS"].specifiers == ["Blueprintable"]
    assert got[18, "UPROPERTY"].specifiers == ["EditAnywhere", "BlueprintReadWrite", 'Category = "Stats|Base"']
    assert [(r.line, r.target_text) for r in extract.extract_includes(f).orderBy("line").collect()] == [(2, "CoreMinimal.h"), (3, "GameFramework/Actor.h"), (6, "Menu.generated.h")]
    d = {r.name: r for r in extract.extract_declarations(f).where("path = 'a/Menu.h'").collect()}
    assert d["ESearchCase"].kind == "enum" and d["AHero"].bases == ["AActor", "IThing"]
    assert (d["Health"].kind, d["Health"].container, d["Health"].type_text) == ("field", "AHero", "float")
    assert [tuple(p) for p in d["Fire"].params] == [("int32", "Count", False), ("TMap<int32, FString>", "Names", False), ("bool", "bNow", True)]
    assert d["BeginPlay"].is_virtual and d["BeginPlay"].is_override and not d["Fire"].is_virtual
    e = {r.type_name: r.errors for r in extract.extract_delegates(f).collect()}
    assert e == {"FOnScoreChangedSignature": [], "FBad": ["parameter name missing"], "FMap": ["comma in a type"]}


def test_tokens(spark):
    f = frame(spark, "path string, content string", ("a.h", '/// doc\n#include <x>\nUCLASS()\nint AFoo = 12; // "c"\nFBar s = "a // b";'))
    kinds = {(r.token, r.kind) for r in extract.tokenize(f).collect()}
    assert {("/// doc", "doc comment"), ("#include", "directive"), ("UCLASS", "reflection macro"), ("int", "keyword"), ("12", "number"), ('// "c"', "comment"), ('"a // b"', "string"), ("AFoo", "identifier")} <= kinds
    symbols = frame(spark, "name string, kind string", ("AFoo", "class"))
    got = {r.token: r["class"] for r in extract.classify_tokens(extract.tokenize(f), symbols).collect()}
    assert got["AFoo"] == "class" and got["FBar"] == "value"


def test_generated_names_and_definitions(spark):
    m = frame(spark, "path string, line int, macro string, args array<string>", ("a.h", 3, "ATTRIBUTE_ACCESSORS", ["UMyAttributeSet", "Health"]))
    assert [r.name for r in extract.expand_generated_names(m).collect()] == ["GetHealth", "SetHealth", "InitHealth", "GetHealthAttribute"]
    p = frame(spark, "path string", ("M\\Public\\Ui\\Menu.h",), ("M/Private/Ui/Menu.cpp",), ("M/Private/Other.cpp",))
    assert [tuple(r) for r in extract.pair_header_source(p).collect()] == [("M\\Public\\Ui\\Menu.h", "M/Private/Ui/Menu.cpp")]


EDGES = [("ACharacter", "APawn"), ("APawn", "AActor"), ("AActor", "UObject"), ("AMyCharacter", "ACharacter"), ("AMyCharacter", "IMyInterface"), ("AX", "AY"), ("AY", "AX"), ("AD", "AB"), ("AD", "AC"), ("AB", "AA"), ("AC", "AA"), (None, "AA"), ("AD", "AB")]


def test_ancestors(spark):
    inherits = frame(spark, "child_id string, parent_id string", *EDGES)
    anc = hierarchy.ancestors(inherits)
    up = {}
    for r in anc.orderBy("depth", "ancestor_id").collect():
        up.setdefault(r.type_id, []).append(r.ancestor_id)
    assert up["ACharacter"] == ["APawn", "AActor", "UObject"] and up["AD"] == ["AB", "AC", "AA"] and up["AX"] == ["AY"]
    tree = {r.type_id: (r.depth, r.path) for r in hierarchy.descendants(anc, inherits, "AA").collect()}
    assert tree == {"AB": (1, ["AA", "AB"]), "AC": (1, ["AA", "AC"]), "AD": (2, ["AA", "AB", "AD"])}
    assert hierarchy.ancestors(inherits.where("false")).count() == 0


def test_closure_of_random_graphs(spark):
    draw = random.Random(9)
    for n in (5, 12):
        edges = {(draw.randrange(n), draw.randrange(n)) for _ in range(2 * n)}
        reach = {}
        for s in range(n):
            seen, now, depth = {}, {s}, 0
            while now:
                depth += 1
                now = {b for a, b in edges if a in now} - set(seen)
                seen |= dict.fromkeys(now, depth)
            reach |= {(s, t): d for t, d in seen.items()}
        got = {(r.a, r.b): r.depth for r in hierarchy.closure(frame(spark, "a int, b int", *edges), "a", "b", loops=True).collect()}
        assert got == reach


def test_via(spark):
    anc = hierarchy.ancestors(frame(spark, "child_id string, parent_id string", *EDGES))
    assets = frame(spark, "asset_path string, parent_path string", ("BP_Base", "AMyCharacter"), ("BP_Hero", "BP_Base"), ("BP_None", "Gone"))
    got = {(r.type_id, r.asset_path): (r.via, r.via_kind) for r in hierarchy.derived_assets(assets, anc).collect()}
    assert got["AMyCharacter", "BP_Hero"] == ("BP_Base", "asset") and got["ACharacter", "BP_Base"] == ("AMyCharacter", "type") and got["AMyCharacter", "BP_Base"] == (None, None)


def test_redirects_and_aliases(spark):
    r = frame(spark, "old_name string, new_name string", ("A", "B"), ("B", "C"), ("X", "Y"), ("Y", "X"), ("S", "S"))
    refs = frame(spark, "target_id string, n int", ("A", 1), ("B", 2), ("X", 3), ("Q", 4), (None, 5))
    assert {x.n: x.target_id for x in resolve.apply_redirects(refs, r, "target_id").collect()} == {1: "C", 2: "C", 3: "X", 4: "Q", 5: None}
    symbols = frame(spark, "module string, name string", ("New", "AMyCharacter"), ("New", "AThing"), ("Other", "AThing"))
    lost = frame(spark, "target_module string, target_name string", ("OldModule", "AMyCharacter"), ("OldModule", "AThing"), ("New", "AGone"))
    assert [tuple(x) for x in resolve.detect_module_aliases(lost, symbols).collect()] == [("OldModule", "New", 2)]


def test_a_chain_of_seventy(spark):
    steps = frame(spark, "path int, resolved_path int", *[(i, i + 1) for i in range(70)])
    got = {r.reached: r.depth for r in hierarchy.include_closure(steps, frame(spark, "path int", (0,))).collect()}
    assert got == {t: t for t in range(1, 71)}


def test_long_redirects(spark):
    r = frame(spark, "old_name int, new_name int", *[(i, i + 1) for i in range(100)], *[(200 + i, 201 + i) for i in range(30)], (230, 220))
    assert {x.old_name: x.new_name for x in resolve.closed_redirects(r).collect()} == dict.fromkeys(range(100), 100)
    assert resolve.closed_redirects(r.where("false")).count() == 0


def test_nearest_folder_and_scope(spark):
    files = frame(spark, "path string", ("/p/Source/Game/Ui/a.h",), ("/p/Source/Game/b.h",), ("/q/c.h",))
    modules = frame(spark, "dir string, module string", ("/p/Source/Game", "Game"), ("/p/Source/Game/Ui/", "Ui"))
    assert {r.path: r.module for r in resolve.assign_module(files, modules).collect()} == {"/p/Source/Game/Ui/a.h": "Ui", "/p/Source/Game/b.h": "Game", "/q/c.h": None}
    scopes = frame(spark, "path string, line int, end_line int, scope_id string", ("f", 1, 900, "class"), ("f", 10, 700, "function"), ("g", 1, 5, "other"))
    points = frame(spark, "point_id int, path string, line int", (1, "f", 5), (2, "f", 300), (3, "f", 800), (4, "f", 1000), (5, "g", 5))
    assert {r.point_id: r.scope_id for r in resolve.enclosing_scope(points, scopes).collect()} == {1: "class", 2: "function", 3: "class", 5: "other"}


def test_search(spark):
    t = frame(spark, "asset_path string, asset_kind string, breadcrumb array<string>, text string, is_name boolean, is_editor_cache boolean", ("a", "bp", ["EventGraph", "Call PrintString", "pin In String"], "Hello you", False, False), ("b", "texture", [], "hello", False, False), ("c", "bp", [], "hello", True, False), ("d", "bp", [], "hello", False, True), ("e", "bp", [], None, False, False), ("f", "bp", [], "Othello", False, False))
    find = lambda q, **k: {r.asset_path for r in search.search_text(search.scope_texts(t), q, **k).collect()}
    assert find("hello") == {"a", "f"} and find("hello", whole_word=True) == {"a"} and find("hello", match_case=True) == {"f"} and find("a.b|[") == set()
    assert {r.asset_path for r in search.search_text(search.scope_texts(t, True, True, True), "hello").collect()} == {"a", "b", "c", "d", "f"}
    assert search.search_text(t, "hello").where("asset_path = 'a'").first().place == "EventGraph › Call PrintString › pin In String"
    with pytest.raises(ValueError):
        search.search_text(t, "h")
    s = frame(spark, "symbol_id int, name string", (1, "GetActorLocation"), (2, "ShooterCharacter"), (3, "ShooterGame"), (4, "Tick"))
    q = frame(spark, "query_id int, query string", (1, "GAL"), (2, "shooter char"), (3, "shchar"), (4, "charcter"))
    got = {}
    for r in search.search_symbols(s, q).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.symbol_id)
    assert got[1][0] == 1 and got[2][:2] == [2, 3] and 2 in got[3]
    assert {r.query_id for r in search.search_symbols(s, q, fuzzy=False).collect()} == {2}


def test_container_queries(spark):
    s = frame(spark, "name string, kind string, container string", ("Bar", "function", "AFoo"), ("Bar", "function", "ABaz"), ("Delta", "local", "Tick"), ("i", "local", "Tick"))
    find = lambda q: sorted((r.container, r.name) for r in search.scoped_symbols(s, q).collect())
    assert find("AFoo::Bar") == [("AFoo", "Bar")] and find("Tick::") == [("Tick", "Delta"), ("Tick", "i")] and find("bar") == [("ABaz", "Bar"), ("AFoo", "Bar")]
    assert search.symbol_filter(s, ["local"]).count() == 2


def test_asset_facts(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"asset_path": "BP", "asset_kind": "bp", "refs": [{"ref_kind": "call", "target_name": "f"}], "texts": [{"text": "t", "breadcrumb": ["A", "B"]}]}\n{"asset_path": "N"}\n')
    refs, texts = readers.read_asset_facts(spark, f"file://{tmp_path}/a.json")
    assert [(r.asset_path, r.target_name) for r in refs.collect()] == [("BP", "f")] and [(r.asset_path, r.breadcrumb) for r in texts.collect()] == [("BP", ["A", "B"])]


def test_logs(spark):
    t0 = dt.datetime(2024, 1, 1)
    beats, at = [(1, t0)], t0
    for gap in (0.9, 1.0, 1.1, 6, 20, 61, 301):
        at += dt.timedelta(seconds=gap)
        beats.append((1, at))
    b = frame(spark, "session long, ts timestamp", *beats)
    h = logs.detect_hangs(b)
    assert sorted(r.seconds for r in h.collect()) == [1.1, 6, 20, 61, 301]
    assert sorted((r.seconds, r.report_at) for r in logs.hang_reports(h).collect()) == [(6, 5), (20, 5), (20, 15), (61, 5), (61, 15), (61, 60), (301, 5), (301, 15), (301, 60), (301, 300)]
    gb = 1 << 30
    m = frame(spark, "session long, ts timestamp, bytes long", *[(1, t0 + dt.timedelta(seconds=i), int(x * gb)) for i, x in enumerate((1, 1.4, 1.8, 2.2, 2.6, 1.0))])
    assert [r.bytes / gb for r in logs.memory_steps(m).orderBy("ts").collect()] == [1, int(2.2 * gb) / gb, 1]
    ops = frame(spark, "session long, ms long", (1, 299), (1, 300))
    assert logs.log_summary(ops, h).first().n_slow == 1
    w = frame(spark, "waiter string, holder string", ("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("y", "z"))
    assert {r.thread: r.cycle_length for r in hierarchy.wait_cycles(w).collect()} == {"a": 3, "b": 3, "c": 3}
    s = frame(spark, "session_date string, session_time string, pid int", *[(f"2024-01-0{i}", "10-00-00", i) for i in range(1, 8)])
    assert sorted(r.pid for r in logs.retain_sessions(s).collect()) == [3, 4, 5, 6, 7]


def test_readers(spark, tmp_path):
    (tmp_path / "Public").mkdir()
    (tmp_path / "Public" / "a b.h").write_text("// é\nint x;\n")
    (tmp_path / "b.cpp").write_text("")
    (tmp_path / "c.uasset").write_bytes(b"12345")
    (tmp_path / "Game.Build.cs").write_text('PublicDependencyModuleNames.AddRange(new string[] { "Core", "Engine" });\nPrivateDependencyModuleNames.Add("UMG");')
    (tmp_path / "Game.uproject").write_text('{"EngineAssociation": "5.4", "Plugins": [{"Name": "P", "Enabled": true}, {"Name": "Q", "Enabled": false}], "AdditionalPluginDirectories": ["../More"]}')
    (tmp_path / "d.ini").write_text('a=1\r\n[CoreRedirects]\r\n+ClassRedirects=(OldName="/Script/Old.A",NewName="/Script/New.A")\n;x=2\n[Engine]\n+ActiveClassRedirects=(OldClassName="B",NewClassName="C")\n')
    (tmp_path / "compile.json").write_text('[{"file": "x.cpp", "directory": "/d", "command": "cl /I\\"a b\\" -Ic -DX=1 /DY x.cpp"}]')
    (tmp_path / "Session_2024-01-02_10-11-12_pid42.log").write_text("2024-01-02T10:11:13 [index] memory: heap=5\nplain\n")
    root = f"file://{tmp_path}"
    src = {r.path.rsplit("/", 1)[1]: r for r in readers.read_sources(spark, [("project", root)]).collect()}
    assert src["a b.h"].kind == "header" and src["a b.h"].content == "// é\nint x;\n" and src["Game.Build.cs"].kind == "build"
    assert readers.list_assets(spark, [root]).first()["size"] == 5
    assert readers.read_modules(spark, [root]).first().deps == ["Core", "Engine", "UMG"]
    p = readers.read_uprojects(spark, root).first()
    assert p.enabled_plugins == ["P"] and p.project == "Game" and p.engine_association == "5.4"
    assert {r.root.rsplit("/", 1)[1] for r in usages.plugin_roots(readers.read_uprojects(spark, root)).collect()} == {"Plugins", "More"}
    ini = readers.read_ini(spark, root)
    assert {(r.section, r.key) for r in ini.collect()} == {(None, "a"), ("CoreRedirects", "ClassRedirects"), ("Engine", "ActiveClassRedirects")}
    assert {(r.old_name, r.new_name) for r in readers.extract_redirects(ini).collect()} == {("/Script/Old.A", "/Script/New.A"), ("B", "C")}
    c = readers.read_compile_db(spark, f"{root}/compile.json").first()
    assert c.include_paths == ["a b", "c"] and c.definitions == ["X=1", "Y"]
    log = readers.read_logs(spark, root).orderBy("n").collect()
    assert (log[0].pid, log[0].category, log[1].message, log[1].ts) == (42, "index", "plain", None)
    listed = frame(spark, "path string", ("x",), ("y",))
    assert [r.path for r in readers.unreadable(listed, listed.where("path = 'x'")).collect()] == ["y"]
    df = frame(spark, "project string, n int", ("p", 1), ("q", 2))
    updates.write_index(df, f"{root}/index")
    updates.write_index(df.where("project = 'q'").withColumn("n", F.lit(3)), f"{root}/index")
    assert {r.project: r.n for r in updates.read_index(spark, f"{root}/index").collect()} == {"p": 1, "q": 3}


S = "symbol_id string, name string, kind string, container_id string, path string, line int, end_line int, access string, is_static boolean, is_const boolean, has_body boolean, is_pure boolean, type_text string, params array<struct<type:string,name:string,has_default:boolean>>, macro string, specifiers array<string>, meta map<string,string>"


def symbol(i, name, **k):
    base = {"symbol_id": i, "name": name, "kind": "field", "container_id": "C", "path": "C.h", "line": 1, "end_line": 1, "access": "public", "is_static": False, "is_const": False, "has_body": False, "is_pure": False, "type_text": "", "params": None, "macro": None, "specifiers": [], "meta": {}} | k
    return tuple(base[c.split()[0]] for c in ("symbol_id _,name _,kind _,container_id _,path _,line _,end_line _,access _,is_static _,is_const _,has_body _,is_pure _,type_text _,params _,macro _,specifiers _,meta _").split(","))


def test_inspections(spark):
    s = frame(spark, S,
        symbol("O", "UObject", kind="class"), symbol("A", "AActor", kind="class", macro="UCLASS", end_line=9), symbol("C", "AThing", kind="class", macro="UCLASS", end_line=50), symbol("U", "UThing", kind="class", macro="UCLASS", path="U.h", end_line=50), symbol("S", "Data", kind="struct", macro="USTRUCT", path="S.h", end_line=20),
        symbol("p1", "Secret", access="private", macro="UPROPERTY", specifiers=["BlueprintReadWrite"]), symbol("p2", "Open", access="private", macro="UPROPERTY", specifiers=["BlueprintReadWrite"], meta={"AllowPrivateAccess": "true"}),
        symbol("p3", "Rep", macro="UPROPERTY", specifiers=["ReplicatedUsing = OnRep_Gone", "Replicated"]), symbol("p4", "Raw", macro="UPROPERTY", type_text="UThing*"), symbol("p5", "Lost", type_text="UThing*"), symbol("p6", "OnX", macro="UPROPERTY", specifiers=["BlueprintAssignable"], type_text="FOnX"),
        symbol("f1", "Pure", kind="function", macro="UFUNCTION", specifiers=["BlueprintPure"], type_text="void", params=[]), symbol("f2", "InStruct", kind="function", container_id="S", macro="UFUNCTION"), symbol("f3", "Event", kind="function", macro="UFUNCTION", specifiers=["BlueprintNativeEvent"], type_text="void"),
        symbol("f4", "Two", kind="function", params=[("int", "a", False), ("int", "b", True)], is_const=True),
    )
    inherits = frame(spark, "child_id string, parent_id string", ("C", "A"), ("A", "O"), ("U", "A"))
    uses = frame(spark, "path string, line int, name string, symbol_id string, receiver_type string, receiver_const boolean, use_kind string, argc int, in_function_id string",
        ("x.cpp", 1, "Two", "f4", "C", False, "call", 3, None), ("x.cpp", 2, "Two", "f4", "C", False, "call", 1, None), ("x.cpp", 3, "Nope", None, "C", False, "read", None, None), ("x.cpp", 4, "Nope", None, None, False, "read", None, None), ("x.cpp", 5, "Secret", "p1", "C", True, "write", None, None), ("x.cpp", 6, "Event", "f3", "C", True, "call", 0, None), ("x.cpp", 7, "Secret", "p1", "C", False, "write", None, "f4"))
    code = 'void f() {\n if (A = B) g();\n if (A == B) g();\n for (;;);\n X = X;\n Y = X;\n do {} while (x);\n UE_LOG(L, Warning, TEXT("%d %s"), A);\n FString::Printf(TEXT("%d%%"), f(1, 2));\n // if (A = B)\n s = "if (A = B)";\n}'
    t = {
        "symbols": s, "ancestors": hierarchy.ancestors(inherits), "uses": uses, "source_files": frame(spark, "path string, content string", ("x.cpp", code)),
        "includes": frame(spark, "path string, line int, target_text string", ("C.h", 1, "C.generated.h"), ("C.h", 2, "Other.h"), ("S.h", 1, "T.generated.h")),
        "macro_uses": frame(spark, "path string, line int, macro string", ("C.h", 3, "GENERATED_BODY"), ("U.h", 90, "GENERATED_BODY")),
        "specifier_catalog": frame(spark, "macro string, specifier string, needs_value boolean, conflicts_with array<string>", ("UPROPERTY", "BlueprintReadWrite", False, ["BlueprintReadOnly"]), ("UPROPERTY", "Replicated", False, ["ReplicatedUsing"]), ("UPROPERTY", "ReplicatedUsing", True, []), ("UFUNCTION", "BlueprintPure", True, []), ("UFUNCTION", "BlueprintNativeEvent", False, [])),
        "delegates": frame(spark, "type_name string, is_dynamic boolean", ("FOnX", False)), "members": frame(spark, "type_id string, name string", ("C", "Two"), ("C", "Secret"), ("C", "Event")),
    }
    got = {}
    for r in inspections.inspect_all(t).collect():
        got.setdefault(r.rule, set()).add(r.symbol if r.symbol and r.path != "x.cpp" else r.line)
    assert got == {
        "generated_missing": {1}, "generated_not_last": {"C.generated.h"}, "generated_name": {"T.generated.h"}, "generated_body": {"UThing", "Data"}, "prefix": {"UThing", "Data"}, "private_exposed": {"Secret"}, "conflicts": {"Rep"}, "pure_without_output": {"Pure"}, "function_in_struct": {"InStruct"},
        "replicated_using": {"Rep"}, "replication_list": {"Rep"}, "missing_definitions": {"Event"}, "specifiers": {"OnX", "Pure"}, "object_ptr": {"Raw"}, "untracked_pointer": {"Lost"}, "assignable": {"OnX"}, "const_writes": {5, 7}, "const_calls": {6}, "unknown_member": {3}, "argument_count": {1},
        "assignment_in_condition": {2}, "empty_statement": {4}, "self_assignment": {5}, "format_arguments": {8},
    }
    assert inspections.inspect_all(t, ["prefix"]).select("rule").distinct().count() == 1
    assert inspections.error_list(inspections.inspect_all(t, ["object_ptr"])).count() == 0


def test_diagnostics(spark):
    d = frame(spark, "path string, line int, code string, message string, token string", ("a", 1, "E1696", 'cannot open "CoreMinimal.h"', ""), ("a", 2, "E20", "x", "y"), ("a", 3, "E1696", 'cannot open "Gone.h"', ""), ("b", 1, "E20", "x", "UPROPERTY"), ("b", 2, "E20", "x", "Foo_Implementation"), ("b", 3, "E20", "x", "Bar_Implementation"), ("c", 1, "E20", "x", "UPROPERTY"))
    args = (frame(spark, "path string, target_text string", ("a", "CoreMinimal.h")), frame(spark, "path string", ("b",)), frame(spark, "name string", ("Foo",)))
    got = {(r.path, r.line) for r in inspections.filter_diagnostics(d, *args).collect()}
    assert got == {("a", 3), ("b", 3), ("c", 1)}
    assert inspections.filter_diagnostics(d, *args, mode="HideAll").count() == 0 and inspections.filter_diagnostics(d, *args, mode="ShowAll").count() == 7


def declarations(files):
    return files.select("path", F.explode(F.filter(F.split("content", "\n"), lambda x: x.startswith("int "))).alias("declaration"))


def test_incremental_index_equals_a_rebuild(spark, tmp_path):
    draw = random.Random(3)
    index, state = f"file://{tmp_path}/index", {}
    schema = "path string, content string, version long, deleted boolean"
    for step in range(4):
        batch = []
        for _ in range(6):
            path, version = f"f{draw.randint(0, 7)}", draw.randint(max(0, 3 * step - 4), 3 * step + 3) * 100 + len(batch)
            content = "\n".join(f"int x{draw.randint(0, 5)};" + " " * draw.randint(0, 3) for _ in range(draw.randint(0, 3)))
            batch.append((path, content, version, draw.random() < 0.2))
        jobs.update_index(frame(spark, schema, *batch), index, declarations, partitions=3)
        for path, content, version, deleted in sorted(batch, key=lambda r: r[2]):
            if version > state.get(path, (None, -1))[1]:
                state[path] = ("" if deleted else content, version)
        want = sorted((p, x) for p, (c, _) in state.items() for x in c.split("\n") if x.startswith("int "))
        assert sorted(tuple(r) for r in jobs.read_declarations(spark, index).select("path", "declaration").collect()) == want


VERSIONS = "path string, content string, version long, deleted boolean"


def test_a_failed_batch_leaves_the_index_as_it_was(spark, tmp_path, monkeypatch):
    """A failure at any write, then the same batch again: nothing is lost, and readers see the batch whole or not at all."""
    batches = [[(f"f{i}", f"int a{i};\nint b;", 1, False) for i in range(6)], [("f0", "int z;", 2, False), ("f1", "", 2, True), ("f2", "int a2;  \nint b;", 2, False), ("f9", "int n;", 2, False)]]
    told = lambda index: sorted(map(tuple, jobs.read_declarations(spark, index).select("path", "declaration").collect()))
    whole = f"file://{tmp_path}/whole"
    for batch in batches:
        jobs.update_index(frame(spark, VERSIONS, *batch), whole, declarations, partitions=3)
    writes = [(jobs, "saved", 0, False), (jobs, "saved", 1, True), (generations, "write_partitions", 0, True), (generations, "write_partitions", 1, False), (generations, "put_manifest", 0, False)]
    for place, name, at, late in writes:  # the write that fails, and whether it has written before
        index, calls = f"file://{tmp_path}/{name}-{at}", []
        jobs.update_index(frame(spark, VERSIONS, *batches[0]), index, declarations, partitions=3)
        before, real = told(index), getattr(place, name)

        def fails(*a, at=at, late=late, real=real, calls=calls):
            calls.append(1)
            out = real(*a) if late or len(calls) <= at else None
            if len(calls) > at:
                raise OSError("lost")
            return out

        with monkeypatch.context() as m:
            m.setattr(place, name, fails)
            with pytest.raises(OSError):
                jobs.update_index(frame(spark, VERSIONS, *batches[1]), index, declarations, partitions=3)
        assert told(index) == before
        for _ in range(2):
            jobs.update_index(frame(spark, VERSIONS, *batches[1]), index, declarations, partitions=3)
            assert told(index) == told(whole)
    assert told(whole) == [("f0", "int z;"), ("f2", "int a2;  "), ("f2", "int b;")] + sorted((f"f{i}", x) for i in (3, 4, 5) for x in (f"int a{i};", "int b;")) + [("f9", "int n;")]
    assert generations.vacuum(spark, whole, keep=1) >= 1 and generations.vacuum(spark, whole, keep=1) == 0
    assert len(told(whole)) == 10


def test_live_hangs_equal_the_batch(spark, tmp_path):
    """Frames of 20 rows, beats in any order, over several batches: hangs and reports are those of the batch operators, with what goes on at the end."""
    draw, t0 = random.Random(5), dt.datetime(2024, 1, 1)
    beats = []
    for session in range(6):
        at = t0
        for _ in range(draw.choice((1, 30, 200))):
            at += dt.timedelta(seconds=draw.choice((0.2, 0.5, 1.0, 1.000001, 1.4, 5, 5.3, 16, 70, 301.5)))
            beats.append((session, at))
    end = max(t for _, t in beats) + dt.timedelta(seconds=100)
    beats += [(99, end), (None, t0)]
    beats += draw.sample(beats, 20)  # some come twice
    order = sorted(beats, key=lambda b: b[1] + dt.timedelta(seconds=draw.random() * 50))  # late by less than a minute
    size = len(order) // 3 + 1
    for i in range(3):
        frame(spark, "session long, ts timestamp", *order[i * size : (i + 1) * size]).coalesce(1).write.parquet(f"file://{tmp_path}/in/{i}")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, "20")
    try:
        stream = spark.readStream.schema("session long, ts timestamp").option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"file://{tmp_path}/in/*")
        got = jobs.finished(jobs.stream_hangs(stream, late="60 seconds"), "append").collect()
    finally:
        spark.conf.set(key, was)
    seen = end - dt.timedelta(seconds=60)  # the last watermark
    all_ = frame(spark, "session long, ts timestamp", *{b for b in beats if b[1] <= seen})
    assert sorted(str((r.session, r.ts, r.seconds)) for r in got if r.report_at is None) == sorted(str((r.session, r.ts, r.seconds)) for r in logs.detect_hangs(all_).collect())
    last = all_.groupBy("session").agg(F.max("ts").alias("ts")).withColumn("ts", F.lit(seen)).select("session", "ts")
    reports = logs.hang_reports(logs.detect_hangs(all_.unionByName(last).distinct())).collect()
    assert sorted(str((r.session, r.ts, r.report_at)) for r in got if r.report_at is not None) == sorted(str((r.session, r.ts, r.report_at)) for r in reports)


def test_index_stream(spark, tmp_path):
    schema = "path string, content string, version long, deleted boolean"
    frame(spark, schema, ("a", "int x;", 1, False), ("b", "int y;\nint z;", 1, False), ("a", "int w;", 2, False)).write.parquet(f"file://{tmp_path}/in/0")
    stream = spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in/*")
    jobs.stream_index(stream, f"file://{tmp_path}/index", declarations, f"file://{tmp_path}/cp").awaitTermination()
    assert sorted(tuple(r) for r in jobs.read_declarations(spark, f"file://{tmp_path}/index").select("path", "declaration").collect()) == [("a", "int w;"), ("b", "int y;"), ("b", "int z;")]


def test_updates(spark):
    a = frame(spark, "path string, declaration string", ("f", "int x"), ("f", "int y"))
    b = frame(spark, "path string, declaration string", ("f", "int y"), ("f", "int x"))
    assert updates.declaration_fingerprints(a).collect() == updates.declaration_fingerprints(b).collect()
    v = frame(spark, "path string, version long, content string", ("f", 2, "new"), ("f", 1, "old"))
    assert updates.latest_versions(v).first().content == "new"


def test_parentheses_of_any_depth(spark):
    deep = lambda n: "(" * n + 'x, ")"' + ")" * n
    for n in (8, 300, 100_000):
        code = f"UFUNCTION(Category = F{deep(n)}, Exec)\nvoid A();\nDECLARE_DELEGATE_OneParam(FOne, decltype{deep(n)});\nvoid G(int32 A = F{deep(n)}, bool B);\n"
        files = frame(spark, "path string, content string", ("a.h", code))
        got = extract.extract_reflection(files).first()
        assert list(got.specifiers) == [f"Category = F{deep(n)}", "Exec"] and got.declaration == "void A()"
        d = extract.extract_delegates(files).first()
        assert list(d.params) == [f"decltype{deep(n)}"] and not d.errors
        assert len(extract.extract_declarations(files).where("name = 'G'").first().params) == 2


def test_conditions_over_several_lines(spark):
    code = "void f() {\nif (a\n  = b) { c; }\nif (a ==\n b) d();\nfor (int i = 0;\n i < g(h(1), (2));\n ++i)\n ;\ndo { x(); } while (y);\nwhile (z)\n;\nq.r =\n q.r;\n// if (a = b) ;\n}"
    t = {"source_files": frame(spark, "path string, content string", ("a.cpp", code))}
    line = lambda rule: [r.line for r in inspections.RULES[rule](t).orderBy("line").collect()]
    assert line("assignment_in_condition") == [2] and line("empty_statement") == [6, 11] and line("self_assignment") == [13]


def test_blocked_search_equals_all_pairs(spark):
    draw = random.Random(11)
    part = lambda: draw.choice(["Get", "Set", "shooter", "Actor", "location", "Widget", "x", "transformation", "é1"])
    names = frame(spark, "symbol_id long, name string", *[(i, draw.choice(["", " ", "_"]).join(part() for _ in range(draw.randint(1, 4)))) for i in range(120)], (500, ""), (501, None))
    asked = ["GA", "shter", "locatoin", "transfrmatin", "x", "é1", "getactor", "zz", "wdgt", "y", "xy", "sho", "Gt", "loc", "witget", "transphormatiom", "hooter", "Actor Set", "transformatoins"]
    queries = frame(spark, "query_id long, query string", *enumerate(asked))
    for fuzzy in (True, False):
        words = queries.select("query_id", F.explode(F.array_distinct(F.split("query", " "))).alias("word"))
        pairs = names.crossJoin(words).where(search.word_rank("name", F.col("word"), fuzzy).isNotNull())
        want = {(r.query_id, r.symbol_id): r.n for r in pairs.groupBy("query_id", "symbol_id").agg(F.count("*").alias("n")).collect()}
        got = search.search_symbols(names, queries, 1000, fuzzy)
        assert {(r.query_id, r.symbol_id): r.n_words for r in got.collect()} == want and want
        assert "NestedLoop" not in got._jdf.queryExecution().toString()
    texts = names.select("symbol_id", F.col("name").alias("text"))
    for case, word in ((False, False), (True, False), (False, True)):
        got = search.search_text(texts, queries, case, word)
        want = texts.crossJoin(queries).where("length(query) >= 2").where(search.matches("text", F.col("query"), case, word))
        assert sorted(map(tuple, got.select("symbol_id", "query_id").collect())) == sorted(map(tuple, want.select("symbol_id", "query_id").collect()))
        assert "NestedLoop" not in got._jdf.queryExecution().toString()


def test_long_arguments(spark):
    """Values of a megabyte, long literals with many escapes, long directives, and many parameters."""
    raw, text = "x" * 1_000_000, '"' + "\\n,)" * 200_000 + '"'
    params = ", ".join(f"TMap<int32, FString> P{i}" for i in range(2_000))
    code = f"#define X {'a ' * 50_000}\nUPROPERTY(Category = {raw}, meta = (ToolTip = {text}, Key))\nint32 A;\nvoid Many({params});\nUFUNCTION()\nvoid B() {{ UE_LOG(L, Warning, TEXT({text}), {raw}); UE_LOG(L, Warning, TEXT(\"%s\"), F({text}), 2); }}\n"
    files = frame(spark, "path string, content string", ("a.h", code))
    got = {r.macro: r for r in extract.extract_reflection(files).collect()}
    assert list(got["UPROPERTY"].specifiers) == [f"Category = {raw}"] and got["UPROPERTY"].meta == {"ToolTip": text[1:-1], "Key": ""} and (got["UFUNCTION"].line, got["UFUNCTION"].declaration) == (5, "void B()")
    d = {r.name: r for r in extract.extract_declarations(files).collect()}
    assert d["A"].type_text == "int32" and [p.type for p in d["Many"].params] == ["TMap<int32, FString>"] * 2_000
    found = inspections.RULES["format_arguments"]({"source_files": files}).collect()
    assert [r.line for r in found] == [6, 6]


def test_templates_in_one_another(spark):
    deep = "TMap<TPair<int, TArray<TSet<TWeak<A, B>>>>, C>"
    code = f"class X {{\nvoid F({deep} A, int B = G(1 < 2, 3), char C = ',', char D = '(', int* E = P->Q(), {deep}& G = {{}});\nbool H(bool A = (x > y), TArray<int> B = {{1, 2}}) const;\n}};\n"
    got = {r.name: r for r in extract.extract_declarations(frame(spark, "path string, content string", ("a.h", code))).collect()}
    assert [(p.type, p.name) for p in got["F"].params] == [(deep, "A"), ("int", "B"), ("char", "C"), ("char", "D"), ("int*", "E"), (f"{deep}&", "G")]
    assert [p.name for p in got["H"].params] == ["A", "B"] and got["H"].is_const


def test_keys_of_a_name_grow_with_its_length(spark):
    draw = random.Random(2)
    made = lambda n: "".join(draw.choice("abcdefghijklmnopqrstuvwxyzABCXYZ_0123456789") for _ in range(n))
    names = frame(spark, "n int, name string", *[(n, made(n)) for n in (100, 300, 600, 1200)])
    keys = {r.n: r.k for r in names.select("n", F.size(search._name_keys("name", True)).alias("k")).collect()}
    assert all(k <= 4 * n + 38 * 38 for n, k in keys.items())


def test_listing_in_tasks(spark, tmp_path):
    """Folders in one another, names with blanks and signs, empty files, hidden names; an unknown store is an error."""
    made = ["a.uasset", "x/b c.umap", "x/y/%41+é.uasset", "x/y/z/empty.umap", "x/other.txt", "x/.hidden.umap", "_tmp/c.umap", "x/noumap"]
    for i, name in enumerate(made):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"1" * (0 if "empty" in name else i + 1))
    (tmp_path / "bare").mkdir()
    got = {r.asset_path: (r["size"], r.mtime is not None) for r in readers.list_assets(spark, [f"file://{tmp_path}"]).collect()}
    assert got == {f"file://{tmp_path}/{n}": (0 if "empty" in n else made.index(n) + 1, True) for n in made[:4]}
    assert readers.list_files(spark, [str(tmp_path / "x"), f"file:{tmp_path}/gone"]).count() == 5
    with pytest.raises(ValueError):
        readers.list_files(spark, ["viewfs://store/in"])


def test_postings_equal_a_scan(spark, tmp_path):
    """Built, updated, put in again, compacted and rebuilt: every time what a scan of the current texts finds."""
    draw = random.Random(6)
    index, state = f"file://{tmp_path}/postings", {}
    text = lambda: draw.choice([None, "", "x", "Ab", "aé漢 ", "\n"]) if draw.random() < 0.2 else " ".join(draw.choice(["Get", "set", "actor", "Ünï", "a.b", "x", "the", "ab"]) for _ in range(draw.randint(1, 6)))
    queries = frame(spark, "query_id int, query string", *enumerate(["get", "ab", "a.b", "x", "Actor s", "ünï", "é漢", "zz", "the the", "get", "t"]))
    schema = "text_id long, text string, version long, deleted boolean"

    def same():
        texts = frame(spark, "text_id long, text string", *[(i, t) for i, (t, _, gone) in state.items() if not gone])
        for case, word in ((False, False), (True, False), (False, True)):
            want = sorted(map(tuple, search.search_text(texts, queries, case, word).select("query_id", "text_id").collect()))
            assert sorted(map(tuple, postings.search_postings(spark, index, queries, case, word).select("query_id", "text_id").collect())) == want and want

    for step in range(2):
        batch = [(draw.randint(0, 30), text(), 100 * step + i + (0 if draw.random() < 0.8 else -150), draw.random() < 0.1) for i in range(25)]
        for _ in range(2):
            postings.update_postings(frame(spark, schema, *batch), index, partitions=3)
        for i, t, v, gone in sorted(batch, key=lambda r: r[2]):
            if v > state.get(i, (None, -1000, None))[1]:
                state[i] = (t, v, gone)
        same()
    postings.compact(spark, index)
    same()
    rebuilt = f"file://{tmp_path}/rebuilt"
    postings.update_postings(frame(spark, schema, *[(i, *x) for i, x in state.items()]), rebuilt, partitions=3)
    rows = lambda at: sorted(map(tuple, postings._all_grams(spark, at, generations.read_manifest(spark, at)).collect()))
    assert rows(index) == rows(rebuilt)


@pytest.mark.parametrize("size", [1, 7, 1 << 16])
def test_scans_equal_windows(spark, size):
    """Nulls as keys and values, ties of blocks, a key with most rows."""
    draw = random.Random(8)
    rows = [(draw.choice([1, 1, 1, 2, None]), i, draw.choice([None, i]), draw.choice([None, None, f"x{i}"])) for i in range(300)] + [(3, 5, None, None)]
    t = frame(spark, "k int, n int, a int, b string", *rows).repartition(3)
    got = scans.scan(t, ["k"], ["n"], scans.line_block("n", size), sums={"s": F.col("a")}, lasts={"l": F.col("b")}, nexts={"x": F.col("b"), "y": F.col("n")}, afters={"f": F.col("b")})
    w = Window.partitionBy("k").orderBy("n")
    upto, rest = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(1, Window.unboundedFollowing)
    want = t.select("k", "n", "a", "b", F.sum("a").over(upto).alias("s"), F.last("b", True).over(upto).alias("l"), F.lead("b").over(w).alias("x"), F.lead("n").over(w).alias("y"), F.first("b", True).over(rest).alias("f"))
    assert sorted(map(str, map(tuple, got.select(*want.columns).collect()))) == sorted(map(str, map(tuple, want.collect())))


def walked_cycles(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    found = {}
    for start in out:
        seen, now, n = set(), {start}, 0
        while now:
            n += 1
            now = {y for x in now for y in out.get(x, ())} - seen
            if start in now:
                found[start] = n
                break
            seen |= now
    return found


def test_cycles_of_random_graphs(spark):
    draw = random.Random(12)
    graphs = [{(draw.randrange(n), draw.randrange(n)) for _ in range(m)} for n, m in ((12, 14), (25, 40))]
    graphs.append({(i, draw.randrange(20)) for i in range(20)})  # one edge out each
    graphs.append({(1, 2), (2, 1), (2, 3), (3, 4), (4, 3), (4, 4), (5, 1), (4, 6)})  # cycles in a row, a loop
    edges = [(100 * g + a, 100 * g + b) for g, graph in enumerate(graphs) for a, b in graph]
    got = {r.thread: r.cycle_length for r in hierarchy.wait_cycles(frame(spark, "waiter int, holder int", *edges, edges[0], (None, 1), (1, None))).collect()}
    assert got == walked_cycles(edges)
    c = {}
    for r in cycles.strong_components(frame(spark, "u int, v int", *edges)).collect():
        c.setdefault(r.component, set()).add(r.node)
    reach = lambda a: {b for b in walk_from(edges, a)}
    nodes = {x for e in edges for x in e}
    far = {a: reach(a) for a in nodes}
    assert {frozenset(x) for x in c.values()} == {frozenset({a} | {b for b in far[a] if a in far[b]}) for a in nodes}


def walk_from(edges, start):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    seen, now = set(), {start}
    while now:
        now = {y for x in now for y in out.get(x, ())} - seen
        seen |= now
    return seen


def test_a_chain_into_a_cycle_costs_rows_in_proportion(spark, monkeypatch):
    rows = []

    def counted(df, name, real=cycles.saved):
        out = real(df, name)
        rows.append(out.count())
        return out

    monkeypatch.setattr(cycles, "saved", counted)
    n = 3000
    edges = [(i, i + 1) for i in range(n)] + [(n + i, n + (i + 1) % 700) for i in range(700)] + [(10_000 + i, i) for i in range(0, n, 3)] + [(n + 5, 20_000)]
    got = {r.thread: r.cycle_length for r in hierarchy.wait_cycles(frame(spark, "waiter int, holder int", *edges)).collect()}
    assert got == dict.fromkeys(range(n, n + 700), 700)
    assert sum(rows) < 6 * len(edges) * math.log2(len(edges)), (sum(rows), len(rows))  # doubling writes the pointers once a round
