"""Schemas of the core tables. `project` (and an engine version) may be a partition column of each on disk."""

from __future__ import annotations

PARAMS = "array<struct<type:string,name:string,has_default:boolean>>"

SCHEMAS = {
    "source_files": "project string, path string, scope string, module string, kind string, content string, content_hash string, mtime timestamp, version long",
    "modules": "project string, module string, dir string, plugin string, scope string, deps array<string>",
    "symbols": "symbol_id string, project string, name string, qualified_name string, kind string, container_id string, module string, path string, line int, end_line int, access string, is_static boolean, is_virtual boolean, is_override boolean, is_final boolean, is_pure boolean, is_const boolean, is_deprecated boolean, is_inline boolean, has_body boolean, type_text string, "
    + f"params {PARAMS}, macro string, specifiers array<string>, meta map<string,string>, friends array<string>, guard string",
    "inherits": "child_id string, parent_id string, ordinal int, is_interface boolean",
    "includes": "path string, line int, target_text string, resolved_path string",
    "uses": "path string, line int, col int, name string, symbol_id string, receiver_type string, receiver_const boolean, use_kind string, argc int, in_function_id string",
    "assets": "asset_path string, asset_kind string, parent_path string, size long, mtime timestamp",
    "asset_refs": "asset_path string, ref_kind string, target_path string, target_name string",
    "asset_texts": "asset_path string, asset_kind string, text_kind string, breadcrumb array<string>, text string, is_name boolean, is_editor_cache boolean, loc struct<namespace:string,key:string>",
    "redirects": "kind string, old_name string, new_name string, file string, line int",
    "compile_commands": "file string, directory string, include_paths array<string>, definitions array<string>",
    "specifier_catalog": "engine_version string, macro string, specifier string, needs_value boolean, conflicts_with array<string>, doc string",
    "diagnostics": "path string, line int, code string, message string, token string, source string, severity string",
    "log_lines": "session_date string, session_time string, pid int, n long, ts timestamp, category string, message string",
}
