"""Schemas of what is read: build databases, unit facts, frames."""

FACTS = (
    "unit string, "
    "records array<struct<usr:string, name:string, file:string, decl_file:string, line0:int, is_static:boolean>>, "
    "edges array<struct<usr:string, callee:string>>, "
    "indirect_sites array<struct<caller_usr:string, line:int, via:string, targets:array<string>, extra_candidates:array<string>, via_param:int, caller_name:string>>, "
    "arg_funcs array<struct<callee:string, idx:int, funcs:array<string>>>, "
    "param_fwd array<struct<callee:string, idx:int, src:string, src_idx:int>>, "
    "includes array<string>"
)
FRAMES = "func string, bytes long, qualifier string, file string, line int"
BUILD_DB = "directory string, file string, command string, arguments array<string>"
