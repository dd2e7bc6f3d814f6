"""Checks of generated Python: structure by the parser, and test execution in a separate interpreter.

Executing code is off unless a caller asks for it: it runs in its own process with ``-I``, no environment,
resource limits and a wall-clock limit. That is no security boundary for hostile code.
"""

from __future__ import annotations

import ast
import json
import re
import resource
import subprocess
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Limits of an accepted function.
MOST_LINES, MOST_NODES, MOST_DEPTH = 25, 140, 12
BANNED = (ast.Import, ast.ImportFrom, ast.ClassDef, ast.AsyncFunctionDef, ast.With, ast.AsyncWith, ast.Try, ast.Raise, ast.Global, ast.Nonlocal, ast.Lambda, ast.Yield, ast.YieldFrom, ast.Await)
#: Names that may not be called, as functions or as methods.
BANNED_CALLS = {"eval", "exec", "open", "input", "compile", "__import__"}


def _depth(node: ast.AST) -> int:
    most, stack = 0, [(node, 1)]
    while stack:
        n, d = stack.pop()
        most = max(most, d)
        stack += [(c, d + 1) for c in ast.iter_child_nodes(n)]
    return most


def structure_reasons(code: str | None, entry_point: str | None) -> list[str]:
    """All reasons against a solution that must be one plain function of the given name."""
    try:
        tree = ast.parse(code or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return ["syntax_error"]
    nodes = list(ast.walk(tree))
    functions = [n for n in tree.body if isinstance(n, ast.FunctionDef)]
    calls = [n.func for n in nodes if isinstance(n, ast.Call)]
    called = [f.id for f in calls if isinstance(f, ast.Name)]
    methods = [f.attr for f in calls if isinstance(f, ast.Attribute)]
    checks = {
        "top_level_function_count": len(functions) != 1,
        "extra_top_level_code": len(tree.body) != 1 or not functions,
        "wrong_function_name": bool(functions) and functions[0].name != entry_point,
        "banned_node": any(isinstance(n, BANNED) for n in nodes),
        "banned_call": not BANNED_CALLS.isdisjoint(called + methods),
        "recursion": entry_point in called,
        "too_many_lines": sum(bool(x.strip()) for x in (code or "").split("\n")) > MOST_LINES,
        "too_many_ast_nodes": len(nodes) > MOST_NODES,
        "too_deep_ast": _depth(tree) > MOST_DEPTH,
    }
    return [k for k, bad in checks.items() if bad]


def entry_point_of(code: str | None) -> str | None:
    """The first top-level function's name."""
    try:
        return next((n.name for n in ast.parse(code or "").body if isinstance(n, ast.FunctionDef)), None)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def check_structure(df: DataFrame, code: str, entry_point: str) -> DataFrame:
    """``row_id, reasons ARRAY<STRING>, found_entry``; a null code has the reasons of an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, codes, names = (b.column(i).to_pylist() for i in range(3))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([structure_reasons(c, n) for c, n in zip(codes, names)], pa.list_(pa.string())), pa.array([entry_point_of(c) for c in codes], pa.string())],
                names=["row_id", "reasons", "found_entry"],
            )

    return df.select("row_id", code, entry_point).mapInArrow(run, "row_id long, reasons array<string>, found_entry string")


_RUNNER = """
import json, sys
job = json.load(sys.stdin)
scope = {}
try:
    exec(compile(job["code"], "candidate", "exec"), scope)
except BaseException as e:
    print(json.dumps(["load:" + type(e).__name__])); sys.exit()
def same(a, b):
    if isinstance(a, bool) or isinstance(b, bool): return a is b
    if isinstance(a, (int, float)) and isinstance(b, (int, float)): return abs(a - b) <= 1e-6 * max(1, abs(b))
    if isinstance(a, (list, tuple)) and isinstance(b, (list, tuple)): return len(a) == len(b) and all(map(same, a, b))
    if isinstance(a, dict) and isinstance(b, dict): return a.keys() == b.keys() and all(same(a[k], b[k]) for k in a)
    return a == b
out = []
for t in job["tests"]:
    try:
        if isinstance(t, str):
            exec(t, dict(scope)); out.append("ok")
        else:
            got = scope[job["entry"]](*t.get("args", []), **t.get("kwargs", {}))
            out.append("ok" if not t.get("raises") and same(got, t.get("expected")) else "wrong")
    except BaseException as e:
        out.append("ok" if not isinstance(t, str) and t.get("raises") == type(e).__name__ else "error:" + type(e).__name__)
print(json.dumps(out))
"""


def run_tests(code: str, entry_point: str, tests: list, seconds: float = 2.0, memory_mb: int = 512) -> list[str]:
    """The outcome of each test (an assert statement, or a dict with args, kwargs, expected or raises)."""

    def limits() -> None:
        resource.setrlimit(resource.RLIMIT_AS, (memory_mb << 20, memory_mb << 20))
        resource.setrlimit(resource.RLIMIT_CPU, (int(seconds) + 1, int(seconds) + 1))
        resource.setrlimit(resource.RLIMIT_FSIZE, (0, 0))
        resource.setrlimit(resource.RLIMIT_NOFILE, (16, 16))

    try:
        done = subprocess.run([sys.executable, "-I", "-c", _RUNNER], input=json.dumps({"code": code, "entry": entry_point, "tests": tests}), capture_output=True, text=True, timeout=seconds, env={}, preexec_fn=limits, check=False)
        return json.loads(done.stdout)
    except (subprocess.TimeoutExpired, ValueError):
        return ["timeout"]


_FENCE = re.compile(r"```(?:python)?\s*(.*?)```", re.S | re.I)
_ASSERTED = re.compile(r"assert\s+([A-Za-z_]\w*)\s*\(")


def code_of(answer: str | None) -> str:
    """The first fenced block of an answer, else the whole answer."""
    m = _FENCE.search(answer or "")
    return (m.group(1).strip() if m else "") or (answer or "")


def asserted_name(tests: list | None) -> str | None:
    """The function that the first telling assert calls."""
    return next((m.group(1) for t in tests or [] if isinstance(t, str) and (m := _ASSERTED.search(t))), None)


def code_reward(answer: str | None, entry_point: str | None, tests: list | None) -> float:
    """1.0 when structure and tests pass, 0.5 when only the structure does or there are no tests, else 0.0.

    The code may stand in a fence; a missing entry point is the code's first function, else the one that the
    tests call. Executes the code.
    """
    code = code_of(answer)
    entry = entry_point or entry_point_of(code) or asserted_name(tests)
    if not entry or structure_reasons(code, entry):
        return 0.0
    return 1.0 if tests and set(run_tests(code, entry, tests)) == {"ok"} else 0.5


def reward(spec: str, registry: dict) -> object:
    """A weighted sum of registered reward columns from ``name:weight+name:weight``."""
    total = None
    for part in spec.split("+"):
        name, _, weight = part.strip().partition(":")
        if name not in registry:
            raise KeyError(f"unknown reward {name!r}; known: {sorted(registry)}")
        term = registry[name] * float(weight or 1.0)
        total = term if total is None else total + term
    return total
