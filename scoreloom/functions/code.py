"""Checks of source code and free JSON that no SQL expression can make; Arrow batches go to small Python helpers."""

from __future__ import annotations

import ast
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# What code for a backend must mention, one of each, and keys that artifacts lose at any depth.
REQUIRED = {"triton": ("import triton", "from triton import"), "cuda": ("torch.cuda", "cuda_kernel", "@cuda.jit", "from numba import cuda")}
ARTIFACT_KEYS = ("cache_hit_source", "cache_index", "cache_key", "cache_scope", "code", "compile_artifact_cache_hit_source", "compile_artifact_cache_index", "module", "model_class", "session", "so_path", "tempfile_handle", "work_dir")


def _fault(source: str | None) -> str | None:
    try:
        ast.parse(source or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return str(e) or type(e).__name__
    return None


def syntax_error(source: Column) -> Column:
    """What is wrong with Python source, null if nothing; it is parsed, never run."""

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([_fault(v) for v in x], dtype=object)

    return run(source)


def kernel_check(source: Column, backend: Column, entry: str = "Model") -> Column:
    """The first failing check of a kernel's source as an error code; null if it passes."""
    text = F.coalesce(source, F.lit(""))
    lacks = [(backend == name) & ~_any(text, marks) for name, marks in REQUIRED.items()]
    out = F.when(~F.contains(text, F.lit(f"class {entry}New")), "VALIDATION_ERROR").when(syntax_error(text).isNotNull(), "SYNTAX_ERROR")
    for missing in lacks:
        out = out.when(missing, "IMPORT_ERROR")
    return out


def _any(text: Column, marks: tuple[str, ...]) -> Column:
    out = F.contains(text, F.lit(marks[0]))
    for m in marks[1:]:
        out = out | F.contains(text, F.lit(m))
    return out


def _open_call(source: str | None, name: str) -> int | None:
    at = 0
    source = source or ""
    while (at := source.find(f"{name}(", at)) >= 0:
        depth, end = 0, None
        for m in re.compile(r"[()]").finditer(source, at):
            depth += 1 if m.group() == "(" else -1
            if not depth:
                end = m.end()
                break
        if end is None or not re.compile(r"\s*;").match(source, end):
            return source.count("\n", 0, at) + 1
        at = end
    return None


def open_call(source: Column, name: str) -> Column:
    """The line, from 1, of the first call of name whose parentheses never close or which no semicolon follows; else null."""

    @F.pandas_udf("int")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([_open_call(v, name) for v in x], dtype="Int32")

    return run(source)


def open_call_in(sources: Column, name: str) -> Column:
    """file:line of the first such call in a JSON object of file contents; else null."""

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        def one(v: str | None) -> str | None:
            for file, source in json.loads(v or "{}").items():
                if (line := _open_call(source, name)) is not None:
                    return f"{file}:{line}"
            return None

        return pd.Series([one(v) for v in x], dtype=object)

    return run(sources)


def without_keys(document: Column, keys: tuple[str, ...] = ARTIFACT_KEYS) -> Column:
    """A JSON document without these keys at any depth; null if it is none."""
    drop = frozenset(keys)

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        def one(v: str | None) -> str | None:
            try:
                return json.dumps(json.loads(v, object_pairs_hook=lambda p: {k: w for k, w in p if k not in drop}), separators=(",", ":"), ensure_ascii=False)
            except (TypeError, ValueError, RecursionError):
                return None

        return pd.Series([one(v) for v in x], dtype=object)

    return run(document)
