"""Classifiers, extractors and parsers of text, as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The classes of error messages in the order in which they are tried, with their patterns.
ERROR_PATTERNS: dict[str, tuple[str, ...]] = {
    "VALIDATION_ERROR": ("validation failed", "dangerous pattern detected", "code must contain", "invalid code format", "missing.*class", "invalid.*entry.*point", "code validation error"),
    "COMPILATION_ERROR": ("compilation failed", "compile.*error", "syntax error", "nvcc.*error", "cuda.*compilation", "triton.*compilation", "kernel.*compilation", "build.*failed", "linker.*error"),
    "RUNTIME_ERROR": ("runtime error", "kernel.*execution.*failed", "cuda.*runtime", "out of memory", "device.*error", "gpu.*error", "invalid.*device", "cuda.*error", "execution.*failed"),
    "CORRECTNESS_ERROR": ("correctness.*check.*failed", "output.*mismatch", "result.*incorrect", "assertion.*failed", "accuracy.*test.*failed", "numerical.*error", "precision.*error"),
    "TIMEOUT_ERROR": ("timeout", "task.*timed.*out", "execution.*timeout", "time.*limit.*exceeded", "hung.*task", "stuck.*task"),
    "SYSTEM_ERROR": ("system.*error", "internal.*server.*error", "redis.*error", "database.*error", "connection.*failed", "service.*unavailable", "initialization.*failed"),
    "RESOURCE_ERROR": ("resource.*error", "insufficient.*memory", "queue.*full", "no.*available.*workers", "gpu.*unavailable", "device.*busy", "memory.*exhausted", "disk.*space", "resource.*exhausted"),
}
# What a context must hold for a class, in order.
CONTEXTS = (("validation", "VALIDATION_ERROR"), ("compilation", "COMPILATION_ERROR"), ("compile", "COMPILATION_ERROR"), ("runtime", "RUNTIME_ERROR"), ("execution", "RUNTIME_ERROR"), ("correctness", "CORRECTNESS_ERROR"), ("timeout", "TIMEOUT_ERROR"), ("system", "SYSTEM_ERROR"), ("resource", "RESOURCE_ERROR"))
# The categories of the classes.
CATEGORIES = {"VALIDATION_ERROR": "input", "COMPILATION_ERROR": "compilation", "RUNTIME_ERROR": "runtime", "CORRECTNESS_ERROR": "correctness", "TIMEOUT_ERROR": "timeout", "SYSTEM_ERROR": "system", "RESOURCE_ERROR": "resource", "UNKNOWN_ERROR": "unknown"}
# What marks memory errors and lock errors.
MEMORY_MARKS = ("illegal memory access", "an illegal memory access was encountered", "illegal address", "cuda error", "cuda_error", "cudaerror", "cudaerrorillegalaccess", "cuda_error_illegal_address", "unspecified launch failure", "device-side assert triggered", "misaligned address", "memory access violation", "segmentation fault", "invalid memory", "out of memory")
LOCK_MARKS = ("filebaton", "baton", "lock file", "lockfile", "file lock", "cache lock", "waiting for lock", "timeout waiting for lock", "timed out waiting for lock", "failed to acquire lock", "could not acquire lock")
# Names of kernels that belong to the framework, and operations that say nothing about it.
FRAMEWORK_PREFIXES = ("aten::", "cudaLaunch", "cudaMemcpy", "cudaMemset", "cudaDeviceSynchronize", "Activity Buffer Request", "Runtime Triggered Module Loading", "Lazy Function Loading", "[memory]", "nccl::")
IGNORED_ATEN = ("empty", "zeros", "ones", "clone", "contiguous", "tensor", "as_strided", "view", "reshape", "to", "cast", "full", "copy", "arange", "randn")

# How sources name their kernels.
KERNEL_PATTERNS = (r"__global__\s+void\s+([A-Za-z_]\w*)\s*\(", r"__global__\s+[\w:<>]+\s+([A-Za-z_]\w*)\s*\(")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def contains_any(x: Column, marks: tuple[str, ...]) -> Column:
    return any_of([F.contains(x, F.lit(m)) for m in marks])


def _holds(low: Column, pattern: str) -> Column:
    """Whether low has a match of pattern, whose fixed words are looked for first; a dot is any character but a newline."""
    words = pattern.split(".*")
    if any(re.escape(w).replace("\\ ", " ").replace("\\-", "-") != w for w in words):
        return low.rlike(f"(?d){pattern}")
    there = reduce(lambda a, b: a & b, [F.contains(low, F.lit(w)) for w in words])
    return there & low.rlike(f"(?d){pattern}") if len(words) > 1 else there


def classify_error(message: Column, context: Column | None = None) -> Column:
    """The first class one of whose patterns is in the lower-cased message; else by the context; else unknown."""

    def by_pattern(low: Column) -> Column:
        out = F.when(F.coalesce(low, F.lit("")) == "", "UNKNOWN_ERROR")
        for code, patterns in ERROR_PATTERNS.items():
            out = out.when(any_of([_holds(low, p) for p in patterns]), code)
        if context is not None:
            for word, code in CONTEXTS:
                out = out.when(F.contains(F.lower(context), F.lit(word)), code)
        return out.otherwise("UNKNOWN_ERROR")

    return F.transform(F.array(F.lower(message)), by_pattern)[0]  # the message is lowered once


def error_category(code: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv])
    return F.coalesce(F.element_at(table, code), F.lit("unknown"))


def is_memory_error(message: Column) -> Column:
    return contains_any(F.lower(F.coalesce(message, F.lit(""))), MEMORY_MARKS)


def is_lock_error(message: Column) -> Column:
    low = F.lower(F.coalesce(message, F.lit("")))
    return contains_any(low, LOCK_MARKS) | (F.contains(low, F.lit("no such file or directory")) & F.contains(low, F.lit(".lock")))


def is_framework_kernel(name: Column) -> Column:
    trimmed = F.trim(name)
    named = any_of([F.startswith(trimmed, F.lit(p)) for p in (*FRAMEWORK_PREFIXES, "void at::", "void c10::")])
    return (F.coalesce(name, F.lit("")) == "") | named | F.contains(trimmed, F.lit("at::native::"))


def is_telling_aten(name: Column) -> Column:
    trimmed = F.trim(F.coalesce(name, F.lit("")))
    return F.startswith(trimmed, F.lit("aten::")) & ~contains_any(trimmed, IGNORED_ATEN)


def bare_kernel_name(name: Column) -> Column:
    """A C++ kernel's name without parameters, template arguments and namespaces."""
    bare = F.substring_index(F.trim(F.substring_index(name, "(", 1)), "<", 1)
    return F.substring_index(bare, "::", -1)


def kernel_names(source: Column) -> Column:
    """The distinct names of __global__ functions in source, sorted."""
    return F.array_sort(F.array_distinct(F.concat(*[F.regexp_extract_all(source, F.lit(p)) for p in KERNEL_PATTERNS])))


def compiled_flag(text: Column) -> Column:
    """The boolean after the key "compiled"; null if there is none."""
    found = F.regexp_extract(text, r'(?i)"compiled"\s*:\s*(true|false)', 1)
    return F.when(found != "", F.lower(found) == "true")


def fenced(text: Column, section: str) -> Column:
    """The text of a fenced section named in a heading line before it, without white space at the ends."""
    body = F.regexp_extract(text, rf"(?is)#+\s*{section}\s*\n```\w*\n(.*?)```", 1)
    return F.regexp_replace(body, r"^\s+|\s+$", "")


def arch_list(text: Column) -> Column:
    """Compute capabilities as x.y, joined by semicolons: sm_ and compute_ cut, +PTX cut, 80 read as 8.0."""
    def one(token: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(F.lower(token), r"\+ptx$", ""), "^(sm_|compute_)", "")
        return F.when(bare.rlike(r"^\d{2,}$"), F.concat(F.regexp_extract(bare, r"^(\d+)\d$", 1), F.lit("."), F.right(bare, F.lit(1)))).otherwise(bare)

    tokens = F.filter(F.split(F.trim(text), r"[;,\s]+"), lambda t: t != "")
    return F.array_join(F.transform(tokens, one), ";")


def without_retry(task_id: Column) -> Column:
    """task_id up to its last _retry."""
    head = F.regexp_extract(task_id, r"(?s)^(.*)_retry", 1)
    return F.when(F.contains(task_id, F.lit("_retry")), head).otherwise(task_id)


def base_task(task_id: Column) -> Column:
    return F.regexp_replace(task_id, "_(compile|kernel|ref)$", "")


def file_kind(path: Column) -> Column:
    """The longest known suffix decides."""
    kinds = ((".cuda.o", "cuda_object"), (".o", "object"), (".so", "library"), (".cu", "cuda_source"), (".cpp", "cpp_source"), (".h", "header"))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for suffix, kind in kinds:
        out = out.when(F.endswith(path, F.lit(suffix)), kind)
    return out.otherwise("other")


def number(text: Column) -> Column:
    """A number that may end in a percent sign; null if it is none."""
    return F.regexp_replace(F.trim(text), "%$", "").try_cast("double")


def milliseconds(text: Column) -> Column:
    """A duration with the unit ms or us, in milliseconds."""
    value = F.regexp_extract(text, r"^\s*([0-9.]+)\s*(ms|us)", 1).try_cast("double")
    return F.when(F.regexp_extract(text, r"^\s*([0-9.]+)\s*(ms|us)", 2) == "us", value / 1000).otherwise(value)


def text_of_flag(flag: Column) -> Column:
    """True, False or None as text."""
    return F.when(flag.isNull(), "None").when(flag, "True").otherwise("False")


def content_key(*parts: Column) -> Column:
    """SHA-256 over parts separated by NUL; null parts are empty."""
    return F.sha2(F.concat_ws("\0", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def appended(before: Column, after: Column) -> Column:
    """What a log has got since it read before; all of it if it doesn't begin so."""
    return F.when(F.startswith(after, before), F.substring(after, F.char_length(before) + 1, F.char_length(after))).otherwise(after)


def first_text(*columns: Column) -> Column:
    """The first column that is neither null nor blank, unstripped."""
    return F.coalesce(*[F.when(~F.coalesce(c, F.lit("")).rlike(r"^\s*$"), c) for c in columns])
