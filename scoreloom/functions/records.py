"""Expressions over nested records: responses, submissions, sources, structural comparison."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom.functions import code, stats
from scoreloom.functions.text import contains_any

# The parts of a response, statuses and messages of failing infrastructure, aliases of backends, the
# name of sources without one, and the marks and messages by which a submission is judged.
RESPONSE = (
    "status string, compiled boolean, correctness boolean, error_code string, error_message string, metadata struct<split_compile_and_execute:boolean,"
    "precompiled_artifact_used:boolean,inline_gpu_execute_completed:boolean,compile_artifact_cache_hit:boolean,compile_artifact_cache_enabled:boolean,"
    "compile_only:boolean,task_stage:string,compile_artifact:struct<build_backend:string,compile_timing:struct<build_backend:string,total_sec:double>>,"
    "worker_id:string,inline_compile_worker_id:string,worker_device:string,inline_compile_worker_device:string>"
)
RESPONSE_FLAGS = (
    "split_compile_and_execute", "precompiled_artifact_used", "inline_gpu_execute_completed", "compile_artifact_cache_hit", "compile_artifact_cache_enabled",
    "compile_only", "task_stage",
)
INFRA_STATUSES, INFRA_MESSAGE = ("client_error", "http_error"), "Worker shutdown"
BACKENDS = {"triton": ("triton",), "cuda_agent": ("cuda_agent",)}
OTHER_BACKEND, DEFAULT_BACKEND = "cuda", "triton"
SOURCE_NAME = "kernels/kernel.cu"
EXTENSION_MARKS = ("REGISTER_BINDING(", "pybind11::module", "m.def(", '#include "../binding_registry.h"', "#include <torch/types.h>", "torch::Tensor")
FFI_MARKS = ("TVM_FFI_DLL_EXPORT_TYPED_FUNC(", "#include <tvm/ffi/function.h>", "#include <tvm/ffi/container/tensor.h>", "tvm::ffi::Tensor", "tvm::ffi::TensorView")
REGISTRY = '#include "../binding_registry.h"'
FAILED = "Precheck failed: "
MESSAGES = {
    "no_code": "Code is required",
    "no_extension": "model_new.py must use cuda_extension",
    "no_sources": "CUDA sources are required for CUDA-Agent compilation",
    "no_cuda": "CUDA-Agent sources must include at least one .cu file",
    "no_registry": "binding source must include ../binding_registry.h",
    "ffi_in_files": "source_mode files/inline expects a pybind/binding_registry style binding, but TVM-FFI exports were detected",
    "no_binding": "No supported Python extension binding pattern detected in CUDA sources",
    "extension_in_ffi": "source_mode='tvm_ffi' requires TVM-FFI exports instead of REGISTER_BINDING/pybind bindings",
    "no_ffi": "source_mode='tvm_ffi' requires TVM_FFI_DLL_EXPORT_TYPED_FUNC(...) or tvm::ffi Tensor bindings",
}


def _told(x: Column) -> Column:
    """x, or null if it is empty."""
    return F.nullif(x, F.lit(""))


def infra_error(status: Column, message: Column) -> Column:
    return F.coalesce(status.isin(*INFRA_STATUSES), F.lit(False)) | F.coalesce(F.contains(message, F.lit(INFRA_MESSAGE)), F.lit(False))


def flat_response(response: Column) -> list[Column]:
    """The columns that a nested JSON response becomes; what is absent or of another kind is null."""
    r = F.from_json(response, RESPONSE)
    meta, artifact = r["metadata"], r["metadata"]["compile_artifact"]
    timing = artifact["compile_timing"]
    return [
        *[r[c].alias(c) for c in ("status", "compiled", "correctness", "error_code", "error_message")],
        infra_error(r["status"], r["error_message"]).alias("infra_error"),
        *[meta[c].alias(f"metadata_{c}") for c in RESPONSE_FLAGS],
        F.coalesce(_told(artifact["build_backend"]), timing["build_backend"]).alias("build_backend"),
        F.to_json(timing).alias("compile_timing"),
        F.coalesce(_told(meta["worker_id"]), meta["inline_compile_worker_id"]).alias("worker_id"),
        F.coalesce(_told(meta["worker_device"]), meta["inline_compile_worker_device"]).alias("worker_device"),
        response.alias("raw_result"),
    ]


def entry_point(source: Column, asked: Column, default: str = "Model") -> Column:
    """The class to run: one asked for by another name than default, else the new class if source has it, else what was asked."""
    new = f"{default}New"
    asked = _told(asked)
    return F.when(asked != default, asked).when(F.contains(source, F.lit(f"class {new}")), new).otherwise(F.coalesce(asked, F.lit(new)))


def backend(name: Column) -> Column:
    key = F.lower(F.trim(F.coalesce(_told(name), F.lit(DEFAULT_BACKEND))))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for to, names in BACKENDS.items():
        out = out.when(key.isin(*names), to)
    return out.otherwise(OTHER_BACKEND)


def failure_text(kind: Column, message: Column, trace: Column, verbose: bool = True) -> Column:
    """A failure as text: its trace, or else its kind and message; the message alone unless verbose."""
    if not verbose:
        return message
    return F.coalesce(_told(trace), F.concat(kind, F.lit(": "), F.coalesce(message, F.lit(""))))


def sources_map(value: Column) -> Column:
    """Sources as a map from file name to content: from the text of a dict literal, or bare text under SOURCE_NAME; blank gives none.

    A literal that can't be read, or is no dict, gives null.
    """

    @F.pandas_udf("string")
    def literal(x: pd.Series) -> pd.Series:
        def one(v: str | None) -> str | None:
            try:
                read = ast.literal_eval(v.strip()) if v is not None else None
            except (ValueError, SyntaxError, RecursionError, MemoryError):
                return None
            return json.dumps({str(k): str(w) for k, w in read.items()}) if isinstance(read, dict) else None

        return pd.Series([one(v) for v in x], dtype=object)

    blank, braced = F.coalesce(value, F.lit("")).rlike(r"^\s*$"), value.rlike(r"^\s*\{")
    none = F.from_json(F.lit("{}"), "map<string,string>")
    return F.when(blank, none).when(braced, F.from_json(literal(F.when(braced, value)), "map<string,string>")).otherwise(F.create_map(F.lit(SOURCE_NAME), value))


def json_safe(document: Column, depth: int = 10) -> Column:
    """A JSON document in which what lies deeper than depth is text."""

    def safe(x: object, at: int) -> object:
        if at > depth:
            return str(x)
        if isinstance(x, dict):
            return {k: safe(v, at + 1) for k, v in x.items()}
        return [safe(v, at + 1) for v in x] if isinstance(x, list) else x

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        def one(v: str | None) -> str | None:
            try:
                return json.dumps(safe(json.loads(v), 0), separators=(",", ":"), ensure_ascii=False)
            except (TypeError, ValueError, RecursionError):
                return None

        return pd.Series([one(v) for v in x], dtype=object)

    return run(document)


def same_structure(a: Column, b: Column, kind: T.DataType, rtol: float = 1e-4, atol: float = 1e-5) -> Column:
    """Whether two values of a kind agree: numbers nearly, arrays item by item, maps key by key, structs field by field; nulls agree with nulls."""
    if isinstance(kind, T.ArrayType):
        # the items of the shorter one are filled up with nulls, and lengths differ then
        each = F.forall(F.zip_with(a, b, lambda x, y: same_structure(x, y, kind.elementType, rtol, atol)), lambda t: t)
        both = (F.size(a) == F.size(b)) & each
    elif isinstance(kind, T.MapType):
        keys = F.array_sort(F.map_keys(a)) == F.array_sort(F.map_keys(b))
        both = keys & F.forall(F.map_keys(a), lambda k: same_structure(F.element_at(a, k), F.element_at(b, k), kind.valueType, rtol, atol))
    elif isinstance(kind, T.StructType):
        both = F.lit(True)
        for f in kind.fields:
            both = both & same_structure(a[f.name], b[f.name], f.dataType, rtol, atol)
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        both = stats.allclose(a, b, rtol, atol)
    else:
        both = a == b
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(F.coalesce(both, F.lit(False)))


def binding_api(text: Column) -> Column:
    extension, ffi = contains_any(text, EXTENSION_MARKS), contains_any(text, FFI_MARKS)
    return F.when(extension & ffi, "mixed").when(ffi, "tvm_ffi").when(extension, "python_extension").otherwise("unknown")


def submission_check(model: Column, sources: Column, mode: Column, entry: str = "ModelNew") -> Column:
    """struct(message, code, binding_api) of a submission: the first rule that it breaks, or an empty message and no code.

    sources maps file names to contents; mode is files, inline or tvm_ffi, by default files.
    """
    mode = F.lower(F.trim(F.coalesce(_told(mode), F.lit("files"))))
    text = F.array_join(F.map_values(sources), "\n")
    of = lambda suffix: F.map_filter(sources, lambda k, _: F.endswith(k, F.lit(suffix)))
    api, in_files, in_ffi = binding_api(text), mode.isin("files", "inline"), mode == "tvm_ffi"
    fault, unended = code.syntax_error(model), code.open_call_in(F.to_json(of(".cpp")), "REGISTER_BINDING")
    rules = [
        (F.coalesce(model, F.lit("")) == "", F.lit(MESSAGES["no_code"]), "VALIDATION_ERROR"),
        (~F.contains(model, F.lit(f"class {entry}")), F.lit(f"Code must contain a '{entry}' class"), "VALIDATION_ERROR"),
        (fault.isNotNull(), F.concat(F.lit("Syntax error in model code: "), fault), "SYNTAX_ERROR"),
        (~F.contains(model, F.lit("cuda_extension")), F.lit(MESSAGES["no_extension"]), "IMPORT_ERROR"),
        (F.coalesce(F.size(sources), F.lit(0)) <= 0, F.lit(MESSAGES["no_sources"]), "VALIDATION_ERROR"),
        (F.size(of(".cu")) == 0, F.lit(MESSAGES["no_cuda"]), "VALIDATION_ERROR"),
        (in_files & ~F.contains(F.array_join(F.map_values(of(".cpp")), "\n"), F.lit(REGISTRY)), F.lit(MESSAGES["no_registry"]), "VALIDATION_ERROR"),
        (in_files & (api == "tvm_ffi"), F.lit(MESSAGES["ffi_in_files"]), "VALIDATION_ERROR"),
        (in_files & (api == "unknown"), F.lit(MESSAGES["no_binding"]), "VALIDATION_ERROR"),
        (in_files & unended.isNotNull(), F.concat(unended, F.lit(" has REGISTER_BINDING(...) without a trailing ';'")), "SYNTAX_ERROR"),
        (in_ffi & (api == "python_extension"), F.lit(MESSAGES["extension_in_ffi"]), "VALIDATION_ERROR"),
        (in_ffi & (api == "unknown"), F.lit(MESSAGES["no_ffi"]), "VALIDATION_ERROR"),
    ]
    message, error = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(""))
    for broken, said, name in rules:
        message, error = message.when(broken, F.concat(F.lit(FAILED), said)), error.when(broken, name)
    return F.struct(message.otherwise("").alias("message"), error.alias("code"), api.alias("binding_api"))
