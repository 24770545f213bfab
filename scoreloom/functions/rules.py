"""Decision rules over records: validation, routing, statuses, decoys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def failed(checks: dict[str, Column]) -> Column:
    """The names of the checks that are true, in order."""
    return F.array_compact(F.array(*[F.when(c, name) for name, c in checks.items()]))


def missing_fields(record: Column, required: list[str]) -> Column:
    """The required keys that the map lacks, sorted."""
    return F.array_sort(F.array_except(F.array(*map(F.lit, required)), F.map_keys(record)))


def resource(wanted: Column, pure_compile: Column, stage: Column, kind: Column) -> Column:
    """cpu or gpu: by what is asked for, else by pure compilation, stage and type."""
    asked, at, of = F.lower(F.trim(wanted)), F.lower(F.trim(stage)), F.lower(F.trim(kind))
    return (
        F.when(asked.isin("cpu", "compile", "compilation"), "cpu").when(asked.isin("gpu", "cuda"), "gpu").when(pure_compile, "cpu")
        .when(at.isin("compile", "compilation") | of.isin("compile", "compilation", "kernel_compile", "cpu_compile"), "cpu").otherwise("gpu")
    )


def kernel_error(compiled: Column, correct: Column, detail: Column) -> Column:
    """struct(code, message) of a kernel's result; null fields if it is good."""
    told = F.coalesce(detail, F.lit("")) != ""
    code = F.when(~compiled, "COMPILATION_ERROR").when(~correct & told, "RUNTIME_ERROR").when(~correct, "CORRECTNESS_ERROR")
    message = (
        F.when(~compiled & told, F.concat(F.lit("Kernel compilation failed: "), detail)).when(~compiled, "Kernel compilation failed")
        .when(~correct & told, F.concat(F.lit("Kernel execution failed: "), detail)).when(~correct, "Kernel produced incorrect results")
    )
    return F.struct(code.alias("code"), message.alias("message"))


def cuda_decoy(n_custom: Column, used: Column, launch_only: Column) -> Column:
    """A result is a decoy unless custom kernels were seen, matched or inferred from launches."""
    return F.when((n_custom > 0) | used | launch_only, False).otherwise(True)


def metadata_first(record: Column, new: str, old: list[str]) -> Column:
    """A map with the value of `new`, or else of the first of its old names, under `new`, and no old names."""
    value = F.coalesce(*[F.element_at(record, k) for k in (new, *old)])
    rest = F.map_filter(record, lambda k, _: ~k.isin(new, *old))
    return F.when(value.isNotNull(), F.map_concat(rest, F.create_map(F.lit(new), value))).otherwise(rest)


def int_list(text: Column, default: list[int]) -> Column:
    """A list of integers written as JSON or with commas; the default if there is none."""
    bare = F.regexp_replace(text, r"[\[\]\s]", "")
    found = F.array_compact(F.transform(F.split(bare, ","), lambda x: x.try_cast("int")))
    return F.when(F.size(found) > 0, found).otherwise(F.array(*map(F.lit, default)))


def worker_kind(kind: Column, device: Column) -> Column:
    return F.when((F.lower(kind) == "cpu") | F.startswith(F.lower(device), F.lit("cpu")), "cpu").otherwise("gpu")


def restart_reason(cuda_error: Column, age_sec: Column, offline_sec: Column, expected: Column, restarting: Column, uptime_sec: Column) -> Column:
    """Why a worker must restart: a CUDA error, then a stale heartbeat (120 s), then being offline (60 s); null if it need not."""
    due = expected & ~restarting & (uptime_sec > 90)
    return F.when(due & cuda_error, "cuda_error").when(due & (age_sec > 120), "heartbeat").when(due & (offline_sec > 60), "offline")
