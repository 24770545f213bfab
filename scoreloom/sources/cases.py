"""A table function that expands declared cases; nothing of a declaration is executed."""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="idx int, name string, inputs string, outputs string, rtol double, atol double")
class Cases:
    """(idx, name, inputs, outputs, rtol, atol) of each case of a JSON declaration.

    It is a list of cases, one case, or {"grid": {name: values}, "repeat": n, "name": prefix}: the cases of all combinations of the values, each n times.
    A case is an object with name, inputs (or input), outputs (or output), rtol and atol, or any other value, which is its inputs. A case without
    a name is case_ and its index. What is no JSON has no cases.
    """

    def eval(self, declared: str) -> Iterator[tuple]:
        try:
            read = json.loads(declared) if declared else None
        except ValueError:
            return
        for i, case in enumerate(self.declared(read)):
            given = case if isinstance(case, dict) else {"inputs": case}
            inputs, outputs = given.get("inputs", given.get("input")), given.get("outputs", given.get("output"))
            text = [None if x is None else json.dumps(x, separators=(",", ":"), ensure_ascii=False) for x in (inputs, outputs)]
            number = [float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else None for x in (given.get("rtol"), given.get("atol"))]
            yield (i, str(given.get("name") or f"case_{i}"), *text, *number)

    @staticmethod
    def declared(read: object) -> Iterator[object]:
        if isinstance(read, dict) and isinstance(read.get("grid"), dict):
            names = list(read["grid"])
            for values in itertools.product(*[v if isinstance(v, list) else [v] for v in read["grid"].values()]):
                yield from itertools.repeat({"inputs": dict(zip(names, values, strict=True))}, int(read.get("repeat", 1)))
        elif isinstance(read, list):
            yield from read
        elif read is not None:
            yield read


def register(spark: SparkSession) -> None:
    """Makes declared_cases(text) known to SQL, for lateral joins."""
    spark.udtf.register("declared_cases", Cases)
