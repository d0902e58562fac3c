"""Identities of records: SHA-256 of canonical JSON, the same bytes whoever writes them."""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(value: object, compact: bool = True, ascii_only: bool = False) -> str:
    """JSON with sorted keys. Control characters are escaped as \\u00XX or by their short names, and nothing else beyond quotes and backslashes."""
    return json.dumps(value, ensure_ascii=ascii_only, sort_keys=True, separators=(",", ":") if compact else (", ", ": "))


def digest(value: object, **how) -> str:
    return hashlib.sha256(canonical(value, **how).encode("utf-8")).hexdigest()


def canonical_id(*names: str, **columns: Column) -> Column:
    """The digest of an object with these columns as its strings; null where one of them is."""
    fields = {n: F.col(n) for n in names} | columns
    keys = sorted(fields)

    @F.arrow_udf("string")
    def of(rows: pa.Array) -> pa.Array:
        held = [rows.field(i).to_pylist() for i in range(len(keys))]
        each = zip(*held, strict=True) if keys else ()
        return pa.array([None if None in values else digest(dict(zip(keys, values, strict=True))) for values in each], pa.string())

    return of(F.struct(*[fields[k].cast("string").alias(f"_{i}") for i, k in enumerate(keys)]))


def record_id(instruction: Column, input_: Column, output: Column) -> Column:
    """Identity of a training record: its instruction, input and output."""
    return canonical_id(instruction=instruction, input=input_, output=output)


def stable_record_id(instruction: Column, input_: Column) -> Column:
    """Identity of a task whatever was answered."""
    return canonical_id(instruction=instruction, input=input_)


def task_key(domain: str, init_dynamic: list, goal: list, faults: list, robots: list) -> str:
    """Identity of a mission, with the separators of a plain writer."""
    return digest({"d": domain, "i": init_dynamic, "g": goal, "f": faults, "r": robots}, compact=False, ascii_only=True)


def request_key(model: Column, messages: Column, options: dict) -> Column:
    """Key of a request for a cache: model, messages and options; messages as one text for each row."""
    held = canonical(options, compact=False)

    @F.arrow_udf("string")
    def of(models: pa.Array, texts: pa.Array) -> pa.Array:
        each = zip(models.to_pylist(), texts.to_pylist(), strict=True)
        return pa.array([digest({"m": m, "msg": [{"role": "user", "content": t}], "kw": json.loads(held)}, compact=False) for m, t in each], pa.string())

    return of(model, messages)
