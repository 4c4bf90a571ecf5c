"""Model clients: the protocol, deterministic offline clients, and how a call becomes a column.

A call is a deterministic struct column ``ok, calls, <outputs>``, so Catalyst pushes filters below it and drops it if
nothing reads it. A client that is made of column expressions (:class:`Expressions`) never leaves the JVM. Calls of a
Python client are issued once per distinct prompt and kept in a content-addressed table (:class:`CallTable`).
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schema import Kind, spark_schema


class Model(Protocol):
    def complete(self, prompt: str, schema: dict[str, Kind]) -> dict: ...

    def embed(self, text: str) -> list[float]: ...

    def classify(self, prompt: str, labels: list[str]) -> tuple[str, float]: ...


@dataclass
class Expressions:
    """Outputs as SQL expressions over the row (or the group): the answer of a model that is known in closed form."""

    outputs: dict[str, str]

    def column(self, kinds: dict[str, Kind]) -> Column:
        missing = set(kinds) - set(self.outputs)
        if missing:
            raise ValueError(f"no expression for {sorted(missing)}")
        return F.struct(*[F.expr(self.outputs[n]).cast(k.spark()).alias(n) for n, k in kinds.items()])


class Hashed:
    """A client without a model: answers and vectors are functions of the text's hash. For plumbing and tests."""

    def __init__(self, answer: Callable[[str], dict] | None = None, width: int = 32):
        self.answer, self.width = answer, width

    def complete(self, prompt: str, schema: dict[str, Kind]) -> dict:
        if self.answer:
            return self.answer(prompt)
        return {n: _filler(k, hashlib.md5(f"{n}\0{prompt}".encode()).hexdigest()) for n, k in schema.items()}

    def embed(self, text: str) -> list[float]:
        """Hashed bag of lower-cased words, of unit length."""
        out = [0.0] * self.width
        for w in re.findall(r"[a-z0-9]+", text.lower()):
            h = int(hashlib.md5(w.encode()).hexdigest()[:8], 16)
            out[h % self.width] += 1.0 if h & 0x80000000 else -1.0
        norm = sum(v * v for v in out) ** 0.5
        return [v / norm for v in out] if norm else out

    def classify(self, prompt: str, labels: list[str]) -> tuple[str, float]:
        h = int(hashlib.md5(prompt.encode()).hexdigest()[:8], 16)
        return labels[h % len(labels)], 0.5 + (h >> 8) % 1000 / 2000


def _filler(kind: Kind, digest: str):
    n = int(digest[:8], 16)
    return {
        "string": lambda: digest[:8], "integer": lambda: n % 100, "number": lambda: n % 1000 / 10, "boolean": lambda: n % 2 == 0,
        "enum": lambda: kind.allowed[n % len(kind.allowed)], "list": lambda: [_filler(kind.item, digest[i:] + digest) for i in range(n % 3)], "object": lambda: {f: _filler(k, digest[i + 1 :] + digest) for i, (f, k) in enumerate(kind.fields)},
    }[kind.name]()


@dataclass
class Gleaning:
    """Up to ``rounds`` refinements: ``judge(output)`` says whether to refine, and with what advice."""

    rounds: int
    judge: Callable[[dict], tuple[bool, str]]


@dataclass
class Call:
    model: Model
    kinds: dict[str, Kind]
    retries: int = 2
    validate: list[Callable[[dict], bool]] = field(default_factory=list)
    gleaning: Gleaning | None = None

    def run(self, prompt: str) -> tuple[bool, int, dict]:
        """(ok, calls, output): retried until typed and valid, then refined."""
        calls, out, ok = 0, {}, False
        for attempt in range(self.retries + 1):
            out = self.model.complete(prompt if not attempt else f"{prompt}\n\nAttempt {attempt + 1}: the last answer was not valid.", self.kinds)
            calls += 1
            ok = self.valid(out)
            if ok:
                break
        if ok and self.gleaning:
            for _ in range(self.gleaning.rounds):
                refine, advice = self.gleaning.judge(out)
                calls += 1
                if not refine:
                    break
                better = self.model.complete(f"{prompt}\n\nImprove: {advice}", self.kinds)
                calls += 1
                out = better if self.valid(better) else out
        return ok, calls, out

    def valid(self, out: dict) -> bool:
        return isinstance(out, dict) and all(n in out and k.accepts(out[n]) for n, k in self.kinds.items()) and all(_holds(rule, out) for rule in self.validate)

    def column(self, prompt: Column) -> Column:
        fields = spark_schema(self.kinds).fields
        kind = T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("calls", T.IntegerType()), *fields])

        def each(prompts: pd.Series) -> pd.DataFrame:
            rows = []
            for p in prompts:
                ok, calls, out = self.run(p)
                rows.append({"ok": ok, "calls": calls} | {n: out.get(n) if ok else None for n in self.kinds})
            return pd.DataFrame(rows, columns=[f.name for f in kind.fields])

        each.__annotations__ = {"prompts": pd.Series, "return": pd.DataFrame}
        return F.pandas_udf(each, kind)(prompt)


def _holds(rule, out: dict) -> bool:
    try:
        return bool(rule(out))
    except Exception:  # noqa: BLE001  a rule that can't be evaluated doesn't hold
        return False


def embedding(model: Model, text: Column) -> Column:
    def each(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: model.embed(t or "")).reset_index(drop=True)

    each.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(each, T.ArrayType(T.DoubleType()))(text)


class CallTable:
    """Answers by the hash of prompt and configuration, as Parquet; every distinct prompt is paid for once."""

    def __init__(self, path: str):
        self.path = path

    def key(self, prompt: Column, config: dict) -> Column:
        return F.sha2(F.concat(F.lit(json.dumps(config, sort_keys=True, default=str) + "\0"), prompt), 256)

    def read(self, df: DataFrame, kind: T.StructType) -> DataFrame | None:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).exists(path):
            return None
        return df.sparkSession.read.schema(kind).parquet(f"{self.path}/*")

    def answered(self, df: DataFrame, prompt: Column, call: Call, config: dict, into: str) -> DataFrame:
        """``df`` with the struct ``into``; only prompts without an answer in the table are issued."""
        keyed = df.withColumn("__key", self.key(prompt, config)).withColumn("__prompt", prompt)
        wanted = keyed.select("__key", "__prompt").dropDuplicates(["__key"])
        made = wanted.select("__key", call.column(F.col("__prompt")).alias(into))
        had = self.read(df, made.schema)
        if had is not None:
            made = wanted.join(had, "__key", "left_anti").select("__key", call.column(F.col("__prompt")).alias(into))
        made.write.parquet(f"{self.path}/{uuid.uuid4().hex}")
        return keyed.join(self.read(df, made.schema), "__key", "left").drop("__key", "__prompt")
