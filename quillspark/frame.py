"""The builder: an immutable chain of operators over a source, run as one DataFrame."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from . import sources
from .plans import OPERATORS, RULES, Node, Plan


@dataclass
class Settings:
    """Defaults of all frames; set them on ``settings``."""

    model: object | None = None
    checkpoint_folder: str | None = None
    rewrites: list[str] = field(default_factory=lambda: list(RULES))


settings = Settings()


@dataclass(frozen=True)
class Frame:
    """``source`` makes a DataFrame of a session; ``steps`` are what is done to it. Nothing runs before an action."""

    source: Callable[[SparkSession], DataFrame]
    label: str
    steps: Plan = Plan()
    origin: dict | None = None
    _memo: dict = field(default_factory=dict, compare=False, repr=False)

    def _add(self, kind: str, name: str | None = None, **params) -> "Frame":
        n = 1 + sum(s.kind == kind for s in self.steps.nodes)
        if kind in ("map", "parallel_map", "filter", "reduce") and "model" not in params and settings.model is not None:
            params["model"] = settings.model
        name = name or f"{kind}_{n}"
        if kind in ("reduce", "code_reduce", "split", "sample", "topk", "extract", "extract_lines", "resolve"):
            params.setdefault("name", name)
        return replace(self, steps=self.steps.then(Node(kind, name, params)), _memo=self._memo)

    def __getattr__(self, kind: str):
        """Every registered operator is a method."""
        if kind.startswith("_") or kind not in OPERATORS:
            raise AttributeError(kind)
        return lambda *args, **params: self._add(kind, **_positional(kind, args), **params)

    def filter(self, **params) -> "Frame":
        return self._add("filter", **params)

    def map(self, **params) -> "Frame":
        return self._add("map", **params)

    def equijoin(self, right: "Frame", **params) -> "Frame":
        """Fuzzy inner join with another frame, which runs as part of this one."""
        return self._add("equijoin", right=right, **params)

    # Inspection

    def plan(self, rewritten: bool = True) -> Plan:
        return self.steps.rewritten(settings.rewrites) if rewritten else self.steps

    def explain(self) -> str:
        return f"scan {self.label}\n{self.plan().explain()}"

    def schema(self, spark: SparkSession | None = None):
        return self.to_df(spark).schema

    def validate(self, spark: SparkSession | None = None) -> list[str]:
        return self.steps.validate(self.source(_session(spark)).columns)

    # Actions

    def to_df(self, spark: SparkSession | None = None) -> DataFrame:
        """The whole chain as one lazy DataFrame. With a checkpoint folder, the longest stored prefix is read and every
        paid step's result is stored, so that no later action pays again."""
        spark = _session(spark)
        plan = self.plan()
        digests = plan.prefix_digests(self.label)
        key = (digests[-1] if digests else self.label, id(spark))
        if key in self._memo:
            return self._memo[key]
        store = sources.Checkpoints(settings.checkpoint_folder) if settings.checkpoint_folder else None
        df, begin = None, 0
        if store:
            for i in range(len(digests) - 1, -1, -1):
                df = store.get(spark, plan.nodes[i].name, digests[i])
                if df is not None:
                    begin = i + 1
                    break
        df = self.source(spark) if df is None else df
        for i, n in enumerate(plan.nodes[begin:], begin):
            params = {k: v.to_df(spark) if isinstance(v, Frame) else v for k, v in n.params.items()}
            df = OPERATORS[n.kind](df, **params)
            if store and n.traits.paid:
                df = store.put(df, n.name, digests[i])
        self._memo[key] = df
        return df

    def collect(self, spark: SparkSession | None = None) -> list[dict]:
        return [r.asDict(recursive=True) for r in self.to_df(spark).collect()]

    def to_pandas(self, spark: SparkSession | None = None):
        return self.to_df(spark).toPandas()

    def count(self, spark: SparkSession | None = None) -> int:
        return self.to_df(spark).count()

    def show(self, n: int = 5, spark: SparkSession | None = None) -> None:
        self.to_df(spark).show(n)

    def write_json(self, path: str, spark: SparkSession | None = None) -> None:
        sources.write(self.to_df(spark), path)

    write_csv = write_parquet = write_json

    # Configuration

    def to_config(self) -> dict:
        """Source and steps as plain data; raises if a step holds code or a client."""
        out = {"source": self.origin, "steps": [{"operator": n.kind, "name": n.name, **n.params} for n in self.steps.nodes]}
        return json.loads(json.dumps(out))

    @staticmethod
    def from_config(config: dict) -> "Frame":
        kind, path = config["source"]["kind"], config["source"]["path"]
        frame = READERS[kind](path)
        for s in config["steps"]:
            frame = frame._add(s["operator"], **{k: v for k, v in s.items() if k != "operator"})
        return frame

    def to_yaml(self) -> str:
        """JSON, which is YAML."""
        return json.dumps(self.to_config(), indent=2)

    @staticmethod
    def from_yaml(text: str) -> "Frame":
        try:
            import yaml
        except ImportError:
            return Frame.from_config(json.loads(text))
        return Frame.from_config(yaml.safe_load(text))


def _positional(kind: str, args: tuple) -> dict:
    import inspect

    names = list(inspect.signature(OPERATORS[kind]).parameters)[1:]
    return dict(zip(names, args, strict=False))


def _session(spark: SparkSession | None) -> SparkSession:
    return spark or SparkSession.builder.getOrCreate()


def _from_path(kind: str, reader: Callable[[SparkSession, str], DataFrame]):
    def read(path: str, parsing: list[dict] | None = None) -> Frame:
        def load(spark: SparkSession) -> DataFrame:
            df = reader(spark, path)
            return sources.parse(df, parsing) if parsing else df

        return Frame(load, f"{kind}:{path}", origin={"kind": kind, "path": path})

    return read


read_json = _from_path("json", sources.read_json)
read_csv = _from_path("csv", sources.read_csv)
read_parquet = _from_path("parquet", sources.read_parquet)
read_directory = _from_path("directory", sources.read_directory)
READERS = {"json": read_json, "csv": read_csv, "parquet": read_parquet, "directory": read_directory}


def read_rows(rows: list[dict], schema: str | None = None) -> Frame:
    digest = hashlib.md5(json.dumps(rows, sort_keys=True, default=repr).encode()).hexdigest()
    return Frame(lambda spark: sources.from_rows(spark, rows, schema), f"rows:{digest}")


def from_dataframe(df: DataFrame, label: str = "dataframe") -> Frame:
    return Frame(lambda _: df, label)
