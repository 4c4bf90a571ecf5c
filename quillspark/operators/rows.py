"""Row-wise operators: map, parallel map, filter, code map and filter, extract, unnest, ids."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.models import Call, CallTable, Expressions
from ..functions.schema import Kind, parse_schema
from ..functions.templates import Template

ORD = "__ord"


def first_rows(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    return df.orderBy(*order).limit(n)


def model_struct(df: DataFrame, into: str, *, prompt: str, kinds: dict[str, Kind], model, retries: int = 2, validate=(), gleaning=None, calls: CallTable | None = None, config: dict | None = None) -> DataFrame:
    """``df`` with the struct ``into`` (ok, calls, outputs). SQL rules and enum checks of an expression model decide ok."""
    if isinstance(model, Expressions):
        out = df.withColumn("__out", model.column(kinds))
        ok = F.lit(True)
        for name, kind in kinds.items():
            ok = ok & kind.check(F.col("__out")[name])
        for rule in validate:
            ok = ok & F.coalesce(_rule(rule, kinds), F.lit(False))
        return out.withColumn(into, F.struct(ok.alias("ok"), F.lit(0).alias("calls"), *[F.col("__out")[n].alias(n) for n in kinds])).drop("__out")
    template = Template(prompt)
    text = template.column() if template.plain else _rendered(template, df)
    call = Call(model, kinds, retries, list(validate), gleaning)
    if calls is not None:
        return calls.answered(df, text, call, {"prompt": prompt, **(config or {})}, into)
    # Behind a generator a filter on the answer can't be pushed into a second copy of the call; other filters still pass it.
    return df.withColumn(into, F.explode_outer(F.array(call.column(text))))


def _rule(rule: str, kinds: dict[str, Kind]) -> Column:
    """A SQL expression in which ``output.x`` is the output x."""
    for name in kinds:
        rule = rule.replace(f"output.{name}", f"__out.`{name}`")
    return F.expr(rule)


def _rendered(template: Template, df: DataFrame) -> Column:
    fields = template.reads
    row = F.struct(*[F.col(c) for c in (sorted(fields) if fields is not None else df.columns)])

    def each(rows: pd.DataFrame) -> pd.Series:
        return pd.Series([template.render(**{template.root: r}) for r in rows.to_dict("records")])

    each.__annotations__ = {"rows": pd.DataFrame, "return": pd.Series}
    return F.pandas_udf(each, T.StringType())(row)


def _merged(df: DataFrame, struct: str, names: list[str]) -> DataFrame:
    """Outputs over the row: an output of an existing name replaces it in place."""
    out = df.withColumns({n: F.col(struct)[n] for n in names})
    return out.drop(struct)


def map_rows(df: DataFrame, *, output: dict[str, str], model, prompt: str = "", name: str = "map", drop_keys=(), limit: int | None = None, order: list[str] | None = None, keep_failed: bool = False, observe: bool = False, **options) -> DataFrame:
    """Typed outputs of one call per row, merged over the row; rows whose answer stays invalid go (or keep nulls).

    ``limit`` takes the first rows by ``order`` before any call. ``observe`` adds the rendered prompt.
    """
    if limit is not None:
        df = first_rows(df, limit, order or df.columns[:1])
    if not output:
        return df.drop(*drop_keys)
    kinds = parse_schema(output)
    if observe:
        df = df.withColumn(f"_observability_{name}", F.struct((Template(prompt).column() if prompt else F.lit("")).alias("prompt")))
    df = model_struct(df, "__m", prompt=prompt, kinds=kinds, model=model, **options)
    if not keep_failed:
        df = df.where(F.col("__m.ok"))
    return _merged(df, "__m", list(kinds)).drop(*drop_keys)


def map_many(df: DataFrame, *, prompt: str, output: dict[str, str], model, n: int, **options) -> DataFrame:
    """``n`` answers per row, a row for each with its number ``choice`` (from 1)."""
    each = df.withColumn("choice", F.explode(F.sequence(F.lit(1), F.lit(n))))
    return map_rows(each, prompt=prompt + "\n\nChoice {{ input.choice }}", output=output, model=model, **options)


def parallel_map(df: DataFrame, *, prompts: list[dict], output: dict[str, str], model, drop_keys=(), **options) -> DataFrame:
    """Independent prompts on each row, their outputs merged into it. prompts: {prompt, output_keys, model?}."""
    names = []
    for k, p in enumerate(prompts):
        kinds = parse_schema({key: output.get(key, "string") for key in p["output_keys"]})
        df = model_struct(df, f"__m{k}", prompt=p.get("prompt", ""), kinds=kinds, model=p.get("model", model), **options)
        names.append(list(kinds))
    for k in range(len(prompts)):
        df = df.where(F.col(f"__m{k}.ok"))
    for k, own in enumerate(names):
        df = _merged(df, f"__m{k}", own)
    return df.drop(*drop_keys)


def filter_rows(df: DataFrame, *, output: dict[str, str], model, prompt: str = "", limit: int | None = None, order: list[str] | None = None, **options) -> DataFrame:
    """Rows whose one boolean output is true; it isn't kept. ``limit`` counts kept rows, in ``order``."""
    kinds = parse_schema(output)
    decisions = [n for n, k in kinds.items() if n != "_short_explanation"]
    if len(decisions) != 1 or kinds[decisions[0]].name != "boolean":
        raise ValueError("a filter has exactly one boolean output")
    df = model_struct(df, "__m", prompt=prompt, kinds=kinds, model=model, **options)
    df = df.where(F.col("__m.ok") & F.col(f"__m.{decisions[0]}"))
    df = _merged(df, "__m", [n for n in kinds if n != decisions[0]])
    return first_rows(df, limit, order or df.columns[:1]) if limit is not None else df


def code_map(df: DataFrame, code: dict[str, Column] | Callable[[dict], dict], *, output: T.StructType | str | None = None, drop_keys=(), limit: int | None = None, order: list[str] | None = None, reads: list[str] | None = None) -> DataFrame:
    """Columns (preferred), or a Python function from row to dict with the ``output`` schema, merged over the row."""
    if limit is not None:
        df = first_rows(df, limit, order or df.columns[:1])
    if isinstance(code, dict):
        return df.withColumns({n: c for n, c in code.items() if n not in drop_keys})
    schema = T._parse_datatype_string(output) if isinstance(output, str) else output

    def each(rows: pd.DataFrame) -> pd.DataFrame:
        made = [code(r) for r in rows.to_dict("records")]
        return pd.DataFrame([{n: m.get(n) for n in schema.names} for m in made], columns=schema.names)

    each.__annotations__ = {"rows": pd.DataFrame, "return": pd.DataFrame}
    row = F.struct(*[F.col(c) for c in (reads or df.columns)])
    df = df.withColumn("__m", F.pandas_udf(each, schema)(row))
    return _merged(df, "__m", [n for n in schema.names if n not in drop_keys])


def code_filter(df: DataFrame, code: Column | str | Callable[[dict], bool], *, limit: int | None = None, order: list[str] | None = None, reads: list[str] | None = None) -> DataFrame:
    """Rows for which a column, a SQL expression or a Python predicate holds; ``limit`` counts kept rows."""
    if isinstance(code, (Column, str)):
        df = df.where(code)
    else:

        def each(rows: pd.DataFrame) -> pd.Series:
            return pd.Series([bool(code(r)) for r in rows.to_dict("records")])

        each.__annotations__ = {"rows": pd.DataFrame, "return": pd.Series}
        df = df.where(F.pandas_udf(each, T.BooleanType())(F.struct(*[F.col(c) for c in (reads or df.columns)])))
    return first_rows(df, limit, order or df.columns[:1]) if limit is not None else df


def wrapped_lines(text: str, width: int = 80) -> list[str]:
    """Lines of at most ``width`` characters, cut at blanks; longer words are cut."""
    out = []
    for line in text.split("\n"):
        while len(line) > width:
            at = line.rfind(" ", 1, width + 1)
            at = at if at > 0 else width
            out.append(line[:at])
            line = line[at:].lstrip(" ")
        out.append(line)
    return out


def numbered(lines: list[str]) -> str:
    return "\n".join(f"{i:4d}: {line}" for i, line in enumerate(lines, 1))


def extract_lines(df: DataFrame, *, key: str, name: str, ranges: Callable[[str], list[tuple[int, int]]], suffix: str | None = None, joined: bool = True, width: int = 80) -> DataFrame:
    """The wrapped lines that ``ranges`` (numbered text to ranges from 1, inclusive) picks; a range's lines are put
    together without a separator, equal pieces go, pieces join by a blank line."""

    def each(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            lines = wrapped_lines(t or "", width)
            pieces = ["".join(lines[max(1, a) - 1 : b]) for a, b in ranges(numbered(lines))]
            out.append(list(dict.fromkeys(p for p in pieces if p)))
        return pd.Series(out)

    each.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    found = F.pandas_udf(each, T.ArrayType(T.StringType()))(F.col(key))
    return df.withColumn(key + (suffix or f"_extracted_{name}"), F.array_join(found, "\n\n") if joined else found)


def extract_patterns(df: DataFrame, *, key: str, name: str, patterns: list[str], suffix: str | None = None, joined: bool = True) -> DataFrame:
    """All matches of the patterns (a dot matches line ends too; with one group, the group), equal ones once."""
    groups = [p.replace("\\(", "").replace("(?", "").count("(") for p in patterns]
    if any(g > 1 for g in groups):
        raise ValueError("a pattern has one group at most")
    found = F.flatten(F.array(*[F.regexp_extract_all(F.col(key), F.lit(f"(?s){p}"), F.lit(g)) for p, g in zip(patterns, groups, strict=True)]))
    found = F.array_distinct(F.coalesce(found, F.array().cast("array<string>")))
    return df.withColumn(key + (suffix or f"_extracted_{name}"), F.array_join(found, "\n\n") if joined else found)


def unnest(df: DataFrame, key: str, *, keep_empty: bool = False, expand_fields: list[str] | None = None, recursive: bool = False, depth: int | None = None) -> DataFrame:
    """One row per element of a list; fields of a struct beside it.

    Null and empty lists give no row, or one with null if ``keep_empty``. ``recursive`` flattens nested lists, of
    ``depth`` levels at most. A path ``a.b`` goes to ``__unnest_value__``. Other types raise.
    """
    kind = df.select(F.col(key)).schema[0].dataType
    into = "__unnest_value__" if "." in key else key
    if isinstance(kind, T.StructType):
        return df.withColumns({f: F.col(key)[f] if f in kind.names else F.lit(None) for f in (expand_fields or kind.names)})
    if not isinstance(kind, T.ArrayType):
        raise TypeError(f"{key} is neither a list nor a struct: {kind.simpleString()}")
    value, item, level = F.col(key), kind.elementType, 1
    while recursive and isinstance(item, T.ArrayType) and (depth is None or level < depth):
        value, item, level = F.flatten(F.filter(value, lambda x: x.isNotNull())), item.elementType, level + 1
    df = df.withColumn(into, F.explode_outer(value) if keep_empty else F.explode(value))
    if expand_fields and isinstance(item, T.StructType):
        df = df.withColumns({f: F.col(into)[f] for f in expand_fields})
    return df


def unnest_columns(df: DataFrame, key: str, keys: list[str] | None = None) -> DataFrame:
    """A struct's fields (or the listed ones, null where absent) as columns; the struct goes."""
    kind = df.schema[key].dataType
    if not isinstance(kind, T.StructType):
        raise TypeError(f"{key} is no struct: {kind.simpleString()}")
    out = {f: F.col(key)[f] if f in kind.names else F.lit(None).cast("string") for f in (keys or kind.names)}
    return df.withColumns({n: c for n, c in out.items() if n != key}).drop(key) if key not in out else df.withColumns(out)


def add_uuid(df: DataFrame, *, name: str = "add_uuid", id_key: str | None = None, of: list[str] | None = None) -> DataFrame:
    """A fresh id per row, or one made of the columns ``of`` (the same in every run)."""
    own = F.uuid() if of is None else F.md5(F.concat_ws("\x01", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in of]).cast("binary"))
    return df.withColumn(id_key or f"{name}_id", own)
