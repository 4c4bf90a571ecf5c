"""Pages and searches as operators; what they fetch comes from a client or a table, so that they run without a network."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import absolute_links, html_body, to_markdown


def fetch_pages(df: DataFrame, pages: DataFrame, *, url_key: str, output_key: str = "content", page_url: str = "url", page_html: str = "html", same: list[str] = (), body_only: bool = False, markdown: bool = False, absolute: bool = False) -> DataFrame:
    """The page of each URL (or of each URL of a list) from a table; ``ERROR: ...`` where there is none.

    A URL may have several pages: ``same`` names the columns of both tables that say which one a row is about (as a
    page's id or the time of its fetch). Of the pages that this leaves it is the one of least content.
    """
    many = isinstance(df.schema[url_key].dataType, T.ArrayType)
    content = html_body(F.col("__html")) if body_only else F.col("__html")
    if absolute:

        def fix(html: pd.Series, base: pd.Series) -> pd.Series:
            return pd.Series([absolute_links(h, b) if h is not None else None for h, b in zip(html, base, strict=True)])

        fix.__annotations__ = {"html": pd.Series, "base": pd.Series, "return": pd.Series}
        content = F.pandas_udf(fix, T.StringType())(content, F.col("__url"))
    if markdown:

        def plain(html: pd.Series) -> pd.Series:
            return html.map(lambda h: to_markdown(h) if h is not None else None)

        plain.__annotations__ = {"html": pd.Series, "return": pd.Series}
        content = F.pandas_udf(plain, T.StringType())(content)
    which = [F.col(c).alias(f"__same_{c}") for c in same]
    known = pages.select(F.col(page_url).alias("__page"), *which, F.col(page_html).alias("__html")).groupBy("__page", *[f"__same_{c}" for c in same]).agg(F.min("__html").alias("__html"))
    found = F.col("__url") == F.col("__page")
    for c in same:
        found = found & F.col(c).eqNullSafe(F.col(f"__same_{c}"))
    error = F.concat(F.lit("ERROR: no page at "), F.coalesce("__url", F.lit("null")))
    content = F.when(F.col("__page").isNull(), error).otherwise(content)  # a page without content is a page
    if not many:
        out = df.withColumn("__url", F.col(url_key)).join(known, found, "left")
        return out.withColumn(output_key, content).drop("__url", "__page", "__html", *[f"__same_{c}" for c in same])
    each = df.select(url_key, *same).distinct().select(F.col(url_key).alias("__list"), *same, F.posexplode(url_key).alias("__at", "__url"))
    each = each.join(known, found, "left").withColumn("__c", content).withColumnsRenamed({c: f"__of_{c}" for c in same})
    lists = each.groupBy("__list", *[f"__of_{c}" for c in same]).agg(F.transform(F.array_sort(F.collect_list(F.struct("__at", "__c"))), lambda s: s["__c"]).alias(output_key))
    own = df[url_key] == lists["__list"]
    for c in same:
        own = own & df[c].eqNullSafe(lists[f"__of_{c}"])
    return df.join(lists, own, "left").drop("__list", *[f"__of_{c}" for c in same])


def _client_column(fetch: Callable[[str], object], kind: T.DataType, failed: Callable[[str], object]):
    def each(values: pd.Series) -> pd.Series:
        out = []
        for v in values:
            try:
                out.append(fetch(v))
            except Exception as e:  # noqa: BLE001  a failed call is a value here
                out.append(failed(str(e)))
        return pd.Series(out)

    each.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return F.pandas_udf(each, kind)


def web_fetch(df: DataFrame, *, url_key: str, fetch: Callable[[str], str], output_key: str = "content") -> DataFrame:
    """Pages by a client, called once per distinct URL."""
    urls = df.select(F.col(url_key).alias("__url")).distinct()
    got = urls.withColumn(output_key, _client_column(fetch, T.StringType(), lambda e: f"ERROR: {e}")(F.col("__url")))
    return df.join(got, df[url_key].eqNullSafe(got["__url"]), "left").drop("__url")


def web_search(df: DataFrame, *, query: str, search: Callable[[str], list[dict]], output_key: str = "results", max_results: int = 5) -> DataFrame:
    """Results {title, description, url} of a query template by a client; a failed search is one result that says so."""
    from ..functions.templates import Template

    kind = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("title", "description", "url")]))
    call = _client_column(lambda q: search(q)[:max_results], kind, lambda e: [{"title": "ERROR", "description": e, "url": ""}])
    return df.withColumn(output_key, call(Template(query).column()))
