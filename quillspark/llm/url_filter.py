"""URL filter: domain rules first, gradient-boosted trees on lexical features for the rest.

The trees are trained where the rules decide: the URLs that a rule matches are the labelled ones. Training is a
histogram method in DataFrame aggregates: every level of a tree is one aggregate of integer gradients by node, feature
and bin, of which the driver sees ``nodes x features x bins`` sums, whatever the number of rows. Gradients are whole
millionths, so sums and with them trees don't depend on the order of rows. The trees then become nested CASE
expressions, so scoring stays in generated code. Nothing here runs Python on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, materialize

#: (rule, verdict); a rule is a host and a path joined, cut at the first slash.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
FEATURES = ("url_len", "host_len", "path_len", "depth", "digit_pct", "entropy_pct", "params", "host_labels", "hyphens", "https", "fragment", "longest_digits", "suffix_rate", "suffix2_rate")
UNIT = 1_000_000


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): the host after the first ``://`` with A-Z lower-cased; both empty for null or without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    take = lambda k: F.coalesce(F.regexp_extract(url, pattern, k), F.lit(""))
    return F.translate(take(1), UPPER, UPPER.lower()), take(2)


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits the host or a parent domain of it and the start of the path, else null."""
    out: Column = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the last WHEN put on is the first tried
        own, slash, tail = rule.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(slash + tail)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def lexical_features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Whole-number features of one URL (null counts as empty); the suffix statistics come from training."""
    url = F.coalesce(url, F.lit(""))
    n = F.length(url)
    count = lambda s, chars: F.length(s) - F.length(F.translate(s, chars, ""))
    each = F.array_distinct(F.split(url, ""))
    entropy = F.aggregate(each, F.lit(0.0), lambda a, c: F.when(c == "", a).otherwise(a - (share := (n - F.length(F.replace(url, c, F.lit("")))) / n) * F.log2(share)))
    whole = {
        "url_len": n,
        "host_len": F.length(host),
        "path_len": F.length(path),
        "depth": count(path, "/"),
        "digit_pct": F.when(n > 0, F.floor(100 * count(url, "0123456789") / n)).otherwise(0),
        "entropy_pct": F.when(n > 0, F.floor(100 * entropy)).otherwise(0),
        "params": F.when(F.contains(url, F.lit("?")), 1 + count(url, "&")).otherwise(0),
        "host_labels": 1 + count(host, "."),
        "hyphens": count(url, "-_"),
        "https": url.startswith("https://").cast("int"),
        "fragment": F.contains(url, F.lit("#")).cast("int"),
        "longest_digits": F.coalesce(F.array_max(F.transform(F.regexp_extract_all(url, F.lit("[0-9]+"), F.lit(0)), F.length)), F.lit(0)),
    }
    return {k: v.cast("long") for k, v in whole.items()}


def suffix(host: Column, labels: int) -> Column:
    return F.substring_index(host, ".", -labels)


@dataclass
class Boosted:
    """Trees as nested tuples (feature, bound, if at most, else) with leaves in millionths; suffix rates in thousandths."""

    prior: int = 0
    trees: list = field(default_factory=list)
    base_rate: int = 500
    rates: DataFrame | None = None

    def score(self) -> Column:
        """Millionths of the log odds of block, over the feature columns."""
        total: Column = F.lit(self.prior)
        for tree in self.trees:
            total = total + _case(tree)
        return total

    def with_rates(self, rows: DataFrame) -> DataFrame:
        """Add suffix_rate and suffix2_rate; rates has a row per suffix of the training sample at most, so it's broadcast."""
        for k, name in ((1, "suffix_rate"), (2, "suffix2_rate")):
            if self.rates is None:
                rows = rows.withColumn(name, F.lit(self.base_rate).cast("long"))
                continue
            own = self.rates.where(F.col("labels") == k).select(F.col("suffix").alias("__suffix"), F.col("rate").alias("__rate"))
            rows = rows.join(F.broadcast(own), suffix(F.col("host"), k) == F.col("__suffix"), "left")
            rows = rows.withColumn(name, F.coalesce("__rate", F.lit(self.base_rate))).drop("__suffix", "__rate")
        return rows


def _case(tree) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(int(tree))
    name, bound, low, high = tree
    return F.when(F.col(name) <= bound, _case(low)).otherwise(_case(high))


def _node(tree, at: int = 1) -> Column:
    """The number of the open leaf that a row falls in: children of k are 2k and 2k+1."""
    if not isinstance(tree, tuple):
        return F.lit(at)
    name, bound, low, high = tree
    return F.when(F.col(name) <= bound, _node(low, 2 * at)).otherwise(_node(high, 2 * at + 1))


def _split(tree, splits: dict, at: int = 1):
    if isinstance(tree, tuple):
        return (*tree[:2], _split(tree[2], splits, 2 * at), _split(tree[3], splits, 2 * at + 1))
    return splits.get(at, tree)


def train(labelled: DataFrame, *, sample_rows: int = 20_000, rounds: int = 5, depth: int = 3, rate: float = 0.4, bins: int = 12, ridge: float = 1.0) -> Boosted:
    """Fit on at most ``sample_rows`` labelled rows (those of lowest URL hash): url, host, path and block (0 or 1).

    Without both classes the model is the prior alone.
    """
    sample = labelled.orderBy(F.xxhash64("url"), "url").limit(sample_rows)
    sample = materialize(sample.select("url", "host", "path", "block", *[c.alias(k) for k, c in lexical_features(F.col("url"), F.col("host"), F.col("path")).items()]), "url-sample")
    n, blocked = sample.agg(F.count("*"), F.coalesce(F.sum("block"), F.lit(0))).first()
    model = Boosted()
    if not n:
        return model
    model.base_rate = 1000 * blocked // n
    if blocked in (0, n):
        model.prior = (4 if blocked else -4) * UNIT
        return model
    each = sample.select("block", F.explode(F.array(*[F.struct(F.lit(k).alias("labels"), suffix(F.col("host"), k).alias("suffix")) for k in (1, 2)])).alias("s"))
    # Smoothed by ten rows at the mean rate.
    model.rates = materialize(each.groupBy("s.labels", "s.suffix").agg(F.expr(f"(1000 * sum(block) + 10 * {model.base_rate}) div (count(*) + 10)").alias("rate")), "url-suffixes")
    rows = materialize(model.with_rates(sample).select("block", *FEATURES), "url-features")
    shares = [(i + 1) / bins for i in range(bins - 1)]
    cuts = rows.agg(*[F.percentile_approx(k, shares, 100_000).alias(k) for k in FEATURES]).first()
    bounds = {k: sorted(set(cuts[k])) for k in FEATURES}
    for _ in range(rounds):
        tree = 0
        for level in range(depth):
            p = 1 / (1 + F.exp(-model.score() / UNIT))
            binned = [F.array(F.lit(i), sum(((F.col(k) > b).cast("int") for b in bounds[k]), F.lit(0))) for i, k in enumerate(FEATURES)]
            at = rows.select(_node(tree).alias("node"), F.round((F.col("block") - p) * UNIT).cast("long").alias("g"), F.round(p * (1 - p) * UNIT).cast("long").alias("h"), F.explode(F.array(*binned)).alias("b"))
            sums: dict = {}
            for r in at.groupBy("node", F.col("b")[0].alias("f"), F.col("b")[1].alias("bin")).agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
                sums.setdefault(r.node, {}).setdefault(r.f, {})[r.bin] = (r.g, r.h)
            splits = {}
            leaf = lambda g, h: int(rate * UNIT * (g / UNIT) / (h / UNIT + ridge))
            worth = lambda g, h: (g / UNIT) ** 2 / (h / UNIT + ridge)
            for node, by in sums.items():
                if node >> level != 1:  # closed before
                    continue
                g, h = (sum(x[i] for x in by[0].values()) for i in (0, 1))
                best, splits[node] = 1e-6, leaf(g, h)
                for f, found in sorted(by.items()):
                    lg = lh = 0
                    for b, bound in enumerate(bounds[FEATURES[f]]):
                        lg, lh = lg + found.get(b, (0, 0))[0], lh + found.get(b, (0, 0))[1]
                        gain = worth(lg, lh) + worth(g - lg, h - lh) - worth(g, h)
                        if gain > best + 1e-9:
                            best, splits[node] = gain, (FEATURES[f], bound, leaf(lg, lh), leaf(g - lg, h - lh))
            tree = _split(tree, splits)
        model.trees.append(tree)
    return model


def filter_urls(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules=RULES, **training) -> DataFrame:
    """Judge every URL: id, host, path, rule (null without one), verdict (``allow`` or ``block``), log_odds of block.

    A null URL, or one without ``://``, has an empty host and path, no rule, and gets the model's verdict like any
    other. Ids may be null or repeat: rows are judged one by one. Other columns are ignored; an empty table gives no
    rows. ``training`` goes to :func:`train`.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    host, path = split_url(F.col("url"))
    rows = rows.select("*", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
    blocks = [rule for rule, verdict in rules if verdict == "block"]
    ruled = F.when(F.col("rule").isNotNull(), F.when(F.col("rule").isin(blocks), F.lit("block")).otherwise(F.lit("allow")))
    model = train(rows.where("rule is not null").withColumn("block", (ruled == "block").cast("int")), **training)
    whole = lexical_features(F.col("url"), F.col("host"), F.col("path"))
    rows = model.with_rates(rows.select("*", *[c.alias(k) for k, c in whole.items()]))
    rows = rows.withColumn("log_odds", model.score() / UNIT)
    return rows.select("page_id", "host", "path", "rule", F.coalesce(ruled, F.when(F.col("log_odds") > 0, "block").otherwise("allow")).alias("verdict"), "log_odds")
