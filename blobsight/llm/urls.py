"""URL filters: rules by host and path, and gradient-boosted trees on lexical features for the rest.

Trees are grown from histograms: one aggregation per level sums gradients and curvatures by node, feature and bin, and
only those sums reach the driver. A trained model is compiled into one column of nested CASE WHEN, so scoring is a
projection.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blobsight.llm.common import ascii_lower
from blobsight.scratch import materialise

# Host, path, verdict.
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)

# Words in a host that mark the labelled URLs as unwanted.
UNWANTED = ("casino", "pills", "bets", "spam", "adult", "porn", "ads-", "viagra", "lottery")

#: Labelled URLs that training takes, the first by hash: a bound on what is fitted, not on what is judged.
MOST_LABELLED = 20_000
TREES, DEPTH, BINS, RATE, L2 = 10, 3, 16, 0.4, 1.0
#: So many URLs of the average kind are added to each suffix.
SMOOTH = 4.0


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path. Null or no ``://``: both empty."""
    get = lambda i: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", i), F.lit(""))
    return ascii_lower(get(1)), get(2)


def rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null where none fits."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits; 0 for an empty text."""
    n = F.length(text).cast("double")
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    bits = F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda a, c: a + F.when(c == "", 0.0).otherwise(-share(c) * F.log2(share(c))))
    return F.when(n > 0, bits).otherwise(F.lit(0.0))


def suffix(host: Column, labels: int) -> Column:
    return F.substring_index(host, ".", -labels)


def features(urls: DataFrame) -> DataFrame:
    """Adds lexical features f_* and the suffixes s_1, s_2 to ``urls`` (url)."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    host, path = parts(F.col("url").cast("string"))
    digits = lambda c: F.length(c) - F.length(F.translate(c, "0123456789", ""))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    count = lambda c, x: F.length(c) - F.length(F.translate(c, x, ""))
    query = F.when(url.contains("?"), F.substring_index(F.substring_index(url, "#", 1), "?", -1)).otherwise(F.lit(""))
    out = urls.withColumn("_h", host).withColumn("_p", path).withColumn("_q", query)
    h, p, q = F.col("_h"), F.col("_p"), F.col("_q")
    return out.withColumns({
        "f_length": F.length(url).cast("double"),
        "f_host_length": F.length(h).cast("double"),
        "f_depth": count(p, "/").cast("double"),
        "f_labels": count(h, ".").cast("double"),
        "f_digits": ratio(digits(url), F.length(url)),
        "f_host_digits": ratio(digits(h), F.length(h)),
        "f_hyphens": count(h, "-").cast("double"),
        "f_parameters": F.when(q == "", 0.0).otherwise(count(q, "&") + 1.0),
        "f_entropy": entropy(h),
        "f_path_entropy": entropy(p),
        "f_longest": F.array_max(F.transform(F.split(h, "[.]"), F.length)).cast("double"),
        "s_1": suffix(h, 1),
        "s_2": suffix(h, 2),
    }).drop("_h", "_p", "_q")


LEXICAL = ("f_length", "f_host_length", "f_depth", "f_labels", "f_digits", "f_host_digits", "f_hyphens", "f_parameters", "f_entropy", "f_path_entropy", "f_longest")
INPUTS = (*LEXICAL, "r_1", "r_2")


@dataclass
class Node:
    feature: str = ""
    bound: float = 0.0
    value: float = 0.0
    low: Node | None = None
    high: Node | None = None

    def column(self) -> Column:
        if self.low is None:
            return F.lit(self.value)
        return F.when(F.col(self.feature) <= self.bound, self.low.column()).otherwise(self.high.column())


@dataclass
class Model:
    base: float
    prior: float
    trees: list[Node] = field(default_factory=list)
    suffixes: DataFrame | None = None

    def margin(self) -> Column:
        return sum((t.column() for t in self.trees), F.lit(self.base))

    def with_suffixes(self, rows: DataFrame, own: str | None = None) -> DataFrame:
        """Adds r_1, r_2: the share of unwanted URLs by suffix, drawn towards the share of all. The table has at most two
        rows a labelled URL, so its size has a bound and it is broadcast. ``own`` names a training row's label: it is left
        out of that row's shares, which would give it away otherwise."""
        less, one = (F.col(own), F.lit(1.0)) if own else (F.lit(0.0), F.lit(0.0))
        for i in (1, 2):
            t = self.suffixes.where(F.col("labels") == i).select(F.col("suffix").alias(f"s_{i}"), "bad", "n")
            share = (F.col("bad") - less + SMOOTH * self.prior) / (F.col("n") - one + SMOOTH)
            rows = rows.join(F.broadcast(t), f"s_{i}", "left").withColumn(f"r_{i}", F.coalesce(share, F.lit(self.prior))).drop("bad", "n")
        return rows

    def score(self, urls: DataFrame) -> DataFrame:
        """``urls`` (url) with ``p_block``."""
        rows = self.with_suffixes(features(urls))
        return rows.withColumn("p_block", 1 / (1 + F.exp(-self.margin()))).drop(*LEXICAL, "r_1", "r_2", "s_1", "s_2")


def labelled(urls: DataFrame, unwanted=UNWANTED) -> DataFrame:
    """(url, label): URLs labelled 1 if their host has an unwanted word; labels for want of better ones."""
    host, _ = parts(F.col("url").cast("string"))
    test = F.lit(False)
    for w in unwanted:
        test = test | host.contains(w)
    return urls.where("url is not null").select("url", test.cast("int").alias("label"))


def train(rows: DataFrame, most: int = MOST_LABELLED, trees: int = TREES, depth: int = DEPTH, bins: int = BINS) -> Model:
    """Boosted trees for ``rows`` (url, label 0/1). Takes the ``most`` different URLs that come first by their hash, each
    with the highest of its labels; without any the model allows everything. Null URLs and labels are left out."""
    once = rows.where("url is not null and label is not null").groupBy("url").agg(F.max("label").cast("double").alias("y"))
    some = materialise(features(once.withColumn("o", F.xxhash64("url")).orderBy("o", "url").limit(most)), "labelled")
    n, y = some.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    prior = (y + 0.5) / (n + 1.0)
    model = Model(math.log(prior / (1 - prior)), prior)
    stat = lambda i: some.groupBy(F.col(f"s_{i}").alias("suffix")).agg(F.sum("y").alias("bad"), F.count("*").cast("double").alias("n")).withColumn("labels", F.lit(i))
    model.suffixes = materialise(stat(1).unionByName(stat(2)), "suffixes")
    if n == 0 or y in (0, n):
        return model
    data = model.with_suffixes(some, "y")
    cuts = [i / bins for i in range(1, bins)]
    bounds = data.agg(*[F.percentile_approx(c, cuts, 1000).alias(c) for c in INPUTS]).first()
    bounds = {c: sorted(set(bounds[c])) for c in INPUTS}
    for c in INPUTS:
        data = data.withColumn(f"b_{c}", sum((F.when(F.col(c) > b, 1).otherwise(0) for b in bounds[c]), F.lit(0)))
    data = materialise(data.select("y", *INPUTS, *[f"b_{c}" for c in INPUTS]), "binned")
    for _ in range(trees):
        model.trees.append(_grow(data, model, bounds, depth))
    return model


def _grow(data: DataFrame, model: Model, bounds: dict, depth: int) -> Node:
    p = 1 / (1 + F.exp(-model.margin()))
    root = Node()
    rows = data.withColumn("p", p).withColumn("g", F.col("p") - F.col("y")).withColumn("h", F.col("p") * (1 - F.col("p")))
    level = [root]
    for _ in range(depth):  # the last level's leaves get their values from the sums of the one above
        at = _place(root, {id(x): i for i, x in enumerate(level)})
        kinds = F.explode(F.array(*[F.struct(F.lit(c).alias("f"), F.col(f"b_{c}").alias("b")) for c in INPUTS]))
        sums = rows.select(at.alias("node"), "g", "h", kinds.alias("k")).where("node >= 0").groupBy("node", "k.f", "k.b").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
        by: dict = {}
        for r in sums.collect():  # nodes x features x bins rows
            by.setdefault(r.node, {}).setdefault(r.f, {})[r.b] = (r.g, r.h)
        grown = []
        for i, node in enumerate(level):
            stats = by.get(i, {})
            if not stats:
                continue
            one = next(iter(stats.values()))
            g, h = sum(x for x, _ in one.values()), sum(x for _, x in one.values())
            node.value = -RATE * g / (h + L2)
            best, sides = (1e-6, "", 0), ((0.0, 0.0), (0.0, 0.0))
            for f in sorted(stats):
                lg = lh = 0.0
                for b in range(len(bounds[f])):
                    x = stats[f].get(b, (0.0, 0.0))
                    lg, lh = lg + x[0], lh + x[1]
                    gain = lg * lg / (lh + L2) + (g - lg) ** 2 / (h - lh + L2) - g * g / (h + L2)
                    if lh > 1e-3 and h - lh > 1e-3 and gain > best[0] + 1e-9:
                        best, sides = (gain, f, b), ((lg, lh), (g - lg, h - lh))
            if best[1]:
                node.feature, node.bound = best[1], float(bounds[best[1]][best[2]])
                node.low, node.high = (Node(value=-RATE * x / (y + L2)) for x, y in sides)
                grown += [node.low, node.high]
        if not grown:
            break
        level = grown
    return root


def _place(node: Node, ids: dict) -> Column:
    """The index of the open node that a row is in; -1 in a finished leaf."""
    if node.low is None:
        return F.lit(ids.get(id(node), -1))
    return F.when(F.col(node.feature) <= node.bound, _place(node.low, ids)).otherwise(_place(node.high, ids))


def judge(pages: DataFrame, model: Model | None = None, rules=RULES, limit: float = 0.5, labels: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, p_block) for every row of ``pages`` (page_id, url; others are left out).

    A rule's verdict stands; where none fits, the model blocks at p_block of ``limit`` and more. Without a ``model``, one
    is trained on ``labels`` (url, label 0/1), and without these on ``labelled(pages)``. A null URL, or one without ``://``, has
    empty host and path, fits no rule and is judged by the model like any other, and so are empty and very long ones. Of the
    rules that fit, the one with the longest host and path wins, of equal ones the last listed. Repeated rows, and rows of one
    page_id or none, each have their verdict. An empty table gives an empty one.
    """
    model = model or train(labelled(pages) if labels is None else labels)
    host, path = parts(F.col("url").cast("string"))
    name, verdict = rule(F.col("host"), F.col("path"), rules)
    rows = model.score(pages.select("page_id", "url")).withColumn("host", host).withColumn("path", path)
    own = F.when(F.col("p_block") >= limit, F.lit("block")).otherwise(F.lit("allow"))
    return rows.withColumn("rule", name).withColumn("verdict", F.coalesce(verdict, own)).select("page_id", "host", "path", "rule", "verdict", "p_block")
