"""URL filters: rules by host and path, else a logistic regression on hashed character n-grams of both.

DataFrame functions only.  A url's host and path become arrays of characters,
three neighbouring characters a feature, its 64-bit hash a place in a table of
``BUCKETS`` weights; the table reaches the rows as a scalar subquery, so that
scoring needs neither a join nor a shuffle.  Fitting takes a small labelled
table, whose bound is ``TRAIN_MOST`` rows for each verdict; a step is one job
that sums integer gradients by bucket, so that the order of rows changes nothing.

Nulls, empty and odd urls: a null url, or one without ``://``, has an empty host
and path, fits no rule, and is judged by the intercept alone.  Repeated rows and
ids, null ids and further columns pass through; an empty table gives no row.
Features are found in time proportional to a url's length.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import discard, fresh, stage

#: Weights, besides the intercept's, which stands after them.
BUCKETS = 1 << 12
#: Labelled rows of each verdict that a fit looks at: those with the least hashes.
TRAIN_MOST = 1_500
STEPS, RATE, MOMENTUM, DECAY = 14, 8.0, 0.7, 1e-4
#: Gradients are summed as integers of this fraction.
_UNIT = float(1 << 40)
#: (verdict, rule), a rule being a host and the beginning of a path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased, and from there up to ``?``, ``#`` or the end."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, else null; of equally long ones the first given.

    A rule fits its host and all subdomains if the path begins with the rule's.
    One expression a rule: meant for lists of up to some hundreds.
    """
    found = None
    for _, rule in sorted(rules, key=lambda x: -len(x[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.when(fits, rule) if found is None else found.when(fits, rule)
    return F.lit(None).cast("string") if found is None else found


def verdict_of(rule: Column, rules=RULES) -> Column:
    out = F.lit(None).cast("string")
    for verdict, name in rules:
        out = F.when(rule == name, verdict).otherwise(out)
    return out


def _triples(text: Column, kind: str) -> Column:
    """Buckets of each three neighbouring characters; shifted copies of one array are zipped, so nothing is searched for again."""
    chars = F.split(F.concat(F.lit("^"), text, F.lit("$")), "")
    both = F.zip_with(chars, F.slice(chars, F.lit(2), F.size(chars)), lambda a, b: F.concat(a, b))
    three = F.filter(F.zip_with(both, F.slice(chars, F.lit(3), F.size(chars)), lambda a, b: F.concat(a, b)), lambda g: g.isNotNull())
    return F.transform(three, lambda g: F.pmod(F.xxhash64(F.lit(kind), g), F.lit(BUCKETS)).cast("int"))


def features(host: Column, path: Column) -> Column:
    """Buckets, one for each three characters, a bucket as often as it is met."""
    return F.concat(_triples(host, "host"), _triples(path, "path"))


@dataclass(frozen=True)
class UrlModel:
    """``weights`` by bucket, and the intercept after them."""

    weights: tuple[float, ...]

    def score(self, ids: Column) -> Column:
        """Probability of ``block`` of rows with the buckets ``ids``."""
        table = F.from_json(F.lit(json.dumps(self.weights)), "array<double>")  # folded into one constant
        total = F.aggregate(ids, F.lit(0.0), lambda z, i: z + F.get(table, i))
        z = total / F.sqrt(F.greatest(F.size(ids), F.lit(1))) + self.weights[BUCKETS]
        return 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-500.0)), F.lit(500.0))))


def fit(labelled: DataFrame, *, url_col="url", label_col="label", most: int = TRAIN_MOST) -> UrlModel:
    """Weights from a small table: ``label_col`` is ``block`` or ``allow``; other labels and null ones aren't used.

    At most ``most`` rows of each verdict are used, those of least hash over all
    columns.  Both verdicts weigh the same.  Without any labelled row all weights
    are 0, and no url is blocked; with rows of one verdict, it is the answer.
    """
    host, path = host_path(F.col(url_col))
    mark = F.xxhash64(*[F.col(c).cast("string") for c, kind in labelled.dtypes if not kind.startswith(("map", "variant"))])
    some = [labelled.filter(F.col(label_col) == v).select(F.col(url_col), F.lit(float(v == "block")).alias("y"), mark.alias("mark")).orderBy("mark", F.col(url_col)).limit(most) for v in ("block", "allow")]
    train = stage(some[0].unionByName(some[1]).select("y", features(host, path).alias("ids")), "url-train")
    counts = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
    w, speed = [0.0] * (BUCKETS + 1), [0.0] * (BUCKETS + 1)
    if counts:
        share = F.when(F.col("y") == 1.0, 1 / (len(counts) * counts.get(1.0, 1))).otherwise(1 / (len(counts) * counts.get(0.0, 1)))
        for _ in range(STEPS):
            ahead = [round(a + MOMENTUM * b, 9) for a, b in zip(w, speed)]
            off = train.select("ids", ((UrlModel(tuple(ahead)).score(F.col("ids")) - F.col("y")) * share).alias("r"))
            each = off.select(F.explode(F.concat(F.transform("ids", lambda i: F.struct(i.alias("i"), (F.col("r") / F.sqrt(F.size("ids"))).alias("g"))), F.array(F.struct(F.lit(BUCKETS).alias("i"), F.col("r").alias("g"))))).alias("x"))
            slope = each.groupBy(F.col("x.i").alias("i")).agg(F.sum(F.round(F.col("x.g") * _UNIT).cast("long")).alias("g")).collect()  # a row for each bucket met, at most BUCKETS + 1
            step = [DECAY * a for a in ahead]
            for r in slope:
                step[r["i"]] += r["g"] / _UNIT
            speed = [MOMENTUM * b - RATE * s for b, s in zip(speed, step)]
            w = [a + b for a, b in zip(w, speed)]
    discard(train)
    return UrlModel(tuple(round(x, 9) for x in w))


def judge(pages: DataFrame, model: UrlModel, *, url_col="url", rules=RULES) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``verdict`` and ``score`` (probability of block), replacing columns of these names.

    A rule's verdict stands; without one, a url is blocked if its score is over a half.
    """
    names = ("host", "path", "rule", "verdict", "score")
    kept = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in names]
    host, path = host_path(F.col(url_col))
    cols = {n: fresh("u_" + n, pages.columns) for n in names[:2]}
    cut = pages.select("*", host.alias(cols["host"]), path.alias(cols["path"]))
    host, path = F.col(cols["host"]), F.col(cols["path"])
    rule, score = rule_of(host, path, rules), model.score(features(host, path))
    found = cut.select(*kept, host.alias("host"), path.alias("path"), rule.alias("rule"), score.alias("score"))
    return found.select("*", F.coalesce(verdict_of(F.col("rule"), rules), F.when(F.col("score") > 0.5, "block").otherwise("allow")).alias("verdict"))


def labelled_by_rules(pages: DataFrame, *, url_col="url", rules=RULES) -> DataFrame:
    """The rows that a rule fits, with its verdict as ``label``: a table to fit on where no other is at hand."""
    host, path = host_path(F.col(url_col))
    return pages.withColumn("label", verdict_of(rule_of(host, path, rules), rules)).filter(F.col("label").isNotNull())
