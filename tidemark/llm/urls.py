"""URL filters: host and path rules first, association rules mined from what these decide for the rest.

Spark's FP-growth finds the token combinations that go with a label; rules of enough support and confidence are kept,
and an inverted index from token to rules matches them with distinct token sets. Where rows have too many tokens for all
their combinations to be listed, FP-growth's conditional rows are searched by bounds instead, with the same result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, cut


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the query. The longest that fits decides.
RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))

SUPPORT, CONFIDENCE = 0.01, 0.9

#: Tokens of a row, equal and decided ones aside, up to which all combinations are listed: they double with each. Where a
#: row has more, rules are searched by bounds; no token is left out either way.
MOST_TOKENS = 12

#: Rows that are counted at once.
BLOCK = 1 << 14

#: Rules that are broadcast as an index; more of them are joined by a shuffle.
MOST_BROADCAST = 10_000

LABEL = "label="


def host(url: Column) -> Column:
    return F.when(url.contains("://"), ascii_lower(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1))).otherwise("")


def path(url: Column) -> Column:
    return F.when(url.contains("://"), F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)).otherwise("")


def fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)


def by_rules(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Name of the longest rule that fits (of equal ones the first), else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        out = F.when(fits(rule, host, path), rule.name).otherwise(out)
    return out


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Sorted tokens of a URL: what its host ends with, its first label, its path's parts and its parameters' names.
    Numbers count as alike, so that the distinct sets are few."""
    labels = F.split(host, r"\.")
    parts = F.filter(F.split(F.regexp_replace(path, "[0-9]+", "0"), "/"), lambda x: x != "")
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    names = F.filter(F.transform(F.split(query, "&"), lambda x: F.element_at(F.split(x, "="), 1)), lambda x: x != "")
    return F.array_sort(
        F.array_distinct(
            F.concat(
                F.array(F.concat(F.lit("top="), F.substring_index(host, ".", -1)), F.concat(F.lit("site="), F.substring_index(host, ".", -2)), F.concat(F.lit("first="), F.element_at(labels, 1))),
                F.transform(parts, lambda x: F.concat(F.lit("path="), x)),
                F.transform(names, lambda x: F.concat(F.lit("name="), x)),
                F.when(url.contains("#"), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>")),
            )
        )
    )


def mine(
    labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, most_tokens: int = MOST_TOKENS, targets: DataFrame | None = None
) -> DataFrame:
    """tokens, label -> antecedent (a list of lists of tokens), label, confidence, support of rules, over all labelled rows.

    A rule fits a URL that has one token at least of each list: tokens that the same labelled rows have are one list, so
    that a path of many parts brings one item to the mining. Tokens whose rows all have one label are rules by
    themselves and aren't combined, since no combination does better. Where every row has most_tokens of what's left and
    frequent at most, all rules are listed; else those that can come first by match()'s order, of any length: for some set of
    targets (tokens) if they're given, else for any set. No labelled rows give no rules.
    """
    spark = labelled.sparkSession
    sets = cut(labelled.groupBy("tokens", "label").agg(F.count("*").alias("n")))
    total = sets.agg(F.sum("n")).first()[0] or 0
    named = "antecedent array<array<string>>, label string, confidence double, support double"
    if not total:
        return spark.createDataFrame([], named)
    least = max(1, math.ceil(support * total - 1e-9))
    rows = F.xxhash64("tokens", "label")
    held = sets.select(F.explode("tokens").alias("token"), "label", "n", rows.alias("a"), F.xxhash64("label", "tokens").alias("b"))
    held = held.groupBy("token").agg(F.sum("n").alias("n"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.min("label").alias("low"), F.max("label").alias("high")).where(F.col("n") >= least)
    held = held.groupBy("a", "b", "n", "low", "high").agg(F.sort_array(F.collect_set("token")).alias("list"))  # 1 / support tokens a row at most
    held = cut(held.withColumn("item", F.col("list")[0]))

    pure = held.where("low = high").select(F.array("list").alias("antecedent"), F.col("low").alias("label"), F.lit(1.0).alias("confidence"), (F.col("n") / total).alias("support"))
    items = held.where("low != high").select("item", F.col("n").alias("rows"))
    met = sets.withColumn("set", rows).select("set", "label", "n", F.explode("tokens").alias("item")).join(F.broadcast(items), "item")
    met = met.groupBy("set").agg(F.first("label").alias("label"), F.first("n").alias("n"), F.array_sort(F.collect_set(F.struct("rows", "item"))).alias("held"))
    met = cut(met.select(F.transform("held", lambda x: x["item"]).alias("items"), "label", "n"))
    n = met.agg(F.sum("n")).first()[0] or 0
    if not n:
        return pure
    if met.where(F.size("items") > most_tokens).isEmpty():
        baskets = met.select(F.concat("items", F.array(F.concat(F.lit(LABEL), "label"))).alias("items"), F.explode(F.sequence(F.lit(1), "n"))).select("items")
        # Support is a share of all labelled rows, also of those that bring no item.
        model = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / n), minConfidence=confidence).fit(baskets)
        rules = model.associationRules.where(F.col("consequent")[0].startswith(LABEL))
        rules = rules.select("antecedent", F.expr(f"substr(consequent[0], {len(LABEL) + 1})").alias("label"), "confidence", (F.round(F.col("support") * n) / total).alias("support"))
    else:
        if targets is not None:
            of = F.broadcast(held.where("low != high").select(F.explode("list").alias("token"), "item", F.col("n").alias("rows")))
            targets = targets.select("tokens", F.explode("tokens").alias("token")).join(of, "token").groupBy("tokens").agg(F.array_sort(F.collect_set(F.struct("rows", "item"))).alias("held"))
            targets = targets.select(F.transform("held", lambda x: x["item"]).alias("items")).distinct()
        found = _searched(met, targets, least, confidence)
        rules = found.select("antecedent", "label", (F.col("n") / F.col("all")).alias("confidence"), (F.col("n") / total).alias("support"))
    lists = held.select("item", "list")
    whole = rules.withColumn("rule", F.xxhash64(F.array_sort("antecedent"), "label")).withColumn("item", F.explode("antecedent")).join(F.broadcast(lists), "item")
    whole = whole.groupBy("rule").agg(F.array_sort(F.collect_list("list")).alias("antecedent"), *(F.first(c).alias(c) for c in ("label", "confidence", "support")))
    return whole.drop("rule").unionByName(pure)


FOUND = pa.schema({"antecedent": pa.list_(pa.string()), "label": pa.string(), "n": pa.int64(), "all": pa.int64()})


def _searched(baskets: DataFrame, targets: DataFrame | None, least: int, confidence: float) -> DataFrame:
    """items, label, n and the items of targets, the rarest first in both -> FOUND, without the rules that never come first.

    As in FP-growth, each item gets the rows that hold it, less the items before it, and finds the rules that begin with it.
    """
    rows = baskets.groupBy("items", "label").agg(F.sum("n").alias("n"))
    if targets is not None:
        rows = rows.unionByName(targets.select("items", F.lit("").alias("label"), F.lit(0).cast("long").alias("n")))
    rows = rows.select("items", "label", "n", F.posexplode("items").alias("i", "first")).select("first", F.expr("slice(items, i + 2, size(items))").alias("rest"), "label", "n")
    # A number of its own: what's few bytes may be long work, and would be put into one task.
    rows = rows.repartition(int(baskets.sparkSession.conf.get("spark.sql.shuffle.partitions")), "first")
    aimed = targets is not None

    def grow(table: pa.Table) -> pa.Table:
        return _grow(table, least, confidence, aimed)

    return cut(rows.groupBy("first").applyInArrow(grow, "antecedent array<string>, label string, n long, all long"))


def _grow(table: pa.Table, least: int, confidence: float, aimed: bool) -> pa.Table:
    """first, rest, label, n (0: a target) of one first item -> FOUND: the rules with it that come first for some target, or
    that may for some set.

    A combination grows by an item only if rows enough of the label stay and rows of other labels go, else the rule without
    the item comes before it, whatever is added later; and only while the rows of other labels that have all items that may
    still be added are few enough for the confidence, and for what some target has already.
    """
    first = table["first"][0].as_py()
    rest = pa.concat_arrays(table["rest"].chunks)
    codes = rest.flatten().dictionary_encode()
    items = codes.dictionary.to_pylist()
    has = np.zeros((len(rest), len(items)), bool)
    has[np.repeat(np.arange(len(rest)), rest.value_lengths().to_numpy()), codes.indices.to_numpy()] = True
    n, labels = table["n"].to_numpy(), np.array(table["label"].to_pylist(), object)
    aims = has[n == 0]
    top = _Top(len(aims) if aimed else None)
    for label in sorted(set(labels[n > 0])):
        of = (n > 0) & (labels == label)
        other = (n > 0) & ~of
        held, lost = int(n[of].sum()), int(n[other].sum())
        if held < least or (aimed and not len(aims)):
            continue
        if held / (held + lost) >= confidence:
            top.offer((first,), label, held, held + lost, np.arange(len(aims)))
        at = np.arange(len(items))
        stack = [((first,), at, *_packed(has[of], n[of]), *_packed(has[other], n[other]), np.arange(len(aims)), (1.0, held, 2))] if lost else []
        while stack:
            chosen, at, p, wp, q, wq, who, bound = stack.pop()
            if aimed:
                who = who[top.open(who, *bound)]
                if not len(who):
                    continue
            some = aims[np.ix_(who, at)] if aimed else None
            with_p, with_q = _counts(p, wp), _counts(q, wq)
            keep = (with_p >= least) & (with_q < wq.sum())
            if aimed:
                keep &= some.any(axis=0)
                some = some[:, keep]
            at, p, q, with_p, with_q = at[keep], p[:, keep], q[:, keep], with_p[keep], with_q[keep]
            if not len(at):
                continue
            sure = with_p / (with_p + with_q)
            good = sure >= confidence
            if aimed:
                good[good] = (some[:, good] & top.open(who[:, None], sure[good], with_p[good], len(chosen) + 1)).any(axis=0)
            for x in np.flatnonzero(good):
                top.offer((*chosen, items[at[x]]), label, int(with_p[x]), int(with_p[x] + with_q[x]), who[some[:, x]] if aimed else None)
            # The most confident last, and so taken first: it is what others have to be better than.
            order = np.argsort(sure, kind="stable")
            place = np.argsort(order)
            both = _pairs(q, wq)
            more = (place[:, None] > place[None, :]) & (_pairs(p, wp) >= least) & (both < with_q[:, None])
            left = _holding(q, wq, more | np.eye(len(at), dtype=bool))
            bounds = with_p / (with_p + left)
            # As few items as may take away what has to go, and the ones so far.
            gone = np.sort(np.where(more, with_q[:, None] - both, 0), axis=1)[:, ::-1].cumsum(axis=1)
            size = len(chosen) + 2 + (gone < (with_q - left)[:, None]).sum(axis=1)
            grows = more.any(axis=1) & (with_q > 0) & (bounds >= confidence)
            if aimed:
                grows[grows] = (some[:, grows] & top.open(who[:, None], bounds[grows], with_p[grows], size[grows])).any(axis=0)
            for x in order[grows[order]]:
                own = who[some[:, x]] if aimed else who
                bound = (bounds[x], with_p[x], size[x])
                a, b = p[:, x], q[:, x]
                stack.append(((*chosen, items[at[x]]), at[more[x]], p[np.ix_(a, more[x])], wp[a], q[np.ix_(b, more[x])], wq[b], own, bound))
    return pa.Table.from_pylist(top.rules(), schema=FOUND)


class _Top:
    """The first rule by match()'s order for each target; without targets every rule."""

    def __init__(self, targets: int | None):
        self.found: list[tuple] = []
        self.targets = targets
        if targets is not None:
            self.sure, self.held, self.size, self.rule = np.zeros(targets), np.zeros(targets), np.zeros(targets), np.full(targets, -1)

    def open(self, who: np.ndarray, sure: np.ndarray | float, held: np.ndarray | float, size: np.ndarray | int) -> np.ndarray:
        """Whether a rule of that confidence, support and size is as good as the target's first, names aside."""
        s, h = self.sure[who], self.held[who]
        return (sure > s) | ((sure == s) & ((held > h) | ((held == h) & (size <= self.size[who]))))

    def offer(self, names: tuple[str, ...], label: str, held: int, every: int, who: np.ndarray | None) -> None:
        rule = (" ".join(sorted(names)), label, names, held, every)
        sure, size = held / every, len(names)
        if self.targets is not None:
            who = who[self.open(who, sure, held, size)]
            tied = (sure == self.sure[who]) & (held == self.held[who]) & (size == self.size[who])
            before = [r for r in np.unique(self.rule[who[tied]]) if self.found[r][:2] <= rule[:2]]
            who = who[~(tied & np.isin(self.rule[who], before))]
            if not len(who):
                return
            self.sure[who], self.held[who], self.size[who], self.rule[who] = sure, held, size, len(self.found)
        self.found.append(rule)

    def rules(self) -> list[dict]:
        kept = range(len(self.found)) if self.targets is None else np.unique(self.rule[self.rule >= 0])
        return [{"antecedent": list(names), "label": label, "n": held, "all": every} for _, label, names, held, every in (self.found[r] for r in kept)]


def _packed(has: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and their sums."""
    if not has.size:
        return has[:1], n.sum(keepdims=True)[: len(has)].astype(float)
    _, at, of = np.unique(np.packbits(has, axis=1), axis=0, return_index=True, return_inverse=True)
    return has[at], np.bincount(of.ravel(), n)


def _blocks(has: np.ndarray, n: np.ndarray):
    for i in range(0, len(has), BLOCK):
        yield has[i : i + BLOCK].astype(float), n[i : i + BLOCK]


def _counts(has: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Rows with each item."""
    return sum((w @ x for x, w in _blocks(has, n)), np.zeros(has.shape[1]))


def _pairs(has: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Rows with each two items."""
    return sum(((x * w[:, None]).T @ x for x, w in _blocks(has, n)), np.zeros((has.shape[1],) * 2))


def _holding(has: np.ndarray, n: np.ndarray, sets: np.ndarray) -> np.ndarray:
    """Rows with all items of each set."""
    size = sets.sum(axis=1)
    return sum((w @ (x @ sets.T == size) for x, w in _blocks(has, n)), np.zeros(len(sets)))


def match(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct tokens -> tokens, label, mined: the first rule that fits, by confidence, then support, both falling, then
    fewer lists, then by name, which is the first token of each list."""
    rules = rules.withColumn("mined", F.array_join(F.transform("antecedent", lambda x: x[0]), " "))
    order = F.struct((-F.col("confidence")).alias("c"), (-F.col("support")).alias("s"), F.size("antecedent").alias("size"), "mined", "label")
    index = rules.select(order.alias("rule"), F.posexplode("antecedent").alias("place", "list")).select("rule", "place", F.explode("list").alias("token"))
    index = cut(index)
    if index.count() <= MOST_BROADCAST:
        index = F.broadcast(index)
    met = sets.select("tokens", F.explode("tokens").alias("token")).join(index, "token")
    whole = met.groupBy("tokens", "rule").agg(F.count_distinct("place").alias("n")).where("n = rule.size")
    return whole.groupBy("tokens").agg(F.min("rule").alias("rule")).select("tokens", "rule.label", "rule.mined")


def judge(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: tuple[Rule, ...] = RULES,
    support: float = SUPPORT,
    confidence: float = CONFIDENCE,
    default: str = "allow",
) -> DataFrame:
    """page_id, host, path, rule, verdict, mined (the association rule's name, or null), a row for each row.

    The labelled URLs are those that a rule decides. Where neither a rule nor a mined one fits, the default holds.
    Null URLs and ones without :// have an empty host and path, and no rule; repeated rows stay repeated and count
    as often; a URL of very many parts has as many tokens, and all of them count; of rules that fit
    alike the first by match()'s order decides; no rows give no rows. Other columns aren't read.
    """
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), host(url).alias("host"), path(url).alias("path"), url.alias("url"))
    rows = rows.select("*", by_rules(F.col("host"), F.col("path"), rules).alias("rule"), tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens")).drop("url")
    label = F.coalesce(*(F.when(F.col("rule") == r.name, r.verdict) for r in rules))
    rows = rows.withColumn("label", label)
    others = rows.where("label IS NULL").select("tokens").distinct()
    found = match(others, mine(rows.where("label IS NOT NULL").select("tokens", "label"), support, confidence, targets=others))
    # A token set may be a third of all rows: the second key makes both sides be dealt out anew, so that it can be split.
    found = found.select(F.col("tokens").alias("t"), F.xxhash64("tokens").alias("h"), F.col("label").alias("method"), "mined")
    rows = rows.withColumn("k", F.xxhash64("tokens")).join(found, (F.col("tokens") == F.col("t")) & (F.col("k") == F.col("h")), "left")
    return rows.select(
        "page_id", "host", "path", "rule", F.coalesce("label", "method", F.lit(default)).alias("verdict"), F.when(F.col("label").isNull(), F.col("mined")).alias("mined")
    )
