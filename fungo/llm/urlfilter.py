"""URL filters: given rules first, then rules that FP-growth mines from labelled URLs.

pyspark.ml.fpm.FPGrowth emits every frequent pattern, and the tokens of one deep path that
thousands of urls share would give 2^n of them; so its growth is written here as projections
and grouped sums that stop at patterns of one label and where a token says nothing new.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, cut_lineage, join_by_share

BLOCK, ALLOW = "block", "allow"


def split_url(url: str | Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a url: between the first `://` and `/`, `?`, `#` or the end; then up to `?`, `#` or the end.  Null or no `://`: both empty."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def query_of(url: Column) -> Column:
    """What follows the first `?` of a url, up to `#`; empty without one."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)


def rule_for(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule (like `example.net/en/`) whose host is the url's or a parent domain of it and whose path the url's begins with; else null."""
    ordered = sorted(rules, key=lambda r: (-len(r), r))

    def fits(rule: str) -> Column:
        h, _, p = rule.partition("/")
        return ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)

    return F.coalesce(*(F.when(fits(r), F.lit(r)) for r in ordered), F.lit(None).cast("string"))


def url_tokens(host: Column, path: Column, query: Column, without: set[str] | frozenset[str] = frozenset()) -> Column:
    """Distinct tokens of a url, each marked by its kind, but for those in `without`.

    s: every domain suffix up to the whole host; h: words of the host (letters between
    hyphens, digits and dots); p: every path part, whole, with runs of digits as 0; w: words
    of a path part; q: keys of the query.
    """
    labels = F.split(host, r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("s:"), F.array_join(F.slice(labels, n - i + 1, i), ".")))
    low = F.translate(path, UPPER, LOWER)
    shapes = F.transform(F.filter(F.split(low, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, "[0-9]+", "0")))

    def marked(kind: str, parts: Column, least: int) -> Column:
        return F.transform(F.filter(parts, lambda x: F.char_length(x) >= least), lambda x: F.concat(F.lit(kind), x))

    host_words = marked("h:", F.split(host, r"[-_0-9.:@]+"), 3)
    path_words = marked("w:", F.split(low, r"[^\p{L}]+"), 3)
    keys = marked("q:", F.transform(F.split(F.translate(query, UPPER, LOWER), "&"), lambda x: F.substring_index(x, "=", 1)), 1)
    every = F.array_distinct(F.concat(F.when(host == "", F.array().cast("array<string>")).otherwise(suffixes), host_words, shapes, path_words, keys))
    return F.filter(every, lambda t: ~t.isin(*sorted(without))) if without else every


def own_tokens(rules: dict[str, str]) -> set[str]:
    """Tokens by which the given rules themselves tell urls: their hosts, what these lie in, the words and path parts in them."""
    out: set[str] = set()
    for r in rules:
        host, _, path = r.partition("/")
        labels = host.split(".")
        out |= {"s:" + ".".join(labels[i:]) for i in range(len(labels))} | {"h:" + x for x in re.split("[-_0-9.:@]+", host)}
        for part in filter(None, path.lower().split("/")):
            out |= {"p:" + re.sub("[0-9]+", "0", part)} | {"w:" + x for x in re.split(r"[^a-z]+", part)}
    return out


def _wider(tokens: tuple[str, ...]) -> Iterator[tuple[str, ...]]:
    """Sets of tokens that every url holds which holds `tokens`: some left out, domain suffixes shortened."""

    def choices(t):
        yield t
        yield None
        if t.startswith("s:"):
            labels = t[2:].split(".")
            yield from ("s:" + ".".join(labels[i:]) for i in range(1, len(labels)))

    for pick in product(*map(choices, tokens)):
        out = tuple(sorted({t for t in pick if t is not None}))
        if out and out != tokens:
            yield out


def _counted(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum("b").alias("b"), F.sum("a").alias("a"), F.count("*").alias("m"))


def _longer(paths: DataFrame, found: DataFrame) -> DataFrame:
    """The conditional pattern bases of FP-growth, one token further: for each mixed pattern of `found`, what lies before its new token on each path.

    Two domain suffixes of one url lie in each other, so the shorter adds nothing to the
    longer and is left out.  Tokens that crowd the paths are joined by broadcast.
    """
    mixed = found.filter("b > 0 and a > 0").select("pattern", "t", F.col("b").alias("of_b"), F.col("a").alias("of_a"), "m")
    total = mixed.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    at = join_by_share(paths.select("pattern", "before", F.posexplode("before").alias("p", "t"), "b", "a"), mixed, ["pattern", "t"], "m", total)
    before = F.filter(F.slice("before", 1, F.col("p")), lambda x: ~(F.col("t").startswith("s:") & x.startswith("s:")))
    rows = at.select(F.concat("pattern", F.array("t")).alias("pattern"), before.alias("before"), "of_b", "of_a", "b", "a").filter(F.size("before") > 0)
    return cut_lineage(_counted(rows, "pattern", "of_b", "of_a", "before").drop("m"))


def rule_table(labelled: DataFrame, min_count: int = 10, min_confidence: float = 0.95) -> DataFrame:
    """(tokens, label, confidence, support) from all rows of `labelled` (tokens array<string>, label block or allow).

    FP-growth by projection, as grouped sums alone: equal token sets are counted together and
    become paths of tokens, most frequent first; each level counts the tokens before a pattern
    and projects the paths of mixed patterns on (_longer).  So neither the driver nor a task
    ever holds a token's whole conditional base.  A rule needs `min_count` rows of its label,
    whatever the table's size, and `min_confidence`; it is pruned where wider tokens imply
    the label as surely.  Patterns that meet one label alone grow no further: more tokens
    cannot make them surer.  Nor do patterns whose last token says nothing new, since all rows
    of the pattern before hold it: whatever they lead to, the pattern before does too, as
    surely and wider.  So the tokens of one deep path that many urls share cost one level, not
    all their combinations, and growth goes on, without a cap, until no pattern is left.
    """
    is_block = F.col("label") == BLOCK
    sets = labelled.filter(F.col("label").isin(BLOCK, ALLOW)).groupBy("tokens").agg(F.count_if(is_block).alias("b"), F.count_if(~is_block).alias("a"))
    sets = cut_lineage(sets.withColumn("id", F.monotonically_increasing_id()))
    n = sets.agg(F.coalesce(F.sum(F.col("b") + F.col("a")), F.lit(0))).first()[0]
    enough = F.greatest("b", "a") >= min_count
    none = F.array().cast("array<string>")
    found = cut_lineage(_counted(sets.select(F.explode("tokens").alias("t"), "b", "a"), "t").filter(enough).select(none.alias("pattern"), "t", "b", "a", "m"))
    levels = [found]
    mixed = found.filter("b > 0 and a > 0").select("t", "m", (-F.col("b") - F.col("a")).alias("rank"))
    total = mixed.agg(F.sum("m")).first()[0]
    if total:
        ranked = join_by_share(sets.select("id", F.explode("tokens").alias("t"), "b", "a"), mixed, "t", "m", total)
        paths = ranked.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "t"))).alias("x"), F.first("b").alias("b"), F.first("a").alias("a"))  # the tokens of one url at most
        paths = cut_lineage(_counted(paths.select(F.col("x.t").alias("before"), "b", "a"), "before").select(none.alias("pattern"), "before", "b", "a"))
        while not found.isEmpty():
            paths = _longer(paths, found)
            counted = _counted(paths.select("pattern", "of_b", "of_a", F.explode("before").alias("t"), "b", "a"), "pattern", "of_b", "of_a", "t")
            found = cut_lineage(counted.filter(enough & ((F.col("b") < F.col("of_b")) | (F.col("a") < F.col("of_a")))).drop("of_b", "of_a"))
            paths = paths.drop("of_b", "of_a")
            levels.append(found)
    patterns = reduce(DataFrame.unionByName, levels).select(F.array_sort(F.concat("pattern", F.array("t"))).alias("tokens"), "b", "a")
    labels = F.explode(F.array(*(F.struct(F.lit(y).alias("label"), F.col(c).alias("of")) for y, c in ((BLOCK, "b"), (ALLOW, "a"))))).alias("y")
    sure = patterns.select("tokens", labels, (F.col("b") + F.col("a")).alias("rows")).select("tokens", "y.label", "y.of", (F.col("y.of") / F.col("rows")).alias("confidence"), (F.col("y.of") / F.lit(n or 1)).alias("support"))
    sure = cut_lineage(sure.filter((F.col("of") >= min_count) & (F.col("confidence") >= min_confidence)).drop("of"))

    def widened(batches):
        for batch in batches:
            rows = [(w, t, y, c) for t, y, c in zip(*(x.to_pylist() for x in batch.columns)) for w in _wider(tuple(t))]
            kinds = (pa.list_(pa.string()), pa.list_(pa.string()), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["wide", "tokens", "label", "confidence"])

    wider = cut_lineage(sure.select("tokens", "label", "confidence").mapInArrow(widened, "wide array<string>, tokens array<string>, label string, confidence double"))
    uses = wider.groupBy("wide", "label").agg(F.count("*").alias("m"))
    known = cut_lineage(sure.select(F.col("tokens").alias("wide"), "label", F.col("confidence").alias("as_sure")).join(uses, ["wide", "label"]))
    total = known.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    said = join_by_share(wider, known, ["wide", "label"], "m", total).filter("as_sure >= confidence").select("tokens", "label").distinct()
    return cut_lineage(sure.join(said, ["tokens", "label"], "left_anti").select("tokens", "label", "confidence", "support"))


def mine_rules(labelled: DataFrame, **mining) -> list[tuple[tuple[str, ...], str, float, float]]:
    """The rules of rule_table, to be looked at."""
    rows = rule_table(labelled, **mining).collect()
    return sorted(((tuple(r["tokens"]), r["label"], r["confidence"], r["support"]) for r in rows), key=lambda r: (len(r[0]), r))


class RuleIndex:
    """Inverted index: a token names the rules that need it; a url fits a rule when all its tokens were met."""

    def __init__(self, rules: list):
        self.rules = rules
        self.by_token: dict[str, list[int]] = defaultdict(list)
        for i, r in enumerate(rules):
            for t in r[0]:
                self.by_token[t].append(i)

    def best(self, tokens: list[str]) -> int | None:
        """The surest fitting rule; of equals, the one with more support, then the one that blocks."""
        met: dict[int, int] = defaultdict(int)
        for t in tokens:
            for i in self.by_token.get(t, ()):
                met[i] += 1
        fit = [i for i, n in met.items() if n == len(self.rules[i][0])]
        return min(fit, key=lambda i: (-self.rules[i][2], -self.rules[i][3], self.rules[i][1] != BLOCK, self.rules[i][0])) if fit else None


def match_rules(rows: DataFrame, rules: DataFrame, max_index_mb: int = 16) -> DataFrame:
    """`rows` (with tokens array<string>, null where nothing is to be matched) and mined, said: tokens and verdict of the best fitting rule of each (see RuleIndex.best).

    The inverted index is broadcast while the rules' text and numbers take `max_index_mb`
    as measured; beyond, each rule is looked up by its rarest token in a join (match_by_join).
    """
    size = rules.agg(F.coalesce(F.sum(F.octet_length(F.array_join("tokens", " ")) + 64), F.lit(0))).first()[0]
    if size > max_index_mb << 20:
        return match_by_join(rows, rules)
    sent = rows.sparkSession.sparkContext.broadcast([(tuple(r["tokens"]), r["label"], r["confidence"], r["support"]) for r in rules.collect()])
    place, names = rows.columns.index("tokens"), [*rows.columns, "mined", "said"]

    def match(batches):
        index = RuleIndex(sent.value)
        cache: dict[tuple, int | None] = {}
        for batch in batches:
            found = []
            for t in batch.column(place).to_pylist():
                if t is None:
                    found.append(None)
                    continue
                t = tuple(t)
                if t not in cache:
                    if len(cache) > 20_000:
                        cache.clear()
                    cache[t] = index.best(t)
                found.append(cache[t])
            mined = [None if i is None else " ".join(index.rules[i][0]) for i in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(mined, pa.string()), pa.array([None if i is None else index.rules[i][1] for i in found], pa.string())], names=names)

    return rows.mapInArrow(match, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", mined string, said string")


def match_by_join(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """match_rules for rules beyond a broadcast: urls meet the rules of each of their tokens that is some rule's rarest, then prove them whole."""
    held = cut_lineage(rows.withColumn("_i", F.monotonically_increasing_id()))
    tokens = held.select("_i", F.explode("tokens").alias("t"), "tokens")
    uses = tokens.groupBy("t").agg(F.count("*").alias("m"))
    parts = cut_lineage(rules.withColumn("r", F.monotonically_increasing_id()))
    # the rarest token of a rule; a token that no url holds makes the rule fit none
    counted = parts.select("r", F.size("tokens").alias("n"), F.explode("tokens").alias("t")).join(uses, "t")
    rarest = counted.groupBy("r").agg(F.min(F.struct("m", "t")).alias("x"), F.count("*").alias("met"), F.first("n").alias("n")).filter("met = n")
    index = cut_lineage(rarest.select("r", "x.t", "x.m").join(parts.withColumnRenamed("tokens", "needed"), "r").drop("r"))
    total = uses.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    met = join_by_share(tokens, index, "t", "m", total).filter(F.size(F.array_except("needed", "tokens")) == 0)
    best = met.groupBy("_i").agg(F.min(F.struct((-F.col("confidence")).alias("c"), (-F.col("support")).alias("s"), (F.col("label") != BLOCK).alias("y"), "needed", "label")).alias("x"))
    best = best.select("_i", F.array_join("x.needed", " ").alias("mined"), F.col("x.label").alias("said"))
    return held.join(best, "_i", "left").select(*rows.columns, "mined", "said")


def _given(url: Column, rules: dict[str, str]) -> tuple[Column, Column, Column, Column]:
    """Host, path, rule and the rule's verdict of a url."""
    host, path = split_url(url)
    rule = rule_for(host, path, rules)
    return host, path, rule, reduce(lambda c, r: F.when(rule == r, F.lit(rules[r])).otherwise(c), rules, F.lit(None).cast("string"))


def held_out_figures(pages: DataFrame, rules: dict[str, str], key: str = "page_id", url: str = "url", fold: int = 5, **mining) -> dict[str, float | int | None]:
    """What mined rules alone say of urls that given rules decide: mined from all but one of `fold` folds (by crc32 of the url), judged on that one.

    `decided` urls held out, `judged` by a mined rule; precision and recall of `block` among
    the decided; None where nothing was blocked.
    """
    host, path, _, given = _given(F.col(url), rules)
    rows = pages.select(url_tokens(host, path, query_of(F.col(url)), own_tokens(rules)).alias("tokens"), given.alias("label"), (F.crc32(F.encode(F.coalesce(F.col(url), F.lit("")), "UTF-8")) % fold).alias("fold"))
    rows = cut_lineage(rows.filter("label is not null"))
    mined = rule_table(rows.filter("fold != 0").select("tokens", "label"), **mining)
    said = match_rules(rows.filter("fold = 0").select("tokens", "label"), mined)
    blocked, is_block = F.col("said") == BLOCK, F.col("label") == BLOCK
    n, judged, hit, said_block, real = said.agg(F.count("*"), F.count("said"), F.count_if(blocked & is_block), F.count_if(blocked), F.count_if(is_block)).first()
    return {"rules": mined.count(), "decided": n, "judged": judged, "precision": hit / said_block if said_block else None, "recall": hit / real if real else None}


def filter_urls(pages: DataFrame, rules: dict[str, str], key: str = "page_id", url: str = "url", labels: DataFrame | None = None, label_col: str = "label", default: str = ALLOW, max_index_mb: int = 16, **mining) -> DataFrame:
    """One row per input row: key, host, path, rule, mined (the tokens of the mined rule used, else null), verdict.

    A given rule that fits decides.  Else the surest mined rule whose tokens the url holds
    decides; else `default`.  Labels to mine from are (key, `label_col` with block or allow);
    without them every url a given rule decides is labelled by it, and urls that none decides
    teach nothing: they are the ones to be judged.  Then the tokens of the given rules are
    left out (own_tokens), so that what is mined is no copy of a rule but says what else
    the urls on either side have in common.

    Null urls have empty host and path and no tokens; an empty table gives no rows; repeated
    rows and null keys stay; of equally sure rules the better supported decides, then the
    one that blocks; urls are whole, of any length; extra columns are ignored.  Rules are
    broadcast or joined by their size (see match_rules).
    """
    host, path, rule, given = _given(F.col(url), rules)
    tokens = url_tokens(host, path, query_of(F.col(url)), frozenset() if labels is not None else own_tokens(rules))
    rows = pages.select(F.col(key).alias("k"), host.alias("host"), path.alias("path"), rule.alias("rule"), given.alias("given"), tokens.alias("tokens"))
    if labels is None:
        labelled = rows.select("tokens", F.col("given").alias("label"))
    else:
        labelled = rows.join(labels.select(F.col(key).alias("k"), F.col(label_col).alias("label")), "k").select("tokens", "label")
    ready = rows.select(F.col("k").cast("long").alias("k"), "host", "path", "rule", "given", F.when(F.col("rule").isNull(), F.col("tokens")).alias("tokens"))
    found = match_rules(ready, rule_table(labelled, **mining), max_index_mb)
    return found.select(F.col("k").alias(key), "host", "path", "rule", "mined", F.coalesce("given", "said", F.lit(default)).alias("verdict"))
