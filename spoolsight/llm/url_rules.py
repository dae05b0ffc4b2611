"""URL filtering: listed host and path rules first, then association rules mined from labelled URLs."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import pandas as pd
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoolsight.shared import written

ALLOW, BLOCK = "allow", "block"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LABEL = "label="
LOCAL_RULES = 20_000


@dataclass(frozen=True)
class Rule:
    """Verdict for a host with all its subdomains, where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed(rules: list[Rule], host: Column, path: Column) -> Column:
    """The fitting rule with the longest text as a struct of rule and verdict, null where none fits. Of equal texts the
    first in the list wins."""
    out = None
    for r in sorted(rules, key=lambda r: -len(r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))
        out = F.when(fits, found) if out is None else out.when(fits, found)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def tokens(url: Column) -> Column:
    """Distinct tokens of a URL: scheme, parts of the host (the last one as such), path segments, file type, names of
    query fields. Digits are folded, so that numbered pages have a token in common."""
    fold = lambda c: F.regexp_replace(F.lower(c), r"[0-9]+", "#")
    named = lambda prefix, parts: F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.concat(F.lit(prefix), fold(p)))
    parts = F.split(host(url), r"\.")
    scheme = F.array(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    kind = F.array(F.regexp_extract(path(url), r"\.([A-Za-z0-9]{1,5})$", 1))
    fields = F.regexp_extract_all(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit(r"(?:^|&)([^=&]+)"), F.lit(1))
    everything = F.concat(named("scheme=", scheme), named("end=", F.slice(parts, -1, 1)), named("host=", parts), named("path=", F.split(path(url), "/")), named("type=", kind), named("query=", fields))
    return F.coalesce(F.array_distinct(everything), F.array().cast("array<string>"))


def rule_table(labelled: DataFrame, min_support: float, min_confidence: float, min_lift: float = 0.0) -> DataFrame:
    """Association rules from token sets to labels: tokens, label, confidence, support.

    ``labelled``: ``tokens array<string>``, ``label string``; all rows are mined by Spark's FP-growth. A rule is pruned if its
    support, its confidence, or its lift (confidence against the label's share of all rows) is too low.
    """
    items = labelled.where("label is not null").select(F.array_distinct(F.concat("tokens", F.array(F.concat(F.lit(LABEL), "label")))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    says = model.associationRules.where(F.col("consequent")[0].startswith(LABEL) & ~F.exists("antecedent", lambda t: t.startswith(LABEL)) & (F.col("lift") >= min_lift))
    return says.select(F.array_sort("antecedent").alias("tokens"), F.substring(F.col("consequent")[0], len(LABEL) + 1, 1 << 30).alias("label"), "confidence", "support")


def pruned(table: DataFrame) -> list[tuple[frozenset, str, float, float]]:
    """Rules of a counted, small table, the best first, without those of which a rule with fewer of the tokens says the same with
    no less confidence. Such rules never decide, as the other fits wherever they do and comes first."""
    rules = table.collect()
    uses = Counter(t for r in rules for t in r.tokens)
    filed: dict[tuple[str, str], list[tuple[frozenset, float]]] = {}
    kept: list[tuple[frozenset, str, float, float]] = []
    for r in sorted(rules, key=lambda r: (len(r.tokens), r.tokens, r.label)):
        words = frozenset(r.tokens)
        if not any(w < words and c >= r.confidence for t in words for w, c in filed.get((t, r.label), ())):
            filed.setdefault((min(words, key=lambda t: (uses[t], t)), r.label), []).append((words, r.confidence))
            kept.append((words, r.label, r.confidence, r.support))
    return sorted(kept, key=lambda k: (-k[2], -k[3], len(k[0]), k[1] != BLOCK, sorted(k[0])))


def mine(labelled: DataFrame, min_support: float, min_confidence: float, min_lift: float = 0.0) -> list[tuple[frozenset, str, float, float]]:
    """Pruned rules, for a caller that knows them to be few: tokens, label, confidence, support, the best first."""
    return pruned(rule_table(labelled, min_support, min_confidence, min_lift))


def matched(rules: list[tuple[frozenset, str, float, float]], words: Column, default: str) -> Column:
    """Label of the best rule all of whose tokens are in ``words``, else ``default``.

    An inverted index leads from each rule's rarest token (the one in fewest rules) to the rules, so that a row tests few
    rules. The rules are bounded (see ``mine``) and travel with the task.
    """
    uses: dict[str, int] = {}
    for found, *_ in rules:
        for t in found:
            uses[t] = uses.get(t, 0) + 1
    index: dict[str, list[tuple[int, frozenset, str]]] = {}
    for k, (found, label, *_) in enumerate(rules):
        index.setdefault(min(found, key=lambda t: (uses[t], t)), []).append((k, found, label))

    def best(rows: pd.Series) -> pd.Series:
        out = []
        for row in rows:
            row = frozenset(row)
            hits = [(k, label) for t in row for k, found, label in index.get(t, ()) if found <= row]
            out.append(min(hits)[1] if hits else default)
        return pd.Series(out, dtype="object")

    return F.pandas_udf(best, "string")(words)


def matched_by_join(table: DataFrame, urls: DataFrame) -> DataFrame:
    """As ``matched`` for any number of rules: ``url`` and ``said``, the label of its best rule; URLs without one are left out.

    The inverted index is a join: rules are filed under their rarest token, and each distinct URL meets the rules filed
    under its tokens.
    """
    uses = table.select(F.explode("tokens").alias("at")).groupBy("at").agg(F.count(F.lit(1)).alias("uses"))
    rank = F.struct((-F.col("confidence")).alias("c"), (-F.col("support")).alias("s"), F.size("tokens").alias("n"), (F.col("label") != BLOCK).alias("b"), "tokens", "label")
    ranked = table.select(rank.alias("rule"), "tokens")
    filed = ranked.select("rule", F.explode("tokens").alias("at")).join(uses, "at").groupBy("rule").agg(F.min(F.struct("uses", "at"))["at"].alias("at"))
    words = urls.select("url").where("url is not null").distinct().select("url", tokens(F.col("url")).alias("words"))
    met = words.select("url", "words", F.explode("words").alias("at")).join(filed, "at").where(F.size(F.array_except("rule.tokens", "words")) == 0)
    return met.groupBy("url").agg(F.min("rule")["label"].alias("said"))


def own_tokens(rules: list[Rule], rule: Column) -> Column:
    """Tokens of an address made of a listed rule's host and path: they restate the rule, and teach nothing beyond it."""
    out = F.array().cast("array<string>")
    for r in rules:
        out = F.when(rule == r.text, tokens(F.lit(f"x://{r.host}{r.path}"))).otherwise(out)
    return out


def labelled_urls(urls: DataFrame, rules: list[Rule], labels: DataFrame | None) -> DataFrame:
    """Token sets with labels, and the host they come from. Without ``labels``, what the listed rules say of the URLs they fit,
    less the tokens that a rule itself consists of."""
    if labels is not None:
        rows = labels.select(F.col("url"), "label", F.array().cast("array<string>").alias("own"))
    else:
        rows = urls.where("listed is not null").select("url", F.col("listed.verdict").alias("label"), own_tokens(rules, F.col("listed.rule")).alias("own"))
    return rows.where("label is not null").select(host(F.col("url")).alias("host"), F.array_except(tokens(F.col("url")), "own").alias("tokens"), "label")


def _split(pages: DataFrame, rules: list[Rule], id_col: str, url_col: str) -> DataFrame:
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    urls = urls.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    return urls.withColumn("listed", listed(rules, F.col("host"), F.col("path")))


def match_listed(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Host, path and the listed rule that fits each URL, null where none does: page_id, host, path, rule."""
    return _split(pages, rules, id_col, url_col).select("page_id", "host", "path", F.col("listed.rule").alias("rule"))


def judge(
    pages: DataFrame, rules: list[Rule], labels: DataFrame | None = None, min_support: float = 0.02, min_confidence: float = 0.9,
    min_lift: float = 1.2, default: str = ALLOW, id_col: str = "page_id", url_col: str = "url", local_rules: int = LOCAL_RULES,
) -> DataFrame:
    """Verdict on every URL: page_id, host, path, rule, verdict.

    A listed rule decides where one fits; elsewhere the best association rule does, and ``default`` where none matches. The
    association rules are mined from ``labels`` (columns url, label), or, where that is None, from all URLs of ``pages`` that a
    listed rule has labelled, without the tokens of which that rule itself consists. A rule that says what most labelled
    URLs are anyway is none: its lift is too low.

    Rules are counted: up to ``local_rules`` they travel with the tasks, and matching needs no shuffle; more are joined by their
    rarest token. Null URLs and those without ``://`` have empty host and path, no rule and no tokens, so they get
    ``default``. Ids may be null or repeat; an empty table, or no labelled URL, leaves listed rules and default. Other columns
    are not read.
    """
    urls = _split(pages, rules, id_col, url_col)
    known = labelled_urls(urls, rules, labels)
    said: Column = F.lit(default)
    if not known.isEmpty():
        table = written(rule_table(known, min_support, min_confidence, min_lift), "url-rules")
        if table.count() <= local_rules:
            said = matched(pruned(table), tokens(F.col("url")), default)
        else:
            urls = urls.join(matched_by_join(table, urls), "url", "left")
            said = F.coalesce("said", F.lit(default))
    return urls.select("page_id", "host", "path", F.col("listed.rule").alias("rule"), F.coalesce(F.col("listed.verdict"), said).alias("verdict"))


def held_out_precision(
    pages: DataFrame, rules: list[Rule], labels: DataFrame | None = None, min_support: float = 0.02, min_confidence: float = 0.9, min_lift: float = 1.2,
    folds: int = 5, id_col: str = "page_id", url_col: str = "url",
) -> DataFrame:
    """How far mined rules hold on hosts that they were not mined from: label, said (rows that a rule spoke on), right.

    One host in ``folds``, by a hash, is held out; no row comes back where no rule speaks on any of them.
    """
    known = labelled_urls(_split(pages, rules, id_col, url_col), rules, labels).withColumn("out", F.pmod(F.xxhash64("host"), F.lit(folds)) == 0)
    seen = known.where("not out")
    mined = [] if seen.isEmpty() else mine(seen, min_support, min_confidence, min_lift)
    judged = known.where("out").withColumn("said", matched(mined, F.col("tokens"), "")).where("said <> ''")
    return judged.groupBy(F.col("said").alias("label")).agg(F.count(F.lit(1)).alias("said"), F.count_if(F.col("said") == F.col("label")).alias("right"))
