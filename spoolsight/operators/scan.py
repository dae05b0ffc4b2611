"""Secret scan over messages, tool calls and artifacts, with ignores."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spoolsight.corpus import Corpus
from spoolsight.functions.scalars import ignore_keys, redacted
from spoolsight.shared import written

RULES_SCHEMA = "rule_id string, description string, regex string, keywords array<string>, min_entropy double"
# A small table of rules of our own.
DEFAULT_RULES = [
    ("aws-access-key", "cloud access key id", r"\b((?:AKIA|ASIA)[0-9A-Z]{16})\b", ["akia", "asia"], None),
    ("github-token", "code host token", r"\b(gh[pousr]_[A-Za-z0-9]{36,})\b", ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"], None),
    ("private-key", "private key block", r"(-----BEGIN [A-Z ]*PRIVATE KEY-----)", ["private key"], None),
    ("slack-token", "chat token", r"\b(xox[abprs]-[A-Za-z0-9-]{10,})\b", ["xox"], None),
    ("api-key", "key that starts with sk-", r"\b(sk-[A-Za-z0-9_-]{20,})", ["sk-"], 3.0),
    ("assigned-secret", "value assigned to a secret's name", r"(?i)\b(?:api_?key|secret|token|password|passwd)\b\s*[:=]\s*['\"]?([A-Za-z0-9_/+.=-]{12,})", ["key", "secret", "token", "passw"], 3.0),
]


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DEFAULT_RULES, RULES_SCHEMA)


def rules_fingerprint(rules: DataFrame) -> str:
    """Digest of the rules; when it changes everything is scanned anew."""
    rows = sorted(tuple(map(str, r)) for r in rules.collect())  # the rule table, not data
    return hashlib.sha256(repr(rows).encode()).hexdigest()


def scan_documents(c: Corpus) -> DataFrame:
    """Texts to scan, with the entity and place that each belongs to: message text, call input, result, excerpt and command,
    and whole artifacts."""
    key = lambda *parts: F.concat_ws("/", *(p.cast("string") for p in parts))
    none = F.lit(None).cast("string")
    said = c.messages.select(F.lit("message").alias("entity_type"), "agent", key(F.col("agent"), F.col("session_id"), F.col("seq")).alias("natural_key"), "session_id", none.alias("artifact_kind"), none.alias("artifact_name"), F.col("seq").alias("place"), "text")
    fields = F.explode(F.array(*(F.col(f) for f in ("input", "result", "excerpt", "command"))))
    called = c.tool_calls.select(F.lit("tool_call").alias("entity_type"), "agent", key(F.col("agent"), F.col("session_id"), F.col("seq")).alias("natural_key"), "session_id", none.alias("artifact_kind"), none.alias("artifact_name"), F.col("message_seq").alias("place"), fields.alias("text"))
    made = c.artifacts.select(F.lit("artifact").alias("entity_type"), "agent", key(F.col("agent"), F.col("kind"), F.col("name")).alias("natural_key"), none.alias("session_id"), F.col("kind").alias("artifact_kind"), F.col("name").alias("artifact_name"), F.lit(None).cast("bigint").alias("place"), F.col("content").alias("text"))
    return said.unionByName(called).unionByName(made).where("text is not null and text <> ''")


def entropy(s: Column) -> Column:
    """Shannon entropy of a text's characters, in bits."""
    letters = F.split(s, "")
    n = F.size(letters).cast("double")
    share = lambda ch: F.size(F.filter(letters, lambda x: x == ch)) / n
    return F.aggregate(F.array_distinct(letters), F.lit(0.0), lambda acc, ch: acc - share(ch) * F.log2(share(ch)))


def any_keyword(words: list[str]) -> str:
    """A pattern that finds, at each place of a text, the longest of the words that begins there. Words that begin alike share their
    beginning, so the work at a place does not grow with the number of words."""
    tree: dict = {}
    for w in words:
        at = tree
        for ch in w:
            at = at.setdefault(ch, {})
        at[""] = {}

    def pattern(at: dict) -> str:
        ways = [re.escape(ch) + pattern(below) for ch, below in sorted(at.items()) if ch]
        if not ways:
            return ""
        return "(?:" + "|".join(ways) + ")" + ("?" if "" in at else "")

    first = "".join(re.escape(ch) for ch in sorted(tree))
    return f"(?=[{first}])(?=({pattern(tree)}))" if tree else "(?!)()"


def find_secrets(docs: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Findings: rule, entity, redacted match and its line (the message's number for tool calls), once per entity.

    A rule's pattern runs only on texts that contain one of its keywords in any case, or on all if it has none. One pattern finds all
    rules' keywords in one pass over a text; an inverted index from keyword to rules tells which rules the text meets, and only
    their patterns run. Rules are read on the driver, as they are a table of configuration; the projection does not grow with them.
    """
    names = ("rule_id", "description", "regex", "keywords", "min_entropy")
    table = [tuple(r) for r in rules.select(*names).collect()] if rules is not None else DEFAULT_RULES
    kept = [{"rule_id": r, "regex": x, "place": 1 if re.compile(x).groups else 0, "floor": floor} for r, _, x, _, floor in table]
    index: dict[str, set[int]] = {}
    for n, (_, _, _, keywords, _) in enumerate(table):
        for k in keywords or []:
            index.setdefault(k.lower(), set()).add(n)
    always = {n for n, r in enumerate(table) if not r[3]} | index.pop("", set())
    # the longest word at a place holds all others that begin there
    meets = {k: sorted(set().union(*(index[w] for w in index if k.startswith(w)))) for k in index}
    literal = lambda value, kind: F.from_json(F.lit(json.dumps(value)), kind)
    every = literal(kept, "array<struct<rule_id:string,regex:string,place:int,floor:double>>")
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(any_keyword(sorted(index))), F.lit(1)))
    met = F.flatten(F.transform(found, lambda k: F.try_element_at(literal(meets, "map<string,array<int>>"), k)))
    met = F.array_distinct(F.concat(literal(sorted(always), "array<int>"), met))

    def named(n: Column) -> Column:
        rule = F.get(every, n)
        matches = F.regexp_extract_all("text", rule.regex, rule.place)
        enough = F.filter(F.array_distinct(matches), lambda m: rule.floor.isNull() | (entropy(m) >= rule.floor))
        return F.transform(enough, lambda m: F.struct(rule.rule_id.alias("rule_id"), m.alias("secret")))

    each = docs.select("*", F.explode(F.flatten(F.transform(met, named))).alias("hit")).select("*", "hit.rule_id", "hit.secret")
    before = F.expr("substring(text, 1, locate(secret, text))")
    text_line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
    line = F.when(F.col("entity_type") == "tool_call", F.col("place")).otherwise(text_line).cast("bigint")
    shown = each.select("rule_id", "entity_type", "agent", "natural_key", "session_id", "artifact_kind", "artifact_name", line.alias("line"), redacted(F.col("secret")).alias("redacted"), "secret")
    once = shown.groupBy("rule_id", "entity_type", "agent", "natural_key", "session_id", "artifact_kind", "artifact_name", "secret").agg(F.min("line").alias("line"), F.min("redacted").alias("redacted"))
    return once.drop("secret")


ENTITY = ["entity_type", "natural_key"]


def entity_hashes(docs: DataFrame, fingerprint: str) -> DataFrame:
    """The state of a scan: a hash of each entity's texts, and of the rules."""
    hashed = docs.groupBy(*ENTITY).agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.sha2("text", 256)))), 256).alias("content_hash"))
    return hashed.withColumn("fingerprint", F.lit(fingerprint))


def moved_entities(state: DataFrame, prior: DataFrame) -> DataFrame:
    """Entities whose hash, or whose rules, are not those of the prior state."""
    return state.join(prior, [*ENTITY, "content_hash", "fingerprint"], "left_anti").select(*ENTITY)


def to_scan(docs: DataFrame, prior: DataFrame | None, fingerprint: str) -> tuple[DataFrame, DataFrame]:
    """Texts of entities that changed since a prior scan, or all under other rules; and the new state per entity."""
    state = entity_hashes(docs, fingerprint)
    if prior is None:
        return docs, state
    return docs.join(moved_entities(state, prior), ENTITY, "left_semi"), state


def secret_scan(c: Corpus, rules: DataFrame | None = None, prior: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Findings of the whole corpus and the scan state. With the prior (findings, state), only moved entities are scanned; then all
    texts are hashed once, and the state and the moved entities are written, as both are used several times."""
    rules = default_rules(c.spark) if rules is None else rules
    docs, fingerprint = scan_documents(c), rules_fingerprint(rules)
    if prior is None:
        return find_secrets(docs, rules).withColumn("found_at", F.current_timestamp()), entity_hashes(docs, fingerprint)
    state = written(entity_hashes(docs, fingerprint), "scan-state")
    moved = written(moved_entities(state, prior[1]), "scan-moved")
    found = find_secrets(docs.join(moved, ENTITY, "left_semi"), rules).withColumn("found_at", F.current_timestamp())
    kept = prior[0].join(moved, ENTITY, "left_anti").join(state.select(*ENTITY), ENTITY, "left_semi")
    return kept.unionByName(found, allowMissingColumns=True), state


def _with_ignores(c: Corpus) -> DataFrame:
    """Findings with whether the user ignores them: by this match, or by the rule in this entity whatever the match."""
    keys = ignore_keys(F.col("rule_id"), F.col("natural_key"), F.col("redacted"))
    ignores = c.annotations.where("kind = 'scan_ignore'").select("entity_type", F.col("natural_key").alias("_key")).distinct()
    rows = c.findings.withColumn("_id", F.sha2(F.to_json(F.struct("rule_id", "entity_type", "natural_key", "redacted", "line")), 256))
    hit = rows.select("_id", "entity_type", F.explode(keys).alias("_key")).join(ignores, ["entity_type", "_key"], "left_semi").select("_id").distinct()
    return rows.join(hit.withColumn("ignored", F.lit(True)), "_id", "left").withColumn("ignored", F.coalesce("ignored", F.lit(False))).drop("_id")


def active_findings(c: Corpus) -> DataFrame:
    return _with_ignores(c).where("not ignored")


def scan(c: Corpus, ignored: bool = False) -> DataFrame:
    """Findings with their ignore state; ignored ones only if asked for."""
    rows = _with_ignores(c)
    rows = rows if ignored else rows.where("not ignored")
    return rows.orderBy("rule_id", "natural_key", "line", "redacted")


def scan_rules(c: Corpus) -> DataFrame:
    """Findings by rule, the one with most active findings first."""
    return _with_ignores(c).groupBy("rule_id").agg(F.count(F.lit(1)).alias("findings"), F.count_if(~F.col("ignored")).alias("active"), F.countDistinct("entity_type", "natural_key").alias("entities"), F.max("found_at").alias("last_seen")).orderBy(F.desc("active"), "rule_id")


def set_ignore(annotations: DataFrame, entity_type: str, natural_key: str, rule_id: str, match: str = "*") -> DataFrame:
    """Annotations with one more ignore; ``match`` is the redacted text, or ``*``."""
    spark = annotations.sparkSession
    row = spark.createDataFrame([(entity_type, f"{rule_id}|{natural_key}|{match}")], "entity_type string, natural_key string")
    return annotations.unionByName(row.select("entity_type", "natural_key", F.lit("scan_ignore").alias("kind"), F.lit("").alias("value"), F.current_timestamp().alias("created_at")))


def clear_ignore(annotations: DataFrame, entity_type: str, natural_key: str, rule_id: str, match: str = "*") -> DataFrame:
    gone = (F.col("kind") == "scan_ignore") & (F.col("entity_type") == entity_type) & (F.col("natural_key") == f"{rule_id}|{natural_key}|{match}")
    return annotations.where(~gone)
