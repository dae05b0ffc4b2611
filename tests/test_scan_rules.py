"""Many secret rules in one pass against rule by rule."""

import math
import random
import re

from pyspark.sql import functions as F

from spoolsight.operators import scan

SCHEMA = "entity_type string, agent string, natural_key string, session_id string, artifact_kind string, artifact_name string, place bigint, text string"


def test_two_hundred_rules_equal_rule_by_rule(spark):
    pick = random.Random(3)
    stems = ["ab", "abc", "bc", "c.d", "Key", "keyring", "ring", "[x", "é", "zz"]
    rules = []
    for n in range(200):
        words = [pick.choice(stems) + (str(n % 7) if n % 3 else "") for _ in range(pick.randrange(3))]
        rules.append((f"r{n}", "", rf"(?i){re.escape(pick.choice(stems))}[:=]?(\d{{2,}}{n % 9})" if n % 2 else rf"{n % 50}\d+", words, 1.0 if n % 4 == 0 else None))
    texts = ["", "abc1 abc:12345 KEYRING2=777770", "nothing here 4711", *("".join(pick.choice([*stems, "=", ":", " ", "1", "2", "34", "\n"]) for _ in range(60)) for _ in range(60))]
    docs = spark.createDataFrame([("message", "a", f"a/s/{k}", "s", None, None, k, t) for k, t in enumerate(texts)], SCHEMA)
    table = spark.createDataFrame(rules, scan.RULES_SCHEMA)
    want = set()
    for rule_id, _, regex, words, floor in rules:
        for k, text in enumerate(texts):
            if words and not any(w.lower() in text.lower() for w in words):
                continue
            for m in re.finditer(regex, text):
                secret = m.group(1) if re.compile(regex).groups else m.group(0)
                shares = [secret.count(ch) / len(secret) for ch in set(secret)]
                if floor is None or -sum(p * math.log2(p) for p in shares) >= floor - 1e-12:
                    want.add((rule_id, f"a/s/{k}", text[: text.index(secret)].count("\n") + 1))
    found = scan.find_secrets(docs, table)
    assert {(r.rule_id, r.natural_key, r.line) for r in found.collect()} == want and len(want) > 200
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("regexp_extract_all", plan)) <= 4  # no column a rule


def test_keywords_that_hold_others(spark):
    words = ["key", "keyring", "ring", "k", "r.", "[", "-"]
    text = "xkeyringr.[a-"
    found = spark.range(1).select(F.regexp_extract_all(F.lit(text), F.lit(scan.any_keyword(words)), F.lit(1)).alias("v")).first().v
    assert found == ["keyring", "ring", "r.", "[", "-"]
    assert spark.range(1).select(F.regexp_extract_all(F.lit(text), F.lit(scan.any_keyword([])), F.lit(1)).alias("v")).first().v == []


def test_no_rules_and_no_texts(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert scan.find_secrets(empty).count() == 0
    one = spark.createDataFrame([("message", "a", "k", "s", None, None, 1, "token: abcdefghijklmnop")], SCHEMA)
    assert scan.find_secrets(one, spark.createDataFrame([], scan.RULES_SCHEMA)).count() == 0
