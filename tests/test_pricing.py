import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from spoolsight.corpus import Corpus
from spoolsight.operators import pricing, usage

BOOK = {
    "models": {
        "big": {"input": 1e-6, "output": 2e-6, "cache_read": 1e-7, "cache_write": 1.5e-6, "cache_write_1h": 3e-6, "tiers": [{"above_input_tokens": 1000, "input": 4e-6}, {"above_input_tokens": 2000, "output": 9e-6}]},
        "small": {"input": 1e-6, "output": 1e-6, "cache_write": 1e-6},
        "odd": {"input": 1.2345e-9, "output": 0},
    },
    "history": {"big": [{"effective_from": "2026-01-01", "effective_to": "2026-02-01", "source": "one", "rate": {"input": 1e-5, "output": 1e-5}}, {"effective_from": "2026-01-10", "effective_to": "2026-01-20", "source": "two", "rate": {"input": 2e-5, "output": 2e-5, "tiers": [{"above_input_tokens": 5, "input": 3e-5}]}}, {"effective_from": "nonsense", "rate": {"input": 1, "output": 1}}]},
}


@pytest.fixture(scope="module")
def book(spark):
    return pricing.rates_from_json(spark, json.dumps(BOOK))


def claims(spark, rows):
    base = {"agent": "a", "session_id": "s", "content_id": "", "request_id": "", "provider": "", "input": 0, "output": 0, "cache_read": 0, "cache_write": 0, "cache_write_1h": 0, "reasoning": 0, "service_tier": "", "reported_nanos": None, "parser_version": 1, "created_at": None, "model": ""}
    from spoolsight.corpus import SCHEMAS, schema

    names = [f.name for f in schema("usage")]
    return spark.createDataFrame([tuple((base | {"seq": k} | r)[n] for n in names) for k, r in enumerate(rows)], SCHEMAS["usage"])


def priced(spark, book, *rows):
    return {r.seq: r for r in pricing.price(claims(spark, rows), book).collect()}


def test_buckets_tiers_and_rounding(spark, book):
    r = priced(
        spark, book, {"model": "big", "input": 1000, "output": 1}, {"model": "big", "input": 1001, "output": 1}, {"model": "big", "input": 1000, "cache_read": 1001}, {"model": "small", "cache_read": 7, "cache_write": 10, "cache_write_1h": 99},
        {"model": "odd", "input": 1}, {"model": "big", "input": -5, "cache_write": 4, "cache_write_1h": -1}, {"model": "none", "input": 3, "cache_write": 2}, {"model": "", "input": 3},
    )
    assert r[0].amount_nanos == 1000 * 1000 + 2000 and r[1].amount_nanos == 1001 * 4000 + 2000  # strictly above the threshold
    assert r[2].amount_nanos == 1000 * 4000 + 1001 * 100  # cache reads count for the tier
    assert (r[3].amount_nanos, r[3].unpriced_cache_read, r[3].unpriced_cache_write) == (0, 7, 10)  # one-hour writes have no rate and take all
    assert r[4].amount_nanos == 1  # 1235 picodollars, half up
    assert r[5].amount_nanos == 4 * 1500
    assert (r[6].amount_nanos, r[6].unpriced_input, r[6].unpriced_cache_write, r[6].unpriced_tokens) == (0, 3, 2, 5) and r[7].unpriced_tokens == 3


def test_reported_costs(spark, book):
    r = priced(spark, book, {"model": "big", "input": 10, "reported_nanos": 77}, {"model": "big", "input": 10, "reported_nanos": 0}, {"model": "big", "reported_nanos": 0}, {"model": "none", "input": 5, "reported_nanos": 3})
    assert [(r[k].amount_nanos, r[k].reported_cost_nanos, r[k].estimated_nanos, r[k].unpriced_tokens) for k in range(4)] == [(77, 77, 0, 0), (10_000, 0, 10_000, 0), (0, 0, 0, 0), (3, 3, 0, 0)]


def test_dated_cards(spark, book):
    at = lambda month, day: {"model": "big", "input": 10, "created_at": datetime(2026, month, day)}
    r = priced(spark, book, at(1, 5), at(1, 15), at(1, 25), at(2, 1), {"model": "big", "input": 10}, {"model": "small", "input": 10, "created_at": datetime(2026, 1, 5)}, {**at(1, 5), "input": 1001})
    assert [r[k].amount_nanos for k in range(6)] == [100_000, 300_000, 100_000, 0, 10_000, 10_000]
    assert r[3].unpriced_input == 10  # a gap is unpriced although a current rate exists
    assert r[6].amount_nanos == 1001 * 4000  # a card without tiers takes the current ones
    asked = spark.createDataFrame([("", "us.vendor.big-v1:0", datetime(2026, 1, 15), 10), ("p", "x/big@20250101", None, 1500), ("", "", None, 1)], "provider string, model string, created_at timestamp, input bigint")
    got = {e.model: e for e in pricing.explain_pricing(asked, book).collect()}
    assert (got["us.vendor.big-v1:0"].key, got["us.vendor.big-v1:0"].source, got["us.vendor.big-v1:0"].above_input_tokens) == ("big", "two", 5)
    assert (got["x/big@20250101"].above_input_tokens, got["x/big@20250101"].input_picos) == (1000, 4_000_000) and not got[""].found


def test_candidates_and_fingerprint(spark, book):
    keys = lambda m: spark.range(1).select(pricing.candidates(F.lit(m)).alias("k")).first().k
    assert keys("OpenRouter/Vendor/Claude-X@2025") == ["openrouter/vendor/claude-x@2025", "vendor/claude-x@2025", "claude-x@2025", "claude-x"]
    assert keys("us.vendor.model-v2:0") == ["us.vendor.model-v2:0", "vendor.model-v2:0", "model-v2:0", "model", "vendor.model"]
    assert keys("  ") == []
    other = json.loads(json.dumps(BOOK))
    other["models"]["big"]["input"] = 2e-6
    assert pricing.fingerprint(book) == pricing.fingerprint(pricing.rates_from_json(spark, json.dumps(BOOK))) != pricing.fingerprint(pricing.rates_from_json(spark, json.dumps(other)))
    merged = pricing.rates_from_json(spark, '{"models": {"new": {"input": 1, "output": 1}}}', book)
    assert {r.key for r in merged.base.collect()} == {"new", "big", "small", "odd"}


def test_ownership_and_richest_claim(spark, book):
    sessions = spark.createDataFrame([("a", "late", datetime(2026, 1, 3)), ("a", "early", datetime(2026, 1, 2)), ("a", "open", None)], "agent string, session_id string, modified_at timestamp").withColumn("created_at", F.lit(None).cast("timestamp"))
    rows = claims(spark, [{"session_id": "late", "content_id": "c", "request_id": "r"}, {"session_id": "early", "content_id": "c", "request_id": "r"}, {"session_id": "open", "content_id": "c", "request_id": "r"}, {"session_id": "late"}, {"session_id": "late"}, {"session_id": "late", "content_id": "c", "request_id": ""}])
    owned = usage.own_usage(rows, sessions).collect()
    assert sorted(r.seq for r in owned) == [1, 3, 4, 5]
    seen = claims(spark, [{"content_id": "c", "output": 5, "parser_version": 1, "reported_nanos": 9}, {"content_id": "c", "output": 1, "parser_version": 2, "reported_nanos": 4}, {"content_id": "c", "output": 3, "parser_version": 2}, {"content_id": "c", "output": 3, "parser_version": 2}, {"content_id": ""}, {"content_id": ""}])
    best = {r.seq: r for r in usage.richest_claims(seen).collect()}
    assert set(best) == {3, 4, 5} and best[3].reported_nanos == 4


def test_bad_arguments(spark, book):
    from spoolsight.operators import activity, filters, sessions

    c = Corpus(spark, rates=book)
    for call in (lambda: usage.usage(c, "hour"), lambda: usage.usage(c, since="2026-1-1"), lambda: usage.usage(c, limit=-1), lambda: usage.blocks(c, limit=201), lambda: sessions.sessions(c, limit=501), lambda: sessions.sessions(c, offset=-1), lambda: activity.session_events(c, kind="turn,none"), lambda: activity.tool_stats(c, sort="x"), lambda: activity.export_commands(c, "csh"), lambda: sessions.transcript(c, "a", "s", from_seq=-1), lambda: filters.day("2026-13-01")):
        with pytest.raises(ValueError):
            call()
    with pytest.raises(LookupError):
        sessions.session(c, "a", "none")
    with pytest.raises(LookupError):
        activity.tool(c, "a", "s", 1)
    assert sessions.sessions(c).count() == 0 and usage.usage(c).count() == 0


def test_cards_that_cannot_be_read_leave_a_gap(spark):
    text = '{"models": {"m": {"input": 0.000001}, "n": {"input": 0.000001}}, "history": {"m": [{"effective_from": "spring", "rate": {"input": 0.000002}}], "n": []}}'
    book = pricing.rates_from_json(spark, text)
    rows = spark.createDataFrame([("m", "2024-01-01"), ("m", None), ("n", "2024-01-01")], "model string, at string").selectExpr("'' AS provider", "model", "CAST(at AS timestamp) AS created_at", "1000000L AS input")
    got = {(r.model, r.created_at is None): (r.found, r.key) for r in pricing.explain_pricing(rows, book).collect()}
    assert got == {("m", False): (False, ""), ("m", True): (True, "m"), ("n", False): (True, "n")}
    without = pricing.rates_from_json(spark, text.replace("spring", ""))
    assert pricing.fingerprint(book) != pricing.fingerprint(without) != pricing.fingerprint(pricing.rates_from_json(spark, '{"models": {"m": {"input": 0.000001}, "n": {"input": 0.000001}}}'))


def test_keys_of_plain_names_and_of_others(spark):
    want = {"M-Large": ["m-large"], "alpha/m": ["alpha/m", "m"], "a/a": ["a/a", "a"], "m/": ["m/"], "/m": ["/m", "m"], "m-v1": ["m-v1", "m"], "p/m-v1:0": ["p/m-v1:0", "m-v1:0", "m"],
            "a/b/c": ["a/b/c", "b/c", "c"], "m@1": ["m@1", "m"], "us.x.m": ["us.x.m", "x.m", "m"], " ": []}
    got = spark.createDataFrame([(n,) for n in want], "n string").select("n", pricing.candidates(F.col("n")).alias("k"))
    assert {r.n: r.k for r in got.collect()} == want
