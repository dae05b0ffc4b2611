"""Exact cost of token usage from dated and tiered rate cards.

Money is counted in nanodollars and rates in picodollars per token, both whole numbers. Every usage row is priced and rounded
once, before anything is summed up. Tokens without a rate are counted as unpriced, never as free.

A ``RateBook`` holds base rates by key and dated cards by key, each with tiers above a request size. It is a rate file: it grows with
the number of models, not with usage, and is parsed on the driver once. What it says becomes one table of bands, made from
the book alone, so that pricing runs no job before its result is asked for.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from datetime import datetime, timezone
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spoolsight.functions.scalars import usd, usd_exact

ALGORITHM = "priced-1"
LOCAL_ROWS = 20_000
FIELDS = ("input", "output", "cache_write", "cache_write_1h", "cache_read")
_RATE = "struct<input:double,output:double,cache_write:double,cache_write_1h:double,cache_read:double,tiers:array<struct<above_input_tokens:bigint,input:double,output:double,cache_write:double,cache_write_1h:double,cache_read:double>>>"
_DATE = re.compile(r"\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?")
_BAND = "dated boolean, key string, tier_key string, valid_from string, valid_to string, from_text string, to_text string, source string, lo bigint, hi bigint, " + ", ".join(f"{f}_picos bigint" for f in FIELDS)
# What regions and versions look like in hosted model names.
REGION, VERSION = r"^(us|eu|apac|jp|au|ca|global)\.", r"-v\d+(:\d+)?$"
#: One name, or a provider and one: nothing in it is a date, a region or a vendor.
PLAIN = r"^([^/@.]+/)?[^/@.]+$"


@dataclass(frozen=True)
class RateBook:
    spark: SparkSession
    models: dict[str, dict]  # key: rate
    history: dict[str, list[dict]]  # key: readable cards

    @property
    def base(self) -> DataFrame:
        """key, rate"""
        return _literal(self.spark, [{"key": k, "rate": r} for k, r in self.models.items()], f"key string, rate {_RATE}")

    @property
    def cards(self) -> DataFrame:
        """key, effective_from, effective_to, source, rate"""
        rows = [{"key": k, **{n: c.get(n) or "" for n in ("effective_from", "effective_to", "source")}, "rate": c.get("rate")} for k, cards in self.history.items() for c in cards]
        return _literal(self.spark, rows, f"key string, effective_from string, effective_to string, source string, rate {_RATE}")


def load_rates(spark: SparkSession, path: str, prior: RateBook | None = None) -> RateBook:
    """Read a JSON rate file. Models that only a prior book has are kept, so that old usage stays priced."""
    return rates_from_json(spark, spark.read.text(path, wholetext=True).first()[0], prior)


def rates_from_json(spark: SparkSession, text: str, prior: RateBook | None = None) -> RateBook:
    """A book from JSON text. Cards with a start or an end that is no date are left out; a model all of whose cards are left out stays
    in the history without any, so that its dated usage is unpriced and not priced at the current rate."""
    book = json.loads(text)
    name = lambda key: key.strip().lower()
    readable = lambda card: all(not card.get(n) or _instant(card[n]) for n in ("effective_from", "effective_to"))
    models = {name(k): rate for k, rate in (book.get("models") or {}).items()}
    history = {name(k): [c for c in cards if readable(c)] for k, cards in (book.get("history") or {}).items() if cards}
    return RateBook(spark, {**(prior.models if prior else {}), **models}, {**(prior.history if prior else {}), **history})


def _instant(text: str | None) -> datetime | None:
    if not text or not _DATE.fullmatch(text):
        return None
    try:
        at = datetime.fromisoformat(text)
    except ValueError:
        return None
    return at.replace(tzinfo=timezone.utc) if at.tzinfo is None else at.astimezone(timezone.utc)


def _literal(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table that is a literal of the plan."""
    kind = "array<struct<" + re.sub(r"(^|, )(\w+) ", r"\1\2:", schema) + ">>"
    return spark.range(0, 1, 1, 1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), kind)))


def fingerprint(book: RateBook) -> str:
    """Digest of all rates and of the pricing rules; rollups built under another one are stale."""
    rows = book.base.select(F.to_json(F.struct("key", "rate")).alias("j")).union(book.cards.select(F.to_json(F.struct("key", "effective_from", "effective_to", "source", "rate"))))
    gaps = json.dumps(sorted(k for k, cards in book.history.items() if not cards))
    digest = rows.agg(F.sha2(F.concat_ws("\n", F.lit(ALGORITHM), F.lit(gaps), F.array_join(F.array_sort(F.collect_list("j")), "\n")), 256)).first()[0]
    return digest


def pricing_model(provider: Column, model: Column) -> Column:
    """Model as it is looked up: with its provider, unless it names one."""
    p, m = F.trim(F.coalesce(provider, F.lit(""))), F.trim(F.coalesce(model, F.lit("")))
    return F.when((p == "") | (m == "") | m.contains("/"), m).otherwise(F.concat(p, F.lit("/"), m))


def candidates(model: Column) -> Column:
    """Keys to try in turn: the name, its tails after each slash, without a date after ``@``, without region and vendor,
    without version. None for a blank model. Most names are plain and have themselves and what follows their slash."""
    base = F.lower(F.trim(model))
    plain = base.rlike(PLAIN) & ~base.rlike(VERSION)
    few = F.when(base.contains("/"), F.array(base, F.substring_index(base, "/", -1))).otherwise(F.array(base))
    parts = F.split(base, "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    tail = F.element_at(F.filter(tails, lambda t: t != ""), -1)
    dated = F.when(F.locate("@", tail) > 1, F.substring_index(tail, "@", 1))
    local = F.regexp_replace(tail, REGION, "")
    vendor = F.substring_index(local, ".", 1)
    bare = F.when(local.contains(".") & ~vendor.contains("-"), F.substring(local, F.length(vendor) + 2, F.length(local)))
    every = F.concat(tails, F.array(dated, local, bare, F.regexp_replace(bare, VERSION, ""), F.regexp_replace(local, VERSION, "")))
    return F.when(F.coalesce(base, F.lit("")) == "", F.array().cast("array<string>")).when(plain, few).otherwise(F.array_distinct(F.filter(every, lambda k: k.isNotNull() & (k != ""))))


def _picos(rate: float | None) -> int | None:
    return None if rate is None else int(Decimal(repr(rate * 1e12)).quantize(Decimal(1), ROUND_HALF_UP))


def _tiered(rate: dict, tiers: list[dict]) -> list[dict]:
    """Ranges of request size ``(lo, hi]`` with their picodollars; what a tier leaves out is as in the range below."""
    out: list[dict] = []
    for entry in [{**rate, "above_input_tokens": -1}, *sorted(tiers or [], key=lambda t: t["above_input_tokens"])]:
        if out:
            out[-1]["hi"] = entry["above_input_tokens"]
        below = out[-1] if out else {}
        out.append({"lo": entry["above_input_tokens"], "hi": None} | {f"{f}_picos": _picos(entry[f]) if entry.get(f) is not None else below.get(f"{f}_picos") for f in FIELDS})
    return out


def _stretches(cards: list[dict]) -> list[tuple[datetime | None, datetime | None, dict]]:
    """Stretches of time, and the card that holds in each: of overlapping ones that with the latest start."""
    dated = [(_instant(c.get("effective_from")), _instant(c.get("effective_to")), c) for c in cards]
    borders = sorted({b for a, z, _ in dated for b in (a, z) if b is not None})
    out = []
    for begin, end in zip([None, *borders], [*borders, None]):
        holding = [c for a, z, c in dated if (a is None or begin is not None and a <= begin) and (z is None or begin is None or begin < z)]
        if holding:
            out.append((begin, end, max(holding, key=lambda c: (c.get("effective_from") or "", c.get("effective_to") or "", c.get("source") or ""))))
    return out


def _inheriting(book: RateBook) -> tuple[list[str], list[str]]:
    """Keys with a card without tiers, and keys whose current rate has tiers that such a card takes."""
    return [k for k, cards in book.history.items() if any(not (c.get("rate") or {}).get("tiers") for c in cards)], [k for k, r in book.models.items() if r.get("tiers")]


def band_rows(book: RateBook) -> list[dict]:
    """All rates of a book as bands that do not overlap.

    One row per key, dated or not, stretch of time and range of request size; so a lookup is an equality with two ranges and
    finds one row at most. Times that no card covers have no row, though the model has a current rate. A card without
    tiers takes those of the current rate, named by ``tier_key``.
    """
    rows = [{"dated": False, "key": k, "tier_key": "", **band} for k, rate in book.models.items() for band in _tiered(rate, rate.get("tiers"))]
    inheriting, tiered = _inheriting(book)
    text = lambda t: None if t is None else t.strftime("%Y-%m-%d %H:%M:%S.%f")
    for key, cards in book.history.items():
        for begin, end, card in _stretches(cards):
            rate = card.get("rate") or {}
            about = {"dated": True, "key": key, "valid_from": text(begin), "valid_to": text(end), "from_text": card.get("effective_from") or "", "to_text": card.get("effective_to") or "", "source": card.get("source") or ""}
            for tier_key in ["", *(tiered if key in inheriting else [])]:
                tiers = rate.get("tiers") or (book.models[tier_key]["tiers"] if tier_key else [])
                rows += [about | {"tier_key": tier_key} | band for band in _tiered(rate, tiers)]
    return rows


def _positive(c: str) -> Column:
    return F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0)).cast("bigint")


def _matched(usage: DataFrame, book: RateBook) -> DataFrame:
    """Usage with the band that each row meets. The keys to try are looked up in the row, in hash sets of the book's keys."""
    rows = band_rows(book)
    table = _literal(book.spark, rows, _BAND).select(*(F.col(c).alias(f"_{c}") for c in ("dated", "key", "tier_key", "from_text", "to_text", "source", "lo", "hi", *(f"{f}_picos" for f in FIELDS))), *(F.to_timestamp(c).alias(f"_{c}") for c in ("valid_from", "valid_to")))
    inheriting, tiered = _inheriting(book)
    c, none = F.col, F.lit("")
    first = lambda keys: F.coalesce(F.try_element_at(F.filter("_tried", lambda k: k.isin(list(keys))), F.lit(1)), none)
    tried = usage.withColumn("_tried", candidates(pricing_model(c("provider"), c("model")))).withColumns({"_current": first(book.models), "_card": first(book.history)}).drop("_tried")
    # usage without a time, and of models that no card is of, meets the current rate
    by_card = c("created_at").isNotNull() & (c("_card") != "")
    asked = tried.withColumns({"_by_card": by_card, "_asked": F.when(by_card, c("_card")).otherwise(c("_current")), "_inherits": F.when(by_card & c("_card").isin(inheriting) & c("_current").isin(tiered), c("_current")).otherwise(none)})
    size, at = _positive("input") + _positive("cache_read") + _positive("cache_write"), c("created_at")
    meets = (
        (c("_by_card") == c("_dated")) & (c("_asked") == c("_key")) & (c("_inherits") == c("_tier_key"))
        & (~c("_by_card") | ((c("_valid_from").isNull() | (at >= c("_valid_from"))) & (c("_valid_to").isNull() | (at < c("_valid_to")))))
        & (size > c("_lo")) & (c("_hi").isNull() | (size <= c("_hi")))
    )
    return asked.join(F.broadcast(table) if len(rows) <= LOCAL_ROWS else table, meets, "left")


def price(usage: DataFrame, book: RateBook) -> DataFrame:
    """Adds cost to every usage row: amount, reported and estimated nanodollars, and unpriced tokens by bucket.

    A reported cost other than zero holds; a reported zero holds only for a row without tokens; everything else is
    estimated. The book's bands are counted before they are broadcast, so the usage itself is not shuffled.
    """
    c, whole = F.col, lambda x: x.cast("decimal(19,0)")
    i, o, r, w = (_positive(n) for n in ("input", "output", "cache_read", "cache_write"))
    w1 = F.least(_positive("cache_write_1h"), w)
    w5 = w - w1
    total = i + o + r + w
    known = c("_key").isNotNull()
    reported = c("reported_nanos").isNotNull() & ((c("reported_nanos") != 0) | (total == 0))
    parts = [(i, "input"), (o, "output"), (r, "cache_read"), (w5, "cache_write"), (w1, "cache_write_1h")]
    zero = F.lit(0).cast("decimal(38,0)")
    picos = zero
    for tokens, field in parts:
        picos = (picos + F.coalesce((whole(tokens) * whole(c(f"_{field}_picos"))).cast("decimal(38,0)"), zero)).cast("decimal(38,0)")
    estimated = F.when(reported | ~known | (total == 0), F.lit(0).cast("bigint")).otherwise(c("_nanos"))
    missing = lambda tokens, field: F.when(~reported & (~known | c(f"_{field}_picos").isNull()), tokens).otherwise(F.lit(0).cast("bigint"))
    out = _matched(usage, book).withColumn("_picos_sum", picos).withColumn("_nanos", F.expr("CAST((_picos_sum + 500) DIV 1000 AS BIGINT)"))
    out = out.withColumns({
        "reported_cost_nanos": F.when(reported, c("reported_nanos")).otherwise(F.lit(0).cast("bigint")),
        "estimated_nanos": estimated,
        "unpriced_input": missing(i, "input"), "unpriced_output": missing(o, "output"), "unpriced_cache_read": missing(r, "cache_read"),
        "unpriced_cache_write": missing(w5, "cache_write") + missing(w1, "cache_write_1h"),
        "total_tokens": total,
    })
    out = out.withColumn("amount_nanos", c("reported_cost_nanos") + c("estimated_nanos"))
    out = out.withColumn("unpriced_tokens", c("unpriced_input") + c("unpriced_output") + c("unpriced_cache_read") + c("unpriced_cache_write"))
    return out.drop(*(x for x in out.columns if x.startswith("_")))


def explain_pricing(requests: DataFrame, book: RateBook) -> DataFrame:
    """Which rate applies to each request: ``provider``, ``model``, ``created_at`` (null: now) and ``input`` tokens.

    Adds found, key, the card's dates and source, the tier's threshold, and the rates in picodollars.
    """
    asked = requests.withColumns({n: F.lit(0).cast("bigint") for n in ("cache_read", "cache_write") if n not in requests.columns})
    found = _matched(asked, book)
    return found.select(
        *requests.columns, F.col("_key").isNotNull().alias("found"), F.coalesce("_key", F.lit("")).alias("key"), F.coalesce("_from_text", F.lit("")).alias("effective_from"),
        F.coalesce("_to_text", F.lit("")).alias("effective_to"), F.coalesce("_source", F.lit("")).alias("source"), F.greatest(F.coalesce("_lo", F.lit(0)), F.lit(0)).alias("above_input_tokens"),
        *(F.col(f"_{f}_picos").alias(f"{f}_picos") for f in FIELDS),
    )


def money(df: DataFrame, column: str = "amount_nanos", name: str = "cost_usd") -> DataFrame:
    """Adds dollars as a double and as exact text."""
    return df.withColumns({name: usd(F.col(column)), f"{name}_exact": usd_exact(F.col(column))})
