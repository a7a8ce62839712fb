"""Text functions on columns: normalising, event candidates, relevance, sentiment, hashes, similarity."""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

try:
    from _md5 import md5  # half the time of OpenSSL's on short texts
except ImportError:
    from hashlib import md5

# Taxonomy order and patterns of event candidates.
EVENT_PATTERNS = {
    "earnings": (r"\bearnings\b", r"\bquarterly results?\b", r"\b(?:revenue|sales|eps|earnings per share|operating margin)\b.*\b(?:beat|miss|rose|fell|reported)\b", r"\b(?:q[1-4]|fiscal (?:quarter|year))\b.*\bresults?\b"),
    "guidance": (r"\b(?:raises?|cuts?|lowers?|withdraws?|reaffirms?) (?:its )?(?:guidance|outlook|forecast)\b", r"\b(?:raises?|cuts?|lowers?|withdraws?|reaffirms?)\b.{0,30}\b(?:guidance|outlook|forecast)\b", r"\b(?:guidance|outlook) (?:raised|lowered|cut|withdrawn|reaffirmed)\b", r"\bforecasts? (?:revenue|sales|earnings|eps)\b"),
    "analyst_action": (r"\b(?:upgrades?|downgrades?|initiates?|reiterates?)\b", r"\bprice target\b", r"\b(?:buy|sell|hold|overweight|underweight) rating\b"),
    "merger_acquisition": (r"\b(?:merger|acquisition|acquires?|acquired|takeover|buyout|divestiture|divests?)\b", r"\b(?:deal|transaction) valued at\b"),
    "regulatory": (r"\b(?:regulator|regulatory|antitrust|doj|ftc|sec|fda|eu commission)\b", r"\b(?:probe|investigation|approval|clearance|consent order)\b"),
    "litigation": (r"\b(?:lawsuit|litigation|sues?|sued|settlement|court ruling|class action|verdict)\b",),
    "cybersecurity": (r"\b(?:cyberattack|cyber attack|ransomware|data breach|hacked|security breach)\b",),
    "fraud_accounting": (r"\b(?:fraud|accounting irregularit|restatement|misstatement|whistleblower)\w*\b", r"\b(?:bankruptcy|chapter 11|going concern|insolven)\w*\b"),
    "dividend": (r"\b(?:declares?|raises?|cuts?|suspends?) (?:a |its )?(?:quarterly )?dividend\b",),
    "buyback": (r"\b(?:buyback|share repurchase|repurchase program|repurchase authorization)\b",),
    "management": (r"\b(?:appoints?|names?|resigns?|retires?|ousts?)\b.*\b(?:ceo|cfo|chair|president|executive)\b", r"\b(?:ceo|cfo|chief executive|chief financial officer)\b.*\b(?:resigns?|retires?|appointed|named)\b"),
    "financing": (r"\b(?:debt offering|equity offering|secondary offering|convertible notes?|raises? capital|refinanc)\w*\b",),
    "restructuring": (r"\b(?:restructuring|reorganization|layoffs?|job cuts?|cost-cutting|strategic review)\b",),
    "operations": (r"\b(?:outage|disruption|shutdown|strike|recall|production halt|supply shortage|plant closure)\b", r"\b(?:production|deliveries|shipments)\b.*\b(?:rose|fell|halted|suspended|missed)\b"),
    "product": (r"\b(?:launches?|unveils?|introduces?|approves?|approval)\b.*\b(?:product|drug|platform|service|device|model)\b", r"\b(?:product launch|new drug|clinical trial|phase [123]|fda approval)\b"),
    "capital_allocation": (r"\b(?:capital allocation|special dividend|asset sale|investment plan|capital spending|capex)\b",),
    "macro_exposure": (r"\b(?:tariff|interest rates?|inflation|currency headwind|commodity prices?|recession)\b",),
}
# Words of keyword sentiment.
POSITIVE = ("approval", "beat", "beats", "growth", "increase", "profit", "raises", "record", "strong", "upgrade")
NEGATIVE = ("bankruptcy", "decline", "downgrade", "fraud", "investigation", "loss", "miss", "misses", "reduced", "weak")
# Words of the contradiction test.
CONTRAST = ("although", "but", "despite", "however", "while", "yet")
GOOD = ("approval", "beat", "growth", "improved", "profit", "raised", "record", "strong", "upgrade")
BAD = ("bankruptcy", "decline", "downgrade", "fraud", "investigation", "loss", "missed", "reduced", "weak")
# Ordered substrings of sampling buckets.
BUCKET_TERMS = {
    "earnings": ("earnings", "quarterly results", "revenue", "eps", "profit"),
    "guidance": ("guidance", "forecast", "outlook", "expects", "raises forecast"),
    "analyst_action": ("upgrade", "downgrade", "price target", "analyst", "rating"),
    "product_news": ("launch", "product", "approval", "drug", "platform", "service"),
    "litigation": ("lawsuit", "litigation", "court", "settlement", "sued"),
    "regulation": ("regulator", "regulatory", "antitrust", "ftc", "sec ", "doj "),
    "capital_allocation": ("buyback", "repurchase", "dividend", "acquisition", "merger"),
    "operational": ("outage", "disruption", "recall", "production", "strike", "cyber"),
}
# Weights of the relevance components.
RELEVANCE = {"headline_company": 0.30, "headline_ticker": 0.10, "opening_company": 0.20, "repeated_company_mentions": 0.10, "primary_subject": 0.10, "specific_event": 0.15, "adequate_text": 0.05, "generic_penalty": -0.25, "multi_ticker_penalty": -0.20, "missing_provider_symbol_penalty": -0.40}

# Titles of market summaries and lists, and legal suffixes of company names.
GENERIC_TITLE = r"(?i)\b(?:market (?:wrap|roundup|update)|stocks? (?:to watch|today)|top \d+ stocks?|best stocks?|sector (?:wrap|roundup)|what investors need to know|stock market today|premarket|closing bell)\b"
LISTICLE = r"(?i)\b(?:\d+|five|ten|three)\s+(?:best|top|stocks?|companies|reasons)\b"
LEGAL_SUFFIX = r"(?i)\b(?:incorporated|corporation|company|inc|corp|plc|ltd|limited|holdings?|group)\b\.?"

TOKEN = r"[a-z0-9]+(?:'[a-z]+)?"


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode compatibility form, case-folded; Spark has no built-in for either."""
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())


@F.pandas_udf(T.StringType())
def compatible(text: pd.Series) -> pd.Series:
    """Unicode compatibility form."""
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def collapsed(text: Column) -> Column:
    """White space runs to single spaces, ends trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def tokens(text: Column) -> Column:
    """Lower-case alphanumeric tokens of ASCII text (pass ``nfkc`` text for the full form)."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def normalised(text: Column) -> Column:
    """Tokens of ASCII text, joined by spaces."""
    return F.array_join(tokens(text), " ")


@F.pandas_udf(T.StringType())
def normal_form(text: pd.Series) -> pd.Series:
    """Tokens of the text in compatibility form, case-folded, joined by spaces; null counts as empty. One Arrow pass, as patterns read it many times."""
    find = re.compile(TOKEN).findall
    return text.map(lambda x: " ".join(find(unicodedata.normalize("NFKC", x or "").casefold())))


def body_hash(body: Column) -> Column:
    """SHA-256 of the body in compatibility form, case-folded, white space collapsed: equal for copies that differ in form alone."""
    return F.sha2(collapsed(nfkc(body)), 256)


def content_hash(title: Column, body: Column) -> Column:
    """SHA-256 of title and body in compatibility form with white space collapsed; case counts."""
    return F.sha2(F.concat_ws("\n", collapsed(compatible(title)), collapsed(compatible(body))), 256)


def text_type(title: Column, body: Column, least: int) -> Column:
    """full_text where the body, collapsed, is long enough and isn't the title over again; else headline_only."""
    own = collapsed(body)
    again = collapsed(nfkc(body)) == collapsed(nfkc(title))
    return F.when((F.length(own) >= least) & ~again, "full_text").otherwise("headline_only")


def is_generic(title: Column) -> Column:
    """Title of a market summary or a list."""
    return title.rlike(GENERIC_TITLE) | title.rlike(LISTICLE)


def is_market_summary(title: Column, symbols: Column, least: int) -> Column:
    """Many symbols and a title that names no one company."""
    return (F.size(symbols) >= least) & title.rlike(GENERIC_TITLE)


def word_limit(text: Column, most: int) -> Column:
    """Not empty and at most so many words."""
    words = collapsed(text)
    return (words != "") & (F.size(F.split(words, " ")) <= most)


def aliases(universe: DataFrame) -> DataFrame:
    """``aliases`` of each member (ticker, company_name, names) in normal form: its names, and the company name without legal suffixes; three letters at least."""
    raw = F.concat(F.array("company_name"), F.coalesce("names", F.array().cast("array<string>")), F.array(F.regexp_replace("company_name", LEGAL_SUFFIX, " ")))
    rows = universe.select("ticker", F.explode(raw).alias("name")).select("ticker", normal_form("name").alias("alias")).where("length(alias) >= 3")
    made = rows.groupBy("ticker").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    return universe.join(made, "ticker", "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))


def company_relevance(articles: DataFrame, universe: DataFrame, *, minimum_text: int = 400, minimum_score: float = 0.55, maximum_symbols: int = 5) -> DataFrame:
    """How specific an article (ticker, title, body, symbols) is to its company, before any model sees it.

    Adds score (ten weighted components, from 0 to 1), eligible, reasons (what
    speaks against it, in order) and candidates (event types). The universe, a
    dimension of companies, is joined by ticker.
    """
    member = aliases(universe).select("ticker", "aliases")
    rows = articles.join(member, "ticker").withColumns({"_title": normal_form("title"), "_body": normal_form("body")})
    base = F.lower(F.split_part("ticker", F.lit("."), F.lit(1)))
    rows = rows.withColumns({"_opening": F.array_join(F.slice(F.split("_body", " "), 1, 120), " "), "_base": base, "_pattern": F.concat(F.lit(r"(?i)(?:\$|\b)"), base, F.lit(r"\b"))})
    any_alias = lambda text: F.exists("aliases", lambda a: F.contains(F.col(text), a))
    flags = {
        "_headline": any_alias("_title"), "_open": any_alias("_opening"), "_mentions": F.aggregate("aliases", F.lit(0), lambda n, a: n + F.regexp_count(F.col("_body"), a)),
        "_symbol_title": (F.length("_base") >= 3) & F.expr("title rlike _pattern"), "_symbol": F.array_contains("symbols", F.col("ticker")), "_low": F.length(collapsed(F.col("body"))) < minimum_text,
        "_generic": is_generic(F.col("title")), "_many": F.size("symbols") > maximum_symbols, "candidates": event_candidates(F.col("title"), F.col("body")),
    }
    rows = rows.withColumns(flags)
    rows = rows.withColumn("_subject", F.col("_headline") & (F.col("_open") | (F.col("_mentions") >= 2)))
    c = F.col
    parts = {
        "headline_company": c("_headline"), "headline_ticker": c("_symbol_title"), "opening_company": c("_open"), "repeated_company_mentions": c("_mentions") >= 2, "primary_subject": c("_subject"), "specific_event": c("candidates") != F.array(F.lit("other")),
        "adequate_text": ~c("_low"), "generic_penalty": c("_generic"), "multi_ticker_penalty": c("_many"), "missing_provider_symbol_penalty": ~c("_symbol"),
    }
    total = sum((F.when(ok, RELEVANCE[k]).otherwise(0.0) for k, ok in parts.items()), F.lit(0.0))
    against = {"provider_symbol_missing": ~c("_symbol"), "target_not_in_headline": ~(c("_headline") | c("_symbol_title")), "target_not_in_opening": ~c("_open"), "low_information_text": c("_low"), "generic_or_listicle": c("_generic"), "too_many_unrelated_symbols": c("_many"), "target_not_primary_subject": ~c("_subject")}
    rows = rows.withColumns({"score": F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 12), "reasons": F.filter(F.array(*(F.when(bad, name) for name, bad in against.items())), lambda x: x.isNotNull())})
    rows = rows.withColumn("eligible", (c("score") >= minimum_score) & ~c("_low") & c("_symbol") & c("_subject"))
    return rows.drop("aliases", "_title", "_body", "_opening", "_base", "_pattern", "_subject", *(k for k in flags if k.startswith("_")))


def event_candidates(title: Column, body: Column) -> Column:
    """Every event type with a matching pattern, in taxonomy order; ['other'] where none matches."""
    text = normal_form(F.concat_ws(" ", title, F.substring(body, 1, 6000)))
    found = F.filter(F.array(*(F.when(F.greatest(*(text.rlike(p) for p in pats), F.lit(False)), name) for name, pats in EVENT_PATTERNS.items())), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("other")))


def sampling_bucket(title: Column, body: Column) -> Column:
    """First bucket, in order, one of whose substrings occurs in the title or the first 3,000 characters."""
    text = F.lower(F.concat_ws(" ", title, F.substring(body, 1, 3000)))
    out = F.lit("other")
    for name, terms in reversed(BUCKET_TERMS.items()):
        hit = F.lit(False)
        for t in terms:
            hit = hit | text.contains(t)
        out = F.when(hit, name).otherwise(out)
    return out


def _hits(words: Column, lexicon: tuple[str, ...]) -> Column:
    return F.size(F.filter(words, lambda x: x.isin(*lexicon)))


def keyword_sentiment(text: Column) -> Column:
    """(positive - negative) / (positive + negative) word counts; 0 where there are none."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z]+"), F.lit(0))
    up, down = _hits(words, POSITIVE), _hits(words, NEGATIVE)
    return F.coalesce(F.try_divide((up - down).cast("double"), (up + down).cast("double")), F.lit(0.0))


def contradictory(text: Column) -> Column:
    """A contrast word, a good word and a bad word all occur."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z]+"), F.lit(0))
    meets = lambda lexicon: F.arrays_overlap(words, F.array(*map(F.lit, lexicon)))
    return meets(CONTRAST) & meets(GOOD) & meets(BAD)


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two token arrays as sets; 1 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def shingle_hashes(words: Column, k: int = 5) -> Column:
    """First 64 bits of the MD5 of each k-token shingle, as a signed number; fewer tokens are one shingle.

    Put it in a column of its own (behind a generator) before ``simhash``, which reads it once a bit.
    """
    n = F.size(words)
    at = F.when(n >= k, F.sequence(F.lit(1), n - k + 1)).otherwise(F.array(F.lit(1)))
    half = lambda digest, start: F.conv(F.substring(digest, start, 8), 16, 10).cast("long")
    digests = F.transform(at, lambda i: F.md5(F.array_join(F.slice(words, i, k), " ").cast("binary")))
    return F.transform(digests, lambda x: F.shiftleft(half(x, 1), 32).bitwiseOR(half(x, 9)))


def simhash(hashes: Column, bits: int = 64) -> Column:
    """A bit is set where at least half of the hashes have it set: one fold a bit, in integer arithmetic."""
    one = F.lit(1).cast("long")
    out = F.lit(0).cast("long")

    def weight_of(b: int) -> Column:
        return F.aggregate(hashes, F.lit(0).cast("long"), lambda acc, h: acc + F.shiftright(h, b).bitwiseAND(one) * 2 - 1)

    for b in range(bits):
        weight = weight_of(b)
        out = out.bitwiseOR(F.when(weight >= 0, F.lit((1 << b) - (1 << 64 if b == 63 else 0)).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


@F.pandas_udf(T.StructType([T.StructField("fingerprint", T.LongType()), T.StructField("title", T.StringType()), T.StructField("body", T.StringType())]))
def story_prints(title: pd.Series, body: pd.Series) -> pd.DataFrame:
    """The ``simhash`` of the body's ``shingle_hashes``, and the tokens of the title and the first 250 of the body, joined by spaces. One Arrow pass."""
    find, out = re.compile(TOKEN).findall, []
    for head, text in zip(title, body, strict=True):
        words = find((text or "").lower())
        line, ends = " ".join(words).encode(), [-1]
        for w in words:
            ends.append(ends[-1] + len(w) + 1)
        n = max(1, len(words) - 4)
        digests = b"".join([md5(line[ends[i] + 1 : ends[min(i + 5, len(words))]]).digest()[:8] for i in range(n)]) if words else md5(b"").digest()[:8]
        hashes = np.frombuffer(digests, np.uint8).reshape(-1, 8)
        ones = sum(np.unpackbits(hashes[i : i + 100_000], axis=1).sum(0, dtype=np.int64) for i in range(0, n, 100_000))
        out.append((int.from_bytes(np.packbits(2 * ones >= n).tobytes(), "big", signed=True), " ".join(find((head or "").lower())), " ".join(words[:250])))
    return pd.DataFrame(out, columns=["fingerprint", "title", "body"])


@F.pandas_udf(T.StructType([T.StructField("n", T.IntegerType()), *(T.StructField(f"p{i}", T.LongType()) for i in range(4))]))
def parities(words: pd.Series) -> pd.DataFrame:
    """Of a set of words, joined by U+001F: its size, and 256 bits that tell whether an odd number of words falls on each.

    Two sets differ in at least as many words as their bits differ.
    """
    place: dict[str, int] = {}
    out = []
    for text in words:
        held, bits = set(text.split("\x1f")) if text else (), 0
        for w in held:
            if (b := place.get(w)) is None:
                b = place[w] = 1 << (zlib.crc32(w.encode()) & 255)
            bits ^= b
        out.append((len(held), *np.frombuffer(bits.to_bytes(32, "little"), "<i8").tolist()))
    return pd.DataFrame(out, columns=["n", "p0", "p1", "p2", "p3"])


def rare_words(words: Column, common: Sequence[str], share: float) -> Column:
    """Of a set of words, joined by U+001F, so many of the rarest that two sets with a Jaccard similarity of ``share`` have one of them in common.

    ``common`` lists frequent words, the most frequent first; all others count as rarer. Any list gives right results.
    """
    rank = {w: -i for i, w in enumerate(common)}
    lowest = -len(common) - 1

    @F.pandas_udf("array<string>")
    def pick(texts: pd.Series) -> pd.Series:
        def one(text: str) -> list[str]:
            held = sorted(set(text.split("\x1f")), key=lambda w: (rank.get(w, lowest), w))
            return held[: len(held) - math.ceil(share * len(held) - 1e-9) + 1]

        return texts.map(one)

    return pick(words)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def key_of(*parts: Column, separator: str = "\x1f") -> Column:
    """Content key: SHA-256 of the parts, joined."""
    return F.sha2(F.concat_ws(separator, *parts), 256)


def seeded_rank_key(seed: int, *ids: Column) -> Column:
    """Deterministic pseudo-random order: SHA-256 of seed:id."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *ids), 256)


def maximum_cost(text: Column, output_tokens: int, input_price: float, output_price: float) -> Column:
    """Upper bound of a request's price, a byte counting as a token; prices are per million."""
    return (F.octet_length(F.coalesce(text, F.lit(""))) * input_price + output_tokens * output_price) / 1e6


def billed_cost(tokens: Column, cached: Column, output: Column, input_price: float, cached_price: float, output_price: float) -> Column:
    """What a request costs: uncached, cached and output tokens at their prices a million."""
    return ((tokens - cached) * input_price + cached * cached_price + output * output_price) / 1e6
