"""Benchmark decontamination by template canonicalisation.

Numbers, units after numbers and names become typed placeholders, so that a
question whose numbers or names were exchanged keeps its template. A name is a
run of capitalised words, however many. Every K-word window of every document's
template is joined by hash to the windows of the benchmark's templates; matches
are counted by diagonal, and diagonals a few words apart are also counted
together, as words put in or left out shift what follows. A passage that covers
enough of an item then has its slots checked, piece by piece: each value of the
item must stand for one value of the passage throughout. Else the likeness is
one of form only.

A second reading of each text, its words in lower case with nothing replaced,
goes through the same windows, join and diagonals and needs no slots: it finds
copies whose capitals differ, and items too short for a window, whole.

DataFrame functions only. The benchmark's windows are broadcast where the
planner finds them small, and shuffled otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import fresh, sifted, stage

K = 8
#: Share of an item's windows that a passage must match, and literal words that a window must hold.
COVER, LITERAL = 0.5, 4
#: Words that an item must have to be looked for; below K it is one window.
SHORTEST = 4
#: Words between neighbouring diagonals up to which they are one passage.
DRIFT = 8
UNITS = ("kg", "g", "mg", "km", "m", "cm", "mm", "mi", "miles", "feet", "ft", "inches", "hours", "hour", "minutes", "minute", "seconds", "days", "day", "weeks", "years", "year", "dollars", "usd", "euros", "eur", "cents", "percent", "liters", "litres", "l", "ml", "mph", "kmh")
#: Readings: with placeholders, and word for word.
TEMPLATE, VERBATIM = 0, 1
_NAME, _NUMBER, _UNIT, _END, _END_NUMBER = "\u0001", "\u0002", "\u0003", "\u0004", "\u0005"
_IS_NAME = r"\p{Lu}\p{Ll}+(?:[ \t]+\p{Lu}\p{Ll}+)*"
_IS_NUMBER = r"\p{N}+(?:[.,]\p{N}+)*"
_IS_UNIT = rf"(?i){_END_NUMBER}[ \t]?(%|(?:{'|'.join(sorted(UNITS, key=len, reverse=True))})(?!\p{{L}}))"


def _replaced(text: Column, name: str, number: str, unit: str) -> Column:
    """Slots replaced one kind after the other, lower-cased; ``number`` must end with the mark that a unit may follow."""
    out = F.translate(F.coalesce(text, F.lit("")), _NAME + _NUMBER + _UNIT + _END + _END_NUMBER, " " * 5)
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(out, _IS_NAME, name), _IS_NUMBER, number), _IS_UNIT, unit))


def template(text: Column) -> Column:
    """Words of the text, slots as their kind alone."""
    bare = _replaced(text, f" {_NAME} ", f" {_NUMBER} {_END_NUMBER}", f" {_UNIT} ")
    return F.array_remove(F.split(bare, rf"[^\p{{L}}{_NAME}-{_UNIT}]+"), "")


def slots(text: Column) -> Column:
    """Words of the text as in ``template``, slots with their value."""
    marked = _replaced(text, f"{_NAME}$0{_END}", f"{_NUMBER}$0{_END_NUMBER}", f"{_END}{_UNIT}$1{_END}")
    found = F.regexp_extract_all(marked, F.lit(rf"[{_NAME}-{_UNIT}][^{_END}{_END_NUMBER}]*[{_END}{_END_NUMBER}]|\p{{L}}+"), F.lit(0))
    return F.transform(found, lambda x: F.regexp_replace(x, r"[ \t]+", " "))


def verbatim(text: Column) -> Column:
    """Words and numbers of the text in lower case."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _held(value: Column) -> Column:
    """``value`` behind a generator, so that the optimiser can't put its computation into every lambda call that uses it."""
    return F.explode(F.array(value))


def _readings() -> Column:
    """Rows (r, words): the column ``text`` in both readings."""
    return F.inline(F.array(F.struct(F.lit(TEMPLATE).alias("r"), template(F.col("text")).alias("words")), F.struct(F.lit(VERBATIM).alias("r"), verbatim(F.col("text")).alias("words"))))


def _hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _windows(hashed: Column, r: Column, k: int) -> Column:
    """Hashes of the k-word windows of a column of word hashes, told apart by reading and length; none where there are fewer words."""
    n = F.size(hashed)
    at = F.when(n >= k, F.sequence(F.lit(0), n - k)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(r, F.lit(k), *(F.get(hashed, i + j) for j in range(k))))


def _item_windows(bench: DataFrame) -> DataFrame:
    """(item_id, ih, r, o, w, of): windows of each item in each reading, and how many it has in that reading."""
    rows = bench.select("item_id", F.xxhash64("text").alias("ih"), _readings())
    rows = rows.select("item_id", "ih", "r", "words", _held(_hashed(F.col("words"))).alias("hashed"))
    n, k = F.size("words"), F.lit(K)
    by_length = [F.when((n >= K) if length == K else (n == length) & (F.col("r") == VERBATIM), _windows(F.col("hashed"), F.col("r"), length)) for length in range(SHORTEST, K + 1)]
    rows = rows.select("item_id", "ih", "r", "words", F.least(n, k).alias("k"), _held(F.coalesce(*by_length)).alias("ws"))
    rows = rows.select("item_id", "ih", "r", "words", "k", F.posexplode("ws").alias("o", "w"))
    literal = F.size(F.filter(F.slice("words", F.col("o") + 1, F.col("k")), lambda x: ~x.isin(_NAME, _NUMBER, _UNIT)))
    return rows.where(literal >= LITERAL).select("item_id", "ih", "r", "k", "o", "w", F.count("*").over(Window.partitionBy("item_id", "ih", "r")).alias("of"))


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, th, item_id, cover): the items that a document holds, by key of row ``th``."""
    bench = stage(benchmark.select("item_id", "text").dropDuplicates(), "bench-items")
    placed = stage(_item_windows(bench), "bench-windows")
    # Lengths of windows: K, and those of items shorter than that, of which there are K - SHORTEST at most.
    shorter = sorted(x.k for x in placed.where(F.col("k") < K).select("k").distinct().collect())

    keyed = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    hashed = keyed.select("doc_id", "th", _readings()).select("doc_id", "th", "r", _held(_hashed(F.col("words"))).alias("hashed"))
    windows = F.array(*(_windows(F.col("hashed"), F.col("r"), k) for k in (K, *shorter)))
    grams = hashed.select("doc_id", "th", F.explode(windows).alias("ws")).select("doc_id", "th", F.posexplode("ws").alias("p", "w"))
    item = ["doc_id", "th", "item_id", "ih", "r", "of"]
    votes = grams.join(placed.drop("k"), "w").groupBy(*item, (F.col("p") - F.col("o")).alias("diag")).agg(F.collect_set("o").alias("os"))
    by_diag = Window.partitionBy(*item).orderBy("diag")
    votes = votes.withColumn("apart", (F.col("diag") - F.lag("diag").over(by_diag) > DRIFT).cast("int")).withColumn("passage", F.coalesce(F.sum("apart").over(by_diag), F.lit(0)))
    whole = lambda n: n >= F.col("of") * COVER
    groups = votes.groupBy(*item, "passage").agg(F.collect_list(F.struct(F.size("os").alias("votes"), "diag", "os")).alias("parts"))
    groups = groups.withColumn("held", F.size(F.array_distinct(F.flatten("parts.os")))).where(whole(F.col("held")))
    groups = stage(groups, "leak-passages")
    copied = groups.where(F.col("r") == VERBATIM).select("doc_id", "th", "item_id", (F.col("held") / F.col("of")).alias("cover"))

    formed = groups.where(F.col("r") == TEMPLATE)
    parts = formed.select(*item, "passage", F.size("parts").alias("n"), F.explode("parts").alias("x")).select(*item, "passage", "n", "x.*")
    piece = F.struct(F.array_min("os").alias("lo"), "diag", (F.array_max("os") - F.array_min("os") + K).alias("width"))
    single = parts.where(whole(F.col("votes"))).select(*item, "votes", F.array(piece).alias("pieces"))
    # Each window of the item counts once, on the diagonal that holds most.
    placed_once = parts.where("n > 1").withColumn("o", F.explode("os")).groupBy(*item, "passage", "o").agg(F.max(F.struct("votes", "diag"))["diag"].alias("diag"))
    merged = placed_once.groupBy(*item, "passage").agg(F.count("*").cast("int").alias("votes"), F.collect_list(F.struct(F.col("o").alias("lo"), "diag", F.lit(K).alias("width"))).alias("pieces"))
    spans = stage(single.unionByName(merged.drop("passage")), "leak-spans")

    on = F.col("doc_id").eqNullSafe(F.col("k")) & (F.col("th") == F.col("h"))
    texts = sifted(keyed, F.col("th"), spans, F.col("th")).dropDuplicates(["doc_id", "th"])
    texts = texts.select(F.col("doc_id").alias("k"), F.col("th").alias("h"), slots(F.col("text")).alias("mine"))
    theirs = bench.select("item_id", F.xxhash64("text").alias("ih"), slots(F.col("text")).alias("theirs"))
    both = spans.join(texts.hint("merge"), on).join(theirs, ["item_id", "ih"])
    side = lambda words, at, x: F.slice(words, at + 1, x["width"])
    aligned = F.flatten(F.transform("pieces", lambda x: F.zip_with(side("theirs", x["lo"], x), side("mine", x["lo"] + x["diag"], x), lambda a, b: F.struct(a.alias("a"), b.alias("b")))))
    pairs = F.array_distinct(F.filter(aligned, lambda x: x["a"].substr(1, 1).isin(_NAME, _NUMBER, _UNIT)))
    checked = both.select("doc_id", "th", "item_id", (F.col("votes") / F.col("of")).alias("cover"), _held(pairs).alias("pairs"))
    consistent = F.size(F.array_distinct(F.transform("pairs", lambda x: x["a"]))) == F.size("pairs")
    return checked.where(consistent).drop("pairs").unionByName(copied).groupBy("doc_id", "th", "item_id").agg(F.max("cover").alias("cover"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row a document: doc_id, contaminated, n_items, items (ids, ascending, comma-joined) and cover (largest).

    A null or empty text holds nothing. Items with fewer than SHORTEST words
    are not looked for, those with fewer than K only word for word; items with
    null or equal text are judged each by its id. Rows that share a doc_id are judged each by its
    own text. An empty table of documents gives no rows, an empty benchmark no
    contamination. Other columns are ignored.
    """
    leaks = find_leaks(docs, benchmark).groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("item_id")).alias("ids"), F.max("cover").alias("cover"))
    leaks = stage(leaks, "leaks").select(F.col("doc_id").alias("k"), F.col("th").alias("h"), "ids", "cover")
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"))
    joined = rows.join(leaks, F.col("doc_id").eqNullSafe(F.col("k")) & (F.col("th") == F.col("h")), "left")
    return joined.select("doc_id", F.col("ids").isNotNull().alias("contaminated"), F.when(F.col("ids").isNull(), 0).otherwise(F.size("ids")).cast("long").alias("n_items"), F.coalesce(F.array_join(F.col("ids").cast("array<string>"), ","), F.lit("")).alias("items"), F.coalesce("cover", F.lit(0.0)).alias("cover"))


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item of the benchmark, with all their columns.

    Null and empty texts hold none and stay; rows that share a doc_id are
    judged each by its own text; equal rows stay or go together. An empty
    benchmark keeps all, an empty table gives no rows.
    """
    key, th = fresh(docs, "doc", "th")
    leaks = stage(find_leaks(docs, benchmark).select(F.col("doc_id").alias(key), F.col("th").alias(th)).distinct(), "leaks")
    return docs.join(leaks, F.col("doc_id").eqNullSafe(F.col(key)) & (F.xxhash64("text") == F.col(th)), "left_anti")
