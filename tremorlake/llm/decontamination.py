"""Benchmark decontamination by template canonicalisation, in DataFrame functions alone.

Words become template words: names (capitalised, other than common function words),
numbers and units after a number give way to typed placeholders, all else is lower-cased
without punctuation; words of punctuation alone do not count. Windows of template words
are hashed (a window of placeholders alone by its words as they are: as a template it says
nothing); they stand at every word of benchmark and documents, so any common run of
`window` template words meets. Windows that meet on one diagonal (document place minus
item place) are one alignment; it counts when its windows cover `least` words and its
slots are consistent: the words behind placeholders map one to one between item and
document. So a question with other numbers or names is caught, and chance meetings are not.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Units that are placeholders after a number (fixed list).
UNITS = "mm cm m km in ft yd mi mg g kg lb lbs oz t ml cl l gal s sec ms min h hr hrs d day days week weeks month months year years hour hours minute minutes second seconds hz khz mhz ghz w kw mw v kv a ma j kj cal kcal pa kpa bar k c f % $ € £ usd eur gbp cents dollars euros meters metres miles kilometers kilometres grams kilograms pounds ounces liters litres gallons inches feet yards percent degrees".split()
#: Capitalised words that are no names (fixed list).
PLAIN = "the an and or but nor if in on at of to for from by with without into onto over under about after before between through during until as is are was were be been being am it its this that these those there here he she they we you his her hers their theirs our your my him them us me what which who whom whose when where why how then than so not no yes do does did done has have had can could will would may might must shall should let given find each every all both some any many much few more most other another such only also just one two three four five six seven eight nine ten".split()
#: Placeholders: private code points, which texts lose first.
NUMBER, NAME, UNIT = "\ue000", "\ue001", "\ue002"
HOLDERS = NUMBER + NAME + UNIT
#: Benchmark windows up to which they are broadcast: 32 bytes each, so 32 MB at most.
BROADCAST_WINDOWS = 1 << 20
WINDOW, LEAST = 6, 9


def _cleaned(text: Column) -> Column:
    """The text without placeholders of its own and without words of punctuation alone."""
    t = F.translate(F.coalesce(text, F.lit("")), HOLDERS, "   ")
    return F.regexp_replace(t, r"(?![A-Za-z0-9 ])(?<!\S)[^\p{L}\p{N}\p{M}\s]+(?!\S)", "")


def _canonical(text: Column) -> Column:
    """The text with a template word in each word's place; words stay apart by the same white space."""
    plain = "|".join(w.capitalize() for w in PLAIN)
    # a cheap look ahead comes first, as most places fail there
    t = F.regexp_replace(text, rf"(?=\p{{Lu}}\p{{Ll}})(?<![\p{{L}}\p{{N}}\p{{M}}'’-])(?!(?:{plain})(?![\p{{L}}\p{{M}}'’-]))\p{{Lu}}\p{{Ll}}[\p{{L}}\p{{M}}'’-]*", NAME)
    t = F.regexp_replace(t, r"(?=[+$€£0-9-])(?<![\p{L}\p{N}])[+-]?[$€£]?\d[\d.,/:]*(?![\p{L}\p{N}])", NUMBER)
    units = "|".join(sorted((u.replace("$", r"\$") for u in UNITS), key=lambda u: (-len(u), u)))
    units = rf"(?<={NUMBER} )(?i:{units})(?![\p{{L}}\p{{N}}])"
    return F.lower(F.when(F.contains(t, F.lit(NUMBER)), F.regexp_replace(t, units, UNIT)).otherwise(t))


def _words(text: Column) -> Column:
    return F.split(text, r"[ \t\n\x0B\f\r]+", -1)


def _template(df: DataFrame) -> DataFrame:
    """Adds raw (words) and tpl (template words, punctuation dropped) of column t, which is cleaned, place by place.

    Every word of t has a letter, digit or mark, which neither step takes away, so both
    have as many words. Also adds wh, the hashes of tpl.
    """
    words = df.select("*", _words(F.col("t")).alias("raw"), _words(F.regexp_replace(_canonical(F.col("t")), rf"(?![a-z0-9 ])[^\p{{L}}\p{{N}}\p{{M}}{HOLDERS}\s]+", "")).alias("tpl"))
    return words.withColumn("wh", F.transform("tpl", lambda w: F.xxhash64(w)))


def _held(w: Column) -> Column:
    return w.isin(NUMBER, NAME, UNIT)


def _hash(at: Column, width: int) -> Column:
    holders = [F.xxhash64(F.lit(x)) for x in HOLDERS]
    words = [F.get("wh", at + i) for i in range(width)]
    alone = reduce(lambda x, y: x & y, [w.isin(*holders) for w in words])
    return F.when(alone, F.xxhash64(F.lit("as it is"), F.slice("raw", at + 1, width))).otherwise(F.xxhash64(F.lit(width), *words))


def _slots(at: Column, width: Column) -> Column:
    """Raw words of the placeholders of a window; null without any."""
    part = F.arrays_zip(F.slice("tpl", at + 1, width).alias("t"), F.slice("raw", at + 1, width).alias("r"))
    held = F.transform(F.filter(part, lambda x: _held(x["t"])), lambda x: x["r"])
    return F.when(F.size(held) > 0, held)


#: Bits of the filter of benchmark windows: so many for a window, 2**MOST_BITS at most.
BITS, MOST_BITS = 16, 22


def _filter(windows: DataFrame, n: int):
    """A test that a hash of windows passes, and few others: bits in a literal array of longs, merged on executors."""
    size = 1 << min(MOST_BITS, max(6, (BITS * n).bit_length()))
    place = lambda h: F.shiftrightunsigned(h.bitwiseAND(size - 1), 6).cast("int")
    bit = lambda h: h.bitwiseAND(63).cast("int")
    words = [0] * (size // 64)
    one = F.expr("bit_or(shiftleft(1L, cast(h & 63 as int)))")
    for r in windows.groupBy(place(F.col("h")).alias("i")).agg(one.alias("w")).collect():  # size / 64 rows at most
        words[r["i"]] = r["w"]
    held = F.split(F.lit(",".join(map(str, words))), ",").cast("array<long>")  # folded to one literal
    return lambda h: F.element_at(F.transform(F.array(h), lambda x: F.getbit(F.get(held, place(x)), bit(x)) == 1), 1)


def _windows(df: DataFrame, widths: list[int], wanted=None) -> DataFrame:
    """One row for each window of each width, at every word (of hashes that pass wanted): the other columns, at (its first word), own_width, h, slots."""
    keep = [c for c in df.columns if c not in ("t", "raw", "tpl", "wh")]
    def places(width):
        every = F.when(F.size("wh") >= width, F.sequence(F.lit(0), F.size("wh") - width)).otherwise(F.array().cast("array<int>"))
        met = every if wanted is None else F.filter(every, lambda at: wanted(_hash(at, width)))
        return F.transform(met, lambda at: F.struct(at.alias("at"), F.lit(width).alias("own_width"), _hash(at, width).alias("h"), _slots(at, F.lit(width)).alias("slots")))

    every = F.concat(*map(places, widths)) if len(widths) > 1 else places(widths[0])
    # outer, as else a filter on the windows' number is inferred, which works all of them out once more
    return df.select(*keep, every.alias("w")).select(*keep, F.explode_outer("w").alias("w")).select(*keep, "w.*").where("h is not null")


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least: int = LEAST) -> DataFrame:
    """(doc_id, item_id, n_words, n_slots): items of benchmark (item_id, text) that a document holds, possibly with other names, numbers or units.

    n_words: words of the item that matching windows of its best alignment cover; n_slots:
    placeholders checked there. Items of fewer than `least` words count when covered whole,
    those of fewer than `window` by a window of their own length; white space around an
    item is no part of it. Items without words, null and empty texts, null ids hold
    nothing; repeated rows count once; other columns are ignored.
    """
    items = benchmark.where("item_id is not null").select("item_id", F.regexp_replace(_cleaned(F.col("text")), r"^\s+|\s+$", "").alias("t"))
    items = _template(items).where(F.exists("tpl", lambda w: w != "")).withColumn("size", F.size("tpl")).withColumn("width", F.least("size", F.lit(window)))
    widths = sorted({window, *(r["width"] for r in items.select("width").distinct().collect())})  # `window` values at most
    item_windows = _windows(items, widths).where("own_width = width").select("item_id", "size", "width", F.col("at").alias("item_at"), "h", F.col("slots").alias("item_slots"))
    own = docs.where("doc_id is not null").select("doc_id", _cleaned(F.col("text")).alias("t"))
    n = item_windows.limit(BROADCAST_WINDOWS + 1).count()
    wanted = _filter(item_windows, n) if n <= BROADCAST_WINDOWS else None
    met = _windows(_template(own), widths, wanted).join(F.broadcast(item_windows) if wanted else item_windows, "h")
    pattern = lambda a: F.element_at(F.transform(F.array(a), lambda b: F.transform(b, lambda x: F.array_position(b, x))), 1)
    alike = F.coalesce(pattern(F.col("slots")) == pattern(F.col("item_slots")), F.lit(True))
    met = met.where(alike).select("doc_id", "item_id", "size", "width", "at", "item_at", (F.col("at") - F.col("item_at")).alias("diagonal"), "slots", "item_slots")
    lines = met.groupBy("doc_id", "item_id", "size", "width", "diagonal").agg(
        F.sort_array(F.collect_set("item_at")).alias("places"),
        F.collect_set(F.struct("slots", "item_slots")).alias("pairs"),
    )
    # words covered: windows overlap where they stand less than a window apart
    spread = F.aggregate(F.col("places"), F.struct((-F.col("width")).alias("last"), F.lit(0).alias("n")), lambda s, p: F.struct(p.alias("last"), (s["n"] + F.least(F.col("width"), p - s["last"])).alias("n")), lambda s: s["n"])
    slot = F.array_distinct(F.flatten(F.transform(F.filter("pairs", lambda p: p["slots"].isNotNull()), lambda p: F.arrays_zip(p["slots"].alias("d"), p["item_slots"].alias("i")))))
    judged = lines.select("doc_id", "item_id", "size", spread.alias("n_words"), slot.alias("slot")).withColumn("n_slots", F.size("slot"))
    one_to_one = (F.size(F.array_distinct(F.transform("slot", lambda x: x["d"]))) == F.col("n_slots")) & (F.size(F.array_distinct(F.transform("slot", lambda x: x["i"]))) == F.col("n_slots"))
    good = judged.where(one_to_one & (F.col("n_words") >= F.least("size", F.lit(least))))
    best = F.max(F.struct(F.col("n_words").cast("long").alias("n_words"), F.col("n_slots").cast("long").alias("n_slots")))
    return good.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.n_words", "b.n_slots")
