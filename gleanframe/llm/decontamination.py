"""Benchmark decontamination by templates.

Texts are cut into words, three times alike: in plain words, lower-cased; with typed
placeholders for numbers, units behind a number and names within a sentence; and with every
capitalised word as a name, also one that begins a sentence. Benchmark items are cut into windows
of such words, and every window of every document is looked up among them by hash. Windows of
equal plain words match, whatever they hold. Windows that match by placeholders only must be
consistent: along one alignment of document and item, each word of the item stands for one word
of the document. And they must be more than a layout: there are several of them, or most of the
item, and they hold a word that is not a function word. So a question asked again with other
numbers or names is caught, and two texts that only share a layout are not.

Only DataFrame functions are used. Documents are not shuffled: each text is cleaned once and cut
all ways in one projection, windows are made and looked up within one stage, against broadcast
blocks of benchmark windows of a bounded number of rows.
"""

from __future__ import annotations

import functools
import math
import operator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from gleanframe.session import durable

NAME, NUMBER, UNIT, POINT, COMMA = "\u0002", "\u0003", "\u0004", "\u0005", "\u0006"
# Fixed values.
UNITS = (
    "mm cm m km mg g kg t ml cl l kb mb gb tb ms s sec min h hr hrs hour hours minute minutes second seconds "
    "day days week weeks month months year years mile miles inch inches foot feet yard yards pound pounds lb lbs "
    "ounce ounces oz gallon gallons litre litres liter liters meter meters metre metres percent degree degrees "
    "dollar dollars cent cents euro euros usd eur gbp mph kmh hz khz mhz ghz kw kwh v w"
)
# Words that hold a sentence together in English, German, French and Spanish; a layout of these says nothing.
FUNCTION_WORDS = frozenset(
    "a an the and or but if so as at by for from in into of off on out over than then to up with without is are was were "
    "be been being am do does did has have had will would can could shall should may might must not no it its he she they "
    "them his her their we us our you your i me my this that these those there here which who whom whose what when where "
    "why how each all some any many much more most other one two also just only very about after before between "
    "der die das den dem des ein eine einen einem einer eines und oder aber wenn als wie so in im an am auf aus bei beim "
    "bis durch für gegen mit nach ohne um unter über von vom vor zu zum zur zwischen ist sind war waren sein wird werden "
    "wurde wurden hat haben hatte hatten kann können konnte soll sollte muss müssen darf nicht kein keine auch nur noch "
    "schon sehr er sie es wir ihr ich du man sich mein dein ihre ihren ihrem seine seinen seinem dieser diese dieses diesem "
    "diesen jeder jede jedes was wer wo wann warum dass ob da dort hier dann doch "
    "le la les l un une des du de d et ou mais si que qui quoi dont où ce cet cette ces il elle ils elles on nous vous je "
    "tu me te se lui leur leurs son sa ses mon ma mes ton ta tes à au aux en dans par pour sur sous avec sans entre est "
    "sont était étaient été être a ont avait avoir ne pas plus y comme quand "
    "el los las lo una unos unas y o pero si que quien cual donde cuando como de del al en por para con sin sobre entre "
    "es son era eran ser está están ha han había haber no su sus mi mis tu tus se le les nos yo él ella ellos".split()
)
_WORD_CHAR = r"\p{L}\p{N}"
_SPECIAL = NAME + NUMBER + UNIT + POINT + COMMA
_NAME = rf"(?<=[\p{{Ll}}\p{{N}},;] )\p{{Lu}}\p{{Ll}}+(?![{_WORD_CHAR}])"
_CAPITAL = rf"(?<![{_WORD_CHAR}])\p{{Lu}}\p{{Ll}}+(?![{_WORD_CHAR}])"
_DIGITS = rf"(?<![{_WORD_CHAR}{POINT}{COMMA}])\p{{N}}+(?:[{POINT}{COMMA}]\p{{N}}+)*"
_NUMBER = rf"{_DIGITS}(?![{_WORD_CHAR}])"
_UNITS = rf"(?i:{'|'.join(UNITS.split())})(?![{_WORD_CHAR}])"
_UNIT = rf"(?<={NUMBER}[ -]?){_UNITS}"
_GLUED = rf"({_DIGITS})(?={_UNITS})"
_BETWEEN = rf"[^{_WORD_CHAR}{_SPECIAL}]+"


@dataclass(frozen=True)
class Templates:
    """``window`` words a window; items of ``least`` to ``window - 1`` words are one window.

    Windows with placeholders match by layout if ``literal_share`` of their words are literal, and
    count if ``run`` of them, or half of the item's windows, match along one alignment.
    """

    window: int = 8
    least: int = 5
    literal_share: float = 0.5
    run: int = 4
    rows_per_broadcast: int = 1_000_000


def _clean(text: Column) -> Column:
    """The text with the separators inside its numbers as marks, and a space between number and unit."""
    free = F.translate(F.coalesce(text, F.lit("")), _SPECIAL, " " * len(_SPECIAL))
    pointed = F.regexp_replace(free, r"(?<=\p{N})\.(?=\p{N})", POINT)
    return F.regexp_replace(F.regexp_replace(pointed, r"(?<=\p{N}),(?=\p{N})", COMMA), _GLUED, "$1 ")


def _cut(text: Column) -> Column:
    return F.split(F.regexp_replace(text, rf"^{_BETWEEN}|{_BETWEEN}$", ""), _BETWEEN)


def _templated(clean: Column, names: str) -> Column:
    named = F.regexp_replace(clean, names, NAME)
    return _cut(F.lower(F.regexp_replace(F.regexp_replace(named, _NUMBER, NUMBER), _UNIT, UNIT)))


# The ways a text is cut; all give the same number of words.
_CUTS = {
    "plain": lambda clean: _cut(F.lower(clean)),
    "words": lambda clean: _templated(clean, _NAME),
    "capitals": lambda clean: _templated(clean, _CAPITAL),
}


def _cuts(text: Column, *ways: str) -> list[Column]:
    """Words of a text in each way; one empty word for a text without any."""
    return [_CUTS[way](_clean(text)).alias(way) for way in ways]


def _holds_slot(words: Column) -> Column:
    return F.arrays_overlap(words, F.array(F.lit(NAME), F.lit(NUMBER), F.lit(UNIT)))


def _hash(words: Column, at: Column, size: Column) -> Column:
    """Hash of the window of ``size`` words from ``at`` (sizes may differ row by row)."""
    return F.xxhash64(F.slice(words, at + 1, size))


def _windows(rows: DataFrame, words: str, size: int) -> DataFrame:
    """One row for each window of ``size`` words: its place, beside the columns of ``rows``."""
    starts = F.when(
        (F.size(words) >= size) & (F.col(words)[0] != ""), F.sequence(F.lit(0), F.size(words) - size)
    )
    return rows.withColumn("at", F.explode(starts))


def _inside(words: str, size: int) -> Column:
    return F.slice(words, F.col("at") + 1, size)


def benchmark_windows(benchmark: DataFrame, p: Templates) -> DataFrame:
    """Windows of the items, plain and by layout: size, way, key, window, item_id, item_at, of_item, and item_plain.

    ``of_item`` is the number of windows of the item. ``item_plain`` holds the plain words of a
    window with placeholders, and is null for a plain one.
    """
    items = durable(
        benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), *_cuts(F.col("text"), *_CUTS))
    )
    found = None
    for size in range(p.least, p.window + 1):
        some = items if size == p.window else items.where(F.size("plain") == size)
        windows = _windows(some, "plain", size)
        for way in _CUTS:
            inside = _inside(way, size)
            literal = F.size(F.filter(inside, lambda w: ~w.isin(NAME, NUMBER, UNIT)))
            usable = F.lit(True) if way == "plain" else _holds_slot(inside) & (literal >= math.ceil(p.literal_share * size))
            rows = windows.where(usable).select(
                F.lit(size).alias("size"),
                F.lit(way).alias("way"),
                _hash(F.col(way), F.col("at"), F.lit(size)).alias("key"),
                F.concat_ws(" ", inside).alias("window"),
                "item_id",
                F.col("at").alias("item_at"),
                (F.size("plain") - size + 1).alias("of_item"),
                (F.lit(None) if way == "plain" else _inside("plain", size)).cast("array<string>").alias("item_plain"),
            )
            found = rows if found is None else found.union(rows)
    return found


def matched_windows(docs: DataFrame, windows: DataFrame, p: Templates) -> DataFrame:
    """Windows of documents that are windows of items: id, text_hash, at, key, window, size, way, plain words.

    Each text is cleaned once and cut all three ways in one projection; the windows of every way
    and size the benchmark uses are made from those arrays and looked up by hash, all in one scan
    of the documents for each block of about ``rows_per_broadcast`` item windows (8 bytes each,
    broadcast), so the documents are read once while the benchmark's windows fit one block.
    """
    counted = sorted((r["way"], r["size"]) for r in windows.select("way", "size").distinct().collect())
    ids = [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash")]
    if not counted:
        return docs.where("false").select(
            *ids, F.lit(0).alias("at"), F.lit(0).cast("long").alias("key"), F.lit(0).alias("size"),
            F.lit("").alias("way"), F.lit("").alias("window"), F.array(F.lit("")).alias("plain"),
        )
    ways = sorted({way for way, _ in counted})
    texts = docs.select(*ids, *_cuts(F.col("text"), *sorted({*ways, "plain"})))
    combos = F.array(*[F.struct(F.lit(way).alias("way"), F.lit(size).alias("size")) for way, size in counted])
    words = functools.reduce(lambda out, way: out.when(F.col("c.way") == way, F.col(way)), ways[1:], F.when(F.col("c.way") == ways[0], F.col(ways[0])))
    size = F.col("c.size")
    starts = F.when((F.size("w") >= size) & (F.col("w")[0] != ""), F.sequence(F.lit(0), F.size("w") - size))
    made = (
        texts.select("*", F.explode(combos).alias("c"))
        .select("*", words.alias("w"))
        .select("*", F.explode(starts).alias("at"))
        .select("*", _hash(F.col("w"), F.col("at"), size).alias("key"))
    )
    n = windows.select("way", "size", "key").distinct().count()
    blocks = max(1, math.ceil(n / p.rows_per_broadcast))
    found = None
    for block in range(blocks):
        keys = windows.where(F.pmod("key", F.lit(blocks)) == block).select(
            F.col("way").alias("k_way"), F.col("size").alias("k_size"), F.col("key").alias("k_key")
        ).distinct()
        same = (F.col("key") == F.col("k_key")) & (F.col("c.way") == F.col("k_way")) & (F.col("c.size") == F.col("k_size"))
        rows = (
            made.where(F.pmod("key", F.lit(blocks)) == block)
            .join(F.broadcast(keys), same, "left_semi")
            .select(
                "doc_id",
                "text_hash",
                "at",
                "key",
                size.alias("size"),
                F.col("c.way").alias("way"),
                F.concat_ws(" ", F.slice("w", F.col("at") + 1, size)).alias("window"),
                F.when(F.col("c.way") != "plain", F.slice("plain", F.col("at") + 1, size)).cast("array<string>").alias("plain"),
            )
        )
        found = rows if found is None else found.union(rows)
    return found


def contaminated(docs: DataFrame, benchmark: DataFrame, p: Templates = Templates()) -> DataFrame:
    """One row for each document and item that share consistent windows.

    doc_id, text_hash (of the text), item_id, n_windows, first_word, last_word (of the document,
    from 0; a number with its separators is one word), n_slots (placeholder places compared). Windows
    of equal plain words always count. An alignment counts by its layout too if its placeholders do
    not contradict each other, ``run`` windows or half of the item match, and a word that stands
    there is not a function word. Windows of which less than ``literal_share`` is literal match by
    plain words only. Null or empty texts and items of fewer than ``least`` words match nothing.
    Repeated rows count once; null ids are kept as null.
    """
    windows = durable(benchmark_windows(benchmark, p))
    hits = durable(matched_windows(docs, windows, p).distinct())
    aligned = hits.join(windows, ["key", "size", "way", "window"]).withColumn("shift", F.col("at") - F.col("item_at"))
    place = ["doc_id", "text_hash", "item_id", "shift"]
    # Each way an item is cut is judged by itself: a literal word at the start of a sentence is no contradiction.
    each = [*place, "size", "way"]
    slots = _slots(aligned, each)
    judged = (
        slots.groupBy(*each, "kind", "item_word")
        .agg(F.count_distinct("doc_word").alias("stands_for"), F.count_distinct("slot").alias("slots"))
        .groupBy(*each)
        .agg((F.max("stands_for") == 1).alias("consistent"), F.sum("slots").alias("n_slots"))
    )
    says = F.exists(F.split("window", " "), lambda w: ~w.isin(NAME, NUMBER, UNIT, *sorted(FUNCTION_WORDS)))
    # All windows of the alignment count towards the run, those of equal plain words as well.
    runs = aligned.groupBy(*place, "size").agg(F.count_distinct("at").alias("in_run"), F.max(says).alias("says"), F.max("of_item").alias("of_item"))
    enough = F.col("says") & (F.col("in_run") >= F.least(F.lit(p.run), F.ceil(F.col("of_item") / 2)))
    whole = runs.where(enough).select(*(F.col(c).alias(f"run_{c}") for c in (*place, "size")))
    of_run = [F.col(c).eqNullSafe(F.col(f"run_{c}")) for c in (*place, "size")]
    judged = judged.join(whole, functools.reduce(operator.and_, of_run), "left_semi")
    null_safe = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in each]
    condition = functools.reduce(operator.and_, null_safe)
    kept = (
        aligned.alias("x")
        .join(judged.alias("y"), condition, "left")
        .where("x.item_plain is null or y.consistent")
        .select("x.*", F.when(F.col("y.consistent"), F.col("y.n_slots")).otherwise(0).alias("n_slots"))
    )
    per_shift = kept.groupBy(*place).agg(
        F.count_distinct("at", "item_at").alias("windows"),
        F.min("at").alias("low"),
        F.max(F.col("at") + F.col("size") - 1).alias("high"),
        F.max("n_slots").alias("slots"),
    )
    return per_shift.groupBy("doc_id", "text_hash", "item_id").agg(
        F.sum("windows").alias("n_windows"),
        F.min("low").cast("long").alias("first_word"),
        F.max("high").cast("long").alias("last_word"),
        F.sum("slots").alias("n_slots"),
    )


def _slots(aligned: DataFrame, place: list[str]) -> DataFrame:
    """Placeholder places of matched windows: kind, the item's word and the document's."""
    zipped = aligned.where("item_plain is not null").select(
        *place, "at", F.posexplode(F.arrays_zip(F.split("window", " ").alias("kind"), F.col("item_plain").alias("item_word"), F.col("plain").alias("doc_word"))).alias("k", "s")
    )
    return zipped.where(F.col("s.kind").isin(NAME, NUMBER, UNIT)).select(
        *place, (F.col("at") + F.col("k")).alias("slot"), "s.kind", "s.item_word", "s.doc_word"
    )
