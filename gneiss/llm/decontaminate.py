"""Benchmark decontamination by canonical templates.

Texts become sequences of tokens in which numbers, names and units are typed placeholders, so a question with other
numbers or names has the same template. Windows of the benchmark's templates meet those of the documents in a hash
join; a Bloom filter of fixed size, made from the benchmark, keeps nearly all other windows out of the shuffle. Windows
that continue each other, place by place, form a stretch, along which each slot of the question must stand for one value
of the document. A contradiction ends a run, and what lies beside it counts only if it is so long, ``WIDE`` windows, that
it is a copy by itself. Windows with few literal tokens need a longer stretch. Windows of plain words go the same way beside
them, for verbatim copies of items whose windows are mostly slots. An item shorter than a window is one window of its own
length, and documents are searched at every length that the benchmark has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gneiss.llm.shared import _PLACE, hashed_spans, mixed, pieces, spans, table, text_bytes

WIDTH, LITERALS, RUN = 8, 4, 3
FEW = 2  # literals of a window that counts only in stretches of twice as many windows
WIDE = 24
BITS = 22  # the filter has 2**22 bits: half a megabyte, whatever the benchmark's size
SEGMENT = 12
_U = np.uint64

# Number words and units of four languages.
NUMBERS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion "
    "null eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend millionen "
    "zéro deux trois quatre cinq sept huit neuf dix onze douze treize quatorze quinze seize vingt trente quarante cinquante soixante cent mille millions "
    "cero dos tres cuatro cinco seis siete ocho nueve diez doce trece catorce quince veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien ciento mil millones"
).split()
UNITS = (
    "mm cm m km in ft yd mi mg g kg lb lbs oz ml l s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years mph kph w kw v a hz khz mhz ghz kb mb gb tb c f k percent dollar dollars cents euro euros pound pounds meter meters metre metres mile miles inch inches foot feet gram grams kilogram kilograms liter liters litre litres "
    "sekunde sekunden minuten stunde stunden tag tage tagen woche wochen monat monate jahr jahre jahren kilometer gramm kilogramm prozent grad "
    "seconde secondes heure heures jour jours semaine semaines mois ans année années mètre mètres kilomètre kilomètres grammes kilos degrés "
    "segundo segundos minuto minutos hora horas día días semana semanas mes meses año años metro metros kilómetro kilómetros gramos litro litros grados dólares"
).split()
NUM, NAME, UNIT = _U(3), _U(5), _U(7)

_WORD = np.ones(256, bool)
_WORD[:128] = [chr(i).isalnum() for i in range(128)]
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[[10, 13, 33, 46, 58, 63]] = True


def _hashes(words: list[str]) -> np.ndarray:
    raw, offsets = text_bytes(pa.array(words))
    return np.sort(hashed_spans(raw, offsets[:-1], offsets[1:]))


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def templates(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all texts end to end, what their slots hold (0: a literal token), and the texts' offsets; their words, and the offsets of those."""
    raw, offsets = text_bytes(texts)
    none = np.zeros(0, np.uint64)
    if not len(raw):
        return none, none, np.zeros(len(offsets), np.int64), none, np.zeros(len(offsets), np.int64)
    starts, ends = spans(_WORD[raw], offsets)
    if not len(starts):
        return none, none, np.zeros(len(offsets), np.int64), none, np.zeros(len(offsets), np.int64)
    words = hashed_spans(raw, starts, ends)
    at = np.searchsorted(starts, offsets)
    head = np.zeros(len(starts), bool)
    head[at[:-1][at[:-1] < len(starts)]] = True
    digits = np.concatenate([[0], np.cumsum(_DIGIT[raw], dtype=np.int32)])
    stops = np.concatenate([[0], np.cumsum(_STOP[raw], dtype=np.int32)])
    before = np.concatenate([[0], ends[:-1]])
    begins = head | (stops[starts] > stops[np.minimum(before, starts)])
    first, second = raw[starts], raw[np.minimum(starts + 1, len(raw) - 1)]
    capital = (first >= 65) & (first <= 90) | (first == 0xC3) & (second >= 0x80) & (second <= 0x9E)
    number = (digits[ends] - digits[starts] == ends - starts) | _among(words, _NUMBERS)
    unit = np.concatenate([[False], number[:-1]]) & ~head & _among(words, _UNITS) & ~number
    name = capital & ~begins & ~number & ~unit
    tokens = np.where(number, NUM, np.where(name, NAME, np.where(unit, UNIT, words)))
    same = np.concatenate([[False], tokens[1:] == tokens[:-1]]) & (number | name) & ~head
    lead = np.flatnonzero(~same)
    slot = _joined(words, lead)
    keep = (number | name | unit)[lead]
    return tokens[lead], np.where(keep, slot | _U(1), _U(0)), np.searchsorted(lead, at), words, at


def _joined(words: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """A hash of each run of words that begins at ``lead``; order counts."""
    run = np.repeat(np.arange(len(lead)), np.diff(np.append(lead, len(words))))
    place = np.arange(len(words)) - lead[run]
    return np.add.reduceat(words * (_U(0x9E3779B97F4A7C15) * place.astype(np.uint64) + _U(1)), lead)


def _keys(tokens: np.ndarray, at: np.ndarray, form: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each window of ``abs(form)`` tokens starts, the text it lies in, and its hash, which no other form shares."""
    size = abs(form)
    n = max(0, len(tokens) - size + 1)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))[:n]
    start = np.flatnonzero(np.arange(n) + size <= at[1:][owner])
    hashed = np.full(len(start), form * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for k in range(size):
        hashed += tokens[start + k] * _PLACE[k]
    return start, owner[start], mixed(hashed)


def _windows(id_column: str, width: int, literals: int, run: int, forms: list[int] | None, bloom: np.ndarray | None):
    """Windows of ``forms`` that the filter lets through; without them, an item's own: of ``width``, or a shorter item as one."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        row = (task.partitionId() if task else 0) << 33
        for piece in pieces(batches, "text"):
            tokens, slots, at, words, words_at = templates(piece.column("text"))
            literal = np.concatenate([[0], np.cumsum(slots == 0)])
            for form in [f for size in range(1, width + 1) for f in (size, -size)] if forms is None else forms:
                size, of = abs(form), at if form > 0 else words_at
                start, owner, hashed = _keys(tokens if form > 0 else words, of, form)
                counts = np.diff(of)[owner]
                solid = np.ones(len(start), bool) if form < 0 else literal[start + size] - literal[start] >= literals
                good = solid.copy() if form < 0 or size < width else literal[start + size] - literal[start] >= min(FEW, literals)
                if forms is None and size < width or form < 0 and size < literals:
                    good &= counts == size
                if bloom is not None:
                    good &= bloom[hashed & _U((1 << BITS) - 1)]
                hit = np.flatnonzero(good)
                lists = [slots[start[i] : start[i] + size].view(np.int64) if form > 0 else [] for i in hit]
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column(id_column).take(pa.array(owner[hit])), pa.array(np.full(len(hit), form)), pa.array(hashed[hit].view(np.int64)), pa.array(start[hit] - of[:-1][owner[hit]]),
                        pa.array(lists, pa.list_(pa.int64())), pa.array(counts[hit] < width + run - 1), pa.array(solid[hit]), pa.array(owner[hit] + row),
                    ],
                    [id_column, "form", "window", "place", "slots", "short", "solid", "row"],
                )
            row += piece.num_rows

    return windows


_NUMBERS, _UNITS = _hashes(NUMBERS), _hashes(UNITS)


def _filter_of(windows: DataFrame) -> np.ndarray:
    """The Bloom filter's bits; what comes to the driver is at most 2**BITS small numbers, in rows of one segment each."""
    bit = F.col("window").bitwiseAND(F.lit((1 << BITS) - 1))
    rows = windows.select(bit.alias("bit")).distinct().groupBy(F.shiftright("bit", SEGMENT).alias("segment")).agg(F.collect_list(F.col("bit").cast("int")).alias("bits")).collect()
    out = np.zeros(1 << BITS, bool)
    for row in rows:
        out[row["bits"]] = True
    return out


def matches(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, literals: int = LITERALS, run: int = RUN, wide: int = WIDE) -> DataFrame:
    """``doc_id, item_id, n_windows``: items of which a document has a run of windows with one value in each slot.

    A stretch without contradictions needs ``run`` windows with ``literals`` literal tokens at least (a shorter item: one), or
    twice as many with ``FEW``; a run beside a contradiction needs ``wide``. Two slots may hold one value. ``n_windows`` is the
    longest run's length.
    """
    items = benchmark.where("item_id is not null").select("item_id", F.col("text").cast("string").alias("text"))
    shape = "form long, window long, place long, slots array<long>, short boolean, solid boolean, row long"
    of_items = items.mapInArrow(_windows("item_id", width, literals, run, None, None), f"item_id {dict(benchmark.dtypes)['item_id']}, {shape}").withColumnRenamed("row", "item")
    forms = sorted(r["form"] for r in of_items.select("form").distinct().collect())
    texts = docs.where("doc_id is not null").select("doc_id", F.col("text").cast("string").alias("text"))
    of_docs = texts.mapInArrow(_windows("doc_id", width, literals, run, forms, _filter_of(of_items)), f"doc_id {dict(docs.dtypes)['doc_id']}, {shape}")
    joined = of_docs.select("doc_id", "row", "window", F.col("place").alias("at"), F.col("slots").alias("held")).join(of_items, "window")
    pairs = F.filter(F.arrays_zip(F.col("slots").alias("slot"), F.col("held").alias("value")), lambda p: p["slot"] != 0)
    along = ["row", "item", "form", "shift"]
    hits = joined.select("doc_id", "item_id", "row", "item", "form", (F.col("at") - F.col("place")).alias("shift"), "place", "short", "solid", pairs.alias("pairs"))
    hits = hits.repartition(*along).select("*", F.explode_outer("pairs").alias("pair"))  # one shuffle for all that follows
    # What a slot holds in a window, and the last window before that where it holds something else.
    slots = hits.groupBy("doc_id", "item_id", *along, "place", "short", "solid", "pair.slot").agg(F.min("pair.value").alias("low"), F.max("pair.value").alias("high"))
    of_slot = Window.partitionBy(*along, "slot").orderBy("place")
    before = (F.lag("low").over(of_slot) != F.col("low")) | (F.lag("high").over(of_slot) != F.col("high"))
    against = F.when(F.col("low") != F.col("high"), F.col("place")).when(F.col("slot").isNotNull() & before, F.lag("place").over(of_slot))
    windows = slots.withColumn("against", against).groupBy("doc_id", "item_id", *along, "place", "short", "solid").agg(F.max("against").alias("against"))
    windows = windows.withColumn("stretch", F.col("place") - F.row_number().over(Window.partitionBy(*along).orderBy("place")))
    # A window's run reaches back to the start of its stretch, or to the last contradiction behind it.
    against = F.max("against").over(Window.partitionBy(*along, "stretch").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    start = F.min("place").over(Window.partitionBy(*along, "stretch"))
    windows = windows.withColumn("against", against).withColumn("start", start).withColumn("against", F.when(F.col("against") >= F.col("start"), F.col("against")))
    windows = windows.withColumn("length", F.col("place") - F.coalesce("against", F.col("start") - 1))
    stretches = windows.groupBy("doc_id", "item_id", *along, "stretch").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("solid"), 1)).alias("solid"), F.max("short").alias("short"), F.max("against").isNotNull().alias("against"), F.max("length").alias("n_windows")
    )
    sound = F.when(F.col("against"), F.col("n_windows") >= wide).otherwise((F.col("solid") >= run) | (F.col("n") >= 2 * run) | F.col("short") & (F.col("solid") > 0))
    return stretches.where(sound).groupBy("doc_id", "item_id").agg(F.max("n_windows").alias("n_windows"))


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, literals: int = LITERALS, run: int = RUN) -> DataFrame:
    """``doc_id, contaminated, n_items, n_windows`` for each row of ``docs(doc_id, text, ...)``.

    A null or empty text is clean; so is a row with a null doc_id, which can't be told from others. Rows that repeat a
    doc_id are judged each by itself and share the worst verdict. Windows with fewer than ``FEW`` literal tokens are found only
    word for word, and items of fewer than ``literals`` words only where they are the whole document. An empty benchmark
    leaves all clean.
    """
    per_doc = matches(docs, benchmark, width, literals, run).groupBy("doc_id").agg(F.count("*").alias("n_items"), F.max("n_windows").alias("n_windows"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return docs.select("doc_id").join(per_doc, "doc_id", "left").select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), zero("n_items"), zero("n_windows"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
