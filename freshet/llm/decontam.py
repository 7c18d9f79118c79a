"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders; windows of the resulting template are hash-joined between
documents and benchmark items. Windows that meet must also agree on their slots: one item value always stands
for one document value, so a question with other numbers or names is caught and a chance meeting is not.

A capital at the start of a sentence may begin a name or an ordinary word, so texts are read in both ways.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common
from .common import U64

WINDOW = 8
LITERALS = 4
COVERAGE = 0.5
RUN = 13
WINDOW_BITS = 1 << 26
WORD_BITS = 1 << 22

# Number words, unit words and pronouns of one person, English, German, French and Spanish.
NUMBER_WORDS = (
    "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million dozen "
    "eins zwei drei vier sechs sieben acht neun zehn elf zwölf zwanzig dreißig hundert tausend deux trois quatre cinq huit neuf dix onze douze vingt trente cent mille uno dos tres cuatro cinco seis siete ocho nueve diez once doce veinte treinta cien mil"
).split()
UNIT_WORDS = (
    "mm cm m km in ft yd mi mg g kg t lb lbs oz ml l s sec min h hr hours hour minutes minute seconds second days day weeks week months month years year percent usd eur gbp dollars dollar euros euro cents cent pounds pound pence "
    "inches inch feet foot yards yard miles mile meter meters metre metres centimeters centimetres kilometer kilometers kilometre kilometres gram grams kilogram kilograms ounces ounce tons tonnes liter liters litre litres gallons gallon pints cups degrees mph kmh kph watts volts "
    "stunden minuten sekunden tage wochen jahre heures secondes jours semaines ans horas minutos segundos semanas años"
).split()

PRONOUNS = "he she him her his hers himself herself il elle lui él ella er sie ihm ihr ihn sein seine seinen seinem seiner ihre ihren ihrem ihrer".split()

LITERAL, NUMBER, NAME, UNIT, PRONOUN = 0, 1, 2, 3, 4

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_POINT = np.zeros(256, bool)
_POINT[[44, 46]] = True
_STOP = np.zeros(256, np.int32)
_STOP[[10, 33, 46, 58, 63]] = 1


def _folded(data: np.ndarray) -> np.ndarray:
    """A-Z and the capitals of Latin-1 (UTF-8 C3 80-9E but the multiplication sign) in lower case."""
    out = common._LOWER[data]
    out[_accented(data)] += 32
    return out


def _accented(data: np.ndarray) -> np.ndarray:
    """Places of the second byte of accented Latin-1 capitals."""
    return np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1


def _hash_list(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    return np.sort(_tokens(data, np.array([0, len(data)]))[0])


def _tokens(data: np.ndarray, offsets: np.ndarray):
    """(hash, start, end, begins, title, first): every token's lower-cased hash and place, whether it begins a text or
    sentence, whether it is title case, and each text's first token.

    A token is a run of letters (bytes from 128 count as letters) or a number, points and commas between digits
    included; a digit next to a letter starts a new token. Temporary arrays cover pieces of about PIECE bytes, cut at
    white space.
    """
    parts, at, stopped, size = [], 0, True, len(data)
    while at < size:
        end = min(size, at + common.PIECE)
        while end < size and not common._WS[data[end]]:
            end += 1
        piece = data[at:end]
        letter, digit = _LETTER[piece], _DIGIT[piece]
        inside = np.zeros(len(piece), bool)
        if len(piece) > 2:
            inside[1:-1] = _POINT[piece[1:-1]] & digit[:-2] & digit[2:]
        kind = letter.astype(np.int8) + 2 * (digit | inside).astype(np.int8)
        cut = np.zeros(len(piece) + 1, bool)
        cut[offsets[(offsets >= at) & (offsets <= end)] - at] = True
        edge = np.ones(len(piece) + 1, bool)
        edge[1:-1] = kind[1:] != kind[:-1]
        edge |= cut
        places = np.flatnonzero(edge)
        s, e = places[:-1], places[1:]
        keep = kind[s] > 0
        s, e = s[keep], e[keep]
        stops = np.concatenate(([0], np.cumsum(_STOP[piece] + cut[:-1])))
        if len(s):
            first = np.zeros(len(piece), np.int32)
            first[s] = np.diff(s, prepend=0)
            pos = np.arange(len(piece), dtype=np.int32) - np.cumsum(first, dtype=np.int32)
            v = common._BYTE[_folded(piece)] * common._POW[pos & 0xFFFF]
            v[kind == 0] = 0
            h = common.mix(np.add.reduceat(v, s) + (e - s).astype(U64))
            # a stop or a text's start between the token before and this one; a start counts at its own place
            upto = stops[s] + cut[s]
            begins = np.concatenate(([stopped or upto[0] > 0], upto[1:] != stops[e[:-1]]))
            capital = (piece >= 65) & (piece <= 90)
            capital[_accented(piece) - 1] = True
            width = 1 + (piece[s] == 0xC3)
            following = capital[np.minimum(s + width, len(piece) - 1)] & (s + width < e)
            title = capital[s] & ~following & (e - s > width)
            parts.append((h, s + at, e + at, begins, title))
            stopped = bool(stops[-1] != stops[e[-1]])
        else:
            stopped = stopped or bool(stops[-1])
        at = end
    if not parts:
        none = np.zeros(0, np.int64)
        return np.zeros(0, U64), none, none, np.zeros(0, bool), np.zeros(0, bool), np.zeros(len(offsets), np.int64)
    h, s, e, begins, title = (np.concatenate(x) for x in zip(*parts))
    return h, s, e, begins, title, np.searchsorted(s, offsets)


_NUMBERS = _hash_list(NUMBER_WORDS)
_UNITS = _hash_list(UNIT_WORDS)
_PRONOUNS = _hash_list(PRONOUNS)
_PLACE = common.mix(np.arange(1, 6, dtype=U64))


def readings(data: np.ndarray, offsets: np.ndarray, known: np.ndarray | None = None) -> list[tuple]:
    """Two readings (template hash, kind, start, end, first, word hash, place): the tokens with placeholders for numbers,
    names and units, the place being the token's number in its text.

    A name is a title-case token; a number and a unit are digits or words of the lists, a unit
    right after a number (or up to three letters joined to its digits). A pronoun of one person is a slot too, also in title case: it goes
    with the name it stands for. Title case at the start of a text or sentence is an
    ordinary word in the first reading and, unless its word is among ``known`` (a bit set), a name in the second. There, also,
    names next to each other, by one space or hyphen, are one, and a number word goes with the number before it.
    """
    h, s, e, begins, title, first = _tokens(data, offsets)
    out = []
    number = _DIGIT[data[s]] | np.isin(h, _NUMBERS)
    after = np.zeros(len(h), bool)
    after[1:] = number[:-1]
    after[first[:-1][first[:-1] < len(h)]] = False
    joined = np.zeros(len(h), bool)
    joined[1:] = after[1:] & (s[1:] == e[:-1]) & (e[1:] - s[1:] <= 3)
    unit = after & ~number & (joined | np.isin(h, _UNITS))
    pronoun = np.isin(h, _PRONOUNS)
    near = np.zeros(len(h), bool)
    near[1:] = (s[1:] - e[:-1] == 1) & ((data[e[:-1]] == 32) | (data[e[:-1]] == 45)) if len(h) else False
    near[first[:-1][first[:-1] < len(h)]] = False
    for both in (False, True):
        name = title & ~begins if not both else title & ~(begins & has(known, h)) if known is not None else title
        kind = np.where(number, NUMBER, np.where(unit, UNIT, np.where(pronoun, PRONOUN, np.where(name, NAME, LITERAL)))).astype(np.int8)
        if not len(h):
            out.append((h, kind, s, e, first, h, s))
            continue
        more = np.zeros(len(h), bool)
        if both:
            more[1:] = near[1:] & (kind[1:] == kind[:-1]) & ((kind[1:] == NAME) | (kind[1:] == NUMBER) & ~_DIGIT[data[s[1:]]])
        keep = np.flatnonzero(~more)
        turn = np.arange(len(h)) - np.repeat(keep, np.diff(np.append(keep, len(h))))
        words = np.add.reduceat(common.mix(h + turn.astype(U64) * U64(0xD6E8FEB86659FD93)), keep)
        kind = kind[keep]
        t = words.copy()
        t[kind > 0] = _PLACE[kind[kind > 0]]
        own = np.searchsorted(keep, first)
        place = keep - np.repeat(first[:-1], np.diff(own))
        out.append((t, kind, s[keep], e[np.append(keep[1:], len(h)) - 1], own, words, place))
    return out


def bit_set(hashes: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Words and masks of a bit set over column h: bits / 64 of them at most, whatever the number of rows."""
    low = F.col("h").bitwiseAND(F.lit(bits - 1))
    rows = hashes.groupBy(F.shiftrightunsigned(low, 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), low.bitwiseAND(F.lit(63)).cast("int"))).alias("m")).collect()
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64).view(U64)


def dense(words: tuple[np.ndarray, np.ndarray], bits: int) -> np.ndarray:
    out = np.zeros(bits // 64, U64)
    out[words[0]] = words[1]
    return out


def has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each hash may be in the bit set."""
    at = h & U64(64 * len(bits) - 1)
    return (bits[(at >> U64(6)).astype(np.int64)] >> (at & U64(63))) & U64(1) > 0


def _both_ways(benchmark: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Bit set of the benchmark's words that open a sentence in title case and also stand in lower case."""

    def run(batches):
        for b in batches:
            for _, _, data, offsets in common.text_blocks(b):
                h, _, _, begins, title, _ = _tokens(data, offsets)
                for x, opens in ((h[title & begins], True), (h[~title], False)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.unique(x).view(np.int64)), pa.array([opens] * len(np.unique(x)), pa.bool_())], names=["h", "opens"])

    words = benchmark.select("text").mapInArrow(run, "h long, opens boolean").groupBy("h").agg(F.max("opens").alias("opens"), F.min("opens").alias("always"))
    return bit_set(words.where("opens and not always"), WORD_BITS)


def _windows(docs: DataFrame, key: str, wanted: tuple | None, known: tuple, size: int, literals: int, short: list[int] | None = None) -> DataFrame:
    """(key, text_hash, pos, width, window, slots, exact): all windows of each text, or those whose hash may be wanted.

    Windows have ``size`` tokens or one of the ``short`` widths; with short None, a text with fewer than ``size`` tokens
    is one window. Of the second reading only the windows that differ from the first are given. A window with fewer than
    ``literals`` ordinary tokens (fewer than all, in a shorter one) says too little as a template: it is exact, its hash is
    that of its words and it has no slots. Other short windows are given both ways.
    """

    def run(batches):
        words_known = dense(known, WORD_BITS)
        bits = None if wanted is None else dense(wanted, WINDOW_BITS)
        for b in batches:
            out = [[], [], [], [], [], [], []]
            keys, hashes = b.column(0), b.column(2)
            for i, j, data, offsets in common.text_blocks(b):
                read = readings(data, offsets, words_known)
                was = _kinds_by_token(read[0], len(data))
                for second, (t, kind, s, e, first, words, place) in enumerate(read):
                    plain = np.concatenate(([0], np.cumsum((kind == LITERAL) | (kind == PRONOUN))))
                    new = np.concatenate(([0], np.cumsum((was[s] != kind) | (np.diff(place, append=0) > 1)))) if second else None
                    lens = np.diff(first)
                    narrow = [(w, also) for w in (range(1, size) if short is None else short) for also in (False, True)]
                    for width, also in (*narrow, (size, False)):
                        g = common.grams(t, width)
                        if not len(g):
                            continue
                        exact = plain[width : width + len(g)] - plain[: len(g)] < min(literals, width)
                        good = ~exact if also else np.ones(len(g), bool)
                        if second:
                            good &= new[width : width + len(g)] > new[: len(g)]
                        exact = exact | also
                        g = np.where(exact, common.mix(common.grams(words, width)), g)
                        at = np.flatnonzero(good if bits is None else good & has(bits, g))
                        text = np.searchsorted(first, at, "right") - 1
                        good = at + width <= first[np.minimum(text + 1, len(first) - 1)]
                        if short is None and width < size:
                            good &= lens[np.minimum(text, len(lens) - 1)] == width
                        for p, k in zip(at[good].tolist(), text[good].tolist()):
                            slots = [] if exact[p] else [f"{kind[q]}:" + _folded(data[s[q] : e[q]]).tobytes().decode("utf-8", "replace") for q in range(p, p + width) if kind[q]]
                            row = (keys[i + k].as_py(), hashes[i + k].as_py(), int(place[p]), width, g[p].astype(np.int64).item(), slots, bool(exact[p]))
                            for c, v in zip(out, row):
                                c.append(v)
            kinds = [pa.int64()] * 5 + [pa.list_(pa.string()), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=[key, "text_hash", "pos", "width", "window", "slots", "exact"])

    rows = docs.select(key, "text", common.unicode_hash().alias("text_hash"))
    return rows.mapInArrow(run, f"{key} long, text_hash long, pos long, width long, window long, slots array<string>, exact boolean")


def _kinds_by_token(reading: tuple, size: int) -> np.ndarray:
    """Kind of the reading's token that begins at each byte; -1 where none does."""
    out = np.full(size + 1, -1, np.int8)
    out[reading[2]] = reading[1]
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, literals: int = LITERALS, coverage: float = COVERAGE, run: int = RUN) -> DataFrame:
    """(doc_id, text_hash, item_id, n_windows, item_windows, kind) for each document that holds a benchmark item.

    A pair counts when windows that are equal word for word, or consistent, cover at least ``coverage`` of the item's
    windows, or when windows equal word for word stand for a passage of ``run`` tokens; kind is 'verbatim' or
    're-parameterised' (some window differs in its slots). In a consistent window each item value stands for the same document value in
    all windows of its alignment, pronouns apart. Of the windows that are templates alone, the same coverage is enough: a copy with other
    values cannot meet the exact ones. An item with fewer than ``size`` tokens is looked up whole, wherever it stands in
    a document.
    A bit set of fixed size of the item windows travels to the document scan, so few windows but those that meet are
    shuffled; with a benchmark of very many windows it lets more through, and the join gives the same rows.
    Null and empty texts, documents or items, have no windows. Repeated rows are one document with their id.
    """
    known = _both_ways(benchmark)
    items = common.checkpoint(_windows(benchmark, "item_id", None, known, size, literals))
    wanted = bit_set(items.select(F.col("window").alias("h")), WINDOW_BITS)
    short = sorted(r[0] for r in items.where(F.col("width") < size).select("width").distinct().collect())  # size - 1 at most
    seen = _windows(docs, "doc_id", wanted, known, size, literals, short).select("doc_id", "text_hash", "window", "slots", "pos")
    sizes = items.groupBy("item_id").agg(F.countDistinct("pos").alias("item_windows"), F.countDistinct(F.when(~F.col("exact"), F.col("pos"))).alias("item_templates"))
    right = items.select("item_id", "window", F.col("pos").alias("item_pos"), F.col("slots").alias("item_slots"), "exact").distinct()
    met = common.checkpoint(seen.join(right, "window").withColumn("shift", F.col("pos") - F.col("item_pos")).drop("window", "pos"))
    pair = ["doc_id", "text_hash", "item_id", "shift"]
    zipped = F.arrays_zip(F.col("slots").alias("d"), F.col("item_slots").alias("i"))
    # windows that equal the item's word for word are evidence whatever the other windows hold
    met = met.withColumn("changed", (F.col("slots") != F.col("item_slots")).cast("int"))
    # a pronoun follows its name, whose slots are compared: one form of it may stand for several
    named = F.filter(zipped, lambda z: ~z["i"].startswith(f"{PRONOUN}:"))
    slots = met.select(*pair, F.explode(named).alias("z")).groupBy(*pair, F.col("z.i").alias("i")).agg(F.min("z.d").alias("lo"), F.max("z.d").alias("hi"))
    torn = slots.where("lo <> hi").groupBy(*pair).agg(F.collect_set("i").alias("torn"))
    torn = torn.select(*[F.col(c).alias(f"_{c}") for c in pair], "torn")
    on = F.lit(True)
    for c in pair:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    rows = met.join(torn, on, "left").where((F.col("changed") == 0) | F.col("torn").isNull() | ~F.arrays_overlap("item_slots", "torn"))
    # at most an item's windows in each set
    rows = rows.withColumn("equal", F.size(F.collect_set(F.when(F.col("changed") == 0, F.col("item_pos"))).over(W.partitionBy(*pair))))
    pairs = rows.groupBy("doc_id", "text_hash", "item_id").agg(
        F.countDistinct("item_pos").alias("n_windows"), F.countDistinct(F.when(~F.col("exact"), F.col("item_pos"))).alias("n_templates"),
        F.countDistinct(F.when(F.col("changed") == 0, F.col("item_pos"))).alias("n_equal"), F.max("equal").alias("equal"),
    )
    enough = lambda n, of: F.col(n) >= F.greatest(F.lit(1.0), F.col(of) * coverage)
    long = F.col("equal") >= max(1, run - size + 1)
    done = pairs.join(sizes, "item_id").where(enough("n_windows", "item_windows") | enough("n_templates", "item_templates") | long)
    return done.select("doc_id", "text_hash", "item_id", "n_windows", "item_windows", F.when(F.col("n_equal") < F.col("n_windows"), "re-parameterised").otherwise("verbatim").alias("kind"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("text_hash")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of docs, all their columns, without contaminated documents.

    Null and empty texts stay; rows that repeat an id go or stay by their own text, a null id too.
    """
    hit = contaminated(docs.select("doc_id", "text"), benchmark).select("doc_id", "text_hash")
    return common.anti_join(docs, hit, ["doc_id", common.unicode_hash()])
