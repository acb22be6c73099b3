"""Quality rules whose limits adapt to each language and source.

Method. Per document some counts are taken from the whole text, and from them whole-number
rates. For each language and source a quantile sketch of every rate is kept: a histogram
whose bins are exact up to 127 and then keep seven significant bits, so a quantile is off by
less than one part in 64. Sketches of parts merge by adding bins; that is how they are built
from partitions, and how those of a language are built from its sources. Limits lie ``reach``
quartile distances, and a margin, outside the quartiles. A group with fewer than
``least_rows`` rows uses the sketch of its language, and that of all documents if that is
small too. The limits are joined to the documents of their group.

Results. Null texts are empty; null languages and sources are groups of their own. A
document that fails the base rules is not kept, and does not count for the sketches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, pieces, texts

WINDOW = 8
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"

# Rate: (numerator, factor, margin, also a lower limit)
RATES = {
    "symbol_rate": ("n_symbols", 1000, 100, False),
    "line_rate": ("n_dup_lines", 1000, 20, False),
    "repeat_rate": ("n_repeat_words", 1000, 250, False),
    "word_length": ("word_chars", 100, 100, True),
}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Settings:
    least_words: int = 20
    most_repeated: int = 30  # in percent of the words
    reach: int = 3
    least_rows: int = 30


# Counts of a text -------------------------------------------------------------


def repeated_words(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each text the words in windows that it has twice or more; words are numbers."""
    n = len(words)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    codes, width = words, 1
    while width < WINDOW:
        following = np.full(n, -1, np.int64)
        following[: max(0, n - width)] = codes[width:]
        codes = np.unique((codes + 1) * (n + 2) + following + 1, return_inverse=True)[1].reshape(-1)
        width *= 2
    inside = np.flatnonzero(np.arange(n) + WINDOW <= np.cumsum(sizes)[owner])
    _, place, count = np.unique(codes[inside] * (len(sizes) + 1) + owner[inside], return_inverse=True, return_counts=True)
    twice = inside[count[place.reshape(-1)] > 1]
    change = np.zeros(n + WINDOW + 1, np.int64)
    np.add.at(change, twice, 1)
    np.add.at(change, twice + WINDOW, -1)
    return np.bincount(owner, np.cumsum(change)[:n] > 0, minlength=len(sizes)).astype(np.int64)


def counts_of(lines: list[str]) -> dict[str, np.ndarray]:
    """The base counts of some texts."""
    numbers: dict[bytes, int] = {}
    words, sizes, chars, symbols, repeats = [], [], [], [], []
    for text in lines:
        own = text.encode().split()
        words += [numbers.setdefault(w, len(numbers)) for w in own]
        sizes.append(len(own))
        chars.append(len(text) - sum(map(text.count, WHITE)))
        symbols.append(sum(map(text.count, SYMBOLS)))
        rows = [row for row in text.split("\n") if row.strip(WHITE)]
        repeats.append(len(rows) - len(set(rows)))
    size = np.array(sizes, np.int64)
    found = (size, chars, symbols, repeats, repeated_words(np.array(words, np.int64), size))
    return dict(zip(BASE, (np.array(x, np.int64) for x in found)))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in pieces(whole):
            found = counts_of(texts(batch.column(0)))
            columns = [*batch.columns[1:], *[pa.array(found[c], pa.int64()) for c in BASE]]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[1:], *BASE])


def counted(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` and the base counts of every row."""
    chosen = df.select(text, *keep)
    kind = ", ".join([f"`{c}` {chosen.schema[c].dataType.simpleString()}" for c in keep] + [f"{c} long" for c in BASE])
    return chosen.mapInArrow(_counted, kind)


# Sketches and limits ----------------------------------------------------------


def sketch_bin(value: Column) -> Column:
    """The bin of a whole number: its seven leading bits, the others 0."""
    spare = F.greatest(F.length(F.bin(value)) - 7, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, spare), spare)


def sketches(df: DataFrame, by: list[str]) -> DataFrame:
    """(by, rate, bin, n): the bins of every rate and group."""
    rates = [F.struct(F.lit(name).alias("rate"), sketch_bin(F.col(name)).alias("bin")) for name in RATES]
    return df.select(*by, F.explode(F.array(*rates)).alias("r")).groupBy(*by, "r.rate", "r.bin").agg(F.count("*").alias("n"))


def merged(parts: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of larger groups from those of smaller ones."""
    return parts.groupBy(*by, "rate", "bin").agg(F.sum("n").alias("n"))


def quartiles(parts: DataFrame, by: list[str]) -> DataFrame:
    """(by, rows, one struct for each rate with the first and third quartile)."""
    from pyspark.sql import Window

    order = Window.partitionBy(*by, "rate").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by, "rate")
    running = parts.withColumns({"upto": F.sum("n").over(order), "total": F.sum("n").over(whole)})
    at = running.groupBy(*by, "rate").agg(
        F.max("total").alias("rows"),
        F.min(F.when(F.col("upto") * 4 >= F.col("total"), F.col("bin"))).alias("q1"),
        F.min(F.when(F.col("upto") * 4 >= F.col("total") * 3, F.col("bin"))).alias("q3"),
    )
    pairs = [F.max(F.when(F.col("rate") == name, F.struct("q1", "q3"))).alias(name) for name in RATES]
    return at.groupBy(*by).agg(F.max("rows").alias("rows"), *pairs)


def limits(parts: DataFrame, s: Settings) -> DataFrame:
    """(lang, source, limits): a struct of lowest and highest values for each group."""
    own = quartiles(parts, ["lang", "source"])
    of_lang = quartiles(merged(parts, ["lang"]), ["lang"])
    of_all = quartiles(merged(parts.withColumn("everything", F.lit(1)), ["everything"]), ["everything"])
    lang = of_lang.select(F.col("lang").alias("l"), F.struct("rows", *RATES).alias("of_lang"))
    everything = of_all.select(F.struct("rows", *RATES).alias("of_all"))
    # One row against one for each group: the limits of all documents.
    joined = own.join(lang, F.col("lang").eqNullSafe(F.col("l")), "left").join(F.broadcast(everything), F.lit(True), "left")
    columns = []
    for name, (_, _, margin, both) in RATES.items():
        chosen = F.when(F.col("rows") >= s.least_rows, F.col(name))
        chosen = chosen.when(F.col("of_lang.rows") >= s.least_rows, F.col(f"of_lang.{name}")).otherwise(F.col(f"of_all.{name}"))
        spread = (chosen["q3"] - chosen["q1"]) * s.reach + margin
        columns.append((chosen["q3"] + spread).alias(f"most_{name}"))
        if both:
            columns.append((chosen["q1"] - spread).alias(f"least_{name}"))
    return joined.select("lang", "source", *columns)


def judged(df: DataFrame, id_col: str = "doc_id", s: Settings = Settings()) -> DataFrame:
    """doc_id, the base counts, base_failed and kept for every row of ``df`` (doc_id, text, lang, source)."""
    counts = counted(df.withColumnRenamed(id_col, "doc_id"), ["doc_id", "lang", "source"])
    words = F.col("n_words")
    failed = (words < s.least_words) | (F.col("n_repeat_words") * 100 > words * s.most_repeated)
    rates = {name: F.expr(f"{top} * {factor} div greatest(n_words, 1)") for name, (top, factor, _, _) in RATES.items()}
    base = materialize(counts.withColumn("base_failed", failed).withColumns(rates), "counts")

    own = limits(sketches(base.filter("not base_failed"), ["lang", "source"]), s)
    own = own.withColumnsRenamed({"lang": "own_lang", "source": "own_source"})
    same = F.col("lang").eqNullSafe(F.col("own_lang")) & F.col("source").eqNullSafe(F.col("own_source"))
    fits = ~F.col("base_failed")
    for name, (_, _, _, both) in RATES.items():
        fits &= F.coalesce(F.col(name) <= F.col(f"most_{name}"), F.lit(False))
        if both:
            fits &= F.col(name) >= F.col(f"least_{name}")
    return base.join(own, same, "left").select("doc_id", *BASE, "base_failed", fits.alias("kept"))
