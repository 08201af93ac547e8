"""Quality rules with an n-gram perplexity (operator 10).

Base rules (whole texts, words as in ``textops``): fewer than 50 words, or over half of the words in
three-word windows that the text repeats, reject a text. The method's verdict is a modified
Kneser-Ney model over all texts: n-grams of ``ORDER`` bytes across words, letters as they are, a space
after each word, spaces before a text.

* Counting: every task counts the n-grams of its texts, Spark sums them. No alphabet, vocabulary or count is
  cut, so what is gathered and stored grows with the input.
* Model: continuation counts below the highest order, three discounts an order from the counts of
  counts, interpolated down to a uniform distribution over bytes; all by DataFrame aggregates, windows and
  joins over distinct n-grams. Each n-gram found has its log probability in the table, so scoring the
  counted texts needs no other order.
* Scoring: the table is dealt by hash into ``shards`` of about ``SHARD`` n-grams. A shard is a sorted array of packed
  n-grams with their logs, broadcast by itself (12 bytes an n-gram, 50 MB); one pass over the texts looks
  up each shard, and the sums of all passes add up. One law at every size: only the number of passes grows,
  with the distinct n-grams of the corpus.
* Bands: the log perplexity (a byte) of each text that passes the base rules, per language, over all texts; from
  the median ``LOW`` robust spreads down and ``HIGH`` up. A text outside is rejected; on an edge it stays. The
  median and spread of a language (null is one) of n such texts are means of its own, with
  weight n, and those of all languages together, with weight ``prior``; the band is wider by
  sqrt(1 + 1/n).

Null and empty texts have no words and fail the base rules. Repeated rows get the same verdict. Temporary
memory follows a few megabytes of text, or the longest text. Where there are more shards than one, texts are
known by a 64-bit hash and their size. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from lattica.llm import jaccard, textops
from lattica.llm.flat import distinct, spread
from lattica.llm.session import lean, unused

ORDER, SHARD, HELD = 5, 1 << 22, 1 << 22
LOW, HIGH, PRIOR, FLOOR = 8.0, 4.5, 20, 0.05
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.isin(np.arange(256), list(_SYMBOLS))


def grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The packed n-gram that ends at each byte of the words and at the space after each, and its text."""
    size = ends - starts + 1
    stream = data[np.minimum(spread(starts, size), max(len(data) - 1, 0))]
    stream[np.cumsum(size) - 1] = 32
    owner = np.repeat(text, size)
    new = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    packed = stream.astype(textops.U)
    for k in range(1, ORDER):
        before = np.full(len(stream), 32, np.uint8)
        before[k:] = stream[:-k]
        for j in range(k):  # what stands before a text
            edge = new + j
            before[edge[edge < len(stream)]] = 32
        packed |= before.astype(textops.U) << textops.U(8 * k)
    return packed.view(np.int64), owner


def base_measures(data: np.ndarray, offs: np.ndarray, starts, ends, text, hashed) -> dict[str, np.ndarray]:
    """The base columns of each text."""
    n = len(offs) - 1

    def total(flags):
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return sums[offs[1:]] - sums[offs[:-1]]

    black = ~textops._WS[data]
    n_words = np.bincount(text, minlength=n).astype(np.int64)
    covered = np.zeros(len(hashed), bool)
    if len(hashed) >= 3:
        same = text[2:] == text[:-2]
        acc = textops.mix(text[2:].astype(textops.U) + textops.U(1))
        for k in range(3):
            acc = textops.mix(acc + hashed[k : len(hashed) - 2 + k] * textops.U(2 * k + 3))
        at = np.flatnonzero(same)
        acc = acc[at]
        order = np.argsort(acc)
        ranked = acc[order]
        equal = ranked[1:] == ranked[:-1]
        twice = np.zeros(len(acc), bool)
        twice[order[1:][equal]] = True
        twice[order[:-1][equal]] = True
        for k in range(3):
            covered[at[twice] + k] = True
    cut = np.zeros(len(data) + 1, bool)
    cut[offs] = True
    ends_here = np.flatnonzero(data == 10)
    line_starts = np.unique(np.concatenate([offs[:-1][offs[:-1] < offs[1:]], ends_here + 1]))
    line_starts = line_starts[line_starts < len(data)]
    breaks = np.append(ends_here, len(data))
    line_ends = np.minimum(breaks[np.searchsorted(breaks, line_starts)], offs[np.searchsorted(offs, line_starts, "right")]) if len(line_starts) else line_starts
    dark = np.concatenate([[0], np.cumsum(black)])
    with_word = dark[line_ends] > dark[line_starts]
    line_starts, line_ends = line_starts[with_word], line_ends[with_word]
    owner = np.searchsorted(offs, line_starts, "right") - 1
    key = textops.mix(textops.hashes(data, line_starts, line_ends) + textops.mix(owner.astype(textops.U)))
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    again = order[1:][ranked[1:] == ranked[:-1]]
    return {
        "n_words": n_words,
        "word_chars": total(black & ((data & 0xC0) != 0x80)),
        "n_symbols": total(_SYMBOL[data]),
        "n_dup_lines": np.bincount(owner[again], minlength=n).astype(np.int64),
        "n_repeat_words": np.bincount(text[covered], minlength=n).astype(np.int64),
    }


def gram_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(gram, n): how often each packed n-gram is found in all texts."""

    def run(batches):
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for part in textops.chunks(batch, "text", 2 << 20):
                data, offs = textops.packed(part.column(0))
                words = textops.spans(data, offs)
                if not len(words[0]):
                    continue
                found, n = np.unique(grams(data, *words)[0], return_counts=True)
                keys, _, back = distinct(np.concatenate([keys, found]))
                counts = np.bincount(back, np.concatenate([counts, n]), len(keys)).astype(np.int64)
                if len(keys) > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["gram", "n"])
                    keys, counts = keys[:0], counts[:0]
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["gram", "n"])

    parts = docs.select(F.col(text_col).alias("text")).mapInArrow(lean(run), "gram long, n long")
    return parts.groupBy("gram").agg(F.sum("n").alias("n"))


def discounts(found: list[int]) -> list[float]:
    """The discounts of counts 1, 2 and 3 or more from how many n-grams have the counts 1 to 4."""
    if min(found) == 0:
        return [0.5, 0.75, 0.9]
    y = found[0] / (found[0] + 2 * found[1])
    ideal = [k - (k + 1) * y * found[k] / found[k - 1] for k in (1, 2, 3)]
    return [min(max(d, 0.1), k - 0.05) for k, d in zip((1, 2, 3), ideal, strict=True)]


def probabilities(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, p): the probability of the last byte of each n-gram of ``counts`` (gram, n) after the others."""
    shorter = lambda k: F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1))
    tables = {order: counts.checkpoint()}
    for k in range(order - 1, 0, -1):  # continuation counts: how many bytes stand before
        tables[k] = tables[k + 1].groupBy(shorter(k).alias("gram")).agg(F.count("*").alias("n")).checkpoint()
    below = None
    for k in range(1, order + 1):
        ones = tables[k].agg(*[F.count_if(F.col("n") == j).alias(f"n{j}") for j in (1, 2, 3, 4)]).first()
        d = discounts(list(ones))
        cut = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        after = Window.partitionBy(F.shiftright("gram", 8))
        total = F.sum("n").over(after)
        level = tables[k].select("gram", ((F.col("n") - cut) / total).alias("own"), (F.sum(cut).over(after) / total).alias("weight"))
        if below is None:
            below = level.select("gram", (F.col("own") + F.col("weight") / 256).alias("p"))
        else:
            under = below.select(F.col("gram").alias("suffix"), "p")
            below = level.join(under, shorter(k - 1) == F.col("suffix")).select("gram", (F.col("own") + F.col("weight") * F.col("p")).alias("p"))
    return below


class Model:
    """The log probabilities of all n-grams, in shards."""

    def __init__(self, table: DataFrame, most: int = SHARD):
        self.table = table.select("gram", F.log("p").cast("float").alias("log")).checkpoint()
        self.shards = max(1, -(-self.table.count() // most))

    def arrays(self, shard: int) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams of a shard, sorted, and their logs; about ``SHARD`` of them."""
        own = self.table.where(F.pmod(F.xxhash64("gram"), F.lit(self.shards)) == shard).toArrow()
        keys = own["gram"].to_numpy()
        order = np.argsort(keys)
        return keys[order], own["log"].to_numpy()[order]


def fit(docs: DataFrame, text_col: str = "text", shard: int = SHARD) -> Model:
    """Count over all texts and build the model."""
    return Model(probabilities(gram_counts(docs, text_col)), shard)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of ``docs`` but ``text``, and in one struct ``_q`` the base columns and the log perplexity."""
    spark, rest = docs.sparkSession, [c for c in docs.columns if c != "text"]
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(*rest, F.xxhash64(text).alias("_h"), F.octet_length(text).alias("_size"), "text")
    inner = StructType.fromDDL(f"{BASE}, symbols long, cost double")

    def looked_up(shard: int) -> DataFrame:
        shared = spark.sparkContext.broadcast(model.arrays(shard))

        def run(batches):
            known, logs = shared.value
            for batch in batches:
                for part in textops.chunks(batch, "text", 2 << 20):
                    data, offs = textops.packed(part.column(part.schema.get_field_index("text")))
                    words = textops.spans(data, offs)
                    n = part.num_rows
                    cost = np.zeros(n)
                    if len(words[0]) and len(known):
                        keys, _, back = distinct(grams(data, *words)[0])
                        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                        value = np.where(known[at] == keys, logs[at], 0).astype(np.float64)
                        size = words[1] - words[0] + 1
                        sums = np.concatenate([[0], np.cumsum(value[back])])
                        cost -= np.bincount(words[2], np.diff(sums[np.concatenate([[0], np.cumsum(size)])]), n)
                    symbols = np.bincount(words[2], words[1] - words[0] + 1, n).astype(np.int64)
                    found = base_measures(data, offs, *words, textops.hashes(data, *words[:2])) if shard == 0 else {f.name: np.zeros(n, np.int64) for f in inner[:5]}
                    cols = [*map(pa.array, found.values()), pa.array(symbols), pa.array(cost)]
                    named = pa.StructArray.from_arrays(cols, inner.names)
                    kept = [part.column(i) for i in range(part.num_columns) if part.schema.names[i] != "text"]
                    yield pa.RecordBatch.from_arrays([*kept, named], [c for c in part.schema.names if c != "text"] + ["_q"])

        source = keyed if shard == 0 else keyed.select("_h", "_size", "text")
        return source.mapInArrow(lean(run), StructType([*[f for f in source.schema if f.name != "text"], StructField("_q", inner)]))

    first, cost = looked_up(0), F.col("_q.cost")
    if model.shards > 1:
        more = reduce(DataFrame.union, [looked_up(s).select("_h", "_size", F.lit(s).alias("s"), "_q.cost").dropDuplicates(["_h", "_size"]) for s in range(1, model.shards)])
        total = more.groupBy("_h", "_size").agg(F.sum("cost").alias("_more"))
        first, cost = first.join(total, ["_h", "_size"]), F.col("_q.cost") + F.col("_more")
    names = [f.name for f in inner[:5]]
    q = F.struct(*[F.col(f"_q.{c}").alias(c) for c in names], F.when(F.col("_q.symbols") > 0, cost / F.col("_q.symbols")).otherwise(0.0).alias("log_perplexity"))
    return first.select(*rest, q.alias("_q"))


def base_failed(name: str = "_q"):
    q = F.col(name)
    return (q.n_words < 50) | (100 * q.n_repeat_words > 50 * q.n_words)


def bands(measured: DataFrame, lang_col: str = "lang", low: float = LOW, high: float = HIGH, prior: float = PRIOR) -> DataFrame:
    """(band_lang, low, high) of the log perplexity, a row for each language of ``measured`` (lang, _q),
    which is read twice: pass a checkpoint. ``low`` and ``high`` are in robust spreads."""
    passed = measured.where(~base_failed()).select(F.col(lang_col).cast("string").alias("lang"), F.col("_q.log_perplexity").alias("p"))

    def middle(df, *by):
        q = df.groupBy(*by).agg(F.percentile_approx("p", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 10000).alias("q"), F.count("*").alias("n"))
        spread = F.greatest((F.col("q")[2] - F.col("q")[0]) / F.lit(1.349), F.lit(FLOOR / 4))
        return q.select(*by, "n", F.col("q")[1].alias("mid"), spread.alias("spread"))

    every = middle(passed).first()
    share = F.col("n") / (F.col("n") + F.lit(float(prior)))
    shrunk = lambda name: share * F.col(name) + (1 - share) * F.lit(every[name])
    unit = shrunk("spread") * F.sqrt(1 + 1 / F.col("n"))
    return middle(passed, "lang").select(F.col("lang").alias("band_lang"), (shrunk("mid") - low * unit).alias("low"), (shrunk("mid") + high * unit).alias("high"))


def kept(measured: DataFrame, table: DataFrame, lang_col: str = "lang", name: str = "_q") -> tuple[DataFrame, str]:
    """``measured`` with the verdict in one more column, and that column's name."""
    lang, low, high, out = (unused(measured, n) for n in ("_band_lang", "_low", "_high", "_kept"))
    table = table.select(F.col("band_lang").alias(lang), F.col("low").alias(low), F.col("high").alias(high))
    joined = measured.join(table, F.col(lang_col).cast("string").eqNullSafe(F.col(lang)), "left")
    p = F.col(name)["log_perplexity"]
    inside = F.coalesce((p >= F.col(low)) & (p <= F.col(high)), F.lit(True))
    return joined.withColumn(out, ~base_failed(name) & inside).drop(lang, low, high), out


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", low: float = LOW, high: float = HIGH, shard: int = SHARD) -> DataFrame:
    """Per text: doc_id, the base columns, base_failed, kept and log_perplexity."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    measured = scored(slim, fit(slim, shard=shard)).checkpoint()
    out, verdict = kept(measured, bands(measured, low=low, high=high))
    names = [f.split()[0] for f in BASE.split(", ")]
    return out.select("doc_id", *[F.col(f"_q.{n}").alias(n) for n in names], base_failed().alias("base_failed"), F.col(verdict).alias("kept"), F.col("_q.log_perplexity").alias("log_perplexity"))


def passing(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", low: float = LOW, high: float = HIGH, shard: int = SHARD) -> DataFrame:
    """The rows of ``docs`` that are kept. Rejected texts are known by a 64-bit hash of text and language; only
    rows that may be among them are shuffled."""
    key = unused(docs, "_key")
    hashed = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.col(lang_col).cast("string"), F.lit("")), F.col(lang_col).isNull())
    slim = docs.select(hashed.alias("key"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    measured = scored(slim, fit(slim, shard=shard)).checkpoint()
    out, verdict = kept(measured, bands(measured, low=low, high=high))
    gone = out.where(~F.col(verdict)).select("key").distinct().checkpoint()
    return jaccard.without(docs.withColumn(key, hashed), gone, key).drop(key)
