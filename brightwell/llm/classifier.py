"""Quality classifier: perplexity under an n-gram model of trusted text.

The model is an interpolated modified Kneser-Ney one over the bytes of UTF-8, so no script is
outside its alphabet, trained on a bounded sample of the documents that the labels trust: of every
other one by its id's hash, train_docs documents in the order of the hashes, of train_bytes in all;
of a text of more than train_bytes / 64 characters its beginning. Counts, continuation counts,
context totals and probabilities are DataFrames, dealt by n-gram and joined order by order; the
driver sees the counts of counts alone. Each shard of the result is a file of sorted arrays in the
shared folder. Scoring reads each document once: the distinct n-grams of a batch are joined with
each shard in turn, since moving the n-grams of all documents would take many times their size.
The summed log probabilities give each document's perplexity a byte, and the most of any WINDOW
bytes on end the perplexity of its worst passage, in which a few bad words are not lost. A document
is kept where both are within its language's thresholds: quantiles over all trusted documents that
the model was not trained on.

Defined cases: a null or empty text has no perplexity and is rejected; a text shorter than WINDOW
is its own worst passage; a null language counts as the empty string; languages of fewer than
min_rows trusted documents take the quantile of all; without any trusted text nothing has a
threshold and all texts are kept; labels that repeat an id trust it if any does; rows that repeat
are each judged; an empty table gives an empty table; a very long text is scored whole, in arrays
of its length. Other columns are kept whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightwell.llm.elias_fano import stored
from brightwell.llm.lm import _map, tally
from brightwell.llm.shared import drop_path, lean, pieces, put_file, shared_path, small_batches, written

_U = np.uint64
ORDER, BITS = 5, 8
SYMBOLS = 1 << BITS
#: Stands before a text's first byte.
START = 0
#: Bytes of the passages whose perplexity counts beside the whole text's.
WINDOW = 48
N_SHARDS = 8
SCORED = "doc_id long, text_hash long, lang string, n_symbols long, perplexity double, worst double"


def symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """n-gram keys ending at each byte, and where each text's begin."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    starts = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    coded = np.frombuffer(data, np.uint8)[starts[0] : starts[-1]].astype(_U) if data is not None else np.zeros(0, _U)
    starts = starts - starts[0]
    keys, place = np.zeros(len(coded), _U), np.arange(len(coded)) - np.repeat(starts[:-1], np.diff(starts))
    for back in range(ORDER):
        moved = np.concatenate((np.zeros(min(back, len(coded)), _U), coded[: max(0, len(coded) - back)]))
        keys |= np.where(place >= back, moved, _U(START)) << _U(BITS * back)
    return keys, starts


def _discounts(counts: dict[int, int]) -> tuple[float, float, float]:
    """D1, D2 and D3+ from the counts of counts."""
    n = [counts.get(i, 0) for i in (1, 2, 3, 4)]
    if not all(n[:3]):
        return 0.5, 0.5, 0.5
    y = n[0] / (n[0] + 2 * n[1])
    found = (1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2])
    return tuple(min(max(d, 0.05), i - 0.05) for i, d in zip((1, 2, 3), found))


def kneser_ney(grams: DataFrame) -> tuple[DataFrame, list[str]]:
    """(n, gram, p, weight) of every n-gram, and of every context, with p null, the share that it leaves to the order below.

    grams: (gram, n) of the highest order with their counts. Also where the result is written.
    """
    tables = [grams.select("gram", F.col("n").alias("c"))]
    for n in range(ORDER - 1, 0, -1):  # continuation counts: distinct left extensions
        tables.insert(0, tables[0].select(F.col("gram").bitwiseAND((1 << BITS * n) - 1).alias("gram")).groupBy("gram").agg(F.count("*").alias("c")))
    below, found, paths = None, [], []
    for n, table in enumerate(tables, 1):
        table, at = written(table, "classifier-counts")
        d1, d2, d3 = _discounts({r["c"]: r["k"] for r in table.where("c <= 4").groupBy("c").agg(F.count("*").alias("k")).collect()})
        taken = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        table = table.select("gram", "c", taken.alias("taken"), F.shiftright("gram", BITS).alias("context"), F.col("gram").bitwiseAND((1 << BITS * (n - 1)) - 1).alias("low"))
        contexts = table.groupBy("context").agg(F.sum("c").alias("total"), F.sum("taken").alias("left")).select("context", "total", (F.col("left") / F.col("total")).alias("weight"))
        joined = table.join(contexts, "context")
        if n == 1:
            joined = joined.withColumn("lower", F.lit(1 / SYMBOLS))
        else:
            joined = joined.join(below.select(F.col("gram").alias("low"), F.col("p").alias("lower")), "low")
        below, more = written(joined.select("gram", ((F.col("c") - F.col("taken")) / F.col("total") + F.col("weight") * F.col("lower")).alias("p")), "classifier-model")
        held, more_2 = written(contexts.select("context", "weight"), "classifier-model")
        paths += [at, more, more_2]
        found += [below.select(F.lit(n).alias("n"), "gram", "p", F.lit(None).cast("double").alias("weight")), held.select(F.lit(n).alias("n"), F.col("context").alias("gram"), F.lit(None).cast("double").alias("p"), "weight")]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out, paths


def _shard(context: np.ndarray, n: int) -> np.ndarray:
    return ((context * _U(0x9E3779B97F4A7C15)) >> _U(40)).astype(np.int64) % n


def _with_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of an order above one with the shard of their context."""
    for batch in batches:
        gram = batch.column(1).to_numpy().view(_U)
        context = np.where(batch.column(2).is_valid().to_numpy(zero_copy_only=False), gram >> _U(BITS), gram)
        yield pa.RecordBatch.from_arrays([pa.array(_shard(context, N_SHARDS), pa.int64()), *batch.columns], names=["shard", *batch.schema.names])


def _write_shards(folder: str):
    """Of each shard, for every order above one: keys and logs of its n-grams, contexts and logs of their weights, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None  # a part of what train_bytes bounds
        for s in range(N_SHARDS) if table is not None else ():
            own = table.filter(pc.equal(table["shard"], s))
            if not own.num_rows:
                continue
            n, gram, p, weight = (own[c].to_numpy() for c in ("n", "gram", "p", "weight"))
            parts = []
            for order in range(2, ORDER + 1):
                for value in (p, weight):
                    at = np.flatnonzero((n == order) & ~np.isnan(value))
                    at = at[np.argsort(gram[at].view(_U))]
                    parts += [np.array([len(at)], _U), gram[at].view(_U), np.log(value[at])]
            put_file(folder, f"kn-{s}", stored(parts))
            yield pa.RecordBatch.from_arrays([pa.array([s])], names=["shard"])

    return run


class Model:
    """Logs of single symbols' probabilities, and the shards of the orders above, read when they are first asked for."""

    def __init__(self, single: np.ndarray, folder: str, shards: list[int]):
        self.single, self.folder, self.shards, self.held = single, folder, shards, None

    def __getstate__(self):
        return self.__dict__ | {"held": None}

    def orders(self) -> dict[int, list[list[np.ndarray]]]:
        if self.held is None:
            self.held = {}
            for s in self.shards:
                data, at, arrays = _map(self.folder, f"kn-{s}"), 0, []
                for _ in range(2 * (ORDER - 1)):
                    size = 8 * int(data[at : at + 8].view(_U)[0])
                    at += 8
                    arrays += [data[at : at + size].view(_U), data[at + size : at + 2 * size].view(np.float64)]
                    at += 2 * size
                self.held[s] = [arrays[i : i + 4] for i in range(0, len(arrays), 4)]
        return self.held

    def logs(self, keys: np.ndarray) -> np.ndarray:
        """Natural log probability of each distinct key: joined with every shard, order by order."""
        out, open_ = np.zeros(len(keys)), np.arange(len(keys))
        for n in range(ORDER, 1, -1):
            low = keys[open_] & _U((1 << BITS * n) - 1)
            context = low >> _U(BITS)
            shard = _shard(context, N_SHARDS)
            found = np.zeros(len(low), bool)
            for s, held in self.orders().items():
                grams, logs, contexts, weights = held[n - 2]
                own = np.flatnonzero(shard == s)
                at, hit = _find(low[own], grams)
                out[open_[own[hit]]] += logs[at[hit]]
                found[own[hit]] = True
                rest = own[~hit]
                at, hit = _find(context[rest], contexts)
                out[open_[rest[hit]]] += weights[at[hit]]
            open_ = open_[~found]
        out[open_] += self.single[(keys[open_] & _U(SYMBOLS - 1)).astype(np.int64)]
        return out


def _find(keys: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, counts = [], []
    for whole in batches:
        for batch in pieces(whole, 0, 1 << 20):
            k, c = np.unique(symbols(batch.column(0))[0], return_counts=True)
            keys.append(k)
            counts.append(c.astype(_U))
            if len(keys) > 8:
                k, c = tally(keys, counts)
                keys, counts = [k], [c]
    k, c = tally(keys, counts)
    yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(c.astype(np.int64))], names=["gram", "n"])


def train(texts: DataFrame) -> tuple[Model, list[str]]:
    """The model of the one column of texts, of bounded size, and where its parts are written."""
    counted = texts.repartition(8).mapInArrow(lean(_count_grams), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    rows, paths = kneser_ney(counted)
    first = {r["gram"]: r["p"] for r in rows.where("n = 1 and p is not null").collect()}  # SYMBOLS rows at most
    rest = [r["weight"] for r in rows.where("n = 1 and weight is not null").collect()]
    single = np.full(SYMBOLS, (rest[0] if rest else 1.0) / SYMBOLS)
    for gram, p in first.items():
        single[gram] = p
    folder = shared_path(texts.sparkSession, "classifier-shards")
    dealt = rows.where("n > 1").mapInArrow(lean(_with_shard), "shard long, n int, gram long, p double, weight double").repartition(N_SHARDS, "shard")
    shards = sorted(r["shard"] for r in dealt.mapInArrow(lean(_write_shards(folder)), "shard long").collect())
    for at in paths:
        drop_path(texts.sparkSession, at)
    return Model(np.log(single), folder, shards), [folder]


def _scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 0, 1 << 20):
                keys, starts = symbols(batch.column(0))
                n = np.diff(starts)
                some = np.flatnonzero(n)
                perplexity, worst = np.full(len(n), np.nan), np.full(len(n), np.nan)
                if len(some):
                    unique, back = np.unique(keys, return_inverse=True)
                    cost = -model.logs(unique)[back]
                    mean = np.add.reduceat(cost, starts[:-1][some]) / n[some]
                    perplexity[some] = np.exp(mean)
                    worst[some] = np.exp(np.maximum(_worst(cost, starts, some), mean))
                arrays = [batch.column(1), batch.column(2), batch.column(3), pa.array(n), pa.array(perplexity, mask=n == 0), pa.array(worst, mask=n == 0)]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text_hash", "lang", "n_symbols", "perplexity", "worst"])

    return run


def _worst(cost: np.ndarray, starts: np.ndarray, some: np.ndarray) -> np.ndarray:
    """The greatest mean cost of WINDOW bytes on end within each of the texts that are not empty; of a shorter text -inf."""
    total = np.concatenate(([0.0], np.cumsum(cost)))
    mean = np.full(len(cost), -np.inf)
    if len(cost) >= WINDOW:
        mean[: len(cost) - WINDOW + 1] = (total[WINDOW:] - total[:-WINDOW]) / WINDOW
    place = np.arange(len(cost)) - np.repeat(starts[:-1], np.diff(starts))
    mean[place > np.repeat(np.diff(starts), np.diff(starts)) - WINDOW] = -np.inf  # these reach into the next text
    return np.maximum.reduceat(mean, starts[:-1][some])


def _rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(text.alias("words"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("")).alias("lang"))


def judge(docs: DataFrame, labels: DataFrame, train_docs: int = 4000, train_bytes: int = 16 << 20, quantile: float = 0.985, worst_quantile: float = 0.97, min_rows: int = 50, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, text_hash, lang, n_symbols, perplexity, worst, threshold, worst_threshold, kept) of every row of docs.

    labels has doc_id, quality (1: trusted) and toxic (1: not trusted after all).
    """
    small_batches(docs.sparkSession)
    rows = _rows(docs, id_col, text_col, lang_col)
    trusted = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False)) & ~F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("good")).where("good").select("doc_id")
    first = trusted.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)  # at most train_docs ids
    part = F.substring("words", 1, max(1, train_bytes // 64))  # a sixteenth of train_bytes at most, so no long text ends the sample early
    sample = rows.join(F.broadcast(first), "doc_id").select("doc_id", part.alias("words")).withColumn("bytes", F.octet_length("words"))
    upto = F.sum("bytes").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("words")).rowsBetween(Window.unboundedPreceding, 0))
    sample, _ = written(sample.withColumn("upto", upto).where(F.col("upto") <= train_bytes).select("doc_id", "words"), "classifier-sample")  # bounded by both limits
    model, paths = train(sample.select("words"))
    scored, _ = written(rows.mapInArrow(lean(_scorer(model)), SCORED), "classifier-scores")
    for at in paths:
        drop_path(docs.sparkSession, at)
    used = sample.select("doc_id").distinct()
    held = scored.where("perplexity is not null").join(trusted, "doc_id", "left_semi").join(F.broadcast(used), "doc_id", "left_anti")
    limits = [F.percentile_approx(c, q, 10_000).alias(f"{c}_limit") for c, q in (("perplexity", quantile), ("worst", worst_quantile))]
    by_lang = held.groupBy("lang").agg(F.count("*").alias("n"), *limits).where(F.col("n") >= min_rows).drop("n")
    overall = held.agg(*limits).select(F.struct("perplexity_limit", "worst_limit").alias("overall"))
    out = scored.join(by_lang, "lang", "left").crossJoin(F.broadcast(overall))  # one row
    for c, name in (("perplexity", "threshold"), ("worst", "worst_threshold")):
        out = out.withColumn(name, F.coalesce(f"{c}_limit", f"overall.{c}_limit"))
    within: Column = F.coalesce((F.col("perplexity") <= F.col("threshold")) & (F.col("worst") <= F.col("worst_threshold")), F.lit(True))
    return out.select("doc_id", "text_hash", "lang", "n_symbols", "perplexity", "worst", "threshold", "worst_threshold", (F.col("perplexity").isNotNull() & within).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """The rows of docs that judge keeps, with the columns of docs."""
    good = judge(docs, labels, id_col=id_col, text_col=text_col, lang_col=lang_col, **options).where("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash"))
    own_hash = F.xxhash64(docs[f"`{text_col}`"].cast("string"))
    return docs.join(good, docs[f"`{id_col}`"].cast("long").eqNullSafe(good["kept_id"]) & (own_hash == good["kept_hash"]), "left_semi")
