"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from somatica.llm.common import slices, whole_rows

UNDETERMINED = "und"
#: More distinct labels than this are refused: it bounds the model (buckets x languages floats, 52 MB) and what the driver gets.
MAX_LANGUAGES = 200
#: Bytes of text that become grams at once; each takes about 150 bytes of memory.
_SLICE = 250_000


@dataclass
class LanguageModel:
    """``logp``: buckets x languages, float32; ``prior``: log shares of the languages."""

    languages: list[str]
    logp: np.ndarray
    prior: np.ndarray
    orders: tuple[int, ...]


def gram_buckets(texts: list[str], orders: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all character n-grams of the lower-cased texts, and where each text's begin.

    Runs of characters that are not letters count as one blank, and each text has a blank at both ends. The code
    points of all texts are hashed together; grams that reach over the end of a text are left out.
    """
    points, sizes = [], []
    for t in texts:
        p = np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = (p >= 192) | ((p >= 97) & (p <= 122))
        p = np.where(letter, p, 32).astype(np.uint32)
        keep = letter.copy()
        if len(p):
            keep[1:] |= letter[:-1]
        p = np.concatenate(([np.uint32(32)], p[keep], [np.uint32(32)]))
        points.append(p)
        sizes.append(len(p))
    if not points:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    p = np.concatenate(points).astype(np.uint64)
    sizes = np.array(sizes)
    ends = np.cumsum(sizes)
    left = np.repeat(ends, sizes) - np.arange(len(p))  # characters up to the end of the text
    shift = np.uint64(64 - int(buckets).bit_length() + 1)
    found = np.full((len(p), len(orders)), -1, np.int64)
    h = np.zeros(len(p), np.uint64)
    for n in range(1, max(orders) + 1):
        h[: len(p) - n + 1] = h[: len(p) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + p[n - 1 :] + np.uint64(1)
        if n in orders:
            mixed = ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> shift
            found[:, orders.index(n)] = np.where(left >= n, mixed.astype(np.int64), -1)
    return found, ends - sizes


def _counts(orders: tuple[int, ...], buckets: int):
    """(number of the language, text) to counts of cells, ``language * buckets + bucket``."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, j, texts in slices(batch.column(1), _SLICE):
                langs = batch.column(0).slice(i, j - i).to_numpy()
                for lang in np.unique(langs).tolist():
                    grams, _ = gram_buckets([texts[k] for k in np.flatnonzero(langs == lang)], orders, buckets)
                    total[lang] = total.get(lang, 0) + np.bincount(grams[grams >= 0], minlength=buckets)
        for lang, c in total.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(at + lang * buckets), pa.array(c[at])], ["cell", "n"])

    return run


def _sample(labelled: DataFrame, most: int) -> tuple[DataFrame, dict[str, int]]:
    """Different texts of each language, about ``most`` in all, and the languages' numbers of rows.

    Copies of a text count once, so no group of copies can fill the sample. Of a language with more texts than its even
    share, those with the smallest hashes stay: reruns agree.
    """
    rows = labelled.where("text is not null and lang is not null").select("lang", "text", F.xxhash64("text", F.lit(3)).alias("h"))
    texts = rows.groupBy("lang", "h").agg(F.count(F.lit(1)).alias("n"))
    found = texts.groupBy("lang").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("texts")).limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not found:
        return rows.select("lang", "text"), {}
    share = most / len(found)
    limits = F.create_map(*[F.lit(x) for r in found for x in (r["lang"], int(min(1.0, share / r["texts"]) * (1 << 32)))])
    chosen = rows.where(F.pmod("h", F.lit(1 << 32)) < limits[F.col("lang")])
    return chosen.dropDuplicates(["lang", "h"]).select("lang", "text"), {r["lang"]: r["rows"] for r in found}


def train(labelled: DataFrame, orders: tuple[int, ...] = (1, 2, 3), buckets: int = 1 << 16, max_docs: int = 40_000, smoothing: float = 0.5) -> LanguageModel | None:
    """Fit on ``labelled`` (text, lang); rows with a null in either are ignored. None if no row is left.

    At most about ``max_docs`` different texts are counted, shared evenly by the languages (``_sample``); priors are the shares
    of all rows. The counts are summed in Spark; the driver receives one number per language and non-empty bucket,
    ``len(languages) * buckets`` at most. Over ``MAX_LANGUAGES`` different labels raise ValueError: such a column does not
    hold languages.
    """
    sample, docs = _sample(labelled, max_docs)
    if not docs:
        return None
    languages = sorted(docs)
    number = F.create_map(*[F.lit(x) for i, lang in enumerate(languages) for x in (lang, i)])
    counted = sample.select(number[F.col("lang")].alias("lang"), "text").mapInArrow(_counts(orders, buckets), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(len(languages) * buckets)
    n[counted["cell"].to_numpy()] = counted["n"].to_numpy()
    n = n.reshape(len(languages), buckets).T
    logp = np.log(n + smoothing) - np.log(n.sum(axis=0) + smoothing * buckets)
    prior = np.log(np.array([docs[x] for x in languages]) / sum(docs.values()))
    return LanguageModel(languages, logp.astype(np.float32), prior, orders)


def predict_batch(texts: list[str | None], model: LanguageModel) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Language and posterior probability of each text, the mean log-probability of its grams in that language, and their number."""
    lang, score, fit, size = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    at = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
    if not at:
        return lang, score, fit, size
    grams, starts = gram_buckets([texts[j] for j in at], model.orders, len(model.logp))
    told, count = np.zeros((len(at), len(model.languages))), np.zeros(len(at), np.int64)
    for g in grams.T:
        rows = model.logp[g]
        rows[g < 0] = 0
        told += np.add.reduceat(rows, starts, axis=0, dtype=np.float64)
        count += np.add.reduceat(g >= 0, starts, dtype=np.int64)
    weight = told + model.prior
    best = weight.argmax(axis=1)
    score[at] = 1 / np.exp(weight - weight.max(axis=1, keepdims=True)).sum(axis=1)
    fit[at], size[at] = told[np.arange(len(at)), best] / count, count
    for j, b in zip(at, best.tolist(), strict=True):
        lang[j] = model.languages[b]
    return lang, score, fit, size


def _predicted(spark, model: LanguageModel):
    """Column of texts to a struct of what ``predict_batch`` finds; the model is broadcast."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred string, score double, fit double, grams long>")
    def predict(texts: pa.Array) -> pa.Array:
        parts = [predict_batch(values, shared.value) for _, _, values in slices(texts, _SLICE)]
        lang = [x for p in parts for x in p[0]]
        rest = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in (1, 2, 3)]
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(rest[0]), pa.array(rest[1]), pa.array(rest[2].astype(np.int64))], ["lang_pred", "score", "fit", "grams"])

    return predict


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """Add ``lang_pred`` and ``score`` to ``docs``, found from the column ``text``; all others are passed on.

    A text that is null or has no letter gets ``und`` and score 0, and so does every text where there is no model.
    The model (buckets x languages floats, bounded by ``MAX_LANGUAGES``) is broadcast. Equal weights go to the first language
    in order. Existing columns of these names are replaced, other names do not matter. An empty table gives no rows.
    """
    docs = docs.drop("lang_pred", "score")
    if model is None:
        return docs.withColumns({"lang_pred": F.lit(UNDETERMINED), "score": F.lit(0.0)})
    predict = _predicted(docs.sparkSession, model)
    return whole_rows(docs).withColumn("p", predict(F.col("row.text"))).select("row.*", "p.lang_pred", "p.score")


def held_out(doc_id: str = "doc_id"):
    """True for the fold that training never sees; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def held_out_language(docs: DataFrame, **training) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; the model sees only the other fold's labels.

    Null and letterless texts are ``und`` with score 0, and so are all where no label is known. Repeated rows and null ids
    (which count as held out) come back as they came; other columns are ignored; an empty table gives no rows.
    """
    model = train(docs.where(~held_out()).select("text", "lang"), **training)
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def shuffled(text: str) -> str:
    """The characters of a text in an order that depends on nothing but the text."""
    return "".join(np.random.default_rng(zlib.crc32(text.encode("utf-8", "surrogatepass"))).permutation(list(text)))


def _fits(spark, model: LanguageModel):
    """Column of texts to mean log-probability and number of their grams, as they are and shuffled."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<fit double, grams long, shuffled_fit double, shuffled_grams long>")
    def fits(texts: pa.Array) -> pa.Array:
        parts = []
        for _, _, values in slices(texts, _SLICE):
            parts.append([*predict_batch(values, shared.value)[2:], *predict_batch([t and shuffled(t) for t in values], shared.value)[2:]])
        both = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in range(4)]
        return pa.StructArray.from_arrays([pa.array(x.astype(np.int64) if k % 2 else x) for k, x in enumerate(both)], ["fit", "grams", "shuffled_fit", "shuffled_grams"])

    return fits


def usual_fit(labelled: DataFrame, model: LanguageModel, max_docs: int = 4_000) -> list[float]:
    """For each language of the model, the least mean log-probability of a gram that still looks like it.

    It lies half-way between the mean over different labelled texts (about ``max_docs`` in all, as in ``train``) and the mean
    over the same texts with their characters shuffled: texts that have the language's letters, but not its order. Both are
    found by one function, so that a task needs one Python worker.
    """
    sample, _ = _sample(labelled, max_docs)
    scored = sample.select("lang", _fits(labelled.sparkSession, model)(F.col("text")).alias("p"))
    weighed = [(F.sum(F.col(f"p.{x}fit") * F.col(f"p.{x}grams")) / F.nullif(F.sum(f"p.{x}grams"), F.lit(0))).alias(f"{x}fit") for x in ("", "shuffled_")]
    fit = {r["lang"]: (r["fit"], r["shuffled_fit"]) for r in scored.groupBy("lang").agg(*weighed).collect()}
    return [sum(fit[x]) / 2 if None not in fit.get(x, (None,)) else -np.inf for x in model.languages]


def accepted(docs: DataFrame, least: float = 0.5, spread: float = 12.0, **training) -> DataFrame:
    """The documents whose language is recognised, all columns as given.

    Rejects null texts, texts without letters, texts whose best language has a posterior under ``least``, and texts whose
    grams fit even that language worse than ``usual_fit``, less an allowance of ``spread / sqrt(grams)`` for short texts: noise, or
    languages that were not learned. Where no label is known nothing is recognised. Repeated rows and null ids stay as
    they came; names of other columns do not matter; an empty table gives no rows.
    """
    labelled = docs.where(~held_out()).select("text", "lang")
    model = train(labelled, **training)
    if model is None:
        return docs.where("false")
    limits = dict(zip(model.languages, usual_fit(labelled, model), strict=True))
    limit = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])
    found = whole_rows(docs).withColumn("p", _predicted(docs.sparkSession, model)(F.col("row.text")))
    fits = F.col("p.fit") >= limit[F.col("p.lang_pred")] - spread / F.sqrt(F.greatest("p.grams", F.lit(1)))
    return found.where((F.col("p.lang_pred") != UNDETERMINED) & (F.col("p.score") >= least) & fits).select("row.*")
