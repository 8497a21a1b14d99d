"""Toxicity: gradient-boosted trees over a few dense features of whole texts, calibrated by isotonic regression."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from somatica.llm.common import materialise, slices

# Words of abuse, in the languages of the corpus.
ABUSE = frozenset("""
idiot idiots idiotic moron morons moronic imbecile imbeciles stupid stupidity dumb dumbass dunce fool fools foolish clown clowns loser losers
trash garbage filth filthy scum scumbag scumbags vermin worthless pathetic disgusting disgrace despicable repulsive revolting vile ugly useless
hopeless brainless braindead clueless ignorant jerk jerks creep creeps freak freaks coward cowards liar liars lowlife degenerate parasite parasites
bastard bastards bitch bitches asshole assholes fuck fucking fucker shit shitty crap crappy bullshit cunt slut whore retard retarded
dummkopf blödmann blöd idioten dumm arschloch scheiße scheisse abschaum versager trottel miststück ekelhaft widerlich erbärmlich wertlos nutzlos
imbécile crétin crétins débile connard connards connasse salaud merde stupide ordure ordures raclure minable pathétique dégoûtant
idiota idiotas estúpido estúpida imbécil imbéciles tonto tonta basura escoria inútil asqueroso asquerosa patético patética mierda cabrón payaso
""".split())
# Words that speak to the reader.
SECOND_PERSON = frozenset("you your yours yourself yourselves ur u youre du dich dir dein deine deinen deiner ihr euch tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
# Signs that stand for letters.
LOOKALIKES = str.maketrans("013457@$!|", "oieastasil")

FEATURES = (
    "abuse_per_100", "abuse_kinds", "learned_per_100", "learned_most", "learned_sum", "near_second_person", "second_person_per_100", "obfuscated_per_100", "disguised_abuse",
    "capital_share", "shouted_words", "exclamations", "questions", "marks_per_word", "stretched_words", "repetition", "log_words",
)
#: Words to either side of an abusive one in which the second person counts as near.
NEAR = 5

_ASCII = bytes(32 if chr(k) in " \t\n\r\x0b\x0c!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~0123456789" else k for k in range(256))
_MARKS = np.array([chr(k) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" for k in range(256)])
_OBFUSCATED = re.compile(r"(?<![^\W_])(?:[0-9@$!|][^\W\d_]|[^\W\d_]++[0-9@$!|*._-])(?:[0-9@$!|*._-]{0,3}[^\W\d_]){1,14}(?![^\W_])")
_SPELLED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .*_-]{1,2}){3,14}[^\W\d_](?![^\W_])")


def _vocabulary(words) -> frozenset[bytes]:
    return frozenset(w.encode() for w in words)


def _plain_forms(shown: str) -> set[str]:
    """What a disguised word may stand for: signs as letters, or left out; letters repeated over twice once."""
    forms = {shown.translate(LOOKALIKES), shown}
    return {re.sub(r"(.)\1{2,}", r"\1", re.sub(r"[\W\d_]", "", f)) for f in forms}


def _stretched(codes: np.ndarray) -> int:
    """Places where a letter a-z stands for the fourth time in a row."""
    same = codes[1:] == codes[:-1]
    return int((same[2:] & same[1:-1] & same[:-2] & (codes[3:] >= 97) & (codes[3:] <= 122)).sum()) if len(codes) > 3 else 0


def features(text: str | None, abuse: frozenset[bytes], learned: dict[bytes, float], spoken: frozenset[bytes]) -> list[float]:
    """Values of ``FEATURES`` for a whole text; an empty one has zeros throughout. ``learned``: words and their weights."""
    if not text:
        return [0.0] * len(FEATURES)
    raw = text.encode("utf-8", "surrogatepass")
    low = text.lower()
    flat = low.encode("utf-8", "surrogatepass")
    words = flat.translate(_ASCII).split()
    n = max(len(words), 1)
    kinds = set(words)
    own = {w: learned[w] for w in kinds & learned.keys()}
    found = kinds & abuse
    bad = [i for i, w in enumerate(words) if w in found] if found else []
    told = [i for i, w in enumerate(words) if w in own] if own else []
    near = sum(any(w in spoken for w in words[max(0, i - NEAR) : i + NEAR + 1]) for i in {*bad, *told})
    you = sum(map(words.count, kinds & spoken))
    disguised = [m.group() for p in (_OBFUSCATED, _SPELLED) for m in p.finditer(low)]
    hidden = sum(any(f.encode() in abuse or f.encode() in learned for f in _plain_forms(m)) for m in disguised)
    codes = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower = codes[65:91].sum(), codes[97:123].sum()
    shouted = sum(len(w) > 2 and w.isupper() for w in raw.translate(_ASCII).split()) if upper > 0.02 * (upper + lower) else 0
    return [
        100.0 * len(bad) / n, float(len(found)), 100.0 * len(told) / n, max(own.values(), default=0.0), sum(own.values()), 100.0 * near / n, 100.0 * you / n, 100.0 * len(disguised) / n, float(hidden),
        upper / max(upper + lower, 1), shouted / n, 100.0 * codes[33] / n, 100.0 * codes[63] / n, codes[_MARKS].sum() / n, 100.0 * _stretched(np.frombuffer(flat, np.uint8)) / n, 1 - len(kinds) / n, float(np.log1p(len(words))),
    ]


@dataclass
class ToxicityModel:
    """``learned``: words of toxic texts and their log-odds. Without both kinds of labels there are no trees, and ``rate`` is every score."""

    learned: dict[str, float]
    trees: Model | None
    steps: Model | None
    rate: float


def with_features(docs: DataFrame, learned: dict[str, float]) -> DataFrame:
    """``docs`` (column text) with ``features``, an array of doubles. One pass over whole texts, about a megabyte at a time."""
    abuse, own, spoken = _vocabulary(ABUSE), {w.encode(): v for w, v in learned.items()}, _vocabulary(SECOND_PERSON)

    @F.arrow_udf("array<double>")
    def measure(texts: pa.Array) -> pa.Array:
        flat = [np.array([features(t, abuse, own, spoken) for t in values], float).ravel() for _, _, values in slices(texts)]
        values = np.concatenate(flat) if flat else np.zeros(0)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, len(FEATURES)), pa.int32()), pa.array(values))

    return docs.withColumn("features", measure(F.col("text")))


def labelled_sample(docs: DataFrame, labels: DataFrame, max_docs: int) -> DataFrame:
    """text, toxic (0 or 1) and part (0 to 3) of about ``max_docs`` labelled documents, or of all if there are fewer; copies of a text
    are one, with the larger label.

    Rows of ``labels`` without toxic do not count; of contradicting ones the majority counts, and a tie is toxic. Documents are chosen by the
    hash of their id, texts dealt to parts by theirs. The chosen ids, 16 bytes each, are sent to the tasks that read the documents, so
    no text but theirs is moved.
    """
    sure = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    sure = materialise(sure, "labels")
    share = min(1.0, max_docs / max(sure.count(), 1))
    chosen = sure.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) < share * 1_000_000)
    joined = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    joined = joined.groupBy(F.xxhash64("text").alias("key")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
    return joined.select("text", "toxic", F.pmod(F.xxhash64("key", F.lit("part")), F.lit(4)).alias("part"))


def learned_words(sample: DataFrame, least_gain: float = 6.0, most: int = 5_000) -> dict[str, float]:
    """Words that stand in toxic texts more than others do, with their smoothed log-odds over the sample's own.

    Of k toxic texts among the n with a word, at a share r of toxic texts in all, the gain is the log-likelihood ratio
    k log(k / nr) + (n - k) log((n - k) / n(1 - r)); words with ``least_gain`` or more count, ``most`` of them at most.
    """
    rate = sample.agg(F.avg("toxic")).first()[0] or 0.0
    if not 0 < rate < 1:
        return {}
    words = sample.select("toxic", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))).alias("word")).where("length(word) > 2")
    told = words.groupBy("word").agg(F.sum("toxic").alias("k"), F.count(F.lit(1)).alias("n")).where(F.col("k") > rate * F.col("n"))
    clean = F.col("n") - F.col("k")
    gain = F.col("k") * F.ln(F.col("k") / (F.col("n") * rate)) + F.when(clean > 0, clean * F.ln(clean / (F.col("n") * (1 - rate)))).otherwise(0.0)
    odds = F.ln((F.col("k") + 0.5) / (clean + 0.5)) - float(np.log(rate / (1 - rate)))
    best = told.select("word", odds.alias("odds"), gain.alias("gain")).where((F.col("gain") >= least_gain) & (F.col("odds") > 0)).orderBy(F.desc("gain"), "word").limit(most)
    return {r["word"]: r["odds"] for r in best.collect()}


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = 40_000, rounds: int = 12, depth: int = 3, seed: int = 13) -> ToxicityModel:
    """Model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic), over about ``max_docs`` labelled documents.

    Half of them show which words are abusive, a quarter grows the trees, a quarter calibrates them. Only the texts of the
    sample are read again; the driver gets counts, at most 5,000 words and the trees.
    """
    sample = materialise(labelled_sample(docs, labels, max_docs), "toxicity-sample")
    kinds = {(r["part"], r["toxic"]): r["count"] for r in sample.groupBy("part", "toxic").count().collect()}
    rate = sum(v for (_, t), v in kinds.items() if t) / max(sum(kinds.values()), 1)
    if not all(kinds.get((part, t)) for part in (2, 3) for t in (0, 1)):
        return ToxicityModel({}, None, None, rate)
    learned = learned_words(sample.where("part < 2"))
    rows = with_features(sample.where("part >= 2"), learned).select("part", F.col("toxic").cast("double").alias("label"), "features")
    rows = materialise(rows, "toxicity-features").withColumn("features", array_to_vector("features")).coalesce(4)
    trees = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.3, minInstancesPerNode=5, seed=seed).fit(rows.where("part = 2"))
    margins = trees.transform(rows.where("part = 3")).select("label", vector_to_array("probability")[1].alias("margin"))
    return ToxicityModel(learned, trees, IsotonicRegression(featuresCol="margin").fit(margins), rate)


def scored(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` (doc_id, text and others) with ``score``, 0 to 1: how likely a text is labelled toxic. Null texts count as empty ones."""
    if model.trees is None or model.steps is None:
        return docs.withColumn("score", F.lit(float(model.rate)))
    d = with_features(docs.select(F.struct(*docs.columns).alias("row"), F.col("text")), model.learned).select("row", array_to_vector("features").alias("features"))
    d = model.trees.transform(d).select("row", vector_to_array("probability")[1].alias("margin"))
    d = model.steps.transform(d).select("row.*", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prediction"))).alias("score"))
    return d


def held_out_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **how) -> DataFrame:
    """doc_id, held_out (CRC-32 of doc_id mod 4 is 2), score and predicted (1 from ``threshold`` on) of every document.

    Held-out documents are never learned from. Rows with a null doc_id are not held out and have no label. Empty and null texts get the
    score of a text without any feature. Repeated rows come back as often as they came, with the same score; an empty
    table gives no rows; other columns are ignored.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = fit(docs.where(~held).select("doc_id", "text"), labels.where(~held), **how)
    return scored(docs.select("doc_id", held.alias("held_out"), "text"), model).select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
