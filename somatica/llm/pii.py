"""Personal data: pattern spans, and terms that the corpus shows to disclose a protected entity.

DataFrame functions only: patterns, positions and check digits are worked out in Spark expressions.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from somatica.llm.common import KeyFilter, columns, materialise, whole_rows

KINDS = ("email", "ip", "card", "phone")

#: Same matches as the plain patterns, scanning left to right without overlap, but with possessive loops and with looks
#: behind that skip starts which cannot succeed. The card pattern already leaves out runs of fewer than 12 or over 19 digits.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda s, x: s + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def _holds(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) < 3) | ((F.length(F.ltrim(p, F.lit("0"))) == 3) & (F.ltrim(p, F.lit("0")) <= "255")))
    if kind == "card":
        return luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


_SPAN = "struct<start:int,rank:int,end:int,kind:string,value:string>"
_SIGNS = {"email": "@", "ip": ".", "phone": "+"}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often it is used (also inside of lambdas)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, largest: bool = False) -> Column:
    """For each number of an array the sum (or the largest) of those before it, from 0 on.

    In blocks of about the root of the length: appending to an array copies it, which for one long array would be quadratic.
    """
    add = (lambda a, b: F.greatest(a, b)) if largest else (lambda a, b: a + b)

    def grown(block: Column, start: Column) -> Column:
        empty = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(block, empty, lambda s, v: F.struct(add(s["at"], v).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])

    def in_blocks(v: Column) -> Column:
        side = F.ceil(F.sqrt(F.size(v))).cast("int")
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / side).cast("int")), lambda k: F.slice(v, k * side + 1, side))
        whole = lambda block: F.aggregate(block, F.lit(0), add)
        return let(cut, lambda blocks: F.flatten(F.zip_with(blocks, grown(F.transform(blocks, whole), F.lit(0)), grown)))

    return let(values, lambda v: F.when(F.size(v) > 0, in_blocks(v)).otherwise(F.array().cast("array<int>")))


def ranks(values: Column, marks: Column, ties: bool) -> Column:
    """For each number of ``values`` how many of ``marks`` are smaller (with ``ties``: or equal). One sort, whatever the lengths."""
    own, other = (1, 0) if ties else (0, 1)
    one = lambda v, side, k: F.struct(v.alias("at"), F.lit(side).alias("side"), k.alias("k"))
    both = F.sort_array(F.concat(F.transform(values, lambda v, k: one(v, own, k)), F.transform(marks, lambda m, k: one(m, other, k))))
    mine = F.filter(F.transform(both, lambda x, i: F.struct(x["side"].alias("side"), x["k"].alias("k"), i.alias("i"))), lambda x: x["side"] == own)
    counts = F.sort_array(F.transform(mine, lambda x, n: F.struct(x["k"].alias("k"), (x["i"] - n).alias("n"))))
    return F.transform(counts, lambda x: x["n"])


def _placed(kind: str, rank: int, found: Column, gaps: Column, holds: Callable[[Column], Column]) -> Column:
    """Spans (code points) of the matches in ``found`` that hold; ``gaps`` are the texts between them."""
    pairs = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: F.struct(m.alias("match"), F.length(g).alias("gap"), F.length(m).alias("n")))

    def span(p: Column, before: Column) -> Column:
        start = before + p["gap"]
        return F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + p["n"]).alias("end"), F.lit(kind).alias("kind"), p["match"].alias("value"))

    every = let(pairs, lambda ps: F.zip_with(ps, running(F.transform(ps, lambda p: p["gap"] + p["n"])), span))
    return F.when(F.size(found) > 0, F.filter(every, lambda x: holds(x["value"]))).otherwise(F.array().cast(f"array<{_SPAN}>"))


def base_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with ``base``: spans (start, rank, end, kind, value) of all kinds, by start, then kind as listed.

    A text without the sign that every match of a kind has is not scanned for it.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast("array<string>")
    d = docs.withColumns({f"_m_{k}": F.when(F.contains(text, F.lit(_SIGNS[k])), F.regexp_extract_all(text, F.lit(PATTERNS[k]), 0)).otherwise(none) if k in _SIGNS else F.regexp_extract_all(text, F.lit(PATTERNS[k]), 0) for k in KINDS})
    d = d.withColumns({f"_g_{k}": F.when(F.size(f"_m_{k}") > 0, F.split(text, PATTERNS[k], -1)) for k in KINDS})
    spans = F.concat(*[_placed(k, i, F.col(f"_m_{k}"), F.col(f"_g_{k}"), functools.partial(_holds, k)) for i, k in enumerate(KINDS)])
    return d.select(*columns(docs), F.sort_array(spans).alias("base"))


_WORD = r"\p{L}++"


#: Words to both sides of a span by which two texts that show it are told apart.
_WIDE = 20


def contexts(based: DataFrame, near: int) -> DataFrame:
    """One row for each base span: entity (its value), kind, terms (the ``near`` words before and after it, each once, in lower case) and
    window (hash of ``_WIDE`` words to both sides). Words are taken from the whole text, however far off; one that overlaps the span
    does not count. The words of a text are placed once; spans find theirs by rank."""
    words, gaps = F.regexp_extract_all("text", F.lit(_WORD), 0), F.split("text", _WORD, -1)
    sides = lambda w, x, n: F.concat(F.slice(w, F.greatest(x["before"] - n, F.lit(0)) + 1, F.least(x["before"], F.lit(n))), F.slice(w, x["after"] + 1, F.lit(n)))

    def around(placed: Column) -> Column:
        before = ranks(F.transform("base", lambda s: s["start"]), F.transform(placed, lambda p: p["end"]), True)
        after = ranks(F.transform("base", lambda s: s["end"]), F.transform(placed, lambda p: p["start"]), False)
        at = F.zip_with(F.col("base"), F.zip_with(before, after, lambda b, a: F.struct(b.alias("before"), a.alias("after"))), lambda s, x: F.struct(s["value"].alias("entity"), s["kind"].alias("kind"), x["before"].alias("before"), x["after"].alias("after")))
        return let(F.transform(placed, lambda p: F.lower(p["value"])), lambda w: F.transform(at, lambda x: F.struct(x["entity"].alias("entity"), x["kind"].alias("kind"), F.array_distinct(sides(w, x, near)).alias("terms"), F.xxhash64(sides(w, x, _WIDE)).alias("window"))))

    return based.select(F.explode(let(_placed("word", 0, words, gaps, lambda m: F.lit(True)), around)).alias("c")).select("c.*")


def disclosing_terms(docs: DataFrame, based: DataFrame, near: int = 3, least_share: float = 0.65, least_bits: float = 4.0) -> DataFrame:
    """Terms that give a protected entity away: ``term``, ``kind``, ``disclosure``.

    ``based``: text and base of the documents with spans. An entity e is the value of a base span; its contexts are the
    ``near`` words before and after each of its spans. Of the n(t) places of a term t in the corpus, n(e, t) are near e. What t says of e
    is p(e | t), estimated low: 1 / p = n(t) / n(e, t) + 1 / d, as if t also stood once without e in one more of the d surroundings that
    show the pair (copies and near copies of a passage are one; a template in different texts counts each time). By chance, a share
    q = 2 ``near`` n(e) / N of the N words stands near e; log2(p / q) bits are told of it. The term discloses e if p is ``least_share``
    or more and it tells ``least_bits`` or more. Neither bound moves with the corpus: a word seen nowhere else needs two
    surroundings at any size (p = 2/3), one that is common elsewhere never gets there. ``disclosure`` is p.
    """
    near_all = materialise(contexts(based, near), "contexts")
    pairs = near_all.select("entity", "kind", "window", F.explode("terms").alias("term"))
    seen = pairs.groupBy("entity", "kind", "term", "window").agg(F.count(F.lit(1)).alias("n")).groupBy("entity", "kind", "term").agg(F.sum("n").alias("both"), F.count(F.lit(1)).alias("shown"))
    entities = near_all.groupBy("entity", "kind").agg(F.count(F.lit(1)).alias("n_entity"))
    words = docs.select(F.explode(F.split(F.lower("text"), r"\P{L}++")).alias("term")).where("term <> ''").groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    words = materialise(words, "words")
    total = words.agg(F.sum("n_term")).first()[0] or 1
    told = seen.join(entities, ["entity", "kind"]).join(words, "term")
    share = 1 / (F.col("n_term") / F.col("both") + 1 / F.col("shown"))
    chance = F.least(2 * near * F.col("n_entity") / F.lit(float(total)), F.lit(1.0))
    told = told.withColumn("disclosure", share).where((F.col("disclosure") >= least_share) & (F.log2(F.col("disclosure") / chance) >= least_bits))
    return materialise(told.groupBy("term").agg(F.max_by("kind", F.struct("disclosure", "kind")).alias("kind"), F.max("disclosure").alias("disclosure")), "terms")


def find_spans(docs: DataFrame, near: int = 3, least_share: float = 0.65, least_bits: float = 4.0) -> DataFrame:
    """Personal data of whole texts: base spans, and the words that disclose an entity (kind ``term``).

    Returns doc_id, text_hash (with doc_id it names the document), base and added: arrays of (start, rank, end, kind,
    value), code points, end exclusive, sorted. Base spans are those of the patterns in ``PATTERNS`` that hold: parts of an
    ip at most 255, a card's digits passing the Luhn check, a phone's 9 to 15 digits. Added spans never touch them. A
    null text counts as empty. Rows that share doc_id and text are alike and come back as often as they came. An empty
    table gives no rows; other columns are ignored.

    Every text is looked through for the terms with a Bloom filter of them; only words that seem to be one are joined with the
    terms, and only texts that seem to hold one are joined with what was found, so the corpus is never shuffled.
    """
    d = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    found = materialise(base_spans(d).select("doc_id", "text_hash", "base", F.when(F.size("base") > 0, F.col("text")).alias("text")), "spans")
    terms = disclosing_terms(d, found.where("text is not null").select("text", "base"), near, least_share, least_bits).select("term")
    seem = KeyFilter(terms.select(F.col("term").alias("key")), each=20, probes=8)
    spoken = d.select("doc_id", "text_hash", F.explode(F.array_distinct(F.split(F.lower("text"), r"\P{L}++"))).alias("term")).where(seem.passes(F.col("term")))
    hits = spoken.join(terms, "term").groupBy("doc_id", "text_hash").agg(F.collect_set("term").alias("terms"))
    hits = materialise(hits.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_h"), "terms"), "speaking")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_h"))
    speaking = KeyFilter(hits.select(F.xxhash64("_id", "_h").alias("key"))).passes(F.xxhash64("doc_id", "text_hash"))
    marked = d.where(speaking).join(hits, same).withColumns({"_m": F.regexp_extract_all("text", F.lit(_WORD), 0), "_g": F.split("text", _WORD, -1)})
    marked = marked.withColumn("added", _placed("term", len(KINDS), F.col("_m"), F.col("_g"), lambda m: F.array_contains("terms", F.lower(m))))
    marked = marked.groupBy("_id", "_h").agg(F.first("added").alias("added"))
    out = found.select("doc_id", "text_hash", "base").join(marked, same, "left")
    none = F.filter("base", lambda b: F.lit(False))
    return out.select("doc_id", "text_hash", "base", F.when(F.size("added") > 0, F.when(F.size("base") > 0, _free(F.col("added"), F.col("base"))).otherwise(F.col("added"))).otherwise(none).alias("added"))


def _free(added: Column, base: Column) -> Column:
    """Spans of ``added`` that no span of ``base`` (sorted by start) overlaps: none that starts before its end reaches beyond its start."""
    ends = F.transform(base, lambda b: b["end"])
    reach = F.concat(running(ends, largest=True), F.array(F.array_max(ends)))
    upto = ranks(F.transform(added, lambda a: a["end"]), F.transform(base, lambda b: b["start"]), False)
    kept = let(reach, lambda r: F.filter(F.zip_with(added, upto, lambda a, n: F.struct(a.alias("a"), (F.get(r, n) <= a["start"]).alias("free"))), lambda x: x["free"]))
    return F.transform(kept, lambda x: x["a"])


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of(kind: str):
    return lambda s: s["kind"] == kind


def span_digests(docs: DataFrame, **how) -> DataFrame:
    """doc_id, counts of the base spans by kind, SHA-256 of the base spans' ``kind:start:end`` list, and the list of all spans."""
    found = find_spans(docs, **how)
    counts = {f"n_{k}": F.size(F.filter("base", _of(k))).cast("long") for k in KINDS}
    every = F.sort_array(F.concat("base", "added"))
    return found.select("doc_id", *[c.alias(n) for n, c in counts.items()], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(every).alias("spans"))


def replaced(text: Column, spans: Column) -> Column:
    """``text`` with each span (sorted by start) replaced by its kind in ``<>``; spans that overlap count as one of the first one's kind.

    The text is cut into words and what lies between them, and only pieces that a span touches are looked into, so the work grows with
    the text and the spans, not with their product.
    """
    ends = F.transform(spans, lambda s: s["end"])
    opened = F.zip_with(spans, running(ends, largest=True), lambda s, r: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), r.alias("before")))
    first = F.filter(opened, lambda s: (s["start"] >= s["before"]))
    regions = let(first, lambda f: F.zip_with(f, F.concat(F.transform(F.slice(f, F.lit(2), F.size(f)), lambda s: s["before"]), F.array(F.array_max(ends))), lambda s, e: F.struct(s["start"].alias("start"), e.alias("end"), F.upper(s["kind"]).alias("kind"))))
    tokens = F.flatten(F.zip_with(F.split(text, _WORD, -1), F.regexp_extract_all(text, F.lit(_WORD), 0), lambda g, w: F.array(g, F.coalesce(w, F.lit("")))))

    def cut(token: Column, own: Column) -> Column:
        def step(s: Column, r: Column) -> Column:
            kept = F.substring(token["text"], s["at"] - token["at"] + 1, F.greatest(r["start"] - s["at"], F.lit(0)))
            label = F.when(r["start"] >= token["at"], F.concat(F.lit("<"), r["kind"], F.lit(">"))).otherwise("")
            return F.struct(F.greatest(s["at"], r["end"]).alias("at"), F.concat(s["out"], kept, label).alias("out"))

        rest = lambda s: F.concat(s["out"], F.substring(token["text"], s["at"] - token["at"] + 1, F.length(token["text"])))
        return F.aggregate(own, F.struct(token["at"].alias("at"), F.lit("").alias("out")), step, rest)

    def rebuilt(found: Column) -> Column:
        placed = let(tokens, lambda t: F.zip_with(t, running(F.transform(t, lambda x: F.length(x))), lambda x, at: F.struct(x.alias("text"), at.alias("at"), (at + F.length(x)).alias("end"))))

        def joined(t: Column) -> Column:
            past = ranks(F.transform(t, lambda x: x["at"]), F.transform(found, lambda r: r["end"]), True)
            begun = ranks(F.transform(t, lambda x: x["end"]), F.transform(found, lambda r: r["start"]), False)
            touched = F.zip_with(t, F.zip_with(past, begun, lambda a, b: F.struct(a.alias("from"), (b - a).alias("n"))), lambda x, y: F.when(y["n"] > 0, cut(x, F.slice(found, y["from"] + 1, F.greatest(y["n"], F.lit(0))))).otherwise(x["text"]))
            return F.array_join(touched, "")

        return let(placed, joined)

    return let(regions, rebuilt)


def sanitise(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with personal data generalised: base spans become ``<EMAIL>`` and the like, disclosing terms ``<TERM>``.

    Where spans overlap, the one that starts first (then the kind listed first) stands for all. Other columns stay, whatever
    their names. Null texts stay null and empty ones empty; repeated rows and null ids come back as they came, each cleaned;
    an empty table gives no rows. Only rows that a Bloom filter takes for documents with spans are joined with the spans.
    """
    spans = find_spans(docs, **how).where("size(base) > 0 or size(added) > 0").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_h"), F.sort_array(F.concat("base", "added")).alias("_spans"))
    spans = materialise(spans.dropDuplicates(["_id", "_h"]), "document-spans")
    named = KeyFilter(spans.select(F.xxhash64("_id", "_h").alias("key")))
    d = whole_rows(docs).withColumns({"id": F.col("row.doc_id"), "hash": F.xxhash64("row.text")})
    seem = named.passes(F.xxhash64("id", "hash"))
    some = d.where(seem).join(spans, F.col("id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_h")), "left")

    text = F.when(F.col("_spans").isNull(), F.col("row.text")).otherwise(replaced(F.col("row.text"), F.col("_spans")))
    rest = d.where(~seem).select("row.*")
    return rest.unionByName(some.select(F.col("row").withField("text", text).alias("row")).select("row.*"))
