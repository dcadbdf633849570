"""Personal data and the terms that give it away. DataFrame functions only.

Fixed patterns find e-mail and IP addresses, card and phone numbers. For every value found, all words of the texts that hold
it are counted with it, by document, over the whole corpus. A word discloses a value if their pointwise mutual information
comes near to the value's own information content: who sees the word can tell the value. Such words are spans, too, at every
place of every text, and are generalised with the values when a text is sanitised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campaignflow.llm import common as c

KINDS = ("email", "ip", "card", "phone", "term")
#: The contract's patterns. Possessive repeats match the same and cannot backtrack; a match can begin inside a run of name
#: characters only where the match before it ended; shorter card runs are not looked at, as no part of them has 12 digits.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SMALL = r"^0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])$"

#: A word discloses a value if it is with it in this many documents and their mutual information is this share of the
#: value's information content.
LEAST_DOCUMENTS, DISCLOSED = 2, 0.95
#: Stands for an e-mail address where words are counted; Unicode has no such character.
HIDDEN = "\uffff"
WORD = r"[^\x20\x09-\x0D]+"
PLACES = "array<struct<start:int,kind:int,end:int>>"


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, value) in code points of all matches, from left to right; matches are never empty."""
    gap = F.transform(F.split(text, pattern, -1), F.length)
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.arrays_zip(F.slice(gap, 1, F.size(value)).alias("gap"), value.alias("value"))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def add(acc, x):
        start = acc["at"] + x["gap"]
        end = start + F.length(x["value"])
        return F.struct(end.alias("at"), F.concat(acc["found"], F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value")))).alias("found"))

    start = F.struct(F.lit(0).alias("at"), none.alias("found"))
    return F.aggregate(both, start, add, lambda acc: acc["found"])


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Is the check digit right? Every second digit from the right counts twice."""
    doubled = F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)])
    own = F.transform(F.split(F.reverse(number), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.get(doubled, d.cast("int"))))
    return F.aggregate(own, F.lit(0), lambda n, d: n + F.coalesce(d, F.lit(0))) % 10 == 0


def base_spans(text: Column) -> list[Column]:
    """For each kind its spans (kind, start, end, value) in a text that is not null; matches that break the kind's rule are dropped."""

    def small_parts(v):
        return F.forall(F.split(v, r"\."), lambda p: p.rlike(SMALL))

    def card(v):
        n = digits(v)
        return F.length(n).between(12, 19) & luhn(n)

    rules = {
        "email": (EMAIL, F.contains(text, F.lit("@")), lambda v: F.lit(True)),
        "ip": (IP, text.rlike(r"[0-9]\.[0-9]"), small_parts),
        "card": (CARD, text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"), card),
        "phone": (PHONE, F.contains(text, F.lit("+")), lambda v: F.length(digits(v)).between(9, 15)),
    }
    return [_kept(text, number, kind, *rules[kind]).alias(kind) for number, kind in enumerate(rules)]


def _kept(text: Column, number: int, kind: str, pattern: str, possible: Column, rule) -> Column:
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    found = F.when(possible, matches(text, pattern)).otherwise(none)
    return F.transform(F.filter(found, lambda x: rule(x["value"])), lambda x: F.struct(
        x["start"].alias("start"), F.lit(number).alias("kind"), x["end"].alias("end"), x["value"].alias("value")))


def bare(word: Column) -> Column:
    """A word without the punctuation at its ends, in lower case."""
    return F.lower(F.regexp_replace(word, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))


def terms_of(text: Column) -> Column:
    """Hashes of the different terms of a text: words of three letters or more that hold no e-mail address."""
    hidden = F.when(F.contains(text, F.lit("@")), F.regexp_replace(text, EMAIL, HIDDEN)).otherwise(text)
    words = F.array_distinct(F.filter(F.split(hidden, c.SPACE), lambda w: ~F.contains(w, F.lit(HIDDEN))))
    terms = F.filter(F.array_distinct(F.transform(words, bare)), lambda t: F.length(F.regexp_replace(t, r"[^\p{L}]+", "")) >= 3)
    return F.transform(terms, lambda t: F.xxhash64(t))


def places_of(text: Column, hits: Column, spans: Column) -> Column:
    """Where a text has a word whose term is among ``hits`` and that no base span touches, in one pass."""
    gap, word = F.transform(F.split(text, WORD, -1), F.length), F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    both = F.transform(F.arrays_zip(F.slice(gap, 1, F.size(word)).alias("gap"), word.alias("word")), lambda x: F.struct(
        x["gap"].alias("gap"), F.length(x["word"]).alias("size"), F.array_contains(hits, F.xxhash64(bare(x["word"]))).alias("hit")))

    def add(acc, x):
        start = acc["at"] + x["gap"]
        end = start + x["size"]
        own = F.array(F.struct(start.alias("start"), F.lit(4).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["hit"], F.concat(acc["found"], own)).otherwise(acc["found"]).alias("found"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(PLACES).alias("found"))
    found = F.aggregate(both, start, add, lambda acc: acc["found"])
    return F.filter(found, lambda t: ~F.exists(spans, lambda s: (s["start"] < t["end"]) & (s["end"] > t["start"])))


def found(documents: DataFrame) -> DataFrame:
    """Per row: row, doc_id, text, the spans of each base kind, and hashes of its different values and terms."""
    df = documents.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("whole"))
    df = df.select("row", "doc_id", "text", *base_spans(F.col("whole")), terms_of(F.col("whole")).alias("terms"))
    df = df.withColumn("spans", F.array_sort(F.concat(*KINDS[:4])))
    return df.withColumn("entities", F.array_distinct(F.transform("spans", lambda s: F.xxhash64(s["kind"], F.lower(s["value"])))))


def disclosing(base: DataFrame) -> DataFrame:
    """(entity, term) pairs whose mutual information reaches the threshold; counts are of documents, over all of them.

    The threshold is n_joint >= n_term * (n_entity / total) ** (1 - DISCLOSED). As n_joint is at most the number of the
    entity's documents, and at most the number of the term's documents that hold a value, terms and pairs that cannot reach
    it are left out before they meet; none is lost by that.
    """
    total = float(max(base.count(), 1))
    entities = base.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    entities = c.written(entities.where((F.col("n_entity") >= LEAST_DOCUMENTS) & (F.col("n_entity") < total)), "entities")

    def least(n_term: Column, n_entity: Column) -> Column:
        return n_term * F.pow(n_entity / F.lit(total), F.lit(1 - DISCLOSED)) * F.lit(1 - 1e-9)

    most = entities.agg(F.max(F.col("n_entity") / least(F.lit(1.0), F.col("n_entity")))).first()[0] or 0.0
    terms = base.select(F.explode("terms").alias("term"), (F.size("entities") > 0).cast("long").alias("beside"))
    terms = terms.groupBy("term").agg(F.count(F.lit(1)).alias("n_term"), F.sum("beside").alias("n_beside"))
    terms = c.written(terms.where(
        (F.col("n_beside") >= LEAST_DOCUMENTS) & (F.col("n_term") <= F.lit(most))
        & (F.col("n_beside") >= least(F.col("n_term"), F.lit(float(LEAST_DOCUMENTS))))), "terms")
    holders = base.where(F.size("entities") > 0)
    of_row = holders.select("row", F.explode("entities").alias("entity")).join(entities, "entity")
    pairs = holders.select("row", F.explode("terms").alias("term")).join(terms, "term").join(of_row, "row").where(
        F.col("n_entity") >= least(F.col("n_term"), F.col("n_entity")))
    joint = pairs.groupBy("entity", "term").agg(
        F.count(F.lit(1)).alias("n_joint"), F.first("n_entity").alias("n_entity"), F.first("n_term").alias("n_term")).where(F.col("n_joint") >= LEAST_DOCUMENTS)
    content = -F.log(F.col("n_entity") / F.lit(total))
    information = F.log(F.col("n_joint") / F.col("n_term")) + content
    return joint.where((content > 0) & (information >= DISCLOSED * content)).select("entity", "term")


def marked(documents: DataFrame) -> DataFrame:
    """``spans`` and the text."""
    base = c.written(found(documents), "pii")
    terms = c.written(disclosing(base).select("term").distinct(), "disclosing")
    hits = c.written(base.select("row", F.explode("terms").alias("term")).join(terms, "term").groupBy("row").agg(F.collect_list("term").alias("hits")), "hits")
    places = base.select("row", "text", "spans").join(hits, "row").select("row", places_of(F.col("text"), F.col("hits"), F.col("spans")).alias("terms"))
    plain = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    df = base.select("row", "doc_id", "text", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:4]], plain.alias("base"))
    df = df.join(places, "row", "left")
    return df.withColumn("spans", F.array_sort(F.concat("base", F.coalesce("terms", F.array().cast(PLACES))))).drop("terms")


def spans(documents: DataFrame) -> DataFrame:
    """Per row of ``documents``: row, doc_id, n_email, n_ip, n_card, n_phone, base (array of kind number, start, end), all spans with terms.

    Null and empty texts have no spans; texts are scanned whole; a null doc_id is kept; rows that repeat a doc_id are documents of
    their own, counted each. Other columns are ignored.
    """
    return marked(documents).drop("text")


def listed(spans: str) -> Column:
    """``kind:start:end`` of an array of spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitised(documents: DataFrame) -> DataFrame:
    """doc_id and text, every span replaced by ``<kind>``; of spans that overlap, the first one replaces both."""
    df = marked(documents)
    names = F.array(*map(F.lit, KINDS))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def put(acc, s):
        gap = F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"])
        return F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), F.concat(acc["out"], gap, F.lit("<"), F.get(names, s["kind"]), F.lit(">")).alias("out"))).otherwise(
            F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out")))

    text = F.aggregate("spans", start, put, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    return df.select("doc_id", text.alias("text"))


def digest(df: DataFrame) -> DataFrame:
    """The contract's columns from ``spans``."""
    return df.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))
