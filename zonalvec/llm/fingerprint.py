"""Document fingerprints by consistent weighted sampling, in DataFrame operations only.

Terms are a text's lower-cased words, weighted by how often they occur. For term x and sample k, r and c are
Gamma(2, 1) and b is uniform on [0, 1), all drawn from hashes of (x, k); with weight w

    t = floor(ln w / r + b),  ln a = ln c - r * (t + 1 - b)

and the sample is the least ln a over the terms. Two texts agree in a sample with a probability equal to the
generalised Jaccard similarity of their weights: the sum of minima over the sum of maxima.

The five draws of a term and sample are parts of one 64-bit hash: four of 12 bits and b of 16. Logarithms of the 12-bit
draws come from one table of 4096 values that is sent to all tasks.

A text's successor in id order: texts are written once with a key; keys alone are numbered in the order of
(id, checksum of the text) and tell each row whose text precedes its own. The texts are then exchanged by their keys, and
the beginning of each text, as long as its predecessor needs, is sent to the predecessor. Every later grouping keeps to the
partitions of the keys; only signatures move again. Keys are of one row each, so no id, however often repeated, is hot.
A term that has the same weight in a text and in its edited text is sampled once for both.

Defined cases: a null text is empty; a text without words has the fingerprint of no term (all zeros), which
equals itself and nothing else; null ids come before all others; rows with equal ids follow each other in
the order of a checksum of their texts; after the last row comes the first; one row is its own successor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.order import numbered
from .common import dropped, materialise, table

SAMPLES = 64
#: Runs of these separate words; other ASCII and all non-ASCII characters belong to words.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bits of each of the draws that make r and c.
BITS = 12


def logarithms(spark) -> DataFrame:
    """One row: ln of the middles of 2**BITS equal parts of (0, 1), as an array."""
    most = 1 << BITS
    return spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.log((i + 0.5) / most)).alias("lns"))


def _sample(k: int) -> str:
    """ln a of a row's term (``term``: its hash; ``lnw``: the logarithm of its weight) in sample k."""
    drawn = f"xxhash64(term, {k})"
    ln_u = [f"get(lns, cast(shiftrightunsigned({drawn}, {s}) & {(1 << BITS) - 1} as int))" for s in range(0, 4 * BITS, BITS)]
    r = f"(- {ln_u[0]} - {ln_u[1]})"
    ln_c = f"ln(- {ln_u[2]} - {ln_u[3]})"
    b = f"(cast(shiftrightunsigned({drawn}, {4 * BITS}) as double) / 65536D)"
    return f"if(lnw = 0D, {ln_c} - {r} * (1 - {b}), {ln_c} - {r} * (floor(lnw / {r} + {b}) + 1 - {b}))"


def signatures(terms: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """terms: keys, term (long), weight (above 0), one row a key and term. -> keys, mins: the least ln a of each sample."""
    weighed = terms.select(*keys, "term", F.log(F.col("weight").cast("double")).alias("lnw"))
    drawn = weighed.crossJoin(F.broadcast(logarithms(terms.sparkSession)))  # one row
    mins = drawn.groupBy(*keys).agg(*[F.min(F.expr(_sample(k))).alias(f"s{k}") for k in range(samples)])
    return mins.select(*keys, F.array(*[f"s{k}" for k in range(samples)]).alias("mins"))


def folded(mins):
    """16 bits of each sample."""
    return F.transform(mins, lambda x, k: F.shiftright(F.xxhash64(x, k), 48).cast("smallint"))


def likeness(a, b):
    """Share of equal samples: estimates the generalised Jaccard similarity."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, e: n + e) / F.size(a).cast("double")


def as_text(sig):
    return F.lower(F.concat_ws("", F.transform(sig, lambda x: F.lpad(F.hex(x.cast("int").bitwiseAND(65535)), 4, "0"))))


def words_of(text):
    return F.split(F.lower(text), SEPARATORS)


def edited(n_chars, text, following):
    """The last floor(n / 4) code points replaced by the first as many, or all, of the following text."""
    quarter = F.expr(f"{n_chars} div 4").cast("int")
    return F.concat(F.substring(text, F.lit(1), F.col(n_chars) - quarter), F.substring(following, F.lit(1), quarter))


def with_successors(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(key, n_chars, text, following), one row a document; its order (key, doc_id, next_key, ...); and the written texts, which
    can be dropped when the first table is used up.

    following: the beginning of the next document's text, a quarter as long as the own one.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kept = materialise(source.withColumn("key", F.monotonically_increasing_id()), "texts")
    placed, n = numbered(kept.select("key", "doc_id", F.char_length("text").alias("n_chars"), F.xxhash64("text").alias("sum")), "doc_id", "sum")
    placed = placed.drop("sum")
    around = lambda by, prefix: placed.select(F.pmod(F.col("row") + by, F.lit(max(n, 1))).alias("row"), F.col("key").alias(f"{prefix}_key"), F.col("n_chars").alias(f"{prefix}_chars"))
    order = materialise(placed.join(around(1, "previous"), "row").join(around(-1, "next").drop("next_chars"), "row"), "order")
    # Merge joins by key on purpose: what follows groups by key in the same partitions. Both sides use one exchange of the texts.
    rows = kept.select("key", "text").hint("merge").join(order.select("key", "n_chars", "previous_key", "previous_chars"), "key")
    ahead = rows.select(F.col("previous_key").alias("key"), F.substring("text", F.lit(1), F.expr("previous_chars div 4").cast("int")).alias("following"))
    return rows.select("key", "n_chars", "text").hint("merge").join(ahead, "key"), order, kept


def fingerprinted(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, sig, edited_sig, next_sig): signatures as arrays of 16-bit samples."""
    rows, order, texts = with_successors(docs)
    rows = rows.withColumn("edited", edited("n_chars", F.col("text"), F.col("following")))
    about = rows.select("key", "n_chars", F.sha2("edited", 256).alias("edited_sha256"))
    sides = rows.select("key", F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("text").alias("t")), F.struct(F.lit(2).alias("side"), F.col("edited").alias("t")))).alias("s"))
    seen = sides.select("key", "s.side", F.explode(words_of(F.col("s.t"))).alias("word")).filter("word <> ''")
    counts = seen.select("key", F.xxhash64("word").alias("term"), "side").groupBy("key", "term").agg(
        F.sum(F.when(F.col("side") == 1, 1).otherwise(0)).alias("n1"), F.sum(F.when(F.col("side") == 2, 1).otherwise(0)).alias("n2")
    )
    weighted = counts.select("key", "term", F.explode(F.expr(
        "case when n1 = n2 then array(struct(3 as side, n1 as weight)) when n1 = 0 then array(struct(2 as side, n2 as weight))"
        " when n2 = 0 then array(struct(1 as side, n1 as weight)) else array(struct(1 as side, n1 as weight), struct(2 as side, n2 as weight)) end"
    )).alias("s")).select("key", "s.side", "term", "s.weight")
    mins = signatures(weighted, ["key", "side"], samples)
    least = lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.zip_with(a, b, lambda x, y: F.least(x, y)))
    by_side = mins.groupBy("key").agg(*[F.max(F.when(F.col("side") == s, F.col("mins"))).alias(f"m{s}") for s in (1, 2, 3)])
    none = F.array_repeat(F.lit(0).cast("smallint"), samples)
    sigs = by_side.select("key", folded(least(F.col("m1"), F.col("m3"))).alias("sig"), folded(least(F.col("m2"), F.col("m3"))).alias("edited_sig"))
    both = about.join(sigs, "key", "left").withColumn("sig", F.coalesce("sig", none)).withColumn("edited_sig", F.coalesce("edited_sig", none))
    found = materialise(both.hint("merge").join(order.select("key", "doc_id", "next_key"), "key"), "signatures")
    dropped(texts, order)
    following = found.select(F.col("key").alias("next_key"), F.col("sig").alias("next_sig"))
    return found.join(following, "next_key").select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", "sig", "edited_sig", "next_sig")


def op1_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    found = fingerprinted(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("sig")).alias("fingerprint"), as_text(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"), likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )
