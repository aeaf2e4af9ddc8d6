"""Canonical exact digests of documents.

A text's canonical form is its NFKC normalisation with full case folding and
white space folded; its digest is 128 bits of xxhash over that form. Documents
are grouped by digest, and inside a bucket of several documents each one's
canonical form is compared byte by byte with another's, so that equal
fingerprints stand for equal forms: a document that differs from its bucket's
first gets a fingerprint of its own. The edited forms, and texts that share an id,
are held against their bucket by SHA-256 instead. SQL functions only; normalisation and case
folding are static methods of the ICU library that Spark ships, called by
Spark's ``reflect``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import join_groups, materialise

#: Ids of one bucket of the successor search differ in this many low bits; parts of a bucket of equal digests.
BITS, PARTS = 14, 1024
_SPACES = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def canonical(text: Column) -> Column:
    """NFKC, case folding, NFKC again, runs of white space as one space, none at the ends."""
    nfkc = lambda c: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    folded = nfkc(F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), nfkc(text), F.lit(True)))
    return F.trim(F.regexp_replace(folded, _SPACES, " "))


def digest(form: Column) -> Column:
    """128 bits of xxhash as 32 hexadecimal digits."""
    return F.concat(*(F.lpad(F.lower(F.hex(h)), 16, "0") for h in (F.xxhash64(form), F.xxhash64(F.lit(0x5F3759DF), form))))


def predecessors(ids: DataFrame) -> DataFrame:
    """(id, next): for every distinct id the greatest smaller one; for the least, the greatest of all.

    Ids are cut into buckets of 2**BITS values, hence at most as many distinct
    ids; the greatest ids of the buckets are then searched in the same way.
    """
    ids = ids.where("id is not null").distinct()
    low, high = ids.agg(F.min("id"), F.max("id")).first()
    if low is None:
        return ids.withColumn("next", F.lit(None).cast("long"))
    found = _below(ids.select("id", (F.col("id").cast("decimal(20,0)") - low).alias("key")), high - low)
    return found.select("id", F.coalesce("next", F.lit(high)).alias("next"))


def _below(ids: DataFrame, span: int) -> DataFrame:
    """(id, next) of (id, key), keys being at most span."""
    if span < 1 << BITS:
        return ids.select("id", F.lag("id").over(Window.partitionBy(F.lit(0)).orderBy("key")).alias("next"))
    width = F.lit(1 << BITS).cast("decimal(20,0)")
    ids = ids.withColumn("bucket", F.floor(F.col("key") / width).cast("decimal(20,0)"))
    inside = ids.select("id", "bucket", F.lag("id").over(Window.partitionBy("bucket").orderBy("key")).alias("next"))
    top = ids.groupBy("bucket").agg(F.max("id").alias("top"))
    linked = _below(top.select(F.col("top").alias("id"), F.col("bucket").alias("key")), span >> BITS).select(F.col("id").alias("top"), F.col("next").alias("under"))
    under = top.join(linked, "top").select("bucket", "under")
    return inside.join(under, "bucket").select("id", F.coalesce("next", "under").alias("next"))


def _comparisons(prints: DataFrame) -> DataFrame:
    """(id, other) of (id, fp): whom to compare with inside a bucket of several.

    The one before in the same part of the bucket, or the bucket's first for a
    part's first; so a bucket of any size is compared as a whole with as many
    comparisons as it has members, and its first is sent to a bounded number.
    """
    prints = prints.where("id is not null").distinct()
    several = materialise(prints.groupBy("fp").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "several")
    part = Window.partitionBy("fp", F.pmod(F.xxhash64("id"), F.lit(PARTS))).orderBy("id")
    return join_groups(prints, several, ["fp"], "n").select("id", F.coalesce(F.lag("id").over(part), "first").alias("other")).where("id != other")


def edited_fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last half of the code points replaced by as many
    first ones of the next document by descending id. near_* is 1 if the
    canonical forms are equal and 0 if not. Null counts as empty. Of rows that share an id the one with the greatest text stands for
    the id as a next document. Rows without an id are their own next document.
    Other columns are ignored; an empty table gives no rows.
    """
    base = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    thin = materialise(base.select("doc_id", F.length("text").alias("n"), digest(canonical(F.col("text"))).alias("fp")), "prints")
    ids = thin.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.floor(F.max("n") / 2).cast("int").alias("need"))
    succession = predecessors(ids.select("id"))
    wanted = succession.join(ids, "id").select(F.col("next").alias("doc_id"), F.col("id").alias("for"), "need", F.lit(True).alias("head"))
    compared = _comparisons(thin.select(F.col("doc_id").alias("id"), "fp")).select(F.col("other").alias("doc_id"), F.col("id").alias("for"), F.lit(2**31 - 1).alias("need"), F.lit(False).alias("head"))
    placed = base.where("doc_id is not null")  # dealt out by id once, for both joins
    sent = placed.join(wanted.union(compared), "doc_id").select(F.col("for").alias("doc_id"), "head", F.expr("substring(text, 1, need)").alias("piece"))
    sent = sent.groupBy("doc_id").agg(F.max(F.when(F.col("head"), F.col("piece"))).alias("next_text"), F.max(F.when(~F.col("head"), F.col("piece"))).alias("other_text"))
    none = F.lit(None).cast("string")
    # A union keeps the names of its first part as they are; for the exchange of texts to be the same in both joins, theirs comes second.
    unnamed = base.where("doc_id is null").select("doc_id", "text", none.alias("next_text"), none.alias("other_text"))
    joined = unnamed.union(placed.join(sent, "doc_id", "left")).withColumn("half", F.floor(F.length("text") / 2).cast("int"))
    edited = F.concat(F.expr("substring(text, 1, length(text) - half)"), F.expr("substring(coalesce(next_text, text), 1, half)"))
    forms = joined.select("doc_id", "text", "other_text", edited.alias("edited")).select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited"), 256).alias("edited_sha256"), canonical(F.col("text")).alias("form"), canonical(F.col("edited")).alias("edited_form"), F.when(F.col("other_text").isNotNull(), canonical(F.coalesce("other_text", F.lit("")))).alias("other_form"))
    checked = F.coalesce((F.col("form") == F.col("other_form")) | (digest(F.col("form")) != digest(F.col("other_form"))), F.lit(True))
    out = materialise(
        forms.select("doc_id", "n_chars", "edited_sha256", digest(F.col("form")).alias("fp"), digest(F.col("edited_form")).alias("edited_fp"), (F.col("form") == F.col("edited_form")).cast("double").alias("near_edited"), F.sha2(F.col("form"), 256).alias("long"), F.sha2(F.col("edited_form"), 256).alias("edited_long"), checked.alias("checked")), "edited"
    )
    # Buckets of different forms: none is to be expected. Edited forms and rows of one id are held against their bucket by SHA-256.
    both = out.select("fp", "long").union(out.select("edited_fp", "edited_long"))
    mixed = both.groupBy("fp").agg(F.min("long").alias("a"), F.max("long").alias("z")).where("a != z")
    broken = out.where(~F.col("checked")).select(F.col("fp").alias("b")).union(mixed.select("fp")).distinct()
    prints = [("fp", "long", "fingerprint"), ("edited_fp", "edited_long", "edited_fingerprint")]
    if broken.limit(1).count():
        for fp, long, name in prints:
            out = out.join(broken, F.col(fp) == F.col("b"), "left").withColumn(name, F.when(F.col("b").isNull(), F.col(fp)).otherwise(F.concat(fp, F.lit("-"), long))).drop("b")
    else:
        out = out.withColumnsRenamed({fp: name for fp, _, name in prints})
    own = out.where("doc_id is not null").groupBy("doc_id").agg(F.max("fingerprint").alias("next_print"))
    after = succession.join(own.withColumnRenamed("doc_id", "next"), "next").select(F.col("id").alias("doc_id"), "next_print")
    near_next = (F.col("fingerprint") == F.coalesce("next_print", "fingerprint")).cast("double")
    columns = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited")
    return out.select(*columns).join(after, "doc_id", "left").select(*columns, near_next.alias("near_next"))


def groups(prints: DataFrame) -> DataFrame:
    """fingerprint, group_size, first_id (the least) of the documents of equal fingerprint."""
    return prints.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("group_size"), F.min("doc_id").alias("first_id"))
