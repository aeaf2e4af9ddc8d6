"""Personal data by bootstrapped contextual extraction.

Four fixed patterns give the seed entities. What a password is said to be, and a
long random string that a token or key is said to be, are the seeds of a fifth
kind, secrets. Whatever else has the shape of an identifier is
an unknown instance, if no seed covers it: a run of identifier characters with a
digit or an @ in it, or groups of digits with single spaces, dots, hyphens and
brackets between them, each of any length. Each instance has lexical patterns: the
word before, the two words before, the word before with the word after, and, for
long random strings, their own make-up. Words are lower-cased runs of letters,
digits and underscores; what stands between them does not count, so that
token = "..." and token: ... are one context.

Patterns and instances form a graph that Spark scores in rounds. In each one the
instances known so far, seeds and discoveries, induce the patterns: for each kind a
pattern is as reliable as its known instances outweigh those of other kinds, half
of the unknown ones (context only) and one more. An unknown instance scores as all
its reliable patterns together leave no doubt, and those of a high score are the
identifiers discovered, which induce patterns in the next round. DataFrame
operations only; positions are code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import materialise

KINDS = ("email", "ip", "card", "phone")
# The base patterns, written so that no run of characters is scanned again and again.
# A card's chain of digits is consumed whole, so chains too short to be one need not match.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Characters without which a kind cannot occur.
_NEEDS = {"email": "@", "ip": ".", "phone": "+"}
#: An unknown instance: up to 19 groups of digits, as many as the longest card has digits, or else a run of identifier characters up to its last letter or digit.
_UNKNOWN = (
    r"(?<![A-Za-z0-9@._%+-])(?:[+(]{0,2}[0-9]++(?:\)?+[\x20.-]?+\(?+[0-9]++){1,18}+(?![A-Za-z0-9@_%+]|[.-][A-Za-z0-9@_%+])"
    r"|(?=[A-Za-z._%+-]*+[0-9@])[A-Za-z0-9@._%+-]*[A-Za-z0-9])"
)
#: Seeds of secrets: instances after this, and long random strings after that.
_ASSIGNED = r"(?i)(?<![a-z])(?:password|passwd|passphrase)\s*[=:]\s*[\"']?$"
_KEYED = r"(?i)(?<![a-z])(?:token|secret|(?:api|access|private)[_ -]?key)\s*[=:]\s*[\"']?$"
SECRET = "secret"
#: Rounds of scoring; the reliability that a pattern needs, the score that an instance needs, what an unknown instance weighs against a context.
ROUNDS, RELIABLE, CERTAIN, UNKNOWN = 3, 0.5, 0.9, 0.5
#: Words of a context. A word is tried at its first character only, so a long piece of text is read once.
_LAST = r"(?<![\p{L}\p{N}_])([\p{L}\p{N}_]++)[^\p{L}\p{N}_]*+$"
_LAST_TWO = r"(?<![\p{L}\p{N}_])([\p{L}\p{N}_]++)[^\p{L}\p{N}_]++([\p{L}\p{N}_]++)[^\p{L}\p{N}_]*+$"
_NEXT = r"^[^\p{L}\p{N}_]*+([\p{L}\p{N}_]++)"


def _luhn(digits: Column) -> Column:
    ordered = F.filter(F.split(F.reverse(digits), ""), lambda x: x != "")
    worth = F.transform(ordered, lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(x.cast("int") * 2 - F.when(x.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(worth, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: Column, found: Column) -> Column:
    """Whether a base match passes its kind's test."""
    digits = F.regexp_replace(found, "[^0-9]", "")
    n = F.length(digits)
    ip = F.forall(F.split(found, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(256)) <= 255)
    return F.when(kind == "email", True).when(kind == "ip", ip).when(kind == "card", n.between(14, 19) & F.when(n <= 19, _luhn(digits)).otherwise(False)).otherwise(n.between(10, 15))


def _pieces(text: Column, pattern: str, possible: Column) -> Column:
    """Every match with its length, that of the text since the last one, and the words around it; named tells what is said to come before."""
    between = F.split(text, pattern, -1)

    def piece(m: Column, i: Column) -> Column:
        left, right = F.get(between, i), F.get(between, i + 1)
        named = F.when(F.regexp_like(left, F.lit(_ASSIGNED)), "password").when(F.regexp_like(left, F.lit(_KEYED)), "key")
        words = (F.lower(F.regexp_extract(left, _LAST, 1)), F.lower(F.concat_ws(" ", F.regexp_extract(left, _LAST_TWO, 1), F.regexp_extract(left, _LAST_TWO, 2))), F.lower(F.regexp_extract(right, _NEXT, 1)))
        return F.struct(i.alias("i"), F.length(left).alias("gap"), F.length(m).alias("size"), m.alias("m"), named.alias("named"), *(w.alias(n) for w, n in zip(words, ("before", "two", "after"), strict=True)))

    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), piece)
    return F.when(possible, found).otherwise(F.array().cast("array<struct<i:int,gap:int,size:int,m:string,named:string,before:string,two:string,after:string>>"))


def _of_kind(kind: str | None, pieces: Column) -> Column:
    return F.transform(pieces, lambda x: F.struct(F.lit(kind).cast("string").alias("kind"), x.alias("x")))


def _count(kind: str, spans: Column) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def instances(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents: uid, doc_id; instances: uid, kind (null if unknown), start, end, m, before, after)."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    source = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_column).alias("doc_id"), text.alias("text"))
    digit = F.regexp_like(F.col("text"), F.lit("[0-9]"))
    columns = [_of_kind(k, _pieces(F.col("text"), p, F.instr(F.col("text"), _NEEDS[k]) > 0 if k in _NEEDS else digit)) for k, p in PATTERNS.items()]
    columns.append(_of_kind(None, _pieces(F.col("text"), _UNKNOWN, digit | (F.instr(F.col("text"), "@") > 0))))
    kept = materialise(source.select("uid", "doc_id", F.concat(*columns).alias("found")), "instances")
    rows = kept.select("uid", F.explode("found").alias("f")).select("uid", "f.kind", "f.x.*")
    end = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("uid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("end", end.cast("long")).withColumn("start", F.col("end") - F.col("size"))
    seed = F.col("kind").isNotNull()
    rows = rows.where(~seed | valid(F.col("kind"), F.col("m")))
    order = Window.partitionBy("uid").orderBy("start", F.col("kind").asc_nulls_last())
    reached = F.max(F.when(seed, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    coming = F.min(F.when(seed, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    free = (F.coalesce(reached, F.lit(0)) <= F.col("start")) & (F.coalesce(coming, F.col("end")) >= F.col("end"))
    rows = rows.withColumn("free", free).where(seed | F.col("free"))
    secret = (F.col("named") == "password") | (F.col("named") == "key") & _make_up(F.col("m")).isNotNull()
    two = F.when(F.col("two").contains(" "), F.col("two")).otherwise("").alias("two")
    return kept.select("uid", "doc_id"), rows.select("uid", F.coalesce("kind", F.when(secret, SECRET)).alias("kind"), "start", "end", "m", "before", two, "after")


def _make_up(m: Column) -> Column:
    """What a long random string is made of; null for other instances."""
    mixed = F.regexp_like(m, F.lit(r"^(?=(?:[A-Za-z]*[0-9]){4})(?=(?:[0-9]*[A-Za-z]){4})[A-Za-z0-9]{16,}$"))
    kinds = F.when(F.regexp_like(m, F.lit("^[0-9a-f]+$")), "hexadecimal").when(F.regexp_like(m, F.lit("^[0-9a-z]+$")), "lower").when(F.regexp_like(m, F.lit("^[0-9A-Z]+$")), "upper").otherwise("any")
    return F.when(mixed, kinds)


def induced(found: DataFrame) -> DataFrame:
    """(m, kind, pattern), distinct, for every instance of found (kind, m, before, two, after)."""
    patterns = F.array(
        F.when(F.length("before") > 0, F.concat(F.lit("l "), "before")),
        F.when(F.length("two") > 0, F.concat(F.lit("2 "), "two")),
        F.when((F.length("before") > 0) & (F.length("after") > 0), F.concat(F.lit("b "), "before", F.lit(" "), "after")),
        F.concat(F.lit("s "), _make_up(F.col("m"))),
    )
    return found.select("m", "kind", F.explode(F.array_compact(patterns)).alias("pattern")).distinct()


def discovered(found: DataFrame) -> DataFrame:
    """(m, kind): unknown instances claimed by reliable patterns, each for its best kind."""
    edges = materialise(induced(found), "edges")
    links = materialise(edges.select("m", "pattern").distinct(), "links")
    seeds = edges.where("kind is not null").select("m", "kind").distinct()
    totals = links.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    unknown = links.join(seeds.select("m").distinct(), "m", "left_anti")
    known = seeds
    for _ in range(ROUNDS):
        sums = links.join(known, "m").groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("own"))
        sums = sums.join(sums.groupBy("pattern").agg(F.sum("own").alias("all")), "pattern").join(totals, "pattern")
        against = F.when(F.col("pattern").startswith("s "), 0.0).otherwise(UNKNOWN) * F.greatest(F.col("n") - F.col("all"), F.lit(0))
        reliable = sums.select("pattern", "kind", (F.col("own") / (F.col("all") + against + 1)).alias("score")).where(F.col("score") >= RELIABLE)
        claimed = unknown.join(reliable, "pattern").groupBy("m", "kind").agg(F.round(1 - F.exp(F.sum(F.log(1 - F.col("score")))), 9).alias("score"))
        best = claimed.where(F.col("score") >= CERTAIN).groupBy("m").agg(F.max(F.struct("score", "kind")).alias("b")).select("m", F.col("b.kind").alias("kind"))
        best = materialise(best, "scores")
        known = seeds.union(best)
    return best


def _joined(spans: str) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, (*KINDS, SECRET))), s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def personal_data(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_found (spans the method discovers), n_secret, secrets (spans of secrets) of every row.

    Null and empty texts have no spans. Rows of equal id stay apart; other columns
    are ignored; an empty table gives no rows.
    """
    kept, found = instances(docs, id_column, text_column)
    found = materialise(found, "spans")
    seed = F.col("kind").isin(*KINDS)
    more = found.where("kind is null").drop("kind").join(discovered(found), "m").select("uid", "kind", "start", "end", F.lit(False).alias("base"), F.lit(True).alias("new"))
    spans = found.where("kind is not null").select("uid", "kind", "start", "end", seed.alias("base"), F.lit(False).alias("new")).union(more)
    gathered = spans.groupBy("uid").agg(F.collect_list(F.struct("kind", "start", "end", "base", "new")).alias("all"))
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,base:boolean,new:boolean>>")
    out = kept.join(gathered, "uid", "left").withColumn("all", F.coalesce("all", none)).withColumn("own", F.filter("all", lambda s: s["base"]))
    out = out.withColumn("secret", F.filter("all", lambda s: s["kind"] == SECRET)).withColumn("listed", F.filter("all", lambda s: s["kind"] != SECRET))
    counts = [_count(k, F.col("own")).alias(f"n_{k}") for k in KINDS]
    new = F.size(F.filter("all", lambda s: s["new"])).cast("long").alias("n_found")
    return out.select("doc_id", *counts, F.sha2(_joined("own"), 256).alias("base_sha256"), _joined("listed").alias("spans"), new, F.size("secret").cast("long").alias("n_secret"), _joined("secret").alias("secrets"))
