"""Personal data: base patterns, and bootstrapped contextual extraction beyond them. DataFrame functions only.

*Base.* E-mail addresses, IPv4 addresses, payment cards and phone numbers by
regular expression, leftmost and non-overlapping per kind; matches that fail
their kind's test (parts up to 255, Luhn, number of digits) are dropped.
Quantifiers are possessive wherever what follows cannot match what they took,
which changes no match but keeps the matcher iterative on very long runs.

*Bootstrap.* Instances are the base matches, and the runs of letters, digits and
a few marks that hold a digit or an @ and touch no base match. The seeds, with score
1, are the base matches and runs that look like keys (`KEY`). What stands around an
instance makes its patterns: the word before with the marks between (`token = "`) and
the character behind, if there are such marks; and the two words before. The
bipartite graph of patterns and distinct instances is scored in rounds: a pattern's
confidence is the mean score of its instances, if their scores add up to `SUPPORT`; an
instance's score is the chance that one of its trusted patterns is right. So what one
round finds supports patterns in the next. Runs that reach `CONFIDENCE` and stand in a
trusted pattern are reported as kind `found`: keys among them, so a key-like run
in no such context is left alone.

Texts of any length: matches become rows, and their places are running sums, so work is
linear in them. Nulls: a null text is empty; an empty table gives an empty result. Rows
that repeat an id are settled each by its own text, and ties of patterns cannot
matter. Other columns are not read. Patterns and instances are hashed and aggregated
before each shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsewright.cluster import BROADCAST_ROWS, discard, materialise

# The base patterns, in the order in which kinds are listed.
EMAIL = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IP_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
#: Runs with a digit or an @, from where no such run goes on before.
RUN = r"(?<![A-Za-z0-9_.%+/@-])[A-Za-z_.%+/-]*+[0-9@][A-Za-z0-9_.%+/@-]*+"
#: A cheap test that every text with a match passes.
HINT = {"email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]", "run": "[0-9@]"}
#: Runs that look like keys: long, with letters and digits.
KEY = r"^(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z])(?:[0-9a-fA-F]{32,}|[A-Za-z0-9_+/-]{24,})$"

ROUNDS = 3
#: Scores that the instances of a pattern must add up to, and the confidence that patterns and instances need.
SUPPORT = 5
CONFIDENCE = 0.9
#: Characters before an instance that are looked at.
CONTEXT = 48
_WORD, _GAP = r"[\p{L}\p{N}_]+", r"[^\p{L}\p{N}_]{1,6}"

KINDS = [*PATTERNS, "run"]
SPAN = "struct<s:int,e:int>"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's test."""
    places = F.sequence(F.lit(1), F.length(digits))
    digit = lambda i: F.substring(F.reverse(digits), i, 1).cast("int")
    one = lambda i: F.when(i % 2 == 1, digit(i)).otherwise(digit(i) * 2 - F.when(digit(i) > 4, 9).otherwise(0))
    return F.aggregate(F.transform(places, one), F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{IP_PART}\.{IP_PART}\.{IP_PART}\.{IP_PART}$")
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.length(digits)
    if kind == "card":
        return F.when(n.between(16, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


def matches(text: Column, kind: str) -> Column:
    """Array of a kind's matches in order: kind's number, place in the order, characters between it and the one before, match, and what stands before and behind."""
    rx = PATTERNS.get(kind, RUN)
    pieces, found = F.split(text, rx, -1), F.regexp_extract_all(text, F.lit(rx), F.lit(0))
    zipped = F.arrays_zip(found.alias("m"), pieces.alias("p"), F.slice(pieces, F.lit(2), F.size(found)).alias("q"), F.concat(F.array(F.lit("")), found).alias("b"))

    def one(x: Column, i: Column) -> Column:
        before = F.substring(F.concat(F.substring(x["b"], -CONTEXT, CONTEXT), x["p"]), -CONTEXT, CONTEXT)
        return F.struct(F.lit(KINDS.index(kind)).alias("k"), i.alias("i"), F.length(x["p"]).alias("gap"), x["m"].alias("m"), before.alias("before"), F.substring(x["q"], 1, 1).alias("behind"))

    listed = F.transform(F.filter(zipped, lambda x: x["m"].isNotNull()), one)
    return F.when(text.rlike(HINT[kind]), listed).otherwise(F.expr("cast(array() as array<struct<k:int,i:int,gap:int,m:string,before:string,behind:string>>)"))


def contexts(before: Column, behind: Column) -> Column:
    """The patterns of an instance: the last word and the marks up to it, with the character behind; the last two words."""
    left = F.regexp_replace(F.regexp_replace(F.lower(before), r"[0-9]", "0"), r"\s+", " ")
    one, two = (F.regexp_extract(left, f"({rx})\\z", 1) for rx in (_WORD + _GAP, _WORD + _GAP + _WORD + _GAP))
    marked = F.when(one.rlike(r"[^\p{L}\p{N}_\s]"), F.concat(one, F.lit("\n"), behind))
    return F.filter(F.array(marked, F.when(two != "", two)), lambda x: x.isNotNull())


def _few(table: DataFrame) -> DataFrame:
    """A materialised table, to be broadcast if it is counted to be small."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def score(edges: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confidence: float = CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """edges: pattern, instance, seed (boolean), distinct pairs. Returns (pattern, conf) that are trusted and (instance, score) that are reached by them."""
    scores = good = None
    for _ in range(rounds):
        held = edges if scores is None else edges.join(_few(scores), "instance", "left")
        own = F.lit(0.0) if scores is None else F.coalesce("score", F.lit(0.0))
        held = held.select("pattern", F.when(F.col("seed"), 1.0).otherwise(own).alias("own"))
        patterns = held.groupBy("pattern").agg(F.sum("own").alias("support"), F.avg("own").alias("conf")).filter((F.col("support") >= support) & (F.col("conf") >= confidence))
        before, good = (good, scores), materialise(patterns.select("pattern", "conf"), "pii-patterns")
        wrong = F.exp(F.sum(F.log(F.greatest(1 - F.col("conf"), F.lit(1e-9)))))
        scores = materialise(edges.join(_few(good), "pattern").groupBy("instance").agg((1 - wrong).alias("score")), "pii-scores")
        discard(*(t for t in before if t is not None))
    return good, scores


def annotate(docs: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """doc_id and, of every row, the spans of each base kind and the `found` ones as sorted arrays of (s, e)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("_text")).select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.concat(*(matches(F.col("_text"), k) for k in KINDS)).alias("all"))
    base = materialise(rows, "pii-base")  # from here on uid is fixed

    each = base.filter("size(all) > 0").select("uid", F.explode("all").alias("x")).select("uid", "x.*")
    up_to = Window.partitionBy("uid", "k").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("e", F.sum(F.col("gap") + F.length("m")).over(up_to).cast("int"))
    each = each.withColumn("s", F.col("e") - F.length("m")).withColumn("m", F.when(F.col("k") == KINDS.index("run"), F.rtrim("m", F.lit(".,%+/-"))).otherwise(F.col("m")))
    each = each.withColumn("e", F.col("s") + F.length("m"))
    ok = F.lit(False)
    for k, kind in enumerate(KINDS):
        ok = F.when(F.col("k") == k, valid(kind, F.col("m"))).otherwise(ok)
    each = each.filter(F.coalesce(ok, F.lit(False)) & (F.col("e") > F.col("s")))
    # a run touches a base match if one that begins before it ends behind its start, or one that begins later does so before its end
    is_base = F.col("k") < len(PATTERNS)
    early, late = (Window.partitionBy("uid").orderBy(o).rangeBetween(Window.unboundedPreceding, 0) for o in (F.col("s"), F.desc("s")))
    each = each.withColumn("reach", F.max(F.when(is_base, F.col("e"))).over(early)).withColumn("next", F.min(F.when(is_base, F.col("s"))).over(late))
    apart = F.coalesce(F.col("reach") <= F.col("s"), F.lit(True)) & F.coalesce(F.col("next") >= F.col("e"), F.lit(True))
    each = each.filter(is_base | apart).select("uid", "k", "s", "e", F.xxhash64("m").alias("instance"), (is_base | F.col("m").rlike(KEY)).alias("seed"), F.transform(contexts(F.col("before"), F.col("behind")), lambda x: F.xxhash64(x)).alias("patterns"))
    each = materialise(each, "pii-spans")

    pairs = each.select("uid", "k", "s", "e", "instance", "seed", F.explode("patterns").alias("pattern"))
    edges = materialise(pairs.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "pii-edges")
    good, scores = score(edges, rounds, support, confidence)
    sure = materialise(scores.filter(F.col("score") >= confidence).select("instance"), "pii-sure")
    found = pairs.filter(F.col("k") == KINDS.index("run")).join(_few(sure), "instance").join(_few(good.select("pattern")), "pattern").select("uid", "k", "s", "e").distinct()
    spans = each.filter(is_base).select("uid", "k", "s", "e").unionByName(found)
    by_row = materialise(spans.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("k", "s", "e"))).alias("spans")), "pii-rows")
    discard(each, edges, good, scores, sure)
    out = base.select("uid", "doc_id").join(by_row, "uid", "left")
    of = lambda k: F.transform(F.filter(F.coalesce("spans", F.expr("cast(array() as array<struct<k:int,s:int,e:int>>)")), lambda x: x["k"] == k), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
    return out.select("doc_id", *[of(k).alias(kind if kind in PATTERNS else "found") for k, kind in enumerate(KINDS)])


def _listed(kinds: list[str]) -> Column:
    def named(kind: str) -> Column:
        return F.transform(kind, lambda x: F.concat_ws(":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string")))

    each = [named(k) for k in kinds]
    return F.array_join(F.concat(*each), ",")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts and spans of every row of `docs`; n_found counts what the bootstrap adds, n_spans all."""
    found = annotate(docs)
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in PATTERNS]
    every = [*PATTERNS, "found"]
    total = sum((F.size(k) for k in every), F.lit(0)).cast("long").alias("n_spans")
    return found.select("doc_id", *counts, F.sha2(_listed([*PATTERNS]).cast("binary"), 256).alias("base_sha256"), _listed(every).alias("spans"), F.size("found").cast("long").alias("n_found"), total)
