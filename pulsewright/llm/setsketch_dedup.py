"""Near-duplicate documents: SetSketch registers, banded, jointly estimated, then verified on full sets.

A document's set is its distinct shingles of five words (A-Z lower-cased, words
split at ASCII white space); with fewer words the whole sequence is one
shingle; without words the set is empty and linked with nothing.

*Sketch.* Register i is floor(1 - log_b(e_i)), where e_i is the least of
exponential variates of the set's shingles, cut to 0..2**16-1. Registers of a
union are the larger ones of its parts, and two sets agree in a register about
as often as they are alike. Documents with equal sets are one class and only
its least document goes on.

*Bands.* `ROWS` registers form a band; `BANDS` bands. A pair at the threshold
shares none with probability (1 - 0.75**4)**40 = 2.5e-7. Classes with an
equal band are a bucket.

*Links.* Buckets are not expanded into pairs. First every member of a bucket is
held against its least member; proposals that the joint likelihood of both
sketches puts far below the threshold are dropped and the others are verified on
full sets. Buckets that then lie within one component are done. The documents of
the others get their shingles' frequencies; the `HUBS` members of a bucket whose
shingles are most frequent stand nearest to what the others are copies of, and
are the hubs of the second round. Pairs that are still in different components
are found by an exact prefix filter: in the order from the rarest shingle on, a
linked pair shares one early in both. All pairs that pass it are verified on full sets,
without an estimate before; none within a component is needed. What can be lost, besides
pairs without a band in common: a bucket's least member is no part of the filter, so a linked pair of it that
the likelihood puts under `LEAST_ESTIMATE` (over 5 standard errors off, a chance below 1e-7) and that no
other path joins.

Hubs with very many members are joined as skewed keys of plain tables, which Spark
splits, and verified in parts of `HUB_MEMBERS`.

Rows without an id or without words are linked with nothing; rows that share an id are
one vertex with all their texts; repeated rows are one class; an empty table gives an
empty result; other columns are not read. A long text is one set like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsewright.cluster import BROADCAST_ROWS, discard, materialise, only_rows_of, ship
from pulsewright.llm import textkit as K
from pulsewright.llm.components import components

SHINGLE = 5
PERCENT = 75
ROWS, BANDS = 4, 40
REGISTERS = ROWS * BANDS
#: Base and rate of the registers: 2**16 of them cover all set sizes up to 1e18 and more.
SKETCH_BASE, SKETCH_RATE = 1.001, 20.0
#: Proposals of hubs whose estimate is below this go unverified there (they stay open for the exact filter); at 160 registers it is over 5 standard errors below 0.75.
LEAST_ESTIMATE = 0.55
#: Hubs of a bucket in the second round.
HUBS = 3

_GEN = np.random.Generator(np.random.PCG64(77))
_XOR = _GEN.integers(0, 1 << 63, REGISTERS, dtype=np.uint64)
_MUL = _GEN.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) | np.uint64(1)
_C1, _C2 = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)

SKETCH = "doc_id long, n_shingles long, s1 long, s2 long, registers binary"


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's shingles with repeats, and the rows' offsets into them."""
    low = K.LOWER[data]
    starts, ends, at = K.word_spans(low, offsets, K.NON_SPACE)
    h = K.word_hashes(low, starts, ends)
    n = np.diff(at)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    cut = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(cut[-1], np.uint64)
    grams = K.gram_hashes(h, k)
    ok = K.whole_grams(K.row_of_words(at), k)
    full = np.repeat(n >= k, count)
    out[full] = grams[ok]
    short = np.flatnonzero((n > 0) & (n < k))
    out[~full] = K.span_hash(K.prefix_hash(h), at[short], at[short + 1])
    return out, cut


def registers(x: np.ndarray, cut: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """The m registers of each row's set; rows must not be empty."""
    least = np.empty((m, len(cut) - 1), np.uint64)
    for i in range(m):
        least[i] = np.minimum.reduceat((x ^ _XOR[i]) * _MUL[i], cut[:-1])
    u = (least.astype(np.float64) + 0.5) / 2.0**64
    e = -np.log1p(-np.minimum(u, 1 - 2.0**-53)) / SKETCH_RATE
    return np.clip(np.floor(1 - np.log(e) / np.log(SKETCH_BASE)), 0, 65535).astype(np.uint16).T


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, j, data, offsets in K.chunks(b.column("text")):
            x, cut = shingle_sets(data, offsets)
            parts = [np.unique(x[s:e]) for s, e in zip(cut[:-1], cut[1:], strict=True)]
            n = np.array([len(p) for p in parts])
            x, cut = np.concatenate(parts), np.concatenate([[0], np.cumsum(n)])
            some = np.flatnonzero(n)
            regs = np.zeros((j - i, REGISTERS), np.uint16)
            sums = np.zeros((2, j - i), np.uint64)
            if len(some):
                regs[some] = registers(x, np.append(cut[some], cut[-1]))
                for k, c in enumerate((_C1, _C2)):
                    sums[k, some] = np.add.reduceat(K.mix(x ^ c), cut[some])
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), pa.array([r.tobytes() for r in regs], pa.binary())], list(_names(SKETCH)))


def _names(schema: str) -> Iterator[str]:
    return (x.split()[0] for x in schema.split(", "))


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        regs = np.frombuffer(b"".join(b.column("registers").to_pylist()), np.uint16).reshape(-1, BANDS, ROWS).astype(np.uint64)
        key = np.arange(BANDS, dtype=np.uint64)[None, :] + np.uint64(1)
        for r in range(ROWS):
            key = K.mix(key * K.BASE + regs[:, :, r])
        doc = np.repeat(b.column("doc_id").to_numpy(zero_copy_only=False), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(doc)], ["bucket", "doc_id"])


def joint_estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of sketches of sets of known sizes, from how many registers are larger, smaller and equal."""
    up, down = (a > b).sum(1).astype(float), (a < b).sum(1).astype(float)
    same = a.shape[1] - up - down
    u, v = na / (na + nb), nb / (na + nb)
    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    log_b = np.log(SKETCH_BASE)
    share = (SKETCH_BASE - 1) / SKETCH_BASE

    def p(x):
        return -np.log1p(-np.clip(x, 1e-12, 1) * share) / log_b

    def loglik(j):
        x, y = p(u - v * j), p(v - u * j)
        return up * np.log(x) + down * np.log(y) + same * np.log(np.maximum(1 - x - y, 1e-12))

    for _ in range(30):  # the likelihood is concave: ternary search
        m1, m2 = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        left = loglik(m1) < loglik(m2)
        lo, hi = np.where(left, m1, lo), np.where(left, hi, m2)
    return (lo + hi) / 2


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        ra, rb = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("ra", "rb"))
        na, nb = (b.column(c).to_numpy().astype(float) for c in ("na", "nb"))
        fits = (100 * np.minimum(na, nb) >= PERCENT * np.maximum(na, nb)) & (joint_estimate(ra, rb, na, nb) >= LEAST_ESTIMATE)
        yield b.select(["a", "b"]).filter(pa.array(fits))


#: Members that are held against a hub at one place; a hub of more is sent to several.
HUB_MEMBERS = 64


def _set_of(text: bytes) -> np.ndarray:
    x = np.frombuffer(text, np.uint8)
    return np.unique(shingle_sets(x, np.array([0, len(x)]))[0])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (b, salt, a, text) sorted by b, salt, a: the hub's own rows, without a, come first."""
    held, hubs = None, []
    for batch in batches:
        out: list[tuple[int, int]] = []
        texts = batch.column("text").cast(pa.binary())
        for i, (b, salt, a) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("b", "salt", "a")), strict=True)):
            own = _set_of(texts[i].as_py())
            if a is None:
                hubs = [*hubs, own] if held == (b, salt) else [own]
                held = (b, salt)
                continue
            for hub in hubs if held == (b, salt) else []:
                both = len(np.intersect1d(own, hub, assume_unique=True))
                if 100 * both >= PERCENT * (len(own) + len(hub) - both) > 0:
                    out.append((a, b))
                    break
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])


def _few(table: DataFrame) -> DataFrame:
    """A materialised table, to be broadcast if it is counted to be small."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _linked(proposals: DataFrame, sketch: DataFrame, texts: DataFrame, tag: str, gate: bool = True) -> DataFrame:
    """The verified ones of the proposed pairs (a: member, b: hub): a table. sketch and texts: tables by doc_id.

    Where an id stands for several texts, each of the one is held against each of the
    other, and one link suffices.
    """
    old = []
    if gate:
        of = sketch.select("doc_id", "registers", "n_shingles")
        pairs = proposals.join(of.toDF("a", "ra", "na"), "a").join(of.toDF("b", "rb", "nb"), "b")
        proposals = pairs.mapInArrow(_likely, "a long, b long").distinct()
    likely = materialise(proposals, f"{tag}-likely")
    nodes = materialise(likely.select(F.col("a").alias("doc_id")).union(likely.select("b")).distinct(), f"{tag}-nodes")
    need = materialise(only_rows_of(texts, nodes, ["doc_id"]).distinct(), f"{tag}-texts")
    hubs = materialise(likely.groupBy("b").agg(F.count(F.lit(1)).alias("n")).select("b", F.expr(f"cast(ceil(n / {HUB_MEMBERS}.0) as long)").alias("salts")), f"{tag}-hubs")
    salted = materialise(likely.join(_few(hubs), "b").select("b", F.pmod(F.xxhash64("a"), F.col("salts")).alias("salt"), "a"), f"{tag}-salted")
    members = salted.join(need.toDF("a", "text"), "a").select("b", "salt", "a", "text")
    heads = hubs.join(need.toDF("b", "text"), "b").select("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("a"), "text")
    rows = heads.unionByName(members).repartition("b", "salt").sortWithinPartitions("b", "salt", "a")
    out = materialise(rows.mapInArrow(_verify, "a long, b long").distinct(), f"{tag}-links")
    discard(likely, nodes, need, hubs, salted)
    return out


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, j, data, offsets in K.chunks(b.column("text")):
            x, cut = shingle_sets(data, offsets)
            parts = [np.unique(x[s:e]) for s, e in zip(cut[:-1], cut[1:], strict=True)]
            own = pa.array(np.repeat(np.arange(j - i), [len(p) for p in parts]))
            keys = [b.column(c).slice(i, j - i).take(own) for c in ("doc_id", "rid")]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(np.concatenate(parts).view(np.int64))], ["doc_id", "rid", "shingle"])


def _ranked_shingles(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, rid, shingle, freq, n, pos) of each text of the documents of `nodes`: in how many of them a shingle stands, the set's size, and the shingle's place from the rarest on."""
    rows = only_rows_of(texts, nodes, ["doc_id"]).withColumn("rid", F.xxhash64("doc_id", "text")).dropDuplicates(["doc_id", "rid"])
    shingles = materialise(rows.select("doc_id", "rid", "text").mapInArrow(_shingles, "doc_id long, rid long, shingle long"), "near-shingles")
    freq = materialise(shingles.groupBy("shingle").agg(F.count(F.lit(1)).alias("freq")), "near-freq")
    w = Window.partitionBy("doc_id", "rid")
    out = shingles.join(freq, "shingle").withColumns({"n": F.count(F.lit(1)).over(w), "pos": F.row_number().over(w.orderBy("freq", "shingle")) - 1})
    out = materialise(out, "near-ranked")
    discard(shingles, freq)
    return out


def _prefix_pairs(ranked: DataFrame, comp: DataFrame) -> DataFrame:
    """Pairs of different components that may be linked: an exact prefix filter.

    Sets of sizes n and m that are linked share at least 3/7 (n + m) shingles. So
    in the order from the rarest on, the first shingle that they share stands
    where each of them has that many left. Rows that no size in their shingle's
    group allows go first, then groups of one component.
    """
    own = ["doc_id", "rid"]
    rows = ranked.filter("4 * (n - pos) >= 3 * n").join(comp.toDF("doc_id", "c"), "doc_id", "left").select("shingle", *own, F.coalesce("c", "doc_id").alias("c"), F.col("n").cast("long").alias("n"), F.col("pos").cast("long").alias("pos"))
    sizes = materialise(rows.groupBy("shingle").agg(F.min("n").alias("least_n"), F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("shingle", "least_n"), "near-sizes")
    rows = materialise(rows.join(sizes, "shingle").filter("7 * (n - pos) >= 3 * (n + least_n)").drop("least_n"), "near-prefix")
    mixed = materialise(rows.groupBy("shingle").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("shingle"), "near-mixed")
    left = materialise(rows.join(mixed, "shingle"), "near-prefix")
    discard(sizes, rows, mixed)
    right = left.toDF("shingle", "doc_id_2", "rid_2", "c_2", "n_2", "pos_2")
    fits = "(n > n_2 or n = n_2 and rid > rid_2) and c <> c_2 and 4 * n_2 >= 3 * n and 7 * (n - pos) >= 3 * (n + n_2) and 7 * (n_2 - pos_2) >= 3 * (n + n_2)"
    return left.join(right, "shingle").filter(fits).select(F.col("doc_id").alias("a"), F.col("doc_id_2").alias("b")).distinct()


def _mixed(members: DataFrame, comp: DataFrame) -> DataFrame:
    """The rows of `members` (bucket, doc_id, ...) in buckets that lie in several components, with c, the component."""
    known = members.join(comp.toDF("doc_id", "c"), "doc_id", "left").withColumn("c", F.coalesce("c", "doc_id"))
    known = materialise(known, "near-known")
    mixed = materialise(known.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("bucket"), "near-mixed")
    return known.join(mixed, "bucket")


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sketch, members, links): a row per document; (s1, s2, n_shingles, rep) per set; (node, component) of linked representatives.

    Rows that share a doc_id are one vertex; rows without one are linked with nothing.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    sketch = materialise(rows.mapInArrow(_sketch, SKETCH), "near-sketch")
    known = sketch.filter("doc_id is not null and n_shingles > 0")
    known_members = materialise(known.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("rep")), "near-classes")
    # a vertex that stands for several sets (rows that repeat an id) keeps all of them
    reps = materialise(only_rows_of(known, known_members.select(F.col("rep").alias("doc_id")), ["doc_id"]).dropDuplicates(["doc_id", "s1", "s2"]), "near-reps")
    texts = rows.filter("doc_id is not null")

    buckets = reps.mapInArrow(_bands, "bucket long, doc_id long")
    hubs = materialise(buckets.groupBy("bucket").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("top")).filter("hub < top").select("bucket", "hub"), "near-hubs")
    shared = materialise(buckets.join(hubs.select("bucket"), "bucket").distinct(), "near-buckets")
    proposed = shared.join(hubs, "bucket").filter("doc_id > hub").select(F.col("doc_id").alias("a"), F.col("hub").alias("b")).distinct()
    links = [_linked(proposed, reps, texts, "near-0")]
    comp = materialise(components(links[0]), "near-components")

    rest = shared.join(hubs, "bucket").filter("doc_id > hub").select("bucket", "doc_id")
    rest = materialise(_mixed(rest, comp), "near-open")
    nodes = materialise(rest.select("doc_id").distinct(), "near-rest")
    ranked = _ranked_shingles(nodes, texts)
    weight = ranked.groupBy("doc_id").agg(F.avg("freq").alias("weight"))
    nearest = Window.partitionBy("bucket").orderBy(F.desc("weight"), "doc_id")
    heads = rest.join(weight, "doc_id").withColumn("_r", F.row_number().over(nearest)).filter(F.col("_r") <= HUBS).select("bucket", F.col("doc_id").alias("hub"), F.col("c").alias("hub_c"))
    proposed = rest.join(materialise(heads, "near-heads"), "bucket").filter("c <> hub_c").select(F.col("doc_id").alias("a"), F.col("hub").alias("b")).distinct()
    links.append(_linked(proposed, reps, texts, "near-1"))
    comp = materialise(components(links[0].unionByName(links[1])), "near-components")
    links.append(_linked(_prefix_pairs(ranked, comp), reps, texts, "near-2", gate=False))
    comp = materialise(components(links[0].unionByName(links[1]).unionByName(links[2])), "near-components")
    discard(hubs, shared, rest, nodes, ranked, reps, *links)
    return sketch, known_members, comp


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of `docs`."""
    sketch, members, comp = classes(docs)
    reached = members.join(comp, members["rep"] == comp["node"], "left").select("s1", "s2", F.col("n_shingles").alias("n"), F.coalesce("component", "rep").alias("component"))
    reached = materialise(reached, "near-reached")
    rows = sketch.select("doc_id", "n_shingles", "s1", "s2")
    out = rows.join(reached, (rows["s1"] == reached["s1"]) & (rows["s2"] == reached["s2"]) & (rows["n_shingles"] == reached["n"]) & rows["doc_id"].isNotNull(), "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that are their group's first, one of each doc_id among them; rows without words or doc_id all stay."""
    verdict = materialise(digest(docs), "near-verdict")
    gone = verdict.filter("not kept").select("doc_id").distinct()
    kept = verdict.filter("kept and doc_id is not null and n_shingles > 0")
    again = materialise(kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id").join(gone, "doc_id", "left_anti"), "near-again")
    rows_of = lambda ids, how: docs.join(ids.toDF("_id"), docs["doc_id"].cast("long") == F.col("_id"), how)
    if again.isEmpty():
        return rows_of(gone, "left_anti")
    # only the rows of ids that occur again are shuffled
    worded = F.coalesce("text", F.lit("")).rlike("[^ \\t\\n\\x0B\\f\\r]")
    first = Window.partitionBy("doc_id", worded).orderBy(F.xxhash64("text"), "text")
    one = rows_of(again, "left_semi").withColumn("_r", F.row_number().over(first)).filter((F.col("_r") == 1) | ~worded).drop("_r")
    return rows_of(gone.union(again), "left_anti").unionByName(one)


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws FROM documents
), sh AS (
  SELECT DISTINCT doc_id, md5(array_to_string(ws[p:p + 4], ' ')) AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS p FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
links AS (
  SELECT i.a, i.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2) i
  JOIN n na ON na.doc_id = i.a JOIN n nb ON nb.doc_id = i.b WHERE 100 * k >= 75 * (na.n + nb.n - k)
), e AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM w UNION SELECT e.b, reach.r FROM reach JOIN e ON e.a = reach.doc_id WHERE reach.r < e.b
), c AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
FROM w JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
