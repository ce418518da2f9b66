"""N-gram Jaccard join by multiple-global-order prefix filtering.

A document's set holds the hashes of its distinct 5-word shingles. Under any global order of
tokens, two sets of Jaccard similarity t or more share a token within their prefixes, the
first |A| - ceil(t |A|) + 1 tokens. Three orders are used. The first puts frequent tokens last
and is indexed: prefix postings meet by token, with filters on sizes and positions.
Pairs that also share enough prefix tokens under the second and third order are verified on
the full sets.

Copies and large groups cost no quadratic work: equal sets are one node; a first round links
every posting only to one leader of its token, and after it tokens whose nodes lie in one
component are done. The second round pairs the remaining nodes across components only; there a parity
sketch of each set, met inside the join, bounds the number of differing tokens from below. A
pair is left out only if a filter proves it unlinked, so components are exact.

Frequent tokens are counted over the whole corpus. In a group of edited copies the shared
tokens are frequent, so a member's own tokens come first in its prefix, and members too far
from each other fail the positional filter without being paired. What is broadcast is
bounded: HOT_TOKENS tokens and a BLOOM_BITS filter; so beyond about HOT_DF * HOT_TOKENS tokens
the floor from which a token counts as frequent rises in proportion to the corpus, and tokens
below it stand in hash order. Shuffled postings travel as packed arrays by token range, the
number of ranges growing with the corpus; those of a token in more than SALT_DF documents are
dealt to several groups by node. Texts are parsed anew in each pass, as their sets are larger
than themselves. Every table written on the way is deleted when the last step that reads it is
done.

Defined results: null or blank text has an empty set and is its own component; very long texts
count whole; rows that repeat or share a doc_id count one by one; the component is the smallest non-null doc_id in it, null
only if it has none; extra columns are ignored; an empty table gives an empty result. Sets are
compared by 64-bit hashes of shingles and of sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U, cut, drop, mix64, release, small_batches, table, tidy, utf8, word_hashes
from .components import connected_components

N = 5
NUM, DEN = 3, 4  # threshold 0.75
HOT_TOKENS = 1 << 22  # bound on tokens known as frequent
EARLY = 4  # early common tokens asked for before a pair is looked at
HOT_DF = 32  # least document frequency of one
SALT_DF = 1 << 12  # postings of one token aimed at for one group
BLOOM_BITS = 1 << 24
FLUSH = 1 << 18  # tokens packed together by a task
RANGE_TOKENS = 1 << 20  # tokens aimed at for one range
RANGE_BITS = 10  # least number of ranges

SKETCH = [f"b{i}" for i in range(8)]  # columns of a set's parity sketch, 64 bits each

_MULT = mix64(np.arange(101, 101 + N, dtype=U)) | U(1)


def _lower(b: np.ndarray) -> np.ndarray:
    return np.where((b >= 65) & (b <= 90), b + 32, b).astype(np.uint8)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the N-word shingles; of the whole if words are fewer."""
    if not text:
        return np.zeros(0, U)
    w = word_hashes(_lower(utf8(text)))
    if not len(w):
        return w
    k = min(len(w), N)
    h = np.zeros(len(w) - k + 1, U)
    for i in range(k):
        h += w[i : len(w) - k + 1 + i] * _MULT[i]
    return np.unique(mix64(h + U(k)))


def set_hash(s: np.ndarray) -> int:
    """One 64-bit hash of a set, as a signed long."""
    with np.errstate(over="ignore"):
        h = mix64(np.array([mix64(s ^ U(0x5851F42D4C957F2D)).sum(dtype=U) + mix64(s).sum(dtype=U) * U(3) + U(len(s))], U))
    return int(h.view(np.int64)[0])


def sketch(s: np.ndarray) -> np.ndarray:
    """Parity of the number of tokens in each of 64 * len(SKETCH) buckets, as signed longs. The
    sketches of two sets differ in no more bits than the sets differ in tokens."""
    odd = np.bincount((s & U(64 * len(SKETCH) - 1)).astype(np.int64), minlength=64 * len(SKETCH)) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def prefix_size(n: int) -> int:
    return n - -(-NUM * n // DEN) + 1


def other_prefix(s: np.ndarray, order: int) -> np.ndarray:
    """Distinct 32-bit digests of the prefix under another order."""
    k = np.sort(mix64(s ^ U(order * 0x9E3779B97F4A7C15 & (2**64 - 1))))[: prefix_size(len(s))]
    return np.unique(mix64(k).view(np.int64).astype(np.int32))


def range_shift(tokens: int) -> int:
    """How far tokens are shifted to give their range, for about RANGE_TOKENS tokens a range."""
    return 64 - max(RANGE_BITS, (tokens // RANGE_TOKENS + 1).bit_length())


def _by_range(r: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple]:
    """Columns, sorted by r, cut where r changes: (r, packed columns)."""
    cuts = np.flatnonzero(np.diff(r)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(r)], strict=True):
        if b > a:
            yield int(r[a]), *(c[a:b].tobytes() for c in columns)


def set_table(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n, node and SKETCH for every document, written to scratch."""

    @F.pandas_udf(", ".join(f"{c} long" for c in ("n", "node", *SKETCH)))
    def measure(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            sets = [shingles(t) for t in texts]
            bits = np.array([sketch(s) for s in sets], np.int64).reshape(-1, len(SKETCH))
            yield pd.DataFrame({"n": [len(s) for s in sets], "node": [set_hash(s) for s in sets]} | dict(zip(SKETCH, bits.T, strict=True)))
        tidy()

    text = F.col("text").cast("string")
    got = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), measure(text).alias("m"))
    return cut(got.select("doc_id", "text_hash", "m.n", "m.node", *(f"m.{b}" for b in SKETCH)), "sets")


def frequent_tokens(docs: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens in more documents than a floor that keeps their number within HOT_TOKENS, sorted, and
    in how many groups each one's postings are dealt. Counted over all documents."""
    floor = max(HOT_DF, total // HOT_TOKENS + 1)
    shift = U(range_shift(total))

    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pd.DataFrame:
            t, c = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            once, many = c == 1, c > 1
            rows = [(r, x, b"") for r, x in _by_range(t[once] >> shift, [t[once]])]
            rows += _by_range(t[many] >> shift, [t[many], c[many].astype(np.int64)])
            return pd.DataFrame(rows, columns=["r", "t", "c"])

        for p in parts:
            for text in p["text"]:
                s = shingles(text)
                if len(s):
                    held.append(s)
                    size += len(s)
                if size >= FLUSH:
                    yield flush()
                    size = 0
        if held:
            yield flush()
        held.clear()
        tidy()

    def count(p: pd.DataFrame) -> pd.DataFrame:
        t = np.concatenate([np.frombuffer(x, U) for x in p["t"]])
        c = np.concatenate([np.frombuffer(y, np.int64) if y else np.ones(len(x) // 8, np.int64) for x, y in zip(p["t"], p["c"], strict=True)])
        order = np.argsort(t, kind="stable")
        t, c = t[order], c[order]
        first = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
        df = np.add.reduceat(c, first)
        hot = df > floor
        return pd.DataFrame({"t": t[first][hot].view(np.int64), "df": df[hot]})

    hot = docs.select("text").mapInPandas(pack, "r long, t binary, c binary").groupBy("r").applyInPandas(count, "t long, df long")
    got = hot.toArrow()
    t = got["t"].to_numpy().astype(np.int64).view(U)
    groups = (got["df"].to_numpy() // SALT_DF + 1).astype(np.int32)
    order = np.argsort(t)
    return t[order], groups[order]


def postings(docs: DataFrame, hot: np.ndarray, groups: np.ndarray, total: int) -> DataFrame:
    """token, node, n, pos: the prefixes under the first order, of tokens in two nodes or more (of
    tokens whose postings are dealt to several groups, all)."""
    sc = docs.sparkSession.sparkContext
    several = groups > 1
    shared = sc.broadcast((hot, hot[several], groups[several]))
    shift = U(range_shift(total // 4))

    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hot, spread, deal = shared.value
        held: list[tuple[np.ndarray, int, int]] = []
        size = 0

        def flush() -> pd.DataFrame:
            length = np.array([len(x[0]) for x in held])
            t = np.concatenate([x[0] for x in held])
            node = np.repeat(np.array([x[1] for x in held], np.int64), length)
            n = np.repeat(np.array([x[2] for x in held], np.int32), length)
            pos = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
            held.clear()
            r = (t >> shift).astype(np.int64)
            if len(spread):  # groups of their own below 0, so that they never mix with whole tokens
                at = np.minimum(np.searchsorted(spread, t), len(spread) - 1)
                own = np.flatnonzero(spread[at] == t)
                part = node[own].view(U) % deal[at[own]].astype(U)
                r[own] = -1 - (mix64(t[own] + part) >> U(2)).astype(np.int64)
            order = np.lexsort((t, r))
            columns = [t[order], node[order], n[order], pos[order].astype(np.int32)]
            return pd.DataFrame(list(_by_range(r[order], columns)), columns=["r", "t", "d", "n", "p"])

        seen: set[int] = set()
        for p in parts:
            for text in p["text"]:
                s = shingles(text)
                if not len(s) or (node := set_hash(s)) in seen:
                    continue  # an equal set before it in this flush
                seen.add(node)
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
                    is_hot = hot[at] == s
                    s = np.concatenate([s[~is_hot], s[is_hot]])
                held.append((s[: prefix_size(len(s))], node, len(s)))
                size += len(held[-1][0])
                if size >= FLUSH:
                    yield flush()
                    seen.clear()
                    size = 0
        if held:
            yield flush()
        held.clear()
        tidy()

    def meet(p: pa.Table) -> pa.Table:
        def joined(c: str, kind: type) -> np.ndarray:
            return np.concatenate([np.frombuffer(x, kind) for x in p[c].to_pylist()])

        t, d, n, pos = joined("t", U), joined("d", np.int64), joined("n", np.int32), joined("p", np.int32)
        order = np.lexsort((d, t))
        t, d, n, pos = t[order], d[order], n[order], pos[order]
        own = np.append(True, (t[1:] != t[:-1]) | (d[1:] != d[:-1]))
        t, d, n, pos = t[own], d[own], n[own], pos[own]
        near = t[1:] == t[:-1]
        keep = np.append(near, False) | np.append(False, near) | (p["r"][0].as_py() < 0)
        return pa.table({"token": t[keep].view(np.int64), "node": d[keep], "n": n[keep], "pos": pos[keep]})

    packed = docs.select("text").mapInPandas(pack, "r long, t binary, d binary, n binary, p binary")
    return cut(packed.groupBy("r").applyInArrow(meet, "token long, node long, n int, pos int"), "postings")


def _least_common(na: Column, nb: Column) -> Column:
    """The least intersection of two linked sets of these sizes."""
    return F.ceil(NUM * (na + nb) / F.lit(NUM + DEN))


def _must_share(na: Column, nb: Column) -> Column:
    """Common prefix tokens of a linked pair: all common tokens up to the end of the
    shorter-reaching prefix lie in both prefixes."""
    return _least_common(na, nb) - F.ceil(NUM * F.greatest(na, nb) / F.lit(DEN)) + 1


def _met(a: DataFrame, b: DataFrame, also: Column) -> DataFrame:
    """Distinct pairs u < v whose postings a and b meet. Sizes must fit. The k-th common token of a
    linked pair leaves room for all but k - 1 of its least intersection; so at least EARLY
    tokens, or all that the prefixes must share if fewer, meet with room for all but EARLY - 1."""
    na, nb = F.col("a.n"), F.col("b.n")
    sizes = DEN * F.least(na, nb) >= NUM * F.greatest(na, nb)
    room = F.least(na - F.col("a.pos"), nb - F.col("b.pos"))
    early = (NUM + DEN) * (room + EARLY - 1) >= NUM * (na + nb)
    met = a.alias("a").join(b.alias("b"), (F.col("a.token") == F.col("b.token")) & also & sizes & early)
    u, v = F.least(F.col("a.node"), F.col("b.node")), F.greatest(F.col("a.node"), F.col("b.node"))
    met = met.select(u.alias("u"), v.alias("v"), _must_share(na, nb).alias("must"))
    pairs = met.groupBy("u", "v").agg(F.count(F.lit(1)).alias("k"), F.first("must").alias("must"))
    return pairs.filter(F.col("k") >= F.least(F.col("must"), F.lit(EARLY))).select("u", "v")


def leader_pairs(post: DataFrame) -> DataFrame:
    """Every posting with its token's leader: the node whose own tokens are the most shared, as
    the original of a group of edited copies is. Other leaders would cost pairs, not links."""
    shared = cut(post.groupBy("token").agg(F.count(F.lit(1)).alias("df")), "token-df")
    weight = post.join(shared, "token").groupBy("node", "n").agg(F.sum("df").alias("w"))
    weight = cut(weight.select("node", (F.col("w") / F.col("n")).alias("w")), "node-weights")
    rated = cut(post.join(weight, "node"), "rated")
    drop(shared, weight)
    lead = cut(rated.groupBy("token").agg(F.max(F.struct("w", "node", "n", "pos")).alias("l")), "leaders")
    pairs = cut(_met(rated, lead.select("token", "l.*"), F.col("a.node") != F.col("b.node")), "leader-pairs")
    drop(rated, lead)
    return pairs


def _near_sketches() -> Column:
    """Whether the sketches of a and b differ in no more bits than linked sets differ in tokens."""
    na, nb = F.col("a.n"), F.col("b.n")
    differ = F.lit(0)
    for c in SKETCH:
        differ = differ + F.bit_count(F.col(f"a.{c}").bitwiseXOR(F.col(f"b.{c}")))
    return differ <= na + nb - 2 * _least_common(na, nb)


def crossing_pairs(post: DataFrame, comps: DataFrame, tried: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of different components that share a posted token, without those tried before and
    those whose sketches differ too much."""
    labelled = cut(post.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "labelled")
    mixed = labelled.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x < y").select("token")
    mixed = cut(mixed, "mixed")
    kept = cut(labelled.join(mixed, "token"), "mixed-postings")
    drop(labelled, mixed)
    bits = cut(sets.groupBy("node").agg(*(F.first(b).alias(b) for b in SKETCH)), "sketches")
    sketched = cut(kept.join(bits, "node"), "sketched-postings")
    drop(kept, bits)
    met = _met(sketched, sketched, (F.col("a.comp") < F.col("b.comp")) & _near_sketches())
    crossing = cut(met.join(tried, ["u", "v"], "left_anti"), "crossing")
    drop(sketched)
    return crossing


def full_sets(docs: DataFrame, sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, s (the set), p2, p3 (prefixes under the other orders) of the given nodes. A bounded
    Bloom filter over text hashes keeps other documents from being parsed; its false hits are
    joined away."""
    spark = docs.sparkSession
    texts = sets.join(nodes, "node").groupBy("node").agg(F.min("text_hash").alias("h"))
    bit = F.expr(f"shiftleft(1L, cast(pmod(h, {BLOOM_BITS}) & 63 as int))")
    words = texts.groupBy(F.shiftright(F.pmod("h", F.lit(BLOOM_BITS)), 6).alias("w")).agg(F.bit_or(bit).alias("b"))
    got = words.toArrow()
    bloom = np.zeros(BLOOM_BITS // 64, np.int64)
    bloom[got["w"].to_numpy()] = got["b"].to_numpy()
    shared = spark.sparkContext.broadcast(bloom)

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value.view(U)
        seen: set[int] = set()

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            def lists(k: int, kind: pa.DataType) -> pa.ListArray:
                ends = np.cumsum([0, *(len(r[k]) for r in rows)])
                return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([r[k] for r in rows]), kind))

            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), lists(1, pa.int64()), lists(2, pa.int32()), lists(3, pa.int32())], ["node", "s", "p2", "p3"])

        for p in parts:
            held, size = [], 0
            k = p["h"].to_numpy(zero_copy_only=False) % BLOOM_BITS
            wanted = words[k >> 6] >> (k & 63).astype(U) & U(1)
            for i in np.flatnonzero(wanted):
                s = shingles(p["text"][int(i)].as_py())
                node = set_hash(s)
                if not len(s) or node in seen:
                    continue
                seen.add(node)
                held.append((node, s.view(np.int64), other_prefix(s, 2), other_prefix(s, 3)))
                size += len(s)
                if size >= FLUSH:
                    yield batch(held)
                    held, size = [], 0
            if held:
                yield batch(held)
        tidy()

    text = F.col("text").cast("string")
    rows = docs.select(F.xxhash64(text).alias("h"), text.alias("text")).mapInArrow(read, "node long, s array<long>, p2 array<int>, p3 array<int>")
    rows = rows.join(nodes, "node", "left_semi").dropDuplicates(["node"])
    return cut(rows.withColumn("n", F.size("s").cast("long")), "full-sets")


def verified(docs: DataFrame, measured: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs u, v whose sets pass the other orders' prefix filters and reach the threshold."""
    nodes = cut(pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct(), "nodes")
    sets = full_sets(docs, measured, nodes)

    def side(name: str, *columns: str) -> DataFrame:
        return sets.select(F.col("node").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in columns))

    light = ("p2", "p3", "n")
    both = pairs.join(side("v", *light), "v").join(side("u", *light), "u")
    bound = _must_share(F.col("u_n"), F.col("v_n"))

    def enough(p: str) -> Column:
        """Whether the prefixes share `bound` tokens; digests that coincide are made up for."""
        merged = F.lit(0)
        for x in ("u", "v"):
            n = F.col(f"{x}_n")
            merged = merged + n - F.ceil(NUM * n / F.lit(DEN)) + 1 - F.size(f"{x}_{p}")
        return F.size(F.array_intersect(f"u_{p}", f"v_{p}")) + merged >= bound

    passed = cut(both.filter(enough("p2") & enough("p3")).select("u", "v"), "passed")
    both = passed.join(side("v", "s"), "v").join(side("u", "s"), "u")
    common = F.size(F.array_intersect("u_s", "v_s"))
    union = F.size("u_s") + F.size("v_s") - F.col("c")
    links = cut(both.withColumn("c", common).filter(DEN * F.col("c") >= NUM * union).select("u", "v"), "links")
    drop(nodes, passed)
    release(sets, docs.sparkSession)
    return links


def linked_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n (set size), comp for every row of docs: rows with a word are linked, over
    any number of steps, if and only if their comp is equal."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text")
    sets = set_table(docs)
    total = int(sets.agg(F.sum("n")).first()[0] or 0)
    if total:
        hot, groups = frequent_tokens(docs, total)
        release(None, spark)
        post = postings(docs, hot, groups, total)
        release(None, spark)
        tried = leader_pairs(post)
        links = verified(docs, sets, tried)
        fresh = crossing_pairs(post, connected_components(links), tried, sets)
        drop(tried)
        release(post, spark)
        if not fresh.isEmpty():
            links = links.unionByName(verified(docs, sets, fresh))
        drop(fresh)
        comps = cut(connected_components(links), "components")
        release(links, spark)
    else:
        comps = sets.limit(0).select("node", F.col("node").alias("comp"))
    return sets.join(comps, "node", "left").select("doc_id", "text_hash", "n", F.coalesce("comp", "node").alias("comp"))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text)."""
    rows = cut(linked_rows(docs).select("doc_id", "n", "comp"), "named")
    least = cut(rows.filter("n > 0").groupBy("comp").agg(F.min("doc_id").alias("component_id")), "least")
    out = rows.filter("n > 0").join(least, "comp").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.unionByName(rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: All pairs that share a shingle, and all paths; for small tables.
ORACLE = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), w AS (
  SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d
), g AS (
  SELECT rid, concat_ws(chr(1), w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o) AS s,
         lead(w, 4) OVER o AS fifth
  FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)
), s AS (
  SELECT DISTINCT rid, s FROM g WHERE fifth IS NOT NULL
  UNION ALL SELECT rid, array_to_string(ws, chr(1)) FROM d WHERE len(ws) BETWEEN 1 AND 4
), n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
i AS (
  SELECT a.rid AS a, b.rid AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.rid < b.rid GROUP BY ALL
), l AS (
  SELECT a, b FROM i JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), e AS (SELECT a AS u, b AS v FROM l UNION ALL SELECT b, a FROM l),
r AS (
  SELECT rid AS u, rid AS v FROM d UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u
), least_id AS (SELECT u, min(doc_id) AS component_id FROM r JOIN d ON d.rid = r.v GROUP BY u)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
FROM d JOIN least_id ON least_id.u = d.rid LEFT JOIN n ON n.rid = d.rid
"""
