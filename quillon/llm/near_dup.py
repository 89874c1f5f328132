"""Near-duplicates by bottom-k sketches and inverted lists (operator 5).

One hash function orders all shingles; a document retains its k smallest (its sketch). Documents
with equal shingle sets are one from here on. Each retained value has an inverted list. Of a
document's values only its rarest stand in lists: documents that are similar enough share at
least `shared` of k values (but for a chance below 1e-8), so they meet in a list even if each
leaves out all but its k - shared + 1 rarest. Documents that meet in a list longer than a block
meet by the rarest of WIDE retained values instead, so that a passage that very many documents
hold lists only those it makes up almost whole. A list that is still longer is dealt into blocks
of bounded size, with one member in each. Within a block, documents of nearly one size are compared by the estimate
from the union's sketch, in memory, and a spanning set of the pairs that pass goes on to be
verified on the full shingle sets. Of lists with the same members, as copies bring them about, one
is kept, since each row of a list takes a sketch along. A second round compares all that the verified links have
left apart: a list's documents outside its main component meet every block, in turns of a
block's size. Links end as
connected components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._common import bounded, buckets, release, row_key, settle, texts_columns, trim
from quillon.llm._shingle import by_bytes, mix, shingles, utf8
from quillon.llm.components import stars

_U = np.uint64
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Retained values; values by which pairs within a list are estimated; documents in a block.
K, WIDE, BLOCK = 32, 256, 1024


@lru_cache
def least_shared(k: int, percent: int) -> int:
    """How many of the k smallest values of their union two sets of that similarity share, but for
    a chance of 1e-8: each value is a draw, in both sets or not."""
    p, below, t = percent / 100, 0.0, 0
    while True:
        below += comb(k, t) * p**t * (1 - p) ** (k - t)
        if below > 1e-8:
            return t
        t += 1


@lru_cache
def least_retained(n: int, percent: int, k: int = K) -> int:
    """How many retained values a set of n <= k shares at least with any set that is similar enough.

    A partner of more than k hashes drops all but its k smallest; each one dropped may be shared.
    Where that leaves less than least_shared(), its chance of 1e-8 holds as for larger sets.
    """
    least = -(-n * percent // 100)
    for m in range(k + 1, 100 * n // percent + 1):
        common = -(-percent * (n + m) // (100 + percent))
        least = min(least, max(common - (m - k), least_shared(k, percent)))
    return least


def _signature(h: np.ndarray) -> bytes:
    """128 bits that equal sets share."""
    with np.errstate(over="ignore"):
        return np.array([mix(h).sum(dtype=_U), mix(h ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U)], "<u8").tobytes()


def _sketch(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in by_bytes(batch, 1, 500_000):
                g, off = shingles(*utf8(b.column(1)), words)
                sets = [g[i:j] for i, j in zip(off, off[1:])]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(2), pa.array(np.diff(off)), pa.array([_signature(s) for s in sets], pa.binary()), pa.array([s[:K].tobytes() for s in sets], pa.binary())],
                    names=["doc_id", "row_key", "n", "sig", "sketch"],
                )
        trim()

    return run


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each retained value: (sig, n, value)."""
    for batch in batches:
        for at in range(0, len(batch), 512):
            b = batch.slice(at, 512)
            v = [np.frombuffer(x, np.int64) for x in b.column(2).to_pylist()]
            of = pa.array(np.repeat(np.arange(len(b)), [len(x) for x in v]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(of), b.column(1).take(of), pa.array(np.concatenate([np.zeros(0, np.int64), *v]))], names=["sig", "n", "value"])


class Members:
    """The members of a bucket's lists, with the smallest WIDE hashes of each one's set."""

    def __init__(self, n: np.ndarray, sketches: list[bytes], percent: int):
        self.n, self.percent, self.whole, self.least = n, percent, n <= WIDE, least_shared(WIDE, percent)
        self.s = np.full((len(n), WIDE), NONE, _U)
        for i, x in enumerate(sketches):
            v = np.frombuffer(x, _U)[:WIDE]
            self.s[i, : len(v)] = v

    def near_size(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return 100 * np.minimum(self.n[i], self.n[j]) >= self.percent * np.maximum(self.n[i], self.n[j])

    def passes(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether pairs are similar: exactly if both sets are whole, else by the union's sketch."""
        out = self.near_size(i, j)
        todo = np.flatnonzero(out)
        for at in range(0, len(todo), 1000):
            k = todo[at : at + 1000]
            both = np.sort(np.concatenate([self.s[i[k]], self.s[j[k]]], 1), 1)
            twice = np.zeros(both.shape, bool)
            twice[:, 1:] = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != NONE)
            rank = np.cumsum(~twice & (both != NONE), 1)
            whole, size = self.whole[i[k]] & self.whole[j[k]], rank[:, -1]
            common = (twice & (rank <= np.where(whole, size, WIDE)[:, None])).sum(1)
            out[k] = np.where(whole, 100 * common >= self.percent * size, common >= self.least)
        return out

    def overlaps(self, a: int, b: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For rows of a list's members [a, b), the hashes they share with each of its members."""
        s = self.s[a:b]
        flat = s.ravel()
        row = np.repeat(np.arange(b - a), WIDE)[flat != NONE]
        values, inverse, count = np.unique(flat[flat != NONE], return_inverse=True, return_counts=True)
        column = np.cumsum(count > 1) - 1
        use = count[inverse] > 1
        row, col = row[use], column[inverse[use]]
        width, step = int((count > 1).sum()), 2048
        got = np.zeros((b - a, b - a), np.float32)
        for c in range(0, width, step):
            m = np.zeros((b - a, min(step, width - c)), np.float32)
            ok = (col >= c) & (col < c + step)
            m[row[ok], col[ok] - c] = 1
            got += m @ m.T
        for at in range(0, b - a, 256):
            yield np.arange(a + at, min(b, a + at + 256)), got[at : at + 256].astype(np.int32)


def _forest(u: np.ndarray, v: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of links u-v (u in order) those that join different labels, which it joins in place."""
    us, vs = [], []
    edges = np.flatnonzero(np.append(True, u[1:] != u[:-1])) if len(u) else []
    for at, end in zip(edges, np.append(edges[1:], len(u)) if len(u) else []):
        i, x = u[at], v[at:end]
        other, first = np.unique(label[x], return_index=True)
        ok = other != label[i]
        if ok.any():
            us += [i] * int(ok.sum())
            vs += x[first[ok]].tolist()
            label[np.isin(label, other[ok])] = label[i]
    return np.array(us, np.int64), np.array(vs, np.int64)


def _block(t: pd.DataFrame, percent: int, settled: bool) -> pd.DataFrame:
    """Candidate pairs of the lists in a bucket; `sure` where both sets were compared in whole.

    At first, for each list, links enough to span what looks alike. Once components are known
    (settled), every pair that passes across components; of whole sets, which are compared
    exactly, only those of documents that are asked in a further block.
    """
    keys = ["value", "block"]
    if settled:
        keys += ["turn"]
        t = t.sort_values("asked", ascending=False)
    t = t.sort_values([*keys, "sig"], kind="stable").drop_duplicates([*keys, "sig"])
    m = Members(t["n"].to_numpy(np.int64), t["sketch"].tolist(), percent)
    key = t[keys].to_numpy()
    value = key[:, 0]
    new = np.ones(len(t), bool)
    new[1:] = (key[1:] != key[:-1]).any(1)
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(t))
    label = pd.factorize(t["root"])[0] if settled else np.arange(len(t))
    asked = t["asked"].to_numpy(bool) if settled else np.zeros(len(t), bool)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    size = end - start
    for few in (2, 3, 4):
        a = start[size == few]
        for d in range(few):
            for e in range(d + 1, few):
                i, j = a + d, a + e
                ok = label[i] != label[j]
                if settled:  # in a list of one block, whole sets are through
                    ok &= ~(m.whole[i] & m.whole[j]) | asked[i] | asked[j]
                i, j = i[ok], j[ok]
                hit = m.passes(i, j)
                found.append((i[hit], j[hit]))
    sure = WIDE * 92 // 100
    for a, b in zip(start[size > 4], end[size > 4]):
        lab = label[a:b]
        if (lab == lab[0]).all() or settled and m.whole[a:b].all() and not asked[a:b].any():
            continue
        later: list = []
        for rows, common in m.overlaps(a, b):
            i = rows[:, None]
            j = np.arange(a, b)[None, :]
            ok = (i < j) & (label[i] != label[j]) & m.near_size(i, j)
            both = m.whole[i] & m.whole[j]
            exact = 100 * common >= percent * (m.n[i] + m.n[j] - common)
            if settled:
                ok &= np.where(both, exact & (asked[i] | asked[j]), common >= m.least)
                x, y = np.nonzero(ok)
                x, y = rows[x], y + a
                hit = m.passes(x, y)
                found.append((x[hit], y[hit]))
                continue
            x, y = np.nonzero(ok & np.where(both, exact, common >= sure))
            found.append(_forest(rows[x], y + a, label))
            x, y = np.nonzero(ok & ~both & (common >= m.least) & (common < sure))
            later.append((rows[x].astype(np.int32), (y + a).astype(np.int32)))
        for x, y in later:
            ok = label[x] != label[y]
            x, y = x[ok], y[ok]
            hit = m.passes(x, y)
            found.append(_forest(x[hit], y[hit], label))
    u, v = (np.concatenate([np.zeros(0, np.int64), *w]).astype(np.int64) for w in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
    if settled and len(u):
        # A pair that lists of one block bring together several times goes out from the first.
        firsts = [np.zeros(0, np.int64) if x is None else np.asarray(x, np.int64) for x in t["firsts"]]
        own = np.full((len(t), max(map(len, firsts), default=0)), NONE, _U)
        for k, x in enumerate(firsts):
            own[k, : len(x)] = x.view(_U)
        keep = np.ones(len(u), bool)
        for at in range(0, len(u), 10_000):
            x, y = u[at : at + 10_000], v[at : at + 10_000]
            both = np.sort(np.concatenate([own[x], own[y]], 1), 1)
            twice = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != NONE)
            if twice.shape[1]:
                first = np.where(twice.any(1), both[np.arange(len(x)), twice.argmax(1)], NONE)
                keep[at : at + 10_000] = (first == NONE) | (first >= value[x].astype(np.int64).view(_U))
        u, v = u[keep], v[keep]
    # The same documents stand in several lists of the bucket.
    code, names = pd.factorize(t["sig"])
    whole = np.zeros(len(names), bool)
    whole[code] = m.whole
    x, y = code[u], code[v]
    low, high = np.minimum(x, y), np.maximum(x, y)
    pair = np.unique(low * len(names) + high)
    low, high = pair // max(1, len(names)), pair % max(1, len(names))
    x, y = names[low], names[high]
    trim()
    swap = x > y
    return pd.DataFrame({"u": np.where(swap, y, x), "v": np.where(swap, x, y), "sure": whole[low] & whole[high]})


def _verify(pairs: DataFrame, full: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """The pairs (u, v) that are similar enough: those that are sure, and of the others those whose
    full shingle sets, which `full` makes for the signatures asked for, say so."""
    sure, doubt = pairs.where("sure").select("u", "v"), pairs.where("NOT sure")
    if doubt.isEmpty():
        return sure
    sets = full(doubt.select(F.col("u").alias("sig")).unionAll(doubt.select(F.col("v").alias("sig"))).distinct())
    joined = doubt.join(sets.select(F.col("sig").alias("u"), F.col("hashes").alias("a")), "u")
    joined = joined.join(sets.select(F.col("sig").alias("v"), F.col("hashes").alias("b")), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v, a, b = (batch.column(c) for c in ("u", "v", "a", "b"))
            ok = []
            for x, y in zip(a, b):
                x, y = (np.frombuffer(z.as_buffer(), _U) for z in (x, y))
                at = np.searchsorted(y, x)
                common = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0
                ok.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([u, v, pa.array(ok)], names=["u", "v", "ok"])
        trim()

    return sure.unionAll(joined.mapInArrow(run, "u binary, v binary, ok boolean").where("ok").select("u", "v"))


def _lists(kept: DataFrame, k: int, percent: int) -> DataFrame:
    """(sig, n, weight, value, df): of sets (sig, n, sketch of their k smallest hashes), the inverted
    lists that each must stand in: those of its rarest values, as many as similar sets could leave
    unshared and one more. Values that no other set retains have no list."""
    held = kept.select("sig", "n", "sketch").mapInArrow(_values, "sig binary, n long, value long")
    often = held.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    own = held.join(often, "value").groupBy("sig", "n").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("lists"))
    size = F.least("n", F.lit(k))
    small = F.array(*(F.lit(least_retained(n, percent, k)) for n in range(1, k + 1)))
    least = F.when(F.col("n") <= k, F.element_at(small, size.cast("int"))).otherwise(least_shared(k, percent))
    # Values without a list are rarest of all and count first.
    take = size - least + 1 - (size - F.size("lists"))
    listed = own.withColumn("take", take.cast("int")).where("take > 0")
    weight = F.aggregate("lists", F.lit(0).cast("long"), lambda a, x: a + x["df"])
    listed = listed.select("sig", "n", weight.alias("weight"), F.explode(F.slice("lists", F.lit(1), F.col("take"))).alias("x"))
    return listed.select("sig", "n", "weight", F.col("x.value").alias("value"), F.col("x.df").alias("df"))


def _distinct(listed: DataFrame) -> DataFrame:
    """One each of the lists that have the same members, and none of a single member: the others
    bring no further pairs together. df becomes the number of members."""
    each = listed.groupBy("value").agg(F.count(F.lit(1)).alias("members"), F.bit_xor(F.xxhash64("sig")).alias("a"), F.bit_xor(F.xxhash64(F.lit(1), "sig")).alias("b"))
    chosen = each.where("members > 1").groupBy("members", "a", "b").agg(F.min("value").alias("value"))
    return listed.drop("df").join(chosen.select("value", F.col("members").alias("df")), "value")


def near_duplicates(docs: DataFrame, *, percent: int = 85, words: int = 5, with_key: bool = False) -> DataFrame:
    """Links documents with 100 * shared shingles >= percent * shingles in their union.

    Returns doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself
    included) and kept (doc_id = component_id); with_key also row_key (see _common) and `first`,
    true for the rows of one doc_id and text of each component. Words are runs of other than
    white space with A-Z in lower case; a document with fewer than `words` has its whole sequence
    as one shingle. A null, empty or blank text has no shingles and links with nothing, so it is
    kept. Repeated texts and repeated rows link as equal sets; rows that repeat a doc_id with
    other texts are linked by their texts alone and may lie in different components. A null
    doc_id takes its component's smallest doc_id (null if there is none).
    """
    spark = docs.sparkSession
    base = docs.select(*texts_columns(docs), row_key().alias("row_key"))
    rows = settle(base.mapInArrow(_sketch(words), "doc_id long, row_key long, n long, sig binary, sketch binary"))
    lead = F.min(F.struct(F.isnull("doc_id").alias("no"), "doc_id", "row_key"))
    reps = settle(rows.where("n > 0").groupBy("sig").agg(F.first("n").alias("n"), lead.alias("lead"), F.count(F.lit(1)).alias("copies"), F.first("sketch").alias("sketch")))

    listed = settle(_lists(reps, K, percent))
    release(spark)
    sketches = _sets(base, reps, listed.select("sig").distinct(), words, WIDE).withColumnRenamed("hashes", "sketch")
    full = lambda asked: _sets(base, reps, asked, words)
    release(spark)
    # Documents that meet in a list of several blocks share a passage at least; they meet again by
    # the rarest of their WIDE values, counted among such documents, instead.
    crowded = listed.where(F.col("df") > BLOCK).select("sig").distinct()
    crowded = settle(reps.select("sig", "n").join(crowded, "sig", "left_semi").join(sketches, "sig"))
    if not crowded.isEmpty():
        again = _lists(crowded, WIDE, percent).withColumn("value", F.xxhash64("value", F.lit(WIDE)))
        listed = settle(listed.where(F.col("df") <= BLOCK).unionByName(again))
    listed = settle(_distinct(listed))
    release(spark)
    deal = buckets(spark, listed.count(), 2_500)
    blocks = F.ceil(F.col("df") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("sig"), blocks).cast("int")

    # One member of a list that has several blocks stands in each.
    top = listed.where(F.col("df") > BLOCK).groupBy("value").agg(F.max_by(F.struct("sig", "n", "df"), F.struct("weight", "sig")).alias("p"))
    top = top.select("p.sig", "p.n", "value", "p.df").withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    first = listed.drop("weight").withColumn("block", block).unionByName(top)

    def candidates(t: DataFrame, settled: bool) -> DataFrame:
        more = ["root", "asked", "turn", "firsts"] if settled else []
        keys = ["value", "block", *(["turn"] if settled else [])]
        t = t.join(sketches, "sig").select("value", "block", "sig", "n", "sketch", *more).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(deal)))
        return t.groupBy("bucket").applyInPandas(lambda x: _block(x, percent, settled), "u binary, v binary, sure boolean").distinct()

    pairs, roots = settle(candidates(first, False)), None
    release(spark)
    if not pairs.isEmpty():
        links = settle(_verify(pairs, full, percent))
        roots = settle(stars(links))
        # Only lists that the links leave in more than one component; of those that have several
        # blocks, the documents outside the main component meet every block, in turns of a bounded
        # number. Any two documents that still lie apart are then compared, so no third round can
        # find more.
        rooted = listed.drop("weight").join(roots.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
        apart = rooted.groupBy("value", "root").agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("largest"))
        apart = apart.groupBy("value").agg(F.count(F.lit(1)).alias("roots"), F.max("c").alias("most"), F.max_by("root", F.struct("c", "root")).alias("main"), F.max("largest").alias("largest"), F.sum("c").alias("members"))
        # A list of one block whose sets are all whole is through: the first round was exact there.
        apart = apart.where((F.col("roots") > 1) & ((F.col("largest") > WIDE) | (F.col("members") > BLOCK)))
        apart = apart.select("value", "main", F.ceil((F.col("members") - F.col("most")) / BLOCK).cast("int").alias("turns"))
        rooted = settle(rooted.join(apart, "value").withColumn("asked", F.lit(False)).withColumn("block", block))
        if not rooted.isEmpty():
            firsts = listed.where(F.col("df") <= BLOCK).groupBy("sig").agg(F.collect_list("value").alias("firsts"))
            rooted = rooted.join(firsts, "sig", "left")
            several = F.col("df") > BLOCK
            out = rooted.where(several & (F.col("root") != F.col("main"))).withColumn("asked", F.lit(True))
            out = out.withColumn("turn", F.pmod(F.xxhash64("sig", F.lit(1)), "turns").cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
            every = rooted.withColumn("turn", F.explode(F.when(several, F.sequence(F.lit(0), F.col("turns") - 1)).otherwise(F.array(F.lit(0)))))
            more = settle(candidates(out.unionByName(every), True).join(pairs, ["u", "v"], "left_anti"))
            good = settle(_verify(more, full, percent))
            if not good.isEmpty():
                roots = settle(stars(links.unionAll(good)))
    release(spark)

    group = reps.select("sig", "lead")
    if roots is not None:
        group = group.join(roots.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
        group = group.join(group.groupBy("root").agg(F.min("lead").alias("lowest")), "root").select("sig", F.col("lowest").alias("lead"))
    named = rows.drop("sketch").join(group, "sig", "left")
    component = F.when(F.col("n") > 0, F.col("lead.doc_id")).otherwise(F.col("doc_id"))
    out = [F.col("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")]
    chosen = (F.col("n") == 0) | F.col("doc_id").eqNullSafe(F.col("lead.doc_id")) & (F.col("row_key") == F.col("lead.row_key"))
    return named.select(*out, *([F.col("row_key"), chosen.alias("first")] if with_key else []))


def _sets(base: DataFrame, reps: DataFrame, asked: DataFrame, words: int, most: int | None = None) -> DataFrame:
    """The shingle sets behind the signatures asked for, or their smallest hashes: (sig, hashes)."""
    several = F.col("copies") > 1
    need = settle(reps.join(asked, "sig", "left_semi").select(F.col("lead.doc_id").alias("wanted"), F.col("lead.row_key").alias("wanted_key"), "sig", several.alias("several")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in by_bytes(batch, 0, 500_000):
                g, off = shingles(*utf8(b.column("text")), words)
                sets = [g[i:j] for i, j in zip(off, off[1:])]
                fits = [_signature(s) == x for s, x in zip(sets, b.column("sig").to_pylist())]
                mask = pa.array(fits, pa.bool_())
                yield pa.RecordBatch.from_arrays([b.column("sig").filter(mask), b.column("several").filter(mask), pa.array([s[:most].tobytes() for s, ok in zip(sets, fits) if ok], pa.binary())], names=["sig", "several", "hashes"])
        trim()

    picked = base.join(bounded(need), (F.col("row_key") == F.col("wanted_key")) & F.col("doc_id").eqNullSafe(F.col("wanted")))
    made = settle(picked.select("text", "sig", "several").mapInArrow(run, "sig binary, several boolean, hashes binary"))
    # Only rows that repeat both doc_id and text can come out twice.
    again = settle(made.where("several").select("sig", "hashes").dropDuplicates(["sig"]))
    return made.where("NOT several").select("sig", "hashes").unionAll(again)
