"""Near-duplicate detection with HyperMinHash signatures.

Each document's set of word shingles is reduced to ``M`` registers. A register keeps, of the smallest hash that falls
into its bucket, the number of leading zeros and ``MANTISSA`` bits after the leading one. Buckets that no shingle falls
into borrow from the first filled bucket of a fixed random order. Bands of registers propose candidates, a
collision-corrected Jaccard estimate thins them, and full shingle sets confirm them.

Candidates stay linear in the input although a group of near copies may hold a third of all rows: documents with equal
sets are first folded into one representative, and a bucket compares each member with one leader, the member that the
most other documents share buckets with. Members that share a bucket but end in different components, whatever became of
their comparisons with leaders, form the second round: their full sets are ordered by how few of these members have a
shingle, and of a pair at the threshold the first shingles (``prefix``) of both have one in common. So members are
compared that share such a shingle and whose registers agree enough; passages that many texts share come last in the
order and propose nobody. All pairs that share a bucket and reach the threshold are compared or known to be connected.

Empty texts (null, no words) have an empty set and are linked with nothing. Repeated rows of one id count once; if their
texts differ, the one with the fewest shingles, of those the one whose set's hash is least.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pairloom.llm.bloom import among
from pairloom.llm.textvec import Words, chunks, map_batches, mix
from pairloom.operators.graph import connected_components
from pairloom.storage import materialise

#: Registers, bits of mantissa, bands and registers a band. A pair at 0.8 shares no band once in 20 million times.
M, MANTISSA, BANDS, ROWS = 128, 10, 32, 4
#: Pairs whose estimate is lower by this much than the threshold are not verified: seven standard deviations.
SLACK = 0.25
#: The estimate says little about smaller sets, which are verified without it.
SMALL_SET = 64
#: Members that have a shingle in common and are compared at once with as many others.
BLOCK = 512

_U = np.uint64
_PROBES = np.array([np.random.default_rng(7 + i).permutation(M) for i in range(M)])
_BAND_SEEDS = np.random.default_rng(11).integers(1, 2**62, BANDS).astype(_U)
_LOW_EXP = 1022


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a chunk."""
    words = Words(data, offs)
    grams = words.grams(k)
    for s, e in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist()):
        if e - s >= k:
            yield np.unique(grams[s : e - k + 1])
        elif e > s:
            whole = words.hash[s:e]
            yield np.array([mix(np.add.reduce(mix(whole, 1) * (np.arange(1, e - s + 1, dtype=_U) * _U(2) + _U(1)), keepdims=True), e - s)[0]], _U)
        else:
            yield np.zeros(0, _U)


def registers(shingles: np.ndarray) -> np.ndarray:
    """The compressed registers of a non-empty sorted set; every register is filled."""
    out = np.zeros(M, np.uint16)
    bucket = (shingles >> _U(57)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    rest = (shingles[first] << _U(7)).astype(np.float64)
    # A double's exponent counts the leading zeros, and its first fraction bits are those after the leading one.
    code = (rest.view(_U) >> _U(52 - MANTISSA)).astype(np.int64) - (_LOW_EXP << MANTISSA)
    out[bucket[first]] = np.maximum(code, 1) & 0xFFFF
    empty = np.flatnonzero(out == 0)
    if len(empty):
        probes = _PROBES[empty]
        out[empty] = out[probes[np.arange(len(empty)), (out != 0)[probes].argmax(1)]]
    return out


def bands(regs: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band."""
    quad = regs[: BANDS * ROWS].astype(_U).reshape(BANDS, ROWS)
    return mix(quad[:, 0] | quad[:, 1] << _U(16) | quad[:, 2] << _U(32) | quad[:, 3] << _U(48), 0) * (_BAND_SEEDS * _U(2) + _U(1)) ^ _BAND_SEEDS


def collision_rate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The chance that registers of two unrelated sets of sizes ``a`` and ``b`` agree."""
    zeros = np.arange(1, 40)[:, None]

    def share(n: np.ndarray) -> np.ndarray:
        n = np.maximum(n / M, 1.0)
        return (1 - 2.0**-zeros) ** n - (1 - 2.0 ** (1 - zeros)) ** n

    return (share(a) * share(b)).sum(0) / 2**MANTISSA


def jaccard_estimate(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """From rows of registers and set sizes, corrected for accidental agreement."""
    c = collision_rate(nx.astype(float), ny.astype(float))
    return ((x == y).mean(1) - c) / (1 - c)


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """``doc_id, n_shingles, k1, k2, bands, regs``: k1 and k2 identify the set; bands and regs are null if it is empty."""
    schema = "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>, regs binary"

    def run(batches):
        for batch in batches:
            for at, to, data, offs in chunks(batch.column(1)):
                n, k1, k2, band, reg = [], [], [], [], []
                for s in shingle_sets(data, offs, k):
                    n.append(len(s))
                    for keys, key in zip((k1, k2), _keys(s)):
                        keys.append(key)
                    r = registers(s) if len(s) else None
                    reg.append(None if r is None else r.tobytes())
                    band.append(None if r is None else bands(r).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, to - at), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(band, pa.list_(pa.int64())), pa.array(reg, pa.binary())],
                    ["doc_id", "n_shingles", "k1", "k2", "bands", "regs"],
                )

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, schema)


def _keys(s: np.ndarray) -> tuple[int, int]:
    """128 bits that identify a set."""
    return (int(np.add.reduce(mix(s, 3)).astype(np.int64)), int(np.add.reduce(mix(s, 5)).astype(np.int64))) if len(s) else (0, 0)


def _sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """``rep, sh``: the sets of the documents ``wanted(doc_id, k1, k2)``, as sorted 64-bit values.

    Documents are chosen by the worker that reads them: a second one beside it would stay for all that follows.
    """
    some = among(wanted.select("doc_id"))

    def run(batches):
        for batch in map(some, batches):
            for at, to, data, offs in chunks(batch.column(1)):
                sets = list(shingle_sets(data, offs, k))
                keys = [_keys(s) for s in sets]
                columns = [batch.column(0).slice(at, to - at), *(pa.array([x[i] for x in keys], pa.int64()) for i in (0, 1)), pa.array([s.tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "k1", "k2", "sh"])

    found = map_batches(docs.select("doc_id", "text"), run, "doc_id long, k1 long, k2 long, sh binary")
    found = found.join(wanted.select("doc_id", "k1", "k2"), ["doc_id", "k1", "k2"], "left_semi")
    return materialise(found.select(F.col("doc_id").alias("rep"), "sh"), "sets")


def _estimated(pairs: DataFrame, sigs: DataFrame, least: float) -> DataFrame:
    """The pairs that may reach the threshold."""
    a = sigs.select(F.col("doc_id").alias("x"), F.col("regs").alias("rx"), F.col("n_shingles").alias("nx"))
    b = sigs.select(F.col("doc_id").alias("y"), F.col("regs").alias("ry"), F.col("n_shingles").alias("ny"))
    rows = pairs.join(a, "x").join(b, "y").where(F.least("nx", "ny") >= F.greatest("nx", "ny") * least).select("x", "y", "rx", "ry", "nx", "ny")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                regs = [np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, M) for i in (2, 3)]
                nx, ny = batch.column(4).to_numpy(), batch.column(5).to_numpy()
                keep = (jaccard_estimate(*regs, nx, ny) >= least - SLACK) | (np.minimum(nx, ny) <= SMALL_SET)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["x", "y"]).filter(pa.array(keep))

    return rows.mapInArrow(run, "x long, y long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``x, y, linked``."""
    rows = pairs.join(sets.select(F.col("rep").alias("x"), F.col("sh").alias("sx")), "x").join(sets.select(F.col("rep").alias("y"), F.col("sh").alias("sy")), "y").select("x", "y", "sx", "sy")

    def run(batches):
        for batch in batches:
            linked = []
            for p, q in zip(batch.column(2), batch.column(3)):
                p, q = np.frombuffer(p.as_buffer(), _U), np.frombuffer(q.as_buffer(), _U)
                at = np.searchsorted(q, p)
                at[at == len(q)] = 0
                inter = int((q[at] == p).sum())
                linked.append(100 * inter >= percent * (len(p) + len(q) - inter))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], ["x", "y", "linked"])

    return map_batches(rows, run, "x long, y long, linked boolean")


def prefix(n: Column, percent: int) -> Column:
    """How many first shingles, in any order common to all, a set of ``n`` can't have all to itself if it has a link."""
    return n - F.ceil(n * percent / 100) + 1


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """``x, bk, at``: the shared ones among the first shingles of each set, by ascending number of the sets that have them,
    with their place. Shingles of one set alone come first and are only counted."""
    rows = sets.mapInArrow(_unpacked, "x long, n long, sh array<long>")
    long = rows.select("x", "n", F.explode("sh").alias("bk"))
    seen = materialise(long.groupBy("bk").agg(F.count("*").alias("c")).where("c > 1"), "seen")
    shared = long.join(seen, "bk").groupBy("x", "n").agg(F.array_sort(F.collect_list(F.struct("c", "bk"))).alias("s"))
    own = F.col("n") - F.size("s")
    most = prefix(F.col("n"), percent) - own
    return shared.where(most > 0).select("x", own.alias("own"), F.posexplode(F.slice("s", F.lit(1), most.cast("int"))["bk"]).alias("at", "bk")).select("x", "bk", (F.col("own") + F.col("at")).alias("at"))


def _unpacked(batches):
    for batch in batches:
        sets = [np.frombuffer(v.as_buffer(), np.int64) for v in batch.column(1)]
        n = np.array([len(x) for x in sets], np.int64)
        flat = np.concatenate([np.zeros(0, np.int64), *sets])
        for at in range(0, len(sets), 100):
            to = min(at + 100, len(sets))
            offs = np.r_[0, np.cumsum(n[at:to])]
            own = flat[n[:at].sum() : n[:to].sum()]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(n[at:to]), pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(own))], ["x", "n", "sh"])


def _crossing(band: DataFrame) -> DataFrame:
    """``bk, x, component, at, i, j, side``: a group for each two blocks of a key's members that are to be compared.

    ``band(bk, x, component, at)``. Members of the key's largest component are never compared among themselves, so the
    work grows with the number of the others. Blocks j below zero are those of the largest component.
    """
    count = band.groupBy("bk", "component").agg(F.count("*").alias("n"))
    tops = count.groupBy("bk").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("c"))
    tops = tops.select("bk", F.col("top.component").alias("top"), F.ceil(F.col("top.n") / BLOCK).alias("nb"), F.ceil((F.col("c") - F.col("top.n")) / BLOCK).alias("nr")).where("nr > 0")
    rows = band.join(tops, "bk").withColumn("main", F.col("component") == F.col("top"))
    rows = rows.withColumn("b", F.pmod(F.xxhash64("x"), F.when(F.col("main"), F.col("nb")).otherwise(F.col("nr"))))
    b, none, last = F.col("b"), F.lit(0).cast("long"), F.col("nr") - 1
    main = F.transform(F.sequence(none, last), lambda i: F.struct(i.alias("i"), (-1 - b).alias("j"), F.lit(True).alias("side")))
    other = F.transform(
        F.sequence(-F.col("nb"), last),
        lambda j: F.struct(F.when(j < 0, b).otherwise(F.least(b, j)).alias("i"), F.when(j < 0, j).otherwise(F.greatest(b, j)).alias("j"), ((j >= 0) & (j < b)).alias("side")),
    )
    return rows.select("bk", "x", "component", "at", F.explode(F.when(F.col("main"), main).otherwise(other)).alias("g")).select("bk", "x", "component", "at", "g.*")


def _across(band: DataFrame, sigs: DataFrame, least: float) -> DataFrame:
    """``x, y``: pairs of different components that share a key of ``band(bk, x, component, at)`` and may reach the threshold.

    If a shingle is the first that two sets share, they share no more than either has from there on (``at``). Registers
    that agree by accident only add to the agreement, so it can stand for the estimate.
    """
    rows = _crossing(band).join(sigs.select(F.col("doc_id").alias("x"), F.col("n_shingles").alias("n"), "regs"), "x")

    def run(group: pa.Table) -> pa.Table:
        x, comp, n, side, place = (group.column(c).to_numpy() for c in ("x", "component", "n", "side", "at"))
        left = n - place
        regs = np.frombuffer(b"".join(group.column("regs").to_pylist()), np.uint16).reshape(-1, M)
        own = group.column("i")[0].as_py() == group.column("j")[0].as_py()
        p, q = np.flatnonzero(~side), np.flatnonzero(side)
        q = p if own else q
        found = [np.zeros((0, 2), np.int64)]
        for at in range(0, len(p), 64):
            a = p[at : at + 64, None]
            enough = np.minimum(left[a], left[q]) * (1 + least) >= least * (n[a] + n[q]) - 1e-6
            u, v = np.nonzero((comp[a] != comp[q]) & enough)
            u, v = a[u, 0], q[v]
            if own:
                u, v = u[u < v], v[u < v]
            for k in range(0, len(u), 16384):
                s, t = u[k : k + 16384], v[k : k + 16384]
                keep = ((regs[s] == regs[t]).mean(1) >= least - SLACK) | (np.minimum(n[s], n[t]) <= SMALL_SET)
                found.append(np.column_stack([x[s[keep]], x[t[keep]]]))
        pairs = np.sort(np.concatenate(found), 1)
        return pa.table({"x": pairs[:, 0], "y": pairs[:, 1]})

    return rows.groupBy("bk", "i", "j").applyInArrow(run, "x long, y long").distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, rep`` for each id of ``docs(doc_id, text)``.

    Two documents are linked if 100 * |A & B| >= percent * |A | B| for their sets of distinct k-word shingles, of words
    with A-Z in lower case; a text of fewer words is one shingle. ``component_id`` is the smallest id reachable over
    links, ``rep`` the smallest with an equal set.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    sigs = materialise(signatures(docs, k), "signatures")
    if not sigs.groupBy("doc_id").count().where("count > 1").isEmpty():
        least = sigs.groupBy("doc_id").agg(F.min(F.struct("n_shingles", "k1", "k2", "bands", "regs")).alias("s"))
        sigs = materialise(least.select("doc_id", "s.*"), "signatures")
    some = sigs.where("n_shingles > 0")
    # Tables of their own, so that a join on a hot key reads plain shuffles, which Spark splits when it runs.
    ids = materialise(some.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("rep")), "ids")
    member = materialise(some.select("doc_id", "n_shingles", "k1", "k2").join(ids, ["k1", "k2", "n_shingles"]).select("doc_id", "rep"), "members")
    reps = some.join(ids.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")

    band = reps.select(F.col("doc_id").alias("x"), F.explode("bands").alias("bk"))
    shared = materialise(band.groupBy("bk").agg(F.count("*").alias("c")).where("c > 1"), "shared")
    band = materialise(band.join(shared, "bk"), "bands")
    fame = band.groupBy("x").agg(F.sum("c").alias("fame"))
    leads = materialise(band.join(fame, "x").groupBy("bk").agg(F.max(F.struct("fame", (-F.col("x")).alias("m"))).alias("top")).select("bk", (-F.col("top.m")).alias("y")), "leads")
    pairs = band.join(leads, "bk").select("x", "y").where("x <> y").distinct()
    least = percent / 100
    pairs = materialise(_estimated(pairs, reps, least), "pairs")

    wanted = reps.join(pairs.select("x").union(pairs.select("y")).distinct().select(F.col("x").alias("doc_id")), "doc_id", "left_semi")
    checked = materialise(_verified(pairs, _sets(docs, wanted, k), percent), "checked")
    links = checked.where("linked").select("x", "y")
    comps = materialise(connected_components(links, "x", "y"), "components")

    # Members of a bucket that are in different components. The leader has met them all.
    named = comps.select(F.col("node").alias("x"), "component")
    left = band.join(leads, "bk").where("x <> y").select("bk", "x").join(named, "x", "left").select("bk", "x", F.coalesce("component", "x").alias("component"))
    split = left.groupBy("bk").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("bk")
    again = materialise(left.join(split, "bk", "left_semi").select("x", "component").distinct(), "again")
    if not again.isEmpty():
        sets = _sets(docs, reps.join(again.select(F.col("x").alias("doc_id")), "doc_id", "left_semi"), k)
        keys = materialise(_prefixes(sets, percent).join(again, "x"), "prefixes")
        done = checked.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
        across = materialise(_across(keys, reps, least).join(done, ["x", "y"], "left_anti"), "across")
        more = materialise(_verified(across, sets, percent).where("linked").select("x", "y"), "more")
        comps = materialise(connected_components(links.union(more), "x", "y"), "components")

    # The smallest id of a component is a representative, since representatives are the smallest of their sets.
    found = member.join(comps.select(F.col("node").alias("rep"), "component"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component_id"), "rep")
    out = sigs.select("doc_id", "n_shingles").join(found, "doc_id", "left")
    own = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", own.alias("component_id"), (F.col("doc_id") == own).alias("kept"), F.coalesce("rep", "doc_id").alias("rep"))
