"""Job logs that say nearly the same: an exact n-gram Jaccard join in vertical fragments.

A log is its set of word shingles. The global order of shingles, that of their hashes, is cut into
fragments; each fragment counts what it sees of every overlap, and the counts are summed per log or
per pair. Fragments are as many as their size asks for, so each fits a task at any scale.

What is asked is which logs hang together by links of similarity, so pairs are looked at only between
groups that are not yet known to hang together:

1. Logs with equal sets are one class from the start.
2. A link needs three quarters of a class's shingles in some other class. The fragments count, for every
   class, how many of its shingles occur in another; most classes end here.
   What is left is looked at by size bands from here on, for sets of unlike size cannot be linked.
3. Star rounds: every shingle of the remaining classes points at one holder, the class with the largest
   share of shingles that others have too, as an original has among its edited copies. A fragment counts, per
   class and holder, the shingles that point there. Summed, that is a lower bound of the overlap, and links it
   proves join groups. Step 2 follows again, for groups in place of classes.
4. When a round no longer closes a good part of what is open, the rest is laid out so that neighbours come to lie together, and cut
   into blocks. Blocks with a rare shingle in common are compared: fragments of the order count the overlaps of all their
   classes at once, as products of 0-1 matrices, and the counts are summed.

Shingles that tasks see in several groups are not shuffled per holder: a task settles what it can among its
own rows and sends one row per shingle. So neither a passage that a third of all logs share
nor a large group of copies meets in one task, and no group emits all of its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facetlake.llm.words import grams, mix, slices, words
from facetlake.operators.components import components
from facetlake.operators.ordering import running_sum
from facetlake.session import drop_stored, materialize, scratch

SHINGLE = 5
#: Links need 100 * overlap >= 75 * union.
PERCENT = 75
#: Shingles of a fragment, about.
FRAGMENT = 1_500_000
#: Star rounds go on while they leave at most this share of the classes open.
CLOSING = 0.8
#: Shingles and classes of a block of neighbours, and shingles of a fragment of their comparison.
BLOCK_TOKENS, BLOCK_ROWS, COLUMNS = 200_000, 512, 4096
#: Shingles a task handles at a time.
CHUNK = 500_000


def shingle_sets(data: np.ndarray, off: np.ndarray, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text, lower-cased (A-Z); a shorter text is one shingle."""
    found = words(data, off, lower=True)
    every = grams(found.hash, size)
    out = []
    for lo, hi in zip(found.first[:-1], found.first[1:], strict=True):
        if hi - lo >= size:
            out.append(np.unique(every[lo : hi - size + 1]))
        elif hi > lo:
            out.append(grams(found.hash[lo:hi], int(hi - lo), 100 + int(hi - lo)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _digest(tokens: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a set; the first names its class."""
    with np.errstate(over="ignore"):
        a = mix(np.array([mix(tokens + np.uint64(1)).sum(dtype=np.uint64) + np.uint64(len(tokens))], np.uint64))[0]
        b = mix(tokens ^ np.uint64(0x5BD1E995)).sum(dtype=np.uint64)
    return int((a | np.uint64(1)).astype(np.int64)), int(b.astype(np.int64))


def _summaries(logs: DataFrame) -> DataFrame:
    """``job_id log_key n owner check`` of every log; ``owner`` and ``check`` name its class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in slices(batch, "log"):
                sets = shingle_sets(data, off)
                digests = [_digest(s) for s in sets]
                columns = [[len(s) for s in sets], [d[0] for d in digests], [d[1] for d in digests]]
                yield pa.RecordBatch.from_arrays(
                    [part.column("job_id"), part.column("log_key"), *(pa.array(c, pa.int64()) for c in columns)], ["job_id", "log_key", "n", "owner", "check"]
                )

    return logs.mapInArrow(run, "job_id long, log_key long, n long, owner long, check long")


# ---- how many shingles of each owner occur in another group -------------------------------------------


_NOTES = "frag long, kind int, tokens binary, owners binary, groups binary, runs binary"


def _notes(tokens: np.ndarray, row: np.ndarray, owner: np.ndarray, group: np.ndarray, bits: int) -> tuple[list[tuple], np.ndarray, np.ndarray]:
    """What a task tells the fragments of its rows' shingles, its own counts, and the second owner of each row.

    A shingle that the task sees in several groups is settled: it counts for all of its rows, and the fragment only
    learns of it. One that several rows of a single group have is told once, under an owner of their
    group; a row's count is then its own and that owner's, at most too high.
    """
    order = np.argsort(tokens, kind="stable")
    t, r = tokens[order], row[order]
    start = np.flatnonzero(np.append(True, t[1:] != t[:-1])) if len(t) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(t)))
    g = group[r]
    least, most = (np.minimum.reduceat(g, start), np.maximum.reduceat(g, start)) if len(t) else (g, g)
    settled = least != most
    local = np.bincount(r[np.repeat(settled, size)], minlength=len(owner))
    with np.errstate(over="ignore"):
        salt = mix(np.array([owner.view(np.uint64).sum(dtype=np.uint64)]))[0]
        second = (mix(group.view(np.uint64) ^ salt) | np.uint64(1)).view(np.int64)
    single = ~settled
    entry_token = np.concatenate((t[start[single]], t[start[settled]], t[start[settled]]))
    whose = np.where(size[single] == 1, owner[r[start[single]]], second[r[start[single]]]) if len(t) else owner[:0]
    nobody = np.zeros(int(settled.sum()), np.int64)
    entry_owner = np.concatenate((whose, nobody, nobody))
    entry_group = np.concatenate((least[single], least[settled], most[settled]))
    frag = (entry_token >> np.uint64(64 - bits)).astype(np.int64)
    low = ((entry_token << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
    order = np.lexsort((entry_group, entry_owner, frag))
    frag, low, entry_owner, entry_group = frag[order], low[order], entry_owner[order], entry_group[order]
    rows = []
    edge = np.flatnonzero(np.append(True, np.diff(frag) != 0)) if len(frag) else []
    for lo, hi in zip(edge, np.append(edge[1:], len(frag)), strict=True) if len(frag) else []:
        o, c = entry_owner[lo:hi], entry_group[lo:hi]
        new = np.flatnonzero(np.append(True, (np.diff(o) != 0) | (np.diff(c) != 0)))
        runs = np.diff(np.append(new, hi - lo)).astype(np.int32)
        rows.append((int(frag[lo]), 0, low[lo:hi].tobytes(), o[new].tobytes(), c[new].tobytes(), runs.tobytes()))
    return rows, local, second


_NOTE_SCHEMA = pa.schema([("frag", pa.int64()), ("kind", pa.int32()), *[(n, pa.binary()) for n in ("tokens", "owners", "groups", "runs")]])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema.names)


def _count_fragment(frame: pd.DataFrame) -> pd.DataFrame:
    """Of each owner, how many shingles of this fragment occur in several groups; task counts pass through."""
    out = []
    notes = frame[frame.kind == 0]
    if len(notes):
        token = np.concatenate([np.frombuffer(b, np.uint32) for b in notes.tokens])
        runs = np.concatenate([np.frombuffer(b, np.int32) for b in notes.runs])
        owner = np.repeat(np.concatenate([np.frombuffer(b, np.int64) for b in notes.owners]), runs)
        group = np.repeat(np.concatenate([np.frombuffer(b, np.int64) for b in notes.groups]), runs)
        order = np.argsort(token, kind="stable")
        token, owner, group = token[order], owner[order], group[order]
        start = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        several = np.minimum.reduceat(group, start) != np.maximum.reduceat(group, start)
        number = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(token))))
        keep = several[number] & (owner != 0)
        number, owner = number[keep], owner[keep]
        order = np.lexsort((number, owner))
        number, owner = number[order], owner[order]
        fresh = np.append(True, (np.diff(owner) != 0) | (np.diff(number) != 0)) if len(owner) else np.zeros(0, bool)
        names, counts = np.unique(owner[fresh], return_counts=True)
        out.append(pd.DataFrame({"owner": names, "told": counts, "local": pd.array([None] * len(names), "Int64")}))
    for row in frame[frame.kind == 1].itertuples():
        names = np.frombuffer(row.owners, np.int64)
        out.append(pd.DataFrame({"owner": names, "told": np.zeros(len(names), np.int64), "local": pd.array(np.frombuffer(row.groups, np.int64), "Int64")}))
    return pd.concat(out) if out else pd.DataFrame({"owner": [], "told": [], "local": []})


def _counted(notes: DataFrame) -> DataFrame:
    """``owner told local``: shingles told apart by the fragments, and the least that one task settled."""
    counts = notes.groupBy("frag").applyInPandas(_count_fragment, "owner long, told long, local long")
    return counts.groupBy("owner").agg(F.sum("told").alias("told"), F.min("local").alias("local"))


def _note_logs(logs: DataFrame, bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, off in slices(batch, "log"):
                sets = {_digest(s)[0]: s for s in shingle_sets(data, off) if len(s)}
                if not sets:
                    continue
                owner = np.array(list(sets), np.int64)
                row = np.repeat(np.arange(len(sets)), [len(s) for s in sets.values()])
                rows, local, _ = _notes(np.concatenate(list(sets.values())), row, owner, owner, bits)
                rows.append((int(owner[0]) % (1 << bits), 1, b"", owner.tobytes(), local.astype(np.int64).tobytes(), b""))
                yield _batch(rows, _NOTE_SCHEMA)

    return logs.mapInArrow(run, _NOTES)


def _bits(shingles: float) -> int:
    return max(4, math.ceil(math.log2(max(1.0, shingles / FRAGMENT))))


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch of classes with their shingles and the row of each."""
    n = np.array([len(t.as_buffer()) // 8 for t in batch.column("tokens")], np.int64)
    upto, lo = np.cumsum(n), 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo] - n[lo]) + CHUNK, "right")))
        part = batch.slice(lo, hi - lo)
        yield part, np.concatenate([np.frombuffer(t.as_buffer(), np.uint64) for t in part.column("tokens")]), np.repeat(np.arange(hi - lo), n[lo:hi])
        lo = hi


def _longs(part: pa.RecordBatch, name: str) -> np.ndarray:
    return part.column(name).to_numpy(zero_copy_only=False).astype(np.int64)


def _open(classes: DataFrame, bits: int) -> DataFrame:
    """Classes that could still have a link to another group, by step 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, tokens, row in _chunks(batch):
                owner = _longs(part, "owner")
                rows, local, second = _notes(tokens, row, owner, _longs(part, "group"), bits)
                # The second owner of each class, as a row that only passes through.
                rows.append((int(owner[0]) % (1 << bits), 1, second.tobytes(), owner.tobytes(), local.astype(np.int64).tobytes(), b""))
                yield _batch(rows, _NOTE_SCHEMA)

    notes = materialize(classes.mapInArrow(run, _NOTES), "notes")

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                yield pd.DataFrame({"owner": np.frombuffer(r.owners, np.int64), "second": np.frombuffer(r.tokens, np.int64)})

    counts = materialize(_counted(notes), "counts")
    seconds = notes.filter("kind = 1").select("owners", "tokens").mapInPandas(unpack, "owner long, second long")
    shared = counts.select(F.col("owner").alias("second"), F.col("told").alias("with_group"))
    bound = F.coalesce("told", F.lit(0)) + F.coalesce("local", F.lit(0)) + F.coalesce("with_group", F.lit(0))
    bounds = counts.join(seconds, "owner").join(shared, "second", "left").select("owner", bound.alias("bound"))
    return _still(classes.drop("bound").join(bounds, "owner"))


def _still(counted: DataFrame) -> DataFrame:
    return counted.filter(F.col("bound") * 100 >= F.col("n") * PERCENT)


# ---- star rounds -----------------------------------------------------------------------------------


def _stars(tokens: np.ndarray, row: np.ndarray, rank: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, their stars and how many shingles point there; and where the holder of each shingle stands."""
    order = np.lexsort((rank[row], tokens))
    t, r = tokens[order], row[order]
    start = np.flatnonzero(np.append(True, t[1:] != t[:-1])) if len(t) else np.zeros(0, np.int64)
    star = np.repeat(r[start], np.diff(np.append(start, len(t))))
    far = group[r] != group[star]
    pairs, counts = np.unique(r[far].astype(np.int64) * len(rank) + star[far], return_counts=True)
    return pairs // len(rank), pairs % len(rank), counts, order[start]


def _linked(overlap, na, nb):
    return overlap * 100 >= (na + nb - overlap) * PERCENT


_STAR = pa.schema([("frag", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), *[(n, pa.binary()) for n in ("tokens", "owners", "groups", "sizes", "shares", "runs")]])


def _star_round(classes: DataFrame, turn: int, bits: int) -> DataFrame:
    """Links ``a b`` between groups that one drawing of holders proves."""

    def drawn(owner: np.ndarray, share: np.ndarray) -> np.ndarray:
        """Rank as a holder: shares by steps of a twentieth, then a hash that changes with the turn."""
        return np.argsort(np.lexsort((mix(owner.view(np.uint64) ^ np.uint64(turn * 7919 + 1)), -share)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, tokens, row in _chunks(batch):
                owner, group, n = (_longs(part, c) for c in ("owner", "group", "n"))
                share = np.minimum(_longs(part, "bound") * 20 // n, 20)
                a, b, count, held = _stars(tokens, row, drawn(owner, share), group)
                sure = _linked(count, n[a], n[b])
                rows = [(-1, int(owner[x]), int(owner[y]), b"", b"", b"", b"", b"", b"") for x, y in zip(a[sure], b[sure], strict=True)]
                t, r = tokens[held], row[held]
                frag = (t >> np.uint64(64 - bits)).astype(np.int64)
                order = np.lexsort((r, frag))
                t, r, frag = t[order], r[order], frag[order]
                edge = np.flatnonzero(np.append(True, np.diff(frag) != 0)) if len(frag) else np.zeros(0, np.int64)
                for lo, hi in zip(edge, np.append(edge[1:], len(frag)), strict=True) if len(frag) else []:
                    new = np.flatnonzero(np.append(True, np.diff(r[lo:hi]) != 0))
                    who = r[lo:hi][new]
                    runs = np.diff(np.append(new, hi - lo)).astype(np.int32)
                    rows.append((int(frag[lo]), None, None, t[lo:hi].tobytes(), owner[who].tobytes(), group[who].tobytes(), n[who].tobytes(), share[who].tobytes(), runs.tobytes()))
                if rows:
                    yield _batch(rows, _STAR)

    def fragment(frame: pd.DataFrame) -> pd.DataFrame:
        tokens = np.concatenate([np.frombuffer(b, np.uint64) for b in frame.tokens])
        runs = np.concatenate([np.frombuffer(b, np.int32) for b in frame.runs])
        owners = np.concatenate([np.frombuffer(b, np.int64) for b in frame.owners])
        names, where, row = np.unique(owners, return_index=True, return_inverse=True)
        group = np.concatenate([np.frombuffer(b, np.int64) for b in frame.groups])[where]
        n, share = (np.concatenate([np.frombuffer(b, np.int64) for b in column])[where] for column in (frame.sizes, frame.shares))
        # All fragments draw the same holders, for their order does not depend on what else is here.
        a, b, count, _ = _stars(tokens, np.repeat(row, runs), drawn(names, share), group)
        return pd.DataFrame({"a": names[a], "b": names[b], "na": n[a], "nb": n[b], "overlap": count})

    told = materialize(classes.mapInArrow(run, "frag long, a long, b long, tokens binary, owners binary, groups binary, sizes binary, shares binary, runs binary"), "stars")
    partial = told.filter("frag >= 0").groupBy("frag").applyInPandas(fragment, "a long, b long, na long, nb long, overlap long")
    summed = partial.groupBy("a", "b", "na", "nb").agg(F.sum("overlap").alias("overlap"))
    return told.filter("frag < 0").select("a", "b").unionByName(summed.filter(_linked(F.col("overlap"), F.col("na"), F.col("nb"))).select("a", "b"))


# ---- what is left: blocks of neighbours ------------------------------------------------------------------


def _entries(classes: DataFrame) -> DataFrame:
    """``token owner group n df``: the shingles that several groups of the open classes have."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, tokens, row in _chunks(batch):
                columns = [tokens.view(np.int64), *[_longs(part, c)[row] for c in ("owner", "group", "n")]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["token", "owner", "group", "n"])

    entries = materialize(classes.select("owner", "group", "n", "tokens").mapInArrow(spread, "token long, owner long, group long, n long"), "entries")
    seen = entries.groupBy("token").agg(F.count("*").alias("df"), F.min("group").alias("lo"), F.max("group").alias("hi")).filter("lo < hi")
    return materialize(entries.join(seen.select("token", "df"), "token"), "entries")


def _overlaps(x: list[np.ndarray], y: list[np.ndarray], same: bool, fragment: int = COLUMNS) -> np.ndarray:
    """Shingles that each set of ``x`` shares with each of ``y``: counted in fragments of the order of shingles, and summed."""
    sides = []
    for sets in (x, y):
        tokens = np.concatenate(sets)
        sides.append((tokens, np.repeat(np.arange(len(sets)), [len(s) for s in sets])))
    if same:
        found, often = np.unique(sides[0][0], return_counts=True)
        common = found[often > 1]
    else:
        common = np.intersect1d(sides[0][0], sides[1][0])
    places = []
    for tokens, row in sides:
        at = np.searchsorted(common, tokens)
        held = common[np.minimum(at, len(common) - 1)] == tokens if len(common) else np.zeros(len(tokens), bool)
        order = np.argsort(at[held], kind="stable")
        places.append((at[held][order], row[held][order]))
    total = np.zeros((len(x), len(y)), np.float32)
    for lo in range(0, len(common), fragment):
        parts = []
        for (at, row), sets in zip(places, (x, y), strict=True):
            i, j = np.searchsorted(at, [lo, lo + fragment])
            part = np.zeros((len(sets), min(fragment, len(common) - lo)), np.float32)
            part[row[i:j], at[i:j] - lo] = 1
            parts.append(part)
        total += parts[0] @ parts[1].T
    return total.astype(np.int64)


def _block_pair(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    """Links between the classes of two blocks: of each class one to every group that it is linked with."""
    sides = [frame[frame["block"] == k].sort_values("owner") for k in key]
    sets = [[np.frombuffer(t, np.uint64) for t in side["tokens"]] for side in sides]
    (own_a, group_a, n_a), (own_b, group_b, n_b) = ([side[c].to_numpy() for c in ("owner", "group", "n")] for side in sides)
    shared = _overlaps(*sets, key[0] == key[1])
    a, b = np.nonzero(_linked(shared, n_a[:, None], n_b[None, :]) & (group_a[:, None] != group_b[None, :]))
    _, numbered = np.unique(group_b, return_inverse=True)
    _, first = np.unique(a * len(group_b) + numbered[b], return_index=True) if len(a) else (a, a)
    return pd.DataFrame({"a": own_a[a[first]], "b": own_b[b[first]]})


#: Copies of all open classes that are shuffled at a time when blocks are compared, and shingles at least.
WAVE, WAVE_TOKENS = 2, 1 << 22


def _block_join(classes: DataFrame) -> DataFrame:
    """Enough links between groups among the open classes to join all groups that links join.

    Classes are laid out by their most frequent shingle, so that copies of one original come to lie together, and
    cut into blocks of bounded size. Two blocks are compared if they have a prefix shingle in common: of the shingles that
    a class shares with other groups, one of its rarest must be in any overlap that is large enough. Pairs are made of blocks,
    never of classes; what a task compares is bounded by two blocks.
    """
    spark = classes.sparkSession
    with scratch(spark):
        pairs, block_of = _block_pairs(_entries(classes))
    both = pairs.select("x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))
    sets = classes.select("owner", "group", "n", "tokens").join(block_of, "owner")
    load, size = (df.agg(F.sum("n")).first()[0] or 0 for df in (both.join(sets.groupBy("block").agg(F.sum("n").alias("n")), "block"), classes))
    # Every pair of blocks takes a copy of both, so pairs come in waves: the disk holds a few copies of the classes at a time.
    waves = max(1, math.ceil(load / max(WAVE * size, WAVE_TOKENS)))
    wave = F.pmod(F.xxhash64("x", "y"), F.lit(waves))
    links = None
    for turn in range(waves):
        with scratch(spark):
            told = both.filter(wave == turn).join(sets, "block").groupBy("x", "y").applyInPandas(_block_pair, "a long, b long")
            told = materialize(told, "block_links", keep=True)
        links = told if links is None else links.unionByName(told)
    return links


def _block_pairs(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of blocks to compare, and the block of each class."""
    own = Window.partitionBy("owner")
    place = F.row_number().over(own.orderBy("df", "token"))
    shared = F.count("*").over(own)
    # Of the shingles no other group has, all could be missing from the overlap; the rest of the slack is the prefix.
    length = shared - F.ceil(F.col("n") * PERCENT / 100) + 1
    placed = entries.withColumn("_p", place).withColumn("_l", length).withColumn("_top", F.max(F.struct("df", "token")).over(own))
    prefix = materialize(placed.filter("_p <= _l").select("token", "owner", "group", "n", F.col("_top.token").alias("top")), "prefix")
    least = F.greatest(F.lit(BLOCK_TOKENS // BLOCK_ROWS), F.col("n"))
    laid = running_sum(prefix.select("owner", "n", "top").distinct(), [], ["top", "owner"], least, "_upto")
    block_of = materialize(laid.select("owner", F.floor(F.col("_upto") / BLOCK_TOKENS).cast("long").alias("block")), "blocks", keep=True)
    held = prefix.join(block_of, "owner").groupBy("token", "block").agg(F.min("group").alias("lo"), F.max("group").alias("hi"))
    held = materialize(held, "block_tokens")
    x, y = (held.select("token", *[F.col(c).alias(f"{c}_{s}") for c in ("block", "lo", "hi")]) for s in "xy")
    several = (F.col("block_x") <= F.col("block_y")) & (F.least("lo_x", "lo_y") < F.greatest("hi_x", "hi_y"))
    pairs = x.join(y, "token").filter(several).groupBy("block_x", "block_y").agg(F.count("*").alias("_t"))
    return materialize(pairs.select(F.col("block_x").alias("x"), F.col("block_y").alias("y")), "block_pairs", keep=True), block_of


# ---- all together ------------------------------------------------------------------------------------------


def _banded(texts: DataFrame) -> DataFrame:
    """A row per class and size band: ``owner`` of the row, ``class``, ``group``, ``bound``, ``n``, ``tokens``.

    Linked sets differ in size by a third at most, so size classes of that width put both in one of the two
    bands that each belongs to. Shingles are salted by band: sets of unlike size never meet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in slices(batch, "log"):
                rows = []
                for owner, bound, tokens in zip(part.column("owner").to_pylist(), part.column("bound").to_pylist(), shingle_sets(data, off), strict=True):
                    at = math.floor(math.log(len(tokens)) / math.log(100 / PERCENT))
                    for band in (at, at + 1):
                        salt = mix(np.array([band + 1000], np.uint64))
                        name = int((mix(np.array([owner], np.int64).view(np.uint64) ^ salt) | np.uint64(1)).view(np.int64)[0])
                        rows.append((name, owner, owner, bound, len(tokens), np.sort(mix(tokens ^ salt)).tobytes()))
                if rows:
                    yield _batch(rows, _BANDED)

    return texts.mapInArrow(run, "owner long, class long, group long, bound long, n long, tokens binary")


_BANDED = pa.schema([*[(c, pa.int64()) for c in ("owner", "class", "group", "bound", "n")], ("tokens", pa.binary())])


def _of_classes(links: DataFrame, class_of: DataFrame) -> DataFrame:
    """Links between rows as links between their classes."""
    for end in "ab":
        links = links.join(class_of.select(F.col("owner").alias(end), F.col("class").alias(f"_{end}")), end)
    return links.select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct()


def alike_logs(logs: DataFrame) -> DataFrame:
    """Which job logs are near copies of each other, directly or through others.

    Two logs are linked if 100 times the shingles they share reach 75 times those that either has. Words are
    runs of anything but space, tab and line ends, lower-cased (A-Z); shingles are five words.

    Args:
        logs: ``job_id`` (long) and ``log``; further columns are left out.

    Returns:
        ``job_id``, ``log_key`` (hash of the log), ``n_shingles``, ``alike_id`` (the smallest ``job_id`` reachable by
        links, its own included) and ``group_key``, which names the group and is null without shingles.

    Logs of fewer than five words are one shingle; null logs and logs without words have none and are linked with
    nothing. Repeated rows stay repeated and are linked like any copies; null ids stay null unless linked with others.
    An empty table gives an empty result. Shingles are compared by 64-bit hashes.
    """
    keyed = logs.select(F.col("job_id").cast("long").alias("job_id"), "log", F.xxhash64("log").alias("log_key"))
    known = materialize(_summaries(keyed), "summaries")
    with scratch(logs.sparkSession):
        groups = materialize(_groups(keyed, known), "groups", keep=True)
    named = known.filter("n > 0").select("job_id", "log_key", "n", "owner").join(groups, "owner", "left").withColumn("group", F.coalesce("group", "owner"))
    least = named.groupBy("group").agg(F.min("job_id").alias("alike_id"))
    alone = known.filter("n = 0").withColumn("group", F.lit(None).cast("long")).withColumn("alike_id", F.col("job_id"))
    columns = ["job_id", "log_key", F.col("n").alias("n_shingles"), "alike_id", F.col("group").alias("group_key")]
    return named.join(least, "group").select(*columns).unionByName(alone.select(*columns))


def _groups(keyed: DataFrame, known: DataFrame) -> DataFrame:
    """``owner group`` of all classes that may have links."""
    size = keyed.agg(F.sum(F.octet_length("log"))).first()[0] or 0
    counted = _counted(_note_logs(keyed, _bits(size / 6)))
    classes = known.filter("n > 0").groupBy("owner", "check", "n").agg(F.min(F.struct("job_id", "log_key")).alias("rep"))
    bound = F.coalesce("told", F.lit(0)) + F.coalesce("local", F.lit(0))
    with scratch(keyed.sparkSession):
        asked = materialize(_still(classes.join(counted, "owner").withColumn("bound", bound)).select("owner", "bound", F.col("rep.*")), "asked", keep=True)
    chosen = keyed.join(asked, keyed["job_id"].eqNullSafe(asked["job_id"]) & (keyed["log_key"] == asked["log_key"])).select("owner", "bound", "log")
    with scratch(keyed.sparkSession):
        open_ = materialize(_banded(chosen.dropDuplicates(["owner"])), "classes", keep=True)
        class_of = materialize(open_.select("owner", "class"), "class_of", keep=True)
    nodes = class_of.select(F.col("class").alias("owner")).distinct()
    links, turn = None, 0
    total, rows = open_.agg(F.sum("n"), F.count("*")).first()
    if rows:
        with scratch(keyed.sparkSession):
            smaller = materialize(_open(open_, _bits(total)), "classes", keep=True)
        drop_stored(open_)
        open_ = smaller
        total, rows = open_.agg(F.sum("n"), F.count("*")).first()
    while rows:
        bits, before = _bits(total), rows
        with scratch(keyed.sparkSession):
            found = materialize(_of_classes(_star_round(open_, turn, bits), class_of), "links", keep=True)
        proven = not found.isEmpty()
        if proven:
            links = found if links is None else links.unionByName(found)
            with scratch(keyed.sparkSession):
                groups = materialize(components(nodes, links, (), "a", "b", "owner", "group"), "groups")
                regrouped = open_.drop("group").join(groups.withColumnRenamed("owner", "class"), "class")
                smaller = materialize(_open(regrouped, bits), "classes", keep=True)
            drop_stored(open_)
            open_ = smaller
            total, rows = open_.agg(F.sum("n"), F.count("*")).first()
            turn += 1
        if rows and (not proven or rows > CLOSING * before):
            with scratch(keyed.sparkSession):
                rest = materialize(_of_classes(_block_join(open_), class_of), "links", keep=True)
            links = rest if links is None else links.unionByName(rest)
            break
    if links is None:
        return nodes.withColumn("group", F.col("owner"))
    return components(nodes, links, (), "a", "b", "owner", "group")


def distinct_logs(logs: DataFrame) -> DataFrame:
    """One log of each group of near copies, that with the smallest id, with all of its columns.

    Logs without words belong to no group and all stay.
    """
    found = materialize(alike_logs(logs), "alike")
    first = found.filter("group_key is not null").groupBy("group_key").agg(F.min(F.struct("job_id", "log_key")).alias("first")).select("first.*")
    key = "_key"
    while key in logs.columns:
        key = f"_{key}"
    keyed = logs.withColumn(key, F.xxhash64("log"))
    # A filter of its own, so that the join need not carry logs without words.
    wordless = found.filter("group_key is null").select("job_id", "log_key").distinct()

    def rows_of(keys: DataFrame) -> DataFrame:
        return keyed.join(keys, keyed["job_id"].eqNullSafe(keys["job_id"]) & (keyed[key] == keys["log_key"]), "left_semi")

    kept = rows_of(first).dropDuplicates(["job_id", key])
    return kept.unionByName(rows_of(wordless)).drop(key)
