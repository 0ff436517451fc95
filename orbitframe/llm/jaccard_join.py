"""Exact n-gram Jaccard join by prefix filtering, with set-relation skipping (operator 5)."""

from __future__ import annotations

import math
import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, materialize, release_memory, small_batches

#: Bytes hashed and tokens held at once by a task.
BYTES, TOKENS = 1 << 21, 1 << 20
#: Tokens of one bucket of the frequency count.
BUCKET_TOKENS = 1_000_000
#: A token in this share of all sets, or in so many, is common: it is not counted and comes last in the order. At most
#: so many tokens are treated so (the most frequent); the rest of them would be counted like any other.
COMMON, COMMON_TIMES, COMMON_TOKENS = 0.01, 500_000, 2_000_000
#: Sets of one token's list that meet in one task, from each side.
BLOCK = 1024
#: Parts of a token's list in the join with what is known about the list.
SALTS = 8
BANDS, ROWS = 10, 3
#: Partners that a set tries in each of its lists, round by round, before the last round takes all that remain.
PICKS = (8, 64, 512)
#: Sets of one component that meet in one task, from each side, and tokens compared at once, where links are counted.
CROWD, WIDE = 512, 2048
LAST = np.iinfo(np.int32).max

_rng = np.random.default_rng(5)
_BYTE = _rng.integers(0, 1 << 64, 256, np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_BLANK = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_PLACE = _rng.integers(0, 1 << 64, 64, np.uint64) | np.uint64(1)
_BAND = _rng.integers(0, 1 << 64, (BANDS, ROWS), np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, 64-bit hash) of each word of a byte array that ends with a blank; hashed in slices that end at blanks."""
    starts, hashes, at = [], [], 0
    while at < len(data):
        to = min(len(data), at + BYTES)
        while to < len(data) and not _BLANK[data[to - 1]]:
            ahead = np.flatnonzero(_BLANK[data[to : to + BYTES]])
            to = to + int(ahead[0]) + 1 if len(ahead) else min(len(data), to + BYTES)
        part = data[at:to]
        word = ~_BLANK[part]
        begin = np.flatnonzero(word & ~np.r_[False, word[:-1]])
        if len(begin):
            own = part[word]
            first = np.cumsum(word)[begin] - 1
            length = np.diff(np.r_[first, len(own)])
            place = np.arange(len(own)) - np.repeat(first, length)
            h = np.add.reduceat(_BYTE[own] * _powers(int(length.max()))[place], first)
            starts.append(begin + at)
            hashes.append(_mix(h + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        at = to
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(hashes)


def shingle_sets(texts: list[str | None], width: int = 5) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingles of each text; a text of fewer words has one, of all its words, or none."""
    out: list[np.ndarray] = []
    blobs = [(t or "").encode("utf-8", "replace") for t in texts]
    with np.errstate(over="ignore"):
        starts, words = _words(np.frombuffer(b"\n".join(blobs) + b"\n", np.uint8))
        bounds = np.searchsorted(starts, np.cumsum([0, *(len(b) + 1 for b in blobs)]))
        rolled = sum((words[k : len(words) - width + 1 + k] * _PLACE[k] for k in range(width)), np.uint64(0)) if len(words) >= width else words[:0]
        rolled = _mix(rolled)
        for at, to in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if to - at >= width:
                out.append(np.unique(rolled[at : to - width + 1]))
            elif to > at:
                out.append(_mix(np.array([(words[at:to] * _PLACE[: to - at]).sum() + np.uint64(to - at)], np.uint64)))
            else:
                out.append(words[:0])
    return out


def _names(tokens: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a set: the first names it, the second tells sets with the same name apart."""
    return struct.unpack("<qq", xxhash.xxh3_128_digest(tokens.tobytes()))


def _parts(batches, width: int):
    """(ids, sets) of a bounded number of bytes at a time."""
    for batch in batches:
        ids, texts, held = [], [], 0
        for id_, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids.append(id_)
            texts.append(text.as_py())
            held += len(texts[-1] or "")
            if held >= BYTES:
                yield ids, shingle_sets(texts, width)
                ids, texts, held = [], [], 0
        if ids:
            yield ids, shingle_sets(texts, width)


def _batch(names: str, types: list, columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names.split())


def describe(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, text_hash, n, key, other, often, times): set size, two hashes of the set (null if empty), tokens often seen nearby."""
    names = "id text_hash n key other often times"
    types = [pa.int64()] * 5 + [pa.list_(pa.int64())] * 2

    def run(batches):
        held, total, docs_held = [], 0, 0
        for batch in batches:
            hashes, at = batch.column(2).to_pylist(), 0
            for ids, sets in _parts([batch], width):
                held += sets
                total += sum(map(len, sets))
                docs_held += len(sets)
                often, times = None, None
                if total >= TOKENS:
                    often, times = _often(held, docs_held)
                    held, total, docs_held = [], 0, 0
                rest = [None] * (len(ids) - 1)
                keys = [_names(s) if len(s) else (None, None) for s in sets]
                yield _batch(names, types, [ids, hashes[at : at + len(ids)], [len(s) for s in sets], *zip(*keys, strict=True), [often, *rest], [times, *rest]])
                at += len(ids)
        if held:
            often, times = _often(held, docs_held)
            yield _batch(names, types, [[None], [None], [-1], [None], [None], [often], [times]])
        held = None
        release_memory()

    schema = "id long, text_hash long, n long, key long, other long, often array<long>, times array<long>"
    return docs.select(F.col(id_col).cast("long"), text_col, F.xxhash64(text_col)).mapInArrow(run, schema)


def _often(held: list[np.ndarray], docs_held: int) -> tuple[np.ndarray, np.ndarray]:
    tokens, times = np.unique(np.concatenate(held), return_counts=True)
    keep = times >= max(4, docs_held * COMMON / 2)
    return tokens[keep].view(np.int64), times[keep]


def _deal(common, renamed: frozenset, buckets: int, width: int):
    """Rows (bucket, keys, sizes, counts, tokens): a task's tokens dealt to buckets by value, grouped by set; common ones apart."""

    def name(tokens):
        key, other = _names(tokens)
        return other if key in renamed else key

    def flush(sets: dict[int, np.ndarray]):
        keys = np.fromiter(sets, np.int64, len(sets))
        tokens = np.concatenate(list(sets.values()))
        sizes = np.array([len(s) for s in sets.values()], "<i4")
        owner = np.repeat(np.arange(len(keys)), sizes)
        bucket = ((tokens >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        if len(common.value):
            at = np.minimum(np.searchsorted(common.value, tokens), len(common.value) - 1)
            # a set's common tokens need no counting: they go on as they are, dealt by the set's key, so that equal sets of
            # several tasks or flushes meet and count once
            bucket = np.where(common.value[at] == tokens, buckets + (keys % buckets)[owner], bucket)
        order = np.argsort(bucket, kind="stable")
        bucket, tokens, owner = bucket[order], tokens[order], owner[order]
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
        rows = []
        for at, to in zip(cuts[:-1], cuts[1:], strict=True):
            runs = np.flatnonzero(np.r_[True, owner[at + 1 : to] != owner[at : to - 1], True])
            own = owner[at:to][runs[:-1]]
            rows.append((int(bucket[at]), keys[own].tobytes(), sizes[own].tobytes(), np.diff(runs).astype("<i4").tobytes(), tokens[at:to].tobytes()))
        return _batch("bucket keys sizes counts tokens", [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()], zip(*rows, strict=True))

    def run(batches):
        held, total = {}, 0
        for _, sets in _parts(batches, width):
            for s in sets:
                if len(s) and (key := name(s)) not in held:
                    held[key] = s
                    total += len(s)
            if total >= TOKENS:
                yield flush(held)
                held, total = {}, 0
        if held:
            yield flush(held)
        held = None
        release_memory()

    return run


def _blobs(table: pa.Table, name: str, kind: str) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, kind) for x in table.column(name).to_pylist()])


def _shared_tokens(buckets: int):
    """Of one bucket, for each set: its tokens that other sets have too, and in how many sets each is; dealt by set."""

    def run(key, table):
        keys, sizes, counts, tokens = (_blobs(table, c, k) for c, k in (("keys", "<i8"), ("sizes", "<i4"), ("counts", "<i4"), ("tokens", "<u8")))
        # equal sets met in several tasks count once
        first = np.zeros(len(keys), bool)
        first[np.unique(keys, return_index=True)[1]] = True
        if not first.all():
            tokens = tokens[np.repeat(first, counts)]
            keys, sizes, counts = keys[first], sizes[first], counts[first]
        if key[0].as_py() >= buckets:
            times = np.full(len(tokens), LAST, np.int32)
        else:
            _, where, number = np.unique(tokens, return_inverse=True, return_counts=True)
            times = number[where].astype(np.int32)
        keep = times > 1
        owner = np.repeat(np.arange(len(keys)), counts)[keep]
        slot = (keys % buckets)[owner]
        order = np.argsort(slot, kind="stable")
        owner, slot, tokens, times = owner[order], slot[order], tokens[keep][order], times[keep][order]
        cuts = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1], True]) if len(slot) else np.zeros(1, int)
        rows = []
        for at, to in zip(cuts[:-1], cuts[1:], strict=True):
            runs = np.flatnonzero(np.r_[True, owner[at + 1 : to] != owner[at : to - 1], True])
            own = owner[at:to][runs[:-1]]
            rows.append((int(slot[at]), keys[own].tobytes(), sizes[own].tobytes(), np.diff(runs).astype("<i4").tobytes(), tokens[at:to].tobytes(), times[at:to].astype("<i4").tobytes()))
        names = ["slot", "keys", "sizes", "counts", "tokens", "times"]
        release_memory()
        return pa.table([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 6, [pa.int32(), *[pa.binary()] * 5], strict=True)], names=names)

    return run


def _arrange(percent: int):
    """Sets that can have a partner: shared tokens in the global order (rare first), prefix length, band keys."""

    def run(table):
        keys, sizes, counts, tokens, times = (_blobs(table, c, k) for c, k in (("keys", "<i8"), ("sizes", "<i4"), ("counts", "<i4"), ("tokens", "<u8"), ("times", "<i4")))
        owner = np.repeat(keys, counts)
        order = np.lexsort((tokens, times, owner))
        owner, tokens = owner[order], tokens[order]
        once = np.r_[True, (owner[1:] != owner[:-1]) | (tokens[1:] != tokens[:-1])][: len(owner)]
        owner, tokens = owner[once], tokens[once]
        size_of = dict(zip(keys.tolist(), sizes.tolist(), strict=True))
        cuts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1], True])
        rows = []
        for at, to in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            key, own = int(owner[at]), tokens[at:to]
            n = size_of[key]
            # tokens of no other set come first in the order; of the prefix only what follows them can match
            prefix = to - at - (-(-percent * n // 100)) + 1
            if prefix <= 0:
                continue
            with np.errstate(over="ignore"):
                least = np.array([[_mix(own ^ seed).min() for seed in band] for band in _BAND])
                bands = _mix(least @ _PLACE[:ROWS] + np.arange(BANDS, dtype=np.uint64)).view(np.int64).tolist()
            rows.append((key, n, to - at, min(prefix, to - at), own.tobytes(), bands))
        release_memory()
        types = [pa.int64()] * 4 + [pa.binary(), pa.list_(pa.int64())]
        return pa.table([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 6, types, strict=True)], names=["key", "n", "m", "prefix", "tokens", "bands"])

    return run


def _post(batches):
    """(token, n, place, key, comp): the prefix of each set."""
    for batch in batches:
        key, n, m, prefix, tokens, comp = (batch.column(i).to_pylist() for i in range(6))
        lists = [np.frombuffer(t, "<i8")[:p] for t, p in zip(tokens, prefix, strict=True)]
        size = [len(x) for x in lists]
        places = [np.arange(s) + a - b for s, a, b in zip(size, n, m, strict=True)]
        spread = lambda c: np.repeat(np.array(c, np.int64), size)
        if size:
            yield _batch("token n place key comp", [pa.int64()] * 5, [np.concatenate(lists), spread(n), np.concatenate(places), spread(key), spread(comp)])


def _cell_pairs(cell: np.ndarray, percent: int, picks: int | None):
    """Pairs of one cell (rows n, place, key, comp, role by column, sorted by n) that can reach the threshold unconnected.

    Probes meet targets. Blocks of sizes out of range are skipped by binary search, the rest by position: behind their
    places neither set may have fewer tokens than the overlap needs. With ``picks``, each probe gets so many of its possible
    partners at most, chosen by hash.
    """
    n, place, key, comp, role = cell
    probe, target = np.flatnonzero(role & PROBE), np.flatnonzero(role & TARGET)
    tn, tp, tk, tc, main = n[target], place[target], key[target], comp[target], (role[target] & MAIN) > 0
    upto = np.searchsorted(tn, n[probe] * 100 // percent, side="right")
    down = np.searchsorted(tn, -(-n[probe] * percent // 100), side="left")
    for at in range(0, len(probe), 256):
        i = probe[at : at + 256]
        j = np.arange(int(down[at]), int(upto[at + len(i) - 1]))
        need = -(-percent * (n[i][:, None] + tn[j]) // (100 + percent))
        ok = (np.minimum((n - place)[i][:, None], (tn - tp)[j]) >= need) & (comp[i][:, None] != tc[j])
        ok &= main[j] | (tk[j] > key[i][:, None])  # two probes meet twice
        a, b = np.nonzero(ok)
        if picks and len(a):
            with np.errstate(over="ignore"):
                draw = _mix(key[i[a]].view(np.uint64) * _PLACE[0] + tk[j[b]].view(np.uint64) * _PLACE[1] + np.uint64(picks))
            by = np.lexsort((draw, a))
            first = np.flatnonzero(np.r_[True, a[by][1:] != a[by][:-1]])
            turn = np.arange(len(by)) - np.repeat(first, np.diff(np.r_[first, len(by)]))
            a, b = a[by[turn < picks]], b[by[turn < picks]]
        yield key[i[a]], tk[j[b]]


#: What a posted set is in a cell: compared with the targets, a target, and of its list's largest component.
PROBE, TARGET, MAIN = 1, 2, 4


def _cells(posted: DataFrame, picks: int | None) -> DataFrame:
    """(token, i, j, n, place, key, comp, role): the lists that hold several components, cut into cells of bounded size.

    In each list the sets of its largest component are targets only, all others are probes too. A list of more than
    ``BLOCK`` sets is split: targets by hash into blocks i, probes into blocks j, and each pair of blocks is a cell. With
    ``picks``, a probe goes to a few blocks only; without, to all.
    """
    shares = posted.groupBy("token", "comp").agg(F.count("*").alias("c"))
    lists = shares.groupBy("token").agg(F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("all"))
    lists = lists.where("all > top.c").select(
        "token", F.col("top.comp").alias("main"), F.ceil(F.col("all") / BLOCK).cast("int").alias("ti"), F.ceil((F.col("all") - F.col("top.c")) / BLOCK).cast("int").alias("pj")
    )
    tried = F.least(F.col("ti"), F.lit(1 + picks // 64)) if picks else F.col("ti")
    spot = lambda seed, many: F.pmod(F.xxhash64(F.lit(seed), "key"), many).cast("int")
    own, probes = F.col("comp") == F.col("main"), F.col("comp") != F.col("main")
    first = spot(picks or 0, F.col("ti"))
    cell = lambda i, j, role: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), role.cast("int").alias("role"))
    as_target = F.transform(F.sequence(F.lit(0), F.col("pj") - 1), lambda j: cell(spot(1, F.col("ti")), j, F.when(own, F.lit(TARGET | MAIN)).otherwise(F.lit(TARGET))))
    as_probe = F.transform(F.sequence(F.lit(0), tried - 1), lambda k: cell(F.pmod(first + k, F.col("ti")), spot(2, F.col("pj")), F.lit(PROBE)))
    one = F.array(cell(F.lit(0), F.lit(0), F.when(own, F.lit(TARGET | MAIN)).otherwise(F.lit(TARGET | PROBE))))
    cells = F.when((F.col("ti") == 1) & (F.col("pj") == 1), one).when(probes, F.concat(as_target, as_probe)).otherwise(as_target)
    # a frequent token's rows spread over several tasks of the join as well
    salted = lists.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return posted.withColumn("salt", spot(3, F.lit(SALTS))).join(salted, ["token", "salt"]).select("token", F.explode(cells).alias("at"), "n", "place", "key", "comp").select("token", "at.i", "at.j", "n", "place", "key", "comp", F.col("at.role").cast("long").alias("role"))


def _scan(percent: int, picks: int | None):
    def run(batches):
        held: list[np.ndarray] = []
        seen: set = set()

        def emit(grid: np.ndarray):
            for a, b in _cell_pairs(grid[3:], percent, picks):
                pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
                fresh = [p for p in zip(*pairs.tolist(), strict=True) if p not in seen]
                if len(seen) > 200_000:
                    seen.clear()
                seen.update(fresh)
                if fresh:
                    yield _batch("a b", [pa.int64()] * 2, zip(*fresh, strict=True))

        for batch in batches:
            grid = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(8)])
            if not grid.shape[1]:
                continue
            cuts = np.flatnonzero(np.r_[True, (grid[:3, 1:] != grid[:3, :-1]).any(axis=0), True])
            for at, to in zip(cuts[:-1], cuts[1:], strict=True):
                if held and (held[0][:3, 0] != grid[:3, at]).any():
                    yield from emit(np.concatenate(held, axis=1))
                    held = []
                held.append(grid[:, at:to])
        if held:
            yield from emit(np.concatenate(held, axis=1))
        held, seen = [], set()
        release_memory()

    return run


def _verify(percent: int):
    def run(batches):
        for batch in batches:
            a, b, na, nb, ta, tb = (batch.column(i) for i in range(6))
            keep = []
            for i in range(batch.num_rows):
                x, y = np.frombuffer(ta[i].as_py(), "<u8"), np.frombuffer(tb[i].as_py(), "<u8")
                both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                keep.append(100 * both >= percent * (na[i].as_py() + nb[i].as_py() - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], names=["u", "v"])

    return run


def _differences(percent: int):
    """Each set as its difference from the reference of its component: (comp, key, w, d, room, tokens).

    With r tokens of the reference missing in a set and a added, let d = 100 r + percent a. Two sets S and T that share x
    tokens of their differences link just when (100 + percent) x >= d(S) + d(T) - room, where room is (100 - percent) times
    the size of the reference; any set of tokens can be the reference.
    """

    def run(batches):
        for batch in batches:
            comp, key, n, w, tokens, ref = (batch.column(i) for i in range(6))
            d, room, apart = [], [], []
            for size, own, of in zip(n.to_pylist(), tokens.to_pylist(), ref.to_pylist(), strict=True):
                x, y = np.frombuffer(own, "<u8"), np.frombuffer(of, "<u8")
                both = np.setxor1d(x, y, assume_unique=True)
                same = (len(x) + len(y) - len(both)) // 2
                d.append(100 * (len(y) - same) + percent * (size - same))
                room.append((100 - percent) * len(y))
                apart.append(both.tobytes())
            made = [pa.array(d, pa.int64()), pa.array(room, pa.int64()), pa.array(apart, pa.binary())]
            yield pa.RecordBatch.from_arrays([comp, key, w, *made], names=["comp", "key", "w", "d", "room", "tokens"])
        release_memory()

    return run


def _shared(lists: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many tokens each list of ``left`` shares with each of ``right``."""
    owner, tokens = np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate(lists)
    _, where, times = np.unique(tokens, return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1
    keep = times[where] > 1
    owner, where = owner[keep], number[where[keep]]
    order = np.argsort(where, kind="stable")
    owner, where = owner[order], where[order]
    found = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, int(where[-1]) + 1 if len(where) else 0, WIDE):
        at, to = np.searchsorted(where, [low, low + WIDE])
        has = np.zeros((len(lists), WIDE), np.float32)
        has[owner[at:to], where[at:to] - low] = 1
        found += has[left] @ has[right].T
    return found.astype(np.int64)


def _crowd_links(percent: int):
    """(key, links): links of the sets of one cell that only their shared differences decide, weighed by rows."""

    def count(grid: np.ndarray, lists: list[np.ndarray]):
        _, i, j, key, w, d, room, side = grid
        left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
        total = d[left][:, None] + d[right] - room[0]
        link = (total > 0) & ((100 + percent) * _shared(lists, left, right) >= total)
        link &= left[:, None] != right
        links = np.zeros(len(key), np.int64)
        links[left] += link @ w[right]
        if i[0] != j[0]:
            links[right] += w[left] @ link
        return _batch("key links", [pa.int64()] * 2, [key, links])

    def run(batches):
        grids: list[np.ndarray] = []
        lists: list[np.ndarray] = []
        for batch in batches:
            grid = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(8)])
            if not grid.shape[1]:
                continue
            tokens = [np.frombuffer(x, "<u8") for x in batch.column(8).to_pylist()]
            cuts = np.flatnonzero(np.r_[True, (grid[:3, 1:] != grid[:3, :-1]).any(axis=0), True])
            for at, to in zip(cuts[:-1], cuts[1:], strict=True):
                if grids and (grids[0][:3, 0] != grid[:3, at]).any():
                    yield count(np.concatenate(grids, axis=1), lists)
                    grids, lists = [], []
                grids.append(grid[:, at:to])
                lists.extend(tokens[at:to])
        if grids:
            yield count(np.concatenate(grids, axis=1), lists)
        release_memory()

    return run


def _count_links(ready: DataFrame, known: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(key, links): with how many rows of other classes the rows of a class link.

    All links lie inside components. A component's sets derive their answers from those of its least set, the reference:
    where the differences of two sets from it are small enough together, they link whatever the differences hold, and a
    running sum over the sizes of differences counts such pairs without forming them. Pairs that the sizes leave open are
    compared by their differences, in cells of bounded size; no pair is written.
    """
    named = known.select("key", F.col("component").alias("comp"))
    own = ready.select("key", "n", "tokens").join(named, "key").join(classes.select("key", "w"), "key").withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)))
    reference = ready.join(named.where("key = comp").select("key"), "key").select(F.col("key").alias("comp"), F.col("tokens").alias("ref"))
    reference = reference.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    apart = own.join(reference, ["comp", "salt"]).select("comp", "key", "n", "w", "tokens", "ref")
    apart = materialize(apart.mapInArrow(_differences(percent), "comp long, key long, w long, d long, room long, tokens binary"), "differences")

    sizes = apart.groupBy("comp", "d", "room").agg(F.sum("w").alias("w"), F.count("*").alias("c"))
    marks = sizes.select("comp", F.col("d").alias("at"), F.lit(0).alias("asks"), "w", "d")
    marks = marks.unionByName(sizes.select("comp", (F.col("room") - F.col("d")).alias("at"), F.lit(1).alias("asks"), F.lit(0).cast("long").alias("w"), "d"))
    near = marks.withColumn("near", F.sum("w").over(Window.partitionBy("comp").orderBy("at", "asks"))).where("asks = 1").select("comp", "d", "near")
    sure = apart.select("comp", "key", "w", "d", "room").join(near, ["comp", "d"])
    sure = sure.select("key", (F.col("near") - F.when(2 * F.col("d") <= F.col("room"), F.col("w")).otherwise(0)).alias("links"))

    most = sizes.withColumn("most", F.max("d").over(Window.partitionBy("comp"))).where("d + most > room")
    crowds = most.groupBy("comp").agg(F.first("most").alias("most"), F.sum("c").alias("c")).where("c > 1")
    crowds = crowds.select("comp", "most", F.ceil(F.col("c") / CROWD).alias("t")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    left = apart.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS))).join(crowds, ["comp", "salt"]).where("d + most > room")
    left = left.withColumn("side", F.pmod(F.xxhash64(F.lit(1), "key"), F.col("t"))).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("t") - 1)))
    left = left.select("comp", F.least("side", "k").alias("i"), F.greatest("side", "k").alias("j"), "key", "w", "d", "room", "side", "tokens")
    left = left.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j")
    rest = left.mapInArrow(_crowd_links(percent), "key long, links long")
    return sure.unionByName(rest).groupBy("key").agg(F.sum("links").alias("links"))


def link_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75, links: bool = False) -> DataFrame:
    """(id, text_hash, n_shingles, component_id, component_key) per row: size of its shingle set, the smallest id reachable
    by links, and a number that names the component even where ids are null (null for empty sets). With ``links`` also
    n_links: with how many other rows it links, rows of equal sets included.

    Sets link when their Jaccard similarity is at least ``percent`` / 100. Classes of equal sets have 128-bit names; shingles
    are 64-bit hashes, so a link is wrong only if two shingles of one pair of texts collide.

    1. Equal sets collapse to one class. 2. A distributed count finds for each class its shared tokens, those of at least
    two classes, and orders them rare first; classes that share too few tokens to link with anything are done. 3. Classes
    alike in a band of min-hashes are verified against the least of their groups, first one each, then those not yet
    connected: a verified class takes over its representative's component, so the two need no further comparison. 4. Each
    prefix token has a list of its classes by size; lists skip by size and position and leave out pairs known to be
    connected, and long lists are split into cells of bounded size. A few rounds try some partners of each class, so that
    near copies without a common representative join; the last takes all pairs that remain. Every pair is verified.
    5. Connected components run over the links. 6. With ``links``, the links inside each component are counted
    (see ``_count_links``), those of pairs never compared before included.

    A very frequent token never meets the others of its value in one task for counting (see ``COMMON_TIMES``). Null or blank
    texts have empty sets and are alone. Rows with null id belong to their class but name no component. Rows that repeat
    an id are rows of their own with the same class if their sets are equal. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    told = materialize(describe(docs, id_col, text_col, width), "sets")
    sets = told.where("n >= 0").select("id", "text_hash", "n", "key", "other")
    classes = sets.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("rep"), F.max("n").alias("n"), F.count("*").alias("w"), F.min("other").alias("lo"), F.max("other").alias("hi"))
    classes = materialize(classes, "classes")
    # different sets with one name: about one in 2^64 pairs, so a few at most; they take their other hash for a name
    renamed = frozenset(r["key"] for r in classes.where("lo <> hi").select("key").collect())
    if renamed:
        sets = sets.withColumn("key", F.when(F.col("key").isin(*renamed), F.col("other")).otherwise(F.col("key")))
        classes = materialize(sets.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("rep"), F.max("n").alias("n"), F.count("*").alias("w")), "classes")
    classes = classes.select("key", "rep", "n", "w")
    total, tokens = classes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    pairs = told.where("often IS NOT NULL").select(F.explode(F.arrays_zip("often", "times")).alias("x"))
    common = pairs.groupBy("x.often").agg(F.sum("x.times").alias("times")).where(F.col("times") >= max(64, min(COMMON_TIMES, int(COMMON * total))))
    common = common.orderBy(F.desc("times"), "often").limit(COMMON_TOKENS).select("often")
    common = np.sort(np.array([r[0] for r in common.collect()], np.int64).view(np.uint64))
    shared = spark.sparkContext.broadcast(common)
    buckets = max(1, math.ceil(tokens / BUCKET_TOKENS))
    dealt = docs.select(F.lit(None).cast("long").alias("id"), text_col).mapInArrow(_deal(shared, renamed, buckets, width), "bucket int, keys binary, sizes binary, counts binary, tokens binary")
    hits = dealt.groupBy("bucket").applyInArrow(_shared_tokens(buckets), "slot int, keys binary, sizes binary, counts binary, tokens binary, times binary")
    ready = materialize(hits.groupBy("slot").applyInArrow(_arrange(percent), "key long, n long, m long, prefix long, tokens binary, bands array<long>"), "ready")

    def verified(pairs: DataFrame) -> DataFrame:
        side = lambda c: ready.select(F.col("key").alias(c), F.col("n").alias(f"n{c}"), F.col("tokens").alias(f"t{c}"))
        full = pairs.distinct().join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ta", "tb")
        return materialize(full.mapInArrow(_verify(percent), "u long, v long"), "links")

    banded = ready.select("key", F.explode("bands").alias("band"))
    heads = banded.groupBy("band").agg(F.min("key").alias("a"), F.max("key").alias("z")).where("a < z").select("band", "a")
    alike = materialize(banded.join(heads, "band").where("key > a").select("a", F.col("key").alias("b")).distinct(), "alike")
    found = verified(alike.groupBy("b").agg(F.min("a").alias("a")))
    known = components(found)
    side = lambda c: known.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    other = alike.join(side("a"), "a", "left").join(side("b"), "b", "left").where("ca IS NULL OR cb IS NULL OR ca <> cb").select("a", "b")
    found = found.unionByName(verified(other))
    known, lists = materialize(components(found), "known"), None
    for picks in (*PICKS, None):
        named = known.select(F.col("node").alias("key"), "component")
        if lists is None:
            posted = ready.join(named, "key", "left").select("key", "n", "m", "prefix", "tokens", F.coalesce("component", "key").alias("comp"))
            posted = posted.mapInArrow(_post, "token long, n long, place long, key long, comp long")
        else:
            posted = lists.join(named, "key", "left").select("token", "n", "place", "key", F.coalesce("component", "key").alias("comp"))
        posted = materialize(posted, "posted")
        # a list whose sets are all connected stays so
        mixed = posted.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("token")
        lists = posted.join(mixed, "token", "left_semi").select("token", "n", "place", "key", "comp")
        cells = _cells(posted, picks).repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "n", "key")
        found = verified(cells.mapInArrow(_scan(percent, picks), "a long, b long"))
        if not found.isEmpty():
            # the stars of the known components stand for all links so far
            known = materialize(components(found.unionByName(known.select(F.col("node").alias("u"), F.col("component").alias("v")))), "known")
    known = known.withColumnRenamed("node", "key")
    least = known.join(classes, "key").groupBy("component").agg(F.min("rep").alias("least"))
    names = classes.join(known.join(least, "component").select("key", "component", "least"), "key", "left")
    if links:
        names = names.join(_count_links(ready, known, classes, percent), "key", "left")
    else:
        names = names.withColumn("links", F.lit(0))
    names = names.select("key", F.coalesce("least", "rep").alias("least"), F.coalesce("component", "key").alias("component"), (F.col("w") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    out = sets.join(names, "key", "left")
    alone = F.col("key").isNull()
    columns = [F.col("id").alias(id_col), "text_hash", F.col("n").alias("n_shingles"), F.when(alone, F.col("id")).otherwise(F.col("least")).alias("component_id"), F.col("component").alias("component_key")]
    return out.select(*columns, *([F.when(alone, 0).otherwise(F.col("links")).cast("long").alias("n_links")] if links else []))


def op5(docs: DataFrame) -> DataFrame:
    return link_components(docs, links=True).drop("text_hash", "component_key")
