"""Problem 5: the most similar vectors of every vector, by NN-descent.

A neighbour graph is started from leaves of random projections and improved by local joins: around every node its neighbours
and reverse neighbours meet, and whoever finds a nearer one among them takes it up. Only pairs of which one is new since the
last round are compared; what has met before does not meet again. Rounds end when hardly a list changes.

Nodes that lie near each other (a leaf of one more projection tree) form a *block*. A node's number holds its block, so that
every exchange is a join by block without a look-up: reverse edges go to their target's block, a block asks the others for the
vectors that its meetings need (each once, however many of its nodes name it), and finds go to the block of the finder. The
vectors travel as bytes with a scale; the lists are compared anew with the full vectors at the end, for all candidates that the
rounding's error bound cannot exclude, so that rounding has no part in the result.

* Vectors are unit ``float32``, one packed column. Usable are those of the usual length without missing, infinite or only
  zero numbers; the others take no part. Of several unlike vectors with one key the least is the record.
* Equal vectors: only the first ``TOP + 1`` of a group (by key) are nodes. Among equals ties go to the smaller key, so the
  others' neighbours are the group's first ``TOP``; nothing is lost, and a group of any size costs little.
* A leaf is the shortest prefix of a row's projection bits that at most so many rows share; where bits run out rows are dealt
  to leaves by hash. Leaves are intervals of codes: their list has at most ``2 ** BITS`` numbers, whatever the table.
* Groups of reverse neighbours are dealt to meetings of ``MEET``, each with the node's own neighbours: no hub makes an
  unbounded meeting and no edge is dropped. Meetings of a block are dealt to units of work of at most ``UNIT`` members.
* New questions walk the graph greedily from the leaves' entry points (``search``).

Defined cases: an empty table gives no rows; a single usable vector has no neighbours; ties in similarity go to the smaller
key; columns other than the named ones play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.session import cut_lineage, parallelism, written

TOP = 5  # neighbours that are asked for
KEEP = 20  # neighbours that a node keeps and joins while the graph is built: recall falls with fewer as the table grows
TREES = 3
BITS = 20
LEAF = 512  # rows of a tree's leaf
BLOCK = 2048  # rows of a block
PLACE = 12  # bits of a node's number that hold its place in the block
MEET = 60  # reverse neighbours in one meeting
UNIT = 1 << 17  # members of all meetings in one unit of work
CHUNK = 512  # vectors in one message
ROUNDS = 8
SETTLED = 0.002  # share of list entries that may still change
SALTS = 32  # parts of a group of equal vectors
SEED = 20


def unit_vectors(df: DataFrame, key: str, vec: str, length: int | None = None) -> DataFrame:
    """``(id, v)``: packed unit vectors of the usable rows, one row a key; ``length`` defaults to the most frequent one."""
    rows = df.select(F.col(key).alias("id"), F.col(vec).cast("array<float>").alias("vec")).filter("id is not null and vec is not null")
    if length is None:
        usual = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
        length = usual["n"] if usual else 0
    rows = rows.filter((F.size("vec") == length) & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x))).groupBy("id").agg(F.min("vec").alias("vec"))

    def run(batches):
        for batch in batches:
            m = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, length).astype(np.float64) if batch.num_rows else np.zeros((0, max(length, 1)))
            norm = np.sqrt((m * m).sum(1))
            ok = np.isfinite(norm) & (norm > 0)
            unit = (m[ok] / norm[ok, None]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("id").filter(pa.array(ok)), pa.array([r.tobytes() for r in unit], pa.binary())], names=["id", "v"])

    return rows.mapInArrow(run, "id bigint, v binary")


def matrix(column) -> np.ndarray:
    data = column.to_pylist() if hasattr(column, "to_pylist") else column
    return np.frombuffer(b"".join(data), np.float32).reshape(len(data), -1) if len(data) else np.zeros((0, 1), np.float32)


def grouped(batches, name: str):
    """The rows of each group of a column, from batches sorted by it; a group may go over batches."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        if not table.num_rows:
            continue
        ids = table.column(name).to_numpy()
        cuts = np.flatnonzero(ids[1:] != ids[:-1]) + 1
        if not len(cuts):
            rest = table
            continue
        whole, rest = table.slice(0, cuts[-1]).combine_chunks(), table.slice(cuts[-1])
        columns = [c.chunk(0) if c.num_chunks else c for c in whole.columns]
        for a, b in zip([0, *cuts[:-1]], cuts, strict=True):
            yield {n: c.slice(a, b - a) for n, c in zip(whole.column_names, columns, strict=True)}
    if rest is not None and rest.num_rows:
        whole = rest.combine_chunks()
        yield {n: c.chunk(0) for n, c in zip(whole.column_names, whole.columns, strict=True)}


# ---- leaves
def planes_of(tree: int, length: int) -> np.ndarray:
    return np.random.default_rng(SEED + tree).standard_normal((length, BITS)).astype(np.float32)


def codes_of(m: np.ndarray, centre: np.ndarray, tree: int) -> np.ndarray:
    """The signs of the projections around the centre, the first as the highest bit."""
    return ((m - centre) @ planes_of(tree, m.shape[1]) > 0) @ (1 << np.arange(BITS - 1, -1, -1))


class Leaves:
    """The leaves of some trees as intervals of codes, with the number of hash parts of each."""

    def __init__(self, nodes: DataFrame, limits: dict[int, int]):
        def sums(batches):
            total, n = 0.0, 0
            for batch in batches:
                if batch.num_rows:
                    m = matrix(batch.column("v"))
                    total, n = total + m.sum(0, dtype=np.float64), n + len(m)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tolist()], pa.list_(pa.float64()))], names=["n", "total"])

        parts = nodes.select("v").mapInArrow(sums, "n bigint, total array<double>").collect()  # a row a task
        self.count = sum(r["n"] for r in parts)
        self.centre = (np.sum([r["total"] for r in parts], axis=0) / self.count).astype(np.float32) if parts else np.zeros(1, np.float32)
        self.limits, centre = limits, self.centre
        # bits beyond these split no leaf further, but where many rows lie close together
        self.bits = {t: min(BITS, int(np.ceil(np.log2(max(self.count / limit, 1)))) + 5) for t, limit in limits.items()}
        bits = self.bits

        def histogram(batches):
            found: dict[int, np.ndarray] = {t: np.zeros(1 << bits[t], np.int64) for t in limits}
            for batch in batches:
                m = matrix(batch.column("v"))
                for t in limits if len(m) else ():
                    found[t] += np.bincount(codes_of(m, centre, t) >> (BITS - bits[t]), minlength=1 << bits[t])
            for t, counts in found.items():
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t)), pa.array(at), pa.array(counts[at])], names=["tree", "code", "n"])

        rows = nodes.select("v").mapInArrow(histogram, "tree bigint, code bigint, n bigint").groupBy("tree", "code").agg(F.sum("n").alias("n")).collect()  # at most 2 ** BITS a tree
        self.starts, self.parts = {}, {}
        for t, limit in limits.items():
            counts = np.zeros(1 << bits[t], np.int64)
            for r in rows:
                if r["tree"] == t:
                    counts[r["code"]] = r["n"]
            whole = np.concatenate([[0], np.cumsum(counts)])
            starts, parts, todo = [], [], [(0, len(counts))]
            while todo:
                a, b = todo.pop()
                n = whole[b] - whole[a]
                if n > limit and b - a > 1:
                    todo += [((a + b) // 2, b), (a, (a + b) // 2)]
                else:
                    starts.append(a)
                    parts.append(max(1, -(-2 * n // limit)) if n > limit else 1)
            self.starts[t], self.parts[t] = np.array(starts), np.array(parts)

    def of(self, tree: int, m: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """A number for each row's leaf."""
        at = np.searchsorted(self.starts[tree], codes_of(m, self.centre, tree) >> (BITS - self.bits[tree]), "right") - 1
        first = np.cumsum(self.parts[tree]) - self.parts[tree]
        mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        return first[at] + (mixed % self.parts[tree][at].astype(np.uint64)).astype(np.int64)


# ---- messages between blocks
MESSAGE = "block bigint, kind int, n bigint, a binary, b binary, c binary"
NAMES = [part.split()[0] for part in MESSAGE.split(", ")]
GRAPH, EDGES, MEETINGS, FLOORS, WANTED, CODES, FINDS, EXACT = range(8)
Parts = list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]


def messages(rows: list[tuple]) -> pa.RecordBatch:
    """``(block, kind, n, a, b, c)`` rows; a, b and c are arrays."""
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
    data = [pa.array([x.tobytes() for x in column], pa.binary()) for column in columns[3:]]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()), *data], names=NAMES)


def parcels(to: np.ndarray, *arrays: np.ndarray):
    """``(block, *slices)`` of the arrays by the block they go to."""
    if not len(to):
        return
    order = np.argsort(to, kind="stable")
    to = to[order]
    cuts = np.concatenate([[0], np.flatnonzero(to[1:] != to[:-1]) + 1, [len(to)]])
    arrays = [x[order] for x in arrays]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield (int(to[a]), *(x[a:b] for x in arrays))


def exchange(rows: DataFrame, step, *more: DataFrame) -> DataFrame:
    """Brings the messages of a block together and maps them by ``step(block, {kind: [(n, a, b, c)]})`` to further messages."""
    for other in more:
        rows = rows.unionByName(other)

    def run(batches):
        for g in grouped(batches, "block"):
            inbox: dict[int, Parts] = {}
            columns = [g[c].to_pylist() for c in NAMES[1:]]
            for kind, n, a, b, c in zip(*columns, strict=True):
                inbox.setdefault(kind, []).append((n, a, b, c))
            out = step(int(g["block"][0].as_py()), inbox)
            if out:
                yield messages(out)

    return rows.repartition(parallelism(rows.sparkSession), "block").sortWithinPartitions("block").mapInArrow(run, MESSAGE)


def joined(parts: Parts, at: int, kind) -> np.ndarray:
    return np.frombuffer(b"".join(p[at] for p in parts), kind)


def state(inbox: dict[int, Parts]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's lists: neighbours (-1 where there are fewer), similarities (falling), and which are new."""
    near, sims, fresh = (joined(inbox[GRAPH], at, kind).reshape(-1, KEEP) for at, kind in ((1, np.int64), (2, np.float32), (3, np.bool_)))
    return near, sims, fresh


def reverse_edges(block: int, inbox: dict[int, Parts]) -> list[tuple]:
    near, _, fresh = state(inbox)
    host, at = np.nonzero(near >= 0)
    out = parcels(near[host, at] >> PLACE, near[host, at], (block << PLACE) + host, fresh[host, at])
    return [(to, EDGES, 0, target, source, new) for to, target, source, new in out]


def meetings(block: int, inbox: dict[int, Parts]) -> list[tuple]:
    """Who meets around each node, what vectors that needs, and the similarity that a find must exceed."""
    if GRAPH not in inbox:
        return []
    near, sims, fresh = state(inbox)
    host, at = np.nonzero(near >= 0)
    own, own_new = near[host, at], fresh[host, at]
    edges = inbox.get(EDGES, [])
    back, guest, guest_new = joined(edges, 1, np.int64) & ((1 << PLACE) - 1), joined(edges, 2, np.int64), joined(edges, 3, np.bool_)
    order = np.argsort(back, kind="stable")
    back, guest, guest_new = back[order], guest[order], guest_new[order]
    count = np.bincount(back, minlength=len(near))
    tables = np.maximum(1, -(-count // MEET))  # meetings of each node
    first = np.cumsum(tables) - tables
    turn = np.arange(len(back)) - (np.cumsum(count) - count)[back]
    times = tables[host]
    meeting = np.concatenate([np.repeat(first[host], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times), first[back] + turn // MEET])
    member = np.concatenate([np.repeat(own, times), guest])
    new = np.concatenate([np.repeat(own_new, times), guest_new])
    order = np.lexsort((~new, member, meeting))
    meeting, member, new = meeting[order], member[order], new[order]
    once = np.ones(len(meeting), bool)
    once[1:] = (meeting[1:] != meeting[:-1]) | (member[1:] != member[:-1])
    held = np.bincount(meeting, new, minlength=int(tables.sum())) > 0  # meetings with someone new
    once &= held[meeting] if len(meeting) else once
    meeting, member, new = meeting[once], member[once], new[once]
    out = [(block, FLOORS, 0, np.ascontiguousarray(sims[:, -1]), sims[:0], sims[:0])]
    sizes = np.bincount(meeting, minlength=int(tables.sum()))
    unit = (np.cumsum(sizes) - 1) // UNIT
    for k in range(int(unit[-1]) + 1 if len(meeting) else 0):
        chosen = (unit == k) & (sizes > 0)
        mine = chosen[meeting]
        members, where = np.unique(member[mine], return_inverse=True)
        to = block + (k << 51)
        out.append((to, MEETINGS, 0, sizes[chosen].astype(np.int32), where.astype(np.int32), new[mine]))
        out += [(home, WANTED, to, ids, ids[:0], ids[:0]) for home, ids in parcels(members >> PLACE, members)]
    return out


def replies(block: int, inbox: dict[int, Parts]) -> list[tuple]:
    """The vectors that were asked for, as bytes, each with its scale and floor; meetings pass on."""
    out = [(block, MEETINGS, n, np.frombuffer(a, np.int32), np.frombuffer(b, np.int32), np.frombuffer(c, np.bool_)) for n, a, b, c in inbox.get(MEETINGS, [])]
    if WANTED in inbox:
        home = sorted(inbox[CODES], key=lambda p: p[0])
        scales = joined(home, 2, np.float32).reshape(-1, 2)[:, 0]
        codes = joined(home, 1, np.int8).reshape(len(scales), -1)
        rest = np.stack([scales, joined(inbox[FLOORS], 1, np.float32)], 1)
        for to, ids, *_ in inbox[WANTED]:
            ids = np.frombuffer(ids, np.int64)
            for a in range(0, len(ids), CHUNK):
                at = ids[a : a + CHUNK] & ((1 << PLACE) - 1)
                out.append((to, CODES, 0, ids[a : a + CHUNK], codes[at], rest[at]))
    return out


SIM_BITS, MEMBER_BITS = 22, 20


def packed(target: np.ndarray, other: np.ndarray, sims: np.ndarray) -> np.ndarray:
    """Target, falling similarity and other in one number each, so that plain sorting groups and ranks them."""
    falling = np.clip((1 - sims.astype(np.float64)) * (1 << SIM_BITS - 1), 0, (1 << SIM_BITS) - 1).astype(np.int64)
    return (target.astype(np.int64) << SIM_BITS + MEMBER_BITS) | (falling << MEMBER_BITS) | other


def ranked_keys(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys up to rank ``KEEP`` of each target, their targets and ranks."""
    keys = np.sort(keys)
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
    target = keys >> SIM_BITS + MEMBER_BITS
    new = np.concatenate([[True], target[1:] != target[:-1]]) if len(keys) else np.zeros(0, bool)
    start = np.flatnonzero(new)
    rank = np.arange(len(keys)) - np.repeat(start, np.diff(np.concatenate([start, [len(keys)]])))
    top = rank < KEEP
    return keys[top], target[top], rank[top]


def finds(_: int, inbox: dict[int, Parts]) -> list[tuple]:
    """The local joins of a unit's meetings: for each member the nearest it met, above its floor."""
    if MEETINGS not in inbox:
        return []
    parts = inbox[CODES]
    ids, rest = joined(parts, 1, np.int64), joined(parts, 3, np.float32).reshape(-1, 2)
    order = np.argsort(ids)
    codes = joined(parts, 2, np.int8).reshape(len(ids), -1)[order].astype(np.float32)
    ids, scale, floor = ids[order], rest[order, 0].copy(), rest[order, 1].copy()
    (_, sizes, where, new), *more = inbox[MEETINGS]
    assert not more
    sizes, where, new = np.frombuffer(sizes, np.int32), np.frombuffer(where, np.int32), np.frombuffer(new, np.bool_)
    first = np.cumsum(sizes) - sizes
    order = np.argsort(sizes, kind="stable")
    kept, waiting, held = np.zeros(0, np.int64), [], 0

    def settle() -> None:
        nonlocal kept, waiting, held
        kept, target, rank = ranked_keys(np.concatenate([kept, *waiting]))
        last = rank == KEEP - 1
        floor[target[last]] = np.maximum(floor[target[last]], 1 - ((kept[last] >> MEMBER_BITS) & ((1 << SIM_BITS) - 1)) / float(1 << SIM_BITS - 1) - 1e-6)
        waiting, held = [], 0

    at = 0
    while at < len(order):
        widest = int(sizes[order[min(at + 1023, len(order) - 1)]])
        some = order[at : at + max(1, min(1024, (1 << 22) // (widest * max(widest, codes.shape[1]))))]
        at += len(some)
        width = int(sizes[some].max())
        place = np.arange(width)
        real = place < sizes[some][:, None]
        flat = np.where(real, first[some][:, None] + place, 0)
        who, is_new = where[flat], new[flat] & real
        x = codes[who]
        # whole numbers below 2 ** 24: exact, and the same whichever meeting computes them
        sims = (x @ x.transpose(0, 2, 1)) * (scale[who][:, :, None] * scale[who][:, None, :])
        good = sims > np.where(real, floor[who], np.float32(9))[:, :, None]
        good &= (is_new[:, :, None] | is_new[:, None, :]) & real[:, None, :]
        good[:, place, place] = False
        m, i, j = np.nonzero(good)
        waiting.append(packed(who[m, i], who[m, j], sims[m, i, j]))
        held += len(m)
        if held > 400_000:
            settle()
    settle()
    target, other = kept >> SIM_BITS + MEMBER_BITS, kept & ((1 << MEMBER_BITS) - 1)
    sims = np.empty(len(kept), np.float32)
    for a in range(0, len(kept), 1 << 16):
        b = slice(a, a + (1 << 16))
        sims[b] = np.einsum("ij,ij->i", codes[target[b]], codes[other[b]]) * (scale[target[b]] * scale[other[b]])
    return [(home, FINDS, 0, t, o, s) for home, t, o, s in parcels(ids[target] >> PLACE, ids[target], ids[other], sims)]


def improved_lists(block: int, inbox: dict[int, Parts]) -> list[tuple]:
    """The nearest ``KEEP`` of a block's lists and of what was found; ``n`` counts the new entries."""
    if GRAPH not in inbox:
        return []
    near, sims, _ = state(inbox)
    row, at = np.nonzero(near >= 0)
    found = inbox.get(FINDS, [])
    owner = np.concatenate([row, joined(found, 1, np.int64) & ((1 << PLACE) - 1)])
    other, similar = np.concatenate([near[row, at], joined(found, 2, np.int64)]), np.concatenate([sims[row, at], joined(found, 3, np.float32)])
    fresh = np.arange(len(owner)) >= len(row)
    keep = other != owner + (block << PLACE)
    keep &= similar >= np.where(fresh, sims[owner, -1], -2) if len(owner) else keep
    owner, other, similar, fresh = owner[keep], other[keep], similar[keep], fresh[keep]
    order = np.lexsort((fresh, other, owner))
    owner, other, similar, fresh = owner[order], other[order], similar[order], fresh[order]
    once = np.ones(len(owner), bool)
    once[1:] = (owner[1:] != owner[:-1]) | (other[1:] != other[:-1])
    owner, other, similar, fresh = owner[once], other[once], similar[once], fresh[once]
    order = np.lexsort((other, -similar, owner))
    owner, other, similar, fresh = owner[order], other[order], similar[order], fresh[order]
    count = np.bincount(owner, minlength=len(near))
    rank = np.arange(len(owner)) - (np.cumsum(count) - count)[owner]
    top = rank < KEEP
    near, sims, new = np.full(near.shape, -1, np.int64), np.full(near.shape, -2, np.float32), np.zeros(near.shape, np.bool_)
    near[owner[top], rank[top]], sims[owner[top], rank[top]], new[owner[top], rank[top]] = other[top], similar[top], fresh[top]
    return [(block, GRAPH, int(new.sum()), near, sims, new)]


# ---- the graph
def placed_vectors(nodes: DataFrame, leaves: Leaves) -> DataFrame:
    """``(block, n, ids, codes, scales, floats)``: the nodes by block, ``n`` the place of a message's first."""
    sent = nodes.sparkSession.sparkContext.broadcast(leaves)

    def deal(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(sent.value.of(TREES, matrix(batch.column("v")), batch.column("id").to_numpy())), batch.column("id"), batch.column("v")], names=["block", "id", "v"])

    def place(batches):
        for g in grouped(batches, "block"):
            m, ids = matrix(g["v"]), g["id"].to_numpy()
            order = np.argsort(ids)
            m, ids = m[order], ids[order]
            scale = np.abs(m).max(1) / np.float32(127)
            codes = np.rint(m / scale[:, None]).astype(np.int8)
            error = np.linalg.norm(m - codes * scale[:, None], axis=1)
            block = g["block"][0].as_py()
            rows = [(a, x.tobytes(), c.tobytes(), s.tobytes(), v.tobytes()) for a in range(0, len(ids), CHUNK) for x, c, s, v in [(ids[a : a + CHUNK], codes[a : a + CHUNK], np.stack([scale, error], 1)[a : a + CHUNK].astype(np.float32), m[a : a + CHUNK])]]
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(rows)), pa.array(columns[0], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["block", "n", "ids", "codes", "scales", "floats"])

    dealt = nodes.mapInArrow(deal, "block bigint, id bigint, v binary")
    return dealt.repartition(parallelism(nodes.sparkSession), "block").sortWithinPartitions("block").mapInArrow(place, "block bigint, n bigint, ids binary, codes binary, scales binary, floats binary")


def leaf_finds(placed: DataFrame, leaves: Leaves) -> DataFrame:
    """The nearest of every node in its leaf of each tree, as finds."""
    sent = placed.sparkSession.sparkContext.broadcast(leaves)

    def deal(batches):
        for batch in batches:
            for block, n, ids, codes, scales in zip(*(batch.column(c).to_pylist() for c in ("block", "n", "ids", "codes", "scales")), strict=True):
                ids, scale = np.frombuffer(ids, np.int64), np.frombuffer(scales, np.float32).reshape(-1, 2)[:, 0]
                codes = np.frombuffer(codes, np.int8).reshape(len(ids), -1)
                number = (block << PLACE) + n + np.arange(len(ids))
                rows = []
                for tree in range(TREES):
                    leaf = sent.value.of(tree, codes * scale[:, None], ids)
                    rows += [(tree + TREES * to, CODES, 0, p, c, s) for to, p, c, s in parcels(leaf, number, codes, scale)]
                yield messages(rows)

    def nearest(_: int, inbox: dict[int, Parts]) -> list[tuple]:
        parts = inbox[CODES]
        ids, scale = joined(parts, 1, np.int64), joined(parts, 3, np.float32)
        codes = joined(parts, 2, np.int8).reshape(len(ids), -1).astype(np.float32)
        sims = (codes @ codes.T) * (scale[:, None] * scale[None, :])
        np.fill_diagonal(sims, -3)
        k = min(KEEP, len(ids) - 1)
        if k < 1:
            return []
        top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        owner = np.repeat(ids, k)
        return [(home, FINDS, 0, t, o, s) for home, t, o, s in parcels(owner >> PLACE, owner, ids[top].ravel(), np.take_along_axis(sims, top, 1).ravel())]

    return exchange(placed.select("block", "n", "ids", "codes", "scales").mapInArrow(deal, MESSAGE), nearest)


def coded(placed: DataFrame) -> DataFrame:
    return placed.select("block", F.lit(CODES).alias("kind"), "n", F.col("codes").alias("a"), F.col("scales").alias("b"), F.lit(b"").alias("c"))


def first_graph(placed: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            yield messages([(block, GRAPH, 0, np.full((n, KEEP), -1, np.int64), np.full((n, KEEP), -2, np.float32), np.zeros((n, KEEP), np.bool_)) for block, n in zip(batch.column("block").to_pylist(), batch.column("n").to_pylist(), strict=True)])

    return placed.groupBy("block").agg((F.sum(F.length("ids")) / 8).cast("bigint").alias("n")).mapInArrow(run, MESSAGE)


def descend(nodes: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame, Leaves]:
    """The nodes by block, the graph of their numbers after NN-descent, and the leaves."""
    leaves = Leaves(nodes, {**dict.fromkeys(range(TREES), LEAF), TREES: BLOCK})
    placed = written(placed_vectors(nodes, leaves))
    graph = cut_lineage(exchange(leaf_finds(placed, leaves), improved_lists, first_graph(placed)))
    for _ in range(rounds):
        around = exchange(graph.mapInArrow(each(reverse_edges), MESSAGE), meetings, graph)
        met = exchange(exchange(around, replies, coded(placed)), finds)
        graph = cut_lineage(exchange(met, improved_lists, graph))
        if (graph.agg(F.sum("n")).first()[0] or 0) <= SETTLED * leaves.count * KEEP:
            break
    return placed, graph, leaves


def each(step):
    """A step on every message by itself."""

    def run(batches):
        for batch in batches:
            for block, kind, n, a, b, c in zip(*(batch.column(x).to_pylist() for x in NAMES), strict=True):
                yield messages(step(block, {kind: [(n, a, b, c)]}))

    return run


def exact_lists(placed: DataFrame, graph: DataFrame, every: bool = False) -> DataFrame:
    """``(id, near, sims)``: each node's nearest ``TOP`` (``every``: all that it keeps) by the full vectors, ties to the smaller key.

    Without ``every`` only candidates that the rounding cannot exclude from the nearest ``TOP`` are fetched.
    """

    def worst(batches):
        most = max((np.frombuffer(s, np.float32).reshape(-1, 2)[:, 1].max() for batch in batches for s in batch.column(0).to_pylist()), default=np.float32(0))
        yield pa.RecordBatch.from_arrays([pa.array([float(most)])], names=["e"])

    error = placed.select("scales").mapInArrow(worst, "e double").agg(F.max("e")).first()[0] or 0.0
    margin = 2 * (2 * error + error * error) + 1e-6

    def ask(block: int, inbox: dict[int, Parts]) -> list[tuple]:
        near, sims, _ = state(inbox)
        good = near >= 0
        if not every:
            good &= sims >= sims[:, TOP - 1 : TOP] - margin
        host, at = np.nonzero(good)
        members, where = np.unique(near[host, at], return_inverse=True)
        out = [(block, MEETINGS, 0, good.sum(1).astype(np.int32), where.astype(np.int32), members)]
        return out + [(home, WANTED, block, ids, ids[:0], ids[:0]) for home, ids in parcels(members >> PLACE, members)]

    def reply(block: int, inbox: dict[int, Parts]) -> list[tuple]:
        out = [(block, MEETINGS, n, np.frombuffer(a, np.int32), np.frombuffer(b, np.int32), np.frombuffer(c, np.int64)) for n, a, b, c in inbox.get(MEETINGS, [])]
        if WANTED in inbox:
            home = sorted(inbox[EXACT], key=lambda p: p[0])
            keys = joined(home, 1, np.int64)
            floats = joined(home, 2, np.float32).reshape(len(keys), -1)
            for to, ids, *_ in inbox[WANTED]:
                ids = np.frombuffer(ids, np.int64)
                for a in range(0, len(ids), CHUNK):
                    at = ids[a : a + CHUNK] & ((1 << PLACE) - 1)
                    out.append((to, CODES, 0, ids[a : a + CHUNK], floats[at], keys[at]))
        return out

    def run(batches):
        for g in grouped(batches, "block"):
            inbox: dict[int, Parts] = {}
            for kind, n, a, b, c in zip(*(g[x].to_pylist() for x in NAMES[1:]), strict=True):
                inbox.setdefault(kind, []).append((n, a, b, c))
            if MEETINGS not in inbox:
                continue
            home = sorted(inbox[EXACT], key=lambda p: p[0])
            own = joined(home, 1, np.int64)
            v = joined(home, 2, np.float32).reshape(len(own), -1)
            ((_, sizes, where, members),) = inbox[MEETINGS]
            sizes, where, members = np.frombuffer(sizes, np.int32), np.frombuffer(where, np.int32), np.frombuffer(members, np.int64)
            got = inbox.get(CODES, [])
            numbers, keys = joined(got, 1, np.int64), joined(got, 3, np.int64)
            order = np.argsort(numbers)
            m = joined(got, 2, np.float32).reshape(len(numbers), -1)[order]
            keys = keys[order]
            host = np.repeat(np.arange(len(own)), sizes)
            sims = np.empty(len(host), np.float64)
            for a in range(0, len(host), 1 << 15):
                b = slice(a, a + (1 << 15))
                sims[b] = (v[host[b]].astype(np.float64) * m[where[b]]).sum(1)
            order = np.lexsort((keys[where], -sims, host))
            host, near, sims = host[order], keys[where[order]], sims[order]
            rank = np.arange(len(host)) - (np.cumsum(sizes) - sizes)[host]
            top = rank < (KEEP if every else TOP)
            host, near, sims = host[top], near[top], sims[top]
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(host, minlength=len(own)))]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.ListArray.from_arrays(ends, pa.array(near)), pa.ListArray.from_arrays(ends, pa.array(sims))], names=["id", "near", "sims"])

    exact = placed.select("block", F.lit(EXACT).alias("kind"), "n", F.col("ids").alias("a"), F.col("floats").alias("b"), F.lit(b"").alias("c"))
    answers = exchange(graph.mapInArrow(each(ask), MESSAGE), reply, exact).unionByName(exact)
    return answers.repartition(parallelism(placed.sparkSession), "block").sortWithinPartitions("block").mapInArrow(run, "id bigint, near array<bigint>, sims array<double>")


def firsts(vectors: DataFrame) -> DataFrame:
    """``(id, v, g, rank)``: the first ``TOP + 1`` of each group of equal vectors; the limit works before the shuffle, so a large group is no large task."""
    order = Window.partitionBy("g").orderBy("id")
    return vectors.withColumn("g", F.md5("v")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= TOP + 1)


def build(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame, Leaves]:
    """``(nodes, graph, leaves)``: the distinct vectors and the ``(id, near, sims)`` lists of all neighbours that they keep."""
    nodes = cut_lineage(firsts(vectors).select("id", "v"))
    placed, graph, leaves = descend(nodes, rounds)
    return nodes, cut_lineage(exact_lists(placed, graph, every=True)), leaves


def neighbour_lists(vectors: DataFrame) -> DataFrame:
    """``(id, rank, near_id, similarity)``: the nearest ``TOP`` of every usable vector."""
    vectors = cut_lineage(vectors)
    heads = cut_lineage(firsts(vectors))
    placed, graph, _ = descend(heads.select("id", "v"))
    lists = exact_lists(placed, graph)
    rows = lists.select("id", F.posexplode(F.arrays_zip("near", "sims")).alias("pos", "x")).select("id", (F.col("pos") + 1).alias("rank"), F.col("x.near").alias("near_id"), F.col("x.sims").alias("similarity"))
    others = vectors.select("id", F.md5("v").alias("g")).join(heads.select("id"), "id", "left_anti").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    groups = others.select("g").distinct()
    named = heads.filter(F.col("rank") <= TOP).join(groups, "g", "left_semi").select("g", F.col("id").alias("near_id"), "rank", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("salt"))
    copies = others.join(named, ["g", "salt"])
    return rows.unionByName(copies.select("id", "rank", "near_id", F.lit(1.0).alias("similarity")))


def mutual_pairs(lists: DataFrame, least: float) -> DataFrame:
    """``(id_a, id_b)``, a < b: each among the other's nearest, with at least that similarity."""
    edges = lists.filter(F.col("similarity") >= least)
    pairs = edges.groupBy(F.least("id", "near_id").alias("id_a"), F.greatest("id", "near_id").alias("id_b")).agg(F.count_distinct("id").alias("sides"))
    return pairs.filter("sides = 2").select("id_a", "id_b")


def exact_neighbours(vectors: DataFrame, queries: DataFrame, top: int = TOP, block: int = 4096) -> DataFrame:
    """Brute force of a stated query set against all rows, ``block`` queries at a time; for measuring recall.

    The queries of a block are sent to the executors (at most ``block`` vectors); each batch of rows sends back its best.
    """
    spark = vectors.sparkSession
    queries = cut_lineage(queries.select("id", "v"))
    n = -(-2 * queries.count() // block)
    blocks = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(max(n, 1))))
    out = None
    for b in range(n):
        rows = blocks.filter(F.col("block") == b).select("id", "v").toPandas()
        sent = spark.sparkContext.broadcast((rows["id"].to_numpy(), b"".join(rows["v"])))

        def run(batches, sent=sent):
            ids, data = sent.value
            q = np.frombuffer(data, np.float32).reshape(len(ids), -1)
            for batch in batches:
                m, keys = matrix(batch.column("v")), batch.column("id").to_numpy()
                if not len(keys):
                    continue
                s = q @ m.T
                s[ids[:, None] == keys[None, :]] = -2
                k = min(top, len(keys))
                part = np.argpartition(-s, k - 1, axis=1)[:, :k]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, k)), pa.array(keys[part].ravel()), pa.array(np.take_along_axis(s, part, 1).ravel().astype(np.float64))], names=["id", "near_id", "similarity"])

        found = vectors.select("id", "v").mapInArrow(run, "id bigint, near_id bigint, similarity double").filter("similarity > -2")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "id bigint, rank int, near_id bigint, similarity double")
    order = Window.partitionBy("id").orderBy(F.desc("similarity"), "near_id")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("id", "rank", "near_id", "similarity")


def search(nodes: DataFrame, graph: DataFrame, leaves: Leaves, queries: DataFrame, top: int = TOP, beam: int = 24, hops: int = 6, entries: int = 16) -> DataFrame:
    """Greedy search of the graph for each query ``(id, v)``: ``(id, rank, near_id, similarity)``.

    A query enters at nodes of its leaf in each tree, chosen by hash, goes to the neighbours and reverse neighbours of its
    beam, and keeps the nearest; a hop is a join of the beam with the edges and of what is new with the vectors.
    """
    out = graph.select("id", F.explode("near").alias("to"))
    edges = cut_lineage(out.unionByName(out.select(F.col("to").alias("id"), F.col("id").alias("to"))).distinct())
    asked = queries.select(F.col("id").alias("q"), F.col("v").alias("qv"))
    sent = nodes.sparkSession.sparkContext.broadcast(leaves)

    def deal(batches):
        for batch in batches:
            m, ids = matrix(batch.column("v")), batch.column("id").to_numpy()
            for tree in range(TREES if len(ids) else 0):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), tree)), pa.array(sent.value.of(tree, m, ids)), batch.column("id")], names=["tree", "leaf", "id"])

    placed = "tree bigint, leaf bigint, id bigint"
    order = Window.partitionBy("tree", "leaf").orderBy(F.xxhash64("id"))
    some = nodes.select("id", "v").mapInArrow(deal, placed).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= entries)
    starts = queries.select("id", "v").mapInArrow(deal, placed).withColumnRenamed("id", "q").join(some.select("tree", "leaf", "id"), ["tree", "leaf"]).select("q", "id")

    def similar(pairs: DataFrame) -> DataFrame:
        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    sims = (matrix(batch.column("v")) * matrix(batch.column("qv"))).sum(1, dtype=np.float64)
                    yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("id"), pa.array(sims)], names=["q", "id", "s"])

        return pairs.join(nodes, "id").join(asked, "q").filter("q <> id").select("q", "id", "v", "qv").mapInArrow(run, "q bigint, id bigint, s double")

    order = Window.partitionBy("q").orderBy(F.desc("s"), "id")
    near = cut_lineage(similar(starts.distinct()).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= beam).select("q", "id", "s"))
    for _ in range(hops):
        new = near.join(edges, "id").select("q", F.col("to").alias("id")).distinct().join(near.select("q", "id"), ["q", "id"], "left_anti")
        near = cut_lineage(near.unionByName(similar(new)).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= beam).select("q", "id", "s"))
    ranked = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select(F.col("q").alias("id"), "rank", F.col("id").alias("near_id"), F.col("s").alias("similarity"))
