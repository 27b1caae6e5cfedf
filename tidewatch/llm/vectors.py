"""Near-duplicate embeddings by hierarchical navigable small-world graphs, one for each shard."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewatch.llm.bytesops import BASE, U64, mix
from tidewatch.llm.components import connected_components
from tidewatch.llm.storage import discard, partitions, stored

#: How far over a border between two cells a vector's links are sought: in deviations of a link's share on one axis, were its direction random.
DEVIATIONS = 3.5
#: Pivots are less alike than this cosine; vectors of one crowd give one.
ALIKE = 0.82
#: Rows whose links are sought among all rows of their label, to audit the cells; their components, too, are bounded.
AUDITED, AUDITED_VALUES = 8192, 1 << 22
#: A vector with more links in its shard than this is compared with the whole shard.
CROWD = 256


class SmallWorld:
    """A navigable small-world graph with layers over unit vectors (Malkov and Yashunin, 2016), built in batches."""

    def __init__(self, vectors: np.ndarray, degree: int = 12, candidates: int = 48):
        self.x, self.degree = vectors, degree
        n = len(vectors)
        u = (mix(np.arange(1, n + 1, dtype=U64) * U64(BASE)) >> U64(11)).astype(float) / 2.0**53
        level = np.minimum(np.floor(-np.log(u + 1e-18) / np.log(degree)).astype(int), 4)
        order = np.argsort(-level, kind="stable")  # the top of the hierarchy first: every layer grows from its own seeds
        top = int(level.max()) if n else 0
        self.layers = [np.full((n, degree * (2 if k == 0 else 1)), -1, np.int32) for k in range(top + 1)]
        self.order, done = order, 0
        while done < n:
            batch = order[done : done + max(32, min(done, 256))]
            old = order[:done]
            for k in range(top, -1, -1):
                here = batch[level[batch] >= k]
                if not len(here):
                    continue
                ids, sims = self._inside(here)
                if len(among := old[level[old] >= k]):
                    far_ids, far_sims = self._nearest(here, among, candidates)
                    ids, sims = np.c_[ids, far_ids], np.c_[sims, far_sims]
                width = self.layers[k].shape[1]
                chosen = self._diverse(vectors[here], ids, sims, max(width // 2, 4))
                self.layers[k][here, : chosen.shape[1]] = chosen
                self._link_back(k, here, chosen)
            done += len(batch)

    def _inside(self, batch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sims = self.x[batch] @ self.x[batch].T
        np.fill_diagonal(sims, -2)
        best = np.argsort(-sims, 1)[:, : min(24, len(batch))]
        sims = np.take_along_axis(sims, best, 1)
        return np.where(sims > -2, batch[best], -1), sims

    def _nearest(self, batch: np.ndarray, old: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest of the rows that the layer has, by a scan: shards are small, and a missed one would be a link less."""
        sims = self.x[batch] @ self.x[old].T
        best = np.argpartition(-sims, min(most, len(old)) - 1, 1)[:, :most]
        return old[best], np.take_along_axis(sims, best, 1)

    def _diverse(self, q: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """From the nearest on, candidates that are nearer to the vector than to any one chosen before; then the nearest."""
        sims = np.where(ids < 0, -2.0, sims)
        by = np.argsort(-sims, 1)[:, :64]
        ids, sims = np.take_along_axis(ids, by, 1), np.take_along_axis(sims, by, 1)
        own = self.x[np.maximum(ids, 0)]
        between = own @ own.transpose(0, 2, 1)
        rows, width = ids.shape
        taken, count = np.zeros((rows, width), bool), np.zeros(rows, int)
        for j in range(width):
            blocked = (taken[:, :j] & (between[:, j, :j] > sims[:, j, None])).any(1) if j else np.zeros(rows, bool)
            taken[:, j] = ~blocked & (count < most) & (ids[:, j] >= 0)
            count += taken[:, j]
        first = np.argsort(~taken, 1, kind="stable")[:, :most]
        fill = np.take_along_axis(ids, first, 1)
        return fill.astype(np.int32)

    def _link_back(self, k: int, batch: np.ndarray, chosen: np.ndarray) -> None:
        """Each chosen neighbour gets a link back; where its list overflows, a diverse part of it stays."""
        source, target = np.repeat(batch, chosen.shape[1]), chosen.ravel()
        source, target = source[target >= 0], target[target >= 0]
        if not len(target):
            return
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, start, count = np.unique(target, return_index=True, return_counts=True)
        table, width = self.layers[k], self.layers[k].shape[1]
        extra = np.full((len(nodes), int(count.max())), -1, np.int32)
        extra[np.repeat(np.arange(len(nodes)), count), np.arange(len(target)) - np.repeat(start, count)] = source
        both = np.c_[table[nodes], extra]
        used = (both >= 0).sum(1)
        easy = used <= width
        packed = np.take_along_axis(both[easy], np.argsort(both[easy] < 0, 1, kind="stable")[:, :width], 1)
        table[nodes[easy]] = packed
        for at in range(0, int((~easy).sum()), 512):
            some = np.flatnonzero(~easy)[at : at + 512]
            ids = both[some]
            q = self.x[nodes[some]]
            sims = np.einsum("bd,bjd->bj", q, self.x[np.maximum(ids, 0)])
            kept = self._diverse(q, ids, sims, width)
            table[nodes[some]] = -1
            table[nodes[some], : kept.shape[1]] = kept

    def search(self, q: np.ndarray, beam: int, layer: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Nearest vectors (ids, cosines) of each query on a layer: descend from the top, then a beam of this width."""
        entry = np.full((len(q), 1), self.order[0], np.int64)
        for k in range(len(self.layers) - 1, layer, -1):
            entry = self._beam(q, entry, 4, k)[0][:, :1]
        return self._beam(q, entry, beam, layer)

    def _beam(self, q: np.ndarray, entry: np.ndarray, beam: int, layer: int) -> tuple[np.ndarray, np.ndarray]:
        table, n, rows = self.layers[layer], len(q), np.arange(len(q))
        seen = np.zeros((n, len(self.x)), bool)
        ids = np.full((n, beam), -1, np.int64)
        sims = np.full((n, beam), -3.0, np.float32)
        ids[:, :1], sims[:, :1] = entry, np.einsum("bd,bd->b", q, self.x[entry[:, 0]])[:, None]
        seen[rows, entry[:, 0]] = True
        done = np.zeros((n, beam), bool)
        live, step = rows, 1 if beam < 8 else 3
        while len(live):
            open_sims = np.where(done[live] | (ids[live] < 0), -9, sims[live])
            pick = np.argpartition(-open_sims, min(step, beam - 1), 1)[:, :step]
            some = np.take_along_axis(open_sims, pick, 1) > -9
            busy = some.any(1)
            live, pick, some = live[busy], pick[busy], some[busy]
            if not len(live):
                break
            done[live[:, None], pick] = True
            near = np.where(some[:, :, None], table[np.maximum(ids[live[:, None], pick], 0)], -1).reshape(len(live), -1)
            fresh = (near >= 0) & ~seen[live[:, None], np.maximum(near, 0)]
            r, c = np.nonzero(fresh)
            who = near[r, c]
            key, first = np.unique(r * len(self.x) + who, return_index=True)
            r, who = r[first], who[first]
            seen[live[r], who] = True
            width = int(np.bincount(r, minlength=len(live)).max()) if len(r) else 0
            if not width:
                continue
            more_ids, more = np.full((len(live), width), -1, np.int64), np.full((len(live), width), -3.0, np.float32)
            heads = np.searchsorted(r, np.arange(len(live)))
            at = np.arange(len(r)) - heads[r]
            more_ids[r, at] = who
            more[r, at] = np.einsum("bd,bd->b", q[live[r]], self.x[who])
            all_ids, all_sims = np.c_[ids[live], more_ids], np.c_[sims[live], more]
            all_done = np.c_[done[live], np.zeros((len(live), width), bool)]
            best = np.argsort(-all_sims, 1, kind="stable")[:, :beam]
            ids[live], sims[live] = np.take_along_axis(all_ids, best, 1), np.take_along_axis(all_sims, best, 1)
            done[live] = np.take_along_axis(all_done, best, 1)
        return ids, sims

    def around(self, rows: np.ndarray, least: float, first: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs (place in ``rows``, row) of cosine >= ``least`` found from each row's own place in the graph, and the crowded ones.

        A row's list is read, then those of the ``first`` nearest of it, then those of all that may be linked with what
        is linked with the row, as long as there are any. A row with more than ``CROWD`` pairs is given up as crowded.
        """
        table, n, b = self.layers[0], len(self.x), len(rows)
        floor = 2 * least * least - 1 - 1e-4 if least > 0 else -1.0
        seen, crowded = np.zeros((b, n), bool), np.zeros(b, bool)
        seen[np.arange(b), rows] = True
        count, found = np.zeros(b, int), []
        q, at, hop = np.arange(b), rows, 0
        while len(q):
            r, c = np.repeat(q, table.shape[1]), table[at].ravel()
            fresh = (c >= 0) & ~seen[r, np.maximum(c, 0)]
            pair = np.unique(r[fresh] * n + c[fresh])
            r, c = pair // n, pair % n
            seen[r, c] = True
            sims = np.einsum("bd,bd->b", self.x[rows[r]], self.x[c])
            near = sims >= least - 1e-4
            found.append(pair[near])
            count += np.bincount(r[near], minlength=b)
            go = sims >= floor
            if hop == 0:
                by = np.lexsort((-sims, r))
                go[by[np.arange(len(by)) - np.searchsorted(r[by], r[by]) < first]] = True
            crowded |= count > CROWD
            go &= ~crowded[r]
            q, at, hop = r[go], c[go], hop + 1
        pair = np.concatenate(found)
        return pair // n, pair % n, crowded


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


def scanned(exact: np.ndarray, queries: np.ndarray, which: np.ndarray, least: float) -> np.ndarray:
    """Pairs (query row, shard row) of cosine >= least by a full scan, for these query rows."""
    parts = [np.argwhere(queries[which[at : at + 256]] @ exact.T >= least) + [at, 0] for at in range(0, len(which), 256)]
    pairs = np.concatenate([np.zeros((0, 2), np.int64), *parts])
    return np.c_[which[pairs[:, 0]], pairs[:, 1]]


def linked(graph: SmallWorld | None, exact: np.ndarray, queries: np.ndarray, least: float, beam: int, recall: float) -> np.ndarray:
    """Pairs (query row, shard row) of cosine >= least in double precision. The queries are no rows of the shard.

    Every 16th query is compared with the whole shard; so is one whose whole beam is linked, and so are all if the search
    has missed more than ``recall`` allows of the audited links. (In shards of some thousand rows a scan takes less than
    beams much wider than the first.)
    """
    n, every = len(exact), np.arange(len(queries))
    if graph is None or beam >= n:
        return scanned(exact, queries, every, least)
    truth = scanned(exact, queries, every[::16], least)
    parts = [graph.search(queries[at : at + 1024].astype(np.float32), beam) for at in range(0, len(queries), 1024)]
    ids, near = np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
    r, c = np.nonzero((near >= least - 1e-4) & (ids >= 0))
    crowded = (np.bincount(r, minlength=len(queries)) >= beam) & (every % 16 > 0)
    pairs = np.c_[r, ids[r, c]]
    pairs = pairs[np.einsum("bd,bd->b", queries[pairs[:, 0]], exact[pairs[:, 1]]) >= least]
    sure = pairs[(pairs[:, 0] % 16 == 0) & (np.bincount(r, minlength=len(queries))[pairs[:, 0]] < beam)]
    due = truth[np.bincount(r, minlength=len(queries))[truth[:, 0]] < beam]
    if len(sure) < recall * len(due):
        return scanned(exact, queries, every, least)
    searched = pairs[~crowded[pairs[:, 0]] & (pairs[:, 0] % 16 > 0)]
    return np.concatenate([truth, searched, scanned(exact, queries, np.flatnonzero(crowded), least)])


def linked_rows(graph: SmallWorld | None, exact: np.ndarray, least: float, beam: int, recall: float, nearest: int = 10, nearest_recall: float = 0.9) -> tuple[np.ndarray, int, np.ndarray]:
    """Which rows of a shard are linked with each other (a symmetric matrix), the beam that passed the audit, and the audit.

    A row's links are sought from its own place in the graph and checked in double precision; a crowded row is compared
    with the whole shard, and so are all rows if a full scan of every 16th shows that less than ``recall`` of the links
    were found. The beam of searches from the top, by which others ask, doubles until it finds the audited rows'
    ``nearest`` neighbours, whatever their cosine, up to ``nearest_recall``. The audit is (neighbours found, neighbours audited).
    """
    n, every = len(exact), np.arange(len(exact))
    audit = every[::16]
    sims = exact[audit] @ exact.T
    sims[np.arange(len(audit)), audit] = -2
    truth, k = sims >= least, min(nearest, n)
    close = np.argpartition(-sims, k - 1, 1)[:, :k]
    close_keys = (audit[:, None] * n + close)[np.take_along_axis(sims, close, 1) > -2]
    hits = len(close_keys)
    while beam < n:
        ids, _ = graph.search(graph.x[audit], beam)
        hits = np.isin(close_keys, audit[:, None] * n + ids).sum()
        if hits >= nearest_recall * len(close_keys):
            break
        hits, beam = len(close_keys), beam * 2
    links = np.zeros((n, n), bool)
    for at in range(0, n, 512) if graph is not None else ():
        rows = every[at : at + 512]
        r, c, crowded = graph.around(rows, least)
        true = np.einsum("bd,bd->b", exact[rows[r]], exact[c]) >= least
        links[rows[r[true]], c[true]] = True
        links[tuple(scanned(exact, exact, rows[crowded], least).T)] = True
    links |= links.T
    if graph is None or (links[audit] & truth).sum() < recall * truth.sum():
        for at in range(0, n, 256):
            links[at : at + 256] = exact[at : at + 256] @ exact.T >= least
        links |= links.T
    np.fill_diagonal(links, False)
    return links, beam, np.array([hits, len(close_keys)])


def joined(links: np.ndarray) -> np.ndarray:
    """The smallest row that each row reaches by links."""
    root, todo = np.arange(len(links)), links.any(1)
    for i in np.flatnonzero(todo):
        front = np.array([i])[todo[[i]]]
        while len(front):
            root[front], todo[front] = i, False
            reached = np.zeros(len(links), bool)
            for at in range(0, len(front), 512):
                reached |= links[front[at : at + 512]].any(0)
            front = np.flatnonzero(reached & todo)
    return root


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what all of the pairs connect: at most one for each node."""
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


class Cells:
    """Cells of one label's unit vectors: each belongs to its nearest pivot, and links over borders are asked from one side.

    A vector whose link lies in another cell is not farther from the border than the link is long (``radius``), whatever
    its direction; so cells whose border is within ``reach`` of it are asked. At ``reach`` = ``radius`` none is missed.
    """

    def __init__(self, pivots: np.ndarray):
        self.pivots = pivots
        self.apart = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0))

    def of(self, x: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's cell, and which other cells it asks (a matrix)."""
        sims = x @ self.pivots.T
        home = sims.argmax(1)
        near = sims.max(1, keepdims=True) - sims <= reach * self.apart[home] + 1e-9
        return home, near & asks(home, len(self.pivots))


def asks(home: np.ndarray, k: int) -> np.ndarray:
    """Of ``k`` places on a circle, those that each place asks: of two, one asks the other, and all ask about as many."""
    other = np.arange(k)[None]
    step = (other - home[:, None]) % k
    return (step > 0) & ((2 * step < k) | ((2 * step == k) & (home[:, None] < other)))


def diverse(candidates: np.ndarray, most: int) -> np.ndarray:
    chosen = candidates[:1]
    for x in candidates[1:]:
        if len(chosen) < most and (chosen @ x).max() < ALIKE:
            chosen = np.vstack([chosen, x])
    return chosen


def unit_rows(column: pa.Array) -> np.ndarray:
    return unit(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1))


class Shard:
    """Rows that are indexed together: their own links, then those of others that ask, block by block."""

    def __init__(self, space: str, part: int, ids: np.ndarray, copies: np.ndarray, exact: np.ndarray, least: float, beam: int, recall: float):
        self.space, self.ids, self.copies, self.exact, self.least, self.recall = space, ids, copies, exact, least, recall
        self.graph = SmallWorld(exact.astype(np.float32)) if len(ids) > beam else None
        links, self.beam, self.audit = linked_rows(self.graph, exact, least, beam, recall)
        if len(np.unique(ids)) < len(ids):
            links &= ids[:, None] != ids
        self.root, self.links, self.edges = joined(links), np.zeros(len(ids), np.int64), []
        if part:  # another part of those that ask the same rows; the first reports the rows' own links
            self.audit[:] = 0
            return
        for at in range(0, len(ids), 512):
            r, c = np.nonzero(links[at : at + 512])
            self.links[at : at + 512] += np.bincount(r, copies[c], len(links[at : at + 512])).astype(np.int64)
        some = np.flatnonzero(self.root != np.arange(len(ids)))
        self.edges = list(zip(ids[some].tolist(), ids[self.root[some]].tolist()))

    def ask(self, ids: np.ndarray, copies: np.ndarray, queries: np.ndarray) -> pa.RecordBatch:
        a, b = linked(self.graph, self.exact, queries, self.least, self.beam, self.recall).T
        other = ids[a] != self.ids[b]
        a, b = a[other], b[other]
        self.links += np.bincount(b, copies[a], len(self.ids)).astype(np.int64)
        pair = np.unique(a * len(self.ids) + self.root[b])
        return self.report(ids, np.bincount(a, self.copies[b], len(ids)).astype(np.int64), forest(ids[pair // len(self.ids)], self.ids[pair % len(self.ids)]), False)

    def done(self) -> pa.RecordBatch:
        return self.report(self.ids, self.links, self.edges, True)

    def report(self, ids: np.ndarray, links: np.ndarray, edges: list[tuple[int, int]], last: bool) -> pa.RecordBatch:
        some = np.flatnonzero(links)
        m, k, end = len(some), len(edges), [None] * last
        return pa.RecordBatch.from_pydict({
            "src": pa.array([*ids[some].tolist(), *[x for x, _ in edges], *end], pa.int64()), "dst": pa.array([None] * m + [y for _, y in edges] + end, pa.int64()), "links": pa.array([*links[some].tolist(), *[None] * k, *end], pa.int64()),
            "space": pa.array([None] * (m + k) + [self.space] * last, pa.string()), "hits": pa.array([None] * (m + k) + [int(self.audit[0])] * last, pa.int64()), "audited": pa.array([None] * (m + k) + [int(self.audit[1])] * last, pa.int64()),
        })


def near_vectors(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", label: str = "label", least: float = 0.98, shard_rows: int = 6000, block_rows: int = 2048, beam: int = 48, recall: float = 0.999, audited: bool = False) -> DataFrame:
    """(key, n_links, component_id, kept): groups of vectors of one label linked by cosine >= least.

    Equal vectors of a label form a class; only its smallest id goes on, with the number of its copies. A label of more
    than ``shard_rows`` classes is cut into cells by pivots (a documented sample: about one class in 4,500, chosen by
    hash), and each class is indexed in its cell. Cells of more than ``shard_rows`` are dealt by hash over several
    shards. A shard is a group of rows in one task: its graph holds all of them, its rows find their links from their
    own places in it, and classes of other shards whose links may lie there ask it in blocks of ``block_rows``. Which
    cells a class asks follows its distance from their borders (see ``Cells``): links of up to ``AUDITED`` hashed
    classes with all classes of their label are compared with what would meet, and a label's distance is widened until the
    share ``recall`` of its own meets; at its greatest none can be missed. Of two shards one asks the other, and a found pair counts
    for both its classes, so links are symmetric. Shards that very many ask are indexed in several tasks. A task reports
    numbers of links and a spanning forest of them, so its output grows with its rows and not with their pairs. With
    ``audited`` there is ``audited_recall``: the share of audited rows' nearest neighbours in their own shards that searches
    from the top found (see ``linked_rows``), null without any.

    Vectors that are null, empty, zero or hold null or non-finite components, and vectors without a label, are linked
    with nothing: 0 links, their own component. So are vectors of different lengths. Rows with a null id get null
    links and components, and are kept. Repeated rows are copies of each other.
    """
    v = F.col(embedding)
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"), v.cast("array<double>").alias("v"))
    sound = "id is not null and label is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)"
    valid = rows.withColumn("ok", F.coalesce(F.expr(sound), F.lit(False)))
    classes = valid.where("ok").groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    classes = stored(classes.withColumn("space", F.concat_ws(":", F.size("v").cast("string"), "label")), "vector-classes")
    sizes = classes.groupBy("space").agg(F.count("*").alias("n"))
    large = {r["space"]: r["n"] for r in sizes.where(F.col("n") * 8 > shard_rows).collect()}  # at most 8 for each shard_rows rows
    radius = math.sqrt(max(0.0, 2 - 2 * least))
    routes, cells = dealt(classes, sizes, large, shard_rows, radius, least, recall)
    counts = {(r["space"], r["cell"]): r["n"] for r in routes.groupBy("space", "cell").agg(F.count("*").alias("n")).where(F.col("n") * 8 > shard_rows).collect()}
    askers = {(r["space"], r["cell"]): r["n"] for r in routes.select("space", F.explode("asks").alias("cell")).groupBy("space", "cell").agg(F.count("*").alias("n")).collect()}
    shards, number = {}, 0  # (space, cell) to its first task, its shards, and the parts of each shard's askers
    for at in sorted({*counts, *((space, c) for space in cells for c in range(len(cells[space].pivots)))}):
        n = counts.get(at, 1)
        subs = math.ceil(n / shard_rows)
        parts = max(1, math.ceil((askers.get(at, 0) + n * (subs - 1) / subs / 2) / (8 * shard_rows)))
        shards[at] = (number, subs, parts)
        number += subs * parts
    rest = partitions(vectors.sparkSession)

    def members(batches):
        """Rows as they are indexed (asks = 0) and as they ask (asks = 1), each to the task of its shard."""
        for batch in batches:
            spaces, cell, lot = batch.column("space").to_pylist(), batch.column("cell").to_pylist(), batch.column("lot").to_pylist()
            out = []  # row, task, cell, shard, part, asks
            for i, (space, home, h, other) in enumerate(zip(spaces, cell, lot, batch.column("asks").to_pylist())):
                first, subs, parts = shards.get((space, home), (number + h[1] % rest, 1, 1))
                own = h[0] % subs
                out += [(i, first + own * parts + part, home, own, part, 0) for part in range(parts)]
                part = h[0] // subs % parts
                if subs > 1:
                    out += [(i, first + s * parts + part, home, s, part, 1) for s in np.flatnonzero(asks(np.array([own]), subs)[0]).tolist()]
                for c in other:
                    first, subs, parts = shards[space, c]
                    part = h[0] % parts
                    out += [(i, first + s * parts + part, c, s, part, 1) for s in range(subs)]
            to = np.array(out, np.int64).reshape(-1, 6)
            taken = batch.select(["space", "rep", "copies", "v"]).take(pa.array(to[:, 0]))
            yield pa.RecordBatch.from_arrays([*[pa.array(to[:, j].astype(np.int32)) for j in range(1, 6)], *taken.columns], ["task", "cell", "shard", "part", "asks", "space", "rep", "copies", "v"])

    lots = F.array(F.shiftrightunsigned(F.xxhash64("rep"), 1), F.shiftrightunsigned(F.xxhash64("space"), 1))
    placed = routes.select("space", "cell", "asks", "rep", "copies", "v", lots.alias("lot")).mapInArrow(members, "task int, cell int, shard int, part int, asks int, space string, rep long, copies long, v array<double>")
    order = ["space", "cell", "shard", "part", "asks"]
    placed = placed.repartitionById(number + rest, F.col("task")).drop("task").sortWithinPartitions(*order, "rep")

    def search(batches):
        at, shard, gathered = None, None, []

        def built():
            return Shard(at[0], at[3], *[np.concatenate(x) for x in zip(*gathered)], least, beam, recall)

        for which, ids, copies, x in runs(batches, order):
            if which[4] == 0:
                if which[:4] != at:
                    if at is not None:
                        yield (shard or built()).done()
                    at, shard, gathered = which[:4], None, []
                gathered.append((ids, copies, x))
            elif which[:4] == at:  # else nothing is indexed there
                shard = shard or built()
                for i in range(0, len(ids), block_rows):
                    yield shard.ask(ids[i : i + block_rows], copies[i : i + block_rows], x[i : i + block_rows])
        if at is not None:
            yield (shard or built()).done()

    found = stored(placed.mapInArrow(search, "src long, dst long, links long, space string, hits long, audited long"), "vector-links")
    if cells:
        discard(routes)
    comps = connected_components(found.where("dst is not null").select("src", "dst"))
    counts = found.where("links is not null").groupBy("src").agg(F.sum("links").alias("links"))
    whole = classes.select("space", "label", "v", "rep", "copies").join(counts.withColumnRenamed("src", "rep"), "rep", "left").join(comps.select(F.col("node").alias("rep"), "component"), "rep", "left")
    shares = found.where("space is not null").groupBy("space").agg((F.sum("hits") / F.sum("audited")).alias("audited_recall"))
    whole = whole.join(shares, "space", "left") if audited else whole.withColumn("audited_recall", F.lit(None).cast("double"))
    whole = whole.select("label", "v", "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"), "audited_recall")
    a, b = valid.alias("a"), whole.alias("b")
    out = a.join(b, F.col("a.ok") & (F.col("a.label") == F.col("b.label")) & (F.col("a.v") == F.col("b.v")), "left")
    out = out.select(F.col("a.id").alias(key), F.when(F.col("a.id").isNotNull(), F.coalesce("b.n_links", F.lit(0))).alias("n_links"), F.coalesce("b.component_id", "a.id").alias("component_id"), *(["b.audited_recall"] if audited else []))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))


def dealt(classes: DataFrame, sizes: DataFrame, large: dict[str, int], shard_rows: int, radius: float, least: float, recall: float) -> tuple[DataFrame, dict[str, Cells]]:
    """Each class with its cell and the cells it asks (space, cell, asks, rep, copies, v), and the cells of labels that have several."""
    big = {space: n for space, n in large.items() if n > shard_rows}
    if not big:
        return classes.select("space", F.lit(0).alias("cell"), F.array().cast("array<int>").alias("asks"), "rep", "copies", "v"), {}
    cells, sample = {}, {}
    width = max(int(space.split(":")[0]) for space in big)
    audited, each = min(AUDITED, AUDITED_VALUES // width), max(1, shard_rows * 3 // 4)
    share = max(5 / each, audited / sum(big.values()))
    lot = F.pmod(F.xxhash64("rep", F.lit(11)), F.lit(1 << 40)) / float(1 << 40)
    some = classes.join(sizes.where(F.col("n") > shard_rows).select("space"), "space").where(lot < share).select("space", "rep", "v", lot.alias("lot"))
    picked = {}
    for r in sorted(some.collect(), key=lambda r: (r["lot"], r["rep"])):
        picked.setdefault(r["space"], []).append(r)
    for space, found in picked.items():
        x, few = unit(np.array([r["v"] for r in found])), max(1, audited * big[space] // sum(big.values()))
        cells[space] = Cells(diverse(x, math.ceil(big[space] / each)))
        sample[space] = x[:few], np.array([r["rep"] for r in found[:few]])
    reach = {space: radius * min(1.0, DEVIATIONS / math.sqrt(int(space.split(":")[0]))) for space in cells}
    while True:

        def route(batches, reach=reach):
            placed = {space: cells[space].of(x, reach[space]) for space, (x, _) in sample.items()}
            for batch in batches:
                spaces = np.array(batch.column("space").to_pylist(), object)
                home, others = np.zeros(len(spaces), np.int32), [[]] * len(spaces)
                truth, met = np.zeros(len(spaces), np.int64), np.zeros(len(spaces), np.int64)
                for space in set(spaces.tolist()) & cells.keys():
                    rows = np.flatnonzero(spaces == space)
                    x = unit_rows(batch.column("v").take(pa.array(rows)))
                    home[rows], asked = cells[space].of(x, reach[space])
                    for i, o in zip(rows.tolist(), asked):
                        others[i] = np.flatnonzero(o).tolist()
                    (known, ids), (at, asked_by) = sample[space], placed[space]
                    a, b = np.concatenate([np.argwhere(x[i : i + 512] @ known.T >= least) + [i, 0] for i in range(0, len(x), 512)]).T
                    other = batch.column("rep").to_numpy()[rows[a]] != ids[b]
                    a, b = a[other], b[other]
                    meet = (home[rows[a]] == at[b]) | asked[a, at[b]] | asked_by[b, home[rows[a]]]
                    truth[rows] += np.bincount(a, minlength=len(rows))
                    met[rows] += np.bincount(a[meet], minlength=len(rows))
                yield pa.RecordBatch.from_arrays([*batch.select(["space", "rep", "copies", "v"]).columns, pa.array(home), pa.array(others, pa.list_(pa.int32())), pa.array(truth), pa.array(met)], ["space", "rep", "copies", "v", "cell", "asks", "truth", "met"])

        routes = stored(classes.select("space", "rep", "copies", "v").mapInArrow(route, "space string, rep long, copies long, v array<double>, cell int, asks array<int>, truth long, met long"), "vector-routes")
        short = routes.groupBy("space").agg(F.sum("truth").alias("truth"), F.sum("met").alias("met")).where(F.col("met") < recall * F.col("truth"))
        short = [r["space"] for r in short.collect() if reach[r["space"]] < radius]
        if not short:
            return routes, cells
        discard(routes)
        reach = reach | {space: min(radius, 1.5 * reach[space]) for space in short}


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, np.ndarray, np.ndarray, np.ndarray]]:
    """(values of ``keys``, ids, copies, unit vectors) of neighbouring rows with equal keys, batch by batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.any([c[1:] != c[:-1] for c in columns], 0)
        ends = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
        for a, b in zip(ends, ends[1:]):
            part = batch.slice(a, b - a)
            yield tuple(c[a] if isinstance(c[a], str) else int(c[a]) for c in columns), part.column("rep").to_numpy(), part.column("copies").to_numpy(), unit_rows(part.column("v"))
