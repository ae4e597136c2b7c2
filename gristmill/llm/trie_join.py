"""N-gram Jaccard join on a prefix tree.

Equal sets are merged into classes first, of which one row each goes on. Shingles have one global
order: by the number of classes that have them, in powers of two, rare ones first, then by a mark
of the blocks that have them, then by hash; so shingles of one passage come one after the other.
Blocks of documents learn that order from hashed buckets. Two sets that link share one of the
first shingles of either, so documents meet by the shingles of these prefixes and by size class;
the place of the first shared shingle bounds the size of the partner once more.

What meets is joined on a trie of the globally ordered sets, read from the common end, so that near
copies share long paths. A set walks down the trie level by level with the overlap so far; a
subtree is left when what remains of the set and of its longest path can no longer reach the
overlap that the sizes ask for, or when all of its documents are connected to the set already.

So that a set does not travel to all of its prefix shingles, shingles are gathered first: of those
with the same documents one is enough, none is needed whose documents all come from one earlier
shingle, and those whose largest component is the same one are joined together. A gathering of
one chunk is joined at once and done. A larger one is dealt into chunks and comes in rounds: first
each chunk is joined by itself, which connects most of a large group of near copies; shingles
whose documents are all connected by then are done, and at last, when a round no longer halves the
components, only pairs of different ones are of interest: the documents outside of the largest
component (the strays) are joined with every chunk. Only shingles of gatherings that are not done are listed again. No link between different
texts is lost, and pairs within a component are never listed.

Links are exact on 64-bit hashes of shingles (and of the rows that stand for classes). Defined cases: null and blank texts have empty sets and
link with nothing; a text of fewer words than a shingle has is one shingle, and a text of any
length is read whole. Rows that share a doc_id are one node: texts that link with either of them
are in one component. A null doc_id comes before all others. Other columns, whatever their names,
are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks as B
from .components import connected_components
from .letters import find
from .words import U64, WORD_BASE, WORD_INV, Words, distinct_per_doc, mix, slices, spans_hash

#: Sets and shingle hashes of a chunk, about.
CHUNK_SETS, CHUNK_HASHES = 500, 1_000_000
#: A null doc_id.
NULL_ID = -(2**63)
_SECOND = U64(0xE7037ED1A0B428DB)
ROWS = "id long, th long, n long, f1 long, f2 long"
SETS = "id long, th long, n long, body binary, key array<long>, before array<long>, guest array<tinyint>, room array<long>"
LINKS = "u long, v long"


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    """How many first shingles of a set of n one with such a similarity cannot all miss."""
    return n - -(-n * percent // 100) + 1


def room(n: np.ndarray, place: np.ndarray, percent: int) -> np.ndarray:
    """Largest partner of a set of n whose first shared shingle stands at a place."""
    return (100 + percent) * (n - place) // percent - n


def size_class(n: np.ndarray, percent: int) -> np.ndarray:
    """Sets that link are in the same class or in neighbouring ones."""
    edges = [1]
    while edges[-1] <= int(n.max(initial=1)):
        edges.append(edges[-1] * 100 // percent + 1)
    return np.searchsorted(np.array(edges), n, "right")


def _sets(column: pa.Array, k: int):
    """Yields (first row, number of documents, document and hash of each distinct shingle)."""
    for lo, data, offsets in slices(column):
        w = Words(data, offsets, lower=True)
        yield lo, len(offsets) - 1, *distinct_per_doc(*w.shingles(k))


def _signatures(k: int):
    def f(batches):
        for b in batches:
            for lo, n, doc, h in _sets(b.column("text"), k):
                first = np.searchsorted(doc, np.arange(n + 1))
                one = spans_hash(h, first[:-1], first[1:], WORD_BASE, WORD_INV)
                two = spans_hash(h ^ _SECOND, first[:-1], first[1:], WORD_BASE, WORD_INV)
                own = {c: b.column(c).slice(lo, n) for c in ("id", "th")}
                yield pa.record_batch(own | {"n": np.diff(first), "f1": one.view(np.int64), "f2": two.view(np.int64)})

    return f


def _row_keys(table: pa.Table) -> np.ndarray:
    return mix(table["id"].to_numpy().view(U64)) ^ mix(table["th"].to_numpy().view(U64) + U64(1))


def _chosen(table: pa.Table, marks: pa.Table) -> pa.Table:
    """The block's rows that stand for a class, each once, in a fixed order."""
    own, wanted = _row_keys(table), np.sort(_row_keys(marks))
    keys, first = np.unique(own, return_index=True)
    return table.take(pa.array(first[find(wanted, keys) >= 0]))


def _low(h: np.ndarray) -> np.ndarray:
    return (h & U64(2**32 - 1)).astype(np.uint32)


#: Counts travel as eighths of their logarithm to the base of two.
def _packed_count(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.rint(8 * np.log2(n)), 255).astype(np.uint8)


def _ask(k: int, buckets: int):
    def f(key, table, marks):
        table = _chosen(table, marks)
        found = [h for _, _, _, h in _sets(table["text"], k)] if table.num_rows else []
        if not found:
            return B.asks([])
        h, n = np.unique(np.concatenate(found), return_counts=True)
        # the bucket tells the high bits; the low 32 tell shingles apart within it
        return B.asks([(key[0].as_py(), b, B.pack(_low(h[i]), _packed_count(n[i]))) for b, i in B.split(h, buckets)])

    return f


def _answer(key, table):
    blocks, bodies = table["block"].to_pylist(), table["body"].to_pylist()
    who, (low, n) = B.merged(bodies, "u4", "u1")
    order = np.argsort(low, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], low[order][1:] != low[order][:-1]]))
    many = np.diff(np.append(first, len(low)))
    total = np.add.reduceat(2.0 ** (n[order] / 8), first)
    # 0: a shingle that only one class has
    rank = np.where(total > 1.5, np.ceil(np.log2(np.maximum(total, 1))), 0)
    mark = np.bitwise_xor.reduceat(mix(np.array(blocks, U64))[who[order]], first) >> U64(48)
    rank_of, mark_of = np.empty(len(low), np.uint8), np.empty(len(low), np.uint16)
    rank_of[order], mark_of[order] = np.repeat(rank, many), np.repeat(mark, many)
    edges = np.searchsorted(who, np.arange(len(blocks) + 1))
    out = []
    for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        own = rank_of[a:b] > 0
        if own.any():
            out.append((blocks[i], key[0].as_py(), B.pack(low[a:b][own], rank_of[a:b][own], mark_of[a:b][own])))
    return B.asks(out)


def _survivors(k: int, percent: int, buckets: int):
    """Sets that share a prefix shingle with another one: their hashes and ranks from the common end, and their prefix shingles."""

    def f(key, table, told):
        step = told["step"].to_numpy()
        table = _chosen(table, told.filter(pa.array(step == 0)))
        replies = told.filter(pa.array(step == 1))
        out: list[list] = [[], [], [], []]
        flat: list[tuple] = []
        if table.num_rows and replies.num_rows:
            number = replies["bucket"].to_pylist()
            each = [B.unpack(x, "u4", "u1", "u2") for x in replies["body"].to_pylist()]
            known = np.concatenate([(U64(b) << U64(32)) + e[0] for b, e in zip(number, each, strict=True)])
            # rank and mark in one number: the place of a shingle in the global order, but for its hash
            level_of = np.concatenate([(e[1].astype(np.uint32) << 16) + e[2] for e in each])
            order = np.argsort(known)
            known, level_of = known[order], level_of[order]
            row_id, row_th = table["id"].to_numpy(), table["th"].to_numpy()
            for lo, n_docs, doc, h in _sets(table["text"], k):
                at = find(known, (B.bucket_of(h, buckets).astype(U64) << U64(32)) + (h & U64(2**32 - 1)))
                level = np.where(at >= 0, level_of[np.maximum(at, 0)], 0).astype(np.uint32)
                order = np.lexsort((h, level, doc))  # documents stay together
                h, level = h[order], level[order]
                first = np.searchsorted(doc, np.arange(n_docs + 1))
                size = np.diff(first)
                place = np.arange(len(h)) - first[doc]
                inside = (place < prefix_length(size, percent)[doc]) & (level > 0)
                has = np.bincount(doc[inside], minlength=n_docs) > 0
                for d in np.flatnonzero(has).tolist():
                    a, b = first[d], first[d + 1]
                    for column, value in zip(out, (row_id[lo + d], row_th[lo + d], b - a, B.pack(h[a:b][::-1], level[a:b][::-1])), strict=True):
                        column.append(value)
                flat.append(_meetings(doc[inside], h[inside], place[inside], size, percent))
        many, *parts = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*flat, strict=True) if flat else [()] * 5)]
        offsets = pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32))
        kinds = (pa.int64(), pa.int64(), pa.int8(), pa.int64())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(t.to_pandas_dtype()), t)) for x, t in zip(parts, kinds, strict=True)]
        ids, ths, sizes, bodies = out
        own = {"id": pa.array(ids, pa.int64()), "th": pa.array(ths, pa.int64()), "n": pa.array(sizes, pa.int64()), "body": pa.array(bodies, pa.binary())}
        return pa.table(own | dict(zip(("key", "before", "guest", "room"), lists, strict=True)))

    return f


def _meetings(doc: np.ndarray, h: np.ndarray, place: np.ndarray, size: np.ndarray, percent: int):
    """How many meeting points each document has, and all of them one after the other: key (shingle and size class), the key before (0: none), guest, room.

    A set is at home in its own class, and a guest of the next one where its room allows.
    """
    own = size_class(size, percent)
    most = room(size[doc], place, percent)
    ahead = size_class(np.maximum(most, 1), percent) > own[doc]
    guest = np.repeat([0, 1], [len(doc), int(ahead.sum())])
    follows = np.zeros(len(doc), bool)
    follows[1:] = doc[1:] == doc[:-1]
    doc, h, most, follows, last = (np.concatenate([x, x[ahead]]) for x in (doc, h, most, follows, np.roll(h, 1)))
    salt = mix((own[doc] + guest).astype(U64))
    key, before = mix(h ^ salt).view(np.int64), np.where(follows, mix(last ^ salt).view(np.int64), 0)
    order = np.argsort(doc, kind="stable")
    many = np.bincount(doc, minlength=len(size))
    return many[many > 0], key[order], before[order], guest[order], most[order]


class Trie:
    """Path-compressed prefix tree of token sequences, with the bounds of each subtree; a level of it is walked at once."""

    def __init__(self, rows: list[np.ndarray], sizes: np.ndarray):
        """rows: sorted tokens of each document, in lexicographic order; sizes: of the whole sets."""
        self.rows, self.sizes = rows, sizes
        #: node: [row its label is from, label start, label end, first document, end of documents, children, documents that end here]
        nodes: list[list] = [[0, 0, 0, 0, len(rows), [], []]]
        path = [0]
        for i, row in enumerate(rows):
            common = self._common(rows[i - 1], row) if i else 0
            while len(path) > 1 and nodes[path[-1]][1] >= common:
                nodes[path.pop()][4] = i
            top = path[-1]
            if nodes[top][2] > common:  # the label is cut: what lies below becomes a child
                a, b, c, d, _, children, ends = nodes[top]
                nodes.append([a, common, c, d, i, children, ends])
                nodes[top] = [a, b, common, d, 0, [len(nodes) - 1], []]
            if len(row) > common:
                nodes.append([i, common, len(row), i, 0, [], [i]])
                nodes[top][5].append(len(nodes) - 1)
                path.append(len(nodes) - 1)
            else:
                nodes[top][6].append(i)
        for p in path:
            nodes[p][4] = len(rows)
        lengths = np.array([len(r) for r in rows])
        base = np.concatenate([[0], np.cumsum(lengths)])
        self.tokens = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        row, a, b, self.first, self.end = (np.array([n[x] for n in nodes]) for x in range(5))
        self.start, self.stop = base[row] + a, base[row] + b
        self.longest = np.array([lengths[n[3] : n[4]].max() - n[2] for n in nodes])
        self.least = np.array([sizes[n[3] : n[4]].min() for n in nodes])
        self.most = np.array([sizes[n[3] : n[4]].max() for n in nodes])
        self.child, self.child_at = self._flat([n[5] for n in nodes])
        self.leaf, self.leaf_at = self._flat([n[6] for n in nodes])

    @staticmethod
    def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        at = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
        return np.array([y for x in lists for y in x], np.int64), at

    @staticmethod
    def _common(a: np.ndarray, b: np.ndarray) -> int:
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[:n] != b[:n])
        return int(differ[0]) if len(differ) else n

    @staticmethod
    def _spans(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        length = stop - start
        return np.repeat(start - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())

    def partners(self, i: int, connected: np.ndarray, mask: np.ndarray, percent: int) -> np.ndarray:
        """Documents that link with document i; subtrees of connected ones are left aside."""
        own, size = self.rows[i], int(self.sizes[i])
        mask[own] = 1
        low, high = -(-size * percent // 100), size * 100 // percent
        done = np.concatenate([[0], np.cumsum(connected)])
        found = []
        node, overlap = np.zeros(1, np.int64), np.zeros(1, np.int64)
        while len(node):
            open_ = done[self.end[node]] - done[self.first[node]] < self.end[node] - self.first[node]
            open_ &= (self.most[node] >= low) & (self.least[node] <= high)
            node, overlap = node[open_], overlap[open_]
            if not len(node):
                break
            start, stop = self.start[node], self.stop[node]
            hits = np.concatenate([[0], np.cumsum(mask[self.tokens[self._spans(start, stop)]])])
            at = np.concatenate([[0], np.cumsum(stop - start)])
            overlap = overlap + hits[at[1:]] - hits[at[:-1]]
            left = np.where(stop > start, len(own) - np.searchsorted(own, self.tokens[np.maximum(stop - 1, 0)], "right"), len(own)) if len(self.tokens) else np.zeros(len(node), np.int64)
            reach = overlap + np.minimum(left, self.longest[node])
            able = (100 + percent) * reach >= percent * (size + np.maximum(low, self.least[node]))
            node, overlap = node[able], overlap[able]
            ends = self.leaf[self._spans(self.leaf_at[node], self.leaf_at[node + 1])]
            shared = np.repeat(overlap, self.leaf_at[node + 1] - self.leaf_at[node])
            found.append(ends[((100 + percent) * shared >= percent * (size + self.sizes[ends])) & ~connected[ends]])
            below = self.child_at[node + 1] - self.child_at[node]
            node, overlap = self.child[self._spans(self.child_at[node], self.child_at[node + 1])], np.repeat(overlap, below)
        mask[own] = 0
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def link_groups(sets: list[np.ndarray], percent: int, ranks: list[np.ndarray] | None = None, label: np.ndarray | None = None, asking: np.ndarray | None = None) -> np.ndarray:
    """A label for each set; sets that a chain of links joins have the same.

    ranks: of the shingles in the global order; label: what is connected already; asking: which sets look for partners.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    label = np.arange(n) if label is None else np.unique(label, return_inverse=True)[1]
    asking = np.ones(n, bool) if asking is None else asking
    tokens, first, which, many = np.unique(np.concatenate(sets), return_index=True, return_inverse=True, return_counts=True)
    # what only one set has cannot overlap; the rest in the global order from its common end
    rank_of = np.concatenate(ranks)[first].astype(np.int64) if ranks is not None else many
    order = np.lexsort((tokens, -rank_of))
    number = np.empty(len(tokens), np.int64)
    number[order] = np.arange(len(tokens))
    which = np.where(many[which] > 1, number[which], -1)
    rows = [np.sort(w[w >= 0]) for w in np.split(which, np.cumsum(sizes)[:-1])]
    by_path = np.array(sorted(range(n), key=lambda i: rows[i].astype(">u4").tobytes()))
    trie = Trie([rows[i] for i in by_path], sizes[by_path])
    label, asking = label[by_path], asking[by_path]
    mask = np.zeros(len(tokens) + 1, np.int64)
    for i in np.flatnonzero(asking).tolist():
        connected = label == label[i]
        if asking.all():
            connected[:i] = True  # earlier ones have looked at this one
        connected[i] = True
        partners = trie.partners(i, connected, mask, percent)
        if len(partners):
            label[np.isin(label, label[partners])] = label[i]
    out = np.empty(n, np.int64)
    out[by_path] = label
    return out


def _star(node: np.ndarray, label: np.ndarray, before: np.ndarray) -> pa.Table:
    """A link from the least node of each label to one node of each component that has newly come to it."""
    order = np.lexsort((node, label))
    label, before, node = label[order], before[order], node[order]
    new = np.concatenate([[True], label[1:] != label[:-1]])
    root = np.flatnonzero(new)[np.cumsum(new) - 1]
    _, one = np.unique(np.stack([label, before]), axis=1, return_index=True)
    one = one[before[one] != before[root[one]]]
    return pa.table({"u": node[one], "v": node[root[one]]})


def _join(percent: int):
    """Joins what has met. c: what is connected; stray: who looks for partners."""

    def f(key, table):
        size, most, guest = (table[c].to_numpy() for c in ("n", "room", "guest"))
        # a partner must fit in the room of the first shared shingle, and someone must be at home in this class
        smallest = [int(np.delete(size, int(size.argmin())).min(initial=2**62)), int(size.min(initial=2**62))]
        fits = most >= np.where(size == smallest[1], smallest[0], smallest[1])
        fits &= size <= most.max(initial=0)
        table = table.filter(pa.array(fits))
        if table.num_rows < 2 or guest[fits].all():
            return pa.table({c: pa.array([], pa.int64()) for c in ("u", "v")})
        table = table.sort_by("node")
        each = [B.unpack(x, "u8", "u4") for x in table["body"].to_pylist()]
        before = table["c"].to_numpy()
        label = link_groups([e[0] for e in each], percent, [e[1] for e in each], before, table["stray"].to_numpy() == 1)
        return _star(table["node"].to_numpy(), label, before)

    return f


def _open_shingles(keyed: DataFrame) -> DataFrame:
    """key and sets of each shingle whose documents are not all connected and may link."""
    totals = {"sets": F.sum, "guest": F.min, "n": F.min, "room": F.max, "rooms": F.sum, "who": F.bit_xor, "before": F.min, "after": F.max, "c": F.min, "other": F.max}
    each = keyed.select("key", F.lit(1).alias("sets"), "guest", "n", "room", F.col("room").alias("rooms"), F.xxhash64("node").alias("who"), "before", F.col("before").alias("after"), "c", F.col("c").alias("other"))
    whole = each.groupBy("key").agg(*(f(c).alias(c) for c, f in totals.items()))
    found = whole.where("c != other AND guest = 0 AND room >= n AND (before != after OR before = 0)")
    # of shingles with the same documents the first in the global order leaves each of them the most room
    found = found.groupBy("who", "sets").agg(F.max(F.struct("rooms", "key")).alias("m"))
    return found.select("m.key", "sets")


def _listed(keyed: DataFrame) -> DataFrame:
    """The meeting points of open shingles: key, node, c, n, room, guest and sets (of the key)."""
    open_ = B.checkpointed(_open_shingles(keyed))
    return B.checkpointed(B.join_by_hot_key(keyed.select("key", "node", "c", "n", "room", "guest"), open_, ["key"], "sets"))


def _gathered(listed: DataFrame, last: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Meeting points of keys that are still open, with main (the largest component of the key); sets by main, each once;
    and of each main one: sets, chunks, stray_chunks and settles (whether this round is the last for it)."""
    shares = listed.groupBy("key", "c").agg(F.count(F.lit(1)).alias("own"), F.max("sets").alias("sets"))
    main = shares.groupBy("key").agg(F.max(F.struct("own", "c")).alias("m"), F.max("sets").alias("sets"), F.count(F.lit(1)).alias("components"))
    main = B.checkpointed(main.where("components > 1").select("key", F.col("m.c").alias("main"), "sets"))
    tied = B.checkpointed(B.join_by_hot_key(listed.drop("sets"), main, ["key"], "sets"))
    members = B.checkpointed(tied.groupBy("main", "node").agg(F.min("c").alias("c"), F.min("n").alias("n"), F.max("room").alias("room"), F.min("guest").alias("guest")))
    sizes = members.groupBy("main").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("hashes"), F.count_if(F.col("c") != F.col("main")).alias("strays"))
    chunks = F.ceil(F.greatest(F.col("sets") / F.lit(float(CHUNK_SETS)), F.col("hashes") / F.lit(float(CHUNK_HASHES)))).cast("int")
    sizes = sizes.select("main", "sets", chunks.alias("chunks"), F.ceil(chunks * F.col("strays") / F.col("sets")).cast("int").alias("stray_chunks"))
    return tied, members, B.checkpointed(sizes.withColumn("settles", F.lit(last) | (F.col("stray_chunks") <= 1)))


def _meet(survivors: DataFrame, members: DataFrame, sizes: DataFrame, number: int, percent: int) -> DataFrame:
    """Links among what is gathered; where it settles all chunks beside all strays, else each chunk by itself."""
    members = B.join_by_hot_key(members, sizes, ["main"], "sets")
    place = F.xxhash64("node", "main", F.lit(number))
    members = members.withColumn("stray", (F.col("c") != F.col("main")).cast("int")).withColumn("mine", F.pmod(place, "chunks").cast("int"))
    # every chunk once beside every chunk of strays; a set that is in both roles is sent once
    members = members.withColumn("asks", F.pmod(place, F.greatest("stray_chunks", F.lit(1))).cast("int"))
    both = "array_distinct(concat(transform(sequence(0, chunks - 1), q -> struct(q as q, asks as t, 1 as stray)), transform(sequence(0, stray_chunks - 1), t -> struct(mine as q, t as t, int(t = asks) as stray))))"
    alone = "transform(sequence(0, stray_chunks - 1), t -> struct(mine as q, t as t, 0 as stray))"
    itself = "array(struct(mine as q, 0 as t, 1 as stray))"
    roles = F.when(~F.col("settles"), F.expr(itself)).when(F.col("stray") == 1, F.expr(both)).otherwise(F.expr(alone))
    sent = B.checkpointed(members.select("main", "node", "c", "n", "room", "guest", F.inline(roles)))
    small = sent.limit(B.BROADCAST_ROWS + 1).count() <= B.BROADCAST_ROWS
    sent = survivors.select("node", "body").join(F.broadcast(sent) if small else sent, "node")
    return sent.groupBy("main", "q", "t").applyInArrow(_join(percent), LINKS)


def _components(survivors: DataFrame, percent: int) -> DataFrame:
    """id (a node) and component of every linked survivor."""
    points = survivors.select("node", F.col("node").alias("c"), "n", F.inline(F.arrays_zip("key", "before", "guest", "room")))
    listed, components, last = _listed(points), None, False
    for number in itertools.count():
        tied, members, sizes = _gathered(listed, last)
        links = _meet(survivors, members, sizes, number, percent)
        components = connected_components(links if components is None else components.select(F.col("id").alias("u"), F.col("component").alias("v")).unionAll(links))
        large = sizes.where("NOT settles").select("main", F.col("sets").alias("members"))
        if not large.limit(1).count():
            break
        # settled gatherings are not listed again; of the others what is connected by now has a new name
        components = B.checkpointed(components)
        named = B.join_by_hot_key(tied, large, ["main"], "members").drop("main", "members").withColumnRenamed("c", "before")
        named = named.join(components.select(F.col("id").alias("node"), "component"), "node", "left")
        listed = B.checkpointed(named.withColumn("c", F.coalesce("component", "node")).drop("component"))
        # another round of chunks pays only while one leaves less than half as many components
        before, now = listed.agg(F.count_distinct("before"), F.count_distinct("c")).first()
        listed, last = listed.drop("before"), 2 * now > before
    return components


def _linked(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (id, th, n, f1, f2); classes of equal sets (f1, f2, node: the least (id, th) of them, copies); node and root of each linked class."""
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64(F.col("text").cast("string")).alias("th"), F.col("text").cast("string").alias("text"))
    blocks = B.parts(own)
    signed = B.checkpointed(own.mapInArrow(_signatures(k), ROWS))
    classes = B.checkpointed(signed.where("n > 0").groupBy("f1", "f2").agg(F.min(F.struct("id", "th")).alias("node"), F.count(F.lit(1)).alias("copies")))
    marks = B.with_block(classes.select("node.id", "node.th"), blocks, "id", "th")
    dealt = B.with_block(own, blocks, "id", "th").repartition(blocks, "block")
    asked = dealt.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(_ask(k, blocks), B.ASK)
    replies = asked.repartition(blocks, "bucket").groupBy("bucket").applyInArrow(_answer, B.ASK)
    none = F.lit(None)
    told = marks.select("block", none.cast("int").alias("bucket"), none.cast("binary").alias("body"), "id", "th", F.lit(0).alias("step"))
    told = told.unionAll(replies.select("block", "bucket", "body", none.cast("long").alias("id"), none.cast("long").alias("th"), F.lit(1).alias("step")))
    survivors = dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_survivors(k, percent, blocks), SETS)
    survivors = B.checkpointed(survivors.withColumn("node", F.xxhash64("id", "th")))
    named = survivors.select(F.struct("id", "th").alias("own"), F.col("node").alias("id"))
    members = B.checkpointed(_components(survivors, percent).join(named, "id").select(F.col("own").alias("node"), "component"))
    least = members.groupBy("component").agg(F.min("node").alias("root"), F.count(F.lit(1)).alias("members"))
    return signed, classes, B.join_by_hot_key(members, least, ["component"], "members").select("node", "root")


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id reachable by links) of every row."""
    signed, classes, linked = _linked(docs, k, percent)
    ids = classes.select("f1", "f2", F.col("node.id").alias("class_id"), "copies")
    full = B.checkpointed(B.join_by_hot_key(signed.where("n > 0"), ids, ["f1", "f2"], "copies").select("id", "class_id"))
    # an id that stands for a class, or has texts of several classes, or an empty one as well, ties its classes together
    copies = full.where("id != class_id")
    several = copies.groupBy("id").agg(F.min("class_id").alias("a"), F.max("class_id").alias("b")).where("a != b").select("id")
    ties = copies.join(ids.select(F.col("class_id").alias("id")).unionAll(several).unionAll(signed.where("n = 0").select("id")), "id", "left_semi").distinct()
    edges = linked.select(F.col("node.id").alias("u"), F.col("root.id").alias("v")).unionAll(ties.select(F.col("id").alias("u"), F.col("class_id").alias("v")))
    components = connected_components(edges)
    # the root of a class is its own, or that of its least id
    root = ids.join(components, ids["class_id"] == components["id"], "left").select("f1", "f2", "copies", F.coalesce("component", "class_id").alias("root"))
    out = B.join_by_hot_key(signed.where("n > 0"), root, ["f1", "f2"], "copies").select("id", "n", "root")
    empty = signed.where("n = 0").join(components.select("id", "component"), "id", "left").select("id", "n", F.coalesce("component", "id").alias("root"))
    back = lambda c: F.when(c != NULL_ID, c)
    return out.unionAll(empty).select(back(F.col("id")).alias("doc_id"), F.col("n").alias("n_shingles"), back(F.col("root")).alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """The rows of docs, all columns, without near copies: one row of each component stays, that of the least doc_id.

    Here every text is a node of its own, whether its doc_id is null, repeated or neither: of rows
    that share a doc_id each is judged by its text. Texts without words all stay.
    """
    _, classes, linked = _linked(docs, k, percent)
    gone = linked.where("node != root").select("node")
    kept = classes.join(gone, "node", "left_anti").select(F.struct(F.col("node.id").alias("id"), F.col("node.th").alias("th")).alias("kept"))
    text = F.col("text").cast("string")
    own = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64(text).alias("th"))
    full = F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), own.alias("kept"), full.alias("full"))
    # equal rows: one stays; the window cuts them down before they are shuffled
    by = [F.col("row")[c] for c, kind in docs.dtypes if c != "text" and "map<" not in kind and "variant" not in kind]
    first = Window.partitionBy("kept").orderBy(*by)
    once = rows.where("full").withColumn("nth", F.row_number().over(first)).where("nth = 1").join(kept, "kept", "left_semi")
    return once.select("row").unionAll(rows.where(~F.col("full")).select("row")).select("row.*")
