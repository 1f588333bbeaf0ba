"""Jaccard self-join on word shingles with prefix filters under several token orders.

A document is the set of its distinct five-word shingles, as 64-bit hashes. Two documents can reach a similarity of
a/b only if they share a token among the first n - ceil(a n / b) + 1 of each under any one order of all tokens; of the
smaller one the first n - ceil(2 a n / (a + b)) + 1 are enough. So a pair is verified only if it passes that test under
each of several orders. Order 0 has the tokens of the most documents last, so that passages which many documents
share make no candidates; orders 1 and 2 are hashes.

Order 0 has the tokens of the fewest documents first, by exact counts; orders 1 and 2 are hashes. Passages that many
documents share come last in order 0 and make no candidates, and a token of one document can't be shared.

Steps, each a Spark job over tables:
1. each task deals the tokens of some documents by token; a part counts its tokens over all documents and answers with
   the counts of those in two or more. A token of many documents of one task travels as one count, and its documents
   wait at the task's address;
2. with the answers each document's first tokens under order 0 are known: those of two or more documents among them are
   dealt by token, packed. Documents with the same set form a class, only one of which goes on;
3. up to SMALL documents that share a token are paired, where sizes and positions allow a link; of more, each is paired
   with FEW of them, of more than LARGE with HUBS. The records of a token of more than HOT documents stay rows where
   they are, which meet the token's hubs;
4. a pair goes on if its first tokens under orders 1 and 2, four bytes each, meet as well; only then are the sets of its
   documents fetched and the overlap counted. Links give components;
5. the documents around a hub that lie in different components are compared in blocks of bounded size: two blocks are
   a task's work, and inside, a pair already connected is skipped. So every pair that passes the filters is verified
   or known to be connected, and no link between components is lost.

A group's size bounds nothing but the number of blocks, and no token or document passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import broadcast_if_small, saved, without
from .graph_components import components

SHINGLE = 5
BLOCK = 256
SMALL, FEW, LARGE, HUBS = 4, 2, 16, 4
#: Bytes of text that are hashed at once, and tokens that a task gathers before it passes them on.
TEXT_BYTES, GATHERED = 1 << 20, 2_000_000
#: Target bytes of a part of the dealt tokens.
PART_BYTES = 32 << 20
#: The records of a token of more documents are not gathered in one group: they stay rows, and only their sizes and hubs are.
HOT = 1 << 16
#: A token of more documents of one task is counted there, and its documents aren't dealt.
BUSY = 32

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
_BASE = np.uint64(0x2545F4914F6CDD1D)
_SALTS = [np.uint64(x) for x in (0, 0x5851F42D4C957F2D, 0x14057B7EF767814F, 0x2127599BF4325C37)]
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of ASCII-lower-cased bytes."""
    raw = np.frombuffer(data, dtype=np.uint8)
    inside = ~_SPACE[raw]
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    powers = np.multiply.accumulate(np.full(int(lengths.max()), _BASE, dtype=np.uint64))
    sums = np.add.reduceat((raw[inside].astype(np.uint64) + _U(1)) * powers[place], first)
    return _mix(sums + lengths.astype(np.uint64) * _ODD[0]), starts


def shingle_sets(texts: list[str | None], k: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; whole texts, hashed some at a time."""
    group: list[bytes] = []
    size = 0
    for i, t in enumerate(texts):
        group.append((t or "").encode("utf-8", "surrogatepass").lower())
        size += len(group[-1]) + 1
        if size >= TEXT_BYTES or i == len(texts) - 1:
            hashes, starts = _words(b" ".join(group))
            ends = np.searchsorted(starts, np.cumsum([len(g) + 1 for g in group]))
            rolled = np.zeros(max(0, len(hashes) - k + 1), dtype=np.uint64)
            for j in range(k if len(rolled) else 0):
                rolled += hashes[j : len(hashes) - k + 1 + j] * _ODD[j % 5]
            rolled = _mix(rolled)
            begin = 0
            for end in ends.tolist():
                n = end - begin
                if n >= k:
                    yield np.unique(rolled[begin : end - k + 1])
                elif n:
                    yield _mix(np.array([(hashes[begin:end] * _ODD[:n]).sum() + _U(n)], dtype=np.uint64))
                else:
                    yield np.zeros(0, dtype=np.uint64)
                begin = end
            group, size = [], 0


def _prefix_size(n: int, a: int, b: int) -> int:
    return n - -(-a * n // b) + 1


def _index_size(n: int, a: int, b: int) -> int:
    return n - -(-2 * a * n // (a + b)) + 1


def _spread(tokens: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a token is dealt, and its mark there."""
    x = _mix(tokens ^ _SALTS[3])
    return ((x & _U(0xFFFFFFFF)) % _U(parts)).astype(np.int64), (x >> _U(32)).astype(np.uint32)


def prefix(tokens: np.ndarray, order: int, size: int) -> np.ndarray:
    """The keys of the first tokens under a hash order, ascending. A key stands for its token under this order."""
    keys = _mix(tokens ^ _SALTS[order])
    return np.sort(np.partition(keys, size - 1)[:size] if size < len(keys) else keys)


def _rank(node: np.ndarray) -> np.ndarray:
    """An order of documents that is the same under every token."""
    return _mix(node.view(np.uint64) ^ _SALTS[1])


RECORD = np.dtype([("mark", "<u4"), ("n", "<u4"), ("node", "<i8")])
INDEXED = np.uint32(1 << 31)


def _by_part(to: np.ndarray, rows: np.ndarray) -> dict[int, bytes]:
    if not len(rows):
        return {}
    order = np.argsort(to, kind="stable")
    rows, to = rows[order], to[order]
    cuts = np.flatnonzero(np.diff(to, prepend=-1))
    return {int(to[x]): rows[x:y].tobytes() for x, y in zip(cuts, [*cuts[1:], len(rows)], strict=True)}


def _planes(numbers: np.ndarray) -> bytes:
    """Unsigned numbers in order as the bytes of their differences, the low bytes first: the high ones are mostly 0 and compress in a shuffle."""
    numbers = np.sort(numbers)
    return np.diff(numbers, prepend=numbers.dtype.type(0)).view(np.uint8).reshape(-1, numbers.itemsize).T.tobytes()


def _from_planes(data: bytes, kind: type = np.uint32) -> np.ndarray:
    planes = np.frombuffer(data, dtype=np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(kind).ravel(), dtype=kind)


def _bytes_of(numbers: np.ndarray) -> bytes:
    """32-bit numbers in their order, the low bytes first."""
    return np.ascontiguousarray(numbers, dtype=np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def _joined(rows: list, kind: type) -> np.ndarray:
    return np.concatenate([np.zeros(0, dtype=kind), *rows])


SIZED = np.dtype([("id", "<i8"), ("n", "<i8"), ("h1", "<i8"), ("h2", "<i8"), ("first", "<i8")])


def _hash_sum(s: np.ndarray, salt: int) -> int:
    return int(_mix(s ^ _SALTS[salt]).sum().view(np.int64))


DEALT = "part int, batch long, marks binary, owners binary, counts binary, busy binary, busy_counts binary, docs binary, own binary"
EMPTY = {c: b"" for c in "marks owners counts busy busy_counts docs own".split()}
FIRST = "kind int, part int, packed binary, a long, b long, c long, d long, e long"
OWN = np.dtype([("code", "<i8"), ("owner", "<i8")])


def _deal(docs: DataFrame, id_col: str, text_col: str, parts: int) -> DataFrame:
    """DEALT: for each batch of documents and part, the tokens' marks and the places of their documents in the batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = TaskContext.get().partitionId() << 32  # a task that runs again has the same batches
        sets: list[np.ndarray] = []
        rows: list[tuple] = []
        seen: set[int] = set()
        n = 0

        def packed() -> pd.DataFrame:
            part, mark = _spread(_joined(sets, np.uint64), parts)
            owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            code = part << 32 | mark
            order = np.lexsort((owner, code))
            code, owner = code[order], owner[order]
            starts = np.flatnonzero(np.diff(code, prepend=-1))
            times = np.diff([*starts, len(code)])
            busy = times > BUSY
            own = np.zeros(int(times[busy].sum()), dtype=OWN)
            alone = ~np.repeat(busy, times)
            own["code"], own["owner"] = code[~alone], owner[~alone]
            busy_code, busy_times = code[starts[busy]], times[busy]
            code, owner = code[alone], owner[alone]
            out: dict[int, dict] = {}
            for k in np.unique(np.concatenate([code, busy_code]) >> 32).tolist():
                x, y = np.searchsorted(code, [k << 32, k + 1 << 32])
                u, v = np.searchsorted(busy_code, [k << 32, k + 1 << 32])
                out[k] = EMPTY | {"marks": _planes(code[x:y].astype(np.uint32)), "owners": _bytes_of(owner[x:y]), "busy": _bytes_of(busy_code[u:v]), "busy_counts": _bytes_of(busy_times[u:v])}
            home = out.setdefault(int(_mix(np.array([at], dtype=np.uint64))[0] % _U(parts)), dict(EMPTY))
            home["docs"], home["own"] = np.array(rows, dtype=SIZED).tobytes(), own.tobytes()
            return pd.DataFrame([{"part": k, "batch": at, **v} for k, v in out.items()], columns=[c.split()[0] for c in DEALT.split(", ")])

        for batch in batches:
            for key, s in zip(batch["id"], shingle_sets(batch["text"].tolist()), strict=True):
                node = _hash_sum(s, 1)
                first = bool(len(s)) and node not in seen
                rows.append((key, len(s), node, _hash_sum(s, 2), first))
                if first:
                    seen.add(node)
                    sets.append(s)
                    n += len(s)
            if n >= GATHERED or len(rows) >= GATHERED // 8:
                yield packed()
                at, sets, rows, seen, n = at + 1, [], [], set(), 0
        if rows:
            yield packed()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, DEALT)


def _count(group: pd.DataFrame) -> pd.DataFrame:
    """A part's answers: of each batch's tokens those of two or more documents, with that number."""
    marks = [_from_planes(x) for x in group["marks"]]
    owners = [_numbers(x) for x in group["owners"]]
    busy = [_numbers(x) for x in group["busy"]]
    weights = [np.ones(len(m)) for m in marks] + [_numbers(x).astype(np.float64) for x in group["busy_counts"]]
    _, place = np.unique(_joined(marks + busy, np.uint32), return_inverse=True)
    total = np.minimum(np.bincount(place, weights=_joined(weights, np.float64)), 2**32 - 1).astype(np.uint32)[place]
    total = np.split(total, np.cumsum([len(x) for x in marks + busy])[:-1])
    out = group[["part", "batch", "busy", "docs", "own"]].copy()
    shared = [t >= 2 for t in total[: len(marks)]]
    out["marks"] = [_planes(m[s]) for m, s in zip(marks, shared, strict=True)]
    out["owners"] = [_bytes_of(o[s]) for o, s in zip(owners, shared, strict=True)]
    out["counts"] = [_bytes_of(t[s]) for t, s in zip(total, shared, strict=False)]
    out["busy_counts"] = [_bytes_of(t) for t in total[len(marks) :]]
    out = out[(out["marks"].str.len() > 0) | (out["busy"].str.len() > 0) | (out["docs"].str.len() > 0)]
    return out[[c.split()[0] for c in DEALT.split(", ")]]


def _first_tokens(docs: DataFrame, id_col: str, text_col: str, parts: int, a: int, b: int) -> DataFrame:
    """FIRST, rows of three kinds: 0 (identifier, size, two hashes of the set); 1 records of first tokens under order 0, packed by part;
    2 (code, size, node, rank, indexed) of those with hot tokens. Tokens of one document have no record."""
    names = [c.split()[0] for c in FIRST.split(", ")]

    def place(group: pd.DataFrame) -> pd.DataFrame:
        sized = np.frombuffer(b"".join(group["docs"]), dtype=SIZED)
        firsts = sized[sized["first"] == 1]
        parts_of = group["part"].to_numpy(np.int64)
        marks = [_from_planes(x) for x in group["marks"]]
        busy = [_numbers(x) for x in group["busy"]]
        own = np.frombuffer(b"".join(group["own"]), dtype=OWN)
        code = _joined([p << 32 | m.astype(np.int64) for p, m in zip(parts_of, marks, strict=True)], np.int64)
        owner = _joined([_numbers(x).astype(np.int64) for x in group["owners"]], np.int64)
        count = _joined([_numbers(x) for x in group["counts"]], np.uint32)
        busy_code = _joined([p << 32 | m.astype(np.int64) for p, m in zip(parts_of, busy, strict=True)], np.int64)
        busy_count = _joined([_numbers(x) for x in group["busy_counts"]], np.uint32)
        if len(own):
            by_code = np.argsort(busy_code)
            at = by_code[np.searchsorted(busy_code[by_code], own["code"])]
            code, owner, count = np.concatenate([code, own["code"]]), np.concatenate([owner, own["owner"]]), np.concatenate([count, busy_count[at]])
        order = np.lexsort((_mix(code.astype(np.uint64)), count, owner))
        code, owner, count = code[order], owner[order], count[order]
        listed = np.bincount(owner, minlength=len(firsts))
        n = firsts["n"][owner]
        spot = n - listed[owner] + np.arange(len(owner)) - (np.cumsum(listed) - listed)[owner]  # behind the tokens of one document
        kept = spot < _prefix_size(n, a, b)
        code, owner, count, n, spot = code[kept], owner[kept], count[kept], n[kept], spot[kept]
        indexed, node = spot < _index_size(n, a, b), firsts["h1"][owner]
        hot = count > HOT
        record = np.zeros(int((~hot).sum()), dtype=RECORD)
        record["mark"], record["n"], record["node"] = (code & 0xFFFFFFFF)[~hot], (n | indexed * int(INDEXED))[~hot], node[~hot]
        packed = _by_part((code >> 32)[~hot], record)
        rank = (_rank(node[hot].copy()) ^ _U(1 << 63)).view(np.int64)  # the order of signed numbers
        frames = [
            pd.DataFrame({"kind": 0, "a": sized["id"], "b": sized["n"], "c": sized["h1"], "d": sized["h2"]}),
            pd.DataFrame({"kind": 1, "part": list(packed), "packed": list(packed.values())}),
            pd.DataFrame({"kind": 2, "a": code[hot], "b": n[hot], "c": node[hot], "d": rank, "e": indexed[hot].astype(np.int64)}),
        ]
        whole = {c: "Int64" for c in ("kind", "part", *"abcde")}  # before anything is missing: floats can't hold hashes
        return pd.concat([f.astype({c: t for c, t in whole.items() if c in f}).reindex(columns=names).astype(whole) for f in frames])

    return _deal(docs, id_col, text_col, parts).groupBy("part").applyInPandas(_count, DEALT).groupBy("batch").applyInPandas(place, FIRST)


def _size_groups(sizes: pd.DataFrame, a: int, b: int) -> pd.DataFrame:
    """The groups of one token that _pairs would make, from how many records (k) it has of each size (n), indexed or not: (code, n, indexed, first), first the smallest size of the group."""
    sizes = sizes.sort_values(["n", "indexed"], ascending=[True, False])
    n, indexed, k = sizes["n"].to_numpy(), sizes["indexed"].to_numpy(bool), sizes["k"].to_numpy()
    for again in range(3):
        starts = np.ones(len(n), dtype=bool)
        starts[1:] = n[:-1] * b < a * n[1:]
        begins, group = np.flatnonzero(starts), np.cumsum(starts) - 1
        if again == 2 or not len(n):
            break
        last = np.maximum.accumulate(np.where(indexed, np.arange(len(n)), -1))
        kept = indexed | ((last >= begins[group]) & (n[np.maximum(last, 0)] * b >= a * n))
        kept &= np.bincount(group, weights=kept * k)[group] > 1
        n, indexed, k = n[kept], indexed[kept], k[kept]
    return pd.DataFrame({"code": int(sizes["code"].iloc[0]), "n": n, "indexed": indexed, "first": n[begins[group]] if len(n) else n})


def _hot_pairs(records: DataFrame, a: int, b: int) -> DataFrame:
    """(a, b, around): the pairs of hot tokens' records, a written table. Each group's HUBS documents of the smallest rank
    are found by partial aggregation and meet its records wherever those are."""
    sizes = records.groupBy("code", "n", "indexed").agg(F.count(F.lit(1)).alias("k"))
    groups = saved(sizes.groupBy("code").applyInPandas(lambda g: _size_groups(g, a, b), "code long, n long, indexed boolean, first long"), "hot-groups")
    grouped = records.join(broadcast_if_small(groups), ["code", "n", "indexed"])
    # copies of a document in several tasks have the same rank
    w = Window.partitionBy("code", "first").orderBy("rank")
    hubs = grouped.select("code", "first", "rank", "node").withColumn("place", F.dense_rank().over(w)).filter(F.col("place") <= HUBS)
    hubs = hubs.groupBy("code", "first").agg(F.array_sort(F.collect_set(F.struct("rank", "node"))).alias("hubs"))
    hubs = saved(hubs, "hot-hubs")
    met = grouped.join(broadcast_if_small(hubs), ["code", "first"]).select("rank", "node", F.posexplode("hubs").alias("place", "hub")).filter(F.col("hub.rank") < F.col("rank"))
    return met.select(F.col("hub.node").alias("a"), F.col("node").alias("b"), (F.col("place") == 0).cast("long").alias("around"))


PAIR = np.dtype([("a", "<i8"), ("b", "<i8"), ("around", "<i8")])


def _pairs(records: np.ndarray, a: int, b: int) -> np.ndarray:
    """Pairs of records that share a token, in groups of sizes without a gap; around is 1 for those of a large group with its first hub."""
    plain = records["n"] & ~INDEXED
    indexed = (records["n"] & INDEXED) != 0
    order = np.lexsort((records["node"], ~indexed, plain, records["mark"]))
    mark, n, node, indexed = records["mark"][order], plain[order].astype(np.int64), records["node"][order], indexed[order]
    again = np.zeros(len(mark), dtype=bool)
    again[1:] = (mark[1:] == mark[:-1]) & (node[1:] == node[:-1])
    mark, n, node, indexed = mark[~again], n[~again], node[~again], indexed[~again]

    def groups() -> tuple[np.ndarray, np.ndarray]:
        starts = np.ones(len(mark), dtype=bool)
        starts[1:] = (mark[1:] != mark[:-1]) | (n[:-1] * b < a * n[1:])
        return np.flatnonzero(starts), np.cumsum(starts) - 1

    for _ in range(2):  # again, as records that can't pair leave
        if not len(mark):
            return np.zeros(0, dtype=PAIR)
        begins, group = groups()
        last = np.maximum.accumulate(np.where(indexed, np.arange(len(mark)), -1))  # the last indexed record so far
        kept = indexed | ((last >= begins[group]) & (n[np.maximum(last, 0)] * b >= a * n))
        kept &= np.bincount(group, weights=kept)[group] > 1
        mark, n, node, indexed = mark[kept], n[kept], node[kept], indexed[kept]
    if not len(mark):
        return np.zeros(0, dtype=PAIR)
    begins, group = groups()
    sizes = np.diff([*begins, len(mark)])
    found = []

    def add(x: np.ndarray, y: np.ndarray, around: int) -> None:
        rows = np.zeros(len(x), dtype=PAIR)
        rows["a"], rows["b"], rows["around"] = x, y, around
        found.append(rows[x != y])

    rank = _rank(node)
    small = np.flatnonzero(sizes[group] <= SMALL)
    for d in range(1, SMALL):
        at = small[small + d < len(mark)]
        at = at[(group[at] == group[at + d]) & indexed[at] & (n[at] * b >= a * n[at + d])]
        if not len(at):
            break
        first = rank[at] < rank[at + d]
        add(np.where(first, node[at], node[at + d]), np.where(first, node[at + d], node[at]), 0)
    if (sizes > SMALL).any():
        large = sizes[group] > SMALL
        rows = np.flatnonzero(large)
        rows = rows[np.lexsort((rank[rows], group[rows]))]  # the same documents become hubs wherever they are
        begin = np.flatnonzero(np.diff(group[rows], prepend=-1))
        size = np.diff([*begin, len(rows)])
        place = np.arange(len(rows)) - np.repeat(begin, size)
        hubs = np.repeat(np.where(size > LARGE, HUBS, FEW), size)
        for h in range(HUBS):
            hub = np.repeat(node[rows[np.minimum(begin + h, len(rows) - 1)]], size)
            others = (place > h) & (hubs > h)
            add(hub[others], node[rows[others]], int(h == 0))
    return np.concatenate(found) if found else np.zeros(0, dtype=PAIR)


def _once(pairs: np.ndarray) -> np.ndarray:
    """Distinct pairs; around if any is."""
    order = np.lexsort((-pairs["around"], pairs["b"], pairs["a"]))
    pairs = pairs[order]
    first = np.ones(len(pairs), dtype=bool)
    first[1:] = (pairs["a"][1:] != pairs["a"][:-1]) | (pairs["b"][1:] != pairs["b"][:-1])
    return pairs[first]


class _Block:
    """Documents on the left of a comparison: their first tokens under each hash order, inverted."""

    def __init__(self, rows: list[tuple], a: int, b: int, orders: range):
        self.a, self.b, self.orders = a, b, orders
        self.ids = np.array([r[0] for r in rows], dtype=np.int64)
        self.parts = np.array([r[1] for r in rows], dtype=np.int64)
        self.sets = [r[2] for r in rows]
        self.sizes = np.array([len(s) for s in self.sets], dtype=np.int64)
        self.lists = []
        for k in orders:
            keys = [prefix(s, k, _prefix_size(len(s), a, b)) for s in self.sets]
            owner = np.repeat(np.arange(len(keys)), [len(x) for x in keys])
            flat = np.concatenate(keys)
            order = np.argsort(flat, kind="stable")
            self.lists.append((flat[order], owner[order]))

    def links(self, part: int, tokens: np.ndarray) -> list[int]:
        """Places on the left of the documents, of other parts, that are similar to this one."""
        n = len(tokens)
        could = (self.parts != part) & (self.sizes * self.b >= self.a * n) & (self.sizes * self.a <= self.b * n)
        for k, (flat, owner) in zip(self.orders, self.lists, strict=True):
            if not could.any():
                return []
            keys = prefix(tokens, k, _prefix_size(n, self.a, self.b))
            low, high = np.searchsorted(flat, keys, "left"), np.searchsorted(flat, keys, "right")
            counts = high - low
            total = int(counts.sum())
            shared = np.zeros(len(self.sets), dtype=bool)
            if total:
                places = np.repeat(low - (np.cumsum(counts) - counts), counts) + np.arange(total)
                shared[owner[places]] = True
            could &= shared
        return [i for i in np.flatnonzero(could).tolist() if self._similar(self.sets[i], tokens)]

    def _similar(self, x: np.ndarray, y: np.ndarray) -> bool:
        at = np.minimum(np.searchsorted(x, y), len(x) - 1)
        overlap = int(np.count_nonzero(x[at] == y))
        return overlap * (self.a + self.b) >= self.a * (len(x) + len(y))


def _meeting(rows: DataFrame, a: int, b: int) -> DataFrame:
    """Pairs (a, b) whose sizes and first tokens under all hash orders allow a link, from rows (key, side, id, n, firsts): each
    document on side 1 against the one on side 0 of its key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = hub = None
        for batch in batches:
            out = []
            for k, side, doc, n, firsts in zip(batch["key"], batch["side"], batch["id"], batch["n"], batch["firsts"], strict=True):
                mine = [_from_planes(x) for x in firsts]
                if side == 0:
                    key, hub, size, theirs = k, doc, n, mine
                elif k == key and min(n, size) * b >= a * max(n, size) and all(_meet(x, y) for x, y in zip(theirs, mine, strict=True)):
                    out.append((hub, doc))
            yield pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return rows.repartition(F.col("key")).sortWithinPartitions("key", "side").select("key", "side", "id", "n", "firsts").mapInPandas(run, "a long, b long")


def _meet(x: np.ndarray, y: np.ndarray) -> bool:
    return bool((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).any())


def _verified(rows: DataFrame, a: int, b: int, orders: range) -> DataFrame:
    """Links (a, b) that join parts, from rows (key, side 0 or 1, id, part, tokens): each document on side 1 against those on side 0 of its key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, left, block = None, [], None
        joined: dict[int, int] = {}

        def top(x: int) -> int:
            while joined.get(x, x) != x:
                x = joined[x]
            return x

        for batch in batches:
            out = []
            for k, side, doc, part, raw in zip(batch["key"], batch["side"], batch["id"], batch["part"], batch["tokens"], strict=True):
                if k != key:
                    key, left, block, joined = k, [], None, {}
                tokens = _from_planes(raw, np.uint64)
                if side == 0:
                    left.append((doc, part, tokens))
                    continue
                if not left:
                    continue
                if block is None:
                    block = _Block(left, a, b, orders)
                for i in block.links(part, tokens):
                    x, y = top(int(block.parts[i])), top(part)
                    if x != y:
                        joined[max(x, y)] = min(x, y)
                        out.append((int(block.ids[i]), doc))
            yield pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    dealt = rows.repartition(F.col("key")).sortWithinPartitions("key", "side")
    return dealt.select("key", "side", "id", "part", "tokens").mapInPandas(run, "a long, b long")


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: tuple[int, int] = (3, 4), orders: int = 3
) -> DataFrame:
    """(id_col, n_shingles, component_id) of every row: component_id is the smallest identifier reachable over links.

    Two documents link when their Jaccard similarity is at least similarity (a fraction). Words are what is between
    ASCII white space, A-Z in lower case. Documents with fewer than five words have their whole sequence as the one
    shingle; null texts and those without words have no shingles and no links, their own identifier is their component.
    Identifiers are integers. Where one repeats, each of its rows has its own set and, as all of them are one document's,
    they need not share a component: a row's component is that of its set. Rows with a null identifier get nulls and no
    links. Texts are taken whole, however long. An empty table gives an empty result; other columns are not looked at.
    """
    a, b = similarity
    spark = docs.sparkSession
    texts = docs.filter(F.col(id_col).isNotNull())
    # parts for the text's length at most: a word and its space have two bytes, a token and its place eight
    length = int(texts.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0])
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * length // PART_BYTES + 1)
    first = saved(_first_tokens(texts, id_col, text_col, parts, a, b), "first-tokens")
    sets = first.filter("kind = 0").select(F.col("a").alias("id"), F.col("b").alias("n"), F.col("c").alias("h1"), F.col("d").alias("h2"))
    classes = saved(sets.filter("n > 0").groupBy("n", "h1", "h2").agg(F.min("id").alias("rep")), "classes")

    def pair(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_once(_pairs(np.concatenate([np.frombuffer(x, dtype=RECORD) for x in group["packed"]]), a, b)))

    pairs = first.filter("kind = 1").select("part", "packed").groupBy("part").applyInPandas(pair, "a long, b long, around long")
    hot = first.filter("kind = 2")
    if not hot.isEmpty():
        hot = hot.select(F.col("a").alias("code"), F.col("b").alias("n"), (F.col("e") == 1).alias("indexed"), F.col("c").alias("node"), F.col("d").alias("rank"))
        pairs = pairs.unionByName(_hot_pairs(hot, a, b))
    pairs = saved(pairs.groupBy("a", "b").agg(F.max("around").alias("around")), "pairs")
    node = classes.select(F.col("h1").alias("a"), F.col("rep").alias("hub"))
    other = classes.select(F.col("h1").alias("b"), F.col("rep").alias("other"))
    edges = pairs.join(node, "a").join(other, "b").filter("hub <> other").select(F.col("hub").alias("a"), F.col("other").alias("b"), "around")
    edges = saved(edges, "candidate-pairs")

    ids = saved(edges.select("a").unionByName(edges.select(F.col("b").alias("a"))).distinct(), "candidates")
    picked = broadcast_if_small(ids)
    hashed = range(1, orders)

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = list(shingle_sets(batch["text"].tolist()))
            firsts = [[_planes((prefix(s, k, _prefix_size(len(s), a, b)) >> _U(32)).astype(np.uint32)) for k in hashed] for s in sets]
            yield pd.DataFrame({"id": batch["id"], "n": [len(s) for s in sets], "firsts": firsts, "tokens": [_planes(s) for s in sets]})

    chosen = texts.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(picked.withColumnRenamed("a", "id"), "id", "left_semi")
    held = saved(chosen.mapInPandas(tokens, "id long, n long, firsts array<binary>, tokens binary"), "sets")

    def keyed(found: DataFrame) -> DataFrame:
        """(key, side, id): each first one of the pairs, side 0, and its others, about BLOCK at a time."""
        degree = found.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
        rows = found.join(degree, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("blocks")).alias("block"))
        rows = saved(rows.select("a", "b", F.concat_ws("-", "a", "block").alias("key")), "keyed")
        hubs = rows.select("key", F.lit(0).alias("side"), F.col("a").alias("id")).distinct()
        return hubs.unionByName(rows.select("key", F.lit(1).alias("side"), F.col("b").alias("id")))

    meeting = saved(_meeting(keyed(edges).join(held.select("id", "n", "firsts"), "id"), a, b), "meeting-pairs")
    rows = keyed(meeting).join(held.select("id", "tokens"), "id").select("key", "side", "id", F.col("id").alias("part"), "tokens")
    links = saved(_verified(rows, a, b, range(0)), "links")

    # the documents around a hub that links leave in different components
    linked = components(links).select(F.col("node").alias("id"), F.col("label").alias("part"))
    around = edges.filter("around = 1").select(F.col("a").alias("wide"), F.col("b").alias("id"))
    around = around.unionByName(around.select("wide", F.col("wide").alias("id")).distinct())
    placed = saved(around.join(linked, "id", "left").select("id", "wide", F.coalesce("part", "id").alias("part")), "placed")
    by_part = placed.groupBy("wide", "part").agg(F.count(F.lit(1)).alias("n"))
    open_ = by_part.groupBy("wide").agg(F.sum("n").alias("n"), F.max(F.struct("n", "part")).alias("largest"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    open_ = open_.select(
        "wide", F.col("largest.part").alias("main"), F.ceil(F.col("n") / BLOCK).cast("int").alias("rights"), F.ceil((F.col("n") - F.col("largest.n")) / BLOCK).cast("int").alias("lefts")
    )
    open_ = saved(placed.join(open_, "wide"), "open")
    mine = lambda k: F.pmod(F.xxhash64("id"), F.col(k))
    key = F.concat_ws("-", "wide", "l", "r").alias("key")
    left = open_.filter("part <> main").withColumn("l", mine("lefts")).withColumn("r", F.explode(F.sequence(F.lit(0), F.col("rights") - 1)))
    right = open_.withColumn("r", mine("rights")).withColumn("l", F.explode(F.sequence(F.lit(0), F.col("lefts") - 1)))
    rows = left.select(key, F.lit(0).alias("side"), "id", "part").unionByName(right.select(key, F.lit(1).alias("side"), "id", "part"))
    more = saved(_verified(rows.join(held, "id").select("key", "side", "id", "part", "tokens"), a, b, hashed), "more-links")

    final = components(links.unionByName(more)).select(F.col("node").alias("rep"), F.col("label").alias("component"))
    classes = saved(classes.join(final, "rep", "left").select("n", "h1", "h2", F.coalesce("component", "rep").alias("component")), "class-components")
    out = sets.join(classes, ["n", "h1", "h2"], "left").select(F.col("id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
    lost = docs.filter(F.col(id_col).isNull()).select(F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return out.unionByName(lost).withColumnRenamed("id", id_col)


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay: of each component the one with the smallest identifier. Rows with a null identifier stay."""
    gone = near_groups(docs, id_col, text_col).filter(F.col(id_col) != F.col("component_id")).select(id_col)
    return without(docs, id_col, saved(gone, "near-copies"))
