"""N-gram Jaccard join by T-occurrence search (operator 1).

Texts become sets of word shingles; equal sets form one class. Two classes link when the Jaccard
similarity of their sets is at least num/den. Steps, none of which lists all pairs of a group:

1. A sketch over all texts marks shingles that many texts have (counters for ``LOAD`` shingles each, at least
   ``CELLS`` and at most ``MOST``). All sets are ordered alike: unmarked shingles first, then by hash.
2. Prefix: linked sets x, y share a shingle of their first n - ceil(n num/den) + 1, and at least
   T'(x, y) = ceil(num (nx + ny) / (num + den)) - ceil(nx num/den) + 1 of them (nx the larger).
   Each class posts its prefix; a partition holds whole inverted lists.
3. Each member of a short list (up to ``SHORT``) gets the list, its smaller members of compatible size;
   lists of one class together count common prefix shingles, and pairs with at least T' stay. Members
   of longer lists are only chained, in order of size. Both give blocks: every linked pair lies in
   one block.
4. In each block the search is exact, by DivideSkip. Of a query's inverted lists the L = T / (``MU`` log2 M + 1)
   longest are set aside (M: length of the longest). The heads of the others stand in a heap; a member on
   T - L of them is probed in the long lists by binary search; otherwise the T - L - 1 smallest heads are popped,
   and their lists jump by binary search to the head that is then smallest. The last members that were taken
   are searched first, for a link to one of them often closes all others. Blocks over ``SUB`` classes are
   split into pairs of up to ``SPLIT`` sub-blocks, more only where one would hold over ``HELD`` shingles: so
   often is a set copied. A task searches a sub-block over ``SUB_SIZE`` shingles piece by piece.
5. Components of the links found; component_id is the smallest doc_id in them. A link between texts that other
   links already join need not be found for that; ``every`` finds and counts all.

Texts lost to a component: none, but for collisions of 64-bit hashes. Null and empty texts, and texts without words,
have the empty set and link with nothing. Rows with equal ids count as one node. A null id takes no
part and gets a null component. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
import zlib
from bisect import bisect_left
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from lattica.llm import textops
from lattica.llm.flat import spread
from lattica.llm.graph import components
from lattica.llm.session import lean, tidy, unused

CELLS, MOST, LOAD, RANGES, BRANCH = 1 << 22, 1 << 25, 32, 64, 16
COMMON, SHORT, SUB, SUB_SIZE, SALTS = 32, 128, 256, 1 << 20, 16
SPLIT, HELD = 16, 1 << 23
MU, RECENT = 0.01, 2


def need(nx, ny, num: int, den: int):
    """The least intersection of sets of these sizes whose similarity is num/den or more."""
    return -(-(num * (nx + ny)) // (num + den))


def set_key(shingles: np.ndarray) -> int:
    """A signed 64-bit id of a set."""
    if not len(shingles):
        return 0
    total = textops.mix(shingles).sum(dtype=textops.U) + textops.U(len(shingles))
    order = textops.mix((shingles * textops.U(0x9FB21C651E98DF25)) ^ textops.U(len(shingles)))
    value = int(textops.mix(np.array([total ^ np.bitwise_xor.reduce(order)], textops.U)).view(np.int64)[0])
    return value or 1


def _sets(batch: pa.RecordBatch, words: int):
    for part in textops.chunks(batch, "text"):
        yield part.column(0), textops.shingle_sets(part.column(1), words)


def packed(counts: np.ndarray) -> bytes:
    """Counters for a shuffle: which are not zero, a bit each, and these, low bytes first."""
    on = counts > 0
    some = counts[on].astype("<u8")
    width = max(1, (int(some.max(initial=0)).bit_length() + 7) // 8)
    return zlib.compress(bytes([width]) + np.packbits(on).tobytes() + some.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes(), 1)


def unpacked(raw: bytes, wide: int) -> np.ndarray:
    """The ``wide`` counters that ``packed`` packed."""
    raw = zlib.decompress(raw)
    on = np.unpackbits(np.frombuffer(raw, np.uint8, -(-wide // 8), 1), count=wide).view(bool)
    planes = np.frombuffer(raw, np.uint8, offset=1 + -(-wide // 8)).reshape(raw[0], -1)
    some = np.zeros((planes.shape[1], 8), np.uint8)
    some[:, : raw[0]] = planes.T
    counts = np.zeros(wide, np.int64)
    counts[on] = some.view("<i8")[:, 0]
    return counts


def bitmap(values: DataFrame, make, cells: int, marked) -> np.ndarray:
    """Marks of ``cells`` cells from counts over all rows.

    ``make(batch)`` gives arrays of uint64 values; ``marked(counts)`` the marks of a range of cells.
    Every task sends its counters compressed by range. They are added up one by one as they stream by, first in
    ``BRANCH`` branches a range, then the branches, so that no task gathers them; only marks, ``cells`` / 8
    bytes, come to the driver.
    """
    wide = cells // RANGES
    schema = "range int, branch int, counts binary"

    def count(batches):
        table = np.zeros(cells, np.uint16)
        seen = False
        for batch in batches:
            for array in make(batch):
                if not len(array):
                    continue
                seen = True
                cell, n = np.unique((array & textops.U(cells - 1)).astype(np.int64), return_counts=True)
                table[cell] = np.minimum(table[cell] + n, 65535)
        if seen:
            branch = np.full(RANGES, TaskContext.get().partitionId() % BRANCH, np.int32)
            rows = [packed(table[r * wide : (r + 1) * wide]) for r in range(RANGES)]
            yield pa.RecordBatch.from_arrays([pa.array(range(RANGES), pa.int32()), pa.array(branch), pa.array(rows, pa.binary())], ["range", "branch", "counts"])

    def added(last: bool):
        def run(batches):
            now, counts = None, np.zeros(wide, np.int64)

            def row():
                raw = np.packbits(marked(counts)).tobytes() if last else packed(counts)
                return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([raw], pa.binary())], ["range", "branch", "counts"])

            for batch in batches:
                for key, branch, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    place = (key, -1 if last else branch)
                    if now not in (None, place):
                        yield row()
                        counts = np.zeros(wide, np.int64)
                    now = place
                    counts += unpacked(raw, wide)
            if now is not None:
                yield row()

        return lean(run)

    parts = values.mapInArrow(lean(count), schema).repartition("range", "branch").sortWithinPartitions("range", "branch").mapInArrow(added(False), schema)
    sums = parts.repartition("range").sortWithinPartitions("range").mapInArrow(added(True), schema)
    out = np.zeros(cells // 8, np.uint8)
    for row in sums.collect():
        out[row["range"] * wide // 8 : (row["range"] + 1) * wide // 8] = np.frombuffer(row["counts"], np.uint8)
    return out


def has(marks: np.ndarray, values: np.ndarray) -> np.ndarray:
    cell = values & textops.U(len(marks) * 8 - 1)
    return (marks[(cell >> textops.U(3)).astype(np.int64)] >> (7 - (cell & textops.U(7)).astype(np.uint8))) & 1 > 0


def common(counts: np.ndarray) -> np.ndarray:
    """Cells that hold clearly more than an even share: at least one shingle there is common."""
    mean = counts.mean()
    return counts > mean + 6 * np.sqrt(mean) + COMMON


def room(total: int) -> int:
    """Cells of the sketch over so many shingles, a power of two: the fuller its cells are, the more copies of a
    shingle pass unmarked."""
    return max(CELLS, min(MOST, 1 << (-(-total // LOAD) - 1).bit_length()))


def seats(total: int) -> int:
    """Cells of a bitmap of so many ids, a power of two: with fewer for an id, more rows that are not meant pass."""
    return max(CELLS, min(MOST, 1 << (LOAD * total - 1).bit_length() if total else 0))


def divide_skip(lists: list[list[int]], least: int, mu: float = MU) -> dict[int, int]:
    """Members that are on at least ``least`` of ``lists`` (each ascending), and on how many of them."""
    lists = sorted((x for x in lists if x), key=len)
    found: dict[int, int] = {}
    if len(lists) < least:
        return found
    aside = min(int(least / (mu * math.log2(len(lists[-1]) + 1) + 1)), least - 1)
    short, long, enough = lists[: len(lists) - aside], lists[len(lists) - aside :], least - aside
    at = [0] * len(short)
    heap = [(x[0], j) for j, x in enumerate(short)]
    heapq.heapify(heap)
    while len(heap) >= enough:
        member, popped = heap[0][0], []
        while heap and heap[0][0] == member:
            popped.append(heapq.heappop(heap)[1])
        if len(popped) >= enough:
            n, left = len(popped), aside
            for one in long:
                k = bisect_left(one, member)
                n += k < len(one) and one[k] == member
                left -= 1
                if n + left < least:
                    break
            if n >= least:
                found[member] = n
            goal = member + 1
        else:
            while heap and len(popped) < enough - 1:
                popped.append(heapq.heappop(heap)[1])
            if not heap:
                break  # no member can be on so many of the lists that are left
            goal = heap[0][0]
        for j in popped:
            at[j] = k = bisect_left(short[j], goal, at[j])
            if k < len(short[j]):
                heapq.heappush(heap, (short[j][k], j))
    return found


def search(sets: list[np.ndarray], sides: np.ndarray, num: int, den: int, every: bool = False) -> list[tuple[int, int]]:
    """Links that connect all linked sets of one block, or with ``every`` all links. Where ``sides`` holds two
    values, pairs of one side are left out (another task has them)."""
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    sizes, side = sizes[order], sides[order]
    tokens = np.concatenate([sets[i] for i in order])
    _, token = np.unique(tokens, return_inverse=True)
    by = np.argsort(token, kind="stable")  # members of each list ascend
    member, begin = np.repeat(np.arange(len(order)), sizes)[by], np.searchsorted(token[by], np.arange(token.max() + 2))
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    links, root = [], np.arange(len(order))
    two = len(np.unique(side)) > 1
    recent: dict[int, list[int]] = {int(k): [] for k in np.unique(side)}

    def lists_of(x: int, allowed: np.ndarray) -> list[list[int]]:
        t = token[cuts[x] : cuts[x + 1]]
        size = begin[t + 1] - begin[t]
        there = member[spread(begin[t], size)]
        on = allowed[there]
        owner, there = np.repeat(np.arange(len(t)), size)[on], there[on]
        cut, flat = [0, *(np.flatnonzero(owner[1:] != owner[:-1]) + 1).tolist(), len(owner)], there.tolist()
        return [flat[a:b] for a, b in zip(cut, cut[1:], strict=False)]

    for x in range(len(order)):
        n = int(sizes[x])
        least = -(-num * n // den)  # the smallest overlap with any set that is not larger
        open_ = np.zeros(len(order), bool)
        open_[np.searchsorted(sizes[:x], least) : x] = True
        if two:
            open_ &= side != side[x]
        first = np.zeros(len(order), bool)
        first[[y for k, ys in recent.items() if not two or k != side[x] for y in ys]] = True
        for part in (np.ones_like(first),) if every else (first, ~first):
            allowed = open_ & part & (every | (root != root[x]))
            lists = lists_of(x, allowed) if allowed.any() else []
            for y, shared in divide_skip(lists, least).items():
                if (every or root[x] != root[y]) and shared >= need(n, int(sizes[y]), num, den):
                    links.append((int(order[x]), int(order[y])))
                    root[root == root[x]] = root[y]
        own = recent[int(side[x])]
        own[:] = [x, *own[: RECENT - 1]]
    return links


def without(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the ids of ``gone`` (one long column, a checkpoint); a null id stays.

    A bitmap lets most rows pass beside the join, so that few texts are shuffled.
    """
    (name,) = gone.columns
    marks = docs.sparkSession.sparkContext.broadcast(bitmap(gone, lambda batch: [textops.mix(batch.column(0).to_numpy().view(textops.U))], seats(gone.count()), lambda c: c > 0))
    maybe, key = unused(docs, "_maybe"), unused(docs, "_gone")

    def mark(batches):
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(id_col)).cast(pa.int64())
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            on = known & has(marks.value, textops.mix(ids.view(textops.U)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(on)], [*batch.schema.names, maybe])

    marked = docs.mapInArrow(lean(mark), StructType([*docs.schema.fields, StructField(maybe, BooleanType())]))
    tested = marked.where(F.col(maybe)).join(gone.select(F.col(name).alias(key)), F.col(id_col).cast("long") == F.col(key), "left_anti")
    return marked.where(~F.col(maybe)).select(*docs.columns).union(tested.select(*docs.columns))


def classes(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n, cls): set size and set id of each text."""

    def run(batches):
        for batch in batches:
            for ids, sets in _sets(batch, words):
                yield pa.RecordBatch.from_arrays([ids, pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) for s in sets], pa.int64())], ["doc_id", "n", "cls"])

    return docs.mapInArrow(lean(run), "doc_id long, n long, cls long")


def links(docs: DataFrame, known: DataFrame, words: int, num: int, den: int, every: bool = False) -> DataFrame:
    """(a, b): links between classes that connect all linked classes, or with ``every`` all links, each once.
    ``known``: a row per class (cls, n, rep)."""
    spark = docs.sparkSession
    cells = room(known.agg(F.sum("n")).first()[0] or 1)
    hot = bitmap(docs, lambda batch: (s for _, sets in _sets(batch, words) for s in [np.concatenate(sets) if sets else np.zeros(0, textops.U)]), cells, common)
    marks = spark.sparkContext.broadcast(hot)

    def post(batches):
        seen: set[int] = set()
        for batch in batches:
            for _, sets in _sets(batch, words):
                token, cls, size = [], [], []
                for s in sets:
                    n = len(s)
                    key = set_key(s) if n else 0
                    if not n or key in seen:
                        continue
                    seen.add(key)
                    p = n - -(-n * num // den) + 1
                    late = has(marks.value, s)
                    first = s[~late][:p]
                    if len(first) < p:
                        first = np.concatenate([first, s[late][: p - len(first)]])
                    token.append(first)
                    cls.append(np.full(p, key, np.int64))
                    size.append(np.full(p, n, np.int32))
                if token:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(token).view(np.int64)), pa.array(np.concatenate(cls)), pa.array(np.concatenate(size))], ["token", "cls", "n"])

    def meet(batches):
        """Inverted lists, each in order of size: links of the chained, and what members of short ones have before them."""
        for table in textops.whole(batches, ["token"]):
            token, size, cls = (table[c].to_numpy() for c in ("token", "n", "cls"))
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])
            token, cls, size = token[new], cls[new], size[new]
            starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            length = np.diff(np.concatenate([starts, [len(token)]]))
            long = np.flatnonzero(np.repeat(length > SHORT, length))
            chained = long[1:][(token[long[1:]] == token[long[1:] - 1]) & (size[long[1:]].astype(np.int64) * num <= size[long[1:] - 1].astype(np.int64) * den)]
            if len(chained):
                edges = np.unique(np.stack([cls[chained - 1], cls[chained]], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(edges[:, 1]), pa.array(np.zeros(len(edges), np.int64)), pa.array([e.tobytes() for e in edges[:, 0]], pa.binary()), pa.nulls(len(edges), pa.binary())], ["cls", "n", "others", "sizes"])
            short = np.flatnonzero(np.repeat((length > 1) & (length <= SHORT), length))
            begin = np.repeat(starts, length)[short]
            size = size.astype(np.int64)
            before, hi = np.concatenate([[0], np.cumsum(short - begin)]), 0
            while hi < len(short):  # some 1 << 20 pairs at a time
                lo, hi = hi, max(hi + 1, min(hi + (1 << 16), int(np.searchsorted(before, before[hi] + (1 << 20), "right")) - 1))
                rows = []
                for at, first in zip(short[lo:hi].tolist(), begin[lo:hi].tolist(), strict=True):
                    first += int(np.searchsorted(size[first:at], -(-size[at] * num // den)))
                    if first < at:
                        rows.append((cls[at], size[at], cls[first:at].tobytes(), size[first:at].astype(np.int32).tobytes()))
                if rows:
                    c, n, others, sizes = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(c)), pa.array(np.array(n)), pa.array(others, pa.binary()), pa.array(sizes, pa.binary())], ["cls", "n", "others", "sizes"])

    def enough(batches):
        """Pairs with at least T' common prefix shingles, and all chained ones."""
        for table in textops.whole(batches, ["cls"]):
            others = table["others"].to_pylist()
            times = np.array([len(o) // 8 for o in others])
            y = np.frombuffer(b"".join(others), np.int64)
            x, nx = np.repeat(table["cls"].to_numpy(), times), np.repeat(table["n"].to_numpy(), times)
            ny = np.zeros(len(y), np.int64)
            ny[nx > 0] = np.frombuffer(b"".join([o for o in table["sizes"].to_pylist() if o]), np.int32)
            pairs, shared = np.unique(np.stack([x, y, nx, ny], 1), axis=0, return_counts=True)
            x, y, nx, ny = pairs.T
            on = (nx == 0) | (shared >= need(nx, ny, num, den) - -(-nx * num // den) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[on])), pa.array(np.ascontiguousarray(y[on]))], ["a", "b"])

    postings = docs.mapInArrow(lean(post), "token long, cls long, n int").repartition("token").sortWithinPartitions("token", "n", "cls")
    near = postings.mapInArrow(lean(meet), "cls long, n long, others binary, sizes binary").repartition("cls").sortWithinPartitions("cls").mapInArrow(lean(enough), "a long, b long")

    def rep_sets(batch: pa.RecordBatch):
        for ids, sets in _sets(batch, words):
            yield ids, np.array([set_key(s) for s in sets], np.int64), sets

    return verified(docs, near, known, rep_sets, num, den, every)


def sub_blocks(classes: Column, shingles: Column) -> Column:
    """Sub-blocks of a block with so many classes and shingles: each of its sets is copied so often."""
    fine = F.greatest(F.ceil(classes / SUB), F.ceil(shingles / SUB_SIZE))
    return F.greatest(F.least(fine, F.lit(SPLIT)), F.ceil(shingles / HELD)).cast("int")


def search_pieces(sets: list[np.ndarray], sides: np.ndarray, num: int, den: int, every: bool = False) -> list[tuple[int, int]]:
    """``search`` over pairs of pieces of some ``SUB_SIZE`` shingles of one side each, which bound its memory."""
    sizes, piece = np.array([len(s) for s in sets]), np.zeros(len(sets), np.int64)
    for k in np.unique(sides):
        on = np.flatnonzero(sides == k)
        piece[on] = (np.cumsum(sizes[on]) - 1) // SUB_SIZE
    labels, of = np.unique(np.stack([sides.astype(np.int64), piece], 1), axis=0, return_inverse=True)
    two, found, of = len(np.unique(sides)) > 1, [], of.reshape(-1)
    for a, b in combinations_with_replacement(range(len(labels)), 2):
        if two and labels[a, 0] == labels[b, 0]:
            continue
        at = np.flatnonzero((of == a) | (of == b))
        if len(at) > 1:
            found += [(int(at[x]), int(at[y])) for x, y in search([sets[k] for k in at], of[at], num, den, every)]
    return found


def verified(docs: DataFrame, near: DataFrame, known: DataFrame, rep_sets, num: int, den: int, every: bool = False) -> DataFrame:
    """(a, b): links of at least num/den that connect all linked classes of each component of ``near``
    (a, b). ``known`` has a row per class (cls, n, rep): set size and the smallest id of a text that
    holds it; ``rep_sets(batch)`` gives (ids, class ids, sets) of the texts of a batch."""
    spark = docs.sparkSession
    blocks = components(near)
    placed = known.join(blocks, known.cls == blocks.node).select("cls", "rep", "n", F.col("root").alias("block")).checkpoint()
    wanted = bitmap(placed.select("rep"), lambda batch: [textops.mix(batch.column(0).to_numpy().view(textops.U))], seats(placed.count()), lambda c: c > 0)
    reps = spark.sparkContext.broadcast(wanted)

    def fetch(batches):
        for batch in batches:
            ids = batch.column(0)
            on = has(reps.value, textops.mix(ids.to_numpy(zero_copy_only=False).astype(np.int64).view(textops.U))) if len(ids) else np.zeros(0, bool)
            for rows, keys, sets in rep_sets(batch.filter(pa.array(on))):
                yield pa.RecordBatch.from_arrays([rows, pa.array(keys, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["rep", "cls", "shingles"])

    held = docs.mapInArrow(lean(fetch), "rep long, cls long, shingles binary")
    room = placed.groupBy("block").agg(F.count("*").alias("c"), F.sum("n").alias("s")).select("block", sub_blocks(F.col("c"), F.col("s")).alias("m"))
    sub = F.pmod(F.xxhash64("cls"), F.col("m")).cast("int")
    # a block may hold a large share of the rows: its one row in ``room`` is copied for each salt
    salted = room.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("cls", F.lit("salt")), F.lit(SALTS)).cast("int")
    dealt = placed.withColumn("salt", salt).join(salted, ["block", "salt"]).withColumn("sub", sub).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    dealt = dealt.select("cls", "rep", "block", "sub", F.least("sub", "other").alias("i"), F.greatest("sub", "other").alias("j"))
    tasks = held.dropDuplicates(["rep", "cls"]).join(dealt, ["rep", "cls"])

    def local(batches):
        for group in textops.groups(batches, ["block", "i", "j"]):
            cls, at = np.unique(group["cls"].to_numpy(), return_index=True)
            raw, sub = group["shingles"].to_pylist(), group["sub"].to_numpy()
            found = search_pieces([np.frombuffer(raw[k], textops.U) for k in at], sub[at], num, den, every) if len(cls) > 1 else []
            if found:
                pairs = np.array(found, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(cls[pairs[:, 0]]), pa.array(cls[pairs[:, 1]])], ["a", "b"])

    ordered = tasks.select("block", "i", "j", "cls", "sub", "shingles").repartition("block", "i", "j").sortWithinPartitions("block", "i", "j")
    return ordered.mapInArrow(lean(local), "a long, b long")


def ngram_join(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", every: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of ``docs``. With ``every`` no link is left out where
    another way joins two texts already, and n_links follows: the rows that a row links with, equal texts and
    repeated rows among them (null for a null id); its work grows with the number of links."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    named = slim.where(F.col("doc_id").isNotNull())
    with tidy(docs.sparkSession):
        rows = classes(slim, words).checkpoint()
        known = rows.where("n > 0 and doc_id is not null").groupBy("cls").agg(F.first("n").alias("n"), F.min("doc_id").alias("rep"), F.count("*").alias("copies")).checkpoint()
        near = links(named, known.select("cls", "n", "rep"), words, num, den, every)
        near = near.checkpoint() if every else near
        same = rows.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("cls").alias("a"), F.max("cls").alias("b")).where("a <> b").select("a", "b")
        roots = components(near.union(same)).checkpoint()
    joined = known.join(roots, known.cls == roots.node, "left").select("cls", "rep", "copies", F.coalesce("root", "cls").alias("root"))
    # a component may hold a large share of the rows: its one row of ``least`` is copied for each salt
    least = joined.groupBy("root").agg(F.min("rep").alias("component")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("cls", F.lit("salt")), F.lit(SALTS)).cast("int")
    of_class = joined.withColumn("salt", salt).join(least, ["root", "salt"]).select("cls", "component", "copies")
    if every:
        both = near.union(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
        partners = both.join(known.select(F.col("cls").alias("b"), "copies"), "b").groupBy(F.col("a").alias("cls")).agg(F.sum("copies").alias("others"))
        of_class = of_class.join(partners, "cls", "left")
    out = rows.join(of_class, "cls", "left")
    linked = [F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("copies") - 1 + F.coalesce("others", F.lit(0))).otherwise(0)).alias("n_links")] if every else []
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(F.col("n") > 0, F.col("component")), F.col("doc_id"))).alias("component_id"), *linked)
