"""The prefix trie of all conversations, as one table of nodes.

A turn is known by two 64-bit codes of its role and text (128 bits), a conversation by the
array of its turns' codes.  Conversations are range-partitioned and sorted by that array
and their id, so the members of a node lie next to each other, the ones that end there
first and by ascending id.  A task walks its sorted rows in chunks: a padded matrix of turn
numbers, ordered by ``lexsort``, whose OR-accumulated column changes mark where nodes start;
``reduceat`` over those starts gives every depth its members, children, leaves and sums.

A node that goes on in the next or the previous chunk is a *boundary node*.  Those are known
before they are counted: they are the prefixes that two neighbouring rows share, and the
neighbours across partitions are compared first (two rows a partition; one length each goes
to the driver).  Boundary nodes leave a chunk as partial sums under a hash of their path and
are recombined by grouping; every other node is complete where it is found.

A chunk holds at most ``CELLS`` matrix cells, or one conversation.  A conversation is the
unit of a row: its codes (not its texts) are gathered in one array.  Node hashes of ids are
SHA-256 over all members that end at a node, in order; for a boundary node the pieces of
its list are streamed through the hash in one task, which holds no more than a batch.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import read, saved
from .registry import query

CELLS = 1 << 20            # matrix cells of a chunk
PIECE_IDS = 1500           # ids of one piece of a boundary node's list
# Fixed values of the contract.
GROUP, SHARED = 100, 6
EMPTY = hashlib.sha256(b"").hexdigest()

NODES = ("kind int, chunk long, piece int, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, "
         "n_leaves long, saved_tokens long, chars long, key binary, parent_key binary, path array<binary>, ends binary")
DONE, PART, ENDS = 0, 1, 2     # kinds of rows: complete node, share of a boundary node, piece of its list


def conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as structs (turn, a, b, chars).

    Null turn numbers come first, equal ones are ordered by their codes; a null role or
    text counts as empty; rows without a conv_id belong to no conversation and are left out."""
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    one = F.struct(F.col(turn).alias("turn"), F.xxhash64(r, t).alias("a"), F.xxhash64(F.lit("turn"), t, r).alias("b"),
                   F.length(t).cast("long").alias("chars"))
    return (turns.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv_id"), one.alias("one"))
            .groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("turns")))


def rebuilt(convs: DataFrame, group: int = GROUP, shared: int = SHARED) -> DataFrame:
    """Each conversation with its first h turns replaced by those of its group's first
    conversation (as many as that has), h = crc32(id) modulo ``shared``."""
    first = (convs.where(F.col("conv_id") % group == 0)
             .select(F.col("conv_id").alias("first_id"), F.slice("turns", 1, shared - 1).alias("first_turns")))
    h = (F.crc32(F.col("conv_id").cast("string")) % shared).cast("int")
    none = F.array().cast(convs.schema["turns"].dataType)
    return (convs.withColumn("first_id", F.col("conv_id") - F.col("conv_id") % group).join(first, "first_id", "left")
            .select("conv_id", F.concat(F.slice(F.coalesce("first_turns", none), F.lit(1), h),
                                        F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns")))


def _edges(batches):
    """(pid, conv_id, seq, chars) -> pid, first and last sequence of the partition"""
    import pyarrow as pa

    pid = first = last = None
    for batch in batches:
        if batch.num_rows:
            if first is None:
                pid, first = batch.column(0)[0], batch.column(2).slice(0, 1)
            last = batch.column(2).slice(batch.num_rows - 1, 1)
    if first is not None:
        yield pa.RecordBatch.from_arrays([pa.array([pid.as_py()], pa.int32()), first, last], ["pid", "first", "last"])


def _common(x: Column, y: Column) -> Column:
    """Turns that two sequences (two codes a turn) share from the start."""
    differ = F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), False)
    same = F.when(differ == 0, F.greatest(F.size(x), F.size(y))).otherwise(differ - 1)
    return F.floor(same / 2).cast("long")


def neighbours(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """Partition -> turns that its first row shares with the row before, its last with the row after."""
    kind = rows.schema["seq"].dataType.simpleString()
    edges = rows.mapInArrow(_edges, f"pid int, first {kind}, last {kind}")
    w = Window.orderBy("pid")                                     # one row a partition
    d = edges.select("pid", F.coalesce(_common(F.lag("last").over(w), F.col("first")), F.lit(0)).alias("before"),
                     F.coalesce(_common(F.col("last"), F.lead("first").over(w)), F.lit(0)).alias("after"))
    return {r[0]: (r[1], r[2]) for r in d.collect()}


class Rows:
    """Some sorted conversations: ids, turns each, codes (two a turn) and characters of all turns."""

    def __init__(self, conv, lens, codes, chars):
        self.conv, self.lens, self.codes, self.chars = conv, lens, codes, chars

    @classmethod
    def of(cls, batch):
        seq, chars = batch.column(2), batch.column(3)
        o = np.asarray(seq.offsets).astype(np.int64)
        c = np.asarray(chars.offsets).astype(np.int64)
        return cls(np.asarray(batch.column(1)), np.diff(c), np.asarray(seq.values)[o[0]:o[-1]].reshape(-1, 2), np.asarray(chars.values)[c[0]:c[-1]])

    def part(self, i: int, j: int) -> Rows:
        at = np.concatenate(([0], np.cumsum(self.lens)))
        return Rows(self.conv[i:j], self.lens[i:j], self.codes[at[i]:at[j]], self.chars[at[i]:at[j]])

    @classmethod
    def joined(cls, parts: list[Rows]) -> Rows:
        return cls(*[np.concatenate([getattr(p, k) for p in parts]) for k in ("conv", "lens", "codes", "chars")])

    def row(self, k: int) -> np.ndarray:
        at = int(self.lens[:k].sum())
        return self.codes[at:at + int(self.lens[k])]


def chunks(batches, cells: int):
    """Consecutive rows whose padded matrix has at most ``cells`` cells (one row may have more)."""
    pending, n, width = [], 0, 1
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = Rows.of(batch)
        pending.append(rows)
        n, width = n + len(rows.conv), max(width, int(rows.lens.max()))
        if n * width <= cells:
            continue
        held = Rows.joined(pending)
        while True:
            widths = np.maximum.accumulate(np.maximum(held.lens, 1))
            over = np.flatnonzero(widths * np.arange(1, len(widths) + 1) > cells)
            if not len(over) or len(held.conv) == 1:
                break
            cut = max(1, int(over[0]))
            yield held.part(0, cut)
            held = held.part(cut, len(held.conv))
        pending, n, width = [held], len(held.conv), int(widths[-1])
    if pending:
        yield Rows.joined(pending)


def shared_turns(x: np.ndarray, y: np.ndarray) -> int:
    n = min(len(x), len(y))
    differ = np.flatnonzero((x[:n] != y[:n]).any(axis=1))
    return int(differ[0]) if len(differ) else n


def path_keys(codes: np.ndarray, depth: int) -> list[bytes]:
    """The hash of every prefix of a path, from none to ``depth`` turns."""
    h, out = hashlib.blake2b(digest_size=16), []
    for d in range(depth + 1):
        if d:
            h.update(codes[d - 1].tobytes())
        out.append(h.copy().digest())
    return out


def _ids(conv: np.ndarray) -> bytes:
    return ",".join(map(str, conv.tolist())).encode()


def nodes_of(rows: Rows, before: int, after: int, chunk: int) -> list[tuple]:
    """Rows of ``NODES`` for the sorted conversations of a chunk, of which the first shares
    ``before`` turns with the row before it and the last ``after`` turns with the next."""
    n, w = len(rows.conv), int(rows.lens.max())
    row_of = np.repeat(np.arange(n), rows.lens)
    col_of = np.arange(len(row_of)) - np.repeat(np.cumsum(rows.lens) - rows.lens, rows.lens)
    matrix, chars = np.zeros((n, w), np.int64), np.zeros((n, w), np.int64)
    if w:
        by = np.lexsort((rows.codes[:, 1], rows.codes[:, 0]))           # turn numbers in the order of the codes
        c = rows.codes[by]
        number = np.empty(len(by), np.int64)
        number[by] = np.concatenate(([1], 1 + np.cumsum((c[1:] != c[:-1]).any(axis=1))))
        matrix[row_of, col_of] = number
        chars[row_of, col_of] = rows.chars
    order = np.lexsort((rows.conv, *matrix.T[::-1]))
    matrix, chars, conv, lens = matrix[order], chars[order], rows.conv[order], rows.lens[order]
    changed = np.ones((n, w + 1), bool)                                 # column d: a node of depth d starts here
    changed[1:, 0] = False
    if n > 1 and w:
        changed[1:, 1:] = np.logical_or.accumulate(matrix[1:] != matrix[:-1], axis=1)

    first_keys = path_keys(rows.row(int(order[0])), before)
    last_keys = path_keys(rows.row(int(order[-1])), after)
    starts = [np.flatnonzero(changed[:, d]) for d in range(w + 1)]
    least = [np.minimum.reduceat(conv, s) for s in starts]

    def boundary(d: int) -> dict[int, bytes]:
        """Number of the part -> key, for the boundary nodes of depth d."""
        out = {0: first_keys[d]} if d <= before else {}
        if d <= after:
            out[len(starts[d]) - 1] = last_keys[d]
        return out

    sums, leaf, child = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    out = []
    for d in range(w, -1, -1):
        s = starts[d]
        size = np.diff(np.append(s, n))
        here = lens[s] >= d
        ended = np.add.reduceat((lens == d).astype(np.int64), s)
        children = np.add.reduceat(child, s)
        last_chars = chars[s, d - 1] if d else np.zeros(len(s), np.int64)
        shared = boundary(d)
        own = here.copy()                                               # complete nodes
        own[list(shared)] = False
        sums[s[own]] += ((size - 1) * last_chars)[own]
        leaf[s[own]] += (children == 0)[own]
        saved_sum, leaves = np.add.reduceat(sums, s), np.add.reduceat(leaf, s)
        child[:] = 0
        child[s[own]] = 1
        above = np.searchsorted(starts[d - 1], s, "right") - 1 if d else None
        parents = boundary(d - 1) if d else {}
        for k in np.flatnonzero(own).tolist():
            up = int(above[k])
            out.append((DONE, chunk, 0, d, int(least[d][k]), None if up in parents else int(least[d - 1][up]), int(size[k]), int(children[k]),
                        int(leaves[k]), int(saved_sum[k]), 0, None, parents.get(up), None,
                        hashlib.sha256(_ids(conv[s[k]:s[k] + ended[k]])).digest() if ended[k] else None))
        for k, key in shared.items():
            path = first_keys if k == 0 and d <= before else last_keys
            out.append((PART, chunk, 0, d, int(least[d][k]), None, int(size[k]), int(children[k]), int(leaves[k]), int(saved_sum[k]),
                        int(last_chars[k]), key, path[d - 1] if d else None, path[:d + 1], None))
            for p, i in enumerate(range(0, int(ended[k]), PIECE_IDS)):
                a = int(s[k])
                out.append((ENDS, chunk, p, d, None, None, None, None, None, None, None, key, None, None, _ids(conv[a + i:a + min(i + PIECE_IDS, int(ended[k]))])))
    return out


def _nodes(known: dict[int, tuple[int, int]], cells: int):
    def run(batches):
        """(pid, conv_id, seq, chars), sorted -> rows of NODES"""
        import pyarrow as pa

        schema = pa.schema([("kind", pa.int32()), ("chunk", pa.int64()), ("piece", pa.int32()), *[(c, pa.int64()) for c in (
            "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "chars")],
            ("key", pa.binary()), ("parent_key", pa.binary()), ("path", pa.list_(pa.binary())), ("ends", pa.binary())])
        pid, number, held, before = None, 0, None, 0

        def seen(it):
            nonlocal pid
            for batch in it:
                if pid is None and batch.num_rows:
                    pid = batch.column(0)[0].as_py()
                yield batch

        def made(rows, before, after):
            got = nodes_of(rows, max(0, before), max(0, after), (pid << 32) + number)
            for i in range(0, len(got), 5000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got[i:i + 5000]), schema)], schema=schema)

        for rows in chunks(seen(batches), cells):
            if held is not None:
                after = shared_turns(held.row(len(held.conv) - 1), rows.row(0))
                yield from made(held, before, after)
                before, number = after, number + 1
            else:
                before = known[pid][0]
            held = rows
        if held is not None:
            yield from made(held, before, known[pid][1])
    return run


def _hashed(batches):
    """(key, ends), the pieces of a key in a row -> key, ends: the hash of all its ids"""
    import pyarrow as pa

    key = h = None
    for batch in batches:
        done = []
        for k, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if k != key:
                if key is not None:
                    done.append((key, h.digest()))
                key, h = k, hashlib.sha256(piece)
            else:
                h.update(b"," + piece)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*done)], ["key", "ends"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([h.digest()], pa.binary())], ["key", "ends"])


def _recombined(found: DataFrame) -> DataFrame:
    """Boundary nodes, whole: key, depth, conv_id, parent_key, n_convs, n_children, n_leaves, saved_tokens, ends."""
    parts = (found.where(F.col("kind") == PART).groupBy("key", "depth").agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("inner_children"),
        F.sum("n_leaves").alias("inner_leaves"), F.sum("saved_tokens").alias("inner_saved"), F.max("chars").alias("chars"),
        F.max("parent_key").alias("parent_key"), F.max("path").alias("path")))
    parts = saved(parts)
    below = parts.where(F.col("parent_key").isNotNull()).groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("more"))
    whole = (parts.join(below, "key", "left")
             .withColumn("n_children", F.col("inner_children") + F.coalesce("more", F.lit(0)))
             .withColumn("own_saved", (F.col("n_convs") - 1) * F.col("chars"))
             .withColumn("own_leaf", (F.col("n_children") == 0).cast("long")))
    # every boundary node counts for all nodes of its path, itself included
    sums = (whole.select(F.explode("path").alias("key"), "own_saved", "own_leaf").groupBy("key")
            .agg(F.sum("own_saved").alias("sub_saved"), F.sum("own_leaf").alias("sub_leaves")))
    ends = (found.where(F.col("kind") == ENDS).select("key", "chunk", "piece", "ends").repartition("key")
            .sortWithinPartitions("key", "chunk", "piece").select("key", "ends").mapInArrow(_hashed, "key binary, ends binary"))
    return (whole.join(sums, "key").join(ends, "key", "left")
            .select("key", "depth", "conv_id", "parent_key", "n_convs", "n_children", (F.col("inner_leaves") + F.col("sub_leaves")).alias("n_leaves"),
                    (F.col("inner_saved") + F.col("sub_saved")).alias("saved_tokens"), "ends"))


def trie(convs: DataFrame, cells: int = CELLS) -> DataFrame:
    """The nodes of the trie of ``convs`` (conv_id, turns as made by ``conversations``): conv_id
    (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    conv_ids are unique and not null.  A conversation without turns is a member of the root
    alone.  No conversation, no node."""
    d = convs.select("conv_id", F.flatten(F.transform("turns", lambda t: F.array(t["a"], t["b"]))).alias("seq"),
                     F.transform("turns", lambda t: t["chars"]).alias("chars"))
    rows = saved(d.repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id")
                 .select(F.spark_partition_id().alias("pid"), "conv_id", "seq", "chars"))
    found = saved(rows.mapInArrow(_nodes(neighbours(rows), cells), NODES))
    edge = saved(_recombined(found))
    names = edge.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    done = found.where(F.col("kind") == DONE).select("chunk", "parent_key", *columns)
    root = edge.where("depth = 0").select("conv_id").scalar()
    plain = done.where(F.col("parent_key").isNull() | (F.col("depth") == 1)).withColumn(
        "parent_conv_id", F.when(F.col("depth") == 1, root).otherwise(F.col("parent_conv_id")))
    # children of other boundary nodes look their parent up within their chunk: no key is hot
    local = (found.where(F.col("kind") == PART).select("chunk", F.col("key").alias("parent_key")).join(names, "parent_key")
             .dropDuplicates(["chunk", "parent_key"]))
    looked = (done.where(F.col("parent_key").isNotNull() & (F.col("depth") > 1)).join(local, ["chunk", "parent_key"])
              .withColumn("parent_conv_id", F.col("parent")))
    edges = edge.join(names, "parent_key", "left").withColumn("parent_conv_id", F.col("parent"))
    out = plain.select(*columns).unionByName(looked.select(*columns)).unionByName(edges.select(*columns))
    return out.withColumn("ends_sha256", F.coalesce(F.lower(F.hex("ends")), F.lit(EMPTY))).drop("ends")


SQL = f"""
WITH elems AS (
  SELECT DISTINCT conv_id, list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''),
           lambda ch: list_concat([ascii(ch)::BIGINT], [-1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[])))) AS e
  FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT conv_id, (xor(list_reduce(e, lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384)
           ELSE c // 2 END), 4294967295) % {SHARED})::BIGINT AS h FROM elems),
own AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p,
               coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
first_turns AS (SELECT h.conv_id, own.p, own.role, own.text FROM h JOIN own ON own.conv_id = h.conv_id - h.conv_id % {GROUP} AND own.p <= h.h),
n_first AS (SELECT conv_id, count(*) AS n FROM first_turns GROUP BY conv_id),
rebuilt AS (SELECT conv_id, p, role, text FROM first_turns
            UNION ALL SELECT own.conv_id, own.p - h.h + coalesce(n_first.n, 0), own.role, own.text
            FROM own JOIN h USING (conv_id) LEFT JOIN n_first USING (conv_id) WHERE own.p > h.h),
seq AS (SELECT h.conv_id, coalesce(list({{'r': role, 't': text}} ORDER BY p) FILTER (WHERE p IS NOT NULL), []) AS s
        FROM h LEFT JOIN rebuilt USING (conv_id) GROUP BY h.conv_id),
member AS (SELECT conv_id, d, s[1:d] AS path, len(s) AS n FROM seq, unnest(range(len(s) + 1)) AS u(d)),
node AS (SELECT d, path, min(conv_id) AS conv_id, count(*) AS n_convs, CASE WHEN d = 0 THEN 0 ELSE length(path[d].t) END AS chars,
                coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = d), '') AS ends FROM member GROUP BY d, path),
kids AS (SELECT d - 1 AS d, path[1:d-1] AS path, count(*) AS n_children FROM node WHERE d > 0 GROUP BY ALL),
full_node AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (d, path)),
up AS (SELECT a AS d, path[1:a] AS path, sum((n_convs - 1) * chars) AS saved, count(*) FILTER (WHERE n_children = 0) AS leaves
       FROM full_node, unnest(range(d + 1)) AS u(a) GROUP BY ALL)
SELECT f.conv_id, f.d AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, up.leaves AS n_leaves, up.saved::BIGINT AS saved_tokens,
       sha256(f.ends) AS ends_sha256
FROM full_node f JOIN up USING (d, path) LEFT JOIN node p ON p.d = f.d - 1 AND p.path = f.path[1:f.d-1]
"""


@query("op13_trie", SQL)
def op13_trie(spark, sf_dir):
    """The trie of all rebuilt conversations."""
    return trie(rebuilt(conversations(read(spark, sf_dir, "conversations"))))
