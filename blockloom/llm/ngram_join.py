"""Similarity join on n-gram sets by vertical partitioning, and the components of its links.

All n-grams have one global order: those that are rare first, by hash, then those that many texts have (HOT). Fragments
of the order serve twice: to find candidates, and to count overlaps.

1. Equal sets are one class, represented by its smallest id.
2. Sets of a linked pair differ in D n-grams at most, so of more than D fragments one is equal in both. Each set gives
   a key for each fragment of the rare part of the order, cut into D + 1 and a few more (D for its size level, and for the
   next level where a partner could be there). A set with too few rare n-grams for that gives a mark of its level, too.
   Keys are dealt over the cluster by their hash. Within a key rows are sorted by size, and a gap too wide for any link
   ends a run.
3. Sets of a run are tied if a link between them is possible. Parities of hashed n-grams (an odd sketch, whose differing
   bits never exceed the differing n-grams) rule most others out; pivots save comparing all pairs of long runs. Sets with
   a mark of one level, and runs of more than RUN_ROWS sets, are tied without a sketch, by a star. Components of the
   ties are clusters: no link leaves one.
4. Overlaps are counted exactly. Each round takes some sets of every unfinished cluster as pivots. N-grams of sets and
   pivots are dealt by (cluster, block of sets, block of pivots, fragment of the order); each fragment counts its partial overlaps of pivots and
   sets alone, but of pairs in one component or ruled out, and an aggregation sums them per pair. Pairs that reach the threshold join components. What is outside a
   cluster's largest component gives the next round's pivots, more each time, until all pairs are compared or connected:
   a group of near copies costs a few pivots, not all pairs.

Blocks of sets, blocks of pivots and chunks are bounded by the n-grams that they hold, not by sets, so memory doesn't
depend on text lengths, but for the one text that is the last of its block.

Cases: null and empty texts, and texts of white space, have no n-grams and are linked with nothing; texts with fewer
words are one n-gram; very long texts are read whole (a text's n-grams are the unit that must fit a worker); repeated rows
and equal sets are one class; an id with different texts is one member, for which its smallest text is compared with
unequal ones; ties don't matter to components; rows with a null id are components of their own with a null id; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .components import components

#: Words in an n-gram and the threshold in percent.
WORDS, PERCENT = 4, 85
#: Ratio of the largest and the smallest size of a level, if the threshold allows it.
LEVEL = 1.3
#: Fragments in which overlaps are counted; n-grams of a block of sets and of one of pivots, and of a chunk that is counted
#: at once.
FRAGMENTS, BLOCK_GRAMS, PIVOT_GRAMS, CHUNK_GRAMS = 4, 1 << 18, 1 << 18, 1 << 18
#: Places where an n-gram of a set meets one of a pivot that are counted at once, and pairs whose counts are held.
MEETINGS, PAIRS = 1 << 18, 1 << 17
#: Pivots of a cluster in the first round, growth, and most in a round (there are as many rounds as needed).
PIVOTS, GROWTH, MOST_PIVOTS = 4, 16, 2048
#: Parts of a cluster that name their first pivots on their own, before the cluster's are taken from these.
SALTS = 64
#: Longest run whose pairs are tied as they are found, and longest one that is compared in one piece.
SHORT, RUN_ROWS = 4, 4096
#: Bits for a set's size beside a token: 12 of its own and 5 for how many more there were.
SIZE_BITS = 17
#: An n-gram is hot if HOT texts of a bucket (BUCKET n-grams in a row of one task) have it; the hottest MOST_HOT count.
HOT, BUCKET, MOST_HOT = 8, 1 << 21, 200_000
#: Bits of the smallest odd sketch; larger sets have about one for each n-gram. Sets whose overlaps are counted have FINE:
#: two differing n-grams then seldom share one, so few pairs just below the threshold are left to count.
SKETCH_BITS, FINE = 512, 8


def _texts(batch) -> list[bytes]:
    return [(x.as_py() or "").encode("utf-8", "surrogatepass") for x in batch.column(batch.schema.get_field_index("text"))]


def sketch(tokens, times: int = 1):
    """Parities of the set's hashes by their last bits, as bytes; about `times` bits for each n-gram."""
    import numpy as np

    from .shingles import mix

    bits = max(SKETCH_BITS, times << max(0, len(tokens) - 1).bit_length())
    counts = np.bincount((mix(tokens, 3) & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def folded(sketch_bytes, size: int):
    """A sketch as if it had been made with size bytes: the parts' parities."""
    import numpy as np

    return np.bitwise_xor.reduce(np.frombuffer(sketch_bytes, np.uint8).reshape(-1, size), axis=0)


def names(docs: DataFrame, words: int) -> DataFrame:
    """kind 0: doc_id, n (set size), s1 and s2 (a 128-bit name of the set), sketch; kind 1: a hot n-gram s1, n times."""
    import numpy as np
    import pyarrow as pa

    columns = ["kind", "doc_id", "n", "s1", "s2", "sketch"]

    def run(batches: Iterator) -> Iterator:
        from . import shingles

        bucket, held = [], 0

        def hot() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(bucket), return_counts=True)
            tokens, counts = tokens[counts >= HOT].view(np.int64), counts[counts >= HOT]
            blank = pa.nulls(len(tokens))
            return pa.RecordBatch.from_arrays(
                [pa.array(np.ones(len(tokens), np.int32)), blank.cast(pa.int64()), pa.array(counts.astype(np.int64)), pa.array(tokens), blank.cast(pa.int64()), blank.cast(pa.binary())], columns
            )

        for batch in common.pieces(batches):
            sets = shingles.sets(_texts(batch), words)
            one = np.array([np.add.reduce(shingles.mix(s, 1)) if len(s) else 0 for s in sets], np.uint64)
            two = np.array([np.bitwise_xor.reduce(shingles.mix(s, 2)) if len(s) else 0 for s in sets], np.uint64)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.zeros(len(sets), np.int32)), batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)),
                pa.array([sketch(s) for s in sets], pa.binary()),
            ], columns)
            for s in sets:
                bucket.append(s)
                held += len(s)
                if held >= BUCKET:
                    yield hot()
                    bucket, held = [], 0
        if bucket:
            yield hot()

    common.small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "kind int, doc_id long, n long, s1 long, s2 long, sketch binary")


def level_ratio(percent: int) -> float:
    """LEVEL, but never less than the largest ratio of the sizes of a linked pair."""
    return max(LEVEL, 100 / percent)


@functools.lru_cache(4096)
def cuts_of(at: int, percent: int) -> tuple[int, int]:
    """Fragments at size level at, and how many of them may be empty without keys of their own.

    That is a little more than the smallest sets of the level leave empty by chance (two standard deviations): keys of
    empty fragments are equal in all sets that have them, and would tie most of the table where fragments are small.
    """
    ratio = level_ratio(percent)
    least = ratio**at * percent / 100
    differ = int(2 * (int(ratio ** (at + 1)) + 1) * (100 - percent) / (100 + percent) + 1e-9)
    spare = 1 + differ // 30
    for _ in range(20):
        empty = math.exp(-least / (differ + 1 + spare))
        mean = (differ + 1 + spare) * empty
        want = int(1 + mean + 2 * math.sqrt(mean * (1 - empty)))
        if want <= spare:
            break
        spare = want
    return differ + 1 + spare, spare


def fragment_keys(tokens, percent: int, hot=None):
    """Keys and level marks of a sorted set: two sets that reach the threshold have a key or a mark in common.

    With larger size U of the two, at most D = 2 * U * (100 - percent) / (100 + percent) n-grams are in one set only, and
    each spoils one fragment at most. Hot n-grams are in no fragment. Of D + 1 + spare fragments a set without a mark
    leaves at most spare empty, so D + 1 are not, and one of these is equal in both; a set with more empty ones has a mark.
    """
    import numpy as np

    from .shingles import mix

    n, none = len(tokens), np.zeros(0, np.uint64)
    if not n:
        return none, none
    ratio = level_ratio(percent)
    level = int(math.log(n) / math.log(ratio) + 1e-9)
    if hot is not None and len(hot):
        at = np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)
        tokens = tokens[hot[at] != tokens]
    mixed, top, keys, marks = mix(tokens, 1), tokens >> np.uint64(32), [none], []
    for at in (level, level + 1):
        if at > level and n * 100 < (ratio**at - 1) * percent:
            continue
        pieces, spare = cuts_of(at, percent)
        filled = none
        if len(tokens):
            part = (top * np.uint64(pieces)) >> np.uint64(32)
            starts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            filled, sums = part[starts], np.add.reduceat(mixed, starts)
            keys.append(mix(mix(sums + np.uint64(at * 1_000_003), 0) + filled * np.uint64(0x9E3779B97F4A7C15), 2))
        if pieces - len(filled) > spare:
            marks.append(at)
    return np.concatenate(keys), np.array(marks, np.uint64)


def key_rows(docs: DataFrame, words: int, percent: int, hot) -> DataFrame:
    """token, mark, n, id: the fragment keys (mark 0) and level marks (mark 1) of each text, and its set's size."""
    import numpy as np
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        from . import shingles

        for batch in common.pieces(batches):
            sets = shingles.sets(_texts(batch), words)
            found = [fragment_keys(s, percent, hot) for s in sets]
            flat = [x for pair in found for x in pair]
            counts = [len(k) + len(m) for k, m in found]
            mark = np.repeat(np.tile([0, 1], len(sets)), [len(x) for x in flat])
            columns = [
                (np.concatenate(flat) if flat else np.zeros(0, np.uint64)).view(np.int64), mark.astype(np.int32),
                np.repeat([len(s) for s in sets], counts).astype(np.int32), np.repeat(batch.column(0).to_numpy(), counts).astype(np.int64),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["token", "mark", "n", "id"])

    common.small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "token long, mark int, n int, id long")


def size_code(n: Column) -> Column:
    """A set's size as SIZE_BITS bits: as it is below 2^12, then its 12 leading bits and how many follow; never 0."""
    more = F.greatest(F.lit(0), F.length(F.bin(n.cast("long"))) - 12)
    return F.call_function("shiftright", n.cast("long"), more) + more.cast("long") * 4096


def code_size(code: Column) -> Column:
    """The smallest size that has the code; the largest is less than a 2,048th above it."""
    return F.call_function("shiftleft", code.bitwiseAND(F.lit(4095)), F.shiftright(code, 12).cast("int"))


def runs(keys: DataFrame, percent: int) -> DataFrame:
    """What rows of one token say about ids, by kind.

    1: a and b tied; 2: a and b to be compared; 3: member b of run (token, a), for runs longer than SHORT; 4: b has mark a.
    A run ends where the next size is too large for a link with the one before. Keys of one id alone give nothing.
    """
    import numpy as np
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        def apart(n, following):
            """Whether the next size is too large, for all sizes that have n's code."""
            return (n + (n >> 11)) * 100 < percent * following

        def rows(kind: int, token, a, b) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(b), kind, np.int32)), pa.array(token), pa.array(a), pa.array(b)], ["kind", "token", "a", "b"])

        def closed(token, n, own) -> Iterator:
            """Whole runs."""
            begins = np.append(True, (token[1:] != token[:-1]) | (apart(n[:-1], n[1:])))
            start = np.flatnonzero(begins)
            length, group = np.diff(np.append(start, len(token))), np.cumsum(begins) - 1
            first, size = own[start][group], length[group]
            short = size <= SHORT
            for d in range(1, SHORT):
                pair = short[d:] & (group[d:] == group[:-d])
                yield rows(2, token[d:][pair], own[:-d][pair], own[d:][pair])
            long = ~short & (size <= RUN_ROWS)
            yield rows(3, token[long], first[long], own[long])
            huge = size > RUN_ROWS
            yield rows(1, token[huge], first[huge], own[huge])

        held: list = []  # the rows of the run that may go on
        head = None  # its first id, if it is longer than RUN_ROWS, and then only its last row is held
        for batch in batches:
            if not batch.num_rows:
                continue
            token, mark, n, own = (batch.column(i).to_numpy() for i in range(4))
            if mark.any():
                yield rows(4, token[mark > 0], token[mark > 0], own[mark > 0])
                token, n, own = token[mark == 0], n[mark == 0], own[mark == 0]
                if not len(token):
                    continue
            if head is not None:
                stop = np.flatnonzero((token != held[0][-1]) | apart(np.append(held[1][-1], n[:-1]), n))
                end = int(stop[0]) if len(stop) else len(token)
                yield rows(1, token[:end], np.full(end, head), own[:end])
                if end == len(token):
                    held = [token[-1:], n[-1:], own[-1:]]
                    continue
                held, head, token, n, own = [], None, token[end:], n[end:], own[end:]
            if held:
                token, n, own = (np.concatenate(x) for x in zip(held, (token, n, own), strict=True))
            cut = np.flatnonzero((token[1:] != token[:-1]) | (apart(n[:-1], n[1:])))
            at = int(cut[-1]) + 1 if len(cut) else 0
            if at:
                yield from closed(token[:at], n[:at], own[:at])
            held = [token[at:], n[at:], own[at:]]
            if len(held[0]) > RUN_ROWS:
                head = held[2][0]
                yield rows(1, held[0], np.full(len(held[0]), head), held[2])
                held = [x[-1:] for x in held]
        if held and head is None:
            yield from closed(*held)

    # What is moved of a row is its id and one number: 47 bits of the token's hash over SIZE_BITS of n, or a mark over no n at all.
    # Tokens that share these bits may make one run; it is split by size and compared like any other.
    packed = F.when(F.col("mark") == 1, F.col("token") * (1 << SIZE_BITS)).otherwise(F.shiftleft(F.xxhash64("token"), SIZE_BITS).bitwiseOR(size_code(F.col("n"))))
    # Marks are not compared here, so they are dealt by id.
    token, code = F.shiftright("packed", SIZE_BITS), F.col("packed").bitwiseAND(F.lit((1 << SIZE_BITS) - 1))
    moved = keys.select(packed.alias("packed"), "id").repartition(F.when(code == 0, F.xxhash64("id")).otherwise(token)).sortWithinPartitions("packed", "id")
    rows = moved.select(token.alias("token"), (code == 0).cast("int").alias("mark"), code_size(code).alias("n"), "id")
    return rows.mapInArrow(run, "kind int, token long, a long, b long")


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int) -> None:
        import numpy as np

        self.label = np.arange(n)

    def join(self, rows) -> None:
        import numpy as np

        labels = np.unique(self.label[rows])
        self.label[np.isin(self.label, labels)] = labels[0]


def resolve(n: int, linked) -> object:
    """Component label of each of n members, with linked(pivot) -> which members: all pairs are compared, or connected."""
    import numpy as np

    forest, done = Forest(n), np.zeros(n, bool)
    pivot = 0
    while True:
        forest.join(np.append(np.flatnonzero(linked(pivot)), pivot))
        done[pivot] = True
        labels, counts = np.unique(forest.label[~done], return_counts=True)
        if len(labels) < 2:
            return forest.label
        # The smallest component next: only one component, the largest, never needs pivots of its own.
        pivot = int(np.flatnonzero(~done & (forest.label == labels[counts.argmin()]))[0])


def possible(sketches: list[bytes], sizes, percent: int):
    """Component labels of sets, where those are connected that their sketches don't rule out as linked."""
    import numpy as np

    length = np.array([len(x) for x in sketches])
    scale = np.unique(length)
    at = {int(size): np.flatnonzero(length >= size) for size in scale}
    table = {size: np.stack([folded(sketches[i], size) for i in rows]) for size, rows in at.items()}
    spot = {size: {int(i): k for k, i in enumerate(rows)} for size, rows in at.items()}

    def linked(pivot: int):
        out = np.zeros(len(sizes), bool)
        for size in scale[scale <= length[pivot]]:
            rows = at[int(size)]
            differ = np.bitwise_count(table[int(size)] ^ table[int(size)][spot[int(size)][pivot]]).sum(1, dtype=np.int64)
            mine = (length[rows] == size) if size < length[pivot] else np.ones(len(rows), bool)
            out[rows[mine]] = (differ * (100 + percent) <= (100 - percent) * (sizes[rows] + sizes[pivot]))[mine]
        return out & (sizes * 100 >= percent * sizes[pivot]) & (percent * sizes <= 100 * sizes[pivot])

    return resolve(len(sizes), linked)


def grouped(batches: Iterator, keys: int) -> Iterator:
    """Rows of each run of equal values in the first columns, as (key, table); rows come sorted by them."""
    import numpy as np
    import pyarrow as pa

    held, now = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        new = np.append(True, np.logical_or.reduce([c[1:] != c[:-1] for c in columns]))
        starts = np.flatnonzero(new)
        for at, end in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows], strict=True):
            key = tuple(c[at] for c in columns)
            if key != now and held:
                yield now, pa.Table.from_batches(held)
                held = []
            now = key
            held.append(batch.slice(at, end - at))
    if held:
        yield now, pa.Table.from_batches(held)


def compared_pairs(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Of the pairs u, v those that their sketches (id, n, sketch) don't rule out."""
    import numpy as np
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            u, v, n, m = (batch.column(i).to_numpy() for i in range(4))
            a, b = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            differ = np.zeros(len(u), np.int64)
            for i, (x, y) in enumerate(zip(a, b, strict=True)):
                size = min(len(x), len(y))
                if len(x) != len(y):
                    x, y = folded(x, size).tobytes(), folded(y, size).tobytes()
                differ[i] = (int.from_bytes(x) ^ int.from_bytes(y)).bit_count()
            keep = differ * (100 + percent) <= (100 - percent) * (n + m)
            yield pa.RecordBatch.from_arrays([pa.array(u[keep]), pa.array(v[keep])], ["u", "v"])

    a, b = (sketches.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}")) for x in ("u", "v"))
    return pairs.join(a, "u").join(b, "v").select("u", "v", "n_u", "n_v", "sketch_u", "sketch_v").mapInArrow(run, "u long, v long")


def compared_runs(members: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Edges u, v between members (token, a, id) of each run that their sketches leave possible."""
    import numpy as np
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        out_u, out_v, held = [], [], 0
        for _, rows in grouped(batches, 2):
            ids = rows.column("id").to_numpy()
            root = ids[possible(rows.column("sketch").to_pylist(), rows.column("n").to_numpy(), percent)]
            out_u.append(root[root != ids])
            out_v.append(ids[root != ids])
            held += len(out_u[-1])
            if held > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_u, out_v)], ["u", "v"])
                out_u, out_v, held = [], [], 0
        if out_u:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_u, out_v)], ["u", "v"])

    dealt = members.join(sketches, "id").select("token", "a", "id", "n", "sketch").repartition("token", "a").sortWithinPartitions("token", "a", "n", "id")
    return dealt.mapInArrow(run, "u long, v long")


def clusters_of(keys: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """id, cluster of the ids that may be linked with others."""
    found = common.saved(runs(keys, percent), "runs")
    tied = found.filter("kind = 1").select(F.col("a").alias("u"), F.col("b").alias("v"))
    pairs = found.filter("kind = 2").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).filter("u <> v").distinct()
    members = found.filter("kind = 3").select("token", "a", F.col("b").alias("id"))
    marked = found.filter("kind = 4").select(F.col("a").alias("mark"), F.col("b").alias("v"))
    marked = marked.join(marked.groupBy("mark").agg(F.min("v").alias("u")), "mark").select("u", "v")  # one row per size level
    edges = tied.unionByName(compared_pairs(pairs, sketches, percent)).unionByName(compared_runs(members, sketches, percent)).unionByName(marked)
    rooted = components(edges)
    common.drop(found)
    both = rooted.unionByName(rooted.select(F.col("root").alias("id"), "root").distinct())
    out = common.saved(both.withColumnRenamed("root", "cluster"), "clusters")
    return out


def fragments(docs: DataFrame, words: int) -> DataFrame:
    """id, n, sketch, fragment, tokens: each set of rows id, text, cut into FRAGMENTS parts of the order."""
    import numpy as np
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        from . import shingles

        cuts = np.array([(i << 64) // FRAGMENTS for i in range(1, FRAGMENTS)], np.uint64)
        for batch in common.pieces(batches):
            sets = shingles.sets(_texts(batch), words)
            ends = np.array([np.append(np.searchsorted(s, cuts), len(s)) for s in sets], np.int64).reshape(-1, FRAGMENTS)
            sizes = np.diff(ends, axis=1, prepend=0).ravel()
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            own, n = np.repeat(batch.column(0).to_numpy(), FRAGMENTS), np.repeat([len(s) for s in sets], FRAGMENTS)
            tokens = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(flat.view(np.int64)))
            sketches = pa.array([x for s in sets for x in [sketch(s, FINE)] * FRAGMENTS], pa.binary())
            columns = [pa.array(own, pa.int64()), pa.array(n, pa.int64()), sketches, pa.array(np.tile(np.arange(FRAGMENTS), len(sets)), pa.int32()), tokens]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "sketch", "fragment", "tokens"])

    common.small_batches(docs.sparkSession)
    return docs.select("id", "text").mapInArrow(run, "id long, n long, sketch binary, fragment int, tokens array<long>")


def alike(sketches: list[bytes], n, a, b, percent: int):
    """Which of the pairs (a, b) of places the sketches leave possible."""
    import numpy as np

    length = np.array([len(x) for x in sketches])
    least, keep = np.minimum(length[a], length[b]), np.zeros(len(a), bool)
    for size in np.unique(least).tolist():
        rows = np.flatnonzero(least == size)
        used, spot = np.unique(np.concatenate([a[rows], b[rows]]), return_inverse=True)
        table = np.stack([folded(sketches[i], size) for i in used]).view(np.uint64)
        for some in np.array_split(np.arange(len(rows)), 1 + len(rows) * size // common.PIECE_BYTES):
            x, y = rows[some], table[spot[some]] ^ table[spot[len(rows) + some]]
            keep[x] = np.bitwise_count(y).sum(1, dtype=np.int64) * (100 + percent) <= (100 - percent) * (n[a[x]] + n[b[x]])
    return keep


def partial_overlaps(rows: DataFrame, percent: int) -> DataFrame:
    """u, v, n_u, n_v, c: n-grams that pivot u and set v share in one fragment, of rows cluster, block, pivots, fragment,
    pivot (1 or 0), id, comp, n, sketch, tokens; sets meet the pivots of each block of these in groups of their own.

    Left out are pairs of one component (comp), one direction of two pivots, and pairs that cannot be linked as their sketches,
    or this fragment alone, differ in more n-grams than linked sets do in all.
    """
    import numpy as np
    import pyarrow as pa

    names_ = ["u", "v", "n_u", "n_v", "c"]

    def counted(held: list) -> Iterator:
        """The overlaps of whole groups, for pivots that meet PAIRS sets or so at once."""
        group, pivot, ids, comp, n = (np.concatenate([h[i] for h in held]) for i in range(5))
        sketches = [x for h in held for x in h[5]]
        sizes, tokens = np.concatenate([h[6] for h in held]), np.concatenate([h[7] for h in held])
        row = np.repeat(np.arange(len(ids)), sizes)
        # One number for each (group, n-gram): pivots' and sets' places with the same number meet.
        order = np.lexsort((tokens, group[row]))
        g, t = group[row][order], tokens[order]
        same = np.empty(len(order), np.int64)
        same[order] = np.cumsum(np.append(True, (g[1:] != g[:-1]) | (t[1:] != t[:-1]))) - 1 if len(order) else same
        asks = pivot == 1
        asked, of_pivot = np.isin(ids, ids[asks]), asks[row]
        all_s_row, all_s_key = row[~of_pivot], same[~of_pivot]
        meets = np.cumsum(np.bincount(group[~asks], minlength=group.max() + 1)[group[asks]])
        total = int(meets[-1]) if len(meets) else 0
        for some in np.split(np.flatnonzero(asks), np.searchsorted(meets, np.arange(PAIRS, total, PAIRS))):
            now = np.zeros(len(ids), bool)
            now[some] = True
            now = now[row]
            p_row, p_key = row[now], same[now]
            by = np.argsort(p_key, kind="stable")
            p_row, p_key = p_row[by], p_key[by]
            low = np.searchsorted(p_key, all_s_key)
            times = np.searchsorted(p_key, all_s_key, "right") - low
            low, s_row, times = low[times > 0], all_s_row[times > 0], times[times > 0]
            found = []
            for part in np.split(np.arange(len(times)), np.searchsorted(np.cumsum(times), np.arange(MEETINGS, times.sum(), MEETINGS))):
                t = times[part]
                at = np.repeat(low[part] - np.append(0, np.cumsum(t)[:-1]), t) + np.arange(t.sum())
                found.append(np.unique(p_row[at] * len(ids) + np.repeat(s_row[part], t), return_counts=True))
            pairs, number = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True)
            c = np.bincount(number, weights=np.concatenate([x for _, x in found]), minlength=len(pairs)).astype(np.int64)
            a, b = pairs // max(1, len(ids)), pairs % max(1, len(ids))
            fit = (ids[a] != ids[b]) & (comp[a] != comp[b]) & ~(asked[b] & (ids[b] < ids[a]))
            fit &= (n[a] * 100 >= percent * n[b]) & (percent * n[a] <= 100 * n[b])
            fit &= (sizes[a] + sizes[b] - 2 * c) * (100 + percent) <= (100 - percent) * (n[a] + n[b])
            a, b, c = a[fit], b[fit], c[fit]
            fit = alike(sketches, n, a, b, percent)
            yield pa.RecordBatch.from_arrays([pa.array(x[fit]) for x in (ids[a], ids[b], n[a], n[b], c)], names_)

    def run(batches: Iterator) -> Iterator:
        held, size, number = [], 0, 0
        for _, rows in grouped(batches, 4):
            tokens = rows.column("tokens").combine_chunks()
            flat = tokens.flatten().to_numpy()
            sizes = np.diff(tokens.offsets.to_numpy())
            if size and size + len(flat) > CHUNK_GRAMS:
                yield from counted(held)
                held, size = [], 0
            held.append((np.full(len(sizes), number), *(rows.column(x).to_numpy() for x in ("pivot", "id", "comp", "n")), rows.column("sketch").to_pylist(), sizes, flat))
            size += len(flat)
            number += 1
        if held:
            yield from counted(held)

    keys = ["cluster", "block", "pivots", "fragment"]
    dealt = rows.select(*keys, "pivot", "id", "comp", "n", "sketch", "tokens").repartition(*keys).sortWithinPartitions(*keys, "pivot", "id")
    return dealt.mapInArrow(run, "u long, v long, n_u long, n_v long, c long")


def chosen(asks: DataFrame, most: int) -> DataFrame:
    """id, cluster, blocks, comp and pivots (a block of PIVOT_GRAMS n-grams) of the `most` first sets of each cluster.

    The first of each of SALTS parts come first, so no task ranks a whole cluster.
    """
    by_hash = (F.xxhash64("id"), F.col("id"))
    parts = asks.withColumn("salt", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(SALTS)))
    firsts = parts.withColumn("place", F.row_number().over(Window.partitionBy("cluster", "salt").orderBy(*by_hash))).filter(F.col("place") <= most)
    order = Window.partitionBy("cluster").orderBy(*by_hash)
    ranked = firsts.withColumns({"place": F.row_number().over(order), "grams": F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1))})
    block = F.floor(F.coalesce("grams", F.lit(0)) / PIVOT_GRAMS).cast("int")
    return ranked.filter(F.col("place") <= most).select("id", "cluster", "blocks", "comp", block.alias("pivots"))


def cluster_links(sets: DataFrame, clusters: DataFrame, percent: int) -> DataFrame:
    """id, root of the ids that are linked with others, from rows id, n, fragment, tokens and the cluster of each id."""
    sized = clusters.join(sets.filter("fragment = 0").select("id", "n"), "id")
    # A cluster's blocks hold about BLOCK_GRAMS n-grams each.
    held = sized.groupBy("cluster").agg(F.ceil(F.sum("n") / BLOCK_GRAMS).cast("int").alias("blocks"))
    state = sized.join(held, "cluster").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    state = common.saved(state.select("id", "n", "cluster", "block", "blocks", F.col("id").alias("comp"), F.lit(False).alias("done")), "state")
    most = PIVOTS
    while True:
        counts = state.groupBy("cluster", "comp").agg(F.count(F.lit(1)).alias("m"))
        largest = counts.groupBy("cluster").agg(F.max_by("comp", F.struct("m", "comp")).alias("main"))
        asks = state.filter("NOT done").join(largest, "cluster").filter("comp <> main")
        pivots = common.saved(chosen(asks, most), "pivots")
        if pivots.limit(1).count() == 0:
            common.drop(pivots)
            break
        groups = pivots.groupBy("cluster").agg(F.max("pivots").alias("last"))
        every = F.explode(F.sequence(F.lit(0), F.col("last"))).alias("pivots")
        open_ = state.join(groups, "cluster").select("id", "cluster", "block", "comp", every)
        own = sets.join(open_, "id").withColumn("pivot", F.lit(0))
        asked = sets.join(pivots, "id").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("pivot", F.lit(1))
        needed = ["cluster", "block", "pivots", "fragment", "pivot", "id", "comp", "n", "sketch", "tokens"]
        sums = partial_overlaps(own.select(needed).unionByName(asked.select(needed)), percent).groupBy("u", "v", "n_u", "n_v").agg(F.sum("c").alias("c"))
        links = common.saved(sums.filter(F.col("c") * 100 >= (F.col("n_u") + F.col("n_v") - F.col("c")) * percent).select("u", "v"), "links")
        named = state.select("id", "comp")
        joined = links.join(named.withColumnsRenamed({"id": "u", "comp": "cu"}), "u").join(named.withColumnsRenamed({"id": "v", "comp": "cv"}), "v")
        moved = components(joined.select(F.col("cu").alias("u"), F.col("cv").alias("v"))).withColumnsRenamed({"id": "comp", "root": "to"})
        after = state.join(moved, "comp", "left").join(pivots.select("id", F.lit(True).alias("now")), "id", "left")
        after = after.select("id", "n", "cluster", "block", "blocks", F.coalesce("to", "comp").alias("comp"), (F.col("done") | F.coalesce("now", F.lit(False))).alias("done"))
        after = common.saved(after, "state")
        common.drop(state, pivots, links)
        state, most = after, min(MOST_PIVOTS, most * GROWTH)
    return state.filter("comp <> id").select("id", F.col("comp").alias("root"))


def _sorted_tokens(tokens: list):
    import numpy as np

    return np.sort(np.array(tokens, np.int64).view(np.uint64))


def link(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (null ids: null)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    found = common.saved(names(docs, words), "names")
    often = found.filter("kind = 1").groupBy("s1").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "s1").limit(MOST_HOT)
    hot = _sorted_tokens([r[0] for r in often.select("s1").collect()])  # MOST_HOT numbers at most
    found = found.filter("kind = 0")
    named = found.filter("n > 0 AND doc_id IS NOT NULL")
    classes = common.saved(named.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep")), "classes")
    copies = named.join(classes, ["n", "s1", "s2"]).filter("doc_id <> rep").select("doc_id")
    # Ids of several rows stand for their smallest text.
    again = common.saved(named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("doc_id"), "again")
    aside = common.saved(copies.unionByName(again).distinct(), "aside")
    smallest = docs.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    single = common.not_among(docs.filter("doc_id IS NOT NULL"), aside, "doc_id").unionByName(smallest)

    once = named.join(again, "doc_id", "left_anti").unionByName(names(smallest, words).filter("kind = 0 AND n > 0"))
    sketches = once.select(F.col("doc_id").alias("id"), "n", "sketch")
    clusters = clusters_of(key_rows(single, words, percent, hot), sketches, percent)
    texts = common.among(single.withColumnRenamed("doc_id", "id"), clusters.select("id"), "id")
    sets = common.saved(fragments(texts, words), "sets")
    links = cluster_links(sets, clusters, percent)

    roots = classes.join(links, classes["rep"] == links["id"], "left")
    roots = common.saved(roots.select("n", "s1", "s2", F.coalesce("root", "rep").alias("component_id")), "roots")
    common.drop(sets)
    whole = found.filter("n > 0").select("doc_id", "n", "s1", "s2").join(roots, ["n", "s1", "s2"], "left")
    whole = whole.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
    return whole.unionByName(found.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
