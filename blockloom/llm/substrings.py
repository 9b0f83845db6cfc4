"""Removal of repeated 100-byte substrings with two-stage suffix sorting.

A byte goes if a string of LENGTH bytes that covers it also starts earlier (in a smaller doc_id, or before in the same
document). Suffix arrays of a whole corpus don't fit a task, so equal strings are first brought together:

1. The smallest hash among the GRAM-byte grams of a LENGTH-byte window depends on the window alone. Successive windows
   with the same smallest hash are a segment, so equal windows lie in segments of equal hashes. Segments (one for each
   35 bytes or so, PIECE windows at most) are dealt over the cluster by hash; a hash that only one segment has is settled.
   A task that sees a hash again and again deals it by the segment instead: that it is repeated is known then.
2. The bytes of all other segments, those of exact copies too, meet by hash in groups of a bounded size. Segments of a
   group with equal bytes are one piece. Each block of pieces gets a suffix array: suffixes smaller than their successors are sorted
   directly, the others are induced by scanning the buckets, and the common prefixes of neighbours tell which windows are
   equal. The windows that start first stay, the others are repeats.
3. Where a hash has more than GROUP segments, its groups' first windows meet again in the same way, under finer names (the
   hash and what lies around the gram), until each name has one group. Each turn leaves one of equal windows per group.

Hashes only say where bytes meet. Matches are judged on the input, so the order of removals does not matter.

Cases: a null text has no bytes; an id's repeated rows are one document; of an id's different texts only the smallest is
compared and cut, the others stay whole, as do rows with a null id; very long texts are cut into segments like others, and runs of one character or of a short
period into pieces of PIECE windows, most of which have equal bytes; of equal strings the first in (doc_id, start) order
stays; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

LENGTH, GRAM = 100, 32
#: Bytes of a block that is sorted at once; most segments of one hash in a group; most windows of a segment.
BLOCK_BYTES, GROUP, PIECE = 512 * 1024, 3000, 4096
#: Times that a batch has a hash to deal it by segment from then on; most hashes that a task remembers.
OFTEN, REMEMBERED = 4, 1 << 18
#: Widths, in windows, of what shares a name in later turns.
WIDTHS = (8, 1)
ROWS = 512


def gram_hashes(data):
    """A hash of the GRAM bytes from each position on."""
    import numpy as np

    from .shingles import mix

    h, step = mix(np.arange(256, dtype=np.uint64) + np.uint64(99), 1)[data], 1
    for k in range(GRAM.bit_length() - 1):
        h = h[:-step] * np.uint64(0x9E3779B97F4A7C15 + 2 * k) + h[step:]
        h ^= h >> np.uint64(29)
        step *= 2
    h = h * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(32)
    return h


def segments(raw: bytes):
    """(smallest hash, start, windows) of each segment; windows is negative where the hash occurs again inside."""
    import numpy as np

    if len(raw) < LENGTH:
        return None
    h = gram_hashes(np.frombuffer(raw, np.uint8))
    wide = LENGTH - GRAM + 1

    def sliding(x, pick):
        span = 1
        while span * 2 <= wide:
            x = pick(x[:-span], x[span:])
            span *= 2
        return x if span == wide else pick(x[: len(x) - (wide - span)], x[wide - span :])

    low = sliding(h, np.minimum)
    start = np.concatenate([[0], np.flatnonzero(low[1:] != low[:-1]) + 1])
    windows = np.diff(np.append(start, len(low)))
    # Grams that are the smallest of some window: the greatest minimum of the windows around them is their own hash.
    around = np.concatenate([np.zeros(wide - 1, np.uint64), low, np.zeros(wide - 1, np.uint64)])
    chosen = np.flatnonzero(sliding(around, np.maximum) == h)
    again = h[chosen[1:]][h[chosen[1:]] == h[chosen[:-1]]]
    parts = -(-windows // PIECE)
    if parts.max() > 1:
        at = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        windows = np.minimum(np.repeat(windows, parts) - at * PIECE, PIECE)
        start = np.repeat(start, parts) + at * PIECE
    value = low[start]
    flagged = np.isin(value, again) if len(again) else np.zeros(len(value), bool)
    return value.view(np.int64), start.astype(np.int32), np.where(flagged, -windows, windows).astype(np.int32)


def segment_rows(docs: DataFrame) -> DataFrame:
    """h, s, n, doc, known, deal of every segment of rows doc, text. known: h is known to be repeated; deal: where to meet."""
    import numpy as np
    import pyarrow as pa

    from .shingles import mix

    def run(batches: Iterator) -> Iterator:
        seen = np.zeros(0, np.int64)  # hashes that this task deals by segment
        for batch in common.pieces(batches):
            parts = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if (found := segments((text.as_py() or "").encode("utf-8", "surrogatepass"))) is not None:
                    parts.append((*found, np.full(len(found[0]), doc, np.int64)))
            if not parts:
                continue
            h, s, n, doc = (np.concatenate(x) for x in zip(*parts, strict=True))
            value, head, number, counts = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            first = np.zeros(len(h), bool)
            first[head] = True
            old = np.isin(value, seen)
            # One row at least of each hash and task meets those of other tasks by the hash.
            known = (n < 0) | (counts > 1)[number] | old[number]
            spread = (~first | old[number]) & known
            deal = np.where(spread, (mix(doc.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + s.astype(np.uint64), 1)).view(np.int64), h)
            if len(seen) < REMEMBERED:
                seen = np.union1d(seen, value[counts >= OFTEN])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h, s, n, doc, known, deal)], ["h", "s", "n", "doc", "known", "deal"])

    return docs.select("doc", "text").mapInArrow(run, "h long, s int, n int, doc long, known boolean, deal long")


def meeting(rows: DataFrame) -> DataFrame:
    """h, doc, s, n of the segments whose hash another one has, or that have it twice inside."""
    import numpy as np
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        held = None  # the last row; it is known to be repeated if it has a neighbour of its hash
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            if held is not None:
                columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
            same = columns[0][1:] == columns[0][:-1]
            columns[4] = columns[4] | np.append(False, same) | np.append(same, False)
            held, rest = [x[-1:] for x in columns], [x[:-1][columns[4][:-1]] for x in columns[:4]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in rest], names)
        if held is not None and held[4][0]:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[:4]], names)

    names = ["h", "doc", "s", "n"]
    dealt = rows.repartition("deal").select("h", "doc", "s", "n", "known").sortWithinPartitions("h", "doc", "s")
    return dealt.mapInArrow(run, "h long, doc long, s int, n int")


def suffix_order(data, wanted):
    """Positions that wanted marks (and those they are induced from), in the order of their first LENGTH bytes.

    data: bytes as uint8, followed by LENGTH + 8 zeros that are not part of the text.
    """
    import numpy as np

    n = len(data) - LENGTH - 8
    # A suffix is smaller than its successor if the first byte that differs from the next is smaller.
    rises = np.append(data[: n - 1] < data[1:n], False)
    falls = np.append(data[: n - 1] > data[1:n], True)
    at = np.where(rises | falls, np.arange(n), n)
    following = np.minimum.accumulate(at[::-1])[::-1]
    small = rises[following]
    # The first position whose byte differs from the one here.
    run_end = np.append(following + 1, n)
    place = np.flatnonzero(wanted[:n])
    # The next smaller-than-successor suffix after each wanted one, and all between, are what it is induced from.
    small_after = np.minimum.accumulate(np.where(small, np.arange(n), n)[::-1])[::-1]
    reach = np.zeros(n + 1, np.int32)
    np.add.at(reach, place, 1)
    np.add.at(reach, np.minimum(small_after[place] + 1, n), -1)
    needed = np.cumsum(reach[:n]) > 0
    direct, induced = np.flatnonzero(needed & small), np.flatnonzero(needed & ~small)

    packed = packed_words(data)
    rank = np.zeros(len(direct), np.int64)
    order = np.arange(len(direct))
    active = np.arange(len(direct))
    for k in range(0, LENGTH + 4, 8):
        if not len(active):
            break
        # active: places in the order whose prefixes so far are shared with a neighbour
        rows = order[active]
        word, tie = packed[direct[rows] + k], rank[active]
        by = np.lexsort((word, tie))
        rows, word, tie = rows[by], word[by], tie[by]
        order[active] = rows
        fresh = np.append(True, (tie[1:] != tie[:-1]) | (word[1:] != word[:-1]))
        rank[active] = active[np.maximum.accumulate(np.where(fresh, np.arange(len(active)), 0))]
        alone = fresh & np.append(fresh[1:], True)
        active = active[~alone]
    direct = direct[order]

    out, spot, filled = [], np.full(n + 1, -1, np.int64), 0
    first_direct, first_induced = data[direct], data[induced]
    cut_direct = np.searchsorted(first_direct, np.arange(257))
    by_bucket = np.argsort(first_induced, kind="stable")
    cut_induced = np.searchsorted(first_induced[by_bucket], np.arange(257))
    for c in range(256):
        todo = induced[by_bucket[cut_induced[c] : cut_induced[c + 1]]]
        if len(todo):
            # c**k x with x below c: the fewer c the smaller, then by the place of x, which is known.
            end = run_end[todo]
            now = todo[np.lexsort((spot[end], end - todo))]
            spot[now] = filled + np.arange(len(now))
            filled += len(now)
            out.append(now)
        now = direct[cut_direct[c] : cut_direct[c + 1]]
        spot[now] = filled + np.arange(len(now))
        filled += len(now)
        out.append(now)
    found = np.concatenate(out) if out else np.zeros(0, np.int64)
    return found[wanted[found]], packed


def packed_words(data):
    """The eight bytes from each position on, as one big-endian number."""
    import numpy as np

    n = len(data) - 8
    packed = np.zeros(n, np.uint64)
    for j in range(8):
        packed = (packed << np.uint64(8)) | data[j : n + j]
    return packed


def common_prefixes(order, packed):
    """The length of the common prefix of each position in the order and the one before, LENGTH at most; 0 for the first."""
    import numpy as np

    found = np.zeros(len(order), np.int64)
    open_ = np.arange(1, len(order))
    for k in range(0, LENGTH, 8):
        if not len(open_):
            break
        differ = packed[order[open_] + k] ^ packed[order[open_ - 1] + k]
        same = differ == 0
        high = differ[~same]
        equal = np.zeros(len(high), np.int64)  # leading bytes that are equal
        for byte in range(1, 8):
            equal += high < (np.uint64(1) << np.uint64(64 - 8 * byte))
        found[open_[~same]] = np.minimum(LENGTH, k + equal)
        open_ = open_[same]
    found[open_] = LENGTH
    return found


def window_classes(pieces: list[bytes], counts):
    """Windows of the pieces in suffix order: piece, offset and class (equal windows)."""
    import numpy as np

    sizes = np.array([len(p) + 1 for p in pieces])
    starts = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"\0".join(pieces) + b"\0" * (LENGTH + 9), np.uint8)
    wanted = np.zeros(len(data), bool)
    piece = np.repeat(np.arange(len(pieces)), counts)
    offset = np.arange(len(piece)) - np.repeat(np.cumsum(counts) - counts, counts)
    wanted[starts[piece] + offset] = True
    order, packed = suffix_order(data, wanted)
    own = np.searchsorted(starts, order, "right") - 1
    return own, order - starts[own], np.cumsum(common_prefixes(order, packed) < LENGTH) - 1


def successive(piece, offset, *same):
    """Start and length of each run of successive offsets of a piece (with equal values of same)."""
    import numpy as np

    if not len(piece):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = (piece[1:] != piece[:-1]) | (offset[1:] != offset[:-1] + 1)
    for x in same:
        new |= x[1:] != x[:-1]
    begin = np.flatnonzero(np.append(True, new))
    return begin, np.diff(np.append(begin, len(piece)))


def finer_names(raw: bytes, h: int, offsets, width: int):
    """(gram position, name) of windows of a piece: windows share a name if the bytes that they have in common with all
    windows as far from the gram (in steps of width) are equal."""
    import numpy as np

    from .shingles import mix

    data = np.frombuffer(raw + b"\0" * 8, np.uint8)
    grams = np.flatnonzero(gram_hashes(data[:-8]).view(np.int64) == h)
    gram = grams[np.searchsorted(grams, offsets)]
    step = (gram - offsets) // width
    packed, at, length = packed_words(data), gram - step * width, LENGTH - width + 1
    name = np.full(len(at), np.int64(h)).view(np.uint64) ^ mix(step.astype(np.uint64) + np.uint64(width << 32), 1)
    for k in [*range(0, length - 7, 8), length - 8]:
        name = mix(name, 0) ^ packed[at + k]
    return gram, mix(name, 2).view(np.int64)


def compare(rows: DataFrame, width: int) -> DataFrame:
    """Of rows name, part, parts, h, doc, s, n, bytes: kind 0, runs of windows (doc, s, n) that start earlier elsewhere in
    the part; and where a name has several parts kind 1, its first windows as rows for the next turn."""
    import numpy as np
    import pyarrow as pa

    names = ["kind", "name", "h", "doc", "s", "n", "bytes"]

    def block(held: list) -> Iterator:
        group, parts, h, doc, s, n = (np.concatenate([x[i] for x in held]) for i in range(6))
        raw = [r for x in held for r in x[6]]
        index: dict = {}
        number = np.array([index.setdefault(r, len(index)) for r in raw])
        order = np.lexsort((s, doc, number))
        head = np.append(True, number[order][1:] != number[order][:-1])
        first = order[head][np.cumsum(head) - 1]  # of each row in order, the first one with its bytes
        again = (doc[order] != doc[first]) | (s[order] != s[first])
        later, first = order[again], order[head]
        yield removed(doc[later], s[later], np.abs(n[later]))
        # Windows of one piece are all different, unless its gram is in it twice.
        kinds = np.bincount(group[first], minlength=group.max() + 1)
        sort = first[(kinds[group[first]] > 1) | (n[first] < 0) | (parts[first] > 1)]
        if not len(sort):
            return
        sort = sort[np.lexsort((s[sort], doc[sort]))]
        doc, s, h, parts, raw = doc[sort], s[sort], h[sort], parts[sort], [raw[i] for i in sort]
        own, offset, same = window_classes(raw, np.abs(n[sort]))
        key = (own << 32) + offset
        heads = np.flatnonzero(np.append(True, same[1:] != same[:-1]))
        # A window is a repeat if an equal one has a smaller (doc, start); pieces of one document may overlap.
        spot = np.lexsort((s[own] + offset, doc[own]))
        place = np.empty(len(key), np.int64)
        place[spot] = np.cumsum(np.append(True, (np.diff(doc[own][spot]) != 0) | (np.diff((s[own] + offset)[spot]) != 0)))
        repeat = place != np.repeat(np.minimum.reduceat(place, heads), np.diff(np.append(heads, len(key))))
        by = np.argsort(key[repeat], kind="stable")
        piece, off = own[repeat][by], offset[repeat][by]
        begin, length = successive(piece, off)
        yield removed(doc[piece[begin]], s[piece[begin]] + off[begin], length)
        left = np.flatnonzero(~repeat & (parts[own] > 1))
        left = left[np.argsort(key[left], kind="stable")]
        cuts = np.flatnonzero(np.diff(own[left])) + 1
        for some in np.split(left, cuts):
            if not len(some):
                continue
            i = own[some[0]]
            gram, name = finer_names(raw[i], int(h[i]), offset[some], width)
            begin, length = successive(own[some], offset[some], gram, name)
            at = offset[some][begin]
            columns = [
                np.ones(len(at), np.int32), name[begin], np.full(len(at), h[i]), np.full(len(at), doc[i]), (s[i] + at).astype(np.int32), length.astype(np.int32),
            ]
            cut = [raw[i][a : a + m + LENGTH - 1] for a, m in zip(at.tolist(), length.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(cut, pa.binary())], names)

    def removed(doc, s, n) -> pa.RecordBatch:
        none = pa.nulls(len(doc))
        columns = [pa.array(np.zeros(len(doc), np.int32)), none.cast(pa.int64()), none.cast(pa.int64()), pa.array(doc), pa.array(s.astype(np.int32)), pa.array(n.astype(np.int32))]
        return pa.RecordBatch.from_arrays([*columns, none.cast(pa.binary())], names)

    def run(batches: Iterator) -> Iterator:
        held, size, number, now = [], 0, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            name, part, parts, h, doc, s, n = (batch.column(i).to_numpy() for i in range(7))
            raw = batch.column(7).to_pylist()
            lengths = np.array([len(x) for x in raw])
            starts = np.flatnonzero(np.append(True, (name[1:] != name[:-1]) | (part[1:] != part[:-1])))
            group = np.cumsum(np.bincount(starts, minlength=len(name)))
            if now == (name[0], part[0]):
                group -= 1  # it goes on from the batch before
            group += number
            done, total = 0, np.append(0, np.cumsum(lengths))
            # A block ends with a group, once it has BLOCK_BYTES.
            for a in starts.tolist():
                if size + total[a] - total[done] >= BLOCK_BYTES and (a > 0 or now != (name[0], part[0])):
                    if a > done:
                        held.append(tuple(x[done:a] for x in (group, parts, h, doc, s, n, raw)))
                    yield from relabelled(held)
                    held, size, done = [], 0, a
            held.append(tuple(x[done:] for x in (group, parts, h, doc, s, n, raw)))
            size += int(total[-1] - total[done])
            number, now = int(group[-1]), (name[-1], part[-1])
        if held:
            yield from relabelled(held)

    def relabelled(held: list) -> Iterator:
        least = held[0][0][0]
        yield from block([(x[0] - least, *x[1:]) for x in held])

    dealt = rows.select("name", "part", "parts", "h", "doc", "s", "n", "bytes").repartition("name", "part").sortWithinPartitions("name", "part", "doc", "s")
    return dealt.mapInArrow(run, "kind int, name long, h long, doc long, s int, n int, bytes binary")


def in_parts(rows: DataFrame, most: DataFrame) -> DataFrame:
    """rows with part and parts: names of more than GROUP segments, or of too many bytes (most: name, parts), are split."""
    rows = rows.join(most, "name", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    return rows.withColumn("part", F.pmod(F.xxhash64("doc", "s"), F.col("parts")).cast("int"))


def split_names(rows: DataFrame) -> DataFrame:
    """name, parts of the names that need more than one part, of rows name, n."""
    sums = rows.groupBy("name").agg(F.count(F.lit(1)).alias("m"), F.sum(F.abs("n") + LENGTH).alias("size"))
    parts = F.ceil(F.greatest(F.col("m") / GROUP, F.col("size") / (2 * BLOCK_BYTES))).cast("int")
    return common.saved(sums.select("name", parts.alias("parts")).filter("parts > 1"), "split")


def repeated(docs: DataFrame) -> DataFrame:
    """doc, s, e: byte ranges to remove, of rows doc, text."""
    spark = docs.sparkSession
    common.small_batches(spark, ROWS)
    found = common.saved(meeting(segment_rows(docs)).withColumnRenamed("h", "name"), "segments")
    edges = in_parts(found, split_names(found))
    per_doc = edges.groupBy("doc").agg(F.collect_list(F.struct("name", "part", "parts", "s", "n")).alias("edges"))
    located = per_doc.join(docs, "doc").select("doc", "edges", F.col("text").cast("binary").alias("raw"))
    # Written, so that the shuffle files of the join are gone before the bytes are dealt.
    located = common.saved(located, "located")
    common.drop(found)
    cut = located.select("doc", "raw", F.explode("edges").alias("x"))
    rows = cut.select("x.name", "x.part", "x.parts", F.col("x.name").alias("h"), "doc", "x.s", "x.n", F.expr("substring(raw, x.s + 1, abs(x.n) + 99)").alias("bytes"))
    ranges, turn = None, 0
    while True:
        windows = common.saved(compare(rows, WIDTHS[min(turn, len(WIDTHS) - 1)]), "windows")
        gone = windows.filter("kind = 0").select("doc", "s", (F.col("s") + F.col("n") + LENGTH - 1).alias("e"))
        ranges = gone if ranges is None else ranges.unionByName(gone)
        if turn == 0:
            common.drop(located)
        first = windows.filter("kind = 1")
        if first.limit(1).count() == 0:
            return ranges
        rows, turn = in_parts(first, split_names(first)), turn + 1


def cut_rows(docs: DataFrame) -> DataFrame:
    """n_removed, n_spans, kept of rows with text and ranges (array of s, e)."""
    import numpy as np
    import pyarrow as pa

    def run(batch) -> list:
        removed, spans, kept = [], [], []
        columns = [batch.column(batch.schema.get_field_index(x)) for x in ("text", "ranges")]
        for text, ranges in zip(*columns, strict=True):
            raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
            if not ranges.is_valid or not len(ranges.values):
                removed.append(0)
                spans.append(0)
                kept.append(raw)
                continue
            s = ranges.values.field(0).to_numpy()
            e = np.minimum(ranges.values.field(1).to_numpy(), len(raw))
            by = np.argsort(s, kind="stable")
            s, e = s[by], np.maximum.accumulate(e[by])
            new = np.append(True, s[1:] > e[:-1])
            begin, end = s[new], e[np.append(np.flatnonzero(new)[1:] - 1, len(e) - 1)]
            removed.append(int((end - begin).sum()))
            spans.append(len(begin))
            ends = [0, *end.tolist()]
            kept.append(b"".join(raw[a:b] for a, b in zip(ends, [*begin.tolist(), len(raw)], strict=True)))
        return [pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())]

    fields = [T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept", T.BinaryType())]
    return common.map_batches(docs, run, fields, ["doc_id", "n_bytes"], rows=ROWS)


def smallest_texts(named: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The rows whose text is the smallest of their id, and the others, if there are any ids of several rows."""
    again = common.saved(named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("doc_id"), "again")
    if again.isEmpty():
        return named, []
    several = named.join(again, "doc_id", "left_semi")
    several = several.join(several.groupBy("doc_id").agg(F.min("text").alias("least")), "doc_id")
    once = named.join(again, "doc_id", "left_anti")
    return once.unionByName(several.filter("text = least").drop("least")), [several.filter("text <> least").drop("least")]


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes)."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    base = base.withColumn("n_bytes", F.octet_length("text").cast("long"))
    named, aside = smallest_texts(base.filter("doc_id IS NOT NULL"))
    long = named.filter(F.col("n_bytes") >= LENGTH)
    found = repeated(long.select(F.col("doc_id").alias("doc"), "text"))
    ranges = common.saved(found.groupBy("doc").agg(F.collect_list(F.struct("s", "e")).alias("ranges")), "ranges")
    whole = named.join(ranges, F.col("doc_id") == F.col("doc"), "left").select("doc_id", "text", "n_bytes", "ranges")
    none = F.lit(None).cast("array<struct<s:int,e:int>>")
    for left in [base.filter("doc_id IS NULL"), *aside]:
        whole = whole.unionByName(left.select("doc_id", "text", "n_bytes", none.alias("ranges")))
    return cut_rows(whole)


def digests(cut: DataFrame) -> DataFrame:
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
