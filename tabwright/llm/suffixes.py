"""Exact substring dedup by a hash-compared suffix sort.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a
document of a smaller id. Sorting every suffix of the corpus would move each byte
many times over, so the sort works on what two documents can share:

1. Every window of LENGTH bytes is owned by the smallest ``GRAM``-byte hash in it
   (the leftmost of equal ones): an anchor. Equal windows have equal anchors, and
   an anchor owns a stretch of about eighteen adjoining windows. One row for each
   anchor goes to the shuffle, with the hash of its stretch.
2. Anchors are dealt by their hash. Those that a sample of documents shows in one
   document of a hundred or more are spread by stretch and document besides, so no
   common passage is a hot task. A stretch that a smaller id has too is covered as
   a whole.
3. What is left of anchors that several documents have are the edges of shared
   passages. Their stretches go by (anchor, id) to tasks that sort the suffixes
   in them: by eight bytes at a time, where a binary search over prefix hashes
   finds how far the suffixes of a run agree and the next eight bytes after that
   part them. Neighbours that agree over LENGTH bytes, which is then verified on
   the bytes, are equal windows.
4. In a group of one anchor that a partition's edge cuts, windows are settled
   among the task's own documents first; the first document of each different
   window goes on as one row, to be compared between tasks. Large groups are
   sorted by the bytes on one side of the anchor, the side that differs more: a
   window is in another task too only if that side of it is that of the group's
   row at the partition's edge, so the others stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.llm.common import dropped, only, parts_for, publish, table
from tabwright.llm.minhash import grouped
from tabwright.llm.rolling import PrefixHash, mix, raw_bytes

LENGTH = 50
GRAM = 16
#: Parts of a shuffle partition; one at a time is in memory.
PARTS = 8
#: Documents whose anchors show which are common, and pieces that a common stretch is cut into.
SAMPLE = 2000
SALTS = 8
#: Groups of more than such a part of a partition's rows are sorted by what is beside their anchor.
LARGE = 32


def _slide(x: np.ndarray, width: int, best) -> np.ndarray:
    """best over every window of so many values, by doubling."""
    done, y = 1, x
    while 2 * done <= width:
        y = best(y[:-done], y[done:])
        done *= 2
    n = len(x) - width + 1
    return best(y[:n], y[width - done : width - done + n]) if done < width else y


def stretches(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, first window, last window, stretch hash) of a text's anchors."""
    return _stretches(data, length, gram)[:4]


def _stretches(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """stretches(), and how many bytes of each stand before its anchor."""
    n = len(data)
    table_ = PrefixHash(data)
    at = np.arange(n - gram + 1)
    h = table_.of(at, at + gram)
    grams = length - gram + 1
    least = _slide(h, grams, np.minimum)
    # An anchor is the least of some window: the greatest of the minima over it.
    edge = np.zeros(grams - 1, np.uint64)
    anchors = np.flatnonzero(_slide(np.concatenate([edge, least, edge]), grams, np.maximum) == h)
    # The owner stays the same between a change of the minimum and the pass of an anchor.
    change = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1, anchors + 1])
    begin = np.unique(change[change < len(least)])
    owner = np.searchsorted(anchors, begin)
    value = least[begin]
    while len(wrong := np.flatnonzero(h[anchors[owner]] != value)):
        owner[wrong] += 1
    starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    first = begin[starts]
    last = np.append(first[1:], len(least)) - 1
    anchor = anchors[owner[starts]]
    lead = anchor - first
    stretch = table_.of(first, last + length) ^ mix(lead.astype(np.uint64))
    return h[anchor], first, last, stretch, lead


def _rows(docs: DataFrame, length: int, gram: int, parts: int, hot: list[int]) -> DataFrame:
    """(part, h, c, doc_id, v, place): one row for each anchor; place is (first * grams + more) * grams + lead, grams a window's."""
    common = np.array(sorted(hot), np.int64)
    grams = length - gram + 1

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dropped()
        for batch in batches:
            held: list[tuple] = []
            count = 0
            for doc_id, v, text in zip(batch.doc_id, batch.v, batch.text):
                data = raw_bytes(text)
                if len(data) < length:
                    continue
                h, first, last, stretch, lead = _stretches(data, length, gram)
                k = len(h)
                held.append((h, stretch, np.full(k, doc_id), np.full(k, v), (first * grams + last - first) * grams + lead))
                count += k
                if count > 100_000:
                    yield _dealt(held, parts, common)
                    held, count = [], 0
            if held:
                yield _dealt(held, parts, common)

    return docs.mapInPandas(find, "part int, h long, c long, doc_id long, v long, place long")


def _dealt(held: list[tuple], parts: int, common: np.ndarray) -> pd.DataFrame:
    """Rows with their part: by anchor, or from ``parts`` on by stretch and id."""
    h, c, doc, v, place = (np.concatenate(x) for x in zip(*held))
    part = (mix(h) % np.uint64(parts)).astype(np.int32)
    signed = h.view(np.int64)
    if len(common):
        spot = np.minimum(np.searchsorted(common, signed), len(common) - 1)
        often = common[spot] == signed
        salt = mix(doc[often].astype(np.uint64)) % np.uint64(SALTS)
        part[often] = (mix(c[often] + salt) % np.uint64(parts)).astype(np.int32) + np.int32(parts)
    return pd.DataFrame({"part": part, "h": signed, "c": c.view(np.int64), "doc_id": doc, "v": v, "place": place})


def _common_anchors(docs: DataFrame, length: int, gram: int) -> list[int]:
    """Anchors that a hundredth of a bounded sample of documents or more have.

    At most a hundred for each anchor of an average document. They only change
    how rows are dealt.
    """
    share = min(1.0, SAMPLE / max(docs.count(), 1))
    place = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    sample = docs.where(place < share)
    found = _rows(sample, length, gram, 1, []).select("h", "doc_id").distinct().groupBy("h").count()
    return [r["h"] for r in found.where(F.col("count") >= max(5, SAMPLE // 100)).select("h").collect()]


def whole_runs(batches: Iterator[pd.DataFrame], key: str) -> Iterator[tuple[pd.DataFrame, bool, bool]]:
    """Sorted batches cut so that no run of a key is parted; whether they hold the first, the last run."""
    held: list[pd.DataFrame] = []
    first = True
    for part in batches:
        if not len(part):
            continue
        x = part[key].to_numpy()
        others = np.flatnonzero(x != x[-1])
        at = int(others[-1]) + 1 if len(others) else 0
        if held and held[-1][key].iloc[-1] != x[0]:
            if at == 0:
                yield pd.concat(held, ignore_index=True), first, False
                held, first = [], False
        if at:
            yield pd.concat([*held, part.iloc[:at]], ignore_index=True), first, False
            held, first = [], False
        held.append(part.iloc[at:])
    if held:
        yield pd.concat(held, ignore_index=True), first, True


def _starts(*columns: np.ndarray) -> np.ndarray:
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    return new


def _classify(parts: int, grams: int):
    """Stretches that are covered, and those that must be compared; an anchor owns up to ``grams`` windows."""

    def classify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in grouped(batches, ["part"]):
            h, c, doc = rows.h.to_numpy(), rows.c.to_numpy(), rows.doc_id.to_numpy()
            order = np.lexsort((doc, c, h))
            h, c, doc = h[order], c[order], doc[order]
            new_h, new_c = _starts(h), _starts(h, c)
            begin_h = np.flatnonzero(new_h)
            several = (np.maximum.reduceat(doc, begin_h) > np.minimum.reduceat(doc, begin_h)) & (
                np.add.reduceat(new_c.astype(np.int64), begin_h) > 1
            )
            if rows.part.iloc[0] >= parts:
                several[:] = True  # others of these anchors are elsewhere
            covered = doc > doc[np.flatnonzero(new_c)][np.cumsum(new_c) - 1]
            keep = np.flatnonzero(covered | several[np.cumsum(new_h) - 1])
            (place, lead), v = divmod(rows.place.to_numpy()[order][keep], grams), rows.v.to_numpy()[order][keep]
            yield pd.DataFrame(
                {"h": h[keep], "doc_id": doc[keep], "v": v, "first": place // grams, "more": place % grams, "lead": lead, "covered": covered[keep]}
            )

    return classify


_STRETCH = "h long, doc_id long, v long, first int, lead int, data binary"


def _contexts(length: int):
    names = [c.split()[0] for c in _STRETCH.split(", ")]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            rows = []
            for doc_id, v, text, places in zip(part.doc_id, part.v, part.text, part.places):
                raw = text.encode("utf-8", "surrogatepass")
                for h, first, more, lead in places.reshape(-1, 4).tolist():
                    rows.append((h, doc_id, v, first, lead, raw[first : first + more + length]))
                if len(rows) > 50_000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    return cut


def common_extension(hashes: PrefixHash, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """How many bytes the suffixes at a and b agree in, up to most: binary search."""
    found = np.zeros(len(a), np.int64)
    step = 1 << (most.bit_length() - 1)
    while step:
        longer = found + step
        ok = longer <= most
        same = np.zeros(len(a), bool)
        same[ok] = hashes.of(a[ok] + found[ok], a[ok] + longer[ok]) == hashes.of(b[ok] + found[ok], b[ok] + longer[ok])
        found = np.where(same, longer, found)
        step >>= 1
    return found


def suffix_sort(data: np.ndarray, at: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes of data at ``at`` by their first ``most`` bytes.

    Also returns, for each but the first in that order, how many bytes it shares
    with the one before. Runs that agree are parted by the eight bytes after what
    all of a run share; a run that agrees in all ``most`` bytes is done.
    """
    padded = np.concatenate([data, np.zeros(most + 8, np.uint8)])
    hashes = PrefixHash(padded)
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    key = lambda where: np.ascontiguousarray(eight[where]).view(">u8")[:, 0]
    order = np.argsort(key(at), kind="stable")
    run = np.cumsum(_starts(key(at[order])))
    while True:
        same = np.flatnonzero(run[1:] == run[:-1])
        if not len(same):
            break
        shared = common_extension(hashes, at[order[same]], at[order[same + 1]], most)
        begins = np.flatnonzero(_starts(run[same]))
        run_depth = np.minimum.reduceat(shared, begins)
        open_ = run_depth < most
        if not open_.any():
            break
        to = dict(zip(run[same][begins][open_].tolist(), run_depth[open_].tolist()))
        rows = np.flatnonzero(np.isin(run, run[same][begins][open_]))
        ids = run[rows]
        uniq, inverse = np.unique(ids, return_inverse=True)
        depth = np.array([to[u] for u in uniq.tolist()])[inverse]
        next_key = key(at[order[rows]] + depth)
        by = np.lexsort((next_key, ids))
        order[rows] = order[rows][by]
        new = _starts(run)
        new[rows] |= _starts(ids, next_key[by])
        run = np.cumsum(new)
    shared = common_extension(hashes, at[order[:-1]], at[order[1:]], most) if len(at) > 1 else np.zeros(0, np.int64)
    return order, shared


def equal_windows(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows in suffix order and the run of equal ones that each is in.

    Runs that the hashes call equal are verified on their bytes.
    """
    order, shared = suffix_sort(data, at, length)
    same = shared >= length
    if same.any():
        window = np.lib.stride_tricks.sliding_window_view(data, length)
        rows = np.flatnonzero(same)
        for part in np.array_split(rows, max(1, len(rows) // 100_000)):
            same[part] = (window[at[order[part]]] == window[at[order[part + 1]]]).all(1)
    return order, np.cumsum(np.concatenate([[0], ~same]))


def _beside(edges: DataFrame, gram: int) -> DataFrame:
    """The stretches with (way, beside): in large groups, bytes from the anchor outwards, behind it or before it.

    ``way`` is 0 in other groups, else 1 for the bytes behind the anchor and 2 for those
    before it, whichever differ more; ``beside`` has two characters for a byte.
    """
    behind = F.expr(f"hex(substring(data, lead + {gram + 1}))")
    before = F.expr("reverse(hex(substring(data, 1, lead)))")
    limit = edges.count() // (LARGE * parts_for(edges.sparkSession))
    large = edges.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("h")
    ways = (
        edges.join(F.broadcast(large), "h")
        .groupBy("h")
        .agg(F.approx_count_distinct(behind).alias("behind"), F.approx_count_distinct(before).alias("before"))
        .select("h", F.when(F.col("behind") >= F.col("before"), 1).otherwise(2).alias("way"))
    )
    ways = publish(ways, "ways")  # at most LARGE for each partition
    way = F.coalesce("way", F.lit(0))
    beside = F.when(F.col("way") == 1, behind).when(F.col("way") == 2, before).otherwise("")
    return edges.join(F.broadcast(ways), "h", "left").withColumns({"way": way, "beside": beside})


def _compare(length: int, gram: int):
    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, is_first, is_last in whole_runs(batches, "h"):
            for group, cut in _portions(part, is_first, is_last):
                yield _settled(group, length, gram, cut)

    return compare


def _portions(part: pd.DataFrame, is_first: bool, is_last: bool, most: int = 20_000):
    """Whole runs of an anchor, a bounded number of rows where runs allow; their rows (0, -1) at a partition's edge, which may cut them."""
    h = part.h.to_numpy()
    begins = np.append(np.flatnonzero(_starts(h)), len(h))
    low, high = int(is_first), len(begins) - 1 - int(is_last)
    if is_first:
        yield part.iloc[: begins[1]], [0, -1] if is_last and len(begins) == 2 else [0]
    at = low
    while at < high:
        to = max(int(np.searchsorted(begins, begins[at] + most, "right")) - 1, at + 1)
        to = min(to, high)
        yield part.iloc[begins[at] : begins[to]], []
        at = to
    if is_last and len(begins) - 2 >= low:
        yield part.iloc[begins[-2] :], [-1]


def _laid_out(group: pd.DataFrame, length: int) -> tuple[np.ndarray, ...]:
    """Bytes of all stretches, and (place, row, offset) of every window in them."""
    sizes = group.data.str.len().to_numpy()
    data = np.frombuffer(b"".join(group.data), np.uint8)
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    counts = sizes - length + 1
    row = np.repeat(np.arange(len(group)), counts)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    return data, begins[row] + offset, row, offset


_FOUND = "h long, w long, doc_id long, v long, first int, last int"


def _agreed(beside: pd.Series, edge: str) -> np.ndarray:
    """How many bytes, of two characters each, the values share with one of them from the start on."""
    values = np.array([x.encode() for x in [edge, *beside]], dtype=np.bytes_)
    if not values.itemsize:
        return np.zeros(len(beside), np.int64)
    letters = values.view(np.uint8).reshape(len(values), -1)
    differ = np.pad(letters[1:] != letters[0], ((0, 0), (0, 1)), constant_values=True)
    return differ.argmax(1) // 2


def _elsewhere(group: pd.DataFrame, row: np.ndarray, offset: np.ndarray, length: int, gram: int, cut: list[int]) -> np.ndarray:
    """Whether windows of a cut group may be in other tasks: rows between equal ones agree with them as far as they reach."""
    way = group.way.iloc[0]
    if not way:
        return np.ones(len(row), bool)
    beside, lead = group.beside, group.lead.to_numpy()[row]
    shared = np.maximum.reduce([_agreed(beside, beside.iloc[k]) for k in cut])[row]
    return shared >= (offset + length - lead - gram if way == 1 else lead - offset)


def _settled(group: pd.DataFrame, length: int, gram: int, cut: list[int]) -> pd.DataFrame:
    """Covered bytes [first, last); of a group that may be cut, the first owner of each window that others may have too."""
    data, at, row, offset = _laid_out(group, length)
    h, doc = group.h.to_numpy()[row], group.doc_id.to_numpy()[row]
    whole = PrefixHash(data).of(at, at + length)
    # A window whose hash is alone equals no other: it stays out of the sort.
    _, inverse, times = np.unique(whole, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(times[inverse] > 1)
    gone = np.zeros(len(at), bool)
    if len(shared):
        order, run = equal_windows(data, at[shared], length)
        order = shared[order]
        # Equal windows have the same anchor: a run never mixes groups.
        least = np.minimum.reduceat(doc[order], np.flatnonzero(_starts(run)))
        gone[order] = doc[order] > least[run]
    spans = _merged_windows(group, row[gone], offset[gone], length)
    if not cut:
        return spans
    left = np.flatnonzero(~gone & _elsewhere(group, row, offset, length, gram, cut))
    first = group["first"].to_numpy()[row[left]] + offset[left]
    windows = pd.DataFrame(
        {"h": h[left], "w": whole[left].view(np.int64), "doc_id": doc[left], "v": group.v.to_numpy()[row[left]], "first": first, "last": first + length}
    )
    return pd.concat([spans, windows.astype({"h": "Int64", "w": "Int64"})], ignore_index=True)


def _merged_windows(group: pd.DataFrame, row: np.ndarray, offset: np.ndarray, length: int) -> pd.DataFrame:
    """Adjoining windows of a stretch as one range, without an anchor."""
    first = group["first"].to_numpy()[row] + offset
    begins = np.flatnonzero(_starts(row, first - np.arange(len(first))))
    ends = np.append(begins[1:], len(first))[: len(begins)] - 1
    none = pd.array([None] * len(begins), "Int64")
    return pd.DataFrame(
        {"h": none, "w": none, "doc_id": group.doc_id.to_numpy()[row[begins]], "v": group.v.to_numpy()[row[begins]], "first": first[begins], "last": first[ends] + length}
    )


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, v, first, last): byte ranges [first, last) that go, overlaps included.

    docs has (doc_id, v, text); v tells rows of one id apart. The ranges of one
    document are not merged and not in order.
    """
    spark = docs.sparkSession
    parts = parts_for(spark)
    rows = docs.where("doc_id is not null and text is not null")
    dealt = _rows(rows, length, gram, PARTS * parts, _common_anchors(rows, length, gram))
    dealt = dealt.repartition(parts, "part").sortWithinPartitions("part")
    kinds = "h long, doc_id long, v long, first int, more int, lead int, covered boolean"
    flagged = publish(dealt.mapInPandas(_classify(PARTS * parts, length - gram + 1), kinds), "anchors")
    places = (
        flagged.where("not covered")
        .groupBy("doc_id", "v")
        .agg(F.flatten(F.collect_list(F.array("h", *[F.col(c).cast("long") for c in ("first", "more", "lead")]))).alias("places"))
    )
    edges = publish(
        rows.join(places, ["doc_id", "v"]).mapInPandas(_contexts(length), _STRETCH),
        "stretches",
    )
    order = ["h", "beside", "doc_id"]
    sorted_ = _beside(edges, gram).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    found = publish(sorted_.mapInPandas(_compare(length, gram), _FOUND), "windows")
    cut = found.where("h is not null")
    owners = cut.groupBy("h", "w").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("top")).where("owner < top")
    across = cut.join(owners, ["h", "w"]).where("doc_id > owner")
    ranges = ["doc_id", "v", "first", "last"]
    whole = flagged.where("covered").withColumn("last", F.col("first") + F.col("more") + length)
    return whole.select(ranges).unionByName(found.where("h is null").select(ranges)).unionByName(across.select(ranges))


def merged(spans: np.ndarray) -> np.ndarray:
    """Ranges [first, last) as disjoint ones in order; touching ones are one."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    begins = np.flatnonzero(np.concatenate([[True], spans[1:, 0] > reach[:-1]]))
    return np.stack([spans[begins, 0], reach[np.append(begins[1:], len(spans)) - 1]], 1)


def _rest(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for texts, lists in batches:
        rows = []
        for text, spans in zip(texts, lists):
            raw = (text or "").encode("utf-8", "surrogatepass")
            runs = merged(spans.reshape(-1, 2)) if spans is not None else np.zeros((0, 2), np.int64)
            edges = [0, *runs.ravel().tolist(), len(raw)]
            kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
            rows.append((len(raw), len(raw) - len(kept), len(runs), kept))
        yield pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept"])


def without_repeats(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for every row of docs.

    ``kept`` is what is left of the text's UTF-8 bytes; null texts count as
    empty. Rows that repeat an id are one document: what only they share stays.
    Rows without an id lose nothing and take nothing from others. An empty table
    gives an empty result.
    """
    rows = only(docs, id_column, text_column).withColumn("v", F.crc32(F.coalesce("text", F.lit(""))))
    spans = repeated_spans(rows, length, gram)
    span = F.array(F.col("first").cast("long"), F.col("last").cast("long"))
    lists = spans.groupBy("doc_id", "v").agg(F.flatten(F.collect_list(span)).alias("spans"))
    rest = F.pandas_udf(_rest, "n_bytes long, n_removed long, n_spans long, kept binary")("text", "spans")
    return rows.join(lists, ["doc_id", "v"], "left").select("doc_id", rest.alias("r")).select("doc_id", "r.*")


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
