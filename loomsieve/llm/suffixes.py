"""Removal of long repeated byte strings by threshold-bounded interval expansion on a Burrows-Wheeler transform.

Two equal strings of ``length`` bytes have their least 64-byte hash (anchor) at the same place. So the strings of a text
are cut into segments that share an anchor, and only segments whose anchor occurs again anywhere can hold a repeat: this
leaves out text, never a match. Equal segments (128 bits of their bytes agree) are one with a weight. The kinds that share
an anchor meet in bounded bundles. Each bundle's transform is built, and common prefixes are derived by increasing value:
from the intervals of the prefixes of length l, backward extension by every preceding byte gives those of length l + 1 and
the boundaries between them, breadth first, up to the minimum length. Rows without a boundary between them by then share
at least that many bytes; where their weights add up to two or more, the string is repeated. Anchors with very many kinds, or
kinds of very many bytes, are dealt to several bundles, and what those leave unmatched is compared by window hash across bundles, so no group has
to fit one task and no match is lost.

Shorter strings (of ``PASSAGE`` bytes) are found beside the long ones by the same transform: they have anchors too, each
anchor of a long string is one of theirs, and the segment of a long string holds that of the short ones. So each anchor has
one segment, the wider, with the range in which short strings start; the expansion passes their length on its way.

Defined results: null texts count as empty; texts shorter than the length lose nothing; repeated rows count as copies of
each other; an empty table gives an empty table; other columns stay as they are, whatever their names. Long texts are
cut into overlapping blocks for the anchors, which changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsieve.llm.common import WORKER_CACHES, Scratch, documents, materialise, mix, trim, worker_serves

LENGTH = 400
#: Bytes of shorter repeated strings, which are counted and not removed: a passage of some fifty words.
PASSAGE = 200
#: Bytes of the strings whose hashes pick the anchors.
GRAM = 64
#: Bytes of the texts that are hashed together; of a bundle; distinct segments of an anchor in one bundle, and their bytes.
BLOCK, BUNDLE, CROWD, CROWD_BYTES = 1 << 21, 3 << 19, 20_000, 4 << 20

#: What tells segments of one content: their anchor's hash and 128 bits of their own.
KIND = ("anchor", "content", "check")

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, BLOCK + 4096)
        for name, base in (("up", _BASE), ("down", np.uint64(pow(int(_BASE), -1, 1 << 64)))):
            values = np.full(size, base, dtype=np.uint64)
            values[0] = 1
            _POWERS[name] = np.multiply.accumulate(values)
        WORKER_CACHES["suffixes"] = _POWERS.clear
    return _POWERS["up"][:n], _POWERS["down"][:n]


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values."""
    n = len(values)
    rows = -(-n // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = values
    square = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


#: A segment's shape in one number: where its short strings start, and how many short and long ones it has.
_FIELD = 21


def _shape(shape: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low = (1 << _FIELD) - 1
    return shape >> (2 * _FIELD), (shape >> _FIELD) & low, shape & low


def segments_of(parts: list[bytes], length: int, short: int = 0, most: int = BLOCK) -> dict[str, np.ndarray]:
    """Segments of byte strings: owner, anchor hash, identity (content, check), start, end in the owner, shape. Only strings
    that start in the owner's first ``most`` bytes count. With ``short``, strings of so many bytes count too."""
    short = short or length
    gram = min(GRAM, short)
    data = np.frombuffer(b"".join(parts), dtype=np.uint8)
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    begins = np.cumsum(sizes) - sizes
    n = len(data)
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    hashes = mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    keys = (hashes & ~np.uint64(0xFFFFFF)) | np.arange(len(hashes), dtype=np.uint64)

    def runs(width: int, least: np.ndarray) -> tuple[np.ndarray, ...]:
        """Strings of ``width`` bytes that share an anchor: owner, anchor, where the first and the last of them start."""
        counts = np.clip(sizes - width + 1, 0, most)
        if not counts.any():
            return (np.zeros(0, np.int64),) * 4
        opens = np.empty(len(least), bool)
        opens[0] = True
        np.not_equal(least[1:], least[:-1], out=opens[1:])
        opens[begins[begins < len(least)]] = True
        first = np.flatnonzero(opens)
        owner = np.searchsorted(begins, first, side="right") - 1
        ends = (begins + counts)[owner]
        last = np.minimum(np.append(first[1:], len(least)), ends) - 1
        inside = first < ends
        return owner[inside], (least[first[inside]] & np.uint64(0xFFFFFF)).astype(np.int64), first[inside], last[inside]

    window = short - gram + 1
    least = _sliding_min(keys, window)
    own, at, s, last = runs(short, least)
    e, long = last + short, last - s + 1
    shape = (long << _FIELD) | long
    if short < length:
        rest = length - short  # a long string's window is made of short ones'
        wide = least[:-rest].copy()
        for shift in (*range(window, rest, window), rest):
            np.minimum(wide, least[shift : shift + len(wide)], out=wide)
        own_long, at_long, s_long, last_long = runs(length, wide)
        both = np.union1d(at, at_long)  # at a block's end, an anchor's short strings may all start in the next one
        i, j = np.searchsorted(both, at), np.searchsorted(both, at_long)
        first, some = np.zeros((2, len(both)), np.int64)
        first[i], some[i] = s, long
        first[j[~np.isin(j, i)]] = s_long[~np.isin(j, i)]
        values = [(own, own_long), (s, s_long), (e, last_long + length), (0, last_long - s_long + 1)]
        own, s, e, long = np.zeros((4, len(both)), np.int64)
        for out, (narrow, wide) in zip((own, s, e, long), values):
            out[i] = narrow
            out[j] = wide
        at, shape = both, ((first - s) << (2 * _FIELD)) | (some << _FIELD) | long
    view = memoryview(data)
    digests = b"".join([xxhash.xxh3_128_digest(view[i:j]) for i, j in zip(s.tolist(), e.tolist(), strict=True)])
    content = np.frombuffer(digests, dtype="<i8").reshape(-1, 2)
    # A block's end can cut equal bytes into different ranges.
    check = content[:, 1] ^ mix(shape.view(np.uint64)).view(np.int64)
    return {"owner": own, "anchor": hashes[at].view(np.int64), "content": content[:, 0], "check": check, "start": s - begins[own], "end": e - begins[own], "shape": shape}


def _find_segments(length: int, short: int = 0):
    least = short or length
    schema = pa.schema([("rid", pa.binary()), ("anchor", pa.int64()), ("content", pa.int64()), ("check", pa.int64()), ("n", pa.int64()), ("first", pa.int32()), ("size", pa.int32()), ("shape", pa.int64()), ("spans", pa.list_(pa.int32()))])

    def emit(rids: list[bytes], shifts: list[int], parts: list[bytes]) -> pa.RecordBatch:
        found = segments_of(parts, length, short, BLOCK)
        order = np.lexsort((found["start"], found["check"], found["content"], found["anchor"], found["owner"]))
        f = {k: v[order] for k, v in found.items()}
        start, end = f["start"] + np.array(shifts)[f["owner"]], f["end"] + np.array(shifts)[f["owner"]]
        new = np.concatenate([[True], np.any([f[k][1:] != f[k][:-1] for k in ("owner", *KIND)], axis=0)])
        groups = np.flatnonzero(new)
        counts = np.diff(groups, append=len(new))
        # A text's equal segments are one row; where they touch, one span. A segment that is alone needs none.
        several = np.repeat(counts > 1, counts)
        opens = (new | np.concatenate([[True], start[1:] > end[:-1]])) & several
        spans = np.flatnonzero(opens)
        closes = np.searchsorted(np.flatnonzero(new), spans, side="right")
        closes = np.minimum(np.append(spans[1:], len(start)), np.append(groups, len(start))[closes]) - 1
        flat = np.stack([start[spans], end[closes]], axis=1).ravel().astype(np.int32)
        offsets = 2 * np.searchsorted(spans, np.append(groups, len(start)))
        lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat), mask=pa.array(counts == 1))
        own = f["owner"][groups]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(rids, pa.binary()).take(pa.array(own)), *(pa.array(f[k][groups]) for k in KIND), pa.array(counts), pa.array(start[groups].astype(np.int32)), pa.array((end - start)[groups].astype(np.int32)), pa.array(f["shape"][groups]), lists,
            ],
            schema=schema,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_serves("suffixes")
        for batch in batches:
            rids, shifts, parts, size = [], [], [], 0
            for rid, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for at in range(0, len(data) - least + 1, BLOCK):
                    part = data[at : at + BLOCK + length - 1]
                    if size and size + len(part) > BLOCK:
                        yield emit(rids, shifts, parts)
                        rids, shifts, parts, size = [], [], [], 0
                    rids.append(rid)
                    shifts.append(at)
                    parts.append(part)
                    size += len(part)
            if parts:
                yield emit(rids, shifts, parts)
        trim()

    return run


# --- the transform of a bundle ---------------------------------------------------------------------------------


def _radix_order(key: np.ndarray) -> np.ndarray:
    """The order of 64-bit keys, ties by place: numpy sorts 16-bit numbers by radix, so four passes over them are cheap."""
    parts = key.view(np.uint16).reshape(-1, 4)
    order = np.argsort(parts[:, 0], kind="stable").astype(np.int32)
    for k in (1, 2, 3):
        order = order[np.argsort(parts[order, k], kind="stable")]
    return order


def sorted_suffixes(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes ordered by their first ``depth`` symbols at least, by prefix doubling; every 0 is smaller than later ones."""
    n, q = len(symbols), 7
    stops = np.flatnonzero(symbols == 0)
    one = np.concatenate([symbols, np.zeros(q, symbols.dtype)]).astype(np.uint64)
    two = (one[:-1] << np.uint64(9)) | one[1:]
    four = (two[:-2] << np.uint64(18)) | two[2:]
    key = (four[:n] << np.uint64(27)) | (four[3 : n + 3] & np.uint64((1 << 27) - 1))
    # Nothing counts behind the first separator; suffixes that reach one keep the order of their places.
    ends = np.zeros(n, bool)
    for back in range(q):
        at = stops - back
        at = at[at >= 0]
        at = at[~ends[at]]
        ends[at] = True
        rest = np.uint64(9 * (q - 1 - back))
        key[at] = (key[at] >> rest) << rest
    order = _radix_order(key)
    inner = key[order]
    opens = np.concatenate([[True], inner[1:] != inner[:-1]]) | ends[order]
    del one, two, four, key, inner
    rank = np.empty(n, dtype=np.uint32)
    while q < depth:
        heads = np.flatnonzero(opens).astype(np.uint32)
        rank[order] = np.repeat(heads, np.diff(heads, append=np.uint32(n)))
        alone = opens & np.concatenate([opens[1:], [True]])
        slots = np.flatnonzero(~alone)
        if not len(slots):
            break
        some = order[slots]
        both = (rank[some].astype(np.uint64) << np.uint64(32)) | rank[some + q]
        again = np.argsort(both, kind="stable")
        order[slots] = some[again]
        both = both[again]
        opens[slots] = np.concatenate([[True], both[1:] != both[:-1]])
        q *= 2
    return order


def shared_rows(transform: np.ndarray, stops: int, length: int, also: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """For each row, whether it shares its first ``length`` symbols with the row before it; and whether it does its first
    ``also`` (which the expansion passes on its way).

    ``transform`` holds the symbol before each suffix in sorted order; the first ``stops`` rows are the separators.
    """
    n = len(transform)
    step = np.empty(n, dtype=np.int32)  # the row of the suffix one symbol longer
    step[np.argsort(transform, kind="stable")] = np.arange(n, dtype=np.int32)
    totals = np.bincount(transform, minlength=257)
    ends = np.cumsum(totals)
    known = np.zeros(n + 1, dtype=bool)
    heads = ends - totals
    live = np.flatnonzero(totals[1:]) + 1
    left = np.concatenate([np.arange(stops), heads[live]]).astype(np.int32)
    right = np.concatenate([np.arange(stops) + 1, ends[live]]).astype(np.int32)
    known[right] = True
    known[0] = True
    low = np.int64((1 << 32) - 1)
    passed = None
    for value in range(1, length):
        if value == also:
            passed = known.copy()
        if not len(left):
            break
        size = right - left
        one = size == 1
        rows = left[one]
        rows = step[rows[transform[rows] != 0]]
        new_left, new_right = [rows], [rows + 1]
        if len(rows) < len(left):
            l, s = left[~one], size[~one]
            at = np.repeat(l - (np.cumsum(s) - s), s) + np.arange(s.sum())
            symbol = transform[at]
            # Interval, symbol and row in one number: sorted values are the intervals that each symbol leads to.
            key = (np.repeat(np.arange(len(l), dtype=np.int64) * 257, s) + symbol << 32) + at
            key = np.sort(key[symbol != 0])
            if len(key):
                of, at = key >> 32, key & low
                edge = np.flatnonzero(of[1:] != of[:-1])
                new_left.append(step[at[np.append(0, edge + 1)]])
                new_right.append(step[at[np.append(edge, len(key) - 1)]] + 1)
        left, right = np.concatenate(new_left), np.concatenate(new_right)
        fresh = ~known[right]
        left, right = left[fresh], right[fresh]
        known[right] = True
    return ~known[:n], ~(known if passed is None else passed)[:n]


def repeated_starts(segments: list[bytes], weights: list[list[tuple[int, int, int]]], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Over the segments, each followed by a separator: which positions start a repeated string, which of them are the
    first of their kind, and where each segment begins. Strings that start in a segment's range (from, to, weight) count as
    often as its weight says."""
    flat = np.array([(k, *r) for k, own in enumerate(weights) for r in own], dtype=np.int64).reshape(-1, 4)
    begins = _begins(segments)
    found = _repeated(segments, [(begins[flat[:, 0]] + flat[:, 1], np.maximum(flat[:, 2] - flat[:, 1], 0))], flat[:, 3], [length])
    return *found[0], begins


def _begins(segments: list[bytes]) -> np.ndarray:
    sizes = np.array([len(s) + 1 for s in segments], dtype=np.int64)
    return np.cumsum(sizes) - sizes


def _repeated(segments: list[bytes], ranges: list[tuple[np.ndarray, np.ndarray]], weight: np.ndarray, lengths: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """As above, for strings of each of one or two lengths, the longer first: with its ranges as numbers (where each starts
    over all segments, how many positions it has), and their weights."""
    data = np.frombuffer(b"\0".join(segments) + b"\0", dtype=np.uint8)
    symbols = data.astype(np.uint16) + np.uint16(1)
    symbols[np.append(_begins(segments)[1:], len(data)) - 1] = 0
    order = sorted_suffixes(symbols, lengths[0])
    out = []
    for same, (starts, n) in zip(shared_rows(symbols[order - 1], len(segments), *lengths), ranges):
        # How often a suffix's string occurs; one that starts outside the ranges is no occurrence of any.
        counts = np.zeros(len(symbols), dtype=np.int64)
        counts[_ranges(starts, n)] = np.repeat(weight, n)
        counts = counts[order]
        # The first of a kind is one that counts, so that its range holds it.
        heads = np.flatnonzero(~same)
        several = np.add.reduceat(counts, heads) > 1
        repeated, head = np.zeros(len(symbols), bool), np.zeros(len(symbols), bool)
        flags = np.repeat(several, np.diff(heads, append=len(symbols)))
        repeated[order] = flags
        counted = np.flatnonzero(flags & (counts > 0))
        kind = np.cumsum(~same, dtype=np.int32)[counted]
        head[order[counted[np.diff(kind, prepend=0) > 0]]] = True
        out.append((repeated, head))
    return out


def _run_lists(flags: np.ndarray, owner: np.ndarray, at: np.ndarray, starts: np.ndarray, length: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Flat start, end pairs of the runs of flagged positions, a list for each member (relative to it); and the pairs."""
    left = flags & np.concatenate([[True], ~flags[:-1] | (owner[1:] != owner[:-1])])
    right = flags & np.concatenate([~flags[1:] | (owner[1:] != owner[:-1]), [True]])
    a, b, of = at[left] - starts[owner[left]], at[right] - starts[owner[right]] + length, owner[left]
    bounds = np.searchsorted(of, np.arange(len(starts) + 1))
    return pa.ListArray.from_arrays(pa.array((2 * bounds).astype(np.int32)), pa.array(np.stack([a, b], axis=1).ravel().astype(np.int32))), a, b, of


def _ranges(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All numbers from each start on, as many as n says, one range after another."""
    return np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _expand_bundle(length: int, short: int = 0):
    fields = (*KIND, "weight", "parts", "off", "size", *(["shape"] if short else []))

    def run(table: pa.Table) -> pa.Table:
        worker_serves("suffixes")
        # The same row may come from repeated rows; its bytes are the same. Segments of several anchors may start at one place.
        lists = table.column("members").combine_chunks()
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        anchors = lists.flatten().field("anchor").to_numpy(zero_copy_only=False)
        anchors = anchors[np.cumsum(sizes := lists.value_lengths().to_numpy(zero_copy_only=False)) - sizes].tolist()
        places = zip(table.column("rid").to_pylist(), table.column("start").to_pylist(), anchors, strict=True)
        rows = pa.array(list({place: k for k, place in enumerate(places)}.values()), pa.int64())
        pieces = table.column("bytes").take(rows).to_pylist()
        lists = lists.take(rows)
        members = lists.flatten()
        named = {k: members.field(k).to_numpy(zero_copy_only=False) for k in fields}
        piece = np.repeat(np.arange(len(pieces)), lists.value_lengths().to_numpy(zero_copy_only=False))
        starts, n = _begins(pieces)[piece] + named["off"], named["size"].astype(np.int64) - length + 1
        lengths, ranges = [length], [(starts, n)]
        if short:
            skip, some, n = _shape(named["shape"])
            lengths, ranges = [length, short], [(starts, n), (starts + skip, some)]
        found = _repeated(pieces, ranges, named["weight"], lengths)
        spans, loose, whole = [], [], np.zeros(len(n), bool)
        for k, ((repeated, head), (begin, count)) in enumerate(zip(found, ranges)):
            # The members' positions one after another; a run of repeated ones ends with its member.
            at, owner = _ranges(begin, count), np.repeat(np.arange(len(n)), count)
            flags = repeated[at]
            # Of crowded kinds one of each string, and all that found no partner here, for the comparison across bundles.
            sent = (named["parts"] > 1)[owner] & (~flags | head[at])
            loose.append((at[sent], owner[sent], lengths[k]))
            if k:  # where a long string of the same segment starts, the short one lies in it
                flags &= (n[owner] == 0) | ~found[0][0][at]
            pairs, a, b, of = _run_lists(flags, owner, at, starts, lengths[k])
            # A segment that has long strings is whole by them only.
            whole[of[(a == 0) & (b == named["size"][of]) & ((n[of] > 0) == (k == 0))]] = True
            spans.append(pairs)
        also = spans[1] if len(spans) > 1 else pa.ListArray.from_arrays(pa.array(np.zeros(len(n) + 1, np.int32)), pa.array([], pa.int32()))
        del found, repeated, head, at, owner, flags, sent
        out = {k: pa.array(named[k], pa.int64()) for k in KIND} | {"spans": spans[0], "also": also, "whole": pa.array(whole), "loose": _loose_windows(pieces, loose, starts, len(n))}
        del loose, pieces
        trim()
        return pa.table(out)

    return run


def _loose_windows(pieces: list[bytes], loose: list[tuple[np.ndarray, np.ndarray, int]], starts: np.ndarray, members: int) -> pa.Array:
    """Two hashes of the strings that start at the places given (over all pieces, with their members, for each length), and
    where in their member; a list for each member. Places of strings of the second length are stored as their complement."""
    begins, parts = _begins(pieces), []
    for kind, (at, owner, length) in enumerate(loose):
        hashes = np.zeros((2, len(at)), dtype=np.uint64)
        if len(at):
            first = np.searchsorted(at, begins)
            for k, piece in enumerate(pieces):
                own = slice(first[k], first[k + 1] if k + 1 < len(pieces) else len(at))
                if own.start < own.stop:
                    where = at[own] - begins[k]
                    up, down = _powers(len(piece) + 1)
                    values = np.frombuffer(piece, dtype=np.uint8).astype(np.uint64)
                    for j, scramble in enumerate((values + np.uint64(1), mix(values + np.uint64(77)))):
                        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(scramble * up[: len(piece)])])
                        hashes[j, own] = mix((sums[where + length] - sums[where]) * down[where] + np.uint64(kind))
        place = (at - starts[owner]).astype(np.int32)
        parts.append((hashes, ~place if kind else place, owner))
    hashes, place, owner = (np.concatenate([p[i] for p in parts], axis=-1) for i in range(3)) if len(parts) > 1 else parts[0]
    if len(parts) > 1:
        order = np.argsort(owner, kind="stable")
        hashes, place, owner = hashes[:, order], place[order], owner[order]
    windows = pa.StructArray.from_arrays([pa.array(hashes[0].view(np.int64)), pa.array(hashes[1].view(np.int64)), pa.array(place)], ["h", "g", "at"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(members + 1)).astype(np.int32)), windows)


# --- the operator ----------------------------------------------------------------------------------------------


MEMBERS = f"array<struct<{', '.join(f'{k}:long' for k in KIND)}, weight:long, parts:int, alone:boolean, off:int, size:int, shape:long>>"


def _cut_segments(limit: int):
    """Bytes of the wanted segments of each text. Segments that are alone with their anchor need no others beside them, so
    those that overlap are one piece, of about ``limit`` bytes at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids, starts, pieces, members = [], [], [], []
            for rid, data, wanted in zip(*(batch.column(c).to_pylist() for c in ("rid", "data", "wanted")), strict=True):
                runs: list[list] = []  # start, end, members
                for w in sorted(wanted, key=lambda w: w["first"]):
                    if not (runs and w["alone"] and runs[-1][2][-1]["alone"] and w["first"] < runs[-1][1] < runs[-1][0] + limit):
                        runs.append([w["first"], 0, []])
                    runs[-1][1] = max(runs[-1][1], w["first"] + w["size"])
                    runs[-1][2].append({k: w[k] for k in (*KIND, "weight", "parts", "alone", "size", "shape")} | {"off": w["first"] - runs[-1][0]})
                for start, end, own in runs:
                    rids.append(rid)
                    starts.append(start)
                    pieces.append(data[start:end])
                    members.append(own)
            kind = pa.list_(pa.struct([*((k, pa.int64()) for k in (*KIND, "weight")), ("parts", pa.int32()), ("alone", pa.bool_()), ("off", pa.int32()), ("size", pa.int32()), ("shape", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(rids, pa.binary()), pa.array(starts, pa.int32()), pa.array(members, kind), pa.array(pieces, pa.binary())], ["rid", "start", "members", "bytes"])

    return run


def _absolute(first, spans):
    return F.transform(spans, lambda x: x + first)


def repeated_spans(rows: DataFrame, length: int = LENGTH, crowd: int = CROWD, bundle: int = BUNDLE, crowd_bytes: int = CROWD_BYTES) -> DataFrame:
    """From (rid, data) rows, binary both: (rid, spans, also), flat start, end pairs both: of bytes to remove, and of strings of
    PASSAGE bytes (where ``length`` is more) that start elsewhere too and don't begin a longer one to remove.

    The result is written; what it took is deleted.
    """
    short = PASSAGE if PASSAGE < length else 0
    levels = (length, short) if short else (length,)
    kind, scratch = ", ".join(f"{k} long" for k in KIND), Scratch()
    found = scratch(rows.filter(F.octet_length("data") >= min(levels)).select("rid", "data").mapInArrow(
        _find_segments(*levels), f"rid binary, {kind}, n long, first int, size int, shape long, spans array<int>"))
    # Aggregates are written before they are joined: a join of two exchanges can be split where an anchor is hot.
    anchors = scratch(found.groupBy("anchor").agg(F.sum("n").alias("total")).filter("total > 1").select("anchor"))
    # Few anchors of many stay, so they are hashed and the wide rows needn't be sorted.
    again = scratch(found.join(anchors.hint("shuffle_hash"), "anchor"))
    scratch.drop(found)
    kinds = scratch(again.groupBy(*KIND).agg(F.sum("n").alias("weight"), F.min(F.struct("rid", "first", "size", "shape")).alias("one")))
    several = scratch(kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum("one.size").alias("bytes")))
    parts = F.when((F.col("kinds") > crowd) | ((F.col("kinds") > 1) & (F.col("bytes") > crowd_bytes)), F.ceil(F.greatest(F.col("kinds") / crowd, F.col("bytes") / crowd_bytes))).otherwise(1).cast("int")
    wanted = scratch(kinds.join(several, "anchor").select(*KIND, "one.*", "weight", "kinds", parts.alias("parts")))
    alone = F.col("kinds") == 1
    volume, most = wanted.agg(F.coalesce(F.sum(F.when(alone, F.col("size") / 2).otherwise(F.col("size"))).cast("long"), F.lit(0)), F.coalesce(F.max("parts"), F.lit(1))).first()
    bundles = max(1, -(-volume // bundle))
    item = F.struct(*KIND, "weight", "parts", alone.alias("alone"), "first", "size", "shape")
    lists = wanted.groupBy("rid").agg(F.collect_list(item).alias("wanted"))
    pieces = rows.join(lists, "rid").select("rid", "data", "wanted").mapInArrow(_cut_segments(bundle // 4), f"rid binary, start int, members {MEMBERS}, bytes binary")
    m = F.col("members")[0]
    salt = F.pmod(m["content"], m["parts"])
    place = F.when(m["alone"], F.xxhash64("rid", "start")).otherwise(F.xxhash64(m["anchor"], salt))
    pieces = pieces.withColumn("bundle", F.pmod(place, F.lit(bundles)))
    loose = "array<struct<h:long,g:long,at:int>>"
    expanded = scratch(pieces.groupBy("bundle").applyInArrow(_expand_bundle(*levels), f"{kind}, spans array<int>, also array<int>, whole boolean, loose {loose}"))
    partial = expanded.select(*KIND, "spans", "also", "whole")
    if most > 1:
        windows = expanded.filter(F.size("loose") > 0).select(*KIND, F.explode("loose").alias("w")).select(*KIND, "w.*")
        twice = windows.groupBy("h", "g").agg(F.count("*").alias("n")).filter("n > 1").select("h", "g")
        at, none = F.col("at"), F.array().cast("array<int>")
        spans, also = F.when(at >= 0, F.array(at, at + length)), F.when(at < 0, F.array(F.bitwise_not(at), F.bitwise_not(at) + short))
        hits = windows.join(twice, ["h", "g"]).select(*KIND, F.coalesce(spans, none).alias("spans"), F.coalesce(also, none).alias("also"), F.lit(False).alias("whole"))
        # A kind that repeats inside one bundle sent one window only; its others are already in ``spans``.
        partial = partial.unionByName(hits)
    partial = partial.filter((F.size("spans") > 0) | (F.size("also") > 0))
    # A segment that the expansion found repeated from end to end goes wherever it lies; of others there is one only.
    own = F.coalesce("spans", F.array(F.col("first"), F.col("first") + F.col("size")))
    long, none = F.col("shape") % (1 << _FIELD) > 0, F.array().cast("array<int>")
    whole = again.join(scratch(partial.filter("whole").select(*KIND)).hint("shuffle_hash"), [*KIND]).select("rid", F.when(long, own).otherwise(none).alias("spans"), F.when(long, none).otherwise(own).alias("also"))
    some = kinds.filter("weight = 1").select(*KIND, "one").join(partial.filter("not whole"), [*KIND]).select(
        F.col("one.rid").alias("rid"), *(_absolute(F.col("one.first"), F.col(c)).alias(c) for c in ("spans", "also")))
    out = materialise(whole.unionByName(some).groupBy("rid").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("spans", "also"))))
    scratch.drop()
    return out


def covered(flat: list[int]) -> int:
    """How many bytes flat start, end pairs cover."""
    at, n = 0, 0
    for a, b in sorted(zip(flat[::2], flat[1::2], strict=True)):
        n += max(0, b - max(a, at))
        at = max(at, b)
    return n


def _remove(batches: Iterator[pa.RecordBatch], as_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, removed, runs, found = [], [], [], []
        for data, spans, also in zip(*(batch.column(c).to_pylist() for c in ("data", "spans", "also")), strict=True):
            found.append(covered([*(spans or ()), *(also or ())]))
            pairs = sorted(zip(spans[::2], spans[1::2], strict=True)) if spans else []
            out, at, n, gone = [], 0, 0, 0
            for a, b in pairs:
                if a > at or not n:
                    out.append(data[at:a])
                    n += 1
                    gone += b - a
                elif b > at:
                    gone += b - at
                at = max(at, b)
            out.append(data[at:])
            left = b"".join(out)
            kept.append(left.decode("utf-8", "ignore") if as_text else left)
            removed.append(gone)
            runs.append(n)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in range(batch.num_columns - 3)), pa.array(kept, pa.string() if as_text else pa.binary()), *(pa.array(x, pa.int64()) for x in (removed, runs, found))],
            [*batch.schema.names[:-3], "kept", "n_removed", "n_spans", "n_repeated"],
        )


def _rid(doc_id: Column, data: Column) -> Column:
    return F.unhex(F.md5(F.concat(F.encode(F.coalesce(doc_id.cast("string"), F.lit("-")), "UTF-8"), F.lit(b"\0"), data)))


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", as_text: bool = False, **limits) -> DataFrame:
    """All columns of ``docs`` but the text in a struct ``row``, with missing (the text was null), n_bytes, ``kept`` (remaining bytes; with ``as_text`` their
    text, in which a character that a removed span cuts in two goes as a whole), n_removed, n_spans and n_repeated (bytes removed or
    in repeated strings of PASSAGE bytes)."""
    data = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col)).alias("row"), F.col(text_col).isNull().alias("missing"), data.alias("data"), _rid(F.col(id_col), data).alias("rid"))
    spans = repeated_spans(rows.select("rid", "data"), length, **limits)
    joined = rows.join(spans, "rid", "left").select("row", "missing", F.octet_length("data").cast("long").alias("n_bytes"), "data", "spans", "also")
    kind = joined.schema["row"].dataType.simpleString()
    return joined.mapInArrow(lambda batches: _remove(batches, as_text), f"row {kind}, missing boolean, n_bytes long, kept {'string' if as_text else 'binary'}, n_removed long, n_spans long, n_repeated long")


def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest columns; also n_repeated, the bytes that a string of PASSAGE bytes covers which starts anywhere else too
    (removed bytes among them)."""
    kept = remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_repeated")


QUERIES = {"op4_suffixes": op4_suffixes}
