"""Removal of long byte strings that also start in an earlier document, by run-length BWT indexes.

A string of 50 bytes is filed under its minimizer, the smallest hash of the 16-byte strings in it, so equal strings are
filed alike wherever they stand.  Consecutive strings of a document under one minimizer make a stretch of text.

1. Minimizers that occur in one document only are ruled out; only hashes travel for that.
2. Stretches under the others are dealt out by minimizer.  Each part builds an index of its stretches: their
   Burrows-Wheeler transform, run-length compressed, with samples at the borders of runs.  Matches are measured only at
   those samples; between them they follow by streaming through the text, one byte shorter at each step.  Where a match is
   at least 50 long, strings are equal, and the smallest document of each set of equal strings is known.
3. Every document gets its strings back that an earlier document holds, and loses the bytes they cover.

What many documents of a task share is settled there and travels once, so a passage in very many documents doesn't
gather in one part.  Equal texts are settled by their hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.llm.common import durable, grouped, mixed, pieces, quoted, table, utf8
from foliomill.llm.words import hashes

LENGTH, GRAM = 50, 16
# Bytes of text behind one part of the minimizers; parts are as many as the input asks for.
PART_BYTES = 32 << 20
# Bytes of candidate texts behind one part of the stretches, and of stretches that are indexed at once.
DEAL_BYTES, INDEX_BYTES = 8 << 20, 1 << 20
# Bytes of texts whose strings are looked at together.
BLOCK_BYTES = 1 << 20
HERE = np.uint32(2**32 - 1)
# Minimizers are told by 48 of their bits; a chance agreement costs a comparison, no wrong result.
NAME_SHIFT = np.uint64(16)


def blocks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """First of, and first after, the pieces between ``offsets`` that make up about ``BLOCK_BYTES`` each time."""
    begin = 0
    while begin < len(offsets) - 1:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + BLOCK_BYTES, "right")) - 1)
        yield begin, end
        begin = end


def stretches(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Maximal runs of ``length``-byte strings with one minimizer: its hash, first byte, number of strings, text.

    Whole texts are taken about ``BLOCK_BYTES`` at a time, as the work arrays hold many bytes for each of theirs.
    """
    found = [block_stretches(data[:0], np.zeros(1, np.int64), length)]
    for a, b in blocks(offsets):
        low, start, many, text = block_stretches(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], length)
        found.append((low, start + offsets[a], many, text + a))
    return tuple(np.concatenate(x) for x in zip(*found))


def block_stretches(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none.astype(np.uint64), none, none, none
    x = data.astype(np.uint64)
    for step in (1, 2, 4):
        x[:-step] |= x[step:] << np.uint64(8 * step)
    grams = x[: len(x) - GRAM + 1] * np.uint64(0x9E3779B97F4A7C15)
    grams ^= grams >> np.uint64(29)
    grams += x[8 : 8 + len(grams)] * np.uint64(0xC2B2AE3D27D4EB4F)
    del x
    low = mixed(grams)
    del grams
    span, width = 1, length - GRAM + 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    rest = width - span
    low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
    count = np.maximum(np.diff(offsets) - length + 1, 0)
    text = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(text)) + np.repeat(offsets[:-1] - np.cumsum(count) + count, count)
    low = low[place]
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return low[at], place[at], np.diff(np.append(at, len(low))), text[at]


def packed(*arrays: np.ndarray) -> list[bytes]:
    """Compressed cells; the bytes of integers stand plane by plane, as the high ones are much alike."""
    codec, out = pa.Codec("zstd", 3), []
    for array in arrays:
        planes = np.ascontiguousarray(array).view(np.uint8).reshape(len(array), array.dtype.itemsize).T.tobytes()
        out.append(np.int64(len(planes)).tobytes() + codec.compress(planes, asbytes=True))
    return out


def unpacked(cell: bytes, kind: type) -> np.ndarray:
    size = int(np.frombuffer(cell[:8], np.int64)[0])
    planes = np.frombuffer(pa.Codec("zstd").decompress(cell[8:], size, asbytes=True), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(width, size // width).T).view(kind).reshape(-1)


def steps(rising: np.ndarray) -> np.ndarray:
    """Differences of sorted numbers, whose high bytes are mostly zero; ``np.cumsum`` brings the numbers back."""
    return np.diff(rising, prepend=rising.dtype.type(0))


def split_by(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(part, kind="stable")
    values, first = np.unique(part[order], return_index=True)
    for value, rows in zip(values.tolist(), np.split(order, first[1:])):
        yield value, rows


def offered(parts: int):
    """Per task: which minimizers each text has.  A minimizer of several texts of a slice is known to be shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 8 << 20):
            low, _, _, text = stretches(*utf8(batch.column(1)))
            node, content, doc = (batch.column(i).to_numpy() for i in (0, 2, 3))
            # Of equal texts only the earliest is looked at further.
            order = np.lexsort((doc, content))
            lead = np.ones(len(order), bool)
            lead[1:] = content[order][1:] != content[order][:-1]
            chosen = np.zeros(len(order), bool)
            chosen[order[lead]] = True
            low, text = low[chosen[text]] >> NAME_SHIFT, text[chosen[text]]
            order = np.lexsort((text, low))
            low, text = low[order], text[order]
            new = np.ones(len(low), bool)
            new[1:] = (low[1:] != low[:-1]) | (text[1:] != text[:-1])
            low, text = low[new], text[new]
            first = np.ones(len(low), bool)
            first[1:] = low[1:] != low[:-1]
            many = np.diff(np.append(np.flatnonzero(first), len(low)))
            shared = np.repeat(many > 1, many)
            rows: list[tuple] = []
            # Of a shared one, its name alone is offered; its texts are answered at once.
            sent = first | ~shared
            place = (low >> np.uint64(16)).astype(np.int64) % parts
            for value, at in split_by(place[sent]):
                who = np.where(shared[sent][at], HERE, text[sent][at].astype(np.uint32))
                rows.append((value, False, node.tobytes(), content.tobytes(), *packed(who, steps(low[sent][at]))))
            if shared.any():
                rows.append((int(node[0]) % parts, True, node.tobytes(), content.tobytes(), *packed(text[shared].astype(np.uint32), steps(low[shared]))))
            names = ["part", "settled", "nodes", "contents", "who", "low"]
            kinds = [pa.int32(), pa.bool_(), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)], names=names)

    return run


def answered(group: pa.Table) -> pa.RecordBatch:
    """The shared minimizers of each document, from one part's offers."""
    node, low, content, settled_node, settled_low = [], [], [], [], []
    for settled, nodes, contents, who, values in zip(*(group.column(c).to_pylist() for c in ("settled", "nodes", "contents", "who", "low"))):
        nodes, contents, who, values = np.frombuffer(nodes, np.int64), np.frombuffer(contents, np.int64), unpacked(who, np.uint32), np.cumsum(unpacked(values, np.uint64), dtype=np.uint64)
        if settled:
            settled_node.append(nodes[who])
            settled_low.append(values)
            continue
        here = who == HERE
        who = np.where(here, 0, who)
        # One that is known to be shared counts as two contents.
        for extra in (slice(None), here):
            node.append(np.where(here, 0, nodes[who])[extra])
            content.append(np.where(here, 0, contents[who])[extra] + (0 if extra is not here else 1))
            low.append(values[extra])
    if node:
        node, low, content = np.concatenate(node), np.concatenate(low), np.concatenate(content)
        order = np.lexsort((content, low))
        node, low, content = node[order], low[order], content[order]
        first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]])) if len(low) else np.zeros(0, np.int64)
        last = np.append(first[1:], len(low))[: len(first)] - 1
        shared = np.repeat(content[first] != content[last], last - first + 1) & (node != 0)
        settled_node.append(node[shared])
        settled_low.append(low[shared])
    node, low = np.concatenate(settled_node), np.concatenate(settled_low)
    # A document's stand together, which packs better in the shuffle.
    order = np.argsort(node, kind="stable")
    return pa.RecordBatch.from_arrays([pa.array(node[order], pa.int64()), pa.array(low[order].view(np.int64), pa.int64())], names=["node", "low"])


def cut_out(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    begin = np.cumsum(size) - size
    return data[np.arange(int(size.sum())) - np.repeat(begin - start, size)]


def content_hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of the strings of ``size`` bytes at ``start``."""
    offsets = np.concatenate([[0], np.cumsum(size)])
    return np.concatenate([np.zeros(0, np.uint64), *(hashes(cut_out(data, start[a:b], size[a:b]), size[a:b]) for a, b in blocks(offsets))])


def dealt(parts: int):
    """Per task: the stretches under shared minimizers, to the parts that compare them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 4 << 20):
            texts = [pa.Codec("zstd").decompress(z, n, asbytes=True) if n else b"" for z, n in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            data = np.frombuffer(b"".join(texts), np.uint8)
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
            low, start, many, text = stretches(data, offsets)
            answers = batch.column(4)
            asked = answers.flatten().to_numpy().view(np.uint64), np.repeat(np.arange(len(answers)), answers.value_lengths().to_numpy())
            names = mixed((low >> NAME_SHIFT) + mixed(text.astype(np.uint64)))
            wanted = np.isin(names, mixed(asked[0] + mixed(asked[1].astype(np.uint64))))
            low, start, many, text = low[wanted], start[wanted], many[wanted], text[wanted]
            doc, node = batch.column(1).to_numpy(), batch.column(0).to_numpy()
            size = many + LENGTH - 1
            same = content_hashes(data, start, size)
            # Of equal stretches of a slice only the earliest document's goes out; later documents lose theirs.
            order = np.lexsort((doc[text], same, low))
            low, start, many, text, same, size = (a[order] for a in (low, start, many, text, same, size))
            new = np.ones(len(low), bool)
            new[1:] = (low[1:] != low[:-1]) | (same[1:] != same[:-1]) | (many[1:] != many[:-1])
            lead = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            lost = doc[text] > doc[text[lead]]
            sent = new | ~lost
            inner = (start - offsets[:-1][text]).astype(np.uint32)
            rows: list[tuple] = []
            for value, at in split_by((low[sent] >> np.uint64(20)).astype(np.int64) % parts):
                at = np.flatnonzero(sent)[at]
                who, at_text = np.unique(text[at], return_inverse=True)
                cells = packed(at_text.astype(np.uint32), inner[at], many[at].astype(np.uint32), steps(low[at] >> NAME_SHIFT), cut_out(data, start[at], size[at]))
                rows.append((value, False, node[who].tobytes(), doc[who].tobytes(), *cells))
            if lost.any():
                cells = packed(text[lost].astype(np.uint32), inner[lost], many[lost].astype(np.uint32), low[:0], np.zeros(0, np.uint8))
                rows.append((int(node[0]) % parts, True, node.tobytes(), doc.tobytes(), *cells))
            names = ["part", "settled", "nodes", "docs", "who", "start", "many", "low", "bytes"]
            kinds = [pa.int32(), pa.bool_(), *[pa.binary()] * 7]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 9, kinds)], names=names)

    return run


def ranked(key: np.ndarray, bits: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """The order of ``key``, and where in it a new value begins; ``bits`` hold any place in it."""
    if int(key.max(initial=0)).bit_length() + int(bits) <= 64:
        both = key << bits
        both |= np.arange(len(key), dtype=np.uint64)
        both.sort()
        order, key = (both & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64), both >> bits
    else:
        order = np.argsort(key)
        key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return order, new


class RunLengthIndex:
    """Run-length BWT of several texts, each followed by an end sign of its own, with samples where runs begin."""

    def __init__(self, data: np.ndarray, sizes: np.ndarray, length: int = LENGTH):
        ends = np.cumsum(sizes + 1) - 1
        text = np.zeros(int(sizes.sum()) + len(sizes), np.uint16)
        inside = np.ones(len(text), bool)
        inside[ends] = False
        text[inside] = data.astype(np.uint16) + 1
        self.text, self.length = text, length
        order = self._sorted(np.repeat(ends, sizes + 1) - np.arange(len(text)))
        before = text[order - 1]
        # End signs differ from one another, so none of them continues a run.
        heads = before == 0
        heads[:1] = True
        heads[1:] |= before[1:] != before[:-1]
        self.run_starts = np.flatnonzero(heads)
        self.run_bytes = before[self.run_starts]
        # Each sample: the place that the byte at a run's head stands at.
        self.samples = (order[self.run_starts] - 1) % max(len(order), 1)
        self.order = order

    def _sorted(self, left: np.ndarray) -> np.ndarray:
        """The places in the order of their suffixes; ``left`` is how far each is from its end sign.

        Prefix doubling, where only suffixes that still tie are sorted further.  Suffixes that agree up to their end
        signs are in the order of their places.
        """
        text, n = self.text, len(self.text)
        bits = np.uint64(max(n.bit_length(), 1))
        present = np.bincount(text, minlength=1) > 0
        present[0] = True
        code = (np.cumsum(present) - 1).astype(np.uint64)[text]
        width = max(int(present.sum() - 1).bit_length(), 1)
        depth = (64 - int(bits)) // width
        key = np.zeros(n, np.uint64)
        for i in range(depth):
            key <<= np.uint64(width)
            key[: n - i] |= np.where(left[: n - i] >= i, code[i:], np.uint64(0))
        order, new = ranked(key, bits)
        del key, code
        slots = np.arange(n)
        number = np.empty(n, np.int64)
        while True:
            # A class is numbered by the slot that its first member has.
            number[order[slots]] = np.maximum.accumulate(np.where(new, slots, 0))
            tied = ~new
            tied[:-1] |= ~new[1:]
            slots = slots[tied]
            if not len(slots):
                return order
            at = order[slots]
            further = np.where(left[at] >= depth, number[np.minimum(at + depth, n - 1)], at)
            moved, new = ranked((number[at].astype(np.uint64) << bits) | further.astype(np.uint64), bits)
            order[slots] = at[moved]
            depth *= 2

    def matches(self) -> np.ndarray:
        """At each place how far it agrees with the suffix sorted above it, up to the length sought."""
        text, n = self.text, len(self.text)
        rank = np.empty(n, np.int64)
        rank[self.order] = np.arange(n)
        far = np.full(n, -1, np.int64)
        far[self.order[0]] = 0
        a = np.append(self.samples, n - 1)
        a = a[rank[a] > 0]
        b = self.order[rank[a] - 1]
        size, left = np.zeros(len(a), np.int64), np.arange(len(a))
        for step in range(self.length):
            x, y = a[left] + step, b[left] + step
            fine = (x < n) & (y < n)
            fine[fine] = (text[x[fine]] == text[y[fine]]) & (text[x[fine]] > 0)
            left = left[fine]
            size[left] += 1
        far[a] = size
        # Inside a run the byte before a place and the byte before its upper neighbour are the same, so the match of
        # the place before is one longer.
        known = np.flatnonzero(far >= 0)
        upon = known[np.searchsorted(known, np.arange(n))]
        return np.minimum(far[upon] + upon - np.arange(n), self.length)

    def earliest(self, doc: np.ndarray) -> np.ndarray:
        """At each place the smallest of ``doc`` among the places that agree with it over the length sought."""
        far = self.matches()[self.order]
        first = np.flatnonzero(far < self.length)
        if not len(first) or first[0]:
            first = np.concatenate([[0], first])
        low = np.minimum.reduceat(doc[self.order], first)
        out = np.empty(len(doc), doc.dtype)
        out[self.order] = np.repeat(low, np.diff(np.append(first, len(doc))))
        return out


def compared(group: pa.Table) -> pa.RecordBatch:
    """Byte runs that each document of one part loses."""
    node, doc, start, many, low, data = [], [], [], [], [], []
    spans = []
    columns = ("settled", "nodes", "docs", "who", "start", "many", "low", "bytes")
    for settled, nodes, docs, who, begin, count, kind, bytes_ in zip(*(group.column(c).to_pylist() for c in columns)):
        who, begin, count = (unpacked(x, np.uint32).astype(np.int64) for x in (who, begin, count))
        owner = np.frombuffer(nodes, np.int64)[who]
        if settled:
            spans.append((owner, begin, begin + count + LENGTH - 1))
            continue
        node.append(owner)
        doc.append(np.frombuffer(docs, np.int64)[who])
        start.append(begin)
        many.append(count)
        low.append(np.cumsum(unpacked(kind, np.uint64), dtype=np.uint64))
        data.append(unpacked(bytes_, np.uint8))
    if node:
        node, doc, start, many, low, data = (np.concatenate(x) for x in (node, doc, start, many, low, data))
        size = many + LENGTH - 1
        at = np.cumsum(size) - size
        # Equal stretches are taken once, as the earliest document's.
        same = content_hashes(data, at, size)
        order = np.lexsort((doc, size, same, low))
        new = np.ones(len(order), bool)
        for values in (low, same, size):
            new[1:] &= values[order][1:] == values[order][:-1]
        new[1:] = ~new[1:]
        kind = np.empty(len(order), np.int64)
        kind[order] = np.cumsum(new) - 1
        lead = order[new]
        # A minimizer with but one kind of stretch needs no index: later documents lose all of it.
        _, group_of, kinds = np.unique(low[lead], return_inverse=True, return_counts=True)
        single = kinds[group_of] == 1
        all_lost = single[kind] & (doc > doc[lead][kind])
        spans.append((node[all_lost], start[all_lost], start[all_lost] + size[all_lost]))
        mixed_kinds = np.flatnonzero(~single)
        chunk = low[lead[mixed_kinds]] % np.uint64(1 + int(size[lead[mixed_kinds]].sum()) // INDEX_BYTES)
        members = np.argsort(kind, kind="stable")
        bounds = np.searchsorted(kind[members], np.arange(len(lead) + 1))
        for _, part in split_by(chunk):
            part = mixed_kinds[part]
            count = bounds[part + 1] - bounds[part]
            rows = members[np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count - bounds[part], count)]
            index = RunLengthIndex(cut_out(data, at[lead[part]], size[lead[part]]), size[lead[part]])
            earliest = index.earliest(np.repeat(doc[lead[part]], size[lead[part]] + 1))
            begin = np.repeat(np.cumsum(size[lead[part]] + 1) - size[lead[part]] - 1, count)
            owner, head, end = lost_runs(earliest, begin, doc[rows], start[rows], many[rows])
            spans.append((node[rows][owner], head, end))
    node, start, end = (np.concatenate(x) for x in zip(*spans))
    order = np.lexsort((start, node))
    node, start, end = node[order], start[order], end[order]
    # Runs that overlap are one; a document's come one after another, so each is moved beyond those before.
    other = np.ones(len(node), bool)
    other[1:] = node[1:] != node[:-1]
    shift = np.cumsum(other) << 32
    reach = np.maximum.accumulate(end + shift)
    head = np.ones(len(node), bool)
    head[1:] = start[1:] + shift[1:] > reach[:-1]
    at = np.flatnonzero(head)
    last = reach[np.append(at[1:], len(node))[: len(at)] - 1] - shift[at]
    return pa.RecordBatch.from_arrays([pa.array(node[at], pa.int64()), pa.array((start[at] << 32) + last, pa.int64())], names=["node", "span"])


def lost_runs(low: np.ndarray, begin: np.ndarray, doc: np.ndarray, start: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, ...]:
    """Which stretch loses which bytes of its document; its strings' earliest documents stand in ``low`` from ``begin`` on."""
    # A stretch's strings, each with the smallest document that holds it.
    string = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    owner = np.repeat(np.arange(len(many)), many)
    lost = low[begin[owner] + string] < doc[owner]
    owner, place = owner[lost], string[lost] + start[owner[lost]]
    cut = np.ones(len(owner), bool)
    cut[1:] = (owner[1:] != owner[:-1]) | (place[1:] != place[:-1] + 1)
    head = np.flatnonzero(cut)
    tail = np.append(head[1:], len(owner))[: len(head)] - 1
    return owner[head], place[head], place[tail] + LENGTH


def merged(spans: list[int]) -> np.ndarray:
    """Maximal runs of the bytes that ``spans`` cover, as rows of begin and end; a span is begin * 2**32 + end."""
    both = np.sort(np.array(spans, np.int64))
    both = np.stack([both >> 32, both & (2**32 - 1)], 1)
    reach = np.maximum.accumulate(both[:, 1])
    new = np.ones(len(both), bool)
    new[1:] = both[1:, 0] > reach[:-1]
    head = np.flatnonzero(new)
    return np.stack([both[head, 0], reach[np.append(head[1:], len(both)) - 1]], 1)


def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for node, packed_text, size, spans in zip(*(batch.column(i).to_pylist() for i in range(4))):
            text = pa.Codec("zstd").decompress(packed_text, size, asbytes=True)
            runs = merged(spans)
            cells = runs.astype("<u4").tobytes()
            kept = without(text, cells)
            out.append((node, int((runs[:, 1] - runs[:, 0]).sum()), cells, hashlib.sha256(kept).hexdigest(), kept))
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.binary()]
        columns = zip(*out) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["node", "n_removed", "runs", "kept_sha256", "kept"])


def squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codec = pa.Codec("zstd", 3)
    for batch in batches:
        texts = [(t or "").encode() for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([codec.compress(t, asbytes=True) for t in texts], pa.binary()), pa.array([len(t) for t in texts], pa.int64())],
            names=["node", "id", "packed", "size"],
        )


def joined_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        runs = [merged(spans).astype("<u4").tobytes() for spans in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(runs, pa.binary())], names=["node", "runs"])


def row_name(text: str, id_column: str) -> Column:
    """A hash that tells rows of different id or text apart."""
    body = F.coalesce(quoted(text).cast("string"), F.lit(""))
    return F.xxhash64(quoted(id_column).cast("bigint"), F.unhex(F.sha2(body.cast("binary"), 256)))


def searched(docs: DataFrame, text: str, id_column: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows without texts, the texts (compressed) of those that share a minimizer, and the spans that these lose."""
    body = F.coalesce(quoted(text).cast("string"), F.lit(""))
    base = docs.select(quoted(id_column).cast("bigint").alias("id"), body.alias("text"), row_name(text, id_column).alias("node"))
    base = base.withColumn("key", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    light = durable(base.select("id", "key", "node", F.octet_length("text").cast("bigint").alias("n_bytes")))
    total = light.agg(F.sum("n_bytes")).first()[0] or 0
    firsts = durable(light.where("id is not null").groupBy("key").agg(F.min("id").alias("first")))
    light = durable(light.join(firsts, "key", "left"))
    eligible = base.where(F.col("id").isNotNull() & (F.octet_length("text") >= LENGTH))

    # Parts are multiples of the shuffle's, so that tasks get equal shares of them.
    parts = 1 + total // PART_BYTES
    offers = eligible.select("node", "text", F.xxhash64("key").alias("content"), "id")
    offers = offers.mapInArrow(offered(parts), "part int, settled boolean, nodes binary, contents binary, who binary, low binary")
    shared = grouped(offers, ["part"], answered, "node bigint, low bigint").groupBy("node").agg(F.collect_list("low").alias("low"))
    # A copy of an earlier document goes as a whole.
    lone = light.where("id = first").select("node").distinct()
    shared = shared.join(lone, "node", "left_semi")
    small = eligible.select("node", "id", "text").mapInArrow(squeezed, "node bigint, id bigint, packed binary, size bigint")
    # Rows that repeat an id and text are one; the join has them in one place already.
    chosen = durable(small.join(shared, "node").dropDuplicates(["node"]))
    stretch = chosen.agg(F.sum("size")).first()[0] or 0
    parts = 1 + stretch // DEAL_BYTES
    deal = chosen.mapInArrow(dealt(parts), "part int, settled boolean, nodes binary, docs binary, who binary, start binary, many binary, low binary, bytes binary")
    lost = grouped(deal, ["part"], compared, "node bigint, span bigint").groupBy("node").agg(F.collect_list("span").alias("spans"))
    return light, chosen, lost


def whole_rows() -> tuple[Column, Column]:
    """Whether a row is a copy of an earlier one, which goes as a whole; and its one run."""
    digits = F.lpad(F.hex("n_bytes"), 8, "0")
    run = F.unhex(F.concat(F.lit("00000000"), *(F.substring(digits, i, 2) for i in (7, 5, 3, 1))))
    return (F.col("id") > F.col("first")) & (F.col("n_bytes") >= LENGTH), run


def repeats(docs: DataFrame, text: str = "text", id_column: str = "doc_id", with_kept: bool = True) -> DataFrame:
    """Per row of ``docs``: the id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``, ``runs`` (removed bytes as
    little-endian 32-bit pairs of begin and end) and, if asked for, ``kept``: the remaining bytes, null if they are all.

    A byte goes if a string of 50 bytes over it also starts in a document of smaller id.  Null counts as empty.  A row
    without id is left whole and costs no other row anything; rows of equal id cost one another nothing.
    """
    light, chosen, lost = searched(docs, text, id_column)
    lost = chosen.select("node", "packed", "size").join(durable(lost), "node")
    lost = lost.mapInArrow(trimmed, "node bigint, n_removed bigint, runs binary, kept_sha256 string, kept binary")
    if not with_kept:
        lost = lost.drop("kept")
    whole, all_of_it = whole_rows()
    out = light.join(durable(lost), "node", "left").select(
        F.col("id").alias(id_column),
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce(F.octet_length("runs") / 8, F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(whole, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("key")))).alias("kept_sha256"),
        F.when(whole, all_of_it).otherwise(F.coalesce("runs", F.lit(b""))).alias("runs"),
        *([F.when(whole, F.lit(b"")).otherwise(F.col("kept")).alias("kept")] if with_kept else []),
    )
    return out


def removed_runs(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """``node`` (the ``row_name`` of rows) and ``runs`` as ``repeats`` has them, once each and only where bytes go.

    For those who hold the texts themselves: none is moved again.
    """
    light, _, lost = searched(docs, text, id_column)
    whole, all_of_it = whole_rows()
    copies = light.where(whole).select("node", all_of_it.alias("runs")).distinct()
    return lost.mapInArrow(joined_runs, "node bigint, runs binary").union(copies)


def without(text: bytes, runs: bytes) -> bytes:
    """What is left of ``text`` without ``runs``."""
    pairs = np.frombuffer(runs, "<u4").reshape(-1, 2)
    return b"".join(text[a:b] for a, b in zip([0, *pairs[:, 1].tolist()], [*pairs[:, 0].tolist(), len(text)]))


def op9_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return repeats(table(spark, folder, "documents"), with_kept=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
