"""Removal of repeated byte strings across documents, by threshold-bounded interval expansion on a Burrows-Wheeler transform.

A byte goes if a string of SPAN bytes that covers it also starts in a document with a smaller id. The work is to find,
over all documents, which strings of SPAN bytes occur in several of them, without moving every string.

1. Anchors: of the GRAM-byte strings inside each SPAN-byte window the one with the smallest hash is the window's anchor (the
   leftmost on ties), about one for each fourteen bytes. Equal windows have equal anchors. Documents are dealt into
   blocks of about BLOCK_BYTES by a hash of the id; a block sends each distinct anchor hash once, with a mark if two of
   its documents hold it and the number of its contexts, to the hash's bucket. Buckets answer with the hashes that several
   documents hold, and with those that have over MOST_CONTEXTS contexts (wide anchors).
2. Contexts: around each such anchor, the stretch of text that its windows cover. A block sends each distinct context once, with the
   smallest id that has it, to its anchor's bucket. A passage that a third of all documents share is thus one row a block.
   Around a wide anchor each window is a context of its own and goes to the bucket of its own hash, so no task
   gathers all that surrounds a frequent phrase.
3. In a bucket, contexts of an anchor that differ are joined to one text and its Burrows-Wheeler transform is expanded: intervals of suffixes that
   share a string of 7, 8, 9, ... bytes are extended backwards by every character at once, breadth first; intervals of one suffix are
   dropped; after SPAN steps each interval is a set of equal windows. The windows of a set that start in a document
   larger than the set's smallest id are repeats.
4. Each block gets a mask for each of its contexts, marks the bytes and removes them.

Steps 1, 2 and 4 read the same shuffle of the texts. All sizes follow the block and bucket size, whatever the input.

Defined cases: a null text is empty; documents of under SPAN bytes keep all. Documents with the same id don't count as
smaller than each other; a null id is larger than all others. Repeated rows are rows of their own. An empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPAN, GRAM = 50, 24
BLOCK_BYTES, BUCKET_BYTES = 3 << 20, 8 << 20
#: Contexts (of at most 76 bytes) of one anchor that meet in one task; those of anchors with more are dealt window by window.
MOST_CONTEXTS = 32_768
NO_ID = (1 << 63) - 1

#: Odd factors of the eight-byte words of a hashed string (SPAN + SPAN - GRAM bytes at most).
FACTORS = np.random.default_rng(50).integers(0, 1 << 64, 10, dtype=np.uint64) | np.uint64(1)
#: Low bits of a running minimum that hold a position; the same for every block, so that all blocks break ties alike.
PLACE_BITS = 31
#: Bytes of an anchor's hash that are kept: anchors that share them by chance only cost a comparison.
HASH_BYTES = 6
#: Windows whose minima are taken at once, so that they stay in the processor's cache.
STRETCH = 1 << 15


def mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def words_of(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as numbers."""
    return np.ndarray((max(0, len(text) - 7),), "<u8", np.ascontiguousarray(text), strides=(1,))


def gram_hashes(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of the GRAM bytes at some positions."""
    h = words[at] * FACTORS[0]
    for i in range(8, GRAM, 8):
        h += words[at + i] * FACTORS[i // 8]
    return mix(h)


def string_words(words: np.ndarray, first: np.ndarray, length: np.ndarray) -> Iterator[np.ndarray]:
    """Words that together hold the strings of SPAN bytes or more that begin at `first`; the last word of each overlaps the one before."""
    for i in range(-(-(2 * SPAN - GRAM) // 8)):
        yield words[first + np.minimum(8 * i, length - 8)]


def window_minima(words: np.ndarray, n: int) -> np.ndarray:
    """For each of n windows of SPAN bytes the smallest of its grams' hashes, cut, above the position of that gram."""
    wide = SPAN - GRAM + 1
    out = np.empty(n, np.uint64)
    for begin in range(0, n, STRETCH):
        many = min(STRETCH, n - begin)
        own = np.ascontiguousarray(words[begin : begin + many + SPAN - 8])
        m = many + wide - 1
        value = own[:m] * FACTORS[0]
        for i in range(8, GRAM, 8):
            value += own[i : i + m] * FACTORS[i // 8]
        mix(value)
        # high bits of the hash above the position: the smallest hash, the leftmost of equals
        value >>= np.uint64(PLACE_BITS)
        value <<= np.uint64(PLACE_BITS)
        value |= np.arange(begin, begin + m, dtype=np.uint64)
        reach = 1
        while reach < wide:
            step = min(reach, wide - reach)
            value = np.minimum(value[:-step], value[step:])
            reach += step
        out[begin : begin + many] = value
    return out


def runs(values: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins."""
    return np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)


def window_anchors(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, windows) of each anchor of texts that lie end to end; windows that cross an end have none.

    An anchor's windows start at consecutive positions."""
    n = len(text) - SPAN + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    words = words_of(text)
    best = window_minima(words, n)
    first = np.flatnonzero(best[1:] != best[:-1]) + 1
    # a run of windows is broken where windows begin to cross an end, and at the end
    first = np.sort(np.concatenate([[0], first, ends - SPAN + 1, ends]), kind="stable")
    first = first[runs(first)]
    first = first[(first >= 0) & (first < n)]
    count = np.diff(np.r_[first, n])
    inside = first + SPAN <= ends[np.searchsorted(ends, first, "right")]
    first, count = first[inside], count[inside]
    hashes = gram_hashes(words, (best[first] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64))
    return hashes >> np.uint64(64 - 8 * HASH_BYTES), first, count


class Block:
    """The documents of one block in order of id, end to end, and their anchors."""

    def __init__(self, ids: list[int | None], texts: list[bytes | None]):
        order = sorted(range(len(ids)), key=lambda i: (NO_ID if ids[i] is None else ids[i], texts[i] or b""))
        self.ids = [ids[i] for i in order]
        self.texts = [texts[i] or b"" for i in order]
        self.key = np.array([NO_ID if i is None else i for i in self.ids], np.int64)
        self.ends = np.cumsum([len(t) for t in self.texts]).astype(np.int64)
        self.text = np.frombuffer(b"".join(self.texts), np.uint8)
        self.words = words_of(self.text)
        self.hash, self.first, self.count = window_anchors(self.text, self.ends)
        self.doc = np.searchsorted(self.ends, self.first, "right")

    def strings(self, first: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Hashes of contexts: of the text of `count` windows from `first` on."""
        h = count.astype(np.uint64)
        for factor, word in zip(FACTORS, string_words(self.words, first, count + SPAN - 1)):
            h += word * factor
        return mix(h)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchor hashes, and for each twice the number of its contexts, plus one if documents of different ids hold it."""
        order = np.argsort(self.hash)
        h = self.hash[order]
        new = runs(h)
        size = np.diff(np.r_[new, len(h)])
        held = np.full(len(new), 2, np.int64)
        several = np.flatnonzero(size > 1)
        if len(several):
            of = order[np.repeat(size > 1, size)]
            group = np.repeat(np.arange(len(several)), size[several])
            context = self.strings(self.first[of], self.count[of])
            by = np.lexsort((context, group))
            context = context[by]
            start = np.cumsum(size[several]) - size[several]
            other = np.r_[True, context[1:] != context[:-1]]
            other[start] = True
            key = self.key[self.doc[of]]
            apart = np.minimum.reduceat(key, start) != np.maximum.reduceat(key, start)
            held[several] = np.minimum(np.add.reduceat(other.astype(np.int64), start), 32_767) * 2 + apart
        return h[new], held.astype("<u2")

    def contexts(self, shared: np.ndarray, wide: np.ndarray):
        """Of anchors whose hash is shared: each occurrence's first window, number of windows, document and context number, and each context's hash and an occurrence in the smallest id.

        A context is the text from its first window's start to its last window's end; around wide anchors each window is one."""
        of = np.flatnonzero(np.isin(self.hash, shared))
        hash_, first, count, doc = self.hash[of], self.first[of], self.count[of], self.doc[of]
        if len(of) and len(wide):
            split = np.isin(hash_, wide)
            parts = np.where(split, count, 1)
            source = np.repeat(np.arange(len(of)), parts)
            split, doc = split[source], doc[source]
            first = first[source] + np.arange(len(source)) - (np.cumsum(parts) - parts)[source]
            count = np.where(split, 1, count[source])
            hash_ = np.where(split, self.strings(first, np.ones(len(first), np.int64)) >> np.uint64(64 - 8 * HASH_BYTES), hash_[source])
        if not len(first):
            return (first, count, doc, first), hash_, first
        # documents come in order of id, so a context's first occurrence has its smallest id
        _, one, which = np.unique(mix(self.strings(first, count) * FACTORS[0] + hash_), return_index=True, return_inverse=True)
        same = (hash_ == hash_[one][which]) & (count == count[one][which])
        length = count + SPAN - 1
        for a, b in zip(string_words(self.words, first, length), string_words(self.words, first[one], length[one])):
            same &= a == b[which]
        if not same.all():  # different contexts of one hash
            data = self.text.tobytes()
            numbers: dict[tuple[int, bytes], int] = {}
            bodies = ((h, data[f : f + n]) for h, f, n in zip(hash_.tolist(), first.tolist(), length.tolist(), strict=True))
            which = np.array([numbers.setdefault(b, len(numbers)) for b in bodies], np.int64)
            _, one = np.unique(which, return_index=True)
        return (first, count, doc, which), hash_[one], one


def equal_windows(texts: list[bytes], span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """(positions, class) of the windows of `span` bytes that occur more than once in the texts, which are laid end to end with a mark after each.

    Suffixes are sorted by `span` characters, and intervals of the Burrows-Wheeler transform are extended backwards, breadth first. The string of
    an interval grows by one character a step, and an interval whose end no shorter string had yields the common prefix at its end: so prefixes are
    found by increasing length. Only such intervals are extended further. It starts at seven bytes, which the first sort gives, and what has no end after
    `span` steps is shared to `span` bytes at least."""
    size = np.array([len(t) for t in texts], np.int64)
    text = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int64) + 1
    marks = np.cumsum(size + 1) - 1
    text[marks] = 0
    n = len(text)
    left = np.repeat(marks, size + 1) - np.arange(n)  # characters up to the mark
    # suffixes in order of seven characters (nine bits each); the last mark is followed by the first text
    start, key = min(7, span), np.zeros(n, np.int64)
    for i in range(start):
        key <<= 9
        key |= np.roll(text, -i)
    order = np.argsort(key)
    key = key[order]
    other = key[1:] != key[:-1]
    sooner = (key[1:] >> 9) != (key[:-1] >> 9)
    first = np.flatnonzero(np.r_[True, other])
    # then by more: rows that are still tied are sorted by the rank of what follows, twice as far each time
    rank, apart, reach = np.empty(n, np.int64), np.r_[True, other], start
    rank[order] = np.repeat(first, np.diff(np.r_[first, n]))
    while reach < span:
        tied = np.flatnonzero(~(apart & np.r_[apart[1:], True]))
        if not len(tied):
            break
        of = order[tied]
        value = rank[of] << 32 | rank[(of + reach) % n]
        by = np.argsort(value)
        of, value = of[by], value[by]
        order[tied] = of
        new = np.r_[True, value[1:] != value[:-1]]
        apart[tied] = new
        rank[of] = np.repeat(tied[new], np.diff(np.r_[np.flatnonzero(new), len(tied)]))
        reach *= 2
    row_of = np.empty(n, np.int64)
    row_of[order] = np.arange(n)
    before = text[order - 1]  # the transform: the character before each suffix
    back = row_of[order - 1]  # the row that a row comes to when its suffix grows by that character
    known = np.r_[True, other, True]  # whether the common prefix of a row and the row before is known, and so shorter than the strings now
    high = np.flatnonzero(np.r_[other & ~sooner, False]) + 1
    low = first[np.searchsorted(first, high - 1, "right") - 1]
    whole = left[order[low]] >= start
    low, high = low[whole], high[whole]
    for _ in range(start, span):
        wide = high - low
        which = np.repeat(np.arange(len(low)), wide)
        rows = np.arange(len(which)) + (low - np.cumsum(wide) + wide)[which]
        char = before[rows]
        alive = char > 0  # no window holds a mark
        which, char, grown = which[alive], char[alive], back[rows[alive]]
        if not len(grown):
            break
        by = np.argsort(grown)
        grown, string = grown[by], which[by] << 9 | char[by]
        new = np.flatnonzero(np.r_[True, (string[1:] != string[:-1]) | (grown[1:] != grown[:-1] + 1)])
        low, high = grown[new], grown[np.r_[new[1:], len(grown)] - 1] + 1
        fresh = ~known[high]
        known[high] = True
        low, high = low[fresh], high[fresh]
    label = np.cumsum(known[:n]) - 1
    held = left[order] >= span
    order, label = order[held], label[held]
    many = np.bincount(label, minlength=1)[label] > 1
    return order[many], label[many]


def hash_bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (hashes % np.uint64(buckets)).astype(np.int64)


def shut(hashes: np.ndarray) -> bytes:
    """Anchor hashes as HASH_BYTES each."""
    return np.ascontiguousarray(hashes, "<u8").view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES].tobytes()


def opened(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // HASH_BYTES, 8), np.uint8)
    out[:, :HASH_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, HASH_BYTES)
    return out.view("<u8").ravel()


def parted(bucket: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Each bucket with the places that go to it, in order."""
    by = np.argsort(bucket, kind="stable")
    return [(int(bucket[of[0]]), of) for of in np.split(by, runs(bucket[by])[1:]) if len(of)]


def block_of(table: pa.Table) -> Block:
    return Block(table["id"].to_pylist(), table["text"].cast(pa.binary()).to_pylist())


def numbers(values: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(values, kind).tobytes()


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES, most_contexts: int = MOST_CONTEXTS) -> DataFrame:
    """id, n_bytes, n_removed, n_spans and kept (the bytes that stay), one row for each row of df."""
    docs = df.select(df[id_col].cast("long").alias("id"), df[text_col].alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    buckets = max(1, -(-total // bucket_bytes)) * 2
    dealt = docs.select(F.pmod(F.xxhash64("id", F.octet_length("text"), F.substring("text", 1, 32)), F.lit(blocks)).cast("int").alias("block"), "id", "text")

    def send_anchors(table: pa.Table) -> pa.Table:
        block, number = block_of(table), table["block"][0].as_py()
        hashes, held = block.anchors()
        rows = [(b, number, shut(hashes[of]), numbers(held[of], "<u2")) for b, of in parted(hash_bucket(hashes, buckets))]
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "block": pa.array([r[1] for r in rows], pa.int32()), "hashes": pa.array([r[2] for r in rows], pa.binary()), "held": pa.array([r[3] for r in rows], pa.binary())})

    anchors = dealt.groupBy("block").applyInArrow(send_anchors, "bucket int, block int, hashes binary, held binary")

    def answer_anchors(table: pa.Table) -> pa.Table:
        from_block = table["block"].to_pylist()
        parts = [opened(x) for x in table["hashes"].to_pylist()]
        hashes = np.concatenate(parts)
        held = np.concatenate([np.frombuffer(x, "<u2") for x in table["held"].to_pylist()])
        in_order = np.argsort(hashes)
        h = hashes[in_order]
        new = np.r_[True, h[1:] != h[:-1]]
        group = np.cumsum(new) - 1
        shared = np.bincount(group) > 1
        shared |= np.bincount(group, held[in_order] & 1) > 0
        many = np.bincount(group, held[in_order] >> 1) > most_contexts
        flag, broad = np.zeros(len(hashes), bool), np.zeros(len(hashes), bool)
        flag[in_order], broad[in_order] = shared[group], (shared & many)[group]
        at, blocks_, found, wide = 0, [], [], []
        for b, part in zip(from_block, parts, strict=True):
            own = part[flag[at : at + len(part)]]
            if len(own):
                blocks_.append(b)
                found.append(shut(own))
                wide.append(shut(part[broad[at : at + len(part)]]))
            at += len(part)
        return pa.table({"block": pa.array(blocks_, pa.int32()), "hashes": pa.array(found, pa.binary()), "wide": pa.array(wide, pa.binary())})

    shared = anchors.groupBy("bucket").applyInArrow(answer_anchors, "block int, hashes binary, wide binary")

    def send_contexts(table: pa.Table, answers: pa.Table) -> pa.Table:
        names = ("bucket", "block", "hashes", "lengths", "least", "bodies")
        kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 4)
        rows = []
        if table.num_rows and answers.num_rows:
            found, wide = (np.concatenate([opened(x) for x in answers[c].to_pylist()]) for c in ("hashes", "wide"))
            block, number = block_of(table), table["block"][0].as_py()
            (first, count, doc, _), hashes, one = block.contexts(found, wide)
            first, length, least = first[one], count[one] + SPAN - 1, block.key[doc[one]]
            for b, of in parted(hash_bucket(hashes, buckets)):
                n = length[of]
                body = block.text[np.repeat(first[of] - np.cumsum(n) + n, n) + np.arange(n.sum())].tobytes()
                rows.append((b, number, shut(hashes[of]), numbers(n, "u1"), zstandard.compress(numbers(least[of], "<i8"), 3), zstandard.compress(body, 3)))
        return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))})

    contexts = dealt.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(
        send_contexts, "bucket int, block int, hashes binary, lengths binary, least binary, bodies binary"
    )

    def answer_contexts(table: pa.Table) -> pa.Table:
        block, number, hashes, bodies, least = [], [], [], [], []
        bucket = table["bucket"][0].as_py()
        for b, h, ls, ids, data in zip(*(table[c].to_pylist() for c in ("block", "hashes", "lengths", "least", "bodies")), strict=True):
            lengths, data = np.frombuffer(ls, "u1").astype(np.int64), zstandard.decompress(data)
            ends = np.cumsum(lengths)
            bodies += [data[e - k : e] for e, k in zip(ends.tolist(), lengths.tolist(), strict=True)]
            block.append(np.full(len(lengths), b))
            number.append(np.arange(len(lengths)))
            hashes.append(opened(h))
            least.append(np.frombuffer(zstandard.decompress(ids), "<i8"))
        block, number, hashes, least = map(np.concatenate, (block, number, hashes, least))
        masks = repeat_masks(hashes, bodies, least)
        out = {"block": [], "bucket": [], "numbers": [], "masks": []}
        set_ = np.flatnonzero(masks > 0)
        for b, of in parted(block[set_]):
            out["block"].append(b)
            out["bucket"].append(bucket)
            out["numbers"].append(numbers(number[set_[of]], "<i4"))
            out["masks"].append(numbers(masks[set_[of]], "<u4"))
        return pa.table({"block": pa.array(out["block"], pa.int32()), "bucket": pa.array(out["bucket"], pa.int32()), "numbers": pa.array(out["numbers"], pa.binary()), "masks": pa.array(out["masks"], pa.binary())})

    answers = contexts.groupBy("bucket").applyInArrow(answer_contexts, "block int, bucket int, numbers binary, masks binary")
    # a block needs its shared hashes again, to number its contexts as before
    replies = shared.select("block", F.lit(-1).alias("bucket"), F.col("wide").alias("numbers"), F.col("hashes").alias("data")).unionByName(
        answers.select("block", "bucket", "numbers", F.col("masks").alias("data"))
    )

    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "n_bytes": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "n_spans": pa.array([], pa.int64()), "kept": pa.array([], pa.binary())})
        block = block_of(table)
        gone = np.zeros(len(block.text), bool)
        pairs = list(zip(*(answers[c].to_pylist() for c in ("bucket", "numbers", "data")), strict=True))
        found = [(opened(d), opened(n)) for b, n, d in pairs if b < 0]
        if found:
            (first, count, doc, which), hashes, one = block.contexts(*map(np.concatenate, zip(*found)))
            masks, places = np.zeros(len(one), np.uint32), dict(parted(hash_bucket(hashes, buckets)))
            for b, n, d in pairs:
                if b >= 0:  # numbers count the block's contexts in that bucket
                    masks[places[b][np.frombuffer(n, "<i4")]] = np.frombuffer(d, "<u4")
            # a document that isn't the first of the block to have a context repeats all its windows
            own = masks[which]
            later = block.key[doc] > block.key[doc[one]][which]
            full = ((np.uint64(1) << count.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)
            own = np.where(later, full, own)
            first, own = first[own > 0], own[own > 0]
            starts = np.concatenate([first[(own >> np.uint32(i)) & np.uint32(1) > 0] + i for i in range(SPAN - GRAM + 1)])
            change = np.bincount(starts, minlength=len(gone) + 1)[: len(gone) + 1] - np.bincount(starts + SPAN, minlength=len(gone) + 1)[: len(gone) + 1]
            gone = np.cumsum(change[:-1]) > 0
        rows = []
        start = 0
        for i, end in zip(block.ids, block.ends.tolist(), strict=True):
            part = gone[start:end]
            spans = int(part[:1].sum() + (part[1:] & ~part[:-1]).sum()) if end > start else 0
            rows.append((i, end - start, int(part.sum()), spans, block.text[start:end][~part].tobytes()))
            start = end
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(("id", "n_bytes", "n_removed", "n_spans", "kept"), kinds, strict=True))})

    done = dealt.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(remove, "id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return done.withColumnRenamed("id", id_col)


def repeat_masks(hashes: np.ndarray, bodies: list[bytes], least: np.ndarray) -> np.ndarray:
    """For each context, bit i is set if its window i also starts in a document smaller than the context's own smallest."""
    ids: dict[tuple[int, bytes], int] = {}
    which = np.array([ids.setdefault((h, b), len(ids)) for h, b in zip(hashes.tolist(), bodies, strict=True)], np.int64)
    kinds = list(ids)
    smallest = np.full(len(kinds), NO_ID, np.int64)
    np.minimum.at(smallest, which, least)
    windows = np.array([len(b) - SPAN + 1 for _, b in kinds], np.int64)
    # windows of contexts that are the same in a smaller document
    masks = np.where(least > smallest[which], ((np.int64(1) << windows[which]) - 1), 0).astype(np.uint32)
    anchor = np.array([h for h, _ in kinds], np.uint64)
    order = np.argsort(anchor, kind="stable")
    bounds = np.flatnonzero(np.r_[True, anchor[order][1:] != anchor[order][:-1], True])
    several = np.zeros(len(kinds), bool)
    sizes = np.diff(bounds)
    several[order] = np.repeat(sizes > 1, sizes)
    open_ = np.flatnonzero(several)  # an anchor with one kind of context has no other windows to compare
    for part in chunks(anchor, open_, bodies=[kinds[i][1] for i in open_]):
        texts = [kinds[i][1] for i in part]
        position, label = equal_windows(texts)
        if not len(position):
            continue
        starts = np.cumsum([0, *[len(t) + 1 for t in texts]])
        kind = np.searchsorted(starts, position, "right") - 1
        offset = position - starts[kind]
        first = np.full(label.max() + 1, NO_ID, np.int64)
        np.minimum.at(first, label, smallest[part[kind]])
        own = np.zeros((len(part), SPAN - GRAM + 1), np.int64)
        own[:] = NO_ID
        np.minimum.at(own, (kind, offset), first[label])
        at = np.full(len(kinds), -1, np.int64)
        at[part] = np.arange(len(part))
        of = np.flatnonzero(at[which] >= 0)
        bits = (own[at[which[of]]] < least[of][:, None]) @ (np.int64(1) << np.arange(SPAN - GRAM + 1))
        masks[of] |= bits.astype(np.uint32)
    return masks


def chunks(anchor: np.ndarray, of: np.ndarray, bodies: list[bytes], most: int = 4 << 20) -> Iterator[np.ndarray]:
    """The contexts `of` in order of anchor, in parts of about `most` bytes that don't divide an anchor's contexts."""
    order = np.argsort(anchor[of], kind="stable")
    part, size, last = [], 0, None
    for i in order.tolist():
        if size >= most and anchor[of[i]] != last:
            yield np.array(part)
            part, size = [], 0
        part.append(of[i])
        size += len(bodies[i]) + 1
        last = anchor[of[i]]
    if part:
        yield np.array(part)


def op10_repeat_removal(spark, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
