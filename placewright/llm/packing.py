"""Harmonic packing of tokenised documents into sequences of fixed capacity.

A document is the ids of its text and a closing id. What fills whole sequences is cut off first. The rest is cut to
reciprocal lengths: a piece of capacity // k tokens belongs to class k, whose bins take exactly k pieces and so are
full but for the k-1 tokens of rounding. A rest within SLACK of its class's length is left whole; otherwise its first
capacity // k tokens become a piece and what remains is cut the same way, until it is shorter than the smallest class,
capacity // CLASSES. Cuts depend on the document's length alone.

Pieces (some 50 bytes each, no texts or ids) are dealt to lanes by a hash of the document, as many lanes as keep about
LANE_PIECES pieces each. Each lane fills the bins of each class by itself. What is left in a lane - fewer than k pieces
of each class, and the short rests - goes into the gaps best-fit by decreasing length, so a lane wastes about one bin.
Sequence ids are the lane times 2^32 plus the bin's number in its lane.

Defined cases: a null text is empty, and an empty document is the closing id alone. A null doc_id is dealt like any
other. Repeated rows are packed each. Very long texts are tokenised whole. An empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewright.llm.common import groups_for, written

CAPACITY, CLASSES, SLACK = 2048, 32, 0.01
CLOSING_ID = 1
LANE_PIECES = 200_000
#: Text units whose ids a worker keeps at once, some 100 MB.
KEPT_UNITS = 500_000

# The split pattern of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

PIECE_FIELDS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class UnitIds(dict):
    """Ids (little-endian unsigned 32-bit) of text units, each of them the text after a single space up to the next.

    Byte-level BPE always begins a token at a space between two visible characters, so the ids of a text cut at such
    spaces are its units' ids in order, and a unit seen before needs no second merge. The ids are those of the
    `tokenizers` file: units are merged by the same vocabulary's ranks, which does it several times faster, and texts
    with a special token's string go through `tokenizers` whole. So do all texts where the file is of another kind.
    """

    CUT = re.compile(r"(?<=\S) (?=\S)")
    #: Blanks side by side, or at an end: such a text is cut with care.
    MIXED = re.compile(r"\s\s|^\s|\s$")

    def __init__(self, path: str):
        import tiktoken
        import tokenizers

        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        ranks = merge_ranks(path)
        self.merge = tiktoken.Encoding("units", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary if ranks else None

    def __missing__(self, unit: str) -> bytes:
        if len(self) >= KEPT_UNITS:
            self.clear()
        ids = self[unit] = array("I", self.merge(" " + unit)).tobytes()
        return ids

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        if self.merge is None or any(s in text for s in self.specials):
            return self.whole(text)
        first, *rest = self.CUT.split(text) if self.MIXED.search(text) else text.split(" ")
        return array("I", self.merge(first)).tobytes() + b"".join(map(self.__getitem__, rest))


def cuts(tokens: int, capacity: int = CAPACITY, classes: int = CLASSES, slack: float = SLACK) -> list[int]:
    """Lengths of a document's pieces, in order."""
    out = [capacity] * (tokens // capacity)
    rest = tokens % capacity
    while rest:
        k = capacity // rest  # the class whose pieces are long enough for all of the rest
        if k >= classes or rest >= (1 - slack) * (capacity // k):
            out.append(rest)
            break
        out.append(capacity // (k + 1))
        rest -= capacity // (k + 1)
    return out


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 bytes stand for themselves, the others for the characters from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def merge_ranks(path: str) -> dict[bytes, int] | None:
    """A tokenizer file's vocabulary as ranks, if it is plain byte-level BPE with the usual split and ids in order of merging; else None."""
    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    model, split = whole["model"], whole.get("pre_tokenizer") or {}
    odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    if model.get("type") != "BPE" or any(map(model.get, odd)) or whole.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        return None
    vocabulary, added = model["vocab"], {t["content"] for t in whole.get("added_tokens", [])}
    merged = [vocabulary.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
    single = [i for token, i in vocabulary.items() if len(token) == 1]
    if any(a >= b for a, b in zip([max(single), *merged], merged)):
        return None
    # tokens under the byte alphabet of byte-level BPE
    shown = dict(zip(byte_alphabet(), range(256), strict=True))
    if not all(c in shown for token in vocabulary if token not in added for c in token):
        return None
    return {bytes(shown[c] for c in token): i for token, i in vocabulary.items() if token not in added}


def piece_rows(tokenizer: str):
    """Arrow function: (doc_id, text) batches to piece rows."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = UnitIds(tokenizer)
        closing = np.array([CLOSING_ID], "<u4").tobytes()
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            docs, starts, lengths, crcs, totals = [], [], [], [], []
            for doc, ids in zip(batch.column(0).to_pylist(), map(ids_of.encode, texts), strict=True):
                ids += closing
                at, total = 0, len(ids) // 4
                for n in cuts(total):
                    docs.append(doc)
                    starts.append(at)
                    lengths.append(n)
                    crcs.append(zlib.crc32(ids[4 * at : 4 * (at + n)]))
                    totals.append(total)
                    at += n
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (docs, starts, lengths, crcs, totals)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return pieces


def fill(lengths: np.ndarray, capacity: int = CAPACITY, classes: int = CLASSES) -> np.ndarray:
    """The bin of each piece of one lane."""
    bins = np.full(len(lengths), -1, np.int64)
    k = capacity // lengths
    used = 0
    for c in range(1, classes):
        of = np.nonzero(k == c)[0]
        full = len(of) // c * c
        bins[of[:full]] = used + np.arange(full) // c
        used += full // c
    # leftovers and short rests, longest first, each into the fullest bin that has room
    room: list[tuple[int, int]] = []
    if used:
        taken = np.bincount(bins[bins >= 0], lengths[bins >= 0], used).astype(int)
        room = sorted((capacity - int(t), b) for b, t in enumerate(taken) if t < capacity)
    left = np.nonzero(bins < 0)[0]
    for i in left[np.argsort(-lengths[left], kind="stable")]:
        n = int(lengths[i])
        at = bisect_left(room, (n, -1))
        free, b = room.pop(at) if at < len(room) else (capacity, used)
        used += b == used
        bins[i] = b
        if free > n:
            insort(room, (free - n, b))
    return bins


def pack_lane(part: pd.DataFrame) -> pd.DataFrame:
    part = part.sort_values(["doc_id", "start", "length", "ids_crc32"], kind="stable", ignore_index=True)
    part["bin"] = fill(part["length"].to_numpy())
    part = part.sort_values("bin", kind="stable", ignore_index=True)
    before = part.groupby("bin")["length"].cumsum() - part["length"]
    return part.assign(sequence_id=part["lane"] * (1 << 32) + part["bin"], offset=before)[[*PACKED]]


PACKED = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", lane_pieces: int = LANE_PIECES) -> DataFrame:
    """One row for each piece: which ids of which document it holds, and its sequence and offset there."""
    pieces = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text")).mapInArrow(piece_rows(tokenizer), PIECE_FIELDS)
    pieces = written(pieces, "pieces")  # tokenised once, though counted and packed
    lanes = groups_for(pieces.count(), lane_pieces)
    lane = F.pmod(F.xxhash64("doc_id", "doc_tokens"), F.lit(lanes)).cast("long")
    return pieces.withColumn("lane", lane).groupBy("lane").applyInPandas(pack_lane, PIECE_FIELDS + ", sequence_id long, offset long")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), tokenizer_path()).select(*PACKED)
