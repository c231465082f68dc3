"""Fill-in-the-middle: documents cut at two line borders and put out with markers, prefix-suffix-middle or suffix-prefix-middle.

The borders of a document's units are a set of code point positions, kept as in a compressed bitmap: positions that share
their high 16 bits are one container, which is a sorted array, a bitmap or a list of runs, whichever is least, and the
containers know how many positions lie before them. The offset of the k-th border is found by a search over the containers
and a select inside one, so both cuts come from the same small structure.

What is cut and how is decided by the SHA-256 of a seed and doc_id alone, so a run on other partitions, or again after a lost
executor, gives the same rows. Null texts count as empty; empty texts and texts that hold a marker are left plain; a null
doc_id counts as an empty number; repeated rows give repeated rows. Other columns, whatever their names, are neither read nor
returned. An empty table gives no rows. A task holds one Arrow batch of texts, and hands its results on in parts.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, table

MARKERS = ("<P>", "<S>", "<M>")
#: A container holds the positions that share their high bits: 2^16 of them at most.
BITS = 16
#: An array takes two bytes a position, a bitmap 8,192 bytes, a run four.
BITMAP_BYTES, RUN_BYTES = 8192, 4
#: Code points of output after which a task hands on what it has.
PART_CHARS = 8_000_000
ROWS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


@dataclass(frozen=True)
class Container:
    """Positions 0 to 65,535: `values` are the positions, the 64-bit words of a bitmap, or the starts of runs.

    `upto`: how many positions the words or runs up to each one hold, itself included.
    """

    kind: str
    values: np.ndarray
    upto: np.ndarray | None = None

    @classmethod
    def of(cls, low: np.ndarray) -> Container:
        starts = np.flatnonzero(np.diff(low, prepend=-2) != 1)
        if RUN_BYTES * len(starts) < min(2 * len(low), BITMAP_BYTES):
            return cls("run", low[starts], np.append(starts[1:], len(low)))
        if 2 * len(low) <= BITMAP_BYTES:
            return cls("array", low.astype(np.uint16))
        bits = np.zeros(1 << BITS, np.uint8)
        bits[low] = 1
        words = np.packbits(bits, bitorder="little").view("<u8")
        return cls("bitmap", words, np.cumsum(np.bitwise_count(words), dtype=np.int64))

    def select(self, k: int) -> int:
        """The position with k positions before it."""
        if self.kind == "array":
            return int(self.values[k])
        at = int(np.searchsorted(self.upto, k, "right"))
        rest = k - (int(self.upto[at - 1]) if at else 0)
        if self.kind == "run":
            return int(self.values[at]) + rest
        word = int(self.values[at])
        for _ in range(rest):
            word &= word - 1
        return 64 * at + (word & -word).bit_length() - 1


class Borders:
    """A set of positions: containers by their high bits, and the number of positions before each."""

    def __init__(self, positions: np.ndarray):
        high = positions >> BITS
        first = np.flatnonzero(np.diff(high, prepend=-1))
        self.keys = high[first]
        self.before = np.append(first, len(positions))
        self.containers = [Container.of(positions[a:b] & (1 << BITS) - 1) for a, b in zip(first, self.before[1:])]

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.before, k, "right")) - 1
        return (int(self.keys[at]) << BITS) + self.containers[at].select(k - int(self.before[at]))


def borders_of(text: str) -> Borders:
    """Where each line of the text ends, in code points; the last line may lack its line feed."""
    ends = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4") == 10) + 1
    return Borders(ends if text.endswith("\n") or not text else np.append(ends, len(text)))


def chances(seed: int, doc_id: int | None) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i:i + 4], "big") for i in (0, 4, 8, 12)]


def cut(doc_id: int | None, text: str | None, seed: int, rate: int, spm: int, markers: tuple[str, str, str]) -> tuple:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of one document."""
    text = text or ""
    borders, (h1, h2, h3, h4) = borders_of(text), chances(seed, doc_id)
    n = len(borders)
    if not text or h3 % 100 >= rate or any(m in text for m in markers):
        return doc_id, n, "plain", None, None, text
    a, b = (borders.select(k - 1) if k else 0 for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    p, s, m = markers
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    form, output = ("spm", f"{s}{suffix}{p}{prefix}{m}{middle}") if h4 % 100 < spm else ("psm", f"{p}{prefix}{s}{suffix}{m}{middle}")
    return doc_id, n, form, a, b - a, output


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): each document once, of `rate` percent cut, of these `spm` percent suffix first."""
    names = [f.split()[0] for f in ROWS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def part(rows: list[tuple]) -> pa.RecordBatch:
        return batch_of(**{name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(zip(names, kinds))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, chars = [], 0
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                rows.append(cut(doc_id.as_py(), text.as_py(), seed, rate, spm, markers))
                chars += len(rows[-1][-1])
                if chars > PART_CHARS:
                    yield part(rows)
                    rows, chars = [], 0
            if rows:
                yield part(rows)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ROWS)


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that an output of this form was made of; the markers alone say where its parts lie."""
    p, s, m = (F.locate(x, output) for x in markers)
    inside = lambda start, marker, end: F.substr(output, start + len(marker), end - start - len(marker))
    middle = F.substr(output, m + len(markers[2]))
    psm = F.concat(inside(p, markers[0], s), middle, inside(s, markers[1], m))
    spm = F.concat(inside(p, markers[0], m), middle, inside(s, markers[1], p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
