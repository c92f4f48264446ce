"""Media columns: any bytes stored losslessly as the coefficients of a progressive JPEG.

A text's UTF-8 bytes, padded with zero bytes to a positive multiple of 64, are read as signed
8-bit coefficients; 64 of them are a block. The blocks of a text are one colour image with halved chroma (4:2:0), of
units of four blocks of Y, one of Cb and one of Cr, up to ``ROW_UNITS`` a row: first all blocks of Y, then those of
Cb and of Cr, the last unit filled up with zeros. The comment segment keeps the unpadded length.

Reading back decodes all scans to coefficients, takes the payload from them, upsamples the chroma and stores the
full-resolution RGB tensor as a column (``with_tensors``); features are computed from that column. Texts are handled in slices of bounded size; one very long text is
encoded slice by slice, as restart intervals stand on their own.

Defined cases: null text is empty (64 zero bytes); repeated rows stay, and ids need not be unique (no
step compares rows, so there are no ties); an empty table gives no rows; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexaudit.llm import jpeg
from lexaudit.llm.common import arrow_map, by_size

ROW_UNITS = 65_535 // 16
#: Sampling factors of Y, Cb and Cr; a unit has as many blocks of each as their product.
FACTORS = [(2, 2), (1, 1), (1, 1)]
UNIT = sum(h * v for h, v in FACTORS)
MAX_BLOCKS = ROW_UNITS * ROW_UNITS * UNIT
SLICE_BYTES = 1_000_000
SLICE_BLOCKS = SLICE_BYTES // 64 // jpeg.RESTART * jpeg.RESTART


def strip(n_blocks: int) -> tuple[int, int]:
    """Rows and columns of units that hold a text's blocks with fewer spare units than rows."""
    units = -(-n_blocks // UNIT)
    rows = -(-units // ROW_UNITS)
    return rows, -(-units // rows)


def pack_texts(texts: list[bytes]) -> list[bytes]:
    """A JPEG of each text's bytes."""
    shapes = [strip(max(1, -(-len(t) // 64))) for t in texts]
    if any(r > ROW_UNITS for r, _ in shapes):
        raise ValueError(f"a text of over {MAX_BLOCKS * 64} bytes exceeds a JPEG's size")
    n_blocks = [r * c * h * v for r, c in shapes for h, v in FACTORS]  # of each component of each text
    n_segs = [-(-n // jpeg.RESTART) for n in n_blocks]
    padded = b"".join(t.ljust(64 * UNIT * r * c, b"\0") for t, (r, c) in zip(texts, shapes, strict=True))
    blocks = np.frombuffer(padded, np.int8).reshape(-1, 64).astype(np.int16)
    within = np.concatenate([np.arange(n) for n in n_blocks])
    seg = np.repeat(np.cumsum(n_segs) - n_segs, n_blocks) + within // jpeg.RESTART
    scans: list[list[bytes]] = [[] for _ in jpeg.SCRIPT]
    at = 0
    while at < len(blocks):
        end = min(at + SLICE_BLOCKS, len(blocks))
        if end < len(blocks):  # a slice ends where an interval does
            end = int(np.searchsorted(seg, seg[end], side="left"))
        here = seg[at:end] - seg[at]
        for all_, some in zip(scans, jpeg.encode_segments(blocks[at:end], here, int(here[-1]) + 1), strict=True):
            all_ += some
        at = end
    edges = np.concatenate([[0], np.cumsum(n_segs)]).tolist()
    own = [[s[a:b] for s in scans] for a, b in zip(edges, edges[1:], strict=False)]
    k = len(FACTORS)
    return [jpeg.assemble(16 * cols, 16 * rows, FACTORS, own[k * i : k * i + k], str(len(t)).encode()) for i, (t, (rows, cols)) in enumerate(zip(texts, shapes, strict=True))]


def unpack(im: jpeg.Image) -> tuple[bytes, int]:
    """Payload (padded) and unpadded length of a decoded image."""
    n = int(im.comment)
    size = max(64, -(-n // 64) * 64)
    return b"".join(c.astype(np.int8).tobytes() for c in im.coefficients)[:size], n


def feature(tensor: np.ndarray) -> str:
    """Size, mean level in 1/16, and a 64-bit average hash over 64 spans of the luma column means, of an RGB tensor."""
    wide = tensor.astype(np.int32)
    luma = (299 * wide[..., 0] + 587 * wide[..., 1] + 114 * wide[..., 2]) // 1000
    columns = luma.sum(0)
    edges = np.arange(65) * len(columns) // 64
    total = np.concatenate([[0], np.cumsum(columns)])
    width = np.maximum(np.diff(edges), 1) * luma.shape[0]
    mean = (total[edges[1:]] - total[edges[:-1]]) / width
    level = luma.sum() / luma.size
    bits = int.from_bytes(np.packbits(mean > level).tobytes())
    return f"{tensor.shape[1]}x{tensor.shape[0]}:{int(16 * int(luma.sum()) // luma.size)}:{bits:016x}"


def with_media(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and a binary column ``media``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_size(whole, "text", SLICE_BYTES):
                media = pack_texts([(t or "").encode() for t in batch.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(media, pa.binary())], ["doc_id", "media"])

    picked = docs.select(F.col(ident).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return arrow_map(picked, run, "doc_id long, media binary")


_PAYLOAD = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"
_TENSOR = "height int, width int, rgb binary"


def with_tensors(media: DataFrame) -> DataFrame:
    """Payload digests, read back from the stored media, and the full-resolution RGB tensor (height, width, its bytes by row)."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.binary()]
    names = [c.split()[0] for c in f"{_PAYLOAD}, {_TENSOR}".split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_size(whole, "media", 2 * SLICE_BYTES):
                files = batch.column("media").to_pylist()
                rows = []
                images = jpeg.decode_coefficients(files)
                for doc, data, im, rgb in zip(batch.column("doc_id").to_pylist(), files, images, jpeg.tensors(images), strict=True):
                    payload, n = unpack(im)
                    tensor = rgb.tobytes()
                    rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), im.height, im.width, tensor))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return arrow_map(media, run, f"{_PAYLOAD}, {_TENSOR}")


def media_digest(media: DataFrame) -> DataFrame:
    """Payload digests, and features of the stored tensors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes = zip(batch.column("height").to_pylist(), batch.column("width").to_pylist(), batch.column("rgb"), strict=True)
            found = [feature(np.frombuffer(x.as_buffer(), np.uint8).reshape(h, w, 3)) for h, w, x in shapes]
            kept = batch.drop_columns(["height", "width", "rgb"])
            yield kept.append_column("feature", pa.array(found, pa.string()))

    return arrow_map(with_tensors(media), run, f"{_PAYLOAD}, feature string")
