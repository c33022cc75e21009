"""Telephony audio as columns: mu-law, A-law and IMA ADPCM in WAV containers.

Companded samples are expanded by look-up tables of 256 entries, built from the rule of G.711;
ADPCM blocks are decoded sample by sample with numpy across all blocks of many files. Decoded audio
is resampled (a low-pass filter before it goes down, linear interpolation) and stored as 16-bit
little-endian PCM in a column beside the media, as it is or packed without loss (``packed``).
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectroloom.llm.common import wider, written

# Format tags of WAV files.
PCM, A_LAW, MU_LAW, IMA_ADPCM = 1, 6, 7, 17

# Step sizes and index changes of IMA ADPCM.
STEPS = [
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449,
    494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493,
    10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
]
INDEX_CHANGE = [-1, -1, -1, -1, 2, 4, 6, 8]


def mu_law_table() -> np.ndarray:
    u = ~np.arange(256) & 255
    size = ((u & 15) * 8 + 132 << (u >> 4 & 7)) - 132
    return np.where(u & 128, -size, size).astype(np.int16)


def a_law_table() -> np.ndarray:
    a = np.arange(256) ^ 0x55
    segment, step = a >> 4 & 7, (a & 15) * 16 + 8
    size = np.where(segment == 0, step, step + 256 << np.maximum(segment - 1, 0))
    return np.where(a & 128, size, -size).astype(np.int16)


def _blocks(raw: np.ndarray) -> np.ndarray:
    """Samples (block, sample) of ADPCM blocks of equal width, over the samples of a block, all blocks at once."""
    sample = raw[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(raw[:, 2], 88).astype(np.int32)
    codes = np.stack([raw[:, 4:] & 15, raw[:, 4:] >> 4], 2).reshape(len(raw), -1)
    steps, change = np.array(STEPS, np.int32), np.array(INDEX_CHANGE, np.int32)
    got = np.empty((len(raw), codes.shape[1] + 1), np.int16)
    got[:, 0] = sample
    for k in range(codes.shape[1]):
        c, step = codes[:, k].astype(np.int32), steps[index]
        move = (step >> 3) + np.where(c & 4, step, 0) + np.where(c & 2, step >> 1, 0) + np.where(c & 1, step >> 2, 0)
        sample = np.clip(sample + np.where(c & 8, -move, move), -32768, 32767)
        index = np.clip(index + change[c & 7], 0, 88)
        got[:, k + 1] = sample
    return got


def adpcm_decode_all(files: list[bytes], block: int) -> list[np.ndarray]:
    """Mono IMA ADPCM of several files: each block has a 4-byte head (first sample, index) and two samples a byte.
    A last block that is cut short gives what it has."""
    out: list[list[np.ndarray]] = [[] for _ in files]
    pieces: dict[int, list[tuple[int, bytes]]] = {}
    for i, data in enumerate(files):
        tail = len(data) % block
        for raw, width in ((data[: len(data) - tail], block), (data[len(data) - tail :], tail)):
            if width >= 4 and raw:
                pieces.setdefault(width, []).append((i, raw))
    for width in sorted(pieces, key=lambda w: w != block):
        got = _blocks(np.frombuffer(b"".join(raw for _, raw in pieces[width]), np.uint8).reshape(-1, width))
        ends = np.cumsum([len(raw) // width for _, raw in pieces[width]])
        for (i, _), part in zip(pieces[width], np.split(got, ends[:-1]), strict=True):
            out[i].append(part.ravel())
    return [np.concatenate(x) if x else np.zeros(0, np.int16) for x in out]


def adpcm_decode(data: bytes, block: int) -> np.ndarray:
    return adpcm_decode_all([data], block)[0]


def wav(data: bytes, tag: int, rate: int = 8000, block: int = 1, bits: int = 8) -> bytes:
    """A mono WAV file around encoded samples."""
    extra = struct.pack("<HH", 2, 2 * (block - 4) + 1) if tag == IMA_ADPCM else b"" if tag == PCM else struct.pack("<H", 0)
    speed = rate * block if tag != IMA_ADPCM else rate * block // (2 * (block - 4) + 1)
    fmt = struct.pack("<HHIIHH", tag, 1, rate, speed, block, bits) + extra
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def unwav(file: bytes) -> tuple[int, int, int, bytes]:
    """(tag, rate, block, data) of a WAV file; raises ValueError on anything else."""
    if file[:4] != b"RIFF" or file[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, head = 12, None
    while at + 8 <= len(file):
        kind, size = file[at : at + 4], struct.unpack("<I", file[at + 4 : at + 8])[0]
        if kind == b"fmt ":
            tag, channels, rate, _, block, _ = struct.unpack("<HHIIHH", file[at + 8 : at + 24])
            if channels != 1:
                raise ValueError("only mono is supported")
            head = (tag, rate, block)
        if kind == b"data":
            if head is None:
                raise ValueError("data before format")
            return (*head, file[at + 8 : at + 8 + size])
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


MU, A = mu_law_table(), a_law_table()


def decode_all(files: list[bytes]) -> list[tuple[np.ndarray, int] | ValueError]:
    """16-bit samples and their rate of each file, or why it can't be read."""
    out: list = [None] * len(files)
    adpcm: dict[int, list[tuple[int, int, bytes]]] = {}
    for i, file in enumerate(files):
        try:
            tag, rate, block, data = unwav(file)
        except (ValueError, struct.error) as e:
            out[i] = ValueError(str(e))
            continue
        if tag in (MU_LAW, A_LAW):
            out[i] = (MU if tag == MU_LAW else A)[np.frombuffer(data, np.uint8)], rate
        elif tag == PCM:
            out[i] = np.frombuffer(data[: len(data) // 2 * 2], "<i2"), rate
        elif tag == IMA_ADPCM and block >= 4:
            adpcm.setdefault(block, []).append((i, rate, data))
        else:
            out[i] = ValueError(f"format {tag} is not supported")
    for block, rows in adpcm.items():
        for (i, rate, _), samples in zip(rows, adpcm_decode_all([d for _, _, d in rows], block), strict=True):
            out[i] = samples, rate
    return out


def decode(file: bytes) -> tuple[np.ndarray, int]:
    """16-bit samples and their rate."""
    got = decode_all([file])[0]
    if isinstance(got, ValueError):
        raise got
    return got


def low_pass(samples: np.ndarray, ratio: float, lobes: int = 8) -> np.ndarray:
    """A windowed sinc that ends what a rate lower by ``ratio`` cannot hold; ends count as silence beyond."""
    half = max(1, round(lobes * ratio))
    at = np.arange(-half, half + 1)
    kernel = np.sinc(at / ratio) * np.hanning(2 * half + 3)[1:-1]
    return np.convolve(samples.astype(np.float64), kernel / kernel.sum())[half : half + len(samples)]


def resample(samples: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation at the new rate's times, up to the last sample; below the old rate after a low-pass filter."""
    if rate == to or len(samples) < 2:
        return samples.astype("<i2")
    x = low_pass(samples, rate / to) if to < rate else samples.astype(np.float64)
    times = np.arange((len(samples) - 1) * to // rate + 1) * (rate / to)
    return np.rint(np.interp(times, np.arange(len(x)), x)).clip(-32768, 32767).astype("<i2")


def packed(pcm: bytes) -> bytes:
    """16-bit PCM in fewer bytes without loss; what compresses a table finds more in it.

    Every other sample comes first: with up to 256 different values (expanded from 8 bits, say) as those values and a
    byte for each sample, else as differences (modulo 2^16). Then comes what the samples between differ from the mean
    of their neighbours, next to nothing after a doubling of the rate: no bytes if all are 0, one or two for each else.
    """
    x = np.frombuffer(pcm, "<u2").astype(np.uint16)
    even, odd = x[::2], x[1::2]
    values, places = np.unique(even, return_inverse=True)
    few = 0 < len(values) <= 256
    main = values.astype("<u2").tobytes() + places.astype(np.uint8).tobytes() if few else (even - np.concatenate([even[:1] * 0, even[:-1]])).astype("<u2").tobytes()
    rest = (odd - _between(even, len(odd))).view(np.int16)
    width = 0 if not rest.any() else 1 if (rest == rest.astype(np.int8)).all() else 2
    tail = b"" if not width else rest.astype(np.int8 if width == 1 else "<i2").tobytes()
    return struct.pack("<IHB", len(x), len(values) if few else 0, width) + main + tail


def unpacked(raw: bytes) -> bytes:
    """What ``packed`` has packed."""
    n, few, width = struct.unpack_from("<IHB", raw)
    x, half, at = np.empty(n, "<u2"), (n + 1) // 2, 7
    if few:
        values = np.frombuffer(raw, "<u2", few, at).astype(np.uint16)
        even, at = values[np.frombuffer(raw, np.uint8, half, at + 2 * few)], at + 2 * few + half
    else:
        even, at = np.cumsum(np.frombuffer(raw, "<u2", half, at), dtype=np.uint16), at + 2 * half
    rest = np.frombuffer(raw, np.int8 if width == 1 else "<i2", n - half, at).astype(np.int16).view(np.uint16) if width else np.uint16(0)
    x[::2], x[1::2] = even, _between(even, n - half) + rest
    return x.tobytes()


def _between(even: np.ndarray, n: int) -> np.ndarray:
    """The means of the first ``n`` samples and those behind them (the last one's is its own value), rounded down."""
    x = even.view(np.int16).astype(np.int32)
    return ((x[:n] + np.concatenate([x[1:], x[-1:]])[:n]) >> 1).astype(np.uint16)


def feature(pcm: np.ndarray) -> str:
    """Samples, root mean square, peak, zero crossings and checksum of PCM."""
    if not len(pcm):
        return "n=0"
    x = pcm.astype(np.float64)
    crossings = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
    return f"n={len(pcm)};rms={np.sqrt(np.dot(x, x) / len(x)):.3f};peak={int(np.abs(x).max())};zc={crossings};crc={zlib.crc32(pcm.tobytes()):08x}"


#: Bytes of payload in a block, and a block's whole width in files of ADPCM.
UNIT, ADPCM_BLOCK = 64, 68
#: Bytes of a column that a slice of a batch holds, unless one row has more.
SLICE = 4 << 20


def payload(text: str | None, unit: int = UNIT) -> bytes:
    """UTF-8 of a text (null: empty), bytes 0 appended up to a positive multiple of ``unit``."""
    data = (text or "").encode()
    return data + b"\0" * (-len(data) % unit if data else unit)


def stored_as(data: bytes, rate: int) -> bytes:
    """The WAV file that holds a payload: its checksum deals an eighth of the payloads to ADPCM (whose blocks
    have a head of zeros and then 64 bytes of payload), three eighths to A-law and the rest to mu-law."""
    kind = zlib.crc32(data) & 7
    if kind == 0:
        blocks = np.zeros((len(data) // UNIT, ADPCM_BLOCK), np.uint8)
        blocks[:, 4:] = np.frombuffer(data, np.uint8).reshape(-1, UNIT)
        return wav(blocks.tobytes(), IMA_ADPCM, rate, ADPCM_BLOCK, 4)
    return wav(data, A_LAW if kind < 4 else MU_LAW, rate)


def payload_of(file: bytes) -> bytes:
    """What ``stored_as`` has put into a file."""
    tag, _, block, data = unwav(file)
    return np.frombuffer(data, np.uint8).reshape(-1, block)[:, 4:].tobytes() if tag == IMA_ADPCM else data


def _slices(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of about SLICE bytes of a column: long values are never held many at a time."""
    first = size = 0
    for i in range(batch.num_rows):
        value = batch.column(at)[i]
        more = len(value.as_buffer()) if value.is_valid else 0
        if i > first and size + more > SLICE:
            yield batch.slice(first, i - first)
            first, size = i, 0
        size += more
    if batch.num_rows > first:
        yield batch.slice(first)


def stored(docs: DataFrame, text: str = "text", rate: int = 8000) -> DataFrame:
    """``docs`` with ``n_bytes`` and ``media`` (replaced if there): the text's padded bytes as the samples of a WAV file.

    Null and empty texts are 64 bytes of 0; equal texts give equal files. Other columns and repeated rows stay.
    """
    docs = docs.drop("n_bytes", "media")
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _slices(batch, at):
                texts = rows.column(at).to_pylist()
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array([stored_as(payload(t), rate) for t in texts], pa.binary())], [*rows.schema.names, "n_bytes", "media"])

    return docs.mapInArrow(run, wider(docs, n_bytes="long", media="binary"))


def decoded(media: DataFrame, column: str = "media", to_rate: int = 16000, pack: bool = False) -> DataFrame:
    """``media`` with ``pcm`` (resampled, 16-bit little-endian) and ``error``, replaced if there: null media give
    null, files that can't be read a null pcm and the reason. Other columns and repeated rows stay. With ``pack`` the
    PCM is ``packed``, so that it leaves the Python worker, and is stored, at a fraction of its size."""
    media = media.drop("pcm", "error")
    at, kind = media.columns.index(column), packed if pack else bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _slices(batch, at):
                files = rows.column(at).to_pylist()
                read = iter(decode_all([f for f in files if f is not None]))
                got = [next(read) if f is not None else None for f in files]
                pcm = [None if g is None or isinstance(g, ValueError) else kind(resample(*g, to_rate).tobytes()) for g in got]
                errors = [str(g) if isinstance(g, ValueError) else None for g in got]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(pcm, pa.binary()), pa.array(errors, pa.string())], [*rows.schema.names, "pcm", "error"])

    return media.mapInArrow(run, wider(media, pcm="binary", error="string"))


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rate: int = 8000, to_rate: int = 16000) -> DataFrame:
    """Stores each text as audio and its PCM in a table of the shared folder, reads both back and describes them.

    One row per input row: doc_id (of its type), n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature. Null and empty texts are 64 bytes of 0; equal texts have equal
    values; repeated rows are repeated; other columns are ignored; an empty table gives no rows. PCM is kept, packed, at ``to_rate``.
    """
    ids = docs.select(F.col(doc_id).alias("doc_id"))
    kept = decoded(stored(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", rate).drop("text"), "media", to_rate, pack=True).drop("error")
    back = written(kept, level=12, page=8 << 20)
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _slices(batch, 2):
                out = []
                for file, pcm in zip(rows.column(2).to_pylist(), rows.column(3).to_pylist(), strict=True):
                    data = payload_of(file)
                    out.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-UNIT:]), len(file), hashlib.sha256(file).hexdigest(), feature(np.frombuffer(unpacked(pcm), "<i2"))))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], names)

    return back.select("doc_id", "n_bytes", "media", "pcm").mapInArrow(describe, wider(ids, n_bytes="long", payload_bytes="long", payload_sha256="string", tail_crc32="long", media_bytes="long", media_sha256="string", feature="string"))
