"""Media columns: baseline JPEG in numpy, over all images of a batch at once.

``encode_media`` keeps a byte payload without loss as a grey baseline JPEG: each
byte is the quantised DC coefficient of one 8 x 8 block (quantiser 8), so the
DC-only thumbnail of the image is the payload. A restart marker follows every 24
blocks; the intervals are independent, so all intervals of a batch are coded and
decoded in step.

``media_features`` parses markers, Huffman-decodes scans (any sequential
baseline file: sampling factors, several components, restart intervals) and
reconstructs the luminance thumbnail from DC coefficients. Its columns are the
dimensions, a difference hash of the thumbnail and the payload.

Defined results: null reads as empty, which pads to one unit; equal payloads
give equal files; a payload too large for one frame (65,535 pixels a side) is
kept as several files one after another; media that is null or no baseline JPEG
has null features and its reason in ``error``; repeated rows stay and are coded
alike; an empty table gives an empty table; ``encode_media`` ignores further columns,
``media_features`` keeps them, save those that have the name of a feature.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.llm.common import text_of

#: Payloads are padded to a multiple of this: 24 rows of 24 blocks.
UNIT = 576
ROW = 24
MOST_BLOCKS = 8191
#: Payload bytes coded together in a task; bounds its memory.
RUN_BYTES = 3_000_000
# Code lengths and categories of the standard's example DC table; end of block alone for AC.
DC_COUNTS, DC_VALUES = [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], list(range(12))
AC_COUNTS, AC_VALUES = [1] + [0] * 15, [0]


def huffman(counts: list[int], values: list[int]) -> tuple[dict[int, tuple[int, int]], np.ndarray]:
    """Codes by value (code, length), and a table from 16 bits to length * 256 + value (0: no code)."""
    codes, table = {}, np.zeros(65536, np.uint16)
    code, k = 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            codes[values[k]] = (code, length)
            at = code << (16 - length)
            table[at : at + (1 << (16 - length))] = length * 256 + values[k]
            code, k = code + 1, k + 1
        code <<= 1
    return codes, table


def _symbols() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number for each DC difference from -255 to 255, the end of block included."""
    codes, _ = huffman(DC_COUNTS, DC_VALUES)
    bits, sizes = np.zeros(511, np.uint64), np.zeros(511, np.uint64)
    for d in range(-255, 256):
        cat = abs(d).bit_length()
        code, length = codes[cat]
        value = d if d >= 0 else d + (1 << cat) - 1
        bits[d + 255], sizes[d + 255] = ((code << cat) | value) << 1, length + cat + 1
    return bits, sizes


BITS, SIZES = _symbols()


def _marker(code: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, code, len(body) + 2) + body


def _head(width: int, height: int, payload: int) -> bytes:
    table = lambda kind, counts, values: bytes([kind, *counts, *values])
    return b"".join(
        [
            b"\xff\xd8",
            _marker(0xFE, b"payload=%d" % payload),
            _marker(0xDB, bytes([0, 8] + [1] * 63)),
            _marker(0xC0, struct.pack(">BHHB", 8, height * 8, width * 8, 1) + bytes([1, 0x11, 0])),
            _marker(0xC4, table(0, DC_COUNTS, DC_VALUES)),
            _marker(0xC4, table(0x10, AC_COUNTS, AC_VALUES)),
            _marker(0xDD, struct.pack(">H", ROW)),
            _marker(0xDA, bytes([1, 1, 0, 0, 63, 0])),
        ]
    )


def scans(blocks: np.ndarray, last: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of intervals (rows of 24 byte values) and the end of each interval in them.

    ``last`` tells whether an interval ends its image (no restart marker), ``turn`` its number there.
    """
    rows = len(blocks)
    diff = blocks.astype(np.int16) - 128
    diff[:, 1:] -= diff[:, :-1].copy()
    index = diff + 255
    words = np.zeros((rows, 13), np.uint32)
    at = np.zeros(rows, np.int64)
    every = np.arange(rows)
    for j in range(ROW):
        k = index[:, j]
        size = SIZES[k].astype(np.int64)
        placed = BITS[k] << (64 - (at & 31) - size).astype(np.uint64)
        w = at >> 5
        words[every, w] |= (placed >> np.uint64(32)).astype(np.uint32)
        words[every, w + 1] |= placed.astype(np.uint32)
        at += size
    pad = -at % 8
    placed = ((np.uint64(1) << pad.astype(np.uint64)) - np.uint64(1)) << (64 - (at & 31) - pad).astype(np.uint64)
    words[every, at >> 5] |= (placed >> np.uint64(32)).astype(np.uint32)
    n = (at + pad) >> 3
    stream = words.astype(">u4").view(np.uint8).reshape(rows, -1)
    coded = stream[np.arange(stream.shape[1]) < n[:, None]]
    width = 1 + (coded == 255).astype(np.int64)
    ends = np.cumsum(n)
    width[ends - 1] += 2 * ~last
    stops = np.cumsum(width)
    out = np.zeros(stops[-1], np.uint8)
    out[stops - width] = coded
    mark = stops[ends - 1][~last]
    out[mark - 2], out[mark - 1] = 255, 0xD0 + turn[~last] % 8
    return out, stops[ends - 1]


def _frames(size: int) -> list[tuple[int, int, int]]:
    """Width and height in blocks and payload bytes of each file for a padded payload."""
    most = MOST_BLOCKS // ROW * ROW * MOST_BLOCKS // UNIT * UNIT
    found = []
    while size:
        part = min(size, most)
        width = ROW * -(-part // (ROW * MOST_BLOCKS))
        found.append((width, -(-part // width), part))
        size -= part
    return found


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """One media value for each payload; lengths are positive multiples of 576."""
    parts, last, turn, heads, owner = [], [], [], [], []
    for i, p in enumerate(payloads):
        at = 0
        for width, height, size in _frames(len(p)):
            values = np.frombuffer(p, np.uint8, size, at)
            if width * height > size:
                values = np.r_[values, np.full(width * height - size, 255, np.uint8)]
            at += size
            n = len(values) // ROW
            parts.append(values)
            last.append(np.arange(n) == n - 1)
            turn.append(np.arange(n))
            heads.append(_head(width, height, size))
            owner.append((i, n))
    out, ends = scans(np.concatenate(parts).reshape(-1, ROW), np.concatenate(last), np.concatenate(turn))
    stops = np.r_[0, ends[np.cumsum([n for _, n in owner]) - 1]]
    media: dict[int, list[bytes]] = defaultdict(list)
    for k, (i, _) in enumerate(owner):
        media[i] += [heads[k], out[stops[k] : stops[k + 1]].tobytes(), b"\xff\xd9"]
    return [b"".join(media[i]) for i in range(len(payloads))]


@dataclass
class Image:
    """What the markers of one file say."""

    width: int = 0
    height: int = 0
    payload: int | None = None
    interval: int = 0
    quant: dict[int, int] = field(default_factory=dict)
    tables: dict[int, bytes] = field(default_factory=dict)
    parts: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantiser
    scan: list[tuple[int, int, int]] = field(default_factory=list)  # part, DC table, AC table
    data: tuple[int, int] = (0, 0)


def parse_markers(media: bytes, at: int = 0) -> tuple[Image, int]:
    """The first file from ``at`` and where it ends. ValueError: no sequential baseline JPEG of one scan."""
    if media[at : at + 2] != b"\xff\xd8":
        raise ValueError("no start of image")
    image, at = Image(), at + 2
    while True:
        if at + 4 > len(media) or media[at] != 255:
            raise ValueError("no marker where one is due")
        code, size = media[at + 1], struct.unpack_from(">H", media, at + 2)[0]
        body = media[at + 4 : at + 2 + size]
        at += 2 + size
        if code == 0xFE and body.startswith(b"payload="):
            image.payload = int(body[8:])
        elif code == 0xDB:
            k = 0
            while k < len(body):
                wide, name = body[k] >> 4, body[k] & 15
                image.quant[name] = struct.unpack_from(">H" if wide else ">B", body, k + 1)[0]
                k += 1 + 64 * (1 + wide)
        elif code == 0xC4:
            k = 0
            while k < len(body):
                n = sum(body[k + 1 : k + 17])
                image.tables[body[k]] = body[k + 1 : k + 17 + n]
                k += 17 + n
        elif code == 0xC0:
            depth, image.height, image.width, n = struct.unpack_from(">BHHB", body)
            if depth != 8:
                raise ValueError("samples of other than 8 bits")
            image.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC1 <= code <= 0xCF and code not in (0xC8, 0xCC):
            raise ValueError("not sequential baseline")
        elif code == 0xDD:
            image.interval = struct.unpack(">H", body)[0]
        elif code == 0xDA:
            names = [p[0] for p in image.parts]
            image.scan = [(names.index(body[1 + 2 * i]), body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            if len(image.scan) != len(image.parts):
                raise ValueError("several scans")
            end = at
            while True:  # the next marker that is neither a stuffed byte nor a restart
                end = media.find(b"\xff", end)
                if end < 0 or end + 1 >= len(media):
                    raise ValueError("no end of image")
                if media[end + 1] == 0xD9:
                    break
                end = _skip(media, end)
            image.data = (at, end)
            return image, end + 2


def _skip(media: bytes, at: int) -> int:
    """Jumps to the end-of-image marker where every marker until it is a restart or a stuffed byte."""
    end = media.find(b"\xff\xd9", at)
    if end < 0:
        raise ValueError("no end of image")
    return end


def decode_dc(pieces: list[np.ndarray], image: Image, mcus: list[int]) -> list[np.ndarray]:
    """DC coefficients (differences undone) of the first component for files that share tables and layout.

    ``pieces`` are their entropy-coded bytes, ``mcus`` their numbers of units; the
    result has the component's blocks of each unit in order.
    """
    raw = np.concatenate([*pieces, np.zeros(8, np.uint8)])
    mark = np.flatnonzero(raw[:-1] == 255)
    after = raw[mark + 1]
    restart = mark[(after >= 0xD0) & (after <= 0xD7)]
    keep = np.ones(len(raw), bool)
    keep[mark + 1] = False
    keep[restart] = False
    place = np.cumsum(keep) - keep  # where each byte goes once marks are out
    file_at = np.cumsum([0] + [len(p) for p in pieces])
    first = np.sort(np.r_[file_at[:-1], restart + 2])
    owner = np.searchsorted(file_at, first, side="right") - 1
    turn = np.arange(len(first)) - np.searchsorted(owner, owner)
    step = image.interval or max(mcus)
    count = np.minimum(step, np.array(mcus)[owner] - turn * step)
    data = raw[keep].astype(np.uint64)
    data = np.r_[data, np.zeros(8, np.uint64)]
    window = (data[:-4] << np.uint64(32)) | (data[1:-3] << np.uint64(24)) | (data[2:-2] << np.uint64(16)) | (data[3:-1] << np.uint64(8)) | data[4:]
    window = window.astype(np.int64)  # 40 bits from each byte on
    tables = {k: huffman(list(t[:16]), list(t[16:]))[1].astype(np.int64) for k, t in image.tables.items()}
    order = [(c, dc, ac) for c, dc, ac in image.scan for _ in range(image.parts[c][1] * image.parts[c][2] if len(image.scan) > 1 else 1)]
    own = sum(1 for c, _, _ in order if c == image.scan[0][0])
    out = np.zeros((len(first), int(count.max()) * own), np.int32)
    at = place[first].astype(np.int64) * 8
    pred = np.zeros((len(image.parts), len(first)), np.int64)
    live = np.arange(len(first))
    limit = (len(window) - 1) * 8
    for m in range(int(count.max())):
        if m:
            live = live[count[live] > m]
        k = 0
        for c, dc, ac in order:
            pos = np.minimum(at[live], limit)
            bits = window[pos >> 3]
            left = 40 - (pos & 7)
            found = tables[dc][(bits >> (left - 16)) & 0xFFFF]
            size, left = found & 255, left - (found >> 8)
            value = (bits >> (left - size)) & ((1 << size) - 1)
            value = np.where((size > 0) & (value < (1 << np.maximum(size - 1, 0))), value - (1 << size) + 1, value)
            pred[c, live] += value
            if c == image.scan[0][0]:
                out[live, m * own + k] = pred[c, live]
                k += 1
            pos = pos + (found >> 8) + size
            todo, spot = np.arange(len(live)), np.ones(len(live), np.int64)
            while len(todo):  # AC coefficients are passed over
                p = np.minimum(pos[todo], limit)
                found = tables[16 + ac][(window[p >> 3] >> (24 - (p & 7))) & 0xFFFF]
                run, size = (found & 255) >> 4, found & 15
                if not (found > 0).all():
                    raise ValueError("a code that no table has")
                pos[todo] = p + (found >> 8) + size
                spot[todo] += run + 1
                todo = todo[((found & 255) != 0) & (spot[todo] < 64)]
            at[live] = pos
    return [out[owner == i].ravel()[: n * own] if (np.diff(count[owner == i]) == 0).all() else np.concatenate([r[: c * own] for r, c in zip(out[owner == i], count[owner == i], strict=True)]) for i, n in enumerate(mcus)]


def thumbnails(media: list[bytes]) -> list[list[tuple[Image, np.ndarray]] | str]:
    """For each value the files in it, each with its DC-only luminance thumbnail; a text says why there are none."""
    found: list = [None] * len(media)
    alike: dict[tuple, list[tuple[int, int, Image]]] = defaultdict(list)
    for i, value in enumerate(media):
        try:
            at, files = 0, []
            while at < len(value) or not files:
                image, at = parse_markers(value, at)
                files.append(image)
            found[i] = [None] * len(files)
            for k, image in enumerate(files):
                key = (tuple(sorted(image.tables.items())), tuple(image.parts), tuple(image.scan), image.interval)
                alike[key].append((i, k, image))
        except (ValueError, IndexError, struct.error) as e:
            found[i] = f"not a baseline JPEG: {e}"
    for group in alike.values():
        image = group[0][2]
        most_h, most_v = max(p[1] for p in image.parts), max(p[2] for p in image.parts)
        lone = len(image.scan) == 1
        h, v = (1, 1) if lone else image.parts[image.scan[0][0]][1:3]
        grid = [(-(-x.width // (8 * (1 if lone else most_h))), -(-x.height // (8 * (1 if lone else most_v)))) for _, _, x in group]
        # one damaged file must not spoil its batch: on an error each is tried alone
        try:
            dcs = decode_dc([np.frombuffer(media[i], np.uint8)[x.data[0] : x.data[1]] for i, _, x in group], image, [a * b for a, b in grid])
        except (ValueError, IndexError, KeyError) as e:
            if len(group) == 1:
                found[group[0][0]] = f"not a baseline JPEG: {e}"
                continue
            for i in {i for i, _, _ in group}:
                found[i] = thumbnails([media[i]])[0]
            continue
        for (i, k, x), (cols, rows), dc in zip(group, grid, dcs, strict=True):
            q = x.quant[x.parts[x.scan[0][0]][3]]
            light = np.clip((dc * q + 4) // 8 + 128, 0, 255).astype(np.uint8)
            shape = light.reshape(rows, cols, v, h).transpose(0, 2, 1, 3).reshape(rows * v, cols * h)
            if isinstance(found[i], list):
                found[i][k] = (x, shape[: -(-x.height // 8), : -(-x.width // 8)])
    return found


def difference_hash(image: np.ndarray) -> str:
    """64 bits: is each of 8 x 9 means of the thumbnail below its right neighbour?"""
    rows = np.linspace(0, image.shape[0], 9).astype(int)
    cols = np.linspace(0, image.shape[1], 10).astype(int)
    total = np.zeros((image.shape[0] + 1, image.shape[1] + 1), np.int64)
    total[1:, 1:] = image.astype(np.int64).cumsum(0).cumsum(1)
    lo_r, hi_r = rows[:-1], np.maximum(rows[1:], rows[:-1] + 1).clip(max=image.shape[0])
    lo_c, hi_c = cols[:-1], np.maximum(cols[1:], cols[:-1] + 1).clip(max=image.shape[1])
    area = np.maximum(np.outer(hi_r - lo_r, hi_c - lo_c), 1)
    sums = total[np.ix_(hi_r, hi_c)] - total[np.ix_(lo_r, hi_c)] - total[np.ix_(hi_r, lo_c)] + total[np.ix_(lo_r, lo_c)]
    mean = sums * 1000 // area
    return np.packbits(mean[:, :-1] < mean[:, 1:]).tobytes().hex()


def _runs(sizes: list[int]) -> Iterator[tuple[int, int]]:
    start, total = 0, 0
    for i, n in enumerate(sizes):
        total += n
        if total >= RUN_BYTES:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def encode_media(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_bytes and media of every whole text."""
    picked = docs.select(F.col(id_column).alias("doc_id"), text_of(text_column).cast("binary").alias("data"))
    kind = picked.schema["doc_id"].dataType.simpleString()

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            data = b.column("data").to_pylist()
            for i, j in _runs([len(x) for x in data]):
                padded = [x + b"\xff" * (-len(x) % UNIT if x else UNIT) for x in data[i:j]]
                sizes = pa.array([len(x) for x in data[i:j]], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), sizes, pa.array(encode_payloads(padded), pa.binary())], ["doc_id", "n_bytes", "media"])

    return picked.mapInArrow(batches, f"doc_id {kind}, n_bytes long, media binary")


FEATURES = "width int, height int, feature string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, error string"


def _features(value: bytes, files: list[tuple[Image, np.ndarray]] | str) -> dict:
    out: dict = {"media_bytes": len(value), "media_sha256": hashlib.sha256(value).hexdigest()}
    if isinstance(files, str):
        return out | {"error": files}
    image, light = files[0]
    out |= {"width": image.width, "height": image.height, "feature": f"{image.width}x{image.height}:" + "-".join(difference_hash(x) for _, x in files)}
    if all(x.payload is not None for x, _ in files):
        payload = b"".join(x.tobytes()[: i.payload] for i, x in files)
        out |= {"payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-32:])}
    return out


def media_features(media: DataFrame, column: str = "media") -> DataFrame:
    """``media`` without its media column and with what the stored bytes say."""
    fields = [p.split()[0] for p in FEATURES.split(", ")]
    others = [c for c in media.columns if c != column and c not in fields]
    kinds = [f"`{c}` {media.schema[c].dataType.simpleString()}" for c in others]

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
        schema = {p.split()[0]: types[p.split()[1]] for p in FEATURES.split(", ")}
        for b in found:
            held = b.column(column).to_pylist()
            for i, j in _runs([len(x or b"") for x in held]):
                values = [x or b"" for x in held[i:j]]
                rows = [_features(v, t) for v, t in zip(values, thumbnails(values), strict=True)]
                made = [pa.array([r.get(f) for r in rows], schema[f]) for f in fields]
                yield pa.RecordBatch.from_arrays([b.column(c).slice(i, j - i) for c in others] + made, others + fields)

    return media.mapInArrow(batches, ", ".join(kinds + [FEATURES]))
