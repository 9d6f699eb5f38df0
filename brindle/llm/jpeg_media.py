"""Media columns: bytes kept as baseline JPEG, read back through its DC coefficients.

Storing. Each byte v is an 8 x 8 block of one grey level: its DC coefficient is 8 (v - 128), the quantiser of the DC is 8
and all AC coefficients are 0, so v survives exactly and any baseline decoder shows it as the block's level. A row of
an image holds LINE bytes and is a restart interval of its own. A payload of more than LINE x ROWS bytes takes several
images, one behind the other.

Reading. Markers are parsed, the entropy-coded data is cut at its restart markers, and all intervals of the images at hand are Huffman-decoded
side by side in numpy, block by block. AC coefficients are read over, and the DC coefficients are the luminance
thumbnail at an eighth of the size. Grey and YCbCr images of any sampling, with or without restarts, are read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batched, let_go, table, tidy

#: Bytes in a row of an image, and the most rows: 65535 pixels are the format's limit.
LINE, ROWS = 64, 8191
#: Rows of the input that are coded together, by their bytes.
BATCH_BYTES = 1 << 20

#: The DC code: the number of codes of each length from 1 to 16, and the categories in the order of their codes.
DC_COUNTS, DC_VALUES = [0, 1, 5, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0], [0, 4, 5, 3, 7, 6, 2, 1, 8]
#: The AC code has one word, for the end of the block.
AC_COUNTS, AC_VALUES = [1] + [0] * 15, [0]


def code_words(counts: list[int], values: list[int]) -> dict[int, tuple[int, int]]:
    """Value: (word, length), by the canonical rule."""
    out, word, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for v in values[at : at + n]:
            out[v] = word, length
            word += 1
        at, word = at + n, word << 1
    return out


def lookup(counts: list[int], values: list[int]) -> np.ndarray:
    """For each 16 bits: 256 x length + value of the word that they begin with; 0 where none does."""
    found = np.zeros(1 << 16, dtype=np.int32)
    for v, (word, length) in code_words(counts, values).items():
        found[word << (16 - length) : (word + 1) << (16 - length)] = length << 8 | v
    return found


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _head(rows: int) -> bytes:
    quant = bytes([0]) + bytes([8] + [1] * 63)
    frame = bytes([8]) + (8 * rows).to_bytes(2, "big") + (8 * LINE).to_bytes(2, "big") + bytes([1, 1, 0x11, 0])
    tables = bytes([0x00, *DC_COUNTS, *DC_VALUES]), bytes([0x10, *AC_COUNTS, *AC_VALUES])
    return b"\xff\xd8" + _segment(0xDB, quant) + _segment(0xC0, frame) + b"".join(_segment(0xC4, t) for t in tables) + _segment(0xDD, LINE.to_bytes(2, "big")) + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))


def _difference_words() -> tuple[np.ndarray, np.ndarray]:
    """For each DC difference + 255: the bits of a block (category, amount, end of block) and their number."""
    dc, (end, end_length) = code_words(DC_COUNTS, DC_VALUES), code_words(AC_COUNTS, AC_VALUES)[0]
    word, length = [], []
    for d in range(-255, 256):
        size = abs(d).bit_length()
        w, n = dc[size]
        amount = d if d >= 0 else d + (1 << size) - 1
        word.append(((w << size | amount) << end_length) | end)
        length.append(n + size + end_length)
    return np.array(word, dtype=np.uint32), np.array(length, dtype=np.int64)


_WORDS, _LENGTHS = _difference_words()


def _entropy(lines: np.ndarray) -> list[bytes]:
    """The entropy-coded data of each row of an array (rows, LINE) of bytes: padded with ones, FF followed by 00."""
    levels = lines.astype(np.int16) - 128
    diff = np.diff(levels, axis=1, prepend=np.int16(0)) + 255
    words, lengths = _WORDS[diff].ravel(), _LENGTHS[diff]
    bits = lengths.sum(1)
    room = (bits + 7) >> 3
    begin = np.concatenate([[0], np.cumsum(room)])  # bytes
    inside = np.cumsum(lengths, axis=1) - lengths
    at = (inside + 8 * begin[:-1, None]).ravel()
    lengths = lengths.ravel()
    # a block has 20 bits at most, so it lies within four bytes of the one it begins in
    shifted = words.astype(np.uint64) << (32 - lengths - (at & 7)).astype(np.uint64)
    data = np.zeros(begin[-1] + 4, dtype=np.uint8)
    first = at >> 3
    for k in range(4):
        part = ((shifted >> np.uint64(24 - 8 * k)) & np.uint64(255)).astype(np.float64)
        data |= np.bincount(first + k, weights=part, minlength=len(data)).astype(np.uint8)  # bits of different blocks never meet, so sums are unions
    data = data[: begin[-1]]
    rest = (8 * room - bits).astype(np.uint8)
    data[begin[1:] - 1] |= ((1 << rest) - 1).astype(np.uint8)
    raw = data.tobytes()
    return [raw[a:b].replace(b"\xff", b"\xff\x00") for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())]


def store(payloads: list[bytes]) -> list[bytes]:
    """The images of each payload, whose length is a positive multiple of LINE."""
    lines = np.frombuffer(b"".join(payloads), dtype=np.uint8).reshape(-1, LINE)
    coded, out, at = _entropy(lines), [], 0
    for p in payloads:
        rows, parts = len(p) // LINE, []
        for begin in range(0, rows, ROWS):
            n = min(ROWS, rows - begin)
            parts.append(_head(n))
            for i in range(n):
                parts.append(coded[at + begin + i])
                parts.append(bytes([0xFF, 0xD0 + i % 8]) if i < n - 1 else b"\xff\xd9")
        out.append(b"".join(parts))
        at += rows
    return out


def parse(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The image that begins at a byte of data, and where it ends: size, tables, components, restart interval, and entropy-coded intervals."""
    if data[at : at + 2] != b"\xff\xd8":
        raise ValueError("no JPEG begins here")
    image: dict = {"quant": {}, "dc": {}, "ac": {}, "tables": {}, "restart": 0}
    at += 2
    while True:
        if data[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker = data[at + 1]
        at += 2
        if marker == 0xFF or marker == 0x01 or 0xD0 <= marker <= 0xD7:
            at -= marker == 0xFF
            continue
        if marker == 0xD9:
            raise ValueError("the image has no scan")
        length = int.from_bytes(data[at : at + 2], "big")
        body, at = data[at + 2 : at + length], at + length
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                image["quant"][body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")  # of the DC
                image["tables"]["quant", body[0] & 15] = body[1 : 2 + wide]
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                counts = list(body[1:17])
                image["ac" if body[0] >> 4 else "dc"][body[0] & 15] = lookup(counts, list(body[17 : 17 + sum(counts)]))
                image["tables"]["ac" if body[0] >> 4 else "dc", body[0] & 15] = body[1 : 17 + sum(counts)]
                body = body[17 + sum(counts) :]
        elif marker in (0xC0, 0xC1):
            if body[0] != 8:
                raise ValueError("samples must have 8 bits")
            image["height"], image["width"] = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            image["parts"] = {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])}
        elif 0xC2 <= marker <= 0xCF and marker != 0xCC and marker != 0xC8:
            raise ValueError("only baseline images are read")
        elif marker == 0xDD:
            image["restart"] = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            image["scan"] = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            if len(image["scan"]) != len(image["parts"]):
                raise ValueError("one scan must hold all components")
            break
    pieces, begin = [], at
    while True:
        at = data.index(b"\xff", at)
        mark = data[at + 1]
        if mark == 0:
            at += 2
            continue
        if 0xD0 <= mark <= 0xD7 or mark == 0xD9:
            pieces.append(data[begin:at].replace(b"\xff\x00", b"\xff"))
            begin = at + 2
            if mark == 0xD9:
                break
        at += 2 if mark != 0xFF else 1
    image["pieces"] = pieces
    return image, begin


def _thumbnails(images: list[dict]) -> list[np.ndarray]:
    """Luminance thumbnails of images that share tables, components and the blocks of an interval."""
    one = images[0]
    scan = [(name, dc, ac, *one["parts"][name]) for name, dc, ac in one["scan"]]
    single = len(scan) == 1
    top_h, top_v = (1, 1) if single else (max(p[3] for p in scan), max(p[4] for p in scan))
    units = [(-(-x["width"] // (8 * top_h)), -(-x["height"] // (8 * top_v))) for x in images]
    pieces = [p for x in images for p in x["pieces"]]
    starts = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])[:-1]
    raw = np.frombuffer(b"".join(pieces) + b"\xff" * 8, dtype=np.uint8).astype(np.uint64)
    window = (raw[:-4] << np.uint64(32)) | (raw[1:-3] << np.uint64(24)) | (raw[2:-2] << np.uint64(16)) | (raw[3:-1] << np.uint64(8)) | raw[4:]  # 40 bits from each byte
    most = max(x["restart"] or w * h for x, (w, h) in zip(images, units))
    left = np.concatenate([[min(x["restart"] or w * h, w * h - i * (x["restart"] or 0)) for i in range(len(x["pieces"]))] for x, (w, h) in zip(images, units)])
    at = starts.astype(np.int64) * 8
    whole = bool((left == most).all())
    blocks = [1 if single else p[3] * p[4] for p in scan]
    out = np.zeros((len(pieces), most, blocks[0]), dtype=np.int32)
    last = [np.zeros(len(pieces), dtype=np.int64) for _ in scan]
    rows = np.arange(len(pieces))

    def bits(where: np.ndarray, n) -> np.ndarray:
        return (window[where >> 3] >> (np.uint64(40) - (where & 7).astype(np.uint64) - np.asarray(n, dtype=np.uint64))).astype(np.int64)

    for unit in range(most):
        live = rows if whole else rows[left > unit]
        for c, (_, dc, ac, _, _, _) in enumerate(scan):
            for block in range(blocks[c]):
                p = at[live]
                code = one["dc"][dc][bits(p, 16) & 0xFFFF]
                if not code.all():
                    raise ValueError("no code word fits")
                size = code & 255
                p = p + (code >> 8)
                amount = bits(p, size) & ((1 << size) - 1)
                p += size
                last[c][live] += np.where((size > 0) & (amount < (1 << np.maximum(size - 1, 0))), amount - (1 << size) + 1, amount)
                if c == 0:
                    out[live, unit, block] = last[0][live]
                k, todo = np.ones(len(live), dtype=np.int64), np.arange(len(live))
                while len(todo):  # read the AC coefficients over
                    code = one["ac"][ac][bits(p[todo], 16) & 0xFFFF]
                    if not code.all():
                        raise ValueError("no code word fits")
                    run, size = code >> 4 & 15, code & 15
                    p[todo] += (code >> 8) + size
                    k[todo] = np.where(size > 0, k[todo] + run + 1, np.where(run == 15, k[todo] + 16, 64))
                    if k[todo].min() >= 64:
                        break
                    todo = todo[k[todo] < 64]
                at[live] = p
    found, done = [], 0
    for x, (w, h) in zip(images, units):
        n = len(x["pieces"])
        flat = out[done : done + n].reshape(-1, blocks[0])[: w * h] if x["restart"] else out[done, : w * h]
        done += n
        own_h, own_v = (1, 1) if single else scan[0][3:5]
        grid = flat.reshape(h, w, own_v, own_h).transpose(0, 2, 1, 3).reshape(h * own_v, w * own_h)
        grid = np.clip((grid * one["quant"][scan[0][5]] + 4 >> 3) + 128, 0, 255).astype(np.uint8)
        found.append(grid[: -(-x["height"] * (own_v if not single else 1) // (8 * (top_v if not single else 1))), : -(-x["width"] * (own_h if not single else 1) // (8 * (top_h if not single else 1)))])
    return found


def read(stored: list[bytes]) -> list[list[np.ndarray]]:
    """For each stored value the luminance thumbnails of its images, one sample for each 8 x 8 block."""
    images, owner = [], []
    for i, data in enumerate(stored):
        at = 0
        while at < len(data):
            x, at = parse(data, at)
            images.append(x)
            owner.append(i)
    groups: dict[tuple, list[int]] = {}
    for n, x in enumerate(images):
        groups.setdefault((tuple(sorted(x["tables"].items())), tuple(x["parts"].items()), tuple(x["scan"]), x["restart"] or -n), []).append(n)
    out: list[list] = [[] for _ in stored]
    thumbs: dict[int, np.ndarray] = {}
    for members in groups.values():
        thumbs.update(zip(members, _thumbnails([images[n] for n in members])))
    for n, i in enumerate(owner):
        out[i].append(thumbs[n])
    return out


def average_hash(thumb: np.ndarray) -> int:
    """64 bits: whether each cell of an 8 x 8 grid over the thumbnail is brighter than the mean of the cells."""
    edges = [np.linspace(0, n, 9).astype(int) for n in thumb.shape]
    rows, cols = (np.minimum(e[:-1], n - 1) for e, n in zip(edges, thumb.shape))
    high, wide = (np.maximum(np.diff(e), 1) for e in edges)
    total = np.cumsum(np.cumsum(np.pad(thumb.astype(np.int64), ((1, 0), (1, 0))), axis=0), axis=1)
    r, c = np.minimum(rows + high, thumb.shape[0]), np.minimum(cols + wide, thumb.shape[1])
    cells = (total[r][:, c] - total[rows][:, c] - total[r][:, cols] + total[rows][:, cols]) / (high[:, None] * wide[None, :])
    return int.from_bytes(np.packbits((cells > cells.mean()).ravel()).tobytes(), "big")


def payload_of(text: str | None) -> tuple[int, bytes]:
    """The number of UTF-8 bytes of a text (null: none) and the bytes, with bytes 0 up to a positive multiple of LINE."""
    data = (text or "").encode()
    return len(data), data + bytes(-len(data) % LINE if data else LINE)


def _batches(texts) -> Iterator[tuple[int, int]]:
    """Stretches of rows of about BATCH_BYTES together."""
    begin, total = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > begin and total + n > BATCH_BYTES:
            yield begin, i
            begin, total = i, 0
        total += n
    if len(texts) > begin:
        yield begin, len(texts)


def media_columns(docs: DataFrame, with_media: bool = True) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, width, height, feature and (with_media)
    the stored media for each row of docs (doc_id, text).

    The digests of the payload are of what is read back from the media, and reading fails if it differs. width and
    height are the first image's; feature is them, the number of images and each image's average hash. Null texts count
    as empty: one row of zeros. Texts come whole, of any length. Equal texts give equal values; rows repeat as in docs; other columns
    are not carried; an empty table gives no rows.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "width", "height", "feature"] + ["media"] * with_media
    types = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, width int, height int, feature string" + ", media binary" * with_media

    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        for x in batches:
            texts, ids = x["text"].tolist(), x["doc_id"].tolist()
            for a, b in _batches(texts):
                payloads = [payload_of(t) for t in texts[a:b]]
                stored = store([p for _, p in payloads])
                rows = []
                for doc_id, (n, payload), media, thumbs in zip(ids[a:b], payloads, stored, read(stored)):
                    back = b"".join(t.tobytes() for t in thumbs)
                    if back != payload:
                        raise ValueError(f"document {doc_id} doesn't read back")
                    feature = f"{thumbs[0].shape[1] * 8}x{thumbs[0].shape[0] * 8}x{len(thumbs)}:" + ",".join(f"{average_hash(t):016x}" for t in thumbs)
                    rows.append((doc_id, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-LINE:]), len(media), hashlib.sha256(media).hexdigest(), thumbs[0].shape[1] * 8, thumbs[0].shape[0] * 8, feature) + ((media,) if with_media else ()))
                yield pd.DataFrame(rows, columns=names)

    return batched(docs.select("doc_id", "text")).mapInPandas(run, types)


def op10_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"), with_media=False)
