"""Media columns: progressive JPEG files, their coefficients and their RGB tensors.

`decode` reads a progressive Huffman JPEG: spectral selection and successive approximation accumulate, scan by
scan, in one coefficient array per component; quantisation is undone, the inverse transform runs in numpy, chroma
is repeated up to full size, and YCbCr becomes an RGB tensor (height, width, 3) of bytes.

`store_payload` keeps bytes losslessly in such a file, in the format's own unit, the quantised coefficient: 64
payload bytes make one 8x8 block, six blocks (four Y, one Cb, one Cr) one 16x16 tile. A byte b is the DC
coefficient b itself, or the AC coefficient b, if b >= 128, or else b - 255, all of which have eight bits. Scans:
DC without its low eight bits, eight DC refinements, AC without its low bit in two spectral bands, and their
refinement. What fills the last tile up is 255; a comment segment tells how long the payload is.

In these scans every code has the same width, so numpy reads and writes all blocks of a scan at once: where a scan's
tables hold a single code of one bit, `decode` takes that path, and else it goes bit by bit.

Defined results of the operator: null text counts as empty, and an empty payload is 576 bytes 255; equal texts
give equal files; texts up to the format's largest picture (65,520 by 65,520, some 6 GB) are stored whole;
repeated rows get the same result; an empty table gives an empty result; other columns of the input are not touched.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwatch.llm.common import ship, text_or_empty

UNIT = 576


def zigzag() -> np.ndarray:
    """Row-major place of each coefficient in zigzag order."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([r * 8 + c for r, c in cells])


ZIGZAG = zigzag()
_K = np.arange(8)
#: DCT[k, x]: the basis of the inverse transform.
DCT = (np.where(_K == 0, np.sqrt(0.125), 0.5)[:, None] * np.cos((2 * _K[None, :] + 1) * _K[:, None] * np.pi / 16)).astype(np.float32)


# ---- writing


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _scan(parts: list[tuple[int, int]], ss: int, se: int, ah: int, al: int, bits: np.ndarray) -> bytes:
    """bits: the entropy-coded data, one element per bit; filled up with ones and stuffed."""
    head = bytes([len(parts), *[x for c, t in parts for x in (c, t)], ss, se, ah << 4 | al])
    fill = np.ones(-len(bits) % 8, np.uint8)
    return _segment(0xDA, head) + np.packbits(np.concatenate((bits, fill))).tobytes().replace(b"\xff", b"\xff\x00")


def _table(kind: int, at: int, symbol: int) -> bytes:
    """A Huffman table of one code, 0, for one symbol."""
    return _segment(0xC4, bytes([kind << 4 | at, 1, *[0] * 15, symbol]))


def tiles_for(blocks: int) -> tuple[int, int]:
    """Tiles across and down for so many blocks: 64 across, more only where the height would not do."""
    tiles = -(-blocks // 6)
    across = min(tiles, max(64, -(-tiles // 4095)))
    return across, -(-tiles // across)


def _planes(blocks: np.ndarray, across: int, down: int) -> list[np.ndarray]:
    """Blocks in tile order to the block order of each component's own scans."""
    t = blocks.reshape(down, across, 6, 64)
    y = t[:, :, :4].reshape(down, across, 2, 2, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 64)
    return [y, t[:, :, 4].reshape(-1, 64), t[:, :, 5].reshape(-1, 64)]


def _tiles(planes: list[np.ndarray], across: int, down: int) -> np.ndarray:
    """The inverse of _planes()."""
    y = planes[0].reshape(down, 2, across, 2, 64).transpose(0, 2, 1, 3, 4).reshape(down, across, 4, 64)
    return np.concatenate((y, *(p.reshape(down, across, 1, 64) for p in planes[1:])), axis=2).reshape(-1, 64)


def store_payload(payload: bytes) -> bytes:
    """A progressive JPEG that holds the payload, whose length is a positive multiple of 64."""
    across, down = tiles_for(len(payload) // 64)
    blocks = np.full((across * down * 6, 64), 255, np.uint8)
    blocks.reshape(-1)[: len(payload)] = np.frombuffer(payload, np.uint8)
    out = [b"\xff\xd8", _segment(0xFE, b"payload=%d" % len(payload)), _segment(0xDB, b"\0" + b"\x01" * 64)]
    size = struct.pack(">BHHB", 8, down * 16, across * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    out += [_segment(0xC2, size), _table(0, 0, 0), _table(1, 0, 7), _table(1, 1, 0)]
    # DC >> 8 is 0: each block sends the one-bit code of "no difference".
    out.append(_scan([(1, 0), (2, 0), (3, 0)], 0, 0, 0, 8, np.zeros(len(blocks), np.uint8)))
    for low in range(7, -1, -1):
        out.append(_scan([(1, 0), (2, 0), (3, 0)], 0, 0, low + 1, low, (blocks[:, 0] >> low) & 1))
    planes = _planes(blocks, across, down)
    for c, p in enumerate(planes, 1):
        for ss, se in ((1, 5), (6, 63)):
            # Code 0 and the seven high bits: one byte for each coefficient.
            out.append(_scan([(c, 0)], ss, se, 0, 1, np.unpackbits(p[:, ss : se + 1] >> 1)))
    for c, p in enumerate(planes, 1):
        ac = p[:, 1:]
        # Code 0 (end of block), then a correction bit for each coefficient: the low bit of its magnitude.
        bits = np.zeros((len(p), 64), np.uint8)
        bits[:, 1:] = (ac & 1) ^ (ac < 128)
        out.append(_scan([(c, 1)], 1, 63, 1, 0, bits.ravel()))
    return b"".join([*out, b"\xff\xd9"])


# ---- reading


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at = np.unpackbits(np.frombuffer(data, np.uint8)).tolist(), 0

    def one(self) -> int:
        if self.at >= len(self.data):
            return 1
        self.at += 1
        return self.data[self.at - 1]

    def many(self, n: int) -> int:
        v = 0
        for _ in range(n):
            v = v << 1 | self.one()
        return v

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for width in range(1, 17):
            code = code << 1 | self.one()
            if (width, code) in table:
                return table[width, code]
        raise ValueError("no such code")

    def value(self, size: int) -> int:
        v = self.many(size)
        return v if not size or v >> (size - 1) else v - (1 << size) + 1


def _codes(body: bytes) -> Iterator[tuple[tuple[int, int], dict[tuple[int, int], int]]]:
    while body:
        counts, at, code, table = body[1:17], 17, 0, {}
        for width, n in enumerate(counts, 1):
            for _ in range(n):
                table[width, code] = body[at]
                code, at = code + 1, at + 1
            code <<= 1
        yield (body[0] >> 4, body[0] & 15), table
        body = body[at:]


class _Part:
    def __init__(self, h: int, v: int, q: int, across: int, down: int, hmax: int, vmax: int, width: int, height: int):
        self.h, self.v, self.q = h, v, q
        self.wide, self.high = across * h, down * v  # blocks, whole tiles
        self.own_wide = -(-(-(-width * h // hmax)) // 8)  # blocks of scans of its own
        self.own_high = -(-(-(-height * v // vmax)) // 8)
        self.coef = np.zeros((self.high, self.wide, 64), np.int32)


def _read_dc(bits: _Bits, parts, tables, tiles: tuple[int, int], ah: int, al: int, restart: int, fresh) -> None:
    last, n = [0] * len(parts), 0
    single = len(parts) == 1
    p0 = parts[0]
    across, down = (p0.own_wide, p0.own_high) if single else tiles
    for r in range(down):
        for c in range(across):
            if restart and n and n % restart == 0:
                bits, last = fresh(), [0] * len(parts)
            n += 1
            for k, p in enumerate(parts):
                for y in range(1 if single else p.v):
                    for x in range(1 if single else p.h):
                        at = (r, c) if single else (r * p.v + y, c * p.h + x)
                        if ah:
                            p.coef[at][0] |= bits.one() << al
                        else:
                            last[k] += bits.value(bits.symbol(tables[k]))
                            p.coef[at][0] = last[k] << al


def _read_ac(bits: _Bits, p: _Part, table, ss: int, se: int, ah: int, al: int, restart: int, fresh) -> None:
    run, n = 0, 0
    for r in range(p.own_high):
        for c in range(p.own_wide):
            if restart and n and n % restart == 0:
                bits, run = fresh(), 0
            n += 1
            b = p.coef[r, c]
            if not ah:
                if run:
                    run -= 1
                    continue
                k = ss
                while k <= se:
                    zeros, size = divmod(bits.symbol(table), 16)
                    if size:
                        k += zeros
                        b[k] = bits.value(size) * (1 << al)
                        k += 1
                    elif zeros == 15:
                        k += 16
                    else:
                        run = (1 << zeros) - 1 + bits.many(zeros)
                        break
                continue
            k = ss
            if not run:
                while k <= se:
                    zeros, size = divmod(bits.symbol(table), 16)
                    new = 0
                    if size:
                        new = (1 if bits.one() else -1) << al
                    elif zeros < 15:
                        run = (1 << zeros) + bits.many(zeros)
                        break
                    while k <= se:
                        if b[k]:
                            if bits.one() and not (abs(int(b[k])) >> al) & 1:
                                b[k] += (1 if b[k] > 0 else -1) << al
                        elif zeros:
                            zeros -= 1
                        else:
                            b[k] = new
                            k += 1
                            break
                        k += 1
            if run:
                while k <= se:
                    if b[k] and bits.one() and not (abs(int(b[k])) >> al) & 1:
                        b[k] += (1 if b[k] > 0 else -1) << al
                    k += 1
                run -= 1


def _even_scan(data: bytes, parts, tables, tiles, ss: int, se: int, ah: int, al: int) -> bool:
    """Reads a scan whose codes all have the same width at once; False if it is not of that kind."""
    one = [t.get((1, 0)) if len(t) == 1 else None for t in tables]
    width = se - ss + 1
    if ss == 0:
        if len(parts) > 1 and [(p.h, p.v) for p in parts] != [(2, 2), (1, 1), (1, 1)] or len(parts) == 1 or not ah and any(x != 0 for x in one):
            return False
        across, down = tiles
        n = across * down * 6
        if not ah:
            return True  # no difference anywhere: all stay 0
        bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(np.int32) << al
        t = bits.reshape(down, across, 6)
        parts[0].coef[:, :, 0] |= t[:, :, :4].reshape(down, across, 2, 2).transpose(0, 2, 1, 3).reshape(down * 2, across * 2)
        for k, p in enumerate(parts[1:], 4):
            p.coef[:, :, 0] |= t[:, :, k]
        return True
    p = parts[0]
    if one[0] is None or (p.own_wide, p.own_high) != (p.wide, p.high):
        return False
    n = p.wide * p.high
    here = p.coef[:, :, ss : se + 1]
    if not ah and one[0] and one[0] < 16:
        size = one[0]
        bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width * (size + 1)).reshape(n * width, size + 1)
        v = bits[:, 1:].astype(np.int32) @ (1 << np.arange(size - 1, -1, -1, dtype=np.int32))
        v = np.where(v >> (size - 1), v, v - (1 << size) + 1) * (1 << al)
        here[:] = v.reshape(p.high, p.wide, width)
        return True
    if ah and one[0] == 0 and here.all():
        bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * (width + 1)).reshape(p.high, p.wide, width + 1)
        low = bits[:, :, 1:].astype(np.int32) << al
        here += np.where(here > 0, low, -low)
        return True
    return False


def coefficients(data: bytes) -> tuple[list[_Part], dict[int, np.ndarray], tuple[int, int, int, int], bytes]:
    """All scans of a progressive JPEG: components, quantisation, (width, height, tiles across, down), comment."""
    at, quant, tables, parts, comment, restart = 2, {}, {}, {}, b"", 0
    size = (0, 0, 0, 0)
    while at < len(data):
        marker = data[at + 1]
        if marker == 0xD9:
            break
        length = struct.unpack(">H", data[at + 2 : at + 4])[0]
        body, at = data[at + 4 : at + 2 + length], at + 2 + length
        if marker == 0xFE:
            comment = body
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int32)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            tables.update(_codes(body))
        elif marker == 0xC2:
            _, height, width, n = struct.unpack(">BHHB", body[:6])
            spec = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
            hmax, vmax = max(h for _, h, _, _ in spec), max(v for *_, v, _ in spec)
            across, down = -(-width // (8 * hmax)), -(-height // (8 * vmax))
            size = (width, height, across, down)
            parts = {i: _Part(h, v, q, across, down, hmax, vmax, width, height) for i, h, v, q in spec}
        elif 0xC0 <= marker <= 0xCF:
            raise ValueError("only progressive Huffman files are read")
        elif marker == 0xDA:
            n = body[0]
            chosen = [parts[body[1 + 2 * k]] for k in range(n)]
            ss, se, ah, al = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
            kind = 0 if ss == 0 else 1
            which = [body[2 + 2 * k] >> 4 if ss == 0 else body[2 + 2 * k] & 15 for k in range(n)]
            coded = [tables.get((kind, w), {}) for w in which]
            segments = []
            while True:  # up to the next marker that is not a restart
                end = at
                while True:
                    end = data.index(b"\xff", end)
                    if data[end + 1]:
                        break
                    end += 2
                segments.append(data[at:end].replace(b"\xff\x00", b"\xff"))
                at = end
                if not 0xD0 <= data[end + 1] <= 0xD7:
                    break
                at += 2
            if not restart and _even_scan(segments[0], chosen, coded, size[2:], ss, se, ah, al):
                continue
            rest = iter(segments)
            fresh = lambda rest=rest: _Bits(next(rest))
            if ss == 0:
                _read_dc(fresh(), chosen, coded, size[2:], ah, al, restart, fresh)
            else:
                _read_ac(fresh(), chosen[0], coded[0], ss, se, ah, al, restart, fresh)
    return list(parts.values()), quant, size, comment


def rgb_tensor(parts: list[_Part], quant: dict[int, np.ndarray], size: tuple[int, int, int, int]) -> np.ndarray:
    """Full-resolution RGB bytes (height, width, 3) from coefficients."""
    width, height = size[:2]
    hmax, vmax = max(p.h for p in parts), max(p.v for p in parts)
    planes = []
    for p in parts:
        block = np.zeros((p.high * p.wide, 64), np.float32)
        block[:, ZIGZAG] = (p.coef.reshape(-1, 64) * quant[p.q]).astype(np.float32)
        rows = block.reshape(-1, 8) @ DCT  # along x
        cells = rows.reshape(-1, 8, 8).transpose(0, 2, 1).reshape(-1, 8) @ DCT  # along y
        pixels = cells.reshape(p.high, p.wide, 8, 8).transpose(0, 3, 1, 2).reshape(p.high * 8, p.wide * 8) + np.float32(128)
        planes.append(np.repeat(np.repeat(pixels, vmax // p.v, axis=0), hmax // p.h, axis=1)[:height, :width])
    if len(planes) == 1:
        full = [planes[0]] * 3
    else:
        y, cb, cr = planes[0], planes[1] - np.float32(128), planes[2] - np.float32(128)
        full = [y + np.float32(1.402) * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + np.float32(1.772) * cb]
    return np.stack([np.clip(np.rint(x), 0, 255).astype(np.uint8) for x in full], axis=2)


def decode(data: bytes) -> np.ndarray:
    """The RGB tensor of a progressive JPEG."""
    return rgb_tensor(*coefficients(data)[:3])


def payload_of(parts: list[_Part], size: tuple[int, int, int, int], comment: bytes) -> bytes:
    """The payload that store_payload() put in, from the coefficients that were read."""
    planes = []
    for p in parts:
        c = p.coef.reshape(-1, 64)
        planes.append(np.where((c < 0) & (np.arange(64) > 0), c + 255, c).astype(np.uint8))
    return _tiles(planes, size[2], size[3]).tobytes()[: int(comment.removeprefix(b"payload="))]


def padded(text: str) -> tuple[int, bytes]:
    raw = text.encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\xff" * (-len(raw) % UNIT or (0 if raw else UNIT))


def feature_of(rgb: np.ndarray) -> str:
    """Size, mean of each channel, and a checksum of the tensor."""
    mean = rgb.reshape(-1, 3).mean(axis=0, dtype=np.float64)
    return f"{rgb.shape[1]}x{rgb.shape[0]};" + ",".join(f"{m:.3f}" for m in mean) + f";{zlib.crc32(rgb):08x}"


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tensors: bool = True, part_bytes: int = 8_000_000) -> DataFrame:
    """Per row: id, n_bytes, payload (as read back), media (the file), width, height, rgb (if asked for), feature."""
    ship(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("__id"), text_or_empty(text_col).alias("__text"))
    kind = own.schema["__id"].dataType.simpleString()
    columns = ["n_bytes", "payload", "media", "width", "height", *["rgb"] * tensors, "feature"]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, out, held, begun = pdf[["__id"]], [], 0, 0
            for n, text in enumerate(pdf["__text"], 1):
                n_bytes, payload = padded(text)
                media = store_payload(payload)
                parts, quant, size, comment = coefficients(media)
                rgb = rgb_tensor(parts, quant, size)
                back = payload_of(parts, size, comment)
                out.append((n_bytes, back, media, size[0], size[1], *[rgb.tobytes()] * tensors, feature_of(rgb)))
                held += len(back) + len(media) + rgb.nbytes * tensors
                if held > part_bytes or n == len(pdf):
                    yield ids.iloc[begun:n].reset_index(drop=True).join(pd.DataFrame(out, columns=columns))
                    out, held, begun = [], 0, n

    tensor = "rgb binary, " if tensors else ""
    schema = f"__id {kind}, n_bytes bigint, payload binary, media binary, width int, height int, {tensor}feature string"
    return own.mapInPandas(work, schema).withColumnRenamed("__id", id_col)
