"""Codecs of image files on NumPy and the standard library: DICOM, PNG and TIFF.

Every decoder takes bytes and gives a (rows, columns) or (rows, columns,
channels) array; files they can't read raise UnsupportedFile.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

from rasterloom.errors import UnsupportedFile

# -- DICOM (Part 10 files; explicit or implicit VR, little endian, uncompressed) ------------

# Fixed values of the DICOM standard: tags, transfer syntaxes and long value representations.
TAGS = {
    (0x0002, 0x0010): "transfer_syntax",
    (0x0028, 0x0002): "samples",
    (0x0028, 0x0010): "rows",
    (0x0028, 0x0011): "cols",
    (0x0028, 0x0100): "bits_allocated",
    (0x0028, 0x0101): "bits_stored",
    (0x0028, 0x0103): "signed",
    (0x0028, 0x1050): "window_center",
    (0x0028, 0x1051): "window_width",
}
PIXELS = (0x7FE0, 0x0010)
IMPLICIT, EXPLICIT = "1.2.840.10008.1.2", "1.2.840.10008.1.2.1"
LONG_VR = {b"OB", b"OD", b"OF", b"OL", b"OV", b"OW", b"SQ", b"UC", b"UN", b"UR", b"UT", b"SV", b"UV"}


def _first_number(raw: bytes) -> float | None:
    text = raw.decode("ascii", "replace").strip(" \0").split("\\")[0]
    try:
        return float(text)
    except ValueError:
        return None


def _skip_sequence(data: bytes, at: int, implicit: bool) -> int:
    """Position after a sequence or item of undefined length."""
    while at + 8 <= len(data):
        group, element, size = struct.unpack_from("<HHI", data, at)
        if group == 0xFFFE:
            at += 8
            if element in (0xE0DD, 0xE00D):
                return at
            at = _skip_sequence(data, at, implicit) if size == 0xFFFFFFFF else at + size
            continue
        head, size = _element(data, at, implicit)
        at = _skip_sequence(data, head, implicit) if size == 0xFFFFFFFF else head + size
    return at


def _element(data: bytes, at: int, implicit: bool) -> tuple[int, int]:
    """Start and size of an element's value."""
    if implicit:
        return at + 8, struct.unpack_from("<I", data, at + 4)[0]
    if data[at + 4 : at + 6] in LONG_VR:
        return at + 12, struct.unpack_from("<I", data, at + 8)[0]
    return at + 8, struct.unpack_from("<H", data, at + 6)[0]


def parse_dicom(data: bytes) -> tuple[dict, int | None, int]:
    """Header values, and start and size of the pixel data (None if the bytes end before it)."""
    if data[128:132] != b"DICM":
        raise UnsupportedFile("not a DICOM file")
    at, head, implicit = 132, {}, False
    while at + 8 <= len(data):
        tag = struct.unpack_from("<HH", data, at)
        if tag[0] > 2 and "transfer_syntax" in head:
            if head["transfer_syntax"] not in (IMPLICIT, EXPLICIT):
                raise UnsupportedFile(f"transfer syntax {head['transfer_syntax']} is not read")
            implicit = head["transfer_syntax"] == IMPLICIT
        try:
            start, size = _element(data, at, implicit and tag[0] > 2)
        except struct.error:
            break
        if tag == PIXELS:
            return head, start, size
        if size == 0xFFFFFFFF:
            at = _skip_sequence(data, start, implicit)
            continue
        raw = data[start : start + size]
        if name := TAGS.get(tag):
            if name == "transfer_syntax":
                head[name] = raw.decode("ascii").strip(" \0")
            elif name.startswith("window"):
                head[name] = _first_number(raw)
            elif len(raw) >= 2:
                head[name] = struct.unpack_from("<H", raw)[0]
        at = start + size
    return head, None, 0


def header_of(data: bytes) -> dict:
    """Header values of as much of a file as there is; none if it is no DICOM file that is read."""
    try:
        return parse_dicom(data)[0]
    except UnsupportedFile:
        return {}


def decode_dicom(data: bytes) -> tuple[dict, np.ndarray]:
    head, start, size = parse_dicom(data)
    if start is None or not head.get("rows") or not head.get("cols"):
        raise UnsupportedFile("DICOM file without pixels")
    kind = {8: "<u1", 16: "<u2", 32: "<u4"}.get(head.get("bits_allocated", 16))
    if kind is None:
        raise UnsupportedFile("unusual pixel size")
    kind = kind.replace("u", "i") if head.get("signed") else kind
    n = head["rows"] * head["cols"] * head.get("samples", 1)
    if len(data) < start + n * np.dtype(kind).itemsize:
        raise UnsupportedFile("DICOM file is cut off")
    x = np.frombuffer(data, kind, n, start)
    shape = (head["rows"], head["cols"]) + ((head["samples"],) if head.get("samples", 1) > 1 else ())
    return head, x.reshape(shape)


def encode_dicom(x: np.ndarray, bits_stored: int = 16, window: tuple[float, float] | None = None, implicit: bool = False) -> bytes:
    """MONOCHROME2, 16 bits allocated, little endian."""
    pixels = np.clip(np.asarray(x, float), 0, 65535).astype("<u2").tobytes()

    def put(group: int, element: int, vr: bytes, value: bytes, plain: bool = False) -> bytes:
        value += b"" if len(value) % 2 == 0 else (b"\0" if vr in (b"UI", b"OW", b"OB") else b" ")
        if implicit and not plain:
            return struct.pack("<HHI", group, element, len(value)) + value
        if vr in LONG_VR:
            return struct.pack("<HH2sHI", group, element, vr, 0, len(value)) + value
        return struct.pack("<HH2sH", group, element, vr, len(value)) + value

    us = lambda v: struct.pack("<H", v)
    meta = put(2, 0x10, b"UI", (IMPLICIT if implicit else EXPLICIT).encode(), plain=True)
    meta = put(2, 0, b"UL", struct.pack("<I", len(meta)), plain=True) + meta
    body = put(0x28, 2, b"US", us(1)) + put(0x28, 4, b"CS", b"MONOCHROME2") + put(0x28, 0x10, b"US", us(x.shape[0])) + put(0x28, 0x11, b"US", us(x.shape[1]))
    body += put(0x28, 0x100, b"US", us(16)) + put(0x28, 0x101, b"US", us(bits_stored)) + put(0x28, 0x102, b"US", us(bits_stored - 1)) + put(0x28, 0x103, b"US", us(0))
    if window:
        body += put(0x28, 0x1050, b"DS", f"{window[0]:g}".encode()) + put(0x28, 0x1051, b"DS", f"{window[1]:g}".encode())
    return b"\0" * 128 + b"DICM" + meta + body + put(*PIXELS, b"OW", pixels)


# -- PNG (8 and 16 bits, grey, RGB and with alpha; no interlacing) ---------------------------

PNG_MARK = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def _unfilter(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 2:
        return line + above
    out = line.copy()
    if kind == 1:
        for k in range(step):
            out[k::step] = np.cumsum(line[k::step], dtype=np.uint64).astype(np.uint8)
        return out
    for i in range(len(line)):
        a = int(out[i - step]) if i >= step else 0
        b, c = int(above[i]), int(above[i - step]) if i >= step else 0
        if kind == 3:
            guess = (a + b) // 2
        else:
            pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
        out[i] = (int(line[i]) + guess) & 255
    return out


def decode_png(data: bytes) -> np.ndarray:
    if data[:8] != PNG_MARK:
        raise UnsupportedFile("not a PNG file")
    at, idat, head = 8, b"", None
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        chunk = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"IDAT":
            idat += chunk
        at += size + 12
    if head is None or head[2] not in (8, 16) or head[3] not in CHANNELS or head[6]:
        raise UnsupportedFile("this kind of PNG is not read")
    w, h, depth, colour = head[:4]
    step = CHANNELS[colour] * depth // 8
    try:
        raw = np.frombuffer(zlib.decompress(idat), np.uint8)
        raw = raw.reshape(h, 1 + w * step)
    except (zlib.error, ValueError) as e:
        raise UnsupportedFile("PNG file is damaged") from e
    out = np.zeros((h, w * step), np.uint8)
    above = np.zeros(w * step, np.uint8)
    for r in range(h):
        above = out[r] = _unfilter(int(raw[r, 0]), raw[r, 1:], above, step)
    x = out.reshape(h, w, -1) if depth == 8 else out.reshape(h, w, -1, 2).view(">u2")[..., 0].astype(np.uint16)
    return x[:, :, 0] if CHANNELS[colour] == 1 else x


def encode_png(x: np.ndarray) -> bytes:
    """8-bit PNG; values are clipped to 0..255 and cut to whole numbers."""
    x = np.clip(np.nan_to_num(np.asarray(x, float)), 0, 255).astype(np.uint8)
    x = x[:, :, None] if x.ndim == 2 else x
    h, w, c = x.shape
    colour = {v: k for k, v in CHANNELS.items()}[c]
    lines = np.zeros((h, 1 + w * c), np.uint8)
    lines[:, 1:] = x.reshape(h, -1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return PNG_MARK + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


# -- TIFF (strips; uncompressed, PackBits or deflate; 8, 16 and 32 bits) ------------------------


def _packbits(raw: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(raw):
        n = raw[i]
        if n < 128:
            out += raw[i + 1 : i + 2 + n]
            i += n + 2
        elif n > 128:
            out += raw[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out)


def decode_tiff(data: bytes) -> np.ndarray:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise UnsupportedFile("not a TIFF file")
    at = struct.unpack_from(order + "I", data, 4)[0]
    tags: dict[int, tuple] = {}
    kinds = {1: "B", 3: "H", 4: "I"}
    try:
        for i in range(struct.unpack_from(order + "H", data, at)[0]):
            tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            if kind in kinds:
                size = n * struct.calcsize(kinds[kind])
                where = at + 10 + 12 * i if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * i)[0]
                tags[tag] = struct.unpack_from(f"{order}{n}{kinds[kind]}", data, where)
        w, h = tags[256][0], tags[257][0]
        bits, packing, channels = tags.get(258, (1,))[0], tags.get(259, (1,))[0], tags.get(277, (1,))[0]
        unpack = {1: bytes, 5: None, 8: zlib.decompress, 32946: zlib.decompress, 32773: _packbits}.get(packing)
        if bits not in (8, 16, 32) or unpack is None:
            raise UnsupportedFile("this kind of TIFF is not read")
        raw = b"".join(unpack(data[o : o + n]) for o, n in zip(tags[273], tags[279]))
        x = np.frombuffer(raw, f"{order}u{bits // 8}", h * w * channels).reshape(h, w, channels)
    except (struct.error, KeyError, ValueError, zlib.error) as e:
        raise UnsupportedFile("TIFF file is damaged") from e
    return x[:, :, 0] if channels == 1 else x


def encode_tiff(x: np.ndarray) -> bytes:
    """8-bit grey TIFF with one deflated strip."""
    x = np.clip(np.nan_to_num(np.asarray(x, float)), 0, 255).astype(np.uint8)
    body = zlib.compress(x.tobytes())
    entries = [(256, 4, x.shape[1]), (257, 4, x.shape[0]), (258, 3, 8), (259, 3, 8), (262, 3, 1), (273, 4, 8), (277, 3, 1), (278, 4, x.shape[0]), (279, 4, len(body))]
    at = 8 + len(body) + len(body) % 2
    ifd = struct.pack("<H", len(entries))
    for tag, kind, value in entries:
        ifd += struct.pack("<HHI", tag, kind, 1) + (struct.pack("<HH", value, 0) if kind == 3 else struct.pack("<I", value))
    return struct.pack("<2sHI", b"II", 42, at) + body + b"\0" * (len(body) % 2) + ifd + struct.pack("<I", 0)


# -- JPEG (baseline, written only) --------------------------------------------------------

# The example tables of the JPEG standard, annex K.
_QUANT = np.array(
    [16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62, 18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99]
).reshape(8, 8)
_DC_COUNTS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
_AC_COUNTS = (0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125)
_AC_VALUES = bytes.fromhex(
    "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a434445464748494a535455565758595a636465666768696a737475767778797a"
    "838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa"
)
_DC_VALUES = bytes(range(12))
#: Places of an 8 x 8 block along its anti-diagonals, turning at every border.
_ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
_COSINES = np.cos((2 * np.arange(8)[None, :] + 1) * np.arange(8)[:, None] * np.pi / 16) * np.where(np.arange(8) == 0, np.sqrt(1 / 8), 0.5)[:, None]


def _codes(counts: tuple, values: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Code and length of every symbol of a Huffman table."""
    code, size, at, n = np.zeros(256, np.int64), np.zeros(256, np.int64), 0, 0
    for length, count in enumerate(counts, 1):
        for v in values[n : n + count]:
            code[v], size[v] = at, length
            at += 1
        n += count
        at <<= 1
    return code, size


def encode_jpeg(x: np.ndarray, quality: int = 90) -> bytes:
    """Baseline JPEG of a grey (rows, columns) or colour (rows, columns, 3) image; values are clipped to 0..255.

    All blocks are transformed at once; the symbols of all blocks are placed by
    one sort and written by one bit expansion.
    """
    x = np.clip(np.nan_to_num(np.asarray(x, float)), 0, 255)
    if x.ndim == 3 and x.shape[2] == 1:
        x = x[:, :, 0]
    if x.ndim == 3:
        r, g, b = (x[:, :, i] for i in range(3))
        y = 0.299 * r + 0.587 * g + 0.114 * b
        planes = [y, 128 + (b - y) / 1.772, 128 + (r - y) / 1.402]
    else:
        planes = [x]
    h, w = x.shape[:2]
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    quant = np.clip((_QUANT * scale + 50) // 100, 1, 255)
    blocks = []
    for p in planes:
        p = np.pad(p, ((0, -h % 8), (0, -w % 8)), mode="edge") - 128
        tiles = p.reshape(p.shape[0] // 8, 8, p.shape[1] // 8, 8).swapaxes(1, 2).reshape(-1, 8, 8)
        blocks.append(np.rint(_COSINES @ tiles @ _COSINES.T / quant).astype(np.int64).reshape(-1, 64)[:, _ZIGZAG])
    z = np.stack(blocks, axis=1)  # block, plane, coefficient
    z[1:, :, 0] = np.diff(z[:, :, 0], axis=0)
    z = z.reshape(-1, 64)
    bits = lambda v: np.where(v == 0, 0, np.floor(np.log2(np.maximum(np.abs(v), 1))).astype(np.int64) + 1)
    tail = lambda v, n: np.where(v < 0, v + (1 << n) - 1, v)
    dc_code, dc_size = _codes(_DC_COUNTS, _DC_VALUES)
    ac_code, ac_size = _codes(_AC_COUNTS, _AC_VALUES)
    n = bits(z[:, 0])
    parts = [(np.arange(len(z)) * 256, dc_code[n] << n | tail(z[:, 0], n), dc_size[n] + n)]
    block, k = np.nonzero(z[:, 1:])
    k += 1
    v = z[block, k]
    before = np.where(np.diff(block, prepend=-1) != 0, 0, np.roll(k, 1))
    run = k - before - 1
    long = np.repeat(np.arange(len(k)), run // 16)
    parts.append((block[long] * 256 + k[long] * 2, np.full(len(long), ac_code[0xF0]), np.full(len(long), ac_size[0xF0])))
    n = bits(v)
    symbol = (run % 16) << 4 | n
    parts.append((block * 256 + k * 2 + 1, ac_code[symbol] << n | tail(v, n), ac_size[symbol] + n))
    end = np.flatnonzero(z[:, 63] == 0)
    parts.append((end * 256 + 255, np.full(len(end), ac_code[0]), np.full(len(end), ac_size[0])))
    key, code, size = (np.concatenate(c) for c in zip(*parts))
    order = np.argsort(key, kind="stable")
    code, size = code[order], size[order]
    left = np.repeat(np.cumsum(size), size) - np.arange(size.sum()) - 1
    stream = (np.repeat(code, size) >> left & 1).astype(np.uint8)
    data = np.packbits(np.concatenate((stream, np.ones(-len(stream) % 8, np.uint8)))).tobytes().replace(b"\xff", b"\xff\0")
    part = lambda mark, body: struct.pack(">BBH", 255, mark, len(body) + 2) + body
    ids = range(1, len(planes) + 1)
    return b"".join([
        b"\xff\xd8", part(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"), part(0xDB, b"\0" + quant.ravel()[_ZIGZAG].astype(np.uint8).tobytes()),
        part(0xC0, struct.pack(">BHHB", 8, h, w, len(planes)) + b"".join(bytes([i, 0x11, 0]) for i in ids)),
        part(0xC4, b"\0" + bytes(_DC_COUNTS) + _DC_VALUES), part(0xC4, b"\x10" + bytes(_AC_COUNTS) + _AC_VALUES),
        part(0xDA, bytes([len(planes)]) + b"".join(bytes([i, 0]) for i in ids) + b"\0\x3f\0"), data, b"\xff\xd9",
    ])
