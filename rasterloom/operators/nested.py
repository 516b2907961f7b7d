"""Deeply nested records to related flat tables, by vectorised structural indexing (problem 3).

The JSON texts of a batch are one byte buffer. Bitmaps of escapes, quotes and
structural characters, prefix sums of quote parity and nesting depth, and a sort
by depth give every member of every container as a span, without walking any
document. Children are then found level by level with array lookups, and each
emitted row carries the positions of its parents.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes indexed at once; a longer document is indexed alone.
CHUNK_BYTES = 2 << 20

OBJECT, ARRAY, STRING, SCALAR, NULL = 1, 2, 3, 4, 5

# The names the two writers give to one thing.
IMAGES = ("Images", "images")
ROIS = ("ROIs", "rois")
ROI_TYPE = ("Type", "roi_type")
ROI_NAME = ("Name", "name")
POINTS = ("Point_px", "points_px")

_NUMBER = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
_PAIR = rf"^\s*\(\s*(?P<x>{_NUMBER})\s*,\s*(?P<y>{_NUMBER})\s*(?:,[^)]*)?\)\s*$"

SCHEMA = pa.schema(
    [
        ("kind", pa.string()),
        ("record_id", pa.int64()),
        ("image_no", pa.int32()),
        ("roi_no", pa.int32()),
        ("point_no", pa.int32()),
        ("roi_type", pa.int32()),
        ("roi_name", pa.string()),
        ("x", pa.float64()),
        ("y", pa.float64()),
    ]
)
DDL = "kind string, record_id bigint, image_no int, roi_no int, point_no int, roi_type int, roi_name string, x double, y double"


class StructuralIndex:
    """Spans of all members of all containers of a batch of JSON texts.

    A text that is empty, cut off or unbalanced has no members (``ok`` is False).
    """

    def __init__(self, texts: list[bytes]):
        self.n = len(texts)
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, self.n)
        self.data = data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        self.start = np.concatenate(([0], np.cumsum(lengths)[:-1])) if self.n else np.zeros(0, np.int64)
        self.end = self.start + lengths - 1
        self._bitmaps()
        self._tokens()
        self._members()

    def _bitmaps(self) -> None:
        d = self.data
        slash = d == 92
        # a character is escaped after a run of backslashes of odd length
        last_other = np.maximum.accumulate(np.where(slash, -1, np.arange(len(d), dtype=np.int64))) if len(d) else np.zeros(0, np.int64)
        run = np.zeros(len(d), np.int64)
        if len(d):
            run[1:] = np.arange(len(d) - 1) - last_other[:-1]
        quote = (d == 34) & (run % 2 == 0)
        self.quotes = np.cumsum(quote, dtype=np.int64)
        self.slashes = np.cumsum(slash, dtype=np.int64)
        self.solid = np.flatnonzero((d != 32) & (d != 10) & (d != 13) & (d != 9))
        self.quote = quote

    def _tokens(self) -> None:
        d = self.data
        is_open, is_close = (d == 123) | (d == 91), (d == 125) | (d == 93)
        pos = np.flatnonzero(is_open | is_close | (d == 44) | (d == 58))
        doc = np.searchsorted(self.start, pos, "right") - 1
        before = self.quotes[self.start - 1] if self.n else np.zeros(0, np.int64)
        if self.n:
            before[0] = 0
        outside = (self.quotes[pos] - before[doc]) % 2 == 0
        self.pos, self.doc = pos, doc = pos[outside], doc[outside]
        step = is_open[pos].astype(np.int64) - is_close[pos]
        total = np.cumsum(step)
        first = np.searchsorted(doc, np.arange(self.n))
        base = np.where(first > 0, total[np.maximum(first, 1) - 1], 0) if len(total) else np.zeros(self.n, np.int64)
        after = total - base[doc]
        self.depth = after + is_close[pos]  # of the container that the token belongs to
        self.opens, self.closes, self.colon = is_open[pos], is_close[pos], d[pos] == 58
        # the text as a whole: even quotes, depth back at 0 and never below, one root
        stop = np.searchsorted(doc, np.arange(self.n), "right")
        ok = (self.quotes[self.end] - before) % 2 == 0 if self.n else np.zeros(0, bool)
        has = stop > first
        last = np.maximum(stop - 1, 0)
        if len(after):
            ok &= ~has | (after[last] == 0)
            low = np.zeros(self.n, np.int64)
            np.minimum.at(low, doc, self.depth - 1)
            ok &= low >= 0
        i, j = np.searchsorted(self.solid, self.start), np.searchsorted(self.solid, self.end) - 1
        self.blank = j < i
        ok &= ~self.blank
        self.head = self.solid[np.minimum(i, max(len(self.solid) - 1, 0))] if len(self.solid) else self.start
        self.tail = self.solid[np.maximum(j, 0)] if len(self.solid) else self.start
        self.first, self.ok = first, ok
        root = np.flatnonzero(ok & has)
        if len(root):
            t = first[root]
            container = self.opens[t] & (self.pos[t] == self.head[root])
            roots = np.bincount(doc[self.opens & (self.depth == 1)], minlength=self.n)[root]
            ends = self.closes[last[root]] & (self.pos[last[root]] == self.tail[root])
            self.ok[root[~(container & (roots == 1) & ends)]] = False

    def _members(self) -> None:
        d = self.data
        plain = np.flatnonzero(~self.colon)
        order = plain[np.lexsort((self.pos[plain], self.depth[plain], self.doc[plain]))]
        starts = ~self.closes[order]
        k = np.flatnonzero(starts)
        k = k[k + 1 < len(order)]
        tok, nxt = order[k], order[k + 1]
        # the last opener at this depth is the container
        at = np.where(self.opens[order], np.arange(len(order)), -1)
        at = np.maximum.accumulate(at) if len(at) else at
        holder_at = at[k]
        same = (holder_at >= 0) & (self.doc[tok] == self.doc[nxt]) & (self.depth[tok] == self.depth[nxt]) & ~self.opens[nxt]
        tok, nxt, k, holder_at = tok[same], nxt[same], k[same], holder_at[same]
        self.m_tok, self.m_holder = tok, order[holder_at] if len(order) else tok
        self.m_index = k - holder_at
        # a colon right after the start token ends the key
        follow = np.minimum(tok + 1, max(len(self.pos) - 1, 0))
        keyed = self.colon[follow] & (self.doc[follow] == self.doc[tok]) if len(tok) else np.zeros(0, bool)
        self.m_key0, self.m_key1 = self._trim(self.pos[tok] + 1, np.where(keyed, self.pos[follow], self.pos[tok] + 1))
        self.m_val0, self.m_val1 = self._trim(np.where(keyed, self.pos[follow], self.pos[tok]) + 1, self.pos[nxt])
        real = self.m_val1 > self.m_val0
        hollow = ~real & (self.m_index == 0) & self.closes[nxt] & ~keyed  # {} and []
        wrong = ~real & ~hollow | (keyed != (d[self.pos[self.m_holder]] == 123)) & real
        paired = ~self.closes[nxt] | (d[self.pos[nxt]] == d[self.pos[self.m_holder]] + 2)
        self.ok[np.unique(self.doc[tok[wrong | ~paired]])] = False
        use = real & self.ok[self.doc[tok]]
        for name in ("m_tok", "m_holder", "m_index", "m_key0", "m_key1", "m_val0", "m_val1"):
            setattr(self, name, getattr(self, name)[use])
        self.m_doc = self.doc[self.m_tok]
        c = d[self.m_val0]
        kind = np.full(len(c), SCALAR)
        kind[c == 123], kind[c == 91], kind[c == 34], kind[c == 110] = OBJECT, ARRAY, STRING, NULL
        self.m_kind = kind
        self.m_open = np.where((kind == OBJECT) | (kind == ARRAY), np.searchsorted(self.pos, self.m_val0), -1)
        # members by their container
        self.by_holder = np.lexsort((self.m_index, self.m_holder))
        self.holders = self.m_holder[self.by_holder]

    def _trim(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i, j = np.searchsorted(self.solid, a), np.searchsorted(self.solid, b)
        none = j <= i
        top = max(len(self.solid) - 1, 0)
        if not len(self.solid):
            return a, a
        return np.where(none, a, self.solid[np.minimum(i, top)]), np.where(none, a, self.solid[np.maximum(j - 1, 0)] + 1)

    # -- lookups -----------------------------------------------------------

    def roots(self) -> tuple[np.ndarray, np.ndarray]:
        """Documents whose root is an object, and that object's opener."""
        docs = np.flatnonzero(self.ok & (self.data[self.head] == 123)) if self.n else np.zeros(0, np.int64)
        return docs, self.first[docs]

    def children(self, opener: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All members of the containers: (index into opener, member)."""
        lo, hi = np.searchsorted(self.holders, opener), np.searchsorted(self.holders, opener, "right")
        count = hi - lo
        owner = np.repeat(np.arange(len(opener)), count)
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
        return owner, self.by_holder[at]

    def has_key(self, member: np.ndarray, names: tuple[str, ...]) -> np.ndarray:
        a, b = self.m_key0[member], self.m_key1[member]
        out = np.zeros(len(member), bool)
        for name in names:
            raw = np.frombuffer(json.dumps(name).encode(), np.uint8)
            fit = np.flatnonzero(b - a == len(raw))
            out[fit[(self.data[a[fit][:, None] + np.arange(len(raw))] == raw).all(1)]] = True
        for i in np.flatnonzero((b > a) & (self.slashes[np.maximum(b - 1, 0)] > self.slashes[np.maximum(a - 1, 0)])):
            out[i] = self.decode(a[i], b[i]) in names
        return out

    def value(self, opener: np.ndarray, names: tuple[str, ...]) -> np.ndarray:
        """The member with one of the names per object, -1 if there is none; the last of repeated ones."""
        owner, member = self.children(opener)
        hit = self.has_key(member, names)
        out = np.full(len(opener), -1)
        out[owner[hit]] = member[hit]
        return out

    def as_list(self, owner: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Elements of list values: (owner, element, position). A lone value is a list of one, null an empty list."""
        keep = member >= 0
        owner, member = owner[keep], member[keep]
        kind = self.m_kind[member]
        many, lone = kind == ARRAY, (kind != ARRAY) & (kind != NULL)
        who, element = self.children(self.m_open[member[many]])
        return (
            np.concatenate((owner[many][who], owner[lone])),
            np.concatenate((element, member[lone])),
            np.concatenate((self.m_index[element], np.zeros(lone.sum(), np.int64))),
        )

    def decode(self, a: int, b: int):
        try:
            return json.loads(self.data[a:b].tobytes())
        except ValueError:
            return None

    def texts(self, member: np.ndarray) -> pa.Array:
        """Values of the members as text: strings without their quotes, scalars as written; null for -1 and null."""
        got = member >= 0
        m = np.where(got, member, 0)
        if not len(self.m_val0):
            return pa.nulls(len(member), pa.string())
        string = (self.m_kind[m] == STRING).astype(np.int64)
        a, b = self.m_val0[m] + string, np.maximum(self.m_val1[m] - string, self.m_val0[m] + string)
        got &= (self.m_kind[m] != NULL) & (self.m_kind[m] != OBJECT) & (self.m_kind[m] != ARRAY)
        size = np.where(got, b - a, 0)
        offset = np.concatenate(([0], np.cumsum(size)))
        at = np.arange(offset[-1]) - np.repeat(offset[:-1], size) + np.repeat(a, size)
        out = pa.LargeStringArray.from_buffers(len(m), pa.py_buffer(offset.astype(np.int64).tobytes()), pa.py_buffer(self.data[at].tobytes()))
        out = pc.if_else(pa.array(got), out, pa.scalar(None, pa.large_string())).cast(pa.string())
        odd = np.flatnonzero(got & (string == 1) & (self.slashes[np.maximum(b - 1, 0)] > self.slashes[np.maximum(a - 1, 0)]))
        if len(odd):
            fixed = out.to_pylist()
            for i in odd:
                fixed[i] = self.decode(a[i] - 1, b[i] + 1)
            out = pa.array(fixed, pa.string())
        return out


def _numbers(text: pa.Array) -> np.ndarray:
    """Texts as numbers; NaN where they are none."""
    clean = pc.utf8_trim_whitespace(text)
    good = pc.fill_null(pc.match_substring_regex(clean, rf"^{_NUMBER}$"), False)
    return pc.fill_null(pc.if_else(good, clean, pa.scalar(None, pa.string())).cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)


def _emit(ids: np.ndarray, n: int, kind: str, **cols) -> pa.RecordBatch:
    """Rows of one kind; levels that do not apply are -1."""
    full = {"image_no": -1, "roi_no": -1, "point_no": -1, "roi_type": -1}
    arrays = []
    for f in SCHEMA:
        if f.name == "kind":
            v = pa.array(np.full(n, kind, object), f.type)
        elif f.name == "record_id":
            v = pa.array(ids, f.type)
        elif f.name in cols:
            v = cols[f.name] if isinstance(cols[f.name], pa.Array) else pa.array(np.asarray(cols[f.name]), f.type)
        elif f.name in full:
            v = pa.array(np.full(n, full[f.name]), f.type)
        else:
            v = pa.nulls(n, f.type)
        arrays.append(v.cast(f.type))
    return pa.RecordBatch.from_arrays(arrays, schema=SCHEMA)


def _flatten(texts: list[bytes], ids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of the documents; those inside outer objects are looked for level by level, those inside outer strings are flattened in turn, to any depth."""
    x = StructuralIndex(texts)
    doc, root = x.roots()
    image_list = x.value(root, IMAGES)
    inner: list[tuple[bytes, int]] = []

    def later(text, i) -> None:
        if isinstance(text, str):
            inner.append((text.encode("utf-8", "surrogatepass"), i))

    # (document, object) pairs of one level of outer objects after the other, until no document is left without its images or no object is
    at, opener = np.flatnonzero(image_list < 0), root[image_list < 0]
    while len(at):
        owner, member = x.children(opener)
        objects = x.m_kind[member] == OBJECT
        inside = x.m_open[member[objects]]
        found = x.value(inside, IMAGES)
        hit = found >= 0
        image_list[at[owner[objects][hit]]] = found[hit]
        for o, m in zip(owner[x.m_kind[member] == STRING], member[x.m_kind[member] == STRING]):
            if image_list[at[o]] < 0 and b"mages" in (raw := x.data[x.m_val0[m] : x.m_val1[m]].tobytes()):
                later(json.loads(raw) if _sound(raw) else None, ids[doc[at[o]]])
        still = image_list[at[owner[objects]]] < 0
        at, opener = at[owner[objects]][still], inside[still]
    for i in np.flatnonzero(x.ok & (x.data[x.head] == 34)):
        later(x.decode(x.head[i], x.tail[i] + 1), ids[i])

    owner, image, image_no = x.as_list(np.arange(len(root)), image_list)
    objects = x.m_kind[image] == OBJECT
    owner, image, image_no = owner[objects], image[objects], image_no[objects]
    i_id = ids[doc[owner]]
    yield _emit(i_id, len(image), "image", image_no=image_no)

    up, roi, roi_no = x.as_list(np.arange(len(image)), x.value(x.m_open[image], ROIS))
    objects = x.m_kind[roi] == OBJECT
    up, roi, roi_no = up[objects], roi[objects], roi_no[objects]
    r_id, r_image = i_id[up], image_no[up]
    opener = x.m_open[roi]
    typed = _numbers(x.texts(x.value(opener, ROI_TYPE)))
    whole = np.isfinite(typed) & (np.abs(typed) < 2**31) & (typed == np.floor(np.where(np.isfinite(typed), typed, 0)))
    roi_type = np.where(whole, np.where(whole, typed, 0), -1).astype(np.int64)
    yield _emit(r_id, len(roi), "roi", image_no=r_image, roi_no=roi_no, roi_type=roi_type, roi_name=x.texts(x.value(opener, ROI_NAME)))

    up, point, point_no = x.as_list(np.arange(len(roi)), x.value(opener, POINTS))
    px, py = np.full(len(point), np.nan), np.full(len(point), np.nan)
    kind = x.m_kind[point] if len(point) else np.zeros(0, int)
    s = np.flatnonzero(kind == STRING)
    if len(s):
        pair = pc.extract_regex(x.texts(point[s]), _PAIR)
        px[s], py[s] = _numbers(pc.struct_field(pair, "x")), _numbers(pc.struct_field(pair, "y"))
    o = np.flatnonzero(kind == OBJECT)
    px[o], py[o] = (_numbers(x.texts(x.value(x.m_open[point[o]], (k,)))) for k in ("x", "y"))
    a = np.flatnonzero(kind == ARRAY)
    who, element = x.children(x.m_open[point[a]])
    for k, out in ((0, px), (1, py)):
        at = x.m_index[element] == k
        out[a[who[at]]] = _numbers(x.texts(element[at]))
    good = (px >= 0) & (py >= 0) & np.isfinite(px) & np.isfinite(py)
    up, n = up[good], int(good.sum())
    yield _emit(r_id[up], n, "point", image_no=r_image[up], roi_no=roi_no[up], point_no=point_no[good], x=px[good], y=py[good])
    if inner:
        yield from _flatten([t for t, _ in inner], np.array([i for _, i in inner], np.int64))


def _sound(raw: bytes) -> bool:
    try:
        json.loads(raw)
    except ValueError:
        return False
    return True


def _flatten_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, bodies = b.column(0).to_numpy(zero_copy_only=False), b.column(1).cast(pa.binary())
        texts: list[bytes] = []
        begin = size = 0
        for k in range(len(ids) + 1):
            if k == len(ids) or size > CHUNK_BYTES:
                if texts:
                    yield from _flatten(texts, ids[begin:k])
                texts, begin, size = [], k, 0
            if k < len(ids):
                texts.append(bodies[k].as_py())
                size += len(texts[-1])


def flatten_documents(records: DataFrame, id_col: str = "xml_id", body_col: str = "body") -> DataFrame:
    """Images, ROIs and points of annotation documents as linked rows.

    Rows: kind (image, roi, point), record_id, image_no, roi_no, point_no,
    roi_type, roi_name, x, y. Numbers are positions in the parent's array as
    stored, -1 where a level does not apply. Images and ROIs count if they are
    objects, points if x and y read as numbers not below 0; a lone value in
    place of a list is a list of one. Null, empty, cut off and unbalanced bodies
    give no rows, nor does a null id; repeated records give their rows each.
    No shuffle: every record is flattened where it is read.
    """
    got = records.where(F.col(id_col).isNotNull() & F.col(body_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(body_col).alias("body"))
    return got.mapInArrow(_flatten_batches, DDL)


def flatten_roi_entries(samples: DataFrame) -> DataFrame:
    """Entries of ``roi_entries`` with a path, in the same columns: kind roi_entry, record_id = sample_id, roi_no."""
    e = samples.where("sample_id is not null").select("sample_id", F.posexplode("roi_entries").alias("pos", "e"))
    filled = lambda c: F.coalesce(F.col(c).rlike(r"\S"), F.lit(False))
    return e.where(filled("e.roi_path") | filled("e.mask_path")).select(
        F.lit("roi_entry").alias("kind"),
        F.col("sample_id").alias("record_id"),
        F.lit(-1).alias("image_no"),
        F.col("pos").alias("roi_no"),
        F.lit(-1).alias("point_no"),
        F.lit(-1).alias("roi_type"),
        F.col("e.roi_path").alias("roi_path"),
        F.col("e.mask_path").alias("mask_path"),
    )


def flat_children(records: DataFrame, samples: DataFrame) -> DataFrame:
    """All children of both tables: kind, record_id, image_no, roi_no, point_no, roi_type."""
    cols = ["kind", "record_id", "image_no", "roi_no", "point_no", "roi_type"]
    return flatten_documents(records).select(cols).unionByName(flatten_roi_entries(samples).select(cols))
