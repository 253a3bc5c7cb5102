"""SentencePiece BPE encoding with source offsets, and decoding, as column operators.

A model file is read once per Python worker.  A text is normalised with the model's compiled character map (longest
prefix first), keeping for every normalised byte the source byte it came from.  Text is then cut before each run of
word markers; no piece of such a model crosses that border (this is checked on load, otherwise the text stays whole), so
each unit is merged alone and its pieces are remembered for the next time.  Piece borders are projected to source bytes.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Cache, table, worker_cache

MARK = "▁"
#: Bytes of units remembered per worker, twice.
CACHE_BYTES = 40_000_000
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(buf: bytes) -> Iterator[tuple[int, object]]:
    """The fields of one protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = buf[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(buf):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, buf[at : at + n]
            at += n
        else:
            n = 8 if kind == 1 else 4
            yield tag >> 3, buf[at : at + n]
            at += n


def char_map(blob: bytes) -> dict[bytes, bytes]:
    """The rules of a compiled character map: a double-array trie over source bytes, then zero-ended targets."""
    if not blob:
        return {}
    size = struct.unpack_from("<I", blob)[0]
    units, targets = np.frombuffer(blob, "<u4", size // 4, 4).tolist(), blob[4 + size :]
    offset = lambda u: (u >> 10) << ((u & 512) >> 6)
    rules: dict[bytes, bytes] = {}
    todo = [(offset(units[0]), b"")]
    while todo:
        base, prefix = todo.pop()
        for c in range(1, 256):
            at = base ^ c
            if at >= len(units) or units[at] & 0x800000FF != c:
                continue
            node, key = at ^ offset(units[at]), prefix + bytes([c])
            if units[at] >> 8 & 1:
                start = units[node] & 0x7FFFFFFF
                rules[key] = targets[start : targets.index(b"\0", start)]
            todo.append((node, key))
    return rules


#: One letter, as the cutting of units sees it.
LETTER = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]"


class _Units(Cache):
    """Remembers the packed ids of units, but not of long ones.  When it is full, the units that are not asked for again
    before it is full the next time are forgotten."""

    def __init__(self, merge, limit: int):
        super().__init__(limit)
        self.merge, self.older = merge, {}

    def __missing__(self, unit: str) -> bytes:
        if self.used > self.limit:
            self.older = dict(self)
            self.make_room()
        got = self.older.pop(unit, None) or self.merge(unit)
        if len(unit) <= 64:
            self.add([unit], [got])
        return got


class PieceModel:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            raw = f.read()
        self.pieces, self.scores, self.kinds = [], [], []
        self.eos = 2
        spec = {2: b"", 3: 1, 4: 1, 5: 1}
        for field, value in _fields(raw):
            if field == 1:
                p = dict(_fields(value))
                self.pieces.append(p[1].decode())
                self.scores.append(struct.unpack("<f", p[2])[0] if 2 in p else 0.0)
                self.kinds.append(p.get(3, NORMAL))
            elif field == 2:
                trainer = dict(_fields(value))
                if trainer.get(3, 1) != 2:
                    raise ValueError("only BPE models are supported")
                self.byte_fallback = bool(trainer.get(35, 0))
                self.suffix_space = bool(trainer.get(24, 0))
            elif field == 3:
                spec |= dict(_fields(value))
        self.dummy_prefix, self.trim, self.escape = bool(spec[3]), bool(spec[4]), bool(spec[5])
        if not self.escape or self.suffix_space or USER in self.kinds or UNUSED in self.kinds:
            raise ValueError("models with user-defined or unused pieces, or spaces at word ends, are not supported")
        self.eos = next((i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == CONTROL and p == "</s>"), self.eos)
        self.rules = char_map(spec[2])
        self.longest_rule = max(map(len, self.rules), default=0)
        starts = {k.decode("utf-8", "ignore")[:1] for k in self.rules} - {""}
        self.first = re.compile("[" + "".join(map(re.escape, sorted(starts))) + "]") if starts else None
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == NORMAL}
        self.byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        self.unit = self._units()
        if not self.byte_fallback:
            raise ValueError("models without byte fallback are not supported")
        self.cost = {p: -self.scores[i] for p, i in self.ids.items()}
        self.sizes = np.array([1 if k == BYTE else len(p.encode()) for p, k in zip(self.pieces, self.kinds, strict=True)], np.int64)
        self.is_byte = np.array([k == BYTE for k in self.kinds])
        self.source = self.sizes - 2 * np.array([p.count(MARK) for p in self.pieces])
        self.plain = [self._plain(i) for i in range(len(self.pieces))]

    def _units(self) -> re.Pattern:
        """Cuts a text where no piece reaches across: before word markers, after letters, before most first letters."""
        letter, joins = re.compile(LETTER), set()
        for p in self.ids:
            for a, b in zip(p, p[1:], strict=False):
                if b == MARK != a or letter.match(a) and not letter.match(b):
                    return re.compile("(?s).+")
                if letter.match(b) and not letter.match(a) and a != MARK:
                    joins.add(a)
        join = f"[{''.join(map(re.escape, sorted(joins)))}]" if joins else "(?!)"
        other = f"[^{MARK}{LETTER[1:]}"
        return re.compile(f"{MARK}*(?:{LETTER}+|{other}*{join}{LETTER}+|{other}+)|{MARK}+")

    def _plain(self, i: int) -> bytes:
        if self.kinds[i] == CONTROL:
            return b""
        if self.kinds[i] == BYTE:
            return bytes([int(self.pieces[i][3:5], 16)])
        if self.kinds[i] == UNKNOWN:
            return b" \xe2\x81\x87 "
        return self.pieces[i].replace(MARK, " ").encode()

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its bytes and its end the source byte that it stands for."""
        src = text.encode()
        if not src:
            return "", np.zeros(1, np.int32)
        if self.first is None or not self.first.search(text):
            out, origin = src, np.arange(len(src) + 1, dtype=np.int32)
        else:
            parts, runs, at = [], [], 0
            while at < len(src):
                for n in range(min(self.longest_rule, len(src) - at), 0, -1):
                    if (to := self.rules.get(src[at : at + n])) is not None:
                        break
                else:
                    lead = src[at]
                    n = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                    to = src[at : at + n]
                parts.append(to)
                runs.append((at, len(to)))
                at += n
            out = b"".join(parts)
            origin = np.append(np.repeat([a for a, _ in runs], [n for _, n in runs]), len(src)).astype(np.int32)
        if self.trim:
            keep = np.ones(len(out), bool)
            raw = np.frombuffer(out, np.uint8) == 32
            keep[1:] &= ~(raw[1:] & raw[:-1])
            full = np.flatnonzero(~raw)
            if not len(full):
                return "", np.zeros(1, np.int32)
            keep[: full[0]] = False
            keep[full[-1] + 1 :] = False
            out, origin = bytes(np.frombuffer(out, np.uint8)[keep]), np.append(origin[:-1][keep], origin[full[-1] + 1])
        spaces = np.frombuffer(out, np.uint8) == 32
        origin = np.append(np.repeat(origin[:-1], np.where(spaces, 3, 1)), origin[-1])
        out = out.replace(b" ", MARK.encode())
        if self.dummy_prefix:
            out, origin = MARK.encode() + out, np.concatenate([np.full(3, origin[0]), origin])
        inside = (np.frombuffer(out, np.uint8) & 0xC0) == 0x80
        if inside.any():  # a border inside a character, as byte pieces have it, falls back to the character's start
            lead = np.maximum.accumulate(np.where(inside, 0, np.arange(len(out))))
            origin = np.append(origin[:-1][lead], origin[-1])
        return out.decode("utf-8", "replace"), origin.astype(np.int32)

    def _merge(self, unit: str) -> bytes:
        """The ids of a unit as packed 32-bit numbers: the best pair is merged first, the leftmost of equals."""
        cost, symbols, none = self.cost, list(unit), float("inf")
        costs = [cost.get(a + b, none) for a, b in zip(symbols, symbols[1:], strict=False)]
        if len(symbols) > 48:
            symbols = self._merge_long(symbols, costs)
        else:
            while costs and (best := min(costs)) < none:
                i = costs.index(best)
                symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
                del costs[i]
                if i:
                    costs[i - 1] = cost.get(symbols[i - 1] + symbols[i], none)
                if i < len(costs):
                    costs[i] = cost.get(symbols[i] + symbols[i + 1], none)
        ids, out = self.ids, []
        for s in symbols:
            if (i := ids.get(s)) is not None:
                out.append(i)
            else:
                out += [self.byte_ids[b] for b in s.encode()]
        return np.array(out, "<i4").tobytes()

    def _merge_long(self, symbols: list[str], costs: list[float]) -> list[str]:
        """The same for a unit of any length, with a heap of pairs instead of a search in each step."""
        cost, n, none = self.cost, len(symbols), float("inf")
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(c, i, i + 1, symbols[i] + symbols[i + 1]) for i, c in enumerate(costs) if c < none]
        heapq.heapify(heap)
        while heap:
            _, a, b, both = heapq.heappop(heap)
            if not symbols[a] or not symbols[b] or after[a] != b or symbols[a] + symbols[b] != both:
                continue
            symbols[a], symbols[b], after[a] = both, "", after[b]
            if after[b] < n:
                before[after[b]] = a
            for x, y in ((before[a], a), (a, after[a])):
                if x >= 0 and y < n and (c := cost.get(new := symbols[x] + symbols[y])) is not None:
                    heapq.heappush(heap, (c, x, y, new))
        return [s for s in symbols if s]

    def encode(self, text: str, end: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and for each id the source byte at which its piece ends (pieces follow one another)."""
        plain = not self.trim and MARK not in text and not (self.first and self.first.search(text))
        if plain:  # the normaliser changes spaces only: a piece's share of the source follows from the piece
            norm = text.replace(" ", MARK)
            norm = MARK + norm if self.dummy_prefix and norm else norm
        else:
            norm, origin = self.normalise(text)
        known = worker_cache(("pieces", id(self)), lambda: _Units(self._merge, CACHE_BYTES))
        ids = np.frombuffer(b"".join(map(known.__getitem__, self.unit.findall(norm))), "<i4")
        if plain and len(ids) and not self.is_byte[ids].any():
            ends = np.cumsum(self.source[ids]) - self.dummy_prefix
        elif len(ids):
            if plain:
                norm, origin = self.normalise(text)
            ends = origin[np.cumsum(self.sizes[ids])]
        else:
            ends = ids
        if end:
            ids, ends = np.append(ids, np.int32(self.eos)), np.append(ends, np.int32(len(text.encode())))
        return ids.astype(np.int32), ends.astype(np.int32)

    def decode(self, ids: list[int]) -> str:
        """The text of ids; a run of byte pieces is read as UTF-8, each byte that fits nowhere as U+FFFD."""
        plain = self.plain
        text = b"".join([plain[i] for i in ids])
        try:
            out = text.decode()
        except UnicodeDecodeError:
            out = "".join(c if c.isprintable() or ord(c) < 0xDC80 or ord(c) > 0xDCFF else "�" for c in text.decode("utf-8", "surrogateescape"))
        if self.dummy_prefix or self.trim:
            first = next((i for i in ids if self.kinds[i] != CONTROL), None)
            if first is not None and self.kinds[first] == NORMAL and out.startswith(" "):
                out = out[1:]
        return out


@lru_cache(maxsize=4)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


ENCODED = "ids array<int>, ends array<int>"


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """id, ``ids`` (end id last) and ``ends``: piece i covers source bytes [ends[i-1], ends[i]) of the UTF-8 text.

    With ``decode`` also ``decoded``, the text of the ids, made in the same pass.  Null text counts as empty and gives the
    end id alone.  One row in, one row out, for repeated rows too; other columns are dropped.  Whole texts are encoded,
    whatever their length; work is row by row, so no shuffle.
    """

    def run(batches):
        model = piece_model(model_path)
        for b in batches:
            for part in range(0, b.num_rows, 500):
                rows = b.slice(part, 500)
                got = [model.encode(t or "") for t in rows.column(1).to_pylist()]
                sizes = np.cumsum([0, *(len(i) for i, _ in got)]).astype(np.int32)
                arrays = [pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate([x[k] for x in got]))) for k in (0, 1)]
                said = [pa.array([model.decode(ids.tolist()) for ids, _ in got], pa.string())] if decode else []
                yield pa.RecordBatch.from_arrays([rows.column(0), *arrays, *said], names=["_id", "ids", "ends", "decoded"][: 3 + decode])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(run, f"_id {rows.schema['_id'].dataType.simpleString()}, {ENCODED}" + ", decoded string" * decode).withColumnRenamed("_id", id_col)


def decode_pieces(encoded: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with a column ``decoded``: the text of its ids; null ids give null."""

    @F.pandas_udf("string")
    def text(ids):
        model = piece_model(model_path)
        return ids.map(lambda x: None if x is None else model.decode(x.tolist()))

    return encoded.withColumn("decoded", text(F.col(ids_col)))


def piece_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """Encode, decode, and reduce each document to counts and digests, in one pass over Arrow batches.

    Same ids and text as ``encode_pieces`` and ``decode_pieces``; the arrays stay inside the task.
    ``last_end`` is the source byte at which the last piece ends, ``n_bytes`` of a text that is covered whole.
    """

    def run(batches):
        model = piece_model(model_path)
        for b in batches:
            for part in range(0, b.num_rows, 256):
                rows = b.slice(part, 256)
                counts, shas, decoded, last = [], [], [], []
                for t in rows.column(1).to_pylist():
                    ids, ends = model.encode(t or "")
                    listed = ids.tolist()
                    counts.append(len(listed))
                    shas.append(hashlib.sha256(" ".join(map(str, listed)).encode()).hexdigest())
                    decoded.append(hashlib.sha256(model.decode(listed).encode("utf-8", "surrogatepass")).hexdigest())
                    last.append(int(ends[-1]))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(decoded, pa.string()), pa.array(last, pa.int64())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "last_end"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string, last_end long")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op6_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    """Every document's token ids and the text that they decode to, as digests."""
    return piece_digests(table(spark, sf_dir, "documents"), model_path or default_model())
