"""SentencePiece encoding of merge-type (BPE) vocabularies with a score-ordered agenda.

Symbols of a text are merged pair by pair: an agenda holds the adjacent pairs whose join is a
piece, best score first, leftmost first on ties.  Popping a pair merges it and offers the two new
neighbour pairs; entries whose symbols have changed since are skipped.

A merge can only span characters that some piece holds next to each other.  No piece of such a
vocabulary has a space mark after another character (checked when the model is loaded), so a text
falls into units, a run of space marks with the characters up to the next mark, that can be encoded
on their own.  Frequent units are looked up; the new ones of some texts are merged together, a column of a matrix
being the agenda of a unit, which merges its best pair a round.  Work runs in Arrow batches (``mapInArrow``), rows stay
in their partition, and memory is bounded by a batch, the units of some texts or one, and two generations of the table.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

MARK = "▁"
TABLE_ROWS = 300_000  # units kept in each of two generations
NEVER = float("inf")
SHORT = 24            # longer units keep their agenda in a heap
TABLE_CHARS = 32      # longer units are not kept
GROUP_CHARS = 2_000_000  # characters of the texts whose new units are merged together


class Known(dict):
    """Ids of units in two generations; a unit asked for the first time gets an empty list, which is filled before ``close``."""

    def __init__(self):
        self.old: dict[str, list[int]] = {}
        self.new: list[tuple[str, list[int]]] = []

    def __missing__(self, unit: str) -> list[int]:
        ids = self.old.get(unit)
        if ids is None:
            ids = []
            self.new.append((unit, ids))
        self[unit] = ids
        return ids

    def close(self, rows: int) -> None:
        for u, _ in self.new:
            if len(u) > TABLE_CHARS:
                del self[u]
        self.new.clear()
        if len(self) >= rows:
            self.old = dict(self)
            self.clear()


class PieceModel:
    """A merge-type sentencepiece model: vocabulary and settings from the library, merging done here."""

    def __init__(self, path: str, table_rows: int = TABLE_ROWS):
        import sentencepiece
        self.table_rows = table_rows
        self.lib = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        plain = [i for i in range(n) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        self.ids = {lib.id_to_piece(i): i for i in plain}
        self.rank = {p: -lib.get_score(i) for p, i in self.ids.items()}  # best score first
        self.bytes = {b: lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)}
        self.unk = lib.unk_id()
        # symbols are piece ids, n + code point for a character without a piece, and a pad that joins with nothing
        self.n, self.pad = n, n + 0x110000
        self.char = np.arange(n, n + 0x110000, dtype=np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        symbol = lambda p: int(self.char[ord(p)]) if len(p) == 1 else self.ids.get(p)
        pairs = [(symbol(p[:k]), symbol(p[k:]), i) for p, i in self.ids.items() for k in range(1, len(p))]
        pairs = sorted((a * (self.pad + 1) + b, i) for a, b, i in pairs if a is not None and b is not None)
        self.pairs = np.array([k for k, _ in pairs] + [np.iinfo(np.int64).max])
        self.joined = np.array([i for _, i in pairs] + [n], dtype=np.int32)  # n: no piece
        cost = np.full(n + 1, NEVER)
        for p, i in self.ids.items():
            cost[i] = self.rank[p]
        self.cost = np.unique(cost, return_inverse=True)[1].astype(np.int32)  # equal scores stay equal
        self.decimal = [str(i) for i in range(n)]
        self.byte_fallback = all(lib.is_byte(i) for i in self.bytes.values())
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids):
            raise ValueError("a piece spans a space mark: texts of this model do not fall into units")
        joined = {c for p in self.ids if len(p) > 1 for c in p}
        cut = "" if "\n" in joined else "\n"  # a line feed that no longer piece holds is a unit by itself
        self.units = re.compile(f"{cut}|{MARK}*[^{MARK}{cut}]+|{MARK}+" if cut else f"{MARK}*[^{MARK}]+|{MARK}+").findall
        self.known = Known()
        probe = "  a\n b  c. ☃ "
        if self.encode(probe) != lib.encode(probe):
            raise ValueError("the model's settings are not a plain merge vocabulary with a space put before the text")

    def _join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair of symbols joins to, n if none."""
        key = left.astype(np.int64) * (self.pad + 1) + right
        at = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[at] == key, self.joined[at], np.int32(self.n))

    def merge(self, units: list[tuple[str, list[int]]]) -> None:
        """Put the ids of each unit into its list."""
        by_width: dict[int, list[tuple[str, list[int]]]] = {}
        for x in units:
            by_width.setdefault((len(x[0]) + 3) // 4 * 4, []).append(x)
        for width, group in by_width.items():
            names, into = zip(*group)
            if width > SHORT:
                for u, ids in group:
                    ids.extend(self._merge_long(u))
                continue
            lens = np.fromiter(map(len, names), dtype=np.int64, count=len(names))
            sym = np.full((len(names), width + 2), self.pad, dtype=np.int32)
            sym[:, 1:-1][np.arange(width) < lens[:, None]] = self.char[np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
            sym = np.ascontiguousarray(sym.T)  # a unit is a column
            agenda = self._join(sym[:-1], sym[1:])
            unit = np.arange(len(names))
            while True:
                cost = self.cost[agenda]
                low, i = cost[0].copy(), np.zeros(len(unit), dtype=np.int32)
                for k in range(1, len(cost)):  # the leftmost of the best
                    i[cost[k] < low] = k
                    np.minimum(low, cost[k], out=low)
                live = low < self.cost[self.n]
                self._done(sym[:, ~live].T, unit[~live], into)
                if not live.any():
                    break
                at = np.flatnonzero(live)
                sym, agenda, unit, i = sym.take(at, axis=1), agenda.take(at, axis=1), unit[at], i[at]
                cols, row = np.arange(len(at)), np.arange(len(sym) - 1, dtype=np.int32)[:, None]
                sym[i, cols] = new = agenda[i, cols]
                sym = np.where(row <= i, sym[:-1], sym[1:])
                agenda = np.where(row[:-1] < i, agenda[:-1], agenda[1:])
                agenda[i - 1, cols] = self._join(sym[i - 1, cols], new)  # a pad comes first and last, so both are there
                agenda[i, cols] = self._join(new, sym[i + 1, cols])

    def _done(self, sym: np.ndarray, unit: np.ndarray, into: tuple[list[int], ...]) -> None:
        real = sym != self.pad
        ends = real.sum(axis=1).cumsum().tolist()
        flat, odd = sym[real].tolist(), ((sym >= self.n) & real).any(axis=1).tolist()
        for u, start, end, other in zip(unit.tolist(), [0, *ends], ends, odd):
            ids = flat[start:end]
            into[u].extend(self._ids([chr(x - self.n) if x >= self.n else x for x in ids]) if other else ids)

    def _merge_long(self, unit: str) -> list[int]:
        """Ids of one unit by a heap of adjacent pairs."""
        rank, sym = self.rank.get, list(unit)
        n = len(sym)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            whole = sym[i] + sym[i + 1]
            r = rank(whole)
            if r is not None:
                agenda.append((r, i, whole))
        heapq.heapify(agenda)
        pop, push = heapq.heappop, heapq.heappush
        while agenda:
            _, i, whole = pop(agenda)
            j = nxt[i]
            if j >= n or not sym[i] or sym[i] + sym[j] != whole:
                continue
            sym[i], sym[j] = whole, ""
            k = nxt[i] = nxt[j]
            if k < n:
                prv[k] = i
                both = whole + sym[k]
                r = rank(both)
                if r is not None:
                    push(agenda, (r, i, both))
            k = prv[i]
            if k >= 0:
                both = sym[k] + whole
                r = rank(both)
                if r is not None:
                    push(agenda, (r, k, both))
        return self._ids(sym)

    def _ids(self, symbols: list[str | int]) -> list[int]:
        """Ids of symbols that are ids or strings, empty ones left out."""
        out: list[int] = []
        for p in symbols:
            if p == "":
                continue
            i = p if isinstance(p, int) else self.ids.get(p)
            if i is not None:
                out.append(i)
            elif self.byte_fallback:
                out.extend(self.bytes[b] for b in p.encode("utf-8"))
            else:
                out.append(self.unk)
        return out

    def _encode_group(self, texts: list[str]) -> list[list[int]]:
        known, get = self.known, self.known.__getitem__
        found = [list(map(get, self.units(MARK + t.replace(" ", MARK)))) if t else [] for t in texts]
        self.merge(known.new)
        known.close(self.table_rows)
        return [list(chain.from_iterable(f)) for f in found]

    def encode_all(self, texts: list[str]) -> Iterator[list[int]]:
        """Ids of each text; the texts are taken in groups of some GROUP_CHARS characters."""
        group, chars = [], 0
        for t in texts:
            group.append(t)
            chars += len(t)
            if chars >= GROUP_CHARS:
                yield from self._encode_group(group)
                group, chars = [], 0
        yield from self._encode_group(group)

    def encode(self, text: str) -> list[int]:
        return list(self.encode_all([text]))[0]


_MODELS: dict[tuple[str, int], PieceModel] = {}


def model(path: str, table_rows: int = TABLE_ROWS) -> PieceModel:
    """The model at ``path``, loaded once in each Python worker."""
    if (path, table_rows) not in _MODELS:
        _MODELS[path, table_rows] = PieceModel(path, table_rows)
    return _MODELS[path, table_rows]


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
                  check_texts: int = 1, ids_out: bool = True, table_rows: int = TABLE_ROWS) -> DataFrame:
    """Encode and decode every whole text.

    A worker remembers the ids of up to twice ``table_rows`` units (it keeps them for its next task); that bounds memory and changes no result.

    Returns the id column, ``n_tokens``, ``ids`` (array, if ``ids_out``), ``ids_sha256`` (of the decimal ids joined by
    commas) and ``decoded_sha256`` (of the decoded text in UTF-8); one row per input row, in any
    order, repeated rows too.  Null text counts as empty and has no ids.  Other input columns are
    dropped.  In every Arrow batch the first ``check_texts`` texts are encoded by the library as
    well, and a difference raises an error (a negative number checks all).
    """
    d = docs.select(F.col(id_col).alias("__id"), text_of(text_col).alias("__t"))
    fields = "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if ids_out else "")
    schema = f"__id {d.schema['__id'].dataType.simpleString()}, {fields}"

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_path, table_rows)
        for b in it:
            n, sha, decoded, all_ids = [], [], [], []
            texts = b.column("__t").to_pylist()
            for k, (text, ids) in enumerate(zip(texts, m.encode_all(texts))):
                if (check_texts < 0 or k < check_texts) and ids != m.lib.encode(text):
                    raise ValueError(f"ids differ from the library's for a text of {len(text)} characters")
                n.append(len(ids))
                sha.append(hashlib.sha256(",".join(map(m.decimal.__getitem__, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(m.lib.decode(ids).encode("utf-8")).hexdigest())
                if ids_out:
                    all_ids.append(pa.array(ids, pa.int32()))
            cols = [b.column("__id"), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(decoded, pa.string())]
            if ids_out:
                cols.append(pa.array([x.to_numpy() for x in all_ids], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, ["__id", *(f.split()[0] for f in fields.split(", "))])

    return d.mapInArrow(batches, schema).withColumnRenamed("__id", id_col)
