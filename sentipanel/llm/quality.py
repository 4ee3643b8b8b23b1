"""Quality rules: base counts, then the divergence of a document from its language.

Each language gets two references from all its documents, every document counting alike: the
shares of eight character classes, and the shares of the language's most frequent words with all
other words as one class.  A document's own histograms are compared with them by Jensen-Shannon
distance (square root of the divergence in bits, 0 to 1).  A comparison is made only for
documents of at least a minimum length and languages of at least a minimum number of documents.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut_lineage, drop_clashing, skew_join, text_of

SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
CLASSES = ("lower", "upper", "letter", "digit", "space", "point", "symbol", "other")
RESULTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "word_distance",
           "base_failed", "kept"]
UNIT = 1_000_000  # shares are summed as whole millionths, so sums do not depend on the order
FLUSH = 200_000   # words of a language a task holds before it emits them
FLUSH_BYTES = 32 << 20  # the same for the bytes of all words it holds
BROADCAST_BYTES = 8 << 20  # of the references' words; wider references are joined by shuffle

_CLASS_OF: list[np.ndarray] = []


def class_table() -> np.ndarray:
    """Character class of every code point below 65536; those above count as the last."""
    if not _CLASS_OF:
        def of(c: int) -> int:
            ch = chr(c)
            if ch in SPACES:
                return 4
            if ch in SYMBOLS:
                return 6
            cat = unicodedata.category(ch)
            return {"Ll": 0, "Lu": 1, "Nd": 3}.get(cat, 2 if cat[0] in "LM" else 5 if cat[0] == "P" else 7)
        _CLASS_OF.append(np.array([of(c) for c in range(65536)], dtype=np.uint8))
    return _CLASS_OF[0]


def class_counts(text: str) -> np.ndarray:
    total = np.zeros(len(CLASSES), dtype=np.int64)
    table = class_table()
    for at in range(0, len(text), 1 << 20):
        cp = np.frombuffer(text[at:at + (1 << 20)].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        total += np.bincount(np.where(cp < 65536, table[np.minimum(cp, 65535)], 7), minlength=len(CLASSES))
    return total


def repeated_words(words: list, size: int = 5) -> int:
    """Words that lie in a window of ``size`` words found twice or more, the first one included."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    number: dict = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
    code, base, top = ids[:n], len(number), len(number)
    for k in range(1, size):
        if top * base >= 1 << 62:  # renumber before the code would overflow
            code = np.unique(code, return_inverse=True)[1].astype(np.int64)
            top = int(code.max()) + 1
        code, top = code * base + ids[k:k + n], top * base
    _, inverse, counts = np.unique(code, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[inverse] > 1)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + size, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    words = text.encode("utf-8", "surrogatepass").split()  # of bytes: splits at exactly the six ASCII spaces
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    return (len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), dup, repeated_words(words))


def distance(counts: np.ndarray, ref: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms, in base 2."""
    p, q = counts / counts.sum(), ref / ref.sum()
    m = (p + q) / 2
    half = lambda x: float((x[x > 0] * np.log2(x[x > 0] / m[x > 0])).sum())
    return max(0.0, (half(p) + half(q)) / 2) ** 0.5


def language_references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", top_words: int = 64) -> DataFrame:
    """Per language: ``__classes`` (sums of shares), ``__words`` and ``__shares`` of its most frequent words of any
    length, ``__docs``.  Tasks count whole texts and emit bounded batches of sums, so what is
    shuffled is pre-aggregated; a language is one key, whatever its share of the rows."""
    d = docs.select(F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), text_of(text_col).alias("text"))

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str], dict] = {}  # (language, kind): sums by item
        held = 0  # bytes of the words in sums

        def emit():
            rows = [(lang, kind, item.decode("utf-8", "replace") if isinstance(item, bytes) else item, n) for (lang, kind), x in sums.items() for item, n in x.items()]
            cols = list(zip(*rows)) or [[], [], [], []]
            sums.clear()
            return pa.RecordBatch.from_arrays([*map(_strings, cols[:3]), pa.array(cols[3], pa.int64())], ["lang", "kind", "item", "n"])
        for b in it:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                if not text:
                    continue
                docs_, classes, words = (sums.setdefault((lang, kind), {}) for kind in ("docs", "class", "word"))
                docs_[""] = docs_.get("", 0) + 1
                cls = class_counts(text)
                for name, v in zip(CLASSES, (cls * UNIT // cls.sum()).tolist()):
                    classes[name] = classes.get(name, 0) + v
                own = _lower_words(text)
                n = max(1, len(own))
                get = words.get
                for w, v in Counter(own).items():
                    old = get(w)
                    if old is None:
                        held += len(w)
                        old = 0
                    words[w] = old + v * UNIT // n
                if len(words) >= FLUSH or held >= FLUSH_BYTES:
                    yield emit()
                    held = 0
        yield emit()

    sums = (d.mapInArrow(count, "lang string, kind string, item string, n long")
             .groupBy("lang", "kind", "item").agg(F.sum("n").alias("n")))
    rank = F.row_number().over(Window.partitionBy("lang", "kind").orderBy(F.col("n").desc(), "item"))
    top = sums.withColumn("r", rank).where(F.col("r") <= top_words)
    by = lambda kind: F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("r", "item", "n"))))
    ref = top.groupBy("lang").agg(by("class").alias("c"), by("word").alias("w"),
                                  F.max(F.when(F.col("kind") == "docs", F.col("n"))).alias("__docs"))
    of = lambda name: F.coalesce(F.get(F.filter("c", lambda x: x["item"] == name), F.lit(0))["n"], F.lit(0))
    return ref.select(F.col("lang").alias("__lang"), F.array(*[of(c) for c in CLASSES]).alias("__classes"),
                      F.col("w.item").alias("__words"), F.col("w.n").alias("__shares"), "__docs")


def _lower_words(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").split()


def _strings(values) -> pa.Array:
    return pa.array(values, pa.string())


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                  max_class_distance: float = 0.25, max_word_distance: float = 0.5, min_chars: int = 200,
                  min_words: int = 50, min_lang_docs: int = 20, references: DataFrame | None = None, carry_text: bool = False) -> DataFrame:
    """Base counts, distances and verdict for every document.

    Returns the input's columns without the text (unless ``carry_text``), plus ``n_words``, ``word_chars``, ``n_symbols``,
    ``n_dup_lines``, ``n_repeat_words``, ``class_distance``, ``word_distance`` (null where the length
    guards make no comparison), ``base_failed`` and ``kept``.  Null text counts as empty and fails
    (no words).  Null languages are one language of their own.  Repeated rows are judged alike;
    an empty table gives an empty result; input columns named like a result are replaced.
    """
    ref = cut_lineage(references if references is not None else language_references(docs, text_col, lang_col))
    wide = (ref.agg(F.sum(F.octet_length(F.concat_ws("", "__words")))).first()[0] or 0) > BROADCAST_BYTES
    ref, small = (ref, False) if wide else broadcast_if_small(ref, 2_000)
    d = drop_clashing(docs, RESULTS)
    keep = [c for c in d.columns if carry_text or c != text_col]
    d = (d.withColumns({"__t": text_of(text_col), "__lang": F.coalesce(F.col(lang_col), F.lit(""))})
          .transform(lambda x: x.join(ref, "__lang", "left") if small else skew_join(x, ref, ["__lang"], "left")).select(*keep, "__t", "__lang", "__classes", "__words", "__shares", "__docs"))
    added = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
             "class_distance double, word_distance double")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields if f.name in keep] + [added])

    def judge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs: dict = {}
        for b in it:
            rows = []
            for text, lang, n_docs, classes, words, shares in zip(*(b.column(c).to_pylist() for c in ("__t", "__lang", "__docs")), *(b.column(c) for c in ("__classes", "__words", "__shares"))):
                base = base_counts(text)
                by_class = by_word = None
                if n_docs is not None and n_docs >= min_lang_docs:
                    if lang not in refs:
                        classes, words, shares = classes.as_py(), words.as_py(), shares.as_py()
                        share = np.array(list(shares) + [max(0, n_docs * UNIT - sum(shares))], dtype=np.float64)
                        refs[lang] = ({w.encode(): i for i, w in enumerate(words)}, share, np.array(list(classes), dtype=np.float64))
                    index, share, of_class = refs[lang]
                    if len(text) >= min_chars:
                        by_class = distance(class_counts(text), of_class)
                    if base[0] >= min_words:
                        own = np.zeros(len(share))
                        found = Counter(_lower_words(text))
                        for w, i in index.items():
                            own[i] = found.get(w, 0)
                        own[-1] = base[0] - own.sum()
                        by_word = distance(own, share)
                rows.append((*base, by_class, by_word))
            cols = list(zip(*rows)) or [[]] * 7
            new = [pa.array(c, pa.int64() if i < 5 else pa.float64()) for i, c in enumerate(cols)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *new], [*keep, *(x.split()[0] for x in added.split(", "))])

    out = d.mapInArrow(judge, schema)
    out = out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    far = (F.coalesce(F.col("class_distance") > max_class_distance, F.lit(False))
           | F.coalesce(F.col("word_distance") > max_word_distance, F.lit(False)))
    return out.withColumn("kept", ~F.col("base_failed") & ~far)
